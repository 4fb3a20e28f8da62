import random

import pytest

from sievewright.operators.dfa_kernel import scan
from sievewright.patterns import PatternError, PatternSet, PatternSyntaxError, UnsupportedPattern, parse, try_parse
from tests.simulator import matches

GOLDEN = [
    ("a", "ab", {(0, 0)}), ("a+", "bab", {(1, 1)}), ("a+", "aa", {(0, 1), (1, 1)}), ("a+", "aaa", {(0, 2), (1, 2), (2, 2)}),
    ("a+", "ababaab", {(0, 0), (2, 2), (4, 5), (5, 5)}), ("ab", "ab ac", {(0, 1)}), ("ac", "ab ac", {(3, 4)}),
    ("den", "ll\nladen", {(5, 7)}), ("laden", "ll\nladen", {(3, 7)}), ("ll", "ll\nladen", {(0, 1)}),
    ("a|b", "b", {(0, 0)}), ("[ab]", "b", {(0, 0)}), ("[a-c]", "b", {(0, 0)}), (".", "z", {(0, 0)}), ("[^ab]", "c", {(0, 0)}), ("a?b", "b", {(0, 0)}),
    ("ba*n", "baaaan", {(5, 5)}), ("frost", "winter frost and hoarfrost", {(7, 11), (21, 25)}),
    ("a|abc", "abd", set()), ("a|abc", "abc", {(0, 2)}), ("a|abc", "abd a abc", {(4, 4), (6, 8)}),
    ("foo.*bar", "foo---bar\nthe world", set()), ("foo.*bar", "foo x bar", {(0, 8)}),
    ("foo[a-z]+bar", "fooquxbar in", {(0, 8)}), ("foo[a-z]+bar", "fooquxbarx in", set()),
    ("ab+", "ababb", {(0, 3), (2, 3)}), ("ab?c", "c abc ac", {(0, 0), (2, 4), (4, 4), (7, 7)}),
    ("[^a]", "a", {(0, 0)}), ("[^a]b", "ab", {(0, 1)}), ("b[^a]", "ba", set()), ("b[^a]", "bc", {(0, 1)}),
    ("[^a]+", "bba", {(2, 2)}), ("[^a]+", "bbb", {(0, 2), (1, 2), (2, 2)}), ("x[^a]b|xac", "xac", set()), ("[^a]b|ac", "xac", {(1, 2)}),
    ("a*", "b", set()), ("a*", "aab", {(0, 1), (1, 1)}), ("|b", "ab", {(1, 1)}), ("a|", "ab", {(0, 0)}),
    ("[a-]", "a-", {(0, 0)}), ("[]", "a", set()), ("[^]", "a", {(0, 0)}), ("(a)", "(a)", {(0, 2)}), ("a{2}", "aa a{2}", {(3, 6)}),
    (".", "a\n", {(0, 0), (1, 1)}), ("", "a", set()), ("a", "", set()), ("b", "a\U0001f600b", {(2, 2)}),
]


def found(pattern, text):
    out = set()
    for t in PatternSet.of([pattern]).tables():
        row, _, start, end = scan(t, ["zz", text, "a"])
        out |= {(int(s), int(e)) for r, s, e in zip(row, start, end, strict=True) if r == 1}
    return out


@pytest.mark.parametrize(("pattern", "text", "want"), GOLDEN)
def test_golden(pattern, text, want):
    assert matches(pattern, text) == want
    assert found(pattern, text) == want


def test_many_repeats():
    assert found("a+", "ab" * 600) == {(2 * i, 2 * i) for i in range(600)}


def test_universal_tail_is_cheap():
    text = "x" * 20_000
    assert len(found("x.*", text)) == 20_000
    assert len(found("x.*x", text)) == 19_999


@pytest.mark.parametrize("pattern", ["\\d", "\\", "[", "[-a]", "[z-a]", "?a", "*", "a|*", "[a-b-c]", "|+"])
def test_syntax_errors(pattern):
    with pytest.raises(PatternSyntaxError):
        parse(pattern)
    assert try_parse(pattern)[0] is None


@pytest.mark.parametrize("pattern", ["^a", "a$"])
def test_anchors(pattern):
    with pytest.raises(UnsupportedPattern):
        parse(pattern)


def test_accepted_oddities():
    assert found("[abc", "b") == {(0, 0)}
    assert parse("a?+").alternatives[0].items[0].optional
    assert parse("ab|cd").literals() == ["ab", "cd"]
    assert parse("a|abc").literals() is None  # a match would depend on what follows
    assert parse("ab+").literals() is None


def test_kernel_equals_simulator():
    rng, n = random.Random(1337), 0
    parts = ["a", "b", "c", "ab", "|", "?", "*", "+", ".", "[ab]", "[^a]", "[^bc]", "[a-c]", "[]", "[^]", ".*"]
    while n < 1500:
        p = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))
        try:
            parse(p)
        except PatternError:
            continue
        assert found(p, t) == matches(p, t), (p, t)
        n += 1


def test_pattern_set():
    s = PatternSet.of(["a", "b", "a"])
    assert s.sources == ("a", "b")
    assert s.add("a").actions == s.actions
    assert s.add("a", "x").actions[0] == ("match", "x")
    assert s.add("a", "x").remove("a").sources == ("a", "b")
    assert s.remove("a").sources == ("b",)
    assert s.remove("nothing") == s
    assert len(PatternSet.of([f"w{i}x" for i in range(300)]).tables(entries=2000)) > 1
