"""The native way against the rules of the language and the kernel."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sievewright.operators.baseline import find_standard
from sievewright.operators.match import match_all
from sievewright.operators.native import CHUNK, NoNativeWay, cut_groups, has_native_way, native_matches, running_sums, scan_of
from sievewright.patterns import PatternSet
from sievewright.sources.text import from_strings
from tests.simulator import matches
from tests.test_matching import fuzz, got, want


def shape(rng):
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    atom = lambda: rng.choice([word(), ".", "[ab]", "[^a]", "[b-c]", "[]", "é"])
    return "|".join("".join(atom() + rng.choice(["", "", "?", "*", "+"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 2)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_native_way_is_that_of_the_rules(spark, seed):
    rng = random.Random(seed)
    patterns = []
    while len(patterns) < 24:
        p = shape(rng)
        if has_native_way(p) and p not in patterns:
            patterns.append(p)
    texts = ["".join(rng.choice("aabbcé d\n😀") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    df = from_strings(spark, texts)
    assert got(match_all(df, PatternSet.of(patterns), strategy="native")) == want(patterns, texts)


@pytest.mark.parametrize("chunk", [1, 2, 7])
def test_pieces_do_not_matter(spark, chunk):
    patterns = ["a+", "ab|abc", "th[a-z]+ed", ".b", "[^a]b", "b", "c*a", "e"]
    texts = ["abcabaaab" * 9, "thaaaaaed thed thoed" * 4, "", "b" * 50, "a😀ba" * 5]
    ps, df = PatternSet.of(patterns), from_strings(spark, texts)
    out = set()
    for m in native_matches(df, ps, list(range(len(ps))), "text", ["doc_id"], True, chunk):
        for r in m.collect():
            assert r["matched_text"] == texts[r["doc_id"]][r["start_pos"] : r["end_pos"] + 1]
            out.add((r["doc_id"], patterns[r["pattern_id"]], r["start_pos"], r["end_pos"]))
    assert out == want(patterns, texts)


def test_long_texts_and_runs(spark):
    """Runs longer than a piece, and loops of thousands of rounds, which must not recurse."""
    texts = ["x" + "a" * (3 * CHUNK), "th" * 6000, "ab" * (2 * CHUNK) + "é" * 10, "b" * (2 * CHUNK) + "-" + "1" * 300]
    ps, df = PatternSet.of(["xa+", "th+", "é+", "1-|b-1+", "a|ab"]), from_strings(spark, texts)
    native = match_all(df, ps, strategy="native")
    assert native.exceptAll(match_all(df, ps, strategy="dfa")).count() == 0 and native.count() == match_all(df, ps, strategy="dfa").count()


def test_repeated_rows_nulls_and_no_python(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, None), (3, "")], "id long, text string")
    m = match_all(df, PatternSet.of(["ab?", "b+", "[a-b]"]), keys=["id"], strategy="native")
    k = match_all(df, PatternSet.of(["ab?", "b+", "[a-b]"]), keys=["id"], strategy="dfa")
    assert sorted(map(str, m.collect())) == sorted(map(str, k.collect()))
    plan = m._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_one_scan_for_all_bounded_patterns(spark, tmp_path):
    from_strings(spark, ["abc"]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    m = match_all(df, PatternSet.of(["a", "bc", "a.c", "[a-f]x", "a+", "b+c", "[0-9]+"]), strategy="native")
    assert m._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2  # the bounded, and one group of cuts
    assert len(cut_groups([(i, scan_of(p)) for i, p in enumerate(["a+", "[0-9]+"])])) == 1


def test_what_has_no_native_way(spark):
    for p in ("the.*", "the.*[.]", "[^]+", ".+"):
        with pytest.raises(NoNativeWay):
            match_all(from_strings(spark, ["x"]), PatternSet.of([p]), strategy="native")
    assert has_native_way("") and match_all(from_strings(spark, ["x"]), PatternSet.of(["", "[]"]), strategy="native").count() == 0


def test_fuzzed_shapes(spark):
    patterns, texts = fuzz(7, 40, 8)
    patterns = [p for p in patterns if has_native_way(p)]
    assert len(patterns) > 20
    assert got(match_all(from_strings(spark, texts), PatternSet.of(patterns), strategy="native")) == want(patterns, texts)
    assert list(matches("ab", "ab")) == [(0, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_standard_matches_have_their_places(spark, seed):
    """The JVM's walk against Python's, with characters of two units, long runs and a tail without matches."""
    rng = random.Random(seed)
    patterns = ["a+", "b|bc", "(a)b?", ".c", "[^a]", "😀|é+", "(?:ab)+", "c*", "zz"]
    texts = ["".join(rng.choice("aabbcé d\n😀") for _ in range(rng.randint(0, 60))) for _ in range(20)] + ["ab" * 3000 + "x" * 2000, "", "c"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    ways = [{(r["doc_id"], r["pattern"], r["start_pos"], r["end_pos"]) for r in find_standard(df, patterns, most_walks=n).collect()} for n in (20, 0)]
    assert ways[0] == ways[1] == {(i, p, m.start(), m.end() - 1) for i, t in enumerate(texts) for p in patterns for m in re.finditer(p, t, re.S) if m.end() > m.start()}
    plan = find_standard(df, patterns[:7])._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_running_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 511, 512, 513, 2000)], "x array<int>")
    for r in df.select("x", running_sums(F.col("x")).alias("s")).collect():
        assert r["s"] == list(itertools.accumulate(r["x"]))
