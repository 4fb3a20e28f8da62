import pytest
from pyspark.sql import functions as F

from sievewright.operators import prefilter as pf
from sievewright.patterns import PatternSet, parse
from sievewright.sources.text import from_strings


@pytest.mark.parametrize(
    ("regex", "literals"),
    [("a(?:b|cd)e", {"cd"}), (r"\Qhttp://\E[a-z]+\.com", {"http://"}), ("foo[a-z]+bar", {"foo", "bar"}), ("abc|def", {"abc", "def"}), ("^foo.*bar", {"foo"}), (r"test\.com", {"test.com"}), ("short|verylongpattern", {"verylongpattern"})],
)
def test_hints(regex, literals):
    assert pf.extract_hint(0, regex).literal in literals


def test_hint_fields():
    assert pf.extract_hint(3, "^foo.*bar").anchored_prefix
    assert pf.extract_hint(3, "FOO", case_insensitive=True).case_insensitive
    for none in (".*", "a", "^$"):
        assert pf.extract_hint(0, none) is None
    assert pf.extract_hint(0, "ab", options=pf.HintOptions(min_length=3)) is None


def test_safety():
    safe = lambda p: pf.is_safe_hint(p, pf.extract_hint(0, p))
    assert safe("fooo[a-z]+bar") and safe("hello") and not safe("abc|def") and not safe(".foo")
    assert not safe("ab*c") and not safe("ab?c")  # the run is optional
    assert not pf.is_safe_hint(None, None)


def test_score_as_column(spark):
    words = ["the", "zxq", "a1-b", "ünit", "test.com", "LIKE", "`~"]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("s", pf.selectivity_column(F.col("w")))
    assert {r["w"]: r["s"] for r in df.collect()} == {w: pf.selectivity(w) for w in words}


def test_candidates(spark):
    df = from_strings(spark, ["abab AB", "none"])
    c = pf.candidates(df, [pf.LiteralHint(0, "ab", 0, False, True, 0), pf.LiteralHint(1, "bab", 0, False, False, 1)], "text", ["doc_id"])
    assert {(r["pattern_id"], r["end_index_exclusive"], r["start_pos"]) for r in c.collect()} == {(0, 2, 0), (0, 4, 2), (0, 7, 5), (1, 4, 0)}
    pos = pf.candidate_positions(c, ["doc_id"])
    assert {(r["start_pos"], tuple(r["pattern_ids"])) for r in pos.collect()} == {(0, (0, 1)), (2, (0,)), (5, (0,))}


def test_necessary_literals():
    assert pf.necessary_literals(parse("foo[a-z]+barr")) == ["barr"]
    assert pf.necessary_literals(parse("ab*c")) is None
    assert pf.necessary_literals(parse("abc|def")) == ["abc", "def"]


def test_indexes(spark):
    p = PatternSet.of(["Ab", "a", "b.."]).to_df(spark)
    assert {r["first_char"]: r["pattern_ids"] for r in pf.first_char_index(p).collect()} == {"A": [0], "a": [0, 1], "b": [2]}
    assert {r["pattern"]: r["min_length"] for r in pf.min_length_index(p).collect()} == {"Ab": 2, "a": 1, "b..": 1}
    got = pf.ngram_semi_join(from_strings(spark, ["xHELlo"]), PatternSet.of(["hello"]).to_df(spark), "text", ["doc_id"])
    assert sorted(r["start_pos"] for r in got.collect()) == [1, 2, 3]
