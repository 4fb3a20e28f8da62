"""Tables as data: compiled by tasks, held or dealt."""

import pytest

from sievewright.operators import shards
from sievewright.operators.match import match_all, match_any, match_counts
from sievewright.patterns import PatternSet
from sievewright.sources.text import from_strings
from tests.test_matching import fuzz, got, want


@pytest.mark.parametrize("most", [shards.MOST_BYTES, 0])
@pytest.mark.parametrize("n", [1, 3, "auto"])
def test_ways_agree(spark, monkeypatch, n, most):
    """On the driver, by tasks, and dealt to pairs of a table and a part of the texts."""
    patterns, texts = fuzz(11, 40, 12)
    texts += [texts[0], ""]
    df, ps = from_strings(spark, texts), PatternSet.of(patterns)
    expected = want(patterns, texts)
    assert got(match_all(df, ps, shards=n)) == expected
    monkeypatch.setattr(shards, "COMPILE_BY_TASKS", 2)
    monkeypatch.setattr(shards, "LEAST_PART", 7)
    monkeypatch.setattr(shards.tables_for, "__defaults__", (1, most))
    m = match_all(df, ps, shards=n, matched_text=True)
    assert got(m) == expected and m.count() == len(expected)
    assert all(r["matched_text"] == texts[r["doc_id"]][r["start_pos"] : r["end_pos"] + 1] for r in m.collect())
    assert {r["pattern"]: r["n"] for r in match_counts(df, ps).collect()} == {p: sum(x[1] == p for x in expected) for p in patterns}
    assert {r["doc_id"] for r in match_any(df, ps).collect()} == {x[0] for x in expected}


def test_one_scan_at_any_number_of_shards(spark, tmp_path, monkeypatch):
    from_strings(spark, ["the cat", "thed"]).write.parquet(str(tmp_path / "t"))
    df, ps = spark.read.parquet(str(tmp_path / "t")), PatternSet.of([f"w{i}[a-z]" for i in range(60)])
    scans = lambda d: d._jdf.queryExecution().executedPlan().toString().count(str(tmp_path))
    for n in (1, 7, 50):
        assert scans(match_all(df, ps, shards=n)) == 1
    monkeypatch.setattr(shards.tables_for, "__defaults__", (1, 0))
    dealt = match_all(df, ps, shards=7)
    assert scans(dealt) == 1 and "Exchange" in dealt._jdf.queryExecution().executedPlan().toString()


def test_null_keys_and_dotted_names_when_dealt(spark, monkeypatch):
    df = spark.createDataFrame([(1, "ab", None), (None, "ab", 2), (None, "ab", 2), (3, None, 3)], "`a.b` int, text string, k int")
    rows = lambda: sorted(map(str, match_all(df, PatternSet.of(["ab", "b"]), shards=2).select("`a.b`", "k", "pattern", "start_pos").collect()))
    held = rows()
    monkeypatch.setattr(shards.tables_for, "__defaults__", (1, 0))
    assert rows() == held and len(held) == 6


def test_parts(spark):
    ps = PatternSet.of([f"p{i}" for i in range(6000)])
    assert len(shards.parts_of(ps, list(range(6000)), "auto", 8)) == 2
    assert len(shards.parts_of(ps, list(range(6000)), "auto", 2)) == 1
    by_hash = shards.parts_of(ps, list(range(1200)), 5, 8)
    assert len(by_hash) == 5 and sorted(i for p in by_hash for _, i in p) == list(range(1200))
