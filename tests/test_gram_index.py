"""The gram index against the scan of all texts."""

import random

import pytest

from sievewright.operators import gram_index as gi
from sievewright.operators.match import match_all
from sievewright.patterns import PatternSet
from sievewright.patterns.parser import parse
from sievewright.sources.text import from_strings
from tests.test_matching import fuzz, got, want
from tests.test_native import shape


def met(f, text):
    if f is None:
        return True
    if isinstance(f, str):
        return f in text
    return (all if f[0] == "and" else any)(met(p, text) for p in f[1])


def test_needs():
    n = lambda p: gi.needs(parse(p))
    assert n("the") == "the" and n("license") == ("and", ("lic", "ice", "cen", "ens", "nse"))
    assert n("th[a-z]+ed") == ("and", ("th", "ed")) and n("[ab]c") == ("or", ("ac", "bc"))
    assert n("a.b") == ("and", ("a", "b")) and n("x?y") == "y" and n("ab|cd") == ("or", ("ab", "cd"))
    assert n("a*") is None and n("|a") is None and n(".") is None and n("[^a]") is None and n("") is None
    assert n("a[b]+c") == ("and", ("ab", "bc"))


@pytest.mark.parametrize("seed", range(4))
def test_every_match_meets_its_needs(seed):
    from tests.simulator import matches

    rng = random.Random(seed)
    for _ in range(150):
        p, text = shape(rng), "".join(rng.choice("aabbcé d") for _ in range(14))
        f = gi.needs(parse(p))
        assert all(met(f, text[s : e + 1]) for s, e in matches(p, text)), p


def test_same_rows_as_a_scan(spark, tmp_path):
    patterns, texts = fuzz(5, 12, 60)
    df = from_strings(spark, [*texts, "", texts[0]]).repartition(3)
    index = gi.build_index(df, str(tmp_path / "i"), block_rows=2)
    for p in [*([x] for x in patterns), patterns[:3], [".*"], ["zzzz"], ["a|zq"]]:
        assert got(gi.indexed_match(index, PatternSet.of(p))) == want(p, [*texts, "", texts[0]])


def test_reads_only_candidate_blocks(spark, tmp_path):
    rows = [(i, "needle in row" if i == 777 else f"hay {i}", i % 3) for i in range(2000)]
    index = gi.build_index(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").repartition(8), str(tmp_path / "i"), block_rows=4)
    ps = PatternSet.of(["needle"])
    assert index.candidate_blocks(ps).count() == 1
    found = index.candidates(ps)
    assert found.columns == ["doc_id", "text", "a.b"] and found.count() <= 4 and len(found.inputFiles()) == 1
    plan = index.candidate_blocks(ps)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "EqualTo(block," in found._jdf.queryExecution().executedPlan().toString()
    assert got(gi.indexed_match(index, ps, ["doc_id"])) == {(777, "needle", 0, 5)}


def test_many_candidates_are_joined(spark, tmp_path, monkeypatch):
    df = from_strings(spark, [f"x{i % 7}" for i in range(50)])
    index = gi.build_index(df, str(tmp_path / "i"), block_rows=1)
    monkeypatch.setattr(gi, "MOST_NAMED", 3)
    assert got(gi.indexed_match(index, PatternSet.of(["x3"]))) == want(["x3"], [f"x{i % 7}" for i in range(50)])
    monkeypatch.setattr(gi, "MOST_GRAMS", 0)
    assert index.candidate_blocks(PatternSet.of(["x3"])) is None


def test_nulls_and_ranges(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "ab"), (None, "ab")], "id long, text string")
    index = gi.build_index(df, str(tmp_path / "i"))
    assert match_all(index.candidates(PatternSet.of(["ab"])), PatternSet.of(["ab"]), keys=["id"]).count() == 2
    assert index.candidates(PatternSet.of(["q"])).count() == 0
