import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sievewright.functions import charclass as cc
from sievewright.operators import compare, stats
from sievewright.plans.queries import ORACLES, QUERIES
from tests.oracle import same

M = "doc_id long, pattern string, start_pos int, end_pos int"


def test_sets(spark):
    a = spark.createDataFrame([(0, "p", 1, 2), (0, "p", 1, 2), (0, "q", 3, 9), (1, "p", 0, 0)], M)
    b = spark.createDataFrame([(0, "p", 1, 2), (0, "r", 4, 5), (0, "q", 2, 10)], M)
    k = ["doc_id"]
    assert compare.intersection(a, b, k).count() == 1
    assert compare.symmetric_difference(a, b, k).count() == 4
    assert tuple(compare.pair_counts(a, b, k).first()) == (1, 4)
    assert tuple(compare.pair_counts(a.limit(0), b.limit(0), k).first()) == (0, 0)
    over = {(r["a_pattern"], r["b_pattern"]): (r["a_contains_b"], r["b_contains_a"]) for r in compare.overlap_classes(a, b, k).collect()}
    assert over == {("q", "r"): (True, False), ("q", "q"): (False, True)}
    assert compare.overlap_classes(a, b, k, first=1).count() == 2
    assert [r["start_pos"] for r in compare.ordered(compare.distinct_matches(a, k), k).collect()] == [1, 3, 0]


def test_domination(spark):
    m = spark.createDataFrame([(0, "p", 0, 5), (0, "p", 1, 3), (0, "p", 4, 8), (0, "p", 0, 5), (0, "q", 2, 2)], M)
    assert {(r["pattern"], r["start_pos"], r["end_pos"]) for r in compare.dominating(m, ["doc_id"]).collect()} == {("p", 0, 5), ("q", 2, 2)}
    assert {(r["pattern"], r["start_pos"]) for r in compare.undominated(m, ["doc_id"]).collect()} == {("p", 0), ("p", 4), ("q", 2)}
    d = compare.dominates(F.lit(0), F.lit(5), F.lit(1), F.lit(3))
    assert spark.range(1).select(d).first()[0] == -1


def runs(spark, rows):
    return stats.run_stats(spark.createDataFrame(rows, "engine string, duration_ms double, mem_mb double"), ["engine"])


def verdict(spark, base, cur):
    b = runs(spark, [("e", t, m) for t, m in base]) if base else runs(spark, [("other", 1.0, 1.0)])
    return stats.evaluate(runs(spark, [("e", t, m) for t, m in cur]), b, ["engine"]).first()["status"]


def test_verdicts(spark):
    steady = [(100.0, 50.0), (101.0, 50.0), (99.0, 50.0)]
    assert verdict(spark, steady, [(120.0, 50.0)] * 3) == "FAIL"
    assert verdict(spark, steady, [(60.0, 50.0), (180.0, 50.0), (200.0, 50.0)]) == "WARNING"
    assert verdict(spark, steady, [(90.0, 50.0)] * 3) == "PASS"
    assert verdict(spark, steady, [(100.0, 50.0)] * 3) == "PASS"
    assert verdict(spark, steady, [(50.0, 50.0), (150.0, 50.0), (100.0, 50.0)]) == "WARNING"
    assert verdict(spark, steady, [(100.0, 50.0)] * 2) == "FAIL"
    assert verdict(spark, None, steady) == "PASS"


def test_normalisation_and_throughput(spark):
    r = spark.createDataFrame([(100.0, 2.0, 1.0), (100.0, None, 1.0)], "m double, b double, s double")
    assert [x[0] for x in r.select(stats.normalised_mean(F.col("m"), F.col("b"), F.col("s"))).collect()] == [200.0, 100.0]
    c = spark.range(1).select(stats.cross_machine_status(F.lit("FAIL"), F.lit(False), F.lit(False)))
    assert c.first()[0] == "WARNING"
    t = stats.throughput(spark.createDataFrame([(1048576, 500.0), (1, 0.0)], "bytes long, duration_ms double"))
    assert [x["mb_per_s"] for x in t.collect()] == [2.0, None]
    assert stats.cpu_score(spark, 1, 1000) > 0
    k = stats.ObjectCounters(spark)
    k.inc("matches", 3)
    k.dec("matches")
    assert k.snapshot()["matches"] == 2 and "matches: 2" in k.dump()
    assert len(stats.check_inputs(spark.createDataFrame([("a",)], "text string"), 5)) == 2
    assert len(stats.run_pairs({"x": lambda: spark.range(3)})) == 3


def test_characters(spark):
    df = spark.createDataFrame([(c,) for c in ["a", "é", "1", "_", " ", " "]], "c string")
    c = F.col("c")
    got = [tuple(r) for r in df.select(cc.is_ascii(c), cc.is_letter(c), cc.is_digit(c), cc.is_word(c), cc.is_whitespace(c), cc.is_letter_or_digit(c)).collect()]
    T, f = True, False
    assert got == [(T, T, f, T, f, T), (f, T, f, T, f, T), (T, f, T, T, f, T), (T, f, f, T, f, f), (T, f, f, f, T, f), (f, f, f, f, f, f)]
    t = spark.createDataFrame([("abéd",), ("abc",), ("",)], "t string")
    assert [tuple(r) for r in t.select(cc.first_non_ascii(F.col("t")), cc.first_non_ascii(F.col("t"), 3), cc.is_all_ascii(F.col("t"))).collect()] == [(2, 4, False), (3, 3, True), (0, 0, True)]
    e = spark.createDataFrame([("a,b",), ('x"y',), ("l\nm",), ("plain",)], "t string").select(cc.csv_escape(F.col("t")))
    assert [r[0] for r in e.collect()] == ['"a,b"', '"x""y"', "l m", "plain"]


def test_null_keys_are_equal(spark):
    m = lambda rows: spark.createDataFrame(rows, "doc_id long, start_pos int, pattern string, end_pos int")
    a = m([(None, 0, "x", 3), (None, 0, "x", 3), (1, 0, "x", 3), (None, 9, "y", 9)])
    b = m([(None, 0, "x", 3), (2, 0, "x", 3), (None, 8, "z", 300)])
    assert sorted((str(r["doc_id"]), r["start_pos"]) for r in compare.only_in(a, b, ["doc_id"]).collect()) == [("1", 0), ("None", 9)]
    got = compare.overlap_classes(a, b, ["doc_id"]).collect()
    assert [(r["doc_id"], r["a_pattern"], r["b_pattern"], r["b_contains_a"]) for r in got] == [(None, "y", "z", True)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_match_no_text_twice(spark):
    """Each side is computed once, however often it is looked up in."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    rows = [(i % 5, "p", i, i + i % 7) for i in range(100)]
    a = spark.createDataFrame(rows, M).mapInArrow(counted, M)
    b = spark.createDataFrame(rows[::2], M).mapInArrow(counted, M)
    assert compare.overlap_classes(a, b, ["doc_id"]).count() > 0
    assert seen.value == 150


def test_domination_leaves_tasks_reduced(spark, tmp_path):
    """One row a key, or what no wider match holds, leaves a task; the same as the plain rules give."""
    rng = random.Random(8)
    rows = [(rng.choice((0, 1, 2, None)), rng.choice(("p", "q", None)), s, s + rng.choice((0, 1, 3, 40))) for s in (rng.randrange(300) for _ in range(3000))]
    m = spark.createDataFrame(rows, M).repartition(5)
    groups = {}
    for d, p, s, e in rows:
        groups.setdefault((d, p), set()).add((s, e))
    got = {(r["doc_id"], r["pattern"]): (r["start_pos"], r["end_pos"]) for r in compare.dominating(m, ["doc_id"]).collect()}
    assert got == {k: min(v, key=lambda x: (x[0] - x[1], x[0])) for k, v in groups.items()}
    left = sorted(map(str, map(tuple, compare.undominated(m, ["doc_id"]).collect())))
    assert left == sorted(str((*k, s, e)) for k, v in groups.items() for s, e in v if not any((x, y) != (s, e) and x <= s and e <= y for x, y in v))
    wide = spark.range(60_000, numPartitions=3).selectExpr("id % 3 as doc_id", "'p' as pattern", "cast(id div 3 as int) as start_pos", "20000 as end_pos")
    assert compare.undominated(wide, ["doc_id"]).count() == compare.dominating(wide, ["doc_id"]).count() == 3
    # few rows are dealt out
    assert "HashAggregate" in plan_of(compare.dominating(wide, ["doc_id"])).split("Exchange")[-1]
    assert plan_of(compare.undominated(wide, ["doc_id"])).split("Exchange")[-1].count("MapInArrow") == 1


def test_overlaps_of_any_length(spark):
    """Pairs and counts against all pairs, with spans of every level, equal ends, null and repeated keys."""
    rng = random.Random(6)
    span = lambda: (s := rng.randrange(60) * rng.choice((1, 100, 5000)), s + rng.choice((0, 1, 5, 300, 70_000, 2_000_000)))
    rows = lambda n: [(rng.choice((1, 1, 2, None)), rng.choice("pq"), *span()) for _ in range(n)]
    a, b = rows(60), rows(60)
    kind = "doc_id int, pattern string, start_pos int, end_pos int"
    da, db = spark.createDataFrame(a, kind), spark.createDataFrame([*b, b[0]], kind)
    meet = lambda x, y: x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]
    got = compare.overlap_classes(da, db, ["doc_id"]).select("doc_id", "a_pattern", "a_start", "a_end", "b_pattern", "b_start", "b_end").collect()
    want = [(*x, *y[1:]) for x in set(a) - set(b) for y in [*b, b[0]] if meet(x, y)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for size in (1 << 16, 64):
        n = compare.overlap_counts(da, db, ["doc_id"], size).collect()
        inside = lambda p, x: x[2] <= p <= x[3]
        all_ = [[y for y in [*b, b[0]] if y[0] == x[0]] for x in a]
        want_n = [(*x, sum(meet(x, y) for y in ys), sum(inside(y[2], x) for y in ys), sum(inside(y[3], x) for y in ys), sum(inside(x[2], y) for y in ys), sum(inside(x[3], y) for y in ys)) for x, ys in zip(a, all_, strict=True)]
        assert sorted(map(str, map(tuple, n))) == sorted(map(str, want_n))


def test_overlaps_broadcast_no_side(spark):
    """Files far below the broadcast threshold hold many spans; neither side passes through the driver."""
    span = lambda step, name: spark.range(0, 30_000, step, 2).selectExpr("id div 300 as doc_id", f"'{name}' as pattern", "cast(id % 300 as int) as start_pos", "cast(300 as int) as end_pos")
    pairs = compare.overlap_classes(span(1, "p"), span(50, "q"), ["doc_id"])
    assert "Broadcast" not in plan_of(pairs)
    got = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in got.collect()} == {(i, 300 * 6) for i in range(100)}
    assert "isFinalPlan=true" in plan_of(got) and "Broadcast" not in plan_of(got)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_overlap_classes_of_a_larger_table(spark):
    same(spark, QUERIES["compare_overlap_class"], ORACLES["compare_overlap_class"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("most", [stats.MEDIAN_ROWS, 500, 3])
def test_exact_medians_of_hot_groups(spark, most):
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(20_000)] + [("same", 7.0)] * 3000 + [("two", float(i % 2)) for i in range(3001)] + [("skew", 2.0 ** (i % 40)) for i in range(4000)]
    rows += [("odd", 3.0), ("odd", 1.0), ("odd", 2.0), ("even", 1.0), ("even", 2.0), ("even", None), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, score double").repartition(6)
    got = {r["g"]: r["score"] for r in stats.median_score(df, ["g"], most=most).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        want[g] = statistics.median(v) if v else None
    assert got == want
    assert stats.median_score(df.limit(0), ["g"]).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_summary_compares_once(spark, monkeypatch):
    calls, plain = [], compare.pair_summary
    monkeypatch.setattr(compare, "pair_summary", lambda *a: calls.append(a) or plain(*a))
    lines = [r[0] for r in QUERIES["summary_file"](spark, "/root/testdata/sf0.001").collect()]
    assert sum(x.startswith("1700000000,") for x in lines) == sum(x.startswith("1700000001,") for x in lines) == 1
    assert len(calls) == 1
