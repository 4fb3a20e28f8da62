"""Statistics of runs: means, spread, status against a baseline, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.sources.scratch import written

# Limits of the verdict.
TIME_REGRESSION, TIME_IMPROVEMENT = -0.02, 0.05
MEMORY_REGRESSION, MEMORY_IMPROVEMENT = -0.02, 0.03
MAX_CV = 0.20
MIN_RUNS = 3
MIN_CORPUS_BYTES, MIN_PATTERNS = 500_000, 10_000
COUNTERS = ("nfa_places", "nfa_edges", "dfa_states", "dfa_edges", "scans", "matches")


def run_stats(runs: DataFrame, by: list[str], time_col: str = "duration_ms", memory_col: str = "mem_mb") -> DataFrame:
    """Mean, population standard deviation and number of runs per group."""
    return runs.groupBy(*by).agg(F.avg(time_col).alias("time_mean"), F.stddev_pop(time_col).alias("time_std"), F.avg(memory_col).alias("memory_mean"), F.stddev_pop(memory_col).alias("memory_std"), F.count(F.lit(1)).alias("n_runs"))


def cv(mean: Column, std: Column) -> Column:
    """Coefficient of variation; 0 where the mean is 0."""
    return F.when(mean == 0, F.lit(0.0)).otherwise(std / mean)


def improvement(base: Column, current: Column) -> Column:
    """Share by which the current value is lower than the base's; 0 without base."""
    return F.when(base == 0, F.lit(0.0)).otherwise((base - current) / base)


def status(time_gain: Column, memory_gain: Column, significant: Column, n_runs: Column, has_base: Column) -> Column:
    """PASS, WARNING or FAIL.

    Too few runs fail; no baseline passes; a regression fails if it is
    significant and warns if not; an improvement passes; what is neither warns
    if not significant and passes if it is.
    """
    worse = (time_gain < TIME_REGRESSION) | (memory_gain < MEMORY_REGRESSION)
    better = (time_gain >= TIME_IMPROVEMENT) | (memory_gain >= MEMORY_IMPROVEMENT)
    return (
        F.when(n_runs < MIN_RUNS, "FAIL")
        .when(~has_base, "PASS")
        .when(worse & significant, "FAIL")
        .when(worse, "WARNING")
        .when(better, "PASS")
        .when(~significant, "WARNING")
        .otherwise("PASS")
    )


def evaluate(current: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """``run_stats`` of current and base runs to a verdict per group."""
    b = base.select(*by, *[F.col(c).alias("base_" + c) for c in ("time_mean", "time_std", "memory_mean", "memory_std", "n_runs")])
    j = current.join(b, by, "left")
    gain_t, gain_m = improvement(F.col("base_time_mean"), F.col("time_mean")), improvement(F.col("base_memory_mean"), F.col("memory_mean"))
    sig = (cv(F.col("time_mean"), F.col("time_std")) < MAX_CV) & (cv(F.col("base_time_mean"), F.col("base_time_std")) < MAX_CV)
    has = F.col("base_n_runs").isNotNull()
    return j.select(*by, "time_mean", "memory_mean", "n_runs", F.coalesce(gain_t, F.lit(0.0)).alias("time_gain"), F.coalesce(gain_m, F.lit(0.0)).alias("memory_gain"), F.coalesce(sig, F.lit(False)).alias("significant"), status(F.coalesce(gain_t, F.lit(0.0)), F.coalesce(gain_m, F.lit(0.0)), F.coalesce(sig, F.lit(False)), F.col("n_runs"), has).alias("status"))


def normalised_mean(mean: Column, base_score: Column, score: Column) -> Column:
    """A mean as it would be on the machine of the baseline (by CPU scores); unchanged without both scores."""
    ok = base_score.isNotNull() & score.isNotNull() & (score > 0) & (base_score > 0)
    return F.when(ok, mean * base_score / score).otherwise(mean)


def cross_machine_status(verdict: Column, same_architecture: Column, has_scores: Column) -> Column:
    """A failure on another architecture without scores is a warning only."""
    return F.when((verdict == "FAIL") & ~same_architecture & ~has_scores, "WARNING").otherwise(verdict)


def cpu_score(spark: SparkSession, runs: int = 3, loops: int = 200_000) -> float:
    """Median of loops per millisecond of a fixed arithmetic loop on the driver."""
    import time
    from statistics import median

    scores = []
    for _ in range(runs):
        t, x = time.perf_counter(), 1
        for i in range(loops):
            x = (x * 31 + i) & 0xFFFFFFFF
        scores.append(loops / (1000 * (time.perf_counter() - t)))
    return float(median(scores))


#: Values of a group that are sorted in one task; more are narrowed down first.
MEDIAN_ROWS = 100_000
#: Of the quantile sketch: a value's rank is told to a share of 1 / ACCURACY.
ACCURACY = 1000


def median_score(scores: DataFrame, by: list[str], col: str = "score", most: int = MEDIAN_ROWS) -> DataFrame:
    """(by..., score): the exact median of each group; nulls don't count, NaN is the largest, a group without values has null.

    A group of any size: a mergeable sketch of its quantiles gives a range of values
    that must hold the median, a count says how many are below it, and the
    range is narrowed by another sketch until what is left can be sorted at once.
    """
    rows = scores.select(*by, F.col(col).cast("double").alias("__v"))
    names = [f"__k{i}" for i in range(len(by))]
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names, strict=True)]
    keys = [F.col(k).alias(n) for k, n in zip(by, names, strict=True)]
    # of each group: how many values, how many below the range, and the range
    known = written(rows.groupBy(*by).agg(F.count("__v").alias("n"), F.lit(0).cast("long").alias("below"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("__v").alias("inside")).select(*keys, "n", "below", "lo", "hi", "inside"), "median")
    widest = lambda df: df.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside")))).first()[0] or 0
    while (size := widest(known)) > most:
        v = rows.join(known, same).where(F.col("__v").between(F.col("lo"), F.col("hi")))
        at = (F.floor((F.col("n") - 1) / 2) - F.col("below")) / F.col("inside")  # where in the range the lower middle is
        # the range's own sketch, asked a little before and a little behind every possible place
        sketch = v.groupBy(*names).agg(F.percentile_approx("__v", F.array(*[F.lit(i / 100) for i in range(101)]), F.lit(ACCURACY)).alias("q"))
        step = lambda x, d: F.get(F.col("q"), F.greatest(F.least(F.floor(x * 100).cast("int") + d, F.lit(100)), F.lit(0)))
        big = F.col("inside") > most
        narrow = known.join(sketch.select(*[F.col(n).alias(f"{n}_") for n in names], "q"), [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], "left")
        narrow = narrow.select(*names, "n", "below", "inside", F.when(big, F.when(F.floor(at * 100) < 2, F.col("lo")).otherwise(step(at, -2))).otherwise(F.col("lo")).alias("lo"), F.when(big, F.when(F.floor(at * 100) > 96, F.col("hi")).otherwise(step(at, 3))).otherwise(F.col("hi")).alias("hi"))
        counts = rows.join(narrow, same).groupBy(*names, "n", "lo", "hi").agg(F.sum((F.col("__v") < F.col("lo")).cast("long")).alias("below"), F.sum(F.col("__v").between(F.col("lo"), F.col("hi")).cast("long")).alias("inside"))
        counts = written(counts.select(*names, "n", "below", "lo", "hi", "inside"), "median")
        lost = counts.where((F.col("n") > 0) & ((F.floor((F.col("n") - 1) / 2) < F.col("below")) | (F.floor(F.col("n") / 2) >= F.col("below") + F.col("inside")))).limit(1).count()
        if lost or widest(counts) >= size:
            break  # a few values fill the range: it can't be narrowed, and is counted by value below
        known = counts
    # by value, so that repeated values are one row
    v = rows.join(known, same).where(F.col("__v").between(F.col("lo"), F.col("hi"))).groupBy(*names, "n", "below", "__v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*names).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    v = v.withColumn("upto", upto)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    mid = v.groupBy(*names).agg(F.max(F.when(holds(lower), F.col("__v"))).alias("a"), F.max(F.when(holds(upper), F.col("__v"))).alias("b"))
    mid = mid.select(*[F.col(n).alias(f"{n}_") for n in names], (F.col("a") * 0.5 + F.col("b") * 0.5).alias("score"))
    return known.join(mid, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], "left").select(*[F.col(n).alias(k) for k, n in zip(by, names, strict=True)], "score")


def throughput(runs: DataFrame, bytes_col: str = "bytes", time_col: str = "duration_ms") -> DataFrame:
    """Adds mb_per_s, of the real size in bytes (1 MB = 1024 * 1024); null for no time."""
    return runs.withColumn("mb_per_s", F.when(F.col(time_col) > 0, F.col(bytes_col) / F.lit(1024.0 * 1024.0) / (F.col(time_col) / F.lit(1000.0))))


def throughput_ratio(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """``a`` with a_mb_per_s, b_mb_per_s (joined by ``by``), their ratio and its
    band: excellent over 2, good over 1, comparable over 0.8, else slower."""
    j = a.withColumnRenamed("mb_per_s", "a_mb_per_s").join(b.select(*by, F.col("mb_per_s").alias("b_mb_per_s")), by)
    r = F.col("a_mb_per_s") / F.col("b_mb_per_s")
    return j.withColumn("ratio", r).withColumn("band", F.when(r > 2.0, "excellent").when(r > 1.0, "good").when(r > 0.8, "comparable").otherwise("slower"))


class ObjectCounters:
    """Named counters over a cluster: accumulators, with a snapshot on the driver.

    ``match_all(..., counters=)`` counts the states and edges of its tables
    there, and the texts scanned and matches found on the executors (a task
    that runs twice counts twice, as accumulators do).
    """

    def __init__(self, spark: SparkSession, names: tuple[str, ...] = COUNTERS):
        self._acc = {n: spark.sparkContext.accumulator(0) for n in names}

    def inc(self, name: str, by: int = 1) -> None:
        self._acc[name].add(by)

    def dec(self, name: str) -> None:
        self._acc[name].add(-1)

    def snapshot(self) -> dict[str, int]:
        return {n: a.value for n, a in self._acc.items()}

    def dump(self) -> str:
        return "\n".join(f"{n}: {v}" for n, v in sorted(self.snapshot().items()))


def check_inputs(corpus: DataFrame, n_patterns: int, text_col: str = "text", min_bytes: int = MIN_CORPUS_BYTES, min_patterns: int = MIN_PATTERNS, runs: int = MIN_RUNS) -> list[str]:
    """What keeps a workload from being a regression run; empty if nothing."""
    size = corpus.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    out = []
    if size < min_bytes:
        out.append(f"corpus has {size} bytes, {min_bytes} are needed")
    if n_patterns < min_patterns:
        out.append(f"{n_patterns} patterns, {min_patterns} are needed")
    if runs < MIN_RUNS:
        out.append(f"{runs} runs, {MIN_RUNS} are needed")
    return out


def run_pairs(engines: dict, runs: int = MIN_RUNS) -> list[tuple[str, int, float, int]]:
    """Runs each engine (name: function that gives a DataFrame) some times:
    (engine, run, duration_ms, matches)."""
    import time

    out = []
    for r in range(max(runs, MIN_RUNS)):
        for name, f in engines.items():
            t = time.perf_counter()
            n = f().count()
            out.append((name, r, 1000 * (time.perf_counter() - t), n))
    return out


def memory_mb(spark: SparkSession) -> float:
    """Heap in use on the driver's JVM."""
    r = spark._jvm.java.lang.Runtime.getRuntime()
    return (r.totalMemory() - r.freeMemory()) / (1 << 20)


def compare_engines(spark: SparkSession, engines: dict, runs: int = MIN_RUNS, baseline: DataFrame | None = None, scores: tuple[float | None, float | None] = (None, None), same_architecture: bool = True) -> DataFrame:
    """The pair driver: runs each engine and judges it against a baseline
    (engine, mem_mb, duration_ms; one row a run): engine, n_runs, matches,
    time_mean, memory_mean, time_gain, memory_gain, significant, status.

    scores: CPU scores of the baseline's machine and of this one, which
    normalise the times; an engine without baseline passes.
    """
    rows = [(e, d, memory_mb(spark), n) for e, _, d, n in run_pairs(engines, runs)]
    now = spark.createDataFrame(rows, "engine string, duration_ms double, mem_mb double, matches long")
    base_score, score = (F.lit(x).cast("double") for x in scores)
    now = now.withColumn("duration_ms", normalised_mean(F.col("duration_ms"), base_score, score))
    if baseline is None:
        baseline = now.limit(0)
    got = evaluate(run_stats(now, ["engine"]), run_stats(baseline.select("engine", "mem_mb", "duration_ms"), ["engine"]), ["engine"])
    matches = now.groupBy("engine").agg(F.max("matches").alias("matches"))
    has = F.lit(scores[0] is not None and scores[1] is not None)
    return got.withColumn("status", cross_machine_status(F.col("status"), F.lit(same_architecture), has)).join(matches, "engine")
