"""Times the headline queries and prints one JSON line.

$BENCH_SF_DIR (default /root/testdata/sf0.1), local[$BENCH_CPUS].  Each query
runs once to warm up where it is cheap, then counts once; its rows go to a sink
that throws them away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.operators.baseline import find_standard
from sievewright.operators.match import match_all, match_counts
from sievewright.patterns import PatternSet

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Size of the text of the usual workload, one novel.
NOVEL_CHARS = 675_000


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    upto = F.sum(F.length("text")).over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    novel = docs.withColumn("__n", upto).where(F.col("__n") <= NOVEL_CHARS).drop("__n").repartition(int(CPUS)).cache()
    novel.count()
    words = [r[0] for r in docs.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where(F.length("w") >= 4).groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(10_000).collect()]
    literals, tails, mixed = PatternSet.of(words), PatternSet.of([w + "[a-z]+" for w in words]), PatternSet.of(words[:42] + ["th[a-z]+ed", "[aeiou]n", "the|and", "(th)+e", "[0-9]+-[0-9]+"])
    few = PatternSet.of(words[:6])

    def sink(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    runs = {
        "novel_10000_literals": lambda: sink(match_all(novel, literals, keys=["doc_id"])),
        "novel_10000_open_patterns": lambda: sink(match_all(novel, tails, keys=["doc_id"])),
        "novel_206_words": lambda: sink(match_all(novel, PatternSet.of(words[:206]), keys=["doc_id"])),
        "novel_42_words": lambda: sink(match_all(novel, PatternSet.of(words[:42]), keys=["doc_id"])),
        "novel_100_tails": lambda: sink(match_all(novel, PatternSet.of([w + ".*" for w in words[200:300]]), keys=["doc_id"])),
        "all_10000_literals": lambda: sink(match_all(docs, literals, keys=["doc_id"])),
        "all_10000_literals_no_gate": lambda: sink(match_all(docs, literals, keys=["doc_id"], bloom="off")),
        "all_10000_literal_counts": lambda: sink(match_counts(docs, literals)),
        "all_6_literals": lambda: sink(match_all(docs, few, keys=["doc_id"])),
        "all_6_literal_counts": lambda: sink(match_counts(docs, few)),
        "all_47_mixed": lambda: sink(match_all(docs, mixed, keys=["doc_id"])),
        "all_6_literals_native": lambda: sink(match_all(docs, few, keys=["doc_id"], strategy="native")),
        "all_words_ending_native": lambda: sink(match_all(docs, PatternSet.of(["th[a-z]+ed"]), keys=["doc_id"], strategy="native")),
        "all_standard_engine_47": lambda: sink(find_standard(docs, list(mixed.sources), keys=["doc_id"])),
    }
    try:
        from sievewright.llm.queries import QUERIES

        runs |= {name: lambda f=QUERIES[name]: sink(f(spark, SF)) for name in ("op2_source_mix", "op4_decontaminate", "op10_exact_dedup", "op11_phrases", "op12_byte_bpe", "op13_embedding_whitening")}
    except ModuleNotFoundError:  # the corpus operators may be left out
        pass
    times = {}
    sink(match_all(novel, few, keys=["doc_id"], strategy="dfa"))  # starts the Python workers
    for name, run in runs.items():
        t = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
