"""Sources: text files, strings, pattern lists, baseline files, the machine."""

from __future__ import annotations

import os
import platform
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: columns of a baseline file.
BASELINE_SCHEMA = "engine string, mem_mb long, duration_ms long"


def _normal(c):
    """CR and CRLF become \\n, and there is one at the end."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    return F.when((t == "") | F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n")))


def resolve(path: str, prefixes: Iterable[str] = (), spark: SparkSession | None = None) -> str:
    """The path, or the first of it under (or freed of) a prefix that exists.

    With a session, paths are looked up by Spark's file systems, else on this machine.
    """

    def exists(p: str) -> bool:
        if spark is None:
            return os.path.exists(p)
        h = spark._jvm.org.apache.hadoop.fs.Path(p)
        return h.getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)

    for p in (path, *(os.path.join(x, path) for x in prefixes), *(path[len(x) :].lstrip("/") for x in prefixes if path.startswith(x))):
        if p and exists(p):
            return p
    return path


def read_whole(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text): a row per file, line breaks normalised."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), _normal(F.col("value")).alias("text"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(line): untrimmed, blank lines too."""
    return spark.read.text(list(paths)).select(F.col("value").alias("line"))


def read_lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a file in its order, or of a folder's files in order of their names.

    Tasks read ranges of bytes; a line belongs to the range in which it begins,
    wherever its break is.  Each range counts its lines, the counts add up to
    where it begins, and inside a range lines are numbered as they are read.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    ranges = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.select(F.col("file").alias("r_file"), F.col("start").alias("r_start"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    j = rows.join(ranges, (F.col("file") == F.col("r_file")) & (F.col("start") == F.col("r_start")))
    return j.select((F.col("at") + F.col("shift")).alias("line_no"), F.col("value").alias("line"))


def push_lines(df: DataFrame, collector: Callable[[str], None], column: str = "line") -> int:
    """Hands each line to a function on the driver, one partition at a time."""
    n = 0
    for row in df.select(column).toLocalIterator():
        collector(row[0])
        n += 1
    return n


def concat_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row (text): the files in the order given.  For corpora that fit one
    row; larger ones stay one row per file (``read_whole``)."""
    parts = None
    for i, p in enumerate(paths):
        one = read_whole(spark, p).select(F.lit(i).alias("i"), "text")
        parts = one if parts is None else parts.union(one)
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("text"))


def from_strings(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """(doc_id, text), ids from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def load_patterns(lines: DataFrame, limit: int = 0, order_col: str = "line_no", column: str = "line") -> DataFrame:
    """(pattern_no, pattern): the first ``limit`` of a list in its order, blanks kept; 0 or less: all."""
    out = lines.select(F.col(order_col).alias("pattern_no"), F.col(column).alias("pattern"))
    return out.orderBy("pattern_no").limit(limit) if limit > 0 else out


def load_patterns_clean(lines: DataFrame, n: int = -1, one_less: bool = False, column: str = "line") -> DataFrame:
    """(pattern, sha1): not blank, distinct, by SHA-1, the first n (-1: all).
    ``one_less`` leaves the last one out, as some lists are counted."""
    p = lines.select(F.col(column).alias("pattern")).where(F.length(F.trim("pattern")) > 0).distinct().withColumn("sha1", F.sha1("pattern"))
    if n < 0 and not one_less:
        return p.orderBy("sha1")
    size = p.count() if n < 0 else n
    return p.orderBy("sha1").limit(max(0, size - one_less))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(engine, mem_mb, duration_ms) of a file with # comments."""
    return spark.read.option("comment", "#").schema(BASELINE_SCHEMA).csv(path)


def environment(spark: SparkSession) -> DataFrame:
    """One row about the driver's machine, with an id of its architecture."""
    model = platform.processor() or platform.machine()
    try:
        with open("/proc/cpuinfo", encoding="utf-8") as f:
            model = next((x.partition(":")[2].strip() for x in f if x.startswith("model name")), model)
    except OSError:
        pass
    cores = os.cpu_count() or 1
    row = (platform.system(), platform.release(), platform.machine(), model, cores, os.path.exists("/.dockerenv"), platform.python_version(), spark.version)
    arch = f"{platform.machine()}_{model}_{cores}".replace(" ", "-")
    return spark.createDataFrame([(*row, arch)], "os string, os_version string, machine string, cpu_model string, cores int, container boolean, python string, spark string, architecture_id string")
