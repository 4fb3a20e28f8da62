"""Sinks: counters, callbacks, CSV summaries, baseline files, graphs, reports."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.charclass import csv_escape

# Fixed value: columns of the summary file.
SUMMARY_COLUMNS = (
    "timestamp testSeriesId metadata matcherTypeName1 usedMemoryInMb1 durationInMillis1 matcherTypeName2 usedMemoryInMb2 durationInMillis2 "
    "noOfMatches noOfMismatches noOfRegexps corpusLength 2to1Ratio"
).split()


def counted(matches: DataFrame, name: str = "matches") -> tuple[DataFrame, Observation]:
    """The matches, and an observation that has their number once they are written."""
    o = Observation(name)
    return matches.observe(o, F.count(F.lit(1)).alias("n")), o


def count_with_progress(matches: DataFrame, report: Callable[[int, float], None], every: int = 20_000, seconds: float = 2.0) -> int:
    """Counts the matches and calls ``report(so far, matches per second)`` on the
    driver while the job runs, at most each ``seconds`` and after ``every`` more.

    A task that runs twice is reported twice; the count that is returned is exact.
    """
    seen = matches.sparkSession.sparkContext.accumulator(0)

    begin, told, done = time.perf_counter(), 0, threading.Event()

    def tell() -> None:
        nonlocal told
        if seen.value - told >= every:
            told = seen.value
            report(told, told / max(time.perf_counter() - begin, 1e-9))

    def watch() -> None:
        while not done.wait(seconds):
            tell()

    t = threading.Thread(target=watch, daemon=True)
    t.start()
    one = matches.select(F.lit(1).alias("x"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen.add(b.num_rows)
            yield b

    try:
        n = one.mapInArrow(rows, "x int").count()
    finally:
        done.set()
        t.join()
    tell()
    return n


def for_each_match_on_executors(matches: DataFrame, action: Callable) -> None:
    """Calls ``action(row)`` for each match where it is found; what the action does must not need the driver."""
    matches.foreach(action)


def for_each_match(matches: DataFrame, action: Callable) -> int:
    """Calls ``action(row)`` on the driver for each match, one partition at a time."""
    n = 0
    for row in matches.toLocalIterator():
        action(row)
        n += 1
    return n


def log_matches(matches: DataFrame, engine: str) -> DataFrame:
    """(engine, regex, start, end)"""
    return matches.select(F.lit(engine).alias("engine"), F.col("pattern").alias("regex"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))


def append_summary(summary: DataFrame, path: str) -> None:
    """Appends its rows (one a run) to one CSV file, with a header when the file is new.

    ``path``: a path or URI of a file.  Values are written by ``csv_escape``.
    Where the store can't append, the file is written anew with the rows added.
    """
    cells = [F.coalesce(csv_escape(F.col(f"`{c}`").cast("string")), F.lit("")) for c in SUMMARY_COLUMNS]
    lines = [r[0] for r in summary.select(F.concat_ws(",", *cells)).toLocalIterator()]
    store, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    store.create_dir(os.path.dirname(name) or ".", recursive=True)
    old = store.get_file_info(name).type == pafs.FileType.File
    data = "".join(x + "\n" for x in ([] if old else [",".join(SUMMARY_COLUMNS)]) + lines).encode()
    try:
        with store.open_append_stream(name, compression=None) if old else store.open_output_stream(name, compression=None) as out:
            out.write(data)
    except (NotImplementedError, pa.ArrowNotImplementedError):
        with store.open_input_stream(name, compression=None) as f:
            before = f.read()
        with store.open_output_stream(name, compression=None) as out:
            out.write(before + data)


def write_baseline(spark: SparkSession, rows: list[tuple[str, int, int]], path: str, header: list[str] = ()) -> None:
    """Comment lines, then engine,mem_mb,duration_ms, as one text file in a folder."""
    lines = [f"# {h}" for h in header] + [f"{e},{m},{d}" for e, m, d in rows]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(result: DataFrame, path: str) -> str:
    """Rows as JSON lines at ``path``, and all of them again as a Markdown table
    at ``path``-markdown; gives the table's text, row by row in order of the result."""
    result.write.mode("overwrite").json(path)
    head = "| " + " | ".join(result.columns) + " |\n|" + "---|" * len(result.columns)
    cells = [F.coalesce(F.regexp_replace(F.col("`" + c.replace("`", "``") + "`").cast("string"), r"[\r\n|]", " "), F.lit("None")) for c in result.columns]
    table = result.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    table.write.mode("overwrite").text(path.rstrip("/") + "-markdown")
    return "\n".join([head, *(r[0] for r in table.toLocalIterator())])


def to_json(result: DataFrame) -> DataFrame:
    return result.select(F.to_json(F.struct(*result.columns)).alias("json"))
