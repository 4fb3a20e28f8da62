"""Chunk streams with timers."""

from sievewright.patterns import PatternSet
from sievewright.streaming.timed import match_chunks_timed, run_timed_to_table
from tests.simulator import matches

KIND = "doc_id string, seq long, text string, is_last boolean, time timestamp"


def at(minute):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_missing_and_late_chunks(spark, tmp_path):
    patterns = ["a+", "ab", "b.*"]
    whole = {"done": ["xaa", "ab", "aa"], "gap": ["aa", "ba", None], "none": [None, "aa"], "swap": ["a", "a", "b"]}
    rows = [(d, i, t, d in ("done", "swap") and i == len(p) - 1, at(1)) for d, p in whole.items() for i, t in enumerate(p) if t is not None]
    rows.sort(key=lambda r: -r[1])  # later chunks first
    first = spark.createDataFrame(rows, KIND)
    second = spark.createDataFrame([("far", 0, "x", True, at(600))], KIND)  # moves the watermark
    third = spark.createDataFrame([("gap", 2, "late", True, at(601)), ("done", 1, "again", False, at(601))], KIND)
    (tmp_path / "in").mkdir()
    s = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    for df in (first, second, third):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run_timed_to_table(match_chunks_timed(s, PatternSet.of(patterns), "30 minutes"), "t_timed", str(tmp_path / "ck"), str(tmp_path / "out"))
        seen = [tuple(r) for r in out.collect()]
    text = {"done": "xaaabaa", "gap": "aaba", "none": "", "swap": "aab", "far": "x"}
    assert sorted(x[:4] for x in seen if x[4] is None) == sorted((d, k, s, e) for d, t in text.items() for k, p in enumerate(patterns) for s, e in matches(p, t))
    assert sorted((d, p, t) for d, _, p, _, t in seen if t) == [("done", 1, "late"), ("gap", 2, "late"), ("gap", 2, "missing"), ("none", 0, "missing")]
