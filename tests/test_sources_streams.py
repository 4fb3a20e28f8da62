import json

import pytest

from sievewright.operators.compare import pair_summary
from sievewright.operators.match import match_all
from sievewright.patterns import PatternSet
from sievewright.sources import sinks, text
from sievewright.streaming.stream import chunk_texts, match_chunks, match_stream, run_to_table
from tests.simulator import matches


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "b.txt").write_text("four\n\nfive\n")
    a, b = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    assert [r["text"] for r in text.read_whole(spark, a).collect()] == ["one\ntwo\nthree\n"]
    assert text.concat_files(spark, [b, a]).first()["text"] == "four\n\nfive\none\ntwo\nthree\n"
    assert [r["line"] for r in text.read_lines(spark, b).collect()] == ["four", "", "five"]
    lines = text.read_lines_in_order(spark, b)
    assert [tuple(r) for r in text.load_patterns(lines, 2).collect()] == [(0, "four"), (1, "")]
    assert text.load_patterns(lines).count() == 3
    assert text.load_patterns_clean(lines, 2, one_less=True).count() == 1
    assert text.load_patterns_clean(lines).count() == 2
    seen = []
    assert text.push_lines(lines.orderBy("line_no"), seen.append) == 3 and seen == ["four", "", "five"]
    assert text.resolve("b.txt", [str(tmp_path)]) == b
    assert text.environment(spark).first()["cores"] > 0


def test_sinks(spark, tmp_path):
    df = text.from_strings(spark, ["ab ab", "b"])
    m = match_all(df, PatternSet.of(["ab", "b"]))
    counted, o = sinks.counted(m, "n_matches")
    counted.collect()
    assert o.get["n"] == 5
    seen = []
    assert sinks.for_each_match(m, seen.append) == len(seen) == 5
    assert sinks.log_matches(m, "x").columns == ["engine", "regex", "start", "end"]
    run = {"engine": "x", "mem_mb": 1, "duration_ms": 10}
    s = pair_summary(m, m, ["doc_id"], 2, 6, run, run, "s,1", "two\nlines", 5)
    for _ in range(2):
        sinks.append_summary(s, str(tmp_path / "csv"))
    assert len((tmp_path / "csv").read_text().splitlines()) == 3  # one header
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == 2 and back.columns == sinks.SUMMARY_COLUMNS and back.first()["metadata"] == "two lines"
    sinks.write_baseline(spark, [("x", 5, 7)], str(tmp_path / "base"), ["made by a test"])
    assert [tuple(r) for r in text.read_baseline(spark, str(tmp_path / "base")).collect()] == [("x", 5, 7)]
    assert "| x |" in sinks.write_report(sinks.log_matches(m, "x"), str(tmp_path / "report"))
    seen_there = spark.sparkContext.accumulator(0)
    sinks.for_each_match_on_executors(m, lambda r: seen_there.add(r["end_pos"] - r["start_pos"] + 1))
    assert seen_there.value == 7
    told = []
    assert sinks.count_with_progress(m, lambda n, speed: told.append(n), every=2) == 5 and told[-1] == 5
    big = spark.range(2500)
    assert sinks.write_report(big, str(tmp_path / "big")).count("\n") == 2501
    assert json.loads(sinks.to_json(df).first()["json"])["doc_id"] == 0


def test_row_stream(spark, tmp_path):
    df = text.from_strings(spark, ["the tion", "other"])
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = run_to_table(match_stream(s, PatternSet.of(["the", "t.o"])), "t_rows", str(tmp_path / "ck"))
    assert {tuple(r) for r in out.select("doc_id", "pattern_id", "start_pos", "end_pos").collect()} == {(0, 0, 0, 2), (1, 0, 1, 3), (0, 1, 4, 6)}


def test_chunk_stream(spark, tmp_path):
    patterns, texts = ["ab+c|x[^q]*", "a.*", "b"], ["ababcab xyzq xy", "", "aaabbb" * 9]
    chunks = chunk_texts(text.from_strings(spark, texts), 4)
    chunks.repartition(5).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = run_to_table(match_chunks(s, PatternSet.of(patterns)), "t_chunks", str(tmp_path / "ck"))
    want = {(i, k, a, b) for i, t in enumerate(texts) for k, p in enumerate(patterns) for a, b in matches(p, t)}
    assert {tuple(r) for r in out.select("doc_id", "pattern_id", "start_pos", "end_pos").collect()} == want


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_lines_in_order_by_ranges(spark, tmp_path, end, size):
    """Ranges of a few bytes cut lines and their breaks anywhere; every line has its number."""
    lines = [f"line {i} {'é' * (i % 9)}" if i % 4 else "" for i in range(90)]
    (tmp_path / "a.txt").write_bytes((end.join(lines) + end).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = text.read_lines_in_order(spark, str(tmp_path / "a.txt"))
        assert sorted(map(tuple, df.collect())) == list(enumerate(lines))
        assert df.rdd.getNumPartitions() >= 1 and (size > 100 or spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5)
        (tmp_path / "b.txt").write_text("last")
        (tmp_path / "c.txt").write_text("")
        assert [r["line"] for r in text.read_lines_in_order(spark, str(tmp_path)).orderBy("line_no").collect()] == [*lines, "last"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
