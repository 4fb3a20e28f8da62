"""Steps that once made a row for each place of a text, or a state for each chunk."""

import random
from collections import Counter

import pytest

from sievewright.operators import anchors, gram_index
from sievewright.operators import literal_join as lj
from sievewright.operators.native import running_sums
from sievewright.patterns import PatternSet
from sievewright.streaming import stream as st

CHARS = "ab cé\n😀."


def texts(n, most, seed=1):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(CHARS) for _ in range(rng.randrange(most)))) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("most_heads", [256, 1])
def test_literals_over_windows(spark, monkeypatch, most_heads):
    monkeypatch.setattr(lj, "MOST_HEADS", most_heads)
    rows = texts(12, 1500)
    words = ["a", "ab", "aa", "b c", "é\n😀", "😀", ". a", "abab", "a" * 600]
    rows[0] = (0, "a" * 1300)
    got = lj.literal_matches(spark.createDataFrame(rows, "doc_id int, text string"), list(enumerate(words)), "text", ["doc_id"])
    want = sorted((d, i, s, s + len(w) - 1) for d, t in rows if t for i, w in enumerate(words) for s in range(len(t)) if t.startswith(w, s))
    assert sorted(map(tuple, got.collect())) == want


def test_only_places_of_heads_become_rows(spark):
    w = lj.windows(spark.createDataFrame([(0, "x" * 5000 + "the" + "y" * 5000)], "k int, t string"), "t", ["k"], 3, lj.PLACES)
    assert lj.head_places(w, ["k"], ["the"]).count() == w.count() + 1


@pytest.mark.parametrize("held", [1 << 20, 4])
def test_gram_counts(spark, monkeypatch, held):
    monkeypatch.setattr(anchors, "MOST_HELD", held)
    rows = texts(40, 300)
    got = {r["g"]: r["n"] for r in anchors.gram_counts(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == Counter(t[i : i + 3] for _, t in rows if t for i in range(len(t) - 2))
    # counted in the tasks: no row a place is dealt out
    assert "Generate" not in anchors.gram_counts(spark.createDataFrame(rows, "doc_id int, text string"))._jdf.queryExecution().toString()


@pytest.mark.parametrize("held, block_rows", [(1 << 23, 1), (4, 3)])
def test_postings(spark, tmp_path, monkeypatch, held, block_rows):
    monkeypatch.setattr(gram_index, "MOST_HELD", held)
    i = gram_index.build_index(spark.createDataFrame(texts(40, 60), "doc_id int, text string").repartition(3), str(tmp_path / "i"), block_rows=block_rows)
    want = {}
    for r in i.table("texts").collect():
        t = r["text"] or ""
        for k in (1, 2, 3):
            for a in range(len(t) - k + 1):
                want.setdefault(t[a : a + k], set()).add(r["block"])
    got = {}
    for r in i.table("postings").collect():
        assert r["blocks"] == sorted(set(r["blocks"]))
        got.setdefault(r["gram"], []).extend(r["segment"] * gram_index.SEGMENT + o for o in r["blocks"])
    assert {g: sorted(b) for g, b in got.items()} == {g: sorted(b) for g, b in want.items()}


def test_chunks_that_follow_are_scanned_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(st, "_feed", lambda tables, open_, text, at, last: calls.append((text, at, last)) or ([], []))

    class Group:
        exists = False

        def remove(self):
            pass

    import pandas as pd

    class Frame:
        dtypes = [("doc_id", "string")]
        sparkSession = None

        def select(self, *a):
            return self

        def groupBy(self, *a):
            return self

        def applyInPandasWithState(self, step, *a):
            self.step = step
            return self

        def withColumnRenamed(self, *a):
            return self

    monkeypatch.setattr(st, "ship", lambda s: None)
    monkeypatch.setattr(st.F, "col", lambda c: __import__("unittest.mock").mock.MagicMock())
    f = st.match_chunks(Frame(), PatternSet.of(["a"]))
    list(f.step(("k",), iter([pd.DataFrame({"seq": [2, 0, 1], "text": ["c", "a", "b"], "is_last": [True, False, False]})]), Group()))
    assert calls == [("abc", 0, True)]


def test_running_sums_of_any_number(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 31, 32, 33, 700):
        xs = list(range(n))
        got = spark.createDataFrame([(xs,)], "x array<int>").select(running_sums(F.col("x"))).first()[0]
        assert got == [sum(xs[: i + 1]) for i in range(n)]
