"""Each operator on small tables: nulls, empty and long texts, ties, repeated
rows, empty tables, and extra columns whose names clash with the operators'."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sievewright.llm import decontaminate as dc
from sievewright.llm import html_text as ht
from sievewright.llm import language_id as li
from sievewright.llm import line_dedup as ld
from sievewright.llm import near_dedup as nd
from sievewright.llm import tokens as tk
from sievewright.llm import url_filter as uf
from sievewright.llm import warc
from sievewright.llm.components import components
from sievewright.llm.exact_dedup import drop_copies, exact_dedup
from sievewright.llm import lm_score as lm
from sievewright.llm.lm_score import lm_scores
from sievewright.llm.mixing import mix_sources, mixed_documents, source_targets
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, node long, `a.b` int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def docs(spark, rows):
    """(id, text, source) rows, with columns whose names clash."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "x", 1, 2) for i, t, s in rows], DOC).repartition(3)


EDGE = [(1, "A  b\nc", "s"), (2, "A b c", "s"), (2, "A b c", "s"), (None, "A b c", None), (3, None, "s"), (4, "", "t"), (5, " \t", "t"), (6, LONG, "t"), (7, LONG + "\n", "t"), (8, "é É", ""), (9, "\n\n", "t")]


def collect(df, *cols):
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


# ---- exact dedup ----------------------------------------------------------------


def test_exact_edges(spark):
    got = {}
    for r in exact_dedup(docs(spark, EDGE), n_partitions=5).collect():
        got.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1] == [(1, 4, True, sha("A b c"))]
    assert sorted(x[2] for x in got[2]) == [False, False] and got[None][0][:3] == (1, 4, False)
    assert got[3][0][:3] == (3, 2, True) and got[4][0][:3] == (3, 2, False)
    assert got[5][0][:3] == (5, 2, True) and got[9][0][:3] == (5, 2, False)
    assert got[6][0][:3] == (6, 1, True) and got[7][0][:3] == (7, 1, True)  # one has a space at its end
    assert exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_exact_groups_over_partitions(spark, n):
    rng = random.Random(n)
    rows = [(i, "same" if i % 3 else f"t{rng.randint(0, 20)}", "s") for i in range(400)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs(spark, rows), n_partitions=n).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t, _ in rows}


def test_exact_rows_that_stay(spark):
    d = docs(spark, EDGE)
    left = drop_copies(d)
    assert left.columns == d.columns and sorted(x for (x,) in collect(left, "doc_id")) == [1, 3, 5, 6, 7, 8]


# ---- mixing ---------------------------------------------------------------------


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Water-filling by repetition."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        rest = total - sum(out.values())
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 1000, 100_000]) for i in range(rng.randint(1, 9))} | {None: 50, "": 3}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = fill(sizes)
    assert {r["source"] for r in got.collect()} == set(sizes)
    for r in got.collect():
        assert r["target"] == pytest.approx(want[r["source"]])


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + EDGE + [(700, "x " * 9, "only")]
    d = docs(spark, rows)
    got = mix_sources(d, ranges=64).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(d.repartition(5), ranges=64).collect()))
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = taken.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        t[0] += r["taken"]
        t[3] += r["size"]
    for got_words, target, size, total in taken.values():
        assert got_words == int(target) and size == total
    out = mixed_documents(d)
    assert out.columns == [*d.columns, "mix_size", "mix_target", "mix_taken"] and out.where("mix_taken = 0").count() == 0
    assert out.count() == sum(r["taken"] > 0 for r in got)
    assert mix_sources(docs(spark, [])).count() == 0


# ---- lines ----------------------------------------------------------------------


def test_line_report(spark):
    rows = [(100 + i, f"Common Line \nown {i}\n\tcommon line\n", "s") for i in range(9)] + [(20, "COMMON LINE", "s"), (21, "É", "s"), (22, "é", "s"), *EDGE]
    got = {}
    for r in ld.line_report(docs(spark, rows), min_docs=10, batches=3, fanout=2).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[100] == [(4, 2, sha("own 0\n"))]
    assert got[20] == [(1, 1, sha(""))]
    assert got[21] == [(1, 0, sha("É"))] and got[22] == [(1, 0, sha("é"))]
    assert got[3] == [(1, 0, sha(""))] and got[9] == [(3, 0, sha("\n\n"))]
    assert got[6] == [(1, 0, sha(LONG))]
    assert ld.line_report(docs(spark, [])).count() == 0


def test_line_folding(spark):
    pairs = [("Abc", "aBC", True), ("É", "é", False), ("\x01é", "é\x01", False), ("\u212a", "k", False), ("Aé", "aé", True), ("aé\x01", "a\x01é", False), ("İx", "İX", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select((ld.folded(F.col("a")) == ld.folded(F.col("b"))).alias("x"), ld.folded(F.col("a")).alias("f"), ld.folded(F.col("b")).alias("g"))
    assert [r["f"] == r["g"] for r in df.collect()] == [x for *_, x in pairs]


def test_line_batches(spark, tmp_path):
    runs = ld.LineRuns(spark, fanout=2, path=str(tmp_path / "runs"))
    seen = []
    for i, text in enumerate(["a\nb", "b\nc\nB ", "c\nd\n\n", "a\nb\nc\nd\ne"]):
        seen.append(ld.dedup_batch(runs, docs(spark, [(i, text, "s")])).first())
    assert [r["text"] for r in seen] == ["a\nb", "c", "d\n\n", "e"]
    assert [r["n_chars"] for r in seen] == [3, 1, 3, 1]
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert len(list((tmp_path / "runs").iterdir())) == 4 + 2 + 1  # a lookup writes no run
    assert runs.totals(3).count() == 2  # b and c


# ---- decontamination ----------------------------------------------------------------


def test_masks_miss_nothing():
    """Whichever three of thirteen tokens differ, one mask fits on the others."""
    for gone in itertools.combinations(range(dc.WINDOW), dc.WINDOW - dc.MIN_EQUAL):
        assert any(all(s + i not in gone for i, c in enumerate(m) if c == "1") for m in dc.MASKS for s in range(dc.WINDOW - len(m) + 1)), gone


@pytest.mark.parametrize("seeds", [dc.BROADCAST_SEEDS, 0])
def test_contamination(spark, seeds):
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randint(0, 50_000))
    item = [word() for _ in range(30)]
    other = [word() for _ in range(13)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other).upper()), (3, "too short"), (4, None), (1, " ".join(item))], "item_id long, text string")
    noise = lambda n: [word() for _ in range(n)]
    changed = [w if i % 5 else "zzz" for i, w in enumerate(item)]
    part = lambda k: other[:k] + noise(13 - k)
    rows = [(1, " ".join(noise(50) + item + noise(50)), "s"), (2, "\n".join(noise(3) + changed), "s"), (3, " ".join(noise(200)), "s"), (4, " ".join(other), "s"), (5, " ".join(part(10)), "s"), (6, " ".join(part(9)), "s"), (7, " ".join(item[:12]), "s"), (8, None, "s"), (9, "", "s"), (4, " ".join(other), "s"), (10, LONG, "s"), (11, " ".join(item + other), "s")]
    d = docs(spark, rows)
    got = {r["doc_id"]: (r["contaminated"], r["items"], r["best"]) for r in dc.contamination(d, bench, broadcast_seeds=seeds).collect()}
    assert got[1] == (True, [1], 13) and got[2][0] and got[4] == (True, [2], 13) and got[5] == (True, [2], 10) and got[11] == (True, [1, 2], 13)
    assert not any(got[i][0] for i in (3, 6, 7, 8, 9, 10))
    # items shorter than the window: all their tokens in a row
    short = spark.createDataFrame([(9, "Red  GREEN blue"), (8, " ".join(item[:12])), (7, "solo"), (6, " \t")], "item_id long, text string")
    some = docs(spark, [(1, "a red green\nblue b", "s"), (2, "red green x blue", "s"), (3, " ".join(noise(9) + item[:12]), "s"), (4, " ".join([*item[:11], "zzz"]), "s"), (5, "Solo", "s"), (6, None, "s"), (7, "blue red green", "s")])
    assert {r["doc_id"]: (r["items"], r["best"]) for r in dc.contamination(some, short.union(bench), broadcast_seeds=seeds).where("contaminated").collect()} == {1: ([9], 3), 3: ([8], 12), 5: ([7], 1)}
    left = dc.drop_contaminated(d, bench, broadcast_seeds=seeds)
    assert left.columns == d.columns and sorted(x for (x,) in collect(left, "doc_id")) == [3, 6, 7, 8, 9, 10]
    assert dc.contamination(d, bench.limit(0)).where("contaminated").count() == 0
    assert dc.contamination(docs(spark, []), bench).count() == 0


def best_windows(text, item):
    """Most equal tokens in 13 aligned ones, by all alignments; of a short item all of it."""
    a, b, most = text.lower().split(), item.lower().split(), 0
    wide = min(13, len(b))
    for d in range(-len(b), len(a) + 1):
        same = [a[d + j] == b[j] for j in range(len(b)) if 0 <= d + j < len(a)]
        most = max([most, *(sum(same[i : i + wide]) for i in range(len(same) - wide + 1))])
    return most if most >= (10 if len(b) >= 13 else len(b)) else 0


@pytest.mark.parametrize("seeds", [dc.BROADCAST_SEEDS, 0])
def test_contamination_of_texts_that_repeat_themselves(spark, seeds):
    rng = random.Random(8)
    some = lambda n, k: " ".join(rng.choice("abcd"[:k]) for _ in range(n))
    items = [(1, "a " * 40), (2, "a b " * 12), (3, some(30, 2)), (4, "a a a b a a a c a a a d a a"), (5, "b b"), (6, some(14, 3))]
    texts = [(i, some(rng.randrange(1, 60), rng.randrange(1, 5)), "s") for i in range(60)] + [(100, "a " * 300, "s"), (101, "b a " * 90, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["best"]) for r in dc.contamination(docs(spark, texts), bench, broadcast_seeds=seeds).where("contaminated").collect()}
    want = {i: {k: b for k, t in items if (b := best_windows(x, t))} for i, x, _ in texts}
    assert got == {i: (sorted(w), max(w.values())) for i, w in want.items() if w}
    place = {(r["__id"], r["item_id"]): (r["place"], r["best"]) for r in dc.benchmark_overlaps(docs(spark, texts), bench, broadcast_seeds=seeds).collect()}
    words = {i: t.split() for i, t in items}
    for (i, k), (at, best) in place.items():
        own, wide = dict((a, b) for a, b, _ in texts)[i].split(), min(13, len(words[k]))
        assert max(sum(x == y for x, y in zip(own[at : at + wide], words[k][j : j + wide], strict=False)) for j in range(len(words[k]) - wide + 1)) >= best


def test_contamination_of_one_word_a_hundred_thousand_times(spark):
    bench = spark.createDataFrame([(1, "spam " * 1000), (2, "spam " * 12 + "x " + "spam " * 12)], "item_id long, text string")
    d = docs(spark, [(1, "spam " * 100_000, "s"), (2, "spam " * 11, "s"), (3, "ham " * 100_000, "s")])
    got = {r["doc_id"]: (r["items"], r["best"]) for r in dc.contamination(d, bench).collect()}
    assert got == {1: ([1, 2], 13), 2: (None, 0), 3: (None, 0)}


# ---- near-dedup -----------------------------------------------------------------------


def near_rows(seed, n=140):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    passage = [rng.choice(vocab) for _ in range(80)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if i % 4 == 0:  # a passage that many share, at most similarities around the threshold
            w = passage + [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_equals_brute_force(spark, seed):
    rows = near_rows(seed) + [(1000, None, "s"), (1001, "", "s"), (1002, "one Two", "s"), (1003, "ONE two", "s"), (None, "one two", "s"), (1002, "one Two", "s"), (1004, LONG, "s"), (1005, LONG + " end", "s")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in nd.near_dedup(docs(spark, rows)).collect())
    want = brute.near_groups([(i, t) for i, t, _ in rows])
    assert got == sorted((str(i), n, str(i if not n else c)) for (i, _, _), (n, c) in zip(rows, want, strict=True))


def test_near_survivors(spark):
    rows = [(5, "a b c d e f g h", "s"), (3, "a b c d e f g h", "s"), (3, "a b c d e f g h", "s"), (9, "q r s t u", "s"), (None, "q r s t u", "s"), (7, "", "s"), (8, None, "s")]
    d = docs(spark, rows)
    left = nd.drop_near_copies(d)
    assert left.columns == d.columns and collect(left, "doc_id") == [(3,), (7,), (8,), (9,)]
    assert nd.near_dedup(docs(spark, [])).count() == 0


def test_near_lengths_of_very_long_texts(spark):
    # the length test on the columns that the prefix join reads, with sets of 160000 to 30 million shingles
    n = [(160_000, 160_000, 0, 0), (160_000, 160_000, 30_000, 0), (160_000, 213_334, 0, 0), (30_000_000, 31_000_000, 100, 5)]
    rows = [((1, i, 1, a, p, True), (1, i, 2, b, q, True)) for i, (a, b, p, q) in enumerate(n)]
    pairs = spark.createDataFrame(rows, f"a struct<{nd.PREFIX}>, b struct<{nd.PREFIX}>")
    got = {r["i"]: r["ok"] for r in pairs.select("a.node", F.expr(nd._may_overlap(75)).alias("ok")).toDF("i", "ok").collect()}
    assert got == {i: 100 * a >= 75 * b and 100 * (1 + min(a - p - 1, b - q - 1)) * 175 >= 7500 * (a + b) for i, (a, b, p, q) in enumerate(n)}
    # and through the rows of the operator itself
    text = " ".join(map(str, range(160_000)))
    order = np.zeros((2, 1 << nd.ORDER_BITS), np.uint32)
    made = next(nd._prefixes(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], ["node", "comp", "text"])]), 5, 75, order))
    assert [str(made.schema.field(c).type) for c in ("n", "pos")] == ["int64", "int64"] and made.column(3)[0].as_py() == 159_996


def test_sketch_fills_and_concentrates():
    rng = np.random.default_rng(0)
    for size in (1, 2, 30, 4000):
        s = rng.integers(0, 2**63, size).astype(np.uint64)
        assert (nd.sketch(s, np.array([0, size]), 128) != nd.EMPTY).all()
    assert (nd.sketch(np.zeros(0, np.uint64), np.array([0, 0]), 16) == nd.EMPTY).all()
    common, rest = rng.integers(0, 2**63, 600).astype(np.uint64), rng.integers(0, 2**63, 400).astype(np.uint64)
    x, y = np.concatenate([common, rest[:200]]), np.concatenate([common, rest[200:]])
    sk = nd.sketch(np.concatenate([x, y]), np.array([0, 800, 1600]), 1024)
    assert abs((sk[0] == sk[1]).mean() - 0.6) < 0.06


def test_words_and_shingles():
    texts = ["A b\tC", "", "É  é\n", " x ", "a b c d e f"]
    import pyarrow as pa

    raw, off = tk.buffers(pa.array(texts))
    h, first = tk.words(raw, off)
    assert np.diff(first).tolist() == [3, 0, 2, 1, 6] and h[0] == h[6] and h[3] != h[4]
    s, f = tk.shingles(h, first)
    assert np.diff(f).tolist() == [len(brute.shingles(t)) for t in texts]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {k: v for k, v in got.items() if k == 5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- language model ---------------------------------------------------------------------


@pytest.mark.parametrize("block, shards, fan", [(200, 4, 3), (200, None, 2), (200, 5, 256), (8 << 20, None, 256)])
def test_lm_equals_brute_force(spark, block, shards, fan):
    """In one block, in many, and in so many that they are added up in a tree."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("the A b of É c".split()) + rng.choice(["", "", "x"]) for _ in range(rng.randint(0, 30))), "s") for i in range(60)] + EDGE
    d = docs(spark, rows).cache()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_scores(d, block_bytes=block, shards=shards, fan=fan).collect())
    want = brute.lm([(i, t) for i, t, _ in rows], lm.SMOOTHING)
    assert got == sorted((str(i), h, n, k, t, round(b, 6), round(s, 6)) for (i, _, _), (h, n, k, t, b, s) in zip(rows, want, strict=True))


def automaton(texts, train):
    """The automaton of texts of which the first ``train`` are counted, with its counts."""
    tokens, border = lm.sequence([pa.array(texts)])
    counted = np.repeat(np.arange(len(texts)) < train, np.diff(border))
    count = {}
    for kind, (h, at) in enumerate(lm.ngrams(tokens, border), 1):
        for x in h[counted[at]].tolist():
            count[kind, x] = count.get((kind, x), 0) + 1
    n = int(counted.sum())
    v = sum(k == 1 for k, _ in count)
    return lm.BackoffAutomaton(tokens, border, lambda kind, keys: np.array([count.get((kind, x), 0) for x in keys.tolist()], float), n, v, train), border


def test_lm_states_sum_to_one():
    """From every state that a text can be in, the weights of all words, a word unseen included, add up to 1."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    model, border = automaton([*texts, "never"], 40)
    end = model.word[border[1] - 1]
    words = np.arange(len(model.count))
    assert (model.count == 0).sum() == 1  # all unseen words have one arc
    reach, todo = {model.start}, [model.start]
    while todo:
        w, after = model.step(np.full(len(words), todo.pop()), words)
        assert np.sum(10**w) == pytest.approx(1)
        for x in set(np.delete(after, end).tolist()) - reach:  # nothing follows the end
            reach.add(x)
            todo.append(x)
    assert len(reach) > 1 + 5 + 20 and 0 in reach  # pairs, words, and the root after an unseen word


def test_lm_segments_make_no_difference(monkeypatch):
    texts = [" ".join(random.Random(i).choice("abcdefgh") for _ in range(5 * i)) for i in range(30)]
    model, border = automaton(texts, 20)
    whole = model.traverse(border, 20)
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(lm, "SEGMENT", size)
        assert np.allclose(model.traverse(border, 20), whole)


def test_lm_notices_other_rows():
    """A block recomputed with other rows, as many n-grams or not, is no answer to what it asked."""
    rows = pa.table({"block": pa.array([0, 0]), "doc_id": pa.array([1, 2]), "held_out": pa.array([False, True]), "text": ["a b c", "a d"]})
    asks = pa.Table.from_batches(list(lm._asks(0, rows["text"].chunks, [np.array([False, True])], lm.range_cuts(4))))
    answers = pa.concat_tables([lm._answered(asks.filter(pc.equal(asks["shard"], s))) for s in set(asks["shard"].to_pylist())])
    n, v = sum(answers["n"].to_pylist()), sum(answers["v"].to_pylist())
    assert (n, v) == (4, 4)
    assert lm._scored(rows, answers, n, v, 1, lm.SMOOTHING, 4)["n_known"].to_pylist() == [4, 2]
    other = rows.set_column(3, "text", pa.array(["a b c", "a e"]))
    with pytest.raises(RuntimeError):
        lm._scored(other, answers, n, v, 1, lm.SMOOTHING, 4)


def test_lm_empty(spark):
    assert lm_scores(docs(spark, [])).count() == 0
    import zlib

    i = next(x for x in range(1000) if zlib.crc32(str(x).encode()) % 7 == 2)
    r = lm_scores(docs(spark, [(i, "a b", "s")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0.0 == r["base_score"]


# ---- language ------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    for lengths in ([1], [0, 3, 2], [5, 0, 1]):
        border = np.append(0, np.cumsum(lengths))
        emit, trans, start = rng.normal(size=(border[-1], 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
        post, moves = li.forward_backward(emit, border, trans, start, True)
        want, total = np.zeros_like(emit), np.zeros((3, 3))
        for a, b in zip(border, border[1:], strict=False):
            z = 0
            part, mv = np.zeros((b - a, 3)), np.zeros((3, 3))
            for ys in itertools.product(range(3), repeat=b - a):
                if b > a:
                    s = start[ys[0]] + sum(emit[a + i, y] for i, y in enumerate(ys)) + sum(trans[x, y] for x, y in zip(ys, ys[1:], strict=False))
                    w = np.exp(s)
                    z += w
                    for i, y in enumerate(ys):
                        part[i, y] += w
                    for x, y in zip(ys, ys[1:], strict=False):
                        mv[x, y] += w
            if b > a:
                want[a:b] = part / z
                total += mv / z
        assert np.allclose(post, want) and np.allclose(moves, total)


def test_segments_make_no_difference(monkeypatch):
    rng = np.random.default_rng(3)
    border = np.array([0, 70, 70, 171])
    args = rng.normal(size=(171, 4)) * 2, border, rng.normal(size=(4, 4)), rng.normal(size=4)
    a = li.forward_backward(*args)[0]
    monkeypatch.setattr(li, "SEGMENT", 7)
    assert np.allclose(a, li.forward_backward(*args)[0])


def language_rows(rng, n):
    say = {"aa": ["bla", "blub", "blom", "bre", "bru"], "zz": ["xix", "xax", "xoz", "zux", "zaz"]}
    return [(i, " ".join(rng.choice(say[lang]) + rng.choice(["", "s", "t"]) for _ in range(rng.randint(3, 30))), lang) for i in range(n) for lang in [rng.choice(["aa", "zz"])]]


def test_language(spark):
    rng = random.Random(6)
    rows = language_rows(rng, 300)
    d = spark.createDataFrame([(i, t, y, "s", 0, 7, "x", 1, 2) for i, t, y in rows] + [(900, None, "aa", "s", 0, 7, "x", 1, 2), (901, "12 !?", None, "s", 0, 7, "x", 1, 2), (902, "", "zz", "s", 0, 7, "x", 1, 2), (903, "bla blub bre xix xax zaz", None, "s", 0, 7, "x", 1, 2), (904, "é" * 200_000, None, "s", 0, 7, "x", 1, 2)], DOC)
    got = {r["doc_id"]: r for r in li.detect_language(d, spans=True).collect()}
    held = [(i, y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 50 and sum(got[i]["lang_pred"] == y for i, y in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert [(s["first_word"], s["n_words"], s["lang"]) for s in got[903]["spans"]] == [(0, 3, "aa"), (3, 3, "zz")]
    assert got[904]["lang_pred"] in ("aa", "zz")
    left = li.keep_languages(d, min_score=0.4)
    assert left.columns == d.columns and left.count() == 302
    assert {r["lang_pred"] for r in li.detect_language(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert li.detect_language(d.limit(0)).count() == 0


def test_language_learns_from_whole_texts(spark):
    # every text begins with what tells nothing
    rng = random.Random(8)
    rows = [(i, "same words here " * 40 + t, y) for i, t, y in language_rows(rng, 300)]
    d = spark.createDataFrame([(i, t, y, "s", 0, 7, "x", 1, 2) for i, t, y in rows], DOC)
    got = li.training_sample(d, "doc_id", "text", "lang", 3, 1, 100)
    whole = {(t, y) for _, t, y in rows}
    assert 60 < len(got) < 140 and set(got) <= whole and len(set(got)) == len(got)
    assert li.training_sample(d.union(d), "doc_id", "text", "lang", 3, 1, 10_000) == li.training_sample(d, "doc_id", "text", "lang", 3, 1, 10_000)


def test_texts_in_many_languages_stay(spark):
    rng = random.Random(9)
    say = {"aa": ["bla", "blub"], "hh": ["hih", "huh"], "mm": ["mom", "mum"], "zz": ["xix", "xax"]}
    rows = [(i, " ".join(rng.choice(say[y]) for _ in range(20)), y) for i in range(200) for y in [rng.choice(list(say))]]
    mixed = " ".join(rng.choice(v) for v in say.values() for _ in range(20))
    d = spark.createDataFrame([(i, t, y, "s", 0, 7, "x", 1, 2) for i, t, y in [*rows, (900, mixed, None)]], DOC)
    got = {r["doc_id"]: r for r in li.detect_language(d).collect()}
    assert got[900]["score"] < 0.4 and got[900]["sure"] > 0.8
    assert li.keep_languages(d, min_score=0.4).where("doc_id = 900").count() == 1


# ---- URL filter -------------------------------------------------------------------------------


def test_urls(spark):
    e = spark.createDataFrame(
        [("Bad.com", "add", "2024-01-10"), ("bad.com", "remove", "2024-02-01"), ("bad.com", "add", "2024-06-01"), ("ok.org/x/y/", "add", "2024-01-01"), ("http://tie.com", "remove", "2024-01-05"), ("tie.com", "add", "2024-01-05"), (None, "add", "2024-01-01"), ("late.com", "add", None), ("late.com", "remove", "2024-01-01")],
        "key string, action string, since string",
    )
    rows = [
        (1, "http://bad.com/a", "2024-01-09 23:59:59", None), (2, "https://u:p@sub.BAD.com:80/a?q=bad", "2024-01-10 00:00:00", "bad.com"), (3, "http://bad.com", "2024-02-01 00:00:00", None), (4, "http://bad.com.", "2030-01-01 00:00:00", "bad.com"),
        (5, "http://notbad.com/", "2024-07-01 00:00:00", None), (6, "http://a.ok.org/x/y/z", "2024-07-01 00:00:00", None), (7, "http://ok.org/x/y/z#f", "2024-07-01 00:00:00", "ok.org/x/y"), (8, "http://ok.org/x/yz", "2024-07-01 00:00:00", None), (9, None, "2024-07-01 00:00:00", None),
        (10, "http://bad.com", None, None), (11, "no url", "2024-07-01 00:00:00", None), (12, "http://tie.com/", "2024-01-05 00:00:00", "tie.com"), (13, "http://late.com/", "2024-07-01 00:00:00", None), (2, "https://u:p@sub.BAD.com:80/a?q=bad", "2024-01-10 00:00:00", "bad.com"),
    ]
    c = spark.createDataFrame([(i, u, t, 1, "k") for i, u, t, _ in rows], "page_id long, url string, fetched_at string, host int, key string")
    got = uf.filter_urls(c, e, period_days=16)
    assert collect(got, "page_id", "matched_key") == sorted([(i, k) for i, _, _, k in rows], key=lambda r: (r[0], r[1] is None, r[1]))
    assert got.where("blocked != (matched_key is not null)").count() == 0
    assert uf.filter_urls(c, e.limit(0)).where("blocked").count() == 0
    assert uf.filter_urls(c.limit(0), e).count() == 0


@pytest.mark.parametrize("most", [None, 0])
def test_urls_by_all_entries(spark, monkeypatch, most):
    """Random histories and times against a walk through all entries, with the list broadcast and not."""
    if most is not None:
        monkeypatch.setattr(uf, "BROADCAST_KEYS", most)
    rng = random.Random(3)
    day = lambda: f"{rng.choice((1970, 2023, 2024, 2024, 9998))}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    hosts = [f"h{i}.com" for i in range(6)] + ["com", "a.h1.com"]
    entries = [(rng.choice(hosts), rng.choice(("add", "add", "remove")), day()) for _ in range(80)]
    rows = [(i, f"http://{rng.choice(('', 'a.', 'b.a.'))}{rng.choice(hosts)}/p", day()) for i in range(150)]

    def blocks(url, at):
        host = url.split("/")[2]
        for key in sorted({x for x, _, _ in entries if host == x or host.endswith("." + x)}, key=len, reverse=True):
            days = {}
            for k, action, since in entries:
                if k == key and since <= at:
                    days[since] = "add" if "add" in (days.get(since), action) else action
            if days and days[max(days)] == "add":
                return key, max(days)
        return None, None

    c = spark.createDataFrame(rows, "page_id long, url string, fetched_at string")
    got = uf.filter_urls(c, spark.createDataFrame(entries, "key string, action string, since string"), period_days=10)
    assert {r["page_id"]: (r["matched_key"], r["listed_since"] and str(r["listed_since"])[:10]) for r in got.collect()} == {i: blocks(u, t) for i, u, t in rows}


def test_far_dates_add_no_rows(spark):
    """Three captures of three ages against a large list."""
    e = spark.range(100_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("key"), F.lit("add").alias("action"), F.lit("2001-01-01").alias("since"))
    c = spark.createDataFrame([(1, "http://h7.com/", "1970-01-02"), (2, "http://x.h8.com/", "2024-01-01"), (3, "http://h99999.com/", "9998-12-31"), (4, "http://other.com/", "9998-12-31")], "page_id long, url string, fetched_at string")
    assert collect(uf.filter_urls(c, e), "page_id", "matched_key") == [(1, None), (2, "h8.com"), (3, "h99999.com"), (4, None)]


# ---- WARC ----------------------------------------------------------------------------------------


def test_warc(spark):
    rows = [(1, "http://a/1", "<p>é"), (2, "http://a/2", "<p>é"), (3, None, None), (4, "http://a/4 x\n", ""), (5, "u", LONG), (None, "u", "<p>é"), (6, "u", "solo"), (6, "u", "solo2"), (7, "v", "x\r\n\r\ny")]
    p = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    index = warc.write_archives(p, file_bytes=800)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 1
    got = {(r["page_id"], r["url"]): r for r in warc.read_records(index, True).collect()}
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got[2, "http://a/2"]["record_type"] == "response" and got[1, "http://a/1"]["refers_to"] == 2 and got[None, "u"]["refers_to"] == 2
    assert got[4, "http://a/4%20x%0A"]["record_type"] == "response" and got[3, None]["refers_to"] == 4
    for (i, u), r in got.items():
        full = next(h or "" for a, b, h in rows if a == i and (b is None or u is not None) and (r["payload"] is None or (h or "") == r["payload"]))
        assert r["payload_bytes"] == len(full.encode()) and r["payload_digest"] == b32(full)
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    assert got[5, "u"]["payload"] == LONG and got[7, "v"]["payload"] == "x\r\n\r\ny"
    some = warc.read_records(index.where("page_id = 5"), True).collect()
    assert len(some) == 1 and some[0]["payload"] == LONG
    assert warc.archive_round_trip(p.limit(0)).count() == 0
    assert warc.archive_round_trip(p, min_bytes=4).where("record_type = 'revisit'").count() == 2


def test_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (10_000_000, 1)], gap=90, most=1000) == [(0, 3, 0, 105), (3, 4, 10_000_000, 1)]
    assert warc.coalesced([(0, 600), (600, 600)], gap=90, most=1000) == [(0, 1, 0, 600), (1, 2, 600, 600)]


# ---- HTML --------------------------------------------------------------------------------------------


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 50))
        ids, d = rng.integers(0, 3, n).astype(np.uint64), int(rng.integers(1, 9))
        order, rank = ht.suffix_array(ids, d)
        key = [tuple(ids[i : i + d].tolist()) for i in range(n)]
        assert [key[i] for i in order] == sorted(key)
        assert all((key[i] == key[j]) == (rank[i] == rank[j]) for i in range(n) for j in range(n))


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use</div><!-- <p>no</p> --><main><article class="post-with-comments"><header><h1>Head &amp; line</h1></header>
<p><b>One<br><p>Two  &lt;three&gt;&nbsp;x<div class="ad">buy <p>now</p></div><p>Four <span class="ad">ADS</span> five<aside>side</aside><p title="a > b">six</p>
<section id="comments"><article class="comment"><p>reader</p></article></section><form><input>f</form><footer>by</footer></article></main><footer>&copy;</footer>"""


def test_markup():
    text, rest = ht.split_page(ARTICLE)
    assert text == "Head & line\n\nOne\n\nTwo <three> x\n\nFour five\n\nsix"
    assert all(dull for dull, _ in rest) and "reader" in [t for _, t in rest]
    assert ht.split_page("a < b & c") == (None, [(False, "a < b & c")])
    assert ht.split_page("") == (None, [])
    assert ht.split_page("<main>m<script>never closed")[0] == "m"
    assert ht.split_page("<div>a</div><div role='navigation'>b</div><p hidden>c</p>") == (None, [(False, "a"), (True, "b"), (True, "c")])


@pytest.mark.parametrize("chunk", [6000, 512 << 10])
def test_host_boilerplate(spark, chunk):
    """A host in one chunk, and in about ten."""

    def page(i):
        return f"<body><div>Site menu home about contact us now and more</div><div>unique text number {i} of {i * 7} words here {i * 13}</div><div>All rights reserved by the owner of this site</div></body>"

    rows = [(i, f"http://h{i % 2}.example.com/{i}", page(i)) for i in range(400)] + [(1020, None, None), (1021, "http://z.example.com/", ARTICLE), (1022, "http://z.example.com/2", ARTICLE), (1023, "http://alone.example.com", page(3)), (1024, "http://h0.example.com/0", page(0))]
    p = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in ht.extract_text(p, chunk_bytes=chunk).collect()}
    for i in range(400):
        text = f"unique text number {i} of {i * 7} words here {i * 13}"
        assert got[i] == (text, len(text))
    assert got[1020] == ("", 0) and got[1021] == got[1022] and got[1021][0].startswith("Head & line")
    assert "Site menu" in got[1023][0] and got[1024] == got[0]
    assert ht.extract_text(p.limit(0)).count() == 0


def test_host_keeps_what_few_pages_share(spark):
    chrome = "<div>Site menu home about contact us now and more</div>"
    own = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(8)]
    phrase = "as we have said so many times before"
    body = {i: f"{own[i]} {phrase if i < 3 else 'x'} end {i}" for i in range(8)}
    body |= {8: "the same story told " + own[0] + " in version one", 9: "the same story told " + own[0] + " in version two"}
    rows = [(i, "http://h.example.com/", f"<body>{chrome}<div>{t}</div>") for i, t in body.items()]
    rows += [(20 + i, "http://two.example.com/", f"<body><div>{body[8 + i]}</div>") for i in range(2)]
    # an ordinary phrase on most pages makes no hole in a block
    rows += [(30 + i, "http://most.example.com/", f"<body><div>{own[i]} {phrase} {own[i][::-1]}</div>") for i in range(4)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in ht.extract_text(p).collect()}
    assert all(got[i] == t for i, t in body.items())
    assert got[20] == body[8] and got[21] == body[9]
    assert all(got[30 + i] == f"{own[i]} {phrase} {own[i][::-1]}" for i in range(4))


def test_markup_keeps_whole_articles():
    body = " ".join(f"word{i}" for i in range(60))
    card = "<article><h3>Teaser</h3></article>"
    # a card next to the body
    assert body in ht.split_page(f"<main><div>{body}</div>{card}</main>")[0]
    text, rest = ht.split_page(f"<div>{body}</div>{card}")
    assert text is None and (False, body) in rest
    assert ht.split_page(f"<main><p>by</p><article>{body}</article></main>")[0] == body
    # a form around the page, with a form of its own in it
    assert ht.split_page(f"<form id=aspnetForm><article>{body}</article><p>out</p></form>")[0] == body
    assert ht.split_page(f"<form role=form><div>{body}</div><form>go</form></form><p>x</p>") == (None, [(False, body), (True, "go"), (False, "x")])
    assert ht.split_page(f"<article>{body}<form>subscribe now</form></article>")[0] == body
    # ids of what the article is about
    about = "<section id=discussion><p>one</p></section><h2 id=related-work>two</h2><div id=search-algorithms>three</div>"
    assert ht.split_page(f"<article id=related-work>{about}</article>")[0] == "one\n\ntwo\n\nthree"
    assert ht.split_page(f"<article>{body}<div id=related-posts>a</div><section id=comments>b</section><div class=main-nav>c</div></article>")[0] == body


# ---- later additions ---------------------------------------------------------------------


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_runs_are_merged_in_place(spark, tmp_path):
    """Levels, and plans without an exchange (and of merges without a sort) above the runs."""
    runs = ld.LineRuns(spark, settled_at=2)
    texts = ["a\nb", "b\nc", "b\nd", "e", "f\nb"]
    for i, t in enumerate(texts):
        runs.add(docs(spark, [(i, t, "s")]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # 1 + 4 batches
    assert sorted(r["n"] for r in runs.levels[2][0].collect()) == [1, 1, 1, 1, 2]  # b is settled after two of its batches
    assert runs.levels[0][0].count() == 1 and runs.totals(2).count() == 1
    a, b = runs.levels[2][0], runs.levels[0][0]
    with runs._sorted_scans():
        for df, sorts in ((runs.merged(a, b), 0), (runs.fresh(a.select("h1", "h2")), 0)):
            plan = physical(df)
            assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Sort [") == sorts, plan
        each = spark.createDataFrame([(1, 2, 3, 4)], "a long, b long, h1 long, h2 long").repartition(3)
        plan = physical(each.join(a.select("h1", "h2"), ["h1", "h2"], "left_semi"))
        right = plan[plan.index("SortMergeJoin"):].split("\n")
        assert sum("Exchange hash" in x for x in right) == 1, plan  # of the batch alone


NAMES = "__row __row_id __row_th __gone_id __gone_th __id __sha __th __ta __tb __a __b __i __s __n __z __lines __kept __gone __text __j __ith row lines kept gone text_ key place size range source_ mix_size c0 node th a b h1 h2".split()


def clashing(spark, rows):
    """Documents with further columns named like those in use inside the operators."""
    d = docs(spark, rows).drop("size", "kept", "node", "a.b")
    for n in NAMES:
        d = d.withColumn(n, F.lit(1))
    return d


def test_names_never_clash(spark):
    rows = [(i, f"common line\nwords of {i} and more {i * 7}", "st"[i % 2]) for i in range(12)] + [(None, None, None), (3, "", "s")]
    d = clashing(spark, rows)
    bench = spark.createDataFrame([(1, "words of 3 and more 21")], "item_id long, text string")
    assert drop_copies(d).columns == d.columns and drop_copies(d).count() == 13
    left = dc.drop_contaminated(d, bench)
    assert left.columns == d.columns and left.count() == 13
    assert nd.drop_near_copies(d).columns == d.columns
    assert li.keep_languages(d, min_score=0.0).columns == d.columns
    gone = ld.with_kept_text(ld.drop_common_lines(d, min_docs=10, batches=3), "text", d.columns)
    assert gone.columns == d.columns and gone.where("text like '%common%'").count() == 0 and gone.count() == 14
    mixed = mixed_documents(d)
    assert mixed.columns == [c for c in d.columns if c != "mix_size"] + ["mix_size", "mix_target", "mix_taken"]
    assert mixed_documents(mixed).count() > 0


def test_mix_is_by_row(spark):
    """Equal rows share what is left of the budget, and rows that differ in text alone are told apart."""
    d = docs(spark, [(1, "one two three four", "s")] * 6 + [(2, "a b", "t")])
    targets = {r["source"]: r["target"] for r in mix_sources(d, weights=(1, 1), share=0.4, max_epochs=1).collect()}
    out = mixed_documents(d, weights=(1, 1), share=0.4, max_epochs=1)
    taken = {s: sum(r["mix_taken"] for r in out.where(F.col("source") == s).collect()) for s in "st"}
    assert taken == {s: int(t) for s, t in targets.items()} and 0 < taken["s"] < 24
    d = docs(spark, [(1, "one two", "s"), (1, "ONE TWO", "s"), (1, "six seven", "s"), (9, "z", "t")])
    got = mixed_documents(d, weights=(1,), share=0.5, max_epochs=1).where("source = 's'").collect()
    want = int(next(r["target"] for r in mix_sources(d, weights=(1,), share=0.5, max_epochs=1).collect() if r["source"] == "s"))
    assert sum(r["mix_taken"] for r in got) == want


def test_markup_names_are_weak():
    body = " ".join(f"word{i}" for i in range(60))
    assert ht.split_page('<article class="post share-enabled"><p>hello world</p></article>')[0] == "hello world"
    kept = '<section id="comment-on-policy">one</section><p class="notice-period">two</p><div class="share-enabled">three</div>'
    assert ht.split_page(f"<article>{body}{kept}</article>")[0] == f"{body}\n\none\n\ntwo\n\nthree"
    out = '<div class="reader-opinions">a</div><div class="feedback">b</div><article class="comment">c</article><ul class="user-comments"><li>d</ul><div class="ad-slot-3">e</div>'
    assert ht.split_page(f"<article>{body}{out}</article>")[0] == body
    assert ht.split_page("<article>See <button>this</button> thing</article>")[0] == "See thing"
    assert ht.split_page("<article><p>a <select><option>x</select> b</article>")[0] == "a\n\nb"


def test_host_decides_inside_articles(spark):
    """What most pages of a host repeat goes from articles too; a hint needs less; what few pages share stays."""
    own = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(40)]
    bio = "<p>Jane writes about science for this site since many years</p>"
    hint = "<div class=newsletter-wide-v2>get our best stories sent to you every day</div>"
    plain = "<p>get our best stories sent to you every day</p>"
    quote = "<p>to be or not to be that is the question here</p>"
    page = lambda i: f"<article><h1>T{i}</h1><p>{own[i]}</p>{quote if i < 10 else ''}{hint if i < 8 else ''}{plain if i == 9 else ''}{bio}</article>"
    rows = [(i, "http://h.example.com/", page(i)) for i in range(40)] + [(90, "http://two.example.com", page(0)), (91, "http://two.example.com", page(1))]
    got = {r["page_id"]: r for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda x: re.sub("<[^>]*>", "", x)
    for i in range(40):
        want = [f"T{i}", own[i]] + [text(quote)] * (i < 10) + [text(plain)] * (i == 9)
        assert got[i]["text"] == "\n\n".join(want), i
    assert got[0]["dropped_repeats"] == 2 and got[39]["dropped_repeats"] == 1 and got[0]["rule"] == "article"
    assert text(bio) in got[90]["text"] and text(hint) not in got[90]["text"]  # two pages
    # most pages of a host are one article in versions
    story = "".join(f"<p>{x}</p>" for x in own[:6])
    rows = [(i, "http://v.example.com/", f"<article>{story}<p>version {i} of the story as told on day {i}</p></article>") for i in range(5)] + [(5, "http://v.example.com/", f"<article><p>{own[9]}</p></article>")]
    got = {r["page_id"]: r["text"] for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(own[j] in got[i] for i in range(5) for j in range(6)) and got[5] == own[9]


def test_chunks_of_a_host_change_nothing(spark):
    """Shares and pages are those of the host, in however many chunks it is dealt."""
    rng = random.Random(3)
    own = lambda i: " ".join(f"p{i}w{j}" for j in range(20))
    parts = [" ".join(f"s{x}w{j}" for j in range(9)) for x in range(24)]
    share = [rng.choice((0.04, 0.09, 0.11, 0.3, 0.48, 0.52, 0.7)) for _ in parts]

    def page(i, n):
        held = [x for x in range(24) if rng.random() < share[x]] if n > 5 else [0, 1] if i < 2 else [2]
        blocks = [f"<div class=newsletter-wide-v{x}>{parts[x]}</div>" if x % 2 else f"<p>{parts[x]}</p>" for x in held]
        return f"<article><p>{own(i)}</p>{''.join(blocks)}</article>" if i % 2 else f"<body><div>{own(i)}</div>{''.join(blocks)}"

    rows = [(h * 1000 + i, f"http://h{h}.example.com/", page(i, n)) for h, n in enumerate((90, 5, 31)) for i in range(n)]
    rows += [(5000 + i, *rows[0][1:]) for i in range(30)]  # copies of a page count once
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    show = lambda chunk: sorted(map(tuple, ht.extract_text(p, chunk_bytes=chunk).collect()))
    want = show(1 << 30)
    assert sum(r[-1] for r in want) > 100
    for chunk in (20_000, 4000, 1):
        assert show(chunk) == want


def test_beyond_the_bounds_of_broadcasts(spark, monkeypatch):
    """Tables that are too large to broadcast are joined, with the same rows."""
    from sievewright.llm import common, exact_dedup as ed, mixing as mx

    rng = random.Random(11)
    rows = [(i, rng.choice(["same text here", f"own {i} words", f"own {i} words and more"]), rng.choice("stu")) for i in range(60)] + EDGE
    d = docs(spark, rows)
    p = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/", f"<p>{t}</p>" * 40) for i, t, _ in rows if i is not None and t is not None and len(t) < 100], "page_id long, url string, html string")
    bench = spark.createDataFrame([(1, "own 7 words")], "item_id long, text string")

    def everything():
        show = lambda df: sorted(map(str, df.collect()))
        return [
            show(mx.mix_sources(d)),
            show(mixed_documents(d)),
            show(exact_dedup(d, n_partitions=4)),
            show(warc.archive_round_trip(p)),
            show(ht.extract_text(p, chunk_bytes=4000)),
            show(dc.drop_contaminated(d, bench)),
        ]

    want = everything()
    for module, name in ((mx, "BROADCAST_SOURCES"), (ed, "BROADCAST_EDGES"), (warc, "BROADCAST_DIGESTS"), (ht, "BROADCAST_HOSTS"), (common, "BROADCAST_KEYS")):
        monkeypatch.setattr(module, name, 0)
    assert everything() == want
