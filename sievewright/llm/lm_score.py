"""LM scoring with a weighted backoff automaton over trigrams.

The model is a smoothed trigram model in backoff form.  Contexts seen in
training are states: the root (no context), every word h, every pair of words
gh.  A state has an arc for each word w seen after it, weighted
log10 p(w | state), that leads to the state of the longest context the text has
then; and one failure arc, weighted log10 of its backoff mass, to the state of
the context that is one word shorter.  The root has an arc for every word, and
one for all words unseen.

    root:   p(w)   = (c(w) + 1) / (N + V + 1)
    state:  p(w|s) = (c(sw) + m(s) p(w|s')) / (c(s) + m(s)),   m(s) = a c(s)^b

s' is s without its first word, so the arcs of a state sum to 1 with its
failure arc (m depends on the state alone).  c are counts over all training
documents, N tokens and V distinct tokens of those; each document ends with one
end token and starts in a start state.

A text is scored by one traversal from left to right that carries the state and
adds up weights: a word without an arc costs the failure arc, and is asked for
again there.  All texts of a block step together.  Long texts are cut into
segments of ``SEGMENT`` tokens; a segment finds its first state by reading the
two tokens before it from the root, which is as far as a state remembers.

The model grows with the corpus, so no task and no driver ever holds it.
The corpus is cut into blocks of about ``block_bytes`` of text.

1. Each block asks: for each of some ranges of the n-gram hashes it sends
   its own distinct n-grams (sorted 63-bit hashes) with their training counts
   in the block - one row per block, order and range.
2. The rows of a range are added up, and every block is answered with the
   totals of just the n-grams it asked for, in the order it asked.
   Up to ``fan`` blocks (64 GB of text) are added up at once.  More blocks go
   through a tree: groups of ``fan`` blocks are merged into one asker each, whose
   ranges are ``fan`` times as fine, and answers come down the same way.  So a row
   holds a hundred n-grams or more, what a task holds is the same at every size,
   and an n-gram moves once up and once down a level (two levels up to 1 PB).
   The tree writes what blocks ask for once more, to answer it on the way down.
3. Each block builds the part of the automaton that its own texts can reach
   and traverses it.

Everything is counted, nothing is pruned, capped or sampled, and skewed words
are combined inside a block before anything moves.  The rows of ``docs`` are
read twice and must come in the same partitions both times, as those of a
table do.  A digest of the n-grams goes with every ask and answer: a block that
holds other n-grams than it asked for raises.

Defined cases: null text is the empty text, one end token; a corpus without
training rows has N = 0 and V = 0, every word is unknown; repeated rows are
scored each, and each counts; a null id is text '' for the split.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.shipping import ship

from . import tokens as tk
from .common import arrow_bytes, partitions, quoted, stash, text_or_empty

U = np.uint64
EVEN = U(0xFFFFFFFFFFFFFFFE)
END = U(0x5E0D000000000002)
START = U(0x57A2000000000004)
ORDER = 3
#: (a, b) of the backoff mass a c^b of a state seen c times, by the words of its
#: context.  Fitted on held-out text.
SMOOTHING = ((4.0, 0.85), (1.0, 0.85))
#: Text of a block; with its n-grams and arcs about twenty times as much memory.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch from Spark.
ARROW_BYTES = 4 << 20
#: Tokens of a segment that is traversed on its own.
SEGMENT = 64
#: Blocks (or groups) that are added up at once; and ranges of the hashes, at least.
FAN, SHARDS = 1 << 14, 256


def in_split(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on the remainder."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def extended(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its context and its last word."""
    return tk.mix(context * U(0x9E3779B97F4A7C15) + w, 11) & EVEN


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(block of each row, batch) of (doc_id, held_out, text): partition and place in it, by bytes of text before."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        _, off = tk.buffers(b.column(2))
        yield (part << 32) + (total + off[:-1] - off[0]) // block_bytes, b
        total += int(off[-1] - off[0])


def _tagged(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Adds the block."""
    for block, b in _blocks(batches, block_bytes):
        yield pa.RecordBatch.from_arrays([pa.array(block), *b.columns], ["block", "doc_id", "held_out", "text"])


def sequence(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each with its end, and the borders of the texts."""
    parts, counts = [], []
    for col in texts:
        for _, _, raw, off in tk.blocks(col):
            h, first = tk.words(raw, off)
            parts.append(np.insert(h & EVEN, first[1:], END))
            counts.append(np.diff(first) + 1)
    n = np.concatenate([*counts, np.zeros(0, np.int64)])
    return np.concatenate([*parts, np.zeros(0, U)]), np.append(0, np.cumsum(n))


def ngrams(tokens: np.ndarray, border: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, position of the last token) of all n-grams, for n from 1 to ORDER.
    The first token of a text has the context START, and no longer one."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[border[:-1]] = START
    at = np.arange(len(tokens))
    out = [(tokens, at), (extended(before, tokens), at)]
    inner = np.ones(len(tokens), bool)
    for n in range(3, ORDER + 1):
        inner[border[:-1][np.diff(border) > n - 3] + n - 3] = False
        at = np.flatnonzero(inner)
        last = np.zeros_like(tokens)
        last[out[-1][1]] = out[-1][0]
        out.append((extended(last[at - 1], tokens[at]), at))
    return out


def packed_ints(x: np.ndarray) -> bytes:
    """Integers in few bytes: the first bytes of all first, then compressed; small numbers cost what they hold."""
    raw = x.astype(x.dtype.newbyteorder(">"), copy=False).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_ints(raw: bytes, dtype=U) -> np.ndarray:
    size, dtype = int.from_bytes(raw[:8], "little"), np.dtype(dtype)
    flat = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).view(dtype.newbyteorder(">")).reshape(-1).astype(dtype)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as what each has more than the one before, without the last bit, which is always 0."""
    return packed_ints(np.diff(keys >> U(1), prepend=U(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked_ints(raw), dtype=U) << U(1)


def range_cuts(ranges: int) -> np.ndarray:
    """First hashes of all ranges but the first."""
    return np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], U)


def digests(keys: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the keys between edges."""
    total = np.zeros(len(keys) + 1, U)
    np.cumsum(tk.mix(keys, 61), out=total[1:])
    return (tk.mix(total[edge[1:]] - total[edge[:-1]], 62) + np.diff(edge).astype(U)).view(np.int64)


ASK = "unit long, shard long, kind int, grams binary, counts binary, digest long"
ANSWER = "unit long, shard long, kind int, counts binary, digest long, n long, v long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def _ask_rows(unit: int, kind: int, keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray, first: int = 0) -> list[tuple]:
    """Sorted n-grams of a unit to a row a range; ``first``: the number of the first range."""
    edge = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
    d = digests(keys, edge)
    return [(unit, first + s, kind, packed_keys(keys[i:j]), packed_ints(counts[i:j].astype(U)), int(d[s])) for s, (i, j) in enumerate(zip(edge, edge[1:], strict=False)) if i < j]


def _asks(block: int, texts: list[pa.Array], held: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block to a row per order and range: sorted n-grams and training counts."""
    tokens, border = sequence(texts)
    train = ~np.repeat(np.concatenate(held), np.diff(border))
    for kind, (h, at) in enumerate(ngrams(tokens, border), 1):
        s = h | train[at]  # the last bit is free
        s.sort()
        start = np.flatnonzero(np.append(True, (s[1:] ^ s[:-1]) > U(1))) if len(s) else np.zeros(0, np.int64)
        n = np.add.reduceat(s & U(1), start) if len(s) else np.zeros(0, U)
        yield from _table(ASK, _ask_rows(block, kind, s[start] & EVEN, n, cuts)).to_batches()


def _asked(batches: Iterator[pa.RecordBatch], block_bytes: int, shards: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) rows to the asks of their blocks."""
    cuts = range_cuts(shards)
    open_, texts, held = None, [], []
    for block, b in _blocks(batches, block_bytes):
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            if open_ is not None and block[i] != open_:
                yield from _asks(open_, texts, held, cuts)
                texts, held = [], []
            open_ = int(block[i])
            texts.append(b.column(2).slice(i, j - i))
            held.append(b.column(1).slice(i, j - i).to_numpy(zero_copy_only=False))
    if open_ is not None:
        yield from _asks(open_, texts, held, cuts)


def _added(table: pa.Table, kind: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Asks of an order: (places of its rows, their n-grams, all n-grams in order, totals)."""
    rows = np.flatnonzero(table["kind"].to_numpy() == kind).tolist()
    grams = [unpacked_keys(table["grams"][i].as_py()) for i in rows]
    counts = [unpacked_ints(table["counts"][i].as_py()) for i in rows]
    if not rows:
        return rows, grams, np.zeros(0, U), np.zeros(0, U)
    every = np.concatenate(grams)
    order = np.argsort(every)
    every = every[order]
    start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return rows, grams, every[start], np.add.reduceat(np.concatenate(counts)[order], start)


def _answers(table: pa.Table, rows: list[int], grams: list[np.ndarray], keys: np.ndarray, totals: np.ndarray) -> list[tuple]:
    units, shards, digest = (table[c].to_numpy() for c in ("unit", "shard", "digest"))
    return [(int(units[i]), int(shards[i]), int(table["kind"][i].as_py()), packed_ints(totals[np.searchsorted(keys, g)]), int(digest[i]), 0, 0) for i, g in zip(rows, grams, strict=True)]


def _answered(table: pa.Table) -> pa.Table:
    """All asks of a range to the totals of the n-grams each asked for; the first row of words tells N and V of the range."""
    out = []
    for kind in range(1, ORDER + 1):
        rows, grams, keys, totals = _added(table, kind)
        got = _answers(table, rows, grams, keys, totals)
        if kind == 1 and got:
            got[0] = (*got[0][:5], int(totals.sum()), int((totals > 0).sum()))
        out += got
    return _table(ANSWER, out)


def _merged(table: pa.Table, fan: int, ranges: int) -> pa.Table:
    """Asks of a group of units in a range to those of the group as a unit, in ``fan`` finer ranges of it."""
    group, shard = table["group"][0].as_py(), table["shard"][0].as_py()
    cuts = range_cuts(fan * ranges)[shard * fan : shard * fan + fan - 1]
    out = []
    for kind in range(1, ORDER + 1):
        _, _, keys, totals = _added(table, kind)
        out += _ask_rows(group, kind, keys, totals, cuts, shard * fan)
    return _table(ASK, out)


def _passed_down(asks: pa.Table, totals: pa.Table) -> pa.Table:
    """What a group was answered, to its units."""
    out = []
    totals = totals.sort_by("shard")
    for kind in range(1, ORDER + 1):
        rows, grams, keys, _ = _added(asks, kind)
        mine = totals.filter(pc.equal(totals["kind"], kind))
        n = np.concatenate([*(unpacked_ints(x) for x in mine["counts"].to_pylist()), np.zeros(0, U)])
        if len(n) != len(keys):
            raise RuntimeError("a group was answered for other n-grams than it asked for")
        out += _answers(asks, rows, grams, keys, n)
    return _table(ANSWER, out)


def summed(asks: DataFrame, units: int, fan: int, ranges: int) -> tuple[DataFrame, int, int]:
    """(answers, N, V): every ask with the totals over all units."""
    if units <= fan:
        answers = stash(asks.groupBy("shard").applyInArrow(_answered, ANSWER), "lm-answers")
        n, v = answers.agg(F.sum("n"), F.sum("v")).first()
        return answers, n or 0, v or 0
    groups = -(-units // fan)
    asks = stash(asks.withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(groups))), "lm-asks")
    up = asks.groupBy("group", "shard").applyInArrow(lambda t: _merged(t, fan, ranges), ASK)
    answers, n, v = summed(up, groups, fan, fan * ranges)
    down = answers.withColumn("coarse", F.floor(F.col("shard") / F.lit(fan)).cast("long"))
    got = asks.groupBy("group", "shard").cogroup(down.groupBy("unit", "coarse")).applyInArrow(_passed_down, ANSWER)
    return stash(got, "lm-answers"), n, v


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, the place of each key among them, a position of each)."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return s[new], at, order[new]


class BackoffAutomaton:
    """The states and arcs that some texts can reach, from total counts.

    States: 0 the root, then one a distinct word, the start state, one a
    distinct pair of words; those never seen in training have no way to them.
    Arcs are sorted by (state, word).
    """

    def __init__(self, tokens: np.ndarray, border: np.ndarray, counts_of, n: int, v: int, starts: int, smoothing=SMOOTHING):
        """``counts_of(kind, keys)``: total counts of distinct n-grams, given in order."""
        grams = ngrams(tokens, border)
        words, self.word, _ = ranked(tokens)
        self.count = counts_of(1, words).astype(np.float64)
        self.n_words = w = max(len(words), 1)
        pairs, pair, pair_at = ranked(grams[1][0])
        grams[0] = grams[1] = None  # a block's arrays are large: each goes when it has been used
        pair_n = counts_of(2, pairs).astype(np.float64)
        del words, pairs
        states = w + 2 + len(pair_n)
        self.start = w + 1
        seen = np.concatenate([[0.0], self.count, np.zeros(w - len(self.count)), [float(starts)], pair_n])  # of each state
        self.state_of_word = np.where(self.count > 0, 1 + np.arange(len(self.count)), 0)
        root = (self.count + 1.0) / (n + v + 1)
        self.root_weight = np.log10(root)
        mass = np.ones(states)
        for k, (lo, hi) in enumerate(((1, w + 2), (w + 2, states))):
            a, b = smoothing[k]
            mass[lo:hi] = a * np.maximum(seen[lo:hi], 1.0) ** b
        norm = seen + mass
        with np.errstate(divide="ignore"):
            self.fail_weight = np.where(seen > 0, np.log10(mass / norm), 0.0)
        del seen
        # arcs of words and of the start: to pairs
        last = self.word[pair_at]
        first = np.zeros(len(tokens), bool)
        first[border[:-1]] = True
        source = np.where(first[pair_at], self.start if starts else 0, self.state_of_word[self.word[pair_at - 1]])
        del first, pair_at
        p_pair = root[last]
        p_pair = np.where(source > 0, (pair_n + mass[source] * p_pair) / norm[source], p_pair)
        self.fail = np.zeros(states, np.int64)
        self.fail[w + 2 :] = self.state_of_word[last]
        on = np.flatnonzero(pair_n > 0)
        del pair_n
        keys, weights, dests = [source[on] * w + last[on]], [p_pair[on]], [(w + 2 + on).astype(np.int32)]
        del source, last, on
        # arcs of pairs: to pairs
        triples, _, at = ranked(grams[2][0])
        triple_n = counts_of(3, triples).astype(np.float64)
        del triples
        at = grams[2][1][at]
        del grams
        on = triple_n > 0
        at, triple_n = at[on], triple_n[on]
        source, dest = w + 2 + pair[at - 1].astype(np.int64), pair[at]
        keys.append(source * w + self.word[at])
        weights.append((triple_n + mass[source] * p_pair[dest]) / norm[source])
        dests.append(w + 2 + dest)
        del at, triple_n, on, source, dest, pair, p_pair, mass, norm
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.arc = keys[order]
        del keys
        self.weight, self.dest = np.log10(np.concatenate(weights)[order]), np.concatenate(dests)[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, states after) of reading a word in each state: an arc, or failure arcs until there is one."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            top = state == 0
            if top.any():
                r = todo[top]
                total[r] += self.root_weight[word[r]]
                after[r] = self.state_of_word[word[r]]
                todo, state = todo[~top], state[~top]
            if not len(todo):
                break
            key = state * self.n_words + word[todo]
            i = np.minimum(np.searchsorted(self.arc, key), max(len(self.arc) - 1, 0))
            hit = self.arc[i] == key if len(self.arc) else np.zeros(len(key), bool)
            r, i = todo[hit], i[hit]
            total[r] += self.weight[i]
            after[r] = self.dest[i]
            todo, state = todo[~hit], state[~hit]
            total[todo] += self.fail_weight[state]
            state = self.fail[state]
        return total, after

    def traverse(self, border: np.ndarray, starts: int) -> np.ndarray:
        """log10 probability of every token of the texts with these borders."""
        size = np.diff(border)
        n = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), n)
        begin = border[:-1][text]
        at = begin + (np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)) * SEGMENT
        length = np.minimum(SEGMENT, border[1:][text] - at)
        order = np.argsort(-length, kind="stable")  # those that still go on are the first
        begin, at, length = begin[order], at[order], length[order]
        read = np.maximum(begin, at - (ORDER - 1))
        state = np.where(read == begin, self.start if starts else 0, 0)
        for back in range(ORDER - 1, 0, -1):
            go = np.flatnonzero(at - back >= read)
            if len(go):
                state[go] = self.step(state[go], self.word[at[go] - back])[1]
        out = np.zeros(len(self.word))
        for j in range(SEGMENT):
            live = int(np.searchsorted(-length, -j, side="left"))  # length > j
            if not live:
                break
            p = at[:live] + j
            out[p], state[:live] = self.step(state[:live], self.word[p])
        return out


SCORES = T.StructType([T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _scored(rows: pa.Table, answers: pa.Table, n: int, v: int, starts: int, smoothing, shards: int) -> pa.Table:
    """One block: its rows, and the answers to what it asked."""
    tokens, border = sequence(rows["text"].chunks)
    answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")])
    cuts = range_cuts(shards)

    def counts_of(kind: int, keys: np.ndarray) -> np.ndarray:
        mine = answers.filter(pc.equal(answers["kind"], kind))
        edge = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
        d = digests(keys, edge)[np.diff(edge) > 0]
        if not np.array_equal(d, mine["digest"].to_numpy()):
            raise RuntimeError("the documents came in other partitions than before; pass a written table")
        return np.concatenate([*(unpacked_ints(x) for x in mine["counts"].to_pylist()), np.zeros(0, U)])

    model = BackoffAutomaton(tokens, border, counts_of, n, v, starts, smoothing)
    log = model.traverse(border, starts)
    at = border[:-1]
    return pa.table(
        [
            rows["doc_id"].combine_chunks(),
            rows["held_out"].combine_chunks(),
            pa.array(np.diff(border)),
            pa.array(np.add.reduceat(model.count[model.word] > 0, at, dtype=np.int64)),
            pa.array(np.add.reduceat(model.root_weight[model.word], at)),
            pa.array(np.add.reduceat(log, at)),
        ],
        names=["doc_id", *SCORES.names],
    )


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, smoothing=SMOOTHING, block_bytes: int = BLOCK_BYTES, shards: int | None = None, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.  Rows whose crc32(id) mod ``modulus`` is
    ``remainder`` are held out of training."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(quoted(id_col).alias("doc_id"), in_split(quoted(id_col), modulus, remainder).alias("held_out"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    facts = rows.select(F.octet_length("text").alias("size"), "held_out", F.spark_partition_id().alias("part"))
    size, starts, parts = facts.agg(F.sum("size"), F.count_if(~F.col("held_out")), F.countDistinct("part")).first()
    blocks = parts + (size or 0) // block_bytes  # or fewer
    # one for four blocks: a task adds up some 5 million n-grams, however many blocks there are
    shards = shards or max(SHARDS, min(blocks, fan) // 4)
    tagged = rows.mapInArrow(partial(_tagged, block_bytes=block_bytes), T.StructType([T.StructField("block", T.LongType()), *rows.schema.fields]))
    with arrow_bytes(spark, ARROW_BYTES):
        answers, n, v = summed(rows.mapInArrow(partial(_asked, block_bytes=block_bytes, shards=shards), ASK), blocks, fan, shards)
    # what the asks were shuffled in is of no use any more; lets Spark's cleaner have it before the texts move
    gc.collect()
    spark._jvm.java.lang.System.gc()
    fn = partial(_scored, n=n, v=v, starts=starts, smoothing=smoothing, shards=shards)
    # as many tasks as blocks, so that none gets many
    tasks = max(partitions(spark), answers.select("unit").distinct().count())
    told = answers.select("unit", "kind", "shard", "counts", "digest").repartition(tasks, "unit")
    with arrow_bytes(spark, ARROW_BYTES):
        out = stash(tagged.repartition(tasks, "block").groupBy("block").cogroup(told.groupBy("unit")).applyInArrow(fn, T.StructType([T.StructField("doc_id", kind), *SCORES.fields])), "lm-scores")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
