"""Language ID of words and texts with a linear-chain conditional random field.

Each word of a text is labelled, so that texts that switch between languages
come out as spans.  A word's emission is the sum of hashed feature weights -
its affixes (first and last three bytes), its byte trigrams with the word's
borders, and the word itself (lexicon) - and learned transitions tie
neighbours.  Forward-backward gives the posterior of every label at every
word; the language of a text is the label with the largest mean posterior over
its words with letters, which is also the score.

Training runs on the driver on the whole texts of a bounded sample of labelled
rows: about ``sample_rows`` distinct rows, as many of each label, chosen by a
hash of id and text.  That number is the only bound; it does not grow with
the input or with the labels.  Sequences are made of pieces of up to three
sampled texts, so that switches are learned too.

Prediction works on blocks of text.  Emissions are computed once per distinct
word of a block.  The chains of all texts are cut into segments of ``SEGMENT``
words: one pass multiplies the transfer matrices inside all segments at once,
a short one carries the state from segment to segment of each text, and a
last one spreads it inside the segments.

Defined cases: text null, empty or without a letter: label ``und``, score 0;
no labelled training row: ``und`` for all; a label seen once is learned like
any other; repeated rows are learned once; more than ``MOST_LABELS`` labels:
an error; ties go to the label first by code points; repeated rows are
predicted alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.shipping import ship

from . import tokens as tk
from .common import ARROW_BYTES, arrow_bytes, quoted, text_or_empty, without
from .lm_score import in_split

U = np.uint64
SEGMENT = 32
#: Entries of the weight table, features times labels: 8 MB, whatever the input.
TABLE = 1 << 21
#: Rows that the model is fitted on, about.
SAMPLE_ROWS = 1000
#: More labels than that can't be languages; the operator raises.
MOST_LABELS = 5000
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of words given as spans of ``raw``, and the index of each word's first."""
    n = len(starts)
    size = ends - starts
    # the words' bytes, each between two borders (bytes 2 and 3)
    edge = np.append(0, np.cumsum(size + 2))
    text = np.zeros(edge[-1] + 1, np.uint32)
    text[edge[:-1]] = 2
    text[edge[1:] - 1] = 3
    inside = np.repeat(starts - edge[:-1] - 1, size + 2) + np.arange(edge[-1])
    body = np.ones(edge[-1], bool)
    body[edge[:-1]] = body[edge[1:] - 1] = False
    text[:-1][body] = tk._LOW[raw[inside[body]]]
    tri = (text[:-2] << np.uint32(16) | text[1:-1] << np.uint32(8) | text[2:]) if len(text) > 2 else np.zeros(0, np.uint32)
    # a word of one byte has one trigram; each word has size of them
    at = np.repeat(edge[:-1] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
    first = np.append(0, np.cumsum(size + 3))
    out = np.empty(first[-1], np.int64)
    spot = np.ones(first[-1], bool)
    for k in range(3):
        spot[first[1:] - 1 - k] = False
    shift = U(64 - bits)
    out[spot] = (tk.mix(tri[at].astype(U), 21) >> shift).astype(np.int64)
    pre = tri[edge[:-1]].astype(U) << U(8) | text[np.minimum(edge[:-1] + 3, edge[1:] - 1)].astype(U)
    suf = tri[np.maximum(edge[1:] - 3, 0)].astype(U) << U(8) | text[np.maximum(edge[1:] - 4, edge[:-1])].astype(U)
    for k, f in enumerate((tk.mix(pre, 22), tk.mix(suf, 23), tk.mix(hashes, 24))):
        out[first[1:] - 1 - k] = (f >> shift).astype(np.int64)
    return out, first[:n]


@dataclass
class Crf:
    labels: list[str]
    bits: int
    weights: np.ndarray  # features x labels
    trans: np.ndarray  # labels x labels, log
    start: np.ndarray  # labels, log

    def emissions(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log emissions of words from their feature ids."""
        if not len(first):
            return np.zeros((0, len(self.labels)))
        n = np.diff(np.append(first, len(feats)))
        return np.add.reduceat(self.weights[feats], first, axis=0).astype(np.float64) / np.sqrt(n)[:, None]

    def posteriors(self, emit: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Posterior of each label at each word of chains with the borders given."""
        return forward_backward(emit, border, self.trans, self.start)[0]


def forward_backward(emit: np.ndarray, border: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors (words x labels), and with ``pairs`` the expected transitions (labels x labels)."""
    k = emit.shape[1]
    size = np.diff(border)
    chains = np.flatnonzero(size > 0)
    if not len(chains):
        return np.zeros((0, k)), np.zeros((k, k))
    size, begin = size[chains], border[:-1][chains]
    nseg = -(-size // SEGMENT)
    seg0 = np.append(0, np.cumsum(nseg))
    s = seg0[-1]
    seg_in = np.arange(s) - np.repeat(seg0[:-1], nseg)
    seg_at = np.repeat(begin, nseg) + seg_in * SEGMENT
    seg_len = np.minimum(SEGMENT, np.repeat(begin + size, nseg) - seg_at)
    where = np.minimum(seg_at[:, None] + np.arange(SEGMENT), len(emit) - 1)
    on = np.arange(SEGMENT) < seg_len[:, None]
    e = np.exp(np.maximum(emit - emit.max(1, keepdims=True), -60))[where]
    head = seg_in == 0
    tr, eye = np.exp(trans - trans.max()), np.eye(k)
    # transfer matrix of each segment
    m = np.broadcast_to(eye, (s, k, k)).copy()
    for t in range(SEGMENT):
        step = m @ tr
        if t == 0:
            step[head] = m[head]
        step *= e[:, t, None, :]
        step /= step.max((1, 2), keepdims=True)
        m = np.where(on[:, t, None, None], step, m)
    # state before and after each segment, along each chain
    before, after = np.empty((s, k)), np.empty((s, k))
    a = np.broadcast_to(np.exp(start - start.max()), (len(chains), k)).copy()
    b = np.ones((len(chains), k))
    for j in range(int(nseg.max())):
        live = np.flatnonzero(nseg > j)
        at = seg0[:-1][live] + j
        before[at] = a[live]
        x = np.einsum("nk,nkl->nl", a[live], m[at])
        a[live] = x / x.sum(1, keepdims=True)
        at = seg0[1:][live] - 1 - j
        after[at] = b[live]
        x = np.einsum("nkl,nl->nk", m[at], b[live])
        b[live] = x / x.sum(1, keepdims=True)
    alpha, beta = np.empty((s, SEGMENT, k)), np.empty((s, SEGMENT, k))
    a = before
    for t in range(SEGMENT):
        step = a @ tr
        if t == 0:
            step[head] = a[head]
        step *= e[:, t]
        step /= step.sum(1, keepdims=True)
        a = np.where(on[:, t, None], step, a)
        alpha[:, t] = a
    b = after
    for t in range(SEGMENT - 1, -1, -1):
        beta[:, t] = b
        step = (b * e[:, t]) @ tr.T
        step /= step.sum(1, keepdims=True)
        b = np.where(on[:, t, None], step, b)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    out = np.zeros_like(emit)
    out[where[on]] = post[on]
    moves = None
    if pairs:
        prev = np.empty_like(alpha)
        prev[:, 1:], prev[:, 0] = alpha[:, :-1], before
        x = prev[..., :, None] * tr * (e * beta)[..., None, :]
        x /= x.sum((2, 3), keepdims=True)
        use = on.copy()
        use[head, 0] = False
        moves = x[use].sum(0)
    return out, moves


def _words(texts: list[str]):
    """(bytes, start, end, hash of each word, first word of each text), hashed a block at a time."""
    col = pa.array(texts, pa.large_string())
    raw, off = tk.buffers(col)
    base, n = int(off[0]) if len(off) else 0, 0
    starts, ends, hashes, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(1, np.int64)]
    for _, _, part, o in tk.blocks(col):
        s, e, f = tk.word_spans(part, o)
        starts.append(s + base)
        ends.append(e + base)
        hashes.append(tk.span_hashes(part, s, e) if len(s) else np.zeros(0, U))
        first.append(f[1:] + n)
        base, n = base + len(part), n + len(s)
    return raw, *(np.concatenate(x) for x in (starts, ends, hashes, first))


def train(rows: list[tuple[str, str]], seed: int = 5, epochs: int = 3, rate: float = 0.4, sequence: int = 48) -> Crf | None:
    """Fits a CRF on (text, label) rows by stochastic gradient (AdaGrad)."""
    labels = sorted({y for _, y in rows})
    if not labels:
        return None
    k = len(labels)
    bits = max(10, int(np.log2(TABLE // k)))
    raw, starts, ends, hashes, first = _words([x for x, _ in rows])
    y_doc = np.array([labels.index(y) for _, y in rows])
    # features are held once per distinct word, and the words as their numbers
    hashes, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    feats, ff = word_features(raw, starts[at], ends[at], hashes, bits)
    feats, word = feats.astype(np.int32), word.astype(np.int32)
    del raw, starts, ends, hashes, at
    fn = np.diff(np.append(ff, len(feats)))
    y = np.repeat(y_doc, np.diff(first))
    rng = np.random.default_rng(seed)
    # pieces of 4 to 24 words
    cuts = []
    for d in range(len(rows)):
        i = first[d]
        while i < first[d + 1]:
            j = min(first[d + 1], i + int(rng.integers(4, 25)))
            cuts.append((i, j))
            i = j
    model = Crf(labels, bits, np.zeros((1 << bits, k), np.float32), np.zeros((k, k)), np.zeros(k))
    gw, gt, gs = np.full((1 << bits, k), 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
    for _ in range(epochs):
        order, at = rng.permutation(len(cuts)), 0
        while at < len(order):
            chosen, border = [], [0]
            while at < len(order) and len(border) <= 64:  # 64 sequences a step
                n = 0
                for _ in range(int(rng.integers(1, 4))):
                    if at < len(order) and n < sequence:
                        i, j = cuts[order[at]]
                        chosen.append(np.arange(i, j))
                        n += j - i
                        at += 1
                border.append(border[-1] + n)
            w = np.concatenate(chosen)
            n = fn[word[w]]
            f0 = np.append(0, np.cumsum(n))[:-1]
            f = feats[np.repeat(ff[word[w]] - f0, n) + np.arange(n.sum())]
            border = np.array(border)
            post, moves = forward_backward(model.emissions(f, f0), border, model.trans, model.start, True)
            grad = -post
            grad[np.arange(len(w)), y[w]] += 1
            steps = np.zeros((k, k))
            inner = np.setdiff1d(np.arange(len(w)), border[:-1])
            np.add.at(steps, (y[w][inner - 1], y[w][inner]), 1)
            seqs = len(border) - 1
            ds = grad[border[:-1][np.diff(border) > 0]].sum(0) / seqs
            dt = (steps - moves) / seqs
            dw = np.repeat(grad / np.sqrt(n)[:, None], n, axis=0).astype(np.float32)
            u, inv = np.unique(f, return_inverse=True)
            g = np.zeros((len(u), k), np.float32)
            np.add.at(g, inv, dw)
            gw[u] += g * g
            model.weights[u] += rate * g / np.sqrt(gw[u])
            gt += dt * dt
            gs += ds * ds
            model.trans += rate * 0.25 * dt / np.sqrt(gt)
            model.start += rate * 0.25 * ds / np.sqrt(gs)
    return model


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, remainder: int, sample_rows: int) -> list[tuple[str, str]]:
    """About ``sample_rows`` distinct (text, label) rows outside the held-out split, as many of each label."""
    rows = docs.where(~in_split(quoted(id_col), modulus, remainder)).select(quoted(id_col).cast("string").alias("i"), quoted(lang_col).cast("string").alias("y"), quoted(text_col).cast("string").alias("x")).where("y is not null and x is not null")
    labels = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()  # one row a label
    if len(labels) > MOST_LABELS:
        raise ValueError(f"column {lang_col} has more than {MOST_LABELS} labels")
    if not labels:
        return []
    each = sample_rows / len(labels)
    share = F.create_map(*[z for r in sorted(labels, key=lambda r: r["y"]) for z in (F.lit(r["y"]), F.lit(min(1.0, each / r["n"])))])
    dice = F.pmod(F.xxhash64(F.lit("language"), "i", "x"), F.lit(1 << 30)) / F.lit(1 << 30)
    got = rows.where(dice < F.element_at(share, F.col("y"))).distinct().collect()  # about sample_rows
    return [(r["x"], r["y"]) for r in sorted(got, key=lambda r: (r["y"], r["i"] or "", r["x"]))]


OUT = T.StructType([T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sure", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("lang", T.StringType())])))])


def _labelled(batches: Iterator[pa.RecordBatch], model: Crf | None, spans: bool) -> Iterator[pa.RecordBatch]:
    span_type = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])
    names = ["doc_id", "held_out", "lang_pred", "score", "sure", "spans"]
    for b in batches:
        for i, j, raw, off in tk.blocks(b.column(3), 1 << 19):
            n = j - i
            letter = b.column(2).slice(i, n).to_numpy(zero_copy_only=False)
            starts, ends, first = tk.word_spans(raw, off)
            pred, score, sure = np.full(n, -1), np.zeros(n), np.zeros(n)
            runs = [[] for _ in range(n)]
            if model is not None and len(starts):
                h = tk.span_hashes(raw, starts, ends)
                u, at, inv = np.unique(h, return_index=True, return_inverse=True)
                emit = model.emissions(*word_features(raw, starts[at], ends[at], u, model.bits))[inv]
                post = model.posteriors(emit, first)
                alpha = np.append(0, np.cumsum(_ALPHA[raw]))
                w = (alpha[ends] > alpha[starts]).astype(np.float64)
                row = np.repeat(np.arange(n), np.diff(first))
                total = np.stack([np.bincount(row, post[:, c] * w, n) for c in range(post.shape[1])], 1)
                weight = np.bincount(row, w, n)
                pred = np.where(weight > 0, total.argmax(1), -1)
                score = np.where(weight > 0, total.max(1) / np.maximum(weight, 1), 0.0).clip(0, 1)
                sure = (np.bincount(row, post.max(1) * w, n) / np.maximum(weight, 1)).clip(0, 1)
                if spans:
                    best = post.argmax(1)
                    new = np.ones(len(best), bool)
                    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
                    cut = np.flatnonzero(new)
                    for c, e in zip(cut, np.append(cut[1:], len(best)), strict=True):
                        runs[row[c]].append({"first_word": int(c - first[row[c]]), "n_words": int(e - c), "lang": model.labels[best[c]]})
            ok = letter & (pred >= 0)
            names_of = np.array([*(model.labels if model else []), "und"], object)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(names_of[np.where(ok, pred, -1)].tolist(), pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, sure, 0.0)), pa.array(runs if spans else [None] * n, pa.list_(span_type))], names)


def detect_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, remainder: int = 1, sample_rows: int = SAMPLE_ROWS, spans: bool = False, model: Crf | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, sure, spans, th.

    sure: the mean over words with letters of each word's largest posterior.
    spans (with ``spans``): runs of words with one most likely label.
    th: hash of the text, to join the row back.  Pass a ``model`` to predict
    without training.
    """
    ship(docs.sparkSession)
    if model is None:
        model = train(training_sample(docs, id_col, text_col, lang_col, modulus, remainder, sample_rows))
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("th")).alias("key"), in_split(quoted(id_col), modulus, remainder).alias("held_out"), text.rlike(r"\p{L}").alias("letter"), text.alias("text"))
    out = rows.mapInArrow(partial(_labelled, model=model, spans=spans), T.StructType([T.StructField("doc_id", rows.schema["key"].dataType), *OUT.fields]))
    return out.select("doc_id.doc_id", *OUT.names, "doc_id.th")


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5, languages: list[str] | None = None, **kw) -> DataFrame:
    """The rows of ``docs`` whose words are told with at least ``min_score`` in
    the mean, be they of one language or more (and whose main one is one of
    ``languages``), with all their columns."""
    told = (F.col("lang_pred") != "und") & (F.col("sure") >= min_score)
    if languages is not None:
        told = told & F.col("lang_pred").isin(languages)
    gone = detect_language(docs, id_col, text_col, **kw).where(~told).select("doc_id", "th")
    with arrow_bytes(docs.sparkSession, ARROW_BYTES):  # the detection runs inside
        return without(docs, gone, id_col, text_col)
