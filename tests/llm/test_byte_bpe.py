"""Byte-level BPE against tiktoken, by row."""

from __future__ import annotations

import base64
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm.byte_bpe import Vocabulary, decode, encode, merged, round_trip, split_words, stand_in
from sievewright.llm.packing import coded, squeeze, squeeze_words, unsqueeze, unsqueeze_words
from sievewright.llm.queries import QUERIES, documents
from tests.llm.test_operators import EDGE, docs
from tests.oracle import SF

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def wanted(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, encoding):
    if not os.path.exists(SF):
        pytest.skip("no test tables")
    want = sorted((r["doc_id"], *wanted(encoding, r["text"])) for r in documents(spark, SF).collect())
    assert sorted(tuple(r) for r in QUERIES["op12_byte_bpe"](spark, SF).collect()) == want


ODD = ["it's we'LL  don't\n\n x\t\ty ", "日本語 текст ١٢٣ ½ x²", "😀😀 a😀b", "<|endoftext|>", "\u0000\u0001", "   x", "á é", "x" * 5000, " " * 999 + "y", "՘࢏ ౜1", "ab" * 400 + "cd" * 300]


@pytest.mark.parametrize("block,words", [(16 << 20, 500_000), (40, 1)])
def test_edges_do_not_depend_on_blocks(spark, encoding, block, words):
    rows = EDGE + [(100 + i, t, "s") for i, t in enumerate(ODD)]
    got = round_trip(docs(spark, rows), Vocabulary(PATH), P.PATTERN, block=block, range_words=words).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, *wanted(encoding, t)) for i, t, _ in rows], key=key)


def test_empty_table(spark):
    got = round_trip(docs(spark, EDGE).where("doc_id = -1"), Vocabulary(PATH), P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0


def test_decode_keeps_columns_and_knows_its_bounds(spark):
    rows = [(1, [0, 50255], "x"), (2, [], "y"), (3, None, "z"), (4, [50256], "x"), (5, [-1], "x"), (6, [1, None], "x")]
    df = spark.createDataFrame(rows, "doc_id long, `a.b` array<int>, c0 string")
    got = {r["doc_id"]: (r["c0"], r["out"]) for r in decode(df, Vocabulary(PATH), "a.b", "out").collect()}
    by_id = {v: k for k, v in Vocabulary(PATH).ranks().items()}
    assert got[1] == ("x", by_id[0] + by_id[50255]) and got[2] == ("y", b"") and got[3] == ("z", None)
    assert all(got[i][1] is None for i in (4, 5, 6))


def test_a_common_word_is_encoded_once(spark):
    """A word in every block goes to one range: no row a position, and one part a block in it."""
    rows = [(i, "same words here " * 50, "s") for i in range(40)]
    got = encode(docs(spark, rows), Vocabulary(PATH), P.PATTERN, block=1)
    assert got.select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).distinct().count() == 1 and got.count() == 40


def test_merges_are_those_of_the_library(encoding):
    ranks, rng = Vocabulary(PATH).ranks(), random.Random(5)
    for n in (1, 2, 7, 30, 99, 101, 400):
        for _ in range(60):
            w = bytes(rng.choice(b"aeinrst th\xc3\xa9\xf0") for _ in range(n))
            assert merged(w, ranks) == encoding._encode_single_piece(w)
    assert merged(b"a" * 20_000, ranks) == encoding._encode_single_piece(b"a" * 20_000)


def test_classes_of_characters_are_those_of_the_library():
    """Every code point's place in the pattern, told by what it joins."""
    ranks = {bytes([b]): b for b in range(256)}
    for c in b"a1!":
        for b in range(256):
            ranks[bytes([c, b])] = len(ranks)
    probe = tiktoken.Encoding("probe2", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in [*range(0x80, 0x3000), *range(0xA000, 0xABFF), *range(0xF900, 0x12000), *range(0x1D000, 0x20000), *range(0x30000, 0x34000, 7)] if not 0xD800 <= c < 0xE000]
    for c in points:
        for first in "a1!":
            text = first + chr(c)
            assert (split_words([text], P.PATTERN)[1] == [1]) == (probe.encode_ordinary(text)[0] >= 256), hex(c)
    assert stand_in("é", P.PATTERN) == "é"


def test_packing():
    import pyarrow as pa

    for a in ([], [0], [1, 2, 3, 70_000], [1 << 40, 5]):
        assert unsqueeze(squeeze(np.array(a, np.int64))).tolist() == a
    for w in ([], [b""], [b"", b"a\x00", b"\xff" * 300]):
        assert unsqueeze_words(squeeze_words(w)) == w
    number, words, counts = coded(pa.array(["b", "a", "b"]))
    assert number.tolist() == [0, 1, 0] and words.to_pylist() == ["b", "a"] and counts.tolist() == [2, 1]
