"""Phrase mining against plain counting, on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import phrases as ph
from sievewright.llm.phrases import collocations, frequent_phrases

KIND = "doc_id long, text string, lang string, rank int, phrase string, n long, `a.b` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 2, 3) for i, (t, g) in enumerate(rows)], KIND).repartition(3)


def plain(rows, longest=5, least=100, cover=100, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    out, outer = {}, Counter()
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                outer[lang, w[i : i + m]] = max(outer[lang, w[i : i + m]], a)
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang, w] = (a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
    got = []
    for lang in {x for x, _ in out}:
        own = [(-v[4], -v[0], " ".join(w).encode(), v) for (g, w), v in out.items() if g == lang and not (outer[g, w] and 100 * outer[g, w] >= cover * v[0])]
        got += [(lang, i + 1, p.decode(), *v) for i, (_, _, p, v) in enumerate(sorted(own)[:top])]
    return sorted(got)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "B", "ç", "d", "ee", "É", "x", "y", "zz"] + [f"r{i}" for i in range(30)]
    ends = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "; ", "!?"]
    return [("".join(rng.choice(words[: rng.choice((3, 6, 40))]) + rng.choice(ends) for _ in range(rng.randrange(120))), rng.choice(("en", "en", "de", None, "und"))) for _ in range(n)]


@pytest.mark.parametrize("seed,longest,least,cover,block", [(1, 5, 5, 100, 8 << 20), (2, 5, 3, 60, 300), (3, 3, 2, 100, 1), (4, 2, 4, 100, 1000)])
def test_like_plain_counting(spark, seed, longest, least, cover, block):
    rows = random_rows(seed) + [("the the the the the the", "en")] * 9 + [(None, "en"), ("", "en"), ("...", "fr"), ("one two", "fr")]
    got = collocations(table(spark, rows), longest=longest, min_count=least, cover_percent=cover, block=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, longest, least, cover)


def test_top_and_ties(spark):
    rows = [(f"p{i} q{i}. " * 3, "en") for i in range(40)] + [("p1 q1", "en")]
    got = collocations(table(spark, rows), min_count=3, top=7).collect()
    assert sorted(map(tuple, got)) == plain(rows, least=3, top=7)


def test_hot_pivots_and_repeated_rows(spark):
    """One row repeated, and one word that is most of the text: its fragments are dealt over parts."""
    rows = [("hot x hot y hot hot z", "en")] * 300 + random_rows(9, 10)
    assert sorted(map(tuple, collocations(table(spark, rows), min_count=5, block=200).collect())) == plain(rows, least=5)


def test_nothing_frequent(spark):
    for rows in ([], [(None, None)], [("a b c", "en")], [("a", "en")] * 200):
        assert collocations(table(spark, rows)).count() == 0


def test_frequent_words_are_ranked_densely(spark):
    words, grams, totals = frequent_phrases(table(spark, random_rows(5)), min_count=2)
    got = sorted((r["rank"], -r["f"]) for r in words.collect())
    assert [r for r, _ in got] == list(range(1, len(got) + 1)) and [f for _, f in got] == sorted(f for _, f in got)
    assert {r["lang"] for r in totals.collect()} == {"en", "de", "und"} and grams.count() > 0


def test_a_phrase_has_one_owner():
    """Each n-gram of a sequence is in the fragments of exactly one place, once."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        r = rng.integers(0, 5, 40)
        parts = list(ph._block_fragments(np.append(0, r), 4, np.ones(1, np.uint64), 3))
        keys, count, left, right = ph._unpacked([tuple(c[0].as_py() for c in p.columns[1:]) for p in parts], 4)
        got = Counter()
        for words, _, total in ph.grown(keys, count, left, right, 5, np.ones(len(keys), np.int64)):
            got.update({tuple(w): int(t) for w, t in zip(words.tolist(), total, strict=True)})
        want = Counter(tuple(r[i : i + m].tolist()) for m in range(2, 6) for i in range(len(r) - m + 1) if (r[i : i + m] > 0).all())
        assert got == want


def test_pieces():
    texts = ["Ab  cd\tE,f", "", "  ", "é.È x", ",a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    words, first = ph.split_pieces(raw, off)
    assert list(zip(words.to_pylist(), first.tolist(), strict=True)) == [("ab", True), ("cd", False), ("e", False), ("f", True), ("é", True), ("È", True), ("x", False), ("a", True)]
    assert ph.split_pieces(raw[:0], np.zeros(2, np.int64))[0].to_pylist() == []
