"""Literals found from their rarest gram."""

import pytest
from pyspark.sql import functions as F

from sievewright.operators.anchors import WIDTH, anchor_hits, anchored_matches, anchors, gram_sketch, merged
from sievewright.sources.text import from_strings

TEXTS = ["the quick zebra the the", "thethethe", "", "ab", "the zeb" * 200, "é😀é the é😀é", "x" * 600 + "zebra" + "x" * 600]
WORDS = ["the", "zebra", "ab", "a", "é😀é", "the the", "xxxx", "nothing", "brax", "x" * 40 + "z"]


def want():
    out = []
    for i, t in enumerate(TEXTS):
        for k, w in enumerate(WORDS):
            out += [(i, k, s, s + len(w) - 1) for s in range(len(t) - len(w) + 1) if t.startswith(w, s)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [4, 64, 512])
@pytest.mark.parametrize("width", [1, WIDTH])
def test_all_places_whatever_the_sketch_says(spark, chunk, width):
    """Also where every gram shares one cell, and where pieces are shorter than the literals."""
    got = anchored_matches(from_strings(spark, TEXTS), list(enumerate(WORDS)), chunk=chunk, width=width)
    assert sorted(tuple(r) for r in got.collect()) == want()


def test_sketches_add_up(spark):
    d = from_strings(spark, TEXTS)
    halves = merged(gram_sketch(d.where("doc_id < 3")), gram_sketch(d.where("doc_id >= 3")))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, gram_sketch(d).collect()))
    a = {r["literal"]: (r["gram"], r["offset"], r["estimate"]) for r in anchors(spark.createDataFrame(list(enumerate(WORDS)), "pattern_id int, literal string"), halves).collect()}
    assert a["zebra"][1] in (1, 2) and a["the"][0] == "the" and a["nothing"][2] == 0 and "ab" not in a


def test_fewer_hits_than_by_beginnings(spark):
    d = from_strings(spark, TEXTS)
    got = {r["literal"]: (r["first_hits"], r["anchor_hits"]) for r in anchor_hits(d, list(enumerate(WORDS)), gram_sketch(d)).collect()}
    assert got["zebra"] == (202, 2) and got["the the"][1] < got["the the"][0] and all(b <= a for a, b in got.values())


def test_null_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, None), (None, "zebra"), (None, "zebra")], "id long, text string")
    assert anchored_matches(d, [(0, "zebra")]).count() == 2
    assert anchored_matches(d, []).count() == 0 and anchored_matches(d.where(F.lit(False)), [(0, "zebra")]).count() == 0
