import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import language_id as li
from sievewright.llm import tokens as tk
from sievewright.llm.lm_score import SMOOTHING
from sievewright.llm.queries import ORACLES, QUERIES, documents
from tests.llm import brute
from tests.llm.test_operators import fill
from tests.oracle import SF, same

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_near_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op5_near_dedup"](spark, SF).collect()}
    assert got == {i: (n, i if not n else c, (i if not n else c) == i) for (i, _), (n, c) in zip(rows, brute.near_groups(rows), strict=True)}


def word_features(model):
    def features(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        one = np.array([0]), np.array([len(raw)])
        return li.word_features(raw, *one, tk.span_hashes(raw, *one), model.bits)[0].tolist()

    return features


def trained(docs):
    return li.train(li.training_sample(docs, "doc_id", "text", "lang", 3, 1, li.SAMPLE_ROWS))


def test_language_query(spark):
    """Every row: its split, und without a letter, and the label and score of a plain forward-backward."""
    rows = documents(spark, SF).collect()
    got = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    model = trained(documents(spark, SF))
    features = word_features(model)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        label, score, _ = brute.language(model, features, r["text"])
        if not any(c.isalpha() for c in r["text"] or ""):
            label, score = "und", 0.0
        assert g["lang_pred"] == (label or "und") and g["score"] == pytest.approx(score, abs=1e-6)
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_lm_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in QUERIES["op6_lm_score"](spark, SF).collect()}
    want = brute.lm(rows, SMOOTHING)
    assert got == {i: (*w[:4], round(w[4], 4), round(w[5], 4)) for (i, _), w in zip(rows, want, strict=True)}
    held = [w for w in want if w[0]]
    assert sum(w[5] for w in held) > sum(w[4] for w in held)


@pytest.mark.parametrize("sf_dir", [SF, SF.replace("0.001", "0.1")])
def test_html_query(spark, sf_dir):
    """All pages against another parser and brute force over the hosts."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1), "html").collect()]
    got = {r["page_id"]: r for r in QUERIES["op9_html_text"](spark, sf_dir).collect()}
    want = brute.articles(rows)
    assert len(got) == len(rows) and {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in got.values())


def test_pipeline(spark):
    """Each stage's whole output against brute force on its own input, and the last one's is what run() gives."""
    import corpus_pipeline as cp

    docs = documents(spark, SF)
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]
    for name, stage in cp.STAGES:
        source = docs
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = cp.stash(stage(spark, docs, SF), "test-" + name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "line_dedup":
            assert all(after[i]["text"] == before[i]["text"] for i in after)
        if name == "language_id":
            model = trained(source)
            features = word_features(model)
            sure = {i: brute.language(model, features, r["text"]) for i, r in before.items()}
            want = {i for i, (label, _, s) in sure.items() if label and any(c.isalpha() for c in before[i]["text"]) and s >= cp.MIN_LANGUAGE_SCORE}
            assert set(after) == want
        elif name == "line_dedup":
            fold = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOW)
            count = {}
            for r in before.values():
                for k in {fold(x) for x in r["text"].split("\n")}:
                    count[k] = count.get(k, 0) + 1
            assert set(after) == set(before)
            for i, r in before.items():
                want = "\n".join(x for x in r["text"].split("\n") if not fold(x) or count[fold(x)] < 10)
                assert after[i]["text"] == want and after[i]["n_chars"] == (r["n_chars"] if want == r["text"] else len(want))
        elif name == "near_dedup":
            groups = brute.near_groups([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, (n, c) in zip(before, groups, strict=True) if not n or c == i}
        elif name == "decontaminate":
            assert set(after) == {i for i, r in before.items() if not brute.contaminated(r["text"], benchmark)}
        else:
            words = [(i, r["source"], len(brute.words(r["text"]))) for i, r in before.items()]
            sizes = {}
            for _, s, n in words:
                sizes[s] = sizes.get(s, 0) + n
            targets = fill(sizes)
            taken = brute.mix(words, {s: t + 1e-6 for s, t in targets.items()})
            assert {i: r["mix_taken"] for i, r in after.items()} == {i: n for i, n in taken.items() if n}
            assert all(r["mix_target"] == pytest.approx(targets[r["source"]]) for r in after.values())
            assert {(r["doc_id"], r["mix_taken"]) for r in cp.run(spark, SF).collect()} == {(i, r["mix_taken"]) for i, r in after.items()}
