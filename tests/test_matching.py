import random

import numpy as np
import pytest

from sievewright.functions.udtf import register_array, register_udtf
from sievewright.operators.baseline import find_standard
from sievewright.operators.bloom import BloomFilter, GramGate, beginnings
from sievewright.operators.lines import from_position, split_lines
from sievewright.operators.match import count_rollup, gate_of, match_all, match_any, match_counts, with_actions
from sievewright.operators.shards import default_shards
from sievewright.patterns import PatternSet
from sievewright.plans.graph import dfa_graph, graphviz, nfa_graph
from sievewright.plans.router import explain_route
from sievewright.sources.text import from_strings
from tests.simulator import matches


def got(df):
    return {(r["doc_id"], r["pattern"], r["start_pos"], r["end_pos"]) for r in df.collect()}


def want(patterns, texts):
    return {(i, p, s, e) for i, t in enumerate(texts) for p in patterns for s, e in matches(p, t)}


def fuzz(seed, n_patterns, n_texts):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    shapes = [lambda a, b: a, lambda a, b: a + ".*" + b, lambda a, b: a + b, lambda a, b: a + "|" + b, lambda a, b: a + "[a-z]+" + b, lambda a, b: a + "." + b, lambda a, b: a + "*" + b, lambda a, b: a + "?[^" + b + "]"]
    patterns = list(dict.fromkeys(rng.choice(shapes)(word(), word()) for _ in range(n_patterns)))
    texts = [rng.choice([" ", "\n"]).join("there" if rng.random() < 0.1 else word() for _ in range(rng.randint(1, 60))) for _ in range(n_texts)]
    return patterns, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_ways_agree(spark, seed):
    patterns, texts = fuzz(seed, 28, 6)
    ps, df = PatternSet.of(patterns), from_strings(spark, texts)
    expected = want(patterns, texts)
    assert got(match_all(df, ps)) == expected
    assert got(match_all(df, ps, strategy="dfa", prefilter=False)) == expected
    assert got(match_all(df, ps, shards=3)) == expected


def test_fixed_texts_as_join(spark):
    patterns = ["ab", "abab", "b a|c", "é", "ba", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"]
    texts = ["abababab" * 20, "é ab aé", "", "a" * 300 + "b", "b a" * 50]
    ps, df = PatternSet.of(patterns), from_strings(spark, texts)
    j = match_all(df, ps, strategy="join")
    assert got(j) == want(patterns, texts) == got(match_all(df, ps, strategy="dfa"))
    assert j.count() == len(got(j))
    assert "Arrow" not in j._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="join"):
        match_all(df, PatternSet.of(["a+"]), strategy="join")


def test_prefilter_is_sound(spark):
    # (ab)*c matches c alone, so ab is not a necessary text
    texts = ["c", "abc", "x", "ababc"]
    df = from_strings(spark, texts)
    for p in ["ab*c", "ab?c", "foo[a-z]+c|c", "[a-b]c"]:
        ps = PatternSet.of([p])
        assert got(match_all(df, ps)) == want([p], texts)


def test_counts_and_friends(spark):
    texts = ["aaa b.c", None, "", "b.c b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ps = PatternSet.of(["aa", "b", "q"])
    n = {r["pattern"]: r["n"] for r in match_counts(df, ps).collect()}
    assert n == {"aa": 2, "b": 3, "q": 0}
    assert {r["pattern"]: r["n"] for r in match_counts(df, ps, strategy="dfa").collect()} == n
    m = match_all(df, ps, keys=["doc_id"])
    assert {(r["pattern"], r["n"]) for r in count_rollup(m).collect()} == {("aa", 2), ("b", 3), (None, 5)}
    assert sorted(r["doc_id"] for r in match_any(df, ps, keys=["doc_id"]).collect()) == [0, 3]
    assert {r["matched_text"] for r in match_all(df, ps, keys=["doc_id"], matched_text=True).collect()} == {"aa", "b"}
    acts = with_actions(m, ps.add("b", "other"))
    assert sum(r["pattern"] == "b" for r in acts.collect()) == 6
    assert match_all(df, PatternSet(), keys=["doc_id"]).count() == 0
    assert [default_shards(c) for c in (1, 2, 3, 8)] == [1, 1, 4, 12]
    assert explain_route(PatternSet.of(["ab", "a+"]), "auto") == [("ab", "dfa"), ("a+", "dfa")]


def test_standard_engine_differs(spark):
    df = from_strings(spark, ["aaa abd"])
    s = {(r["pattern"], r["start_pos"], r["end_pos"]) for r in find_standard(df, ["a+", "a|abc"]).collect()}
    assert ("a+", 0, 2) in s and ("a+", 1, 2) not in s and ("a|abc", 4, 4) in s


def test_lines_and_seek(spark):
    df = from_strings(spark, ["x\n\ny\n", "", "z"])
    assert sorted((r["doc_id"], r["line_no"], r["line"]) for r in split_lines(df).collect()) == [(0, 0, "x"), (0, 1, ""), (0, 2, "y"), (2, 0, "z")]
    assert [r["text"] for r in from_position(df, 0).orderBy("doc_id").collect()] == ["\n\ny\n", "", ""]


def test_sql_functions(spark):
    ps = PatternSet.of(["ab", "b+"])
    register_udtf(spark, ps, "t_match")
    register_array(spark, ps, "t_array")
    from_strings(spark, ["abb", "x"]).createOrReplaceTempView("t_docs")
    a = {tuple(r) for r in spark.sql("select doc_id, pattern, start_pos, end_pos from t_docs, lateral t_match(text)").collect()}
    b = {tuple(r) for r in spark.sql("select doc_id, m.pattern, m.start_pos, m.end_pos from (select doc_id, explode(t_array(text)) as m from t_docs)").collect()}
    assert a == b == want(["ab", "b+"], ["abb", "x"])


def test_graphs(spark):
    nodes, edges = dfa_graph(spark, PatternSet.of(["x[^a]"]))
    assert {(r["src"], r["dst"], r["label"]) for r in edges.collect()} == {(0, 1, "x"), (1, -2, "a"), (1, 2, "U+0000-`,b-U+10FFFF")}
    n, e = nfa_graph(spark, PatternSet.of(["a|b+"]))
    assert n.where("accept").count() == 2 and e.count() == 3
    lines = [r["line"] for r in graphviz(nodes, edges).orderBy("line_no").collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}"


def test_rows_are_told_apart_without_keys(spark):
    """Repeated and null keys: a row with a match comes back, as often as it is there, and no other."""
    rows = [(1, "the a"), (1, "nothing"), (None, "the b"), (1, "the a"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    ps = PatternSet.of(["the", "no"])
    got_ = [tuple(r) for r in match_any(df, PatternSet.of(["the"])).collect()]
    assert sorted(got_, key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
    m = match_all(df, ps, keys=["doc_id"], matched_text=True)
    assert sorted((str(r["doc_id"]), r["matched_text"], r["start_pos"]) for r in m.collect()) == [("1", "no", 0), ("1", "the", 0), ("1", "the", 0), ("None", "the", 0)]
    j = match_all(df, ps, keys=["doc_id"], matched_text=True, strategy="join")
    assert sorted(map(str, j.select(m.columns).collect())) == sorted(map(str, m.collect()))
    assert match_any(df.limit(0), ps).columns == df.columns


def test_bloom_filter():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 5000).astype(np.uint64)
    f = BloomFilter.of(items)
    assert f.might_contain(items).all()
    assert f.might_contain(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.1
    assert not BloomFilter.of(items[:0]).might_contain(items).any()


@pytest.mark.parametrize("seed", [3, 4])
def test_gate_changes_nothing(spark, seed):
    patterns, texts = fuzz(seed, 60, 8)
    ps, df = PatternSet.of(patterns), from_strings(spark, [*texts, "", "é" * 5, "abab"])
    assert GramGate.of(PatternSet.of(["ab*", "x"]).parsed) is None and gate_of(ps, [0]) is None
    fixed = PatternSet.of([p for p in patterns if beginnings(PatternSet.of([p]).parsed[0])] + ["é", "ab", "éé|b"])
    assert len(fixed) > 20 and gate_of(fixed, list(range(len(fixed))), "on") is not None
    for s in (ps, fixed):
        assert got(match_all(df, s, bloom="on", prefilter=False)) == got(match_all(df, s, bloom="off", prefilter=False))
    n = {r["pattern"]: r["n"] for r in match_counts(df, fixed, bloom="on").collect()}
    assert n == {r["pattern"]: r["n"] for r in match_counts(df, fixed, bloom="off").collect()} and sum(n.values()) == match_all(df, fixed).count()
    assert sorted(map(str, match_any(df, fixed, bloom="on").collect())) == sorted(map(str, match_any(df, fixed, bloom="off").collect()))


def test_gate_of_many_patterns(spark):
    many = PatternSet.of([f"w{i}x" for i in range(5000)])
    assert gate_of(many, list(range(5000))) is not None and gate_of(many, list(range(4999))) is None
    assert gate_of(many.add("[a-z]+"), list(range(5001))) is None  # one pattern may begin anywhere
    df = from_strings(spark, ["w12x w4999x w5000x", "ww7xx", None])
    assert {(r["doc_id"], r["pattern"]) for r in match_all(df, many).collect()} == {(0, "w12x"), (0, "w4999x"), (1, "w7x")}
