"""The registered queries of the matching engine, with DuckDB SQL for each that
SQL can express.  All run over whole tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.functions import charclass as cc
from sievewright.functions.udtf import register_array, register_udtf
from sievewright.operators import anchors, compare, gram_index, lines, prefilter, stats
from sievewright.operators.baseline import count_standard, find_standard
from sievewright.operators.match import count_rollup, is_single, match_all, match_any, match_counts, with_actions
from sievewright.patterns import PatternSet, try_parse
from sievewright.plans.graph import dfa_graph, graphviz, live_sets, nfa_graph
from sievewright.sources import sinks, text
from sievewright.sources.scratch import scratch_path, written
from sievewright.sources.text import load_patterns, load_patterns_clean
from sievewright.streaming.stream import chunk_texts, match_chunks, match_stream, run_to_table
from sievewright.streaming.timed import match_chunks_timed, run_timed_to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = ["the", "tion", "und", "que", "les", "license"]
CHUNK = 64


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- SQL for matches ----------------------------------------------------------


def _places(table_: str, keys: str, text: str, width: int) -> str:
    """CTE ``o``: (keys, start_pos, rest) with the text from each place on, up to ``width``."""
    return f"""
w as (select {keys}, c0, substr({text}, (c0 + 1)::int, {CHUNK + width}) as win
      from (select {keys}, {text}, unnest(range(0, length({text}), {CHUNK})) as c0 from {table_} where length({text}) > 0)),
o as (select {keys}, (c0 + i)::int as start_pos, substr(win, (i + 1)::int, {width}) as rest from w, range({CHUNK}) r(i) where i < length(win))"""


def literal_sql(words: list[str], table_: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """CTE ``m``: matches of fixed texts."""
    values = ", ".join(f"({i}, {q(x)})" for i, x in enumerate(words))
    return f"""{_places(table_, keys, text, max(map(len, words)))},
p as (select * from (values {values}) t(pattern_id, pattern)),
m as (select {keys}, pattern_id::int as pattern_id, pattern, start_pos, (start_pos + length(pattern) - 1)::int as end_pos from o join p on starts_with(rest, pattern))"""


def run_sql(pattern: str, viable: str, full: str, table_: str = "documents", keys: str = "doc_id", text: str = "text", width: int = 160) -> str:
    """CTE ``m``: run on while ``viable`` fits, keep if what was run over fits ``full``."""
    return f"""{_places(table_, keys, text, width)},
v as (select {keys}, start_pos, regexp_extract(rest, {q('^(?s:' + viable + ')')}) as run from o),
m as (select {keys}, 0 as pattern_id, {q(pattern)} as pattern, start_pos, (start_pos + length(run) - 1)::int as end_pos from v
      where length(run) > 0 and regexp_full_match(run, {q('(?s:' + full + ')')}))"""


ALL = "doc_id, pattern_id, pattern, start_pos, end_pos"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def on_documents(pattern: str, viable: str, full: str, name: str) -> None:
    """Registers a query that matches one pattern in all documents."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match_all(documents(spark, sf_dir), PatternSet.of([pattern]), keys=["doc_id"])

    QUERIES[name] = f
    ORACLES[name] = f"with {run_sql(pattern, viable, full)} select {ALL} from m"


# ---- fixed texts ---------------------------------------------------------------


@query(f"with {literal_sql(WORDS)} select {ALL} from m")
def literal_matches(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(WORDS), keys=["doc_id"])


@query(f"with {literal_sql(WORDS)} select {ALL} from m")
def literal_join(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(WORDS), keys=["doc_id"], strategy="join")


@query(f"with {literal_sql(WORDS)} select pattern, count(m.pattern_id)::bigint as n from p left join m using (pattern) group by pattern")
def literal_match_counts(spark, sf_dir):
    return match_counts(documents(spark, sf_dir), PatternSet.of(WORDS))


@query(f"with {literal_sql(WORDS)} select pattern, count(*)::bigint as n from m group by rollup(pattern)")
def literal_rollup(spark, sf_dir):
    return count_rollup(match_all(documents(spark, sf_dir), PatternSet.of(WORDS), keys=["doc_id"]))


@query(f"with {literal_sql(['den', 'laden', 'll', 'en'])} select {ALL} from m")
def overlap_patterns(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(["den", "laden", "ll", "en"]), keys=["doc_id"])


@query(f"with {literal_sql(['the'])} select {ALL} from m")
def remove_pattern(spark, sf_dir):
    ps = PatternSet.of(["tion", "the"]).remove("tion")
    return match_all(documents(spark, sf_dir), ps, keys=["doc_id"])


@query(f"with {literal_sql(['the'])} select {ALL}, unnest(['match', 'second']) as action from m")
def duplicate_pattern(spark, sf_dir):
    ps = PatternSet.of(["the", "the"]).add("the").add("the", "second")
    return with_actions(match_all(documents(spark, sf_dir), ps, keys=["doc_id"]), ps)


@query(f"with {literal_sql(WORDS)} select {ALL} from m")
def sharded_match(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(WORDS), keys=["doc_id"], shards=3, strategy="dfa")


@query(f"with {literal_sql(['the', 'license'])} select doc_id, pattern, start_pos, end_pos, substr(text, start_pos + 1, end_pos - start_pos + 1) as matched_text from m join documents using (doc_id)")
def matched_text(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(["the", "license"]), keys=["doc_id"], matched_text=True).drop("pattern_id")


@query("select doc_id from documents where contains(text, 'license') or contains(text, 'stupid')")
def match_any_rows(spark, sf_dir):
    return match_any(documents(spark, sf_dir), PatternSet.of(["license", "stupid"]), keys=["doc_id"])


@query(f"with {literal_sql(WORDS)} select {ALL} from m")
def table_function(spark, sf_dir):
    register_udtf(spark, PatternSet.of(WORDS), "multi_match")
    documents(spark, sf_dir).createOrReplaceTempView("multi_match_documents")
    return spark.sql("select doc_id, pattern_id, pattern, start_pos, end_pos from multi_match_documents, lateral multi_match(text)")


@query(f"with {literal_sql(WORDS)} select doc_id, count(m.pattern_id)::bigint as n from documents left join m using (doc_id) group by doc_id")
def array_function(spark, sf_dir):
    register_array(spark, PatternSet.of(WORDS), "multi_match_array")
    documents(spark, sf_dir).createOrReplaceTempView("multi_match_documents")
    return spark.sql("select doc_id, cast(size(multi_match_array(text)) as bigint) as n from multi_match_documents")


_MANY = "select distinct p_name as pattern from part union select distinct p_brand from part union select distinct unnest(string_split(lower(p_name), ' ')) from part"


@query(
    f"""with pats as ({_MANY}),
{_places('documents', 'doc_id', 'text', 40)}
select pattern, count(*)::bigint as n from o join pats on starts_with(rest, pattern) group by pattern"""
)
def many_literals(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("pattern")).union(p.select("p_brand")).union(p.select(F.explode(F.split(F.lower("p_name"), " "))))
    ps = PatternSet.from_df(names)
    return match_all(documents(spark, sf_dir), ps, keys=["doc_id"]).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


_PIECES = r"select distinct unnest(regexp_split_to_array(text, '[|\\.^$?*+\[]')) as pattern from benchmark"


@query(
    f"""with pats as (select pattern from ({_PIECES}) where length(pattern) >= 20),
{_places('documents', 'doc_id', 'text', 400)}
select doc_id, count(distinct pattern)::bigint as n from o join pats on starts_with(rest, pattern) group by doc_id"""
)
def benchmark_contamination(spark, sf_dir):
    """How many of the benchmark's long fixed pieces each document holds."""
    b = table(spark, sf_dir, "benchmark")
    pieces = b.select(F.explode(F.split("text", r"[|\\.^$?*+\[]")).alias("pattern")).where(F.length("pattern") >= 20)
    m = match_all(documents(spark, sf_dir), PatternSet.from_df(pieces), keys=["doc_id"])
    return m.groupBy("doc_id").agg(F.countDistinct("pattern").alias("n"))


# ---- the language ----------------------------------------------------------------

_LANGUAGE = {
    "overlap_self": ("e+", "e+", "e+"),
    "alternation_simple": ("the|and|qu", "the|and|qu|th|an|t|a|q", "the|and|qu"),
    "alternation_prefix_trap": ("a|and", "and|an|a", "a|and"),
    "alternation_empty": ("|on", "on|o", "on"),
    "literal_run_plus": ("th+", "(?:th)*t?", "(?:th)+"),
    "literal_run_opt": ("ed?s", "eds|ed|e|s", "(?:ed)?s"),
    "literal_run_star": ("th*e", "(?:th)*(?:t|e)?", "(?:th)*e"),
    "stacked_quantifiers": ("an?+", "(?:an)*a?", "(?:an)+"),
    "charset": ("[aeiou]n", "[aeiou]n?", "[aeiou]n"),
    "charset_range": ("[a-f]+", "[a-f]+", "[a-f]+"),
    "charset_mixed": ("[0-9+()-]+", "[0-9+()]+", "[0-9+()]+"),
    "any_char": ("t.e", "t(?:.e?)?", "t.e"),
    "literal_parens": ("1 (", r"1(?: \(?)?", r"1 \("),
    "negated_first": ("[^t]he", ".(?:he?)?", ".he"),
    "negated_inner": ("e[^aeiou ]s", "e(?:[^aeiou ]s?)?", "e[^aeiou ]s"),
    "class_plus_between": ("th[a-z]+ed", "th[a-z]*|t", "th[a-z]+ed"),
    "digits_dashes": ("[0-9]+-[0-9]+", "[0-9]+(?:-[0-9]*)?", "[0-9]+-[0-9]+"),
}
for _name, _args in _LANGUAGE.items():
    on_documents(*_args, _name)


def _language_counts(spark, sf_dir, **kw) -> DataFrame:
    d, ps = table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), PatternSet.of(p for p, _, _ in _LANGUAGE.values())
    return match_all(d, ps, keys=["conv_id", "turn"], **kw).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("places"))


_LANGUAGE_SQL = " union all ".join(f"(with {run_sql(*args, 'conversations', 'conv_id, turn', 'text')} select pattern, count(*)::bigint as n, sum(end_pos - start_pos)::bigint as places from m group by pattern)" for args in _LANGUAGE.values())


@query(_LANGUAGE_SQL)
def native_language(spark, sf_dir):
    """All patterns of the language queries at once, as expressions of the JVM."""
    return _language_counts(spark, sf_dir, strategy="native")


@query(_LANGUAGE_SQL)
def kernel_language(spark, sf_dir):
    """The same in the automaton kernel, its patterns in three tables."""
    return _language_counts(spark, sf_dir, strategy="dfa", shards=3)


@query(
    """with w as (select conv_id, turn, text, unnest(range(1, length(text) - 1)) as p from conversations where length(text) >= 3)
select conv_id, turn, 0 as pattern_id, 'the.*' as pattern, (p - 1)::int as start_pos, (length(text) - 1)::int as end_pos from w where substr(text, p::int, 3) = 'the'"""
)
def dotstar_tail(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return match_all(d, PatternSet.of(["the.*"]), keys=["conv_id", "turn"])


@query(
    """with w as (select conv_id, turn, text, unnest(range(1, length(text) - 1)) as p from conversations where length(text) >= 3)
select conv_id, turn, 0 as pattern_id, 'the.*[.]' as pattern, (p - 1)::int as start_pos, (length(text) - 1)::int as end_pos from w
where substr(text, p::int, 3) = 'the' and ends_with(text, '.') and p + 3 <= length(text)"""
)
def dotstar_suffix(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return match_all(d, PatternSet.of(["the.*[.]"]), keys=["conv_id", "turn"])


@query(f"with {run_sql('view|click|up', 'view|click|up|vie|vi|v|clic|cli|cl|c|u', 'view|click|up', 'events', 'event_id', 'event_type', 16)} select event_id, pattern, start_pos, end_pos from m")
def event_type_scan(spark, sf_dir):
    d = table(spark, sf_dir, "events", "event_id", "event_type")
    return match_all(d, PatternSet.of(["view|click|up"]), "event_type", ["event_id"], strategy="native").select("event_id", "pattern", "start_pos", "end_pos")


@query(f"with {run_sql('[0-9]+', '[0-9]+', '[0-9]+', 'events', 'event_id', 'props', 32)} select event_id, pattern, start_pos, end_pos from m")
def props_scan(spark, sf_dir):
    d = table(spark, sf_dir, "events", "event_id", "props")
    return match_all(d, PatternSet.of(["[0-9]+"]), "props", ["event_id"], strategy="native").select("event_id", "pattern", "start_pos", "end_pos")


@query(f"with {literal_sql(['https://', 'example.com', 'utm_source'], 'pages', 'page_id', 'url')} select page_id, pattern, start_pos, end_pos from m")
def url_scan(spark, sf_dir):
    d = table(spark, sf_dir, "pages", "page_id", "url")
    return match_all(d, PatternSet.of(["https://", "example.com", "utm_source"]), "url", ["page_id"]).select("page_id", "pattern", "start_pos", "end_pos")


@query(f"with {run_sql('<[a-z]+>', '<(?:[a-z]+>?)?', '<[a-z]+>', 'pages', 'page_id', 'html', 40)} select page_id, pattern, start_pos, end_pos from m")
def html_tag_scan(spark, sf_dir):
    d = table(spark, sf_dir, "pages", "page_id", "html")
    return match_all(d, PatternSet.of(["<[a-z]+>"]), "html", ["page_id"], strategy="native").select("page_id", "pattern", "start_pos", "end_pos")


# ---- prefilters and indexes --------------------------------------------------------


@query(f"with {literal_sql(['foo', 'the'])} select doc_id, pattern_id, (end_pos + 1)::int as end_index_exclusive, 3 as literal_length, 0 as literal_offset_in_match, start_pos from m")
def candidates(spark, sf_dir):
    hints = [prefilter.extract_hint(0, "foo[a-z]+"), prefilter.extract_hint(1, "the.+")]
    return prefilter.candidates(documents(spark, sf_dir), hints, "text", ["doc_id"])


@query(f"with {literal_sql(['th', 'the', 'tion'])} select doc_id, start_pos, string_agg(pattern_id::varchar, ',' order by pattern_id) as patterns from m group by doc_id, start_pos")
def candidate_positions(spark, sf_dir):
    hints = [prefilter.extract_hint(i, p) for i, p in enumerate(["th.e", "the[a-z]", "tion"])]
    c = prefilter.candidates(documents(spark, sf_dir), hints, "text", ["doc_id"])
    return prefilter.candidate_positions(c, ["doc_id"]).select("doc_id", "start_pos", F.array_join("pattern_ids", ",").alias("patterns"))


@query("select doc_id from documents where length(text) >= 8 and contains(text, 'license')")
def necessary_literal_filter(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.where(prefilter.row_filter(PatternSet.of(["license[a-z]*.", "(ab)?x*license[,. ]"]), F.col("text"))).select("doc_id")


@query("select p_partkey, p_name, greatest(1, length(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')))::int as min_length from part")
def min_length_filter(spark, sf_dir):
    return prefilter.min_length_index(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_name")


@query(
    """select first_char, string_agg(id::varchar, ',' order by id) as pattern_ids from (
  select distinct unnest([substr(p_brand, 1, 1), lower(substr(p_brand, 1, 1)), substr(p_name, 1, 1)]) as first_char, p_partkey as id from part) group by first_char"""
)
def first_char_index(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.col("p_brand").alias("t")).union(p.select("p_partkey", "p_name"))
    return prefilter.first_char_index(rows, "t", "p_partkey").select("first_char", F.array_join("pattern_ids", ",").alias("pattern_ids"))


@query(
    f"""with g as (select distinct substr(lower(p), i::int, 3) as gram from (select p, unnest(range(1, length(p) - 1)) as i from (values ('General'), ('license')) t(p))),
{_places('conversations', 'conv_id, turn', 'text', 3)}
select conv_id, turn, start_pos from o join g on lower(rest) = gram"""
)
def ngram_semi(spark, sf_dir):
    pats = PatternSet.of(["General", "license"]).to_df(spark)
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return prefilter.ngram_semi_join(d, pats, "text", ["conv_id", "turn"])


_NAMES = "select distinct unnest(string_split(p_name, ' ') || [p_type]) as literal from part"


def _names(spark, sf_dir) -> list[tuple[int, str]]:
    """Words and types of the parts, from four characters on, in order."""
    p = table(spark, sf_dir, "part").select(F.explode(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("x")).distinct()
    return list(enumerate(sorted(r[0] for r in PatternSet.from_df(p.where(F.length("x") >= 4), "x").to_df(spark).select("pattern").collect())))


@query(
    f"""with l as (select literal from ({_NAMES}) where length(literal) >= 4),
{_places('documents', 'doc_id', 'text', 40)}
select doc_id, literal, start_pos, (start_pos + length(literal) - 1)::int as end_pos from o join l on starts_with(rest, literal)"""
)
def anchored_literals(spark, sf_dir):
    """Every place of the parts' words, found from each one's rarest gram in the documents."""
    names = _names(spark, sf_dir)
    m = anchors.anchored_matches(documents(spark, sf_dir), names)
    return m.join(spark.createDataFrame(names, "pattern_id int, literal string"), "pattern_id").drop("pattern_id")


@query(
    f"""with l as (select literal from ({_NAMES}) where length(literal) >= 4),
{_places('documents', 'doc_id', 'text', 3)},
g as materialized (select rest as gram, count(*)::bigint as n from o where length(rest) = 3 group by rest),
c as (select literal, i, substr(literal, (i + 1)::int, 3) as gram from (select literal, unnest(range(0, length(literal) - 2)) as i from l))
select literal, coalesce(max(n) filter (where i = 0), 0)::bigint as first_hits, min(coalesce(n, 0))::bigint as anchor_hits from c left join g using (gram) group by literal"""
)
def anchor_hits(spark, sf_dir):
    """Places met by each literal's first gram and by its anchor, from a sketch of two halves added up."""
    d = documents(spark, sf_dir)
    halves = [anchors.gram_sketch(d.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    return anchors.anchor_hits(d, _names(spark, sf_dir), anchors.merged(*halves)).drop("pattern_id")


@query(f"with {literal_sql(['foo', 'the'])} select doc_id, pattern_id, (end_pos + 1)::int as end_index_exclusive, 3 as literal_length, 0 as literal_offset_in_match, start_pos from m")
def anchored_candidates(spark, sf_dir):
    d, hints = documents(spark, sf_dir), [prefilter.extract_hint(0, "foo[a-z]+"), prefilter.extract_hint(1, "the.+")]
    return prefilter.candidates(d, hints, "text", ["doc_id"], anchors.gram_sketch(d))


def _index(spark, sf_dir, name: str):
    return gram_index.build_index(documents(spark, sf_dir), scratch_path(spark, name), block_rows=8)


@query(
    f"""with a as (with {literal_sql(['license'])} select doc_id, pattern, start_pos, end_pos from m),
b as (with {run_sql('[QX][a-z]+d', '[QX][a-z]*', '[QX][a-z]+d')} select doc_id, pattern, start_pos, end_pos from m)
select * from a union all select * from b"""
)
def indexed_match(spark, sf_dir):
    """Matches by way of the gram index: only candidate blocks are read."""
    return gram_index.indexed_match(_index(spark, sf_dir, "gram-index"), PatternSet.of(["license", "[QX][a-z]+d"]), ["doc_id"]).drop("pattern_id")


@query(
    f"""with {_places('documents', 'doc_id', 'text', 3)},
g as (select distinct doc_id, substr(rest, 1, k) as gram from o, (values (1), (2), (3)) t(k) where length(rest) >= k)
select gram, count(*)::bigint as n from g group by gram"""
)
def gram_documents(spark, sf_dir):
    """How many documents have each gram, from the postings of an index of one document a block."""
    i = gram_index.build_index(documents(spark, sf_dir), scratch_path(spark, "gram-documents"), block_rows=1)
    return i.table("postings").groupBy("gram").agg(F.sum(F.size("blocks")).alias("n"))


def _score_sql(x: str) -> str:
    n = lambda cls: f"(length({x}) - length(regexp_replace({x}, '{cls}', '', 'g')))"
    punct = r"[!@#$%^&*()_+\-=\[\]{}|;'':,.<>?/~`]"
    v, a, d, p = n("[aeiouAEIOU]"), n("[a-zA-Z]"), n("[0-9]"), n(punct)
    return f"(length({x}) * 10.0::double + {v} + 2 * ({a} - {v}) + 5 * {d} + 10 * {p} + 3 * (length({x}) - {a} - {d} - {p})) * case when contains({q(prefilter.COMMON_WORDS)}, lower({x})) then 0.5::double else 1.0::double end"


@query(f"with l as (select distinct unnest(string_split(p_name, ' ') || [p_brand, p_type, substr(p_name, 1, 3)]) as literal from part) select literal, {_score_sql('literal')} as score from l")
def hint_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lit = p.select(F.explode(F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", F.substring("p_name", 1, 3)))).alias("literal")).distinct()
    return lit.withColumn("score", prefilter.selectivity_column(F.col("literal")))


# ---- the standard engine, and comparing ----------------------------------------------

STANDARD = ["th[a-z]+", "a|abc", "[0-9]+", "(?:an)+"]


@query(" union all ".join(f"select {q(p)} as pattern, sum(len(regexp_extract_all(text, {q(p)})))::bigint as n from documents" for p in STANDARD))
def standard_counts(spark, sf_dir):
    return count_standard(documents(spark, sf_dir), STANDARD)


def _standard_sql(p: str) -> str:
    """Places of standard matches: the pieces between them, whose lengths and those of the matches add up."""
    return f"""select doc_id, {q(p)} as pattern, (sum(length(gap) + length(x)) over (partition by doc_id order by i) - length(x))::int as start_pos, (sum(length(gap) + length(x)) over (partition by doc_id order by i) - 1)::int as end_pos
from (select doc_id, unnest(regexp_extract_all(text, {q('(?s)' + p)})) as x, unnest(string_split_regex(text, {q('(?s)' + p)})[:len(regexp_extract_all(text, {q('(?s)' + p)}))]) as gap, generate_subscripts(regexp_extract_all(text, {q('(?s)' + p)}), 1) as i from documents)"""


@query(" union all ".join(_standard_sql(p) for p in STANDARD))
def standard_find(spark, sf_dir):
    return find_standard(documents(spark, sf_dir), STANDARD, keys=["doc_id"]).drop("pattern_id")


A, B = ["the", "ing", "tion"], ["the", "on", "io"]
_AB = f"""with {literal_sql(sorted(set(A + B))).replace(" as (select", " as materialized (select")},
a as materialized (select doc_id, start_pos, pattern, end_pos from m where pattern in ({', '.join(map(q, A))})),
b as materialized (select doc_id, start_pos, pattern, end_pos from m where pattern in ({', '.join(map(q, B))}))"""


def _ab(spark, sf_dir):
    d = documents(spark, sf_dir)
    return match_all(d, PatternSet.of(A), keys=["doc_id"], strategy="join"), match_all(d, PatternSet.of(B), keys=["doc_id"], strategy="dfa")


@query(_AB + " select * from a intersect select * from b")
def compare_intersect(spark, sf_dir):
    return compare.intersection(*_ab(spark, sf_dir), ["doc_id"])


@query(_AB + " select *, 'a' as side from (select * from a except select * from b) union all select *, 'b' as side from (select * from b except select * from a)")
def compare_symdiff(spark, sf_dir):
    return compare.symmetric_difference(*_ab(spark, sf_dir), ["doc_id"])


@query(
    _AB
    + """, x as (select doc_id, pattern as a_pattern, start_pos as a_start, end_pos as a_end, unnest(range(start_pos // 256, end_pos // 256 + 1)) as bucket from (select * from a except select * from b)),
y as (select doc_id, pattern as b_pattern, start_pos as b_start, end_pos as b_end, unnest(range(start_pos // 256, end_pos // 256 + 1)) as bucket from b)
select doc_id, a_pattern, a_start, a_end, b_pattern, b_start, b_end,
  b_start >= a_start and b_end <= a_end as a_contains_b, a_start between b_start and b_end as a_start_in_b, a_end between b_start and b_end as a_end_in_b,
  a_start >= b_start and a_end <= b_end as b_contains_a, b_start between a_start and a_end as b_start_in_a, b_end between a_start and a_end as b_end_in_a
from x join y using (doc_id, bucket) where a_start <= b_end and b_start <= a_end and bucket = greatest(a_start, b_start) // 256"""
)
def compare_overlap_class(spark, sf_dir):
    return compare.overlap_classes(*_ab(spark, sf_dir), ["doc_id"])


_LONG = f"""with {literal_sql(['the', 'tion', 'en'], 'conversations', 'conv_id, turn').replace(" as (select", " as materialized (select")},
a as materialized (select conv_id, turn, pattern || '.*' as pattern, start_pos, (length(text) - 1)::int as end_pos from m join conversations using (conv_id, turn) where pattern in ('the', 'tion')),
b as materialized (select conv_id, turn, pattern, start_pos, end_pos from m where pattern = 'en' union all select conv_id, turn, pattern, start_pos, end_pos from a where pattern = 'tion.*')"""


def _long(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    m = lambda *p: match_all(d, PatternSet.of(p), keys=["conv_id", "turn"]).drop("pattern_id")
    return m("the.*", "tion.*"), m("en", "tion.*")


@query(
    _LONG
    + """, x as (select * from a except select * from b)
select x.conv_id, x.turn, x.pattern as a_pattern, count(*)::bigint as pairs, count(*) filter (where b.start_pos >= x.start_pos and b.end_pos <= x.end_pos)::bigint as a_contains_b, count(*) filter (where b.start_pos <= x.start_pos)::bigint as a_start_in_b
from x join b on x.conv_id = b.conv_id and x.turn = b.turn and x.start_pos <= b.end_pos and b.start_pos <= x.end_pos group by all"""
)
def compare_overlap_long(spark, sf_dir):
    """Overlaps where matches go on to the end of their text."""
    j = compare.overlap_classes(*_long(spark, sf_dir), ["conv_id", "turn"])
    n = lambda c: F.sum(F.col(c).cast("long"))
    return j.groupBy("conv_id", "turn", "a_pattern").agg(F.count(F.lit(1)).alias("pairs"), n("a_contains_b").alias("a_contains_b"), n("a_start_in_b").alias("a_start_in_b"))


@query(
    _LONG
    + """ select a.conv_id, a.turn, a.pattern, a.start_pos, a.end_pos, count(*) filter (where b.start_pos <= a.end_pos and a.start_pos <= b.end_pos)::bigint as n_overlaps,
  count(*) filter (where b.start_pos between a.start_pos and a.end_pos)::bigint as n_b_start_in_a, count(*) filter (where b.end_pos between a.start_pos and a.end_pos)::bigint as n_b_end_in_a,
  count(*) filter (where a.start_pos between b.start_pos and b.end_pos)::bigint as n_a_start_in_b, count(*) filter (where a.end_pos between b.start_pos and b.end_pos)::bigint as n_a_end_in_b
from a left join b on a.conv_id = b.conv_id and a.turn = b.turn group by all"""
)
def overlap_counts(spark, sf_dir):
    """How many overlap each long match, by a sweep."""
    return compare.overlap_counts(*_long(spark, sf_dir), ["conv_id", "turn"])


@query(
    _AB
    + """, c as (select (select count(*) from (select * from a intersect select * from b)) as same, (select count(*) from a) as na, (select count(*) from b) as nb)
select 1700000000::bigint as "timestamp", 'series' as "testSeriesId", 'query' as metadata, 'join' as "matcherTypeName1", 512::bigint as "usedMemoryInMb1", 1500::bigint as "durationInMillis1",
  'dfa' as "matcherTypeName2", 256::bigint as "usedMemoryInMb2", 1000::bigint as "durationInMillis2", same::int as "noOfMatches", (na + nb - 2 * same)::int as "noOfMismatches",
  4 as "noOfRegexps", 1000 as "corpusLength", 1.5::float as "2to1Ratio" from c"""
)
def pair_summary(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    run = lambda e, m, t: {"engine": e, "mem_mb": m, "duration_ms": t}
    return compare.pair_summary(a, b, ["doc_id"], 4, 1000, run("join", 512, 1500), run("dfa", 256, 1000), "series", "query", 1700000000)


_RUNS = run_sql("[a-f]+", "[a-f]+", "[a-f]+")


@query(f"with {_RUNS} select doc_id, pattern_id, pattern, start_pos, end_pos from m qualify row_number() over (partition by doc_id, pattern order by start_pos - end_pos, start_pos) = 1")
def dominating_match(spark, sf_dir):
    return compare.dominating(match_all(documents(spark, sf_dir), PatternSet.of(["[a-f]+"]), keys=["doc_id"]), ["doc_id"])


@query(f"with {_RUNS} select doc_id, pattern_id, pattern, min(start_pos) as start_pos, end_pos from m group by doc_id, pattern_id, pattern, end_pos")
def undominated_matches(spark, sf_dir):
    return compare.undominated(match_all(documents(spark, sf_dir), PatternSet.of(["[a-f]+"]), keys=["doc_id"]), ["doc_id"])


@query(f"with {_RUNS} select count(*)::bigint as n from m where start_pos = end_pos")
def single_character_matches(spark, sf_dir):
    m = match_all(documents(spark, sf_dir), PatternSet.of(["[a-f]+"]), keys=["doc_id"])
    return m.where(is_single()).agg(F.count(F.lit(1)).alias("n"))


# ---- lines, lists, characters -----------------------------------------------------------

_LINES = "l as (select doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as line, (generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) - 1)::int as line_no from documents where length(text) > 0)"


@query(f"with {_LINES} select doc_id, line_no, line from l")
def line_split(spark, sf_dir):
    return lines.split_lines(documents(spark, sf_dir), keys=["doc_id"])


@query(f"with {_LINES}, {literal_sql(['the', 'license'], 'l', 'doc_id, line_no', 'line')} select doc_id, line_no, pattern, start_pos, end_pos from m")
def line_matches(spark, sf_dir):
    return lines.match_lines(documents(spark, sf_dir), PatternSet.of(["the", "license"]), keys=["doc_id"]).drop("pattern_id")


@query(f"with {literal_sql(['the'])} select doc_id, start_pos, end_pos from m where start_pos >= 101")
def seek_then_match(spark, sf_dir):
    d = lines.from_position(documents(spark, sf_dir), 100)
    m = match_all(d, PatternSet.of(["the"]), keys=["doc_id", "__offset"])
    return m.select("doc_id", (F.col("start_pos") + F.col("__offset")).alias("start_pos"), (F.col("end_pos") + F.col("__offset")).alias("end_pos"))


@query("select row_number() over (order by p_partkey) - 1 as pattern_no, p_name as pattern from part order by p_partkey limit 100")
def pattern_load_limit(spark, sf_dir):
    """The first patterns of a list in files, read by ranges of bytes and numbered in order."""
    path = scratch_path(spark, "pattern-list")
    table(spark, sf_dir, "part").repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey").select("p_name").write.text(path)
    return load_patterns(text.read_lines_in_order(spark, path), 100)


@query("select p_name as pattern, sha1(p_name) as sha1 from (select distinct p_name from part where length(trim(p_name)) > 0) order by 2 limit 39")
def pattern_load_sha1(spark, sf_dir):
    return load_patterns_clean(table(spark, sf_dir, "part"), 40, one_less=True, column="p_name")


@query(
    """select lang, count(*)::bigint as docs, sum(case when not regexp_matches(text, '[^\\x00-\\x7F]') then 1 else 0 end)::bigint as all_ascii,
  sum(case when regexp_matches(text, '[^\\x00-\\x7F]') then length(regexp_extract(text, '^[\\x00-\\x7F]*')) else length(text) end)::bigint as first_non_ascii,
  sum(case when regexp_matches(substr(text, 1, 1), '^\\p{L}$') then 1 else 0 end)::bigint as letters, sum(case when regexp_matches(substr(text, 1, 1), '^\\p{Nd}$') then 1 else 0 end)::bigint as digits,
  sum(case when regexp_matches(substr(text, 1, 1), '^[\\p{L}\\p{Nd}_]$') then 1 else 0 end)::bigint as words, sum(case when regexp_matches(substr(text, 1, 1), '^[\\x09-\\x0D\\x1C-\\x20]$') then 1 else 0 end)::bigint as spaces
from documents group by lang"""
)
def ascii_profile(spark, sf_dir):
    c = F.substring("text", 1, 1)
    n = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), n(cc.is_all_ascii(F.col("text"))).alias("all_ascii"), F.sum(cc.first_non_ascii(F.col("text"))).cast("long").alias("first_non_ascii"), n(cc.is_letter(c)).alias("letters"), n(cc.is_digit(c)).alias("digits"), n(cc.is_word(c)).alias("words"), n(cc.is_whitespace(c)).alias("spaces"))


@query("select doc_id, sha1(text) as sha1 from documents")
def text_sha1(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", cc.sha1_hex(F.col("text")).alias("sha1"))


@query(
    """select p_partkey, case when regexp_matches(t, '[,"'']') then '"' || replace(t, '"', '""') || '"' else t end as escaped
from (select p_partkey, p_name || case when p_partkey % 3 = 0 then ', "x"' when p_partkey % 3 = 1 then chr(10) || 'y' else '' end as t0, replace(t0, chr(10), ' ') as t from part)"""
)
def csv_escape(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ', "x"').when(F.col("p_partkey") % 3 == 1, "\ny").otherwise(""))
    return p.select("p_partkey", cc.csv_escape(t).alias("escaped"))


# ---- statistics ----------------------------------------------------------------------------


def _runs(spark, sf_dir):
    """Events as runs: value as milliseconds, the part of the id as memory; even ids are the base's."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("engine"), F.col("value").alias("duration_ms"), (F.col("user_id") % 50 + 10).cast("double").alias("mem_mb"), (F.col("event_id") % 2 == 0).alias("base"))


_STATS = """s as (select engine, base, avg(duration_ms) as time_mean, stddev_pop(duration_ms) as time_std, avg(mem_mb) as memory_mean, stddev_pop(mem_mb) as memory_std, count(*)::bigint as n_runs
from (select event_type as engine, event_id % 2 = 0 as base, "value" as duration_ms, (user_id % 50 + 10)::double as mem_mb from events) group by engine, base)"""


@query(f"with {_STATS} select engine, base, round(time_mean, 6) as time_mean, round(time_std, 6) as time_std, round(memory_mean, 6) as memory_mean, round(memory_std, 6) as memory_std, n_runs from s")
def run_stats(spark, sf_dir):
    s = stats.run_stats(_runs(spark, sf_dir), ["engine", "base"])
    return s.select("engine", "base", *[F.round(c, 6).alias(c) for c in ("time_mean", "time_std", "memory_mean", "memory_std")], "n_runs")


@query(
    f"""with {_STATS}, j as (select c.engine, c.n_runs, (b.time_mean - c.time_mean) / b.time_mean as tg, (b.memory_mean - c.memory_mean) / b.memory_mean as mg,
  c.time_std / c.time_mean < 0.2 and b.time_std / b.time_mean < 0.2 as significant from s c join s b on c.engine = b.engine and not c.base and b.base)
select engine, n_runs, round(tg, 6) as time_gain, round(mg, 6) as memory_gain, significant,
  case when n_runs < 3 then 'FAIL' when tg < -0.02 or mg < -0.02 then case when significant then 'FAIL' else 'WARNING' end
  when tg >= 0.05 or mg >= 0.03 then 'PASS' when not significant then 'WARNING' else 'PASS' end as status from j"""
)
def run_status(spark, sf_dir):
    r = _runs(spark, sf_dir)
    s = stats.evaluate(stats.run_stats(r.where("not base"), ["engine"]), stats.run_stats(r.where("base"), ["engine"]), ["engine"])
    return s.select("engine", "n_runs", F.round("time_gain", 6).alias("time_gain"), F.round("memory_gain", 6).alias("memory_gain"), "significant", "status")


@query(
    """with t as (select event_type as engine, sum(event_id)::double / 1048576.0 / (sum("value") / 1000.0) as mb from events group by event_type)
select a.engine as engine, round(a.mb / b.mb, 6) as ratio, case when a.mb / b.mb > 2.0 then 'excellent' when a.mb / b.mb > 1.0 then 'good' when a.mb / b.mb > 0.8 then 'comparable' else 'slower' end as band
from t a, t b where b.engine = 'click'"""
)
def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("engine")).agg(F.sum("event_id").alias("bytes"), F.sum("value").alias("duration_ms"))
    t = stats.throughput(e).withColumn("k", F.lit(1))
    base = t.where("engine = 'click'").select("k", "mb_per_s")
    return stats.throughput_ratio(t, base, ["k"]).select("engine", F.round("ratio", 6).alias("ratio"), "band")


@query("select event_type as engine, median(\"value\") as score from events group by event_type")
def cpu_score_median(spark, sf_dir):
    return stats.median_score(table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), "value"), ["engine"], "value")


# ---- gates, shards, counters --------------------------------------------------------------------


@query(f"with {literal_sql(WORDS)} select {ALL} from m")
def bloom_match(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(WORDS), keys=["doc_id"], bloom="on", prefilter=False)


@query(f"with {run_sql('th[a-z]+ed', 'th[a-z]*|t', 'th[a-z]+ed')} select {ALL} from m")
def bloom_open_pattern(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(["th[a-z]+ed"]), keys=["doc_id"], bloom="on")


@query(f"with {literal_sql(WORDS)} select {ALL} from m")
def factory_match(spark, sf_dir):
    return match_all(documents(spark, sf_dir), PatternSet.of(WORDS), keys=["doc_id"], shards="auto")


@query(f"with {literal_sql(['The', 'the', 'THE'])} select doc_id, 0 as pattern_id, (end_pos + 1)::int as end_index_exclusive, 3 as literal_length, 0 as literal_offset_in_match, start_pos from m")
def candidates_any_case(spark, sf_dir):
    return prefilter.candidates(documents(spark, sf_dir), [prefilter.extract_hint(0, "The", True)], "text", ["doc_id"])


HINTED = ["a(?:b|cd)e", "\\Qhttp://\\E[a-z]+\\.com", "foo[a-z]+bar", "abc|def", "^foo.*bar", ".*", "a", "^$", "test\\.com", "short|verylongpattern", "would[a-z]"]


@query(
    """select * from (values (0, 'cd', false, false), (1, 'http://', false, false), (2, 'bar', false, false), (3, 'abc', false, false), (4, 'foo', true, false),
  (8, 'test.com', false, false), (9, 'verylongpattern', false, false), (10, 'would', false, true)) t(pattern_id, literal, anchored_prefix, safe)"""
)
def hint_table(spark, sf_dir):
    return prefilter.hints_df(spark, HINTED).select("pattern_id", "literal", "anchored_prefix", "safe")


@query("select * from (values (1, 'http://'), (8, 'test.com'), (9, 'verylongpattern'), (10, 'would')) t(pattern_id, literal)")
def hint_options(spark, sf_dir):
    return prefilter.hints_df(spark, HINTED, prefilter.HintOptions(min_length=4, common_word_penalty=False)).select("pattern_id", "literal")


_NATIONS = literal_sql(["NATION_1", "_2", "1"], "nation", "n_nationkey", "n_name")


def nation_matches(spark, sf_dir, **kw):
    return match_all(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), PatternSet.of(["NATION_1", "_2", "1"]), "n_name", ["n_nationkey"], **kw)


@query(f"with {_NATIONS} select 'scans' as name, (select count(*) from nation)::bigint as n union all select 'matches', (select count(*) from m)")
def counters(spark, sf_dir):
    c = stats.ObjectCounters(spark)
    nation_matches(spark, sf_dir, prefilter=False, counters=c).write.format("noop").mode("overwrite").save()
    got = c.snapshot()
    if not got["dfa_states"] or not got["dfa_edges"]:
        raise RuntimeError("states were not counted")
    return spark.createDataFrame([(k, got[k]) for k in ("scans", "matches")], "name string, n long")


@query(f"with {_NATIONS} select engine, 3::bigint as n_runs, (select count(*) from m)::bigint as matches, 'PASS' as status, true as timed from (values ('dfa'), ('join')) t(engine)")
def engine_pair(spark, sf_dir):
    engines = {e: lambda e=e: nation_matches(spark, sf_dir, strategy=e) for e in ("dfa", "join")}
    got = stats.compare_engines(spark, engines)
    return got.select("engine", "n_runs", "matches", "status", (F.col("time_mean") > 0).alias("timed"))


@query(
    """select unnest(['corpus has ' || (select sum(strlen(n_name)) from nation) || ' bytes, 500000 are needed', '2 patterns, 10000 are needed', '2 runs, 3 are needed']) as problem"""
)
def input_problems(spark, sf_dir):
    got = stats.check_inputs(table(spark, sf_dir, "nation"), 2, "n_name", runs=2)
    return spark.createDataFrame([(x,) for x in got], "problem string")


@query(
    """with e as (select event_id, "value" as mean, nullif(user_id % 5, 0)::double as base_score, nullif(event_id % 4, 0)::double as score, event_id % 2 = 0 as same, case event_id % 3 when 0 then 'FAIL' when 1 then 'WARNING' else 'PASS' end as status from events)
select event_id, round(case when base_score is not null and score is not null then mean * base_score / score else mean end, 6) as mean,
  case when status = 'FAIL' and not same and (base_score is null or score is null) then 'WARNING' else status end as status from e"""
)
def cross_machine(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base, score = (F.nullif(F.col(c) % n, F.lit(0)).cast("double") for c, n in (("user_id", 5), ("event_id", 4)))
    verdict = F.element_at(F.array(F.lit("FAIL"), F.lit("WARNING"), F.lit("PASS")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", F.round(stats.normalised_mean(F.col("value"), base, score), 6).alias("mean"), stats.cross_machine_status(verdict, F.col("event_id") % 2 == 0, base.isNotNull() & score.isNotNull()).alias("status"))


@query(
    """with p as (select p_partkey, p_size as a0, p_size + p_partkey % 7 as a1, p_size + p_partkey % 3 - 1 as b0, p_size + 3 as b1 from part)
select p_partkey, case when a0 <= b0 and a1 >= b1 and not (b0 <= a0 and b1 >= a1) then -1 when b0 <= a0 and b1 >= a1 and not (a0 <= b0 and a1 >= b1) then 1 else 0 end as order_ from p"""
)
def domination_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select("p_partkey", compare.dominates(size, size + k % 7, size + k % 3 - 1, size + 3).alias("order_"))


@query(f"with {_NATIONS} select n_nationkey, pattern, start_pos, end_pos, row_number() over (order by n_nationkey, start_pos, pattern, end_pos)::int as place from m")
def ordered_matches(spark, sf_dir):
    m = compare.ordered(nation_matches(spark, sf_dir), ["n_nationkey"]).withColumn("at", F.monotonically_increasing_id())
    return m.select("n_nationkey", "pattern", "start_pos", "end_pos", F.row_number().over(Window.orderBy("at")).alias("place"))


@query(f"with {literal_sql(A)} select doc_id, start_pos, pattern, end_pos from m")
def distinct_of_engines(spark, sf_dir):
    d = documents(spark, sf_dir)
    both = match_all(d, PatternSet.of(A), keys=["doc_id"], strategy="join").unionByName(match_all(d, PatternSet.of(A), keys=["doc_id"]))
    return compare.distinct_matches(both, ["doc_id"]).select("doc_id", "start_pos", "pattern", "end_pos")


# ---- files in and out ----------------------------------------------------------------------------


def _nation_files(spark, sf_dir) -> str:
    """A text file a nation, with line breaks of another system."""
    path = scratch_path(spark, "nations")
    n = table(spark, sf_dir, "nation")
    n.select("n_nationkey", F.concat("n_name", F.lit("\r\nkey "), "n_nationkey").alias("value")).write.partitionBy("n_nationkey").text(path)
    return path


def _region_lines(spark, sf_dir) -> str:
    path = scratch_path(spark, "regions")
    table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    return path


@query("select n_nationkey, n_name || chr(10) || 'key ' || n_nationkey || chr(10) as text from nation")
def text_whole(spark, sf_dir):
    got = text.read_whole(spark, _nation_files(spark, sf_dir))
    return got.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "text")


@query("with l as (select unnest(string_split(coalesce(text, ''), chr(10))) as line from conversations) select line, count(*)::bigint as n from l group by line")
def text_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit(""))).write.text(path)
    return text.read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("select (row_number() over (order by r_regionkey) - 1)::int as place, r_name as line from region")
def pushed_lines(spark, sf_dir):
    seen = []
    text.push_lines(text.read_lines(spark, _region_lines(spark, sf_dir)), seen.append)
    return spark.createDataFrame(list(enumerate(seen)), "place int, line string")


@query("select r_name as line from region")
def resolved_path(spark, sf_dir):
    folder, _, name = _region_lines(spark, sf_dir).rpartition("/")
    return text.read_lines(spark, text.resolve(name, [folder + "/nowhere", folder], spark))


@query("select string_agg(n_name || chr(10) || 'key ' || n_nationkey || chr(10), '' order by n_nationkey desc) as text from nation")
def concatenated_files(spark, sf_dir):
    path = _nation_files(spark, sf_dir)
    keys = sorted((r[0] for r in table(spark, sf_dir, "nation", "n_nationkey").collect()), reverse=True)
    return text.concat_files(spark, [f"{path}/n_nationkey={k}" for k in keys])


@query("select event_type as engine, count(*)::bigint as mem_mb, count(distinct user_id)::bigint as duration_ms from events group by event_type")
def baseline_file(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)), F.countDistinct("user_id")).collect()  # one row an engine
    path = scratch_path(spark, "baseline")
    sinks.write_baseline(spark, [tuple(r) for r in rows], path, ["engine,mem_mb,duration_ms"])
    return text.read_baseline(spark, path)


@query("select true as has_os, true as has_cores, true as has_architecture")
def environment_row(spark, sf_dir):
    e = text.environment(spark)
    return e.select((F.length("os") > 0).alias("has_os"), (F.col("cores") > 0).alias("has_cores"), (F.length("architecture_id") > 0).alias("has_architecture"))


@query(f"with {_NATIONS} select pattern, count(*)::bigint as n from m group by pattern")
def callback_counts(spark, sf_dir):
    n: Counter = Counter()
    sinks.for_each_match(nation_matches(spark, sf_dir), lambda r: n.update([r["pattern"]]))
    return spark.createDataFrame(list(n.items()), "pattern string, n long")


@query(f"with {literal_sql(WORDS)} select count(*)::bigint as observed, count(*)::bigint as counted, true as told from m")
def counted_matches(spark, sf_dir):
    m = match_all(documents(spark, sf_dir), PatternSet.of(WORDS), keys=["doc_id"])
    df, o = sinks.counted(m, "counted_matches")
    df.write.format("noop").mode("overwrite").save()
    told = []
    n = sinks.count_with_progress(m, lambda n, speed: told.append((n, speed)), every=1)
    return spark.createDataFrame([(o.get["n"], n, bool(told) and told[-1][0] >= n)], "observed long, counted long, told boolean")


@query(f"""with {_NATIONS} select 'dfa' as engine, pattern as regex, start_pos as "start", end_pos as "end" from m""")
def logged_matches(spark, sf_dir):
    return sinks.log_matches(nation_matches(spark, sf_dir), "dfa")


@query(
    _AB
    + f""", c as (select (select count(*) from (select * from a intersect select * from b)) as same, (select count(*) from a) as na, (select count(*) from b) as nb)
select {q(','.join(sinks.SUMMARY_COLUMNS))} as line union all
select unnest(['1700000000', '1700000001']) || replace(',@a, @@b@@@,two lines,join,512,1500,dfa,256,1000,', '@', chr(34)) || same || ',' || (na + nb - 2 * same) || ',4,1000,1.5' from c"""
)
def summary_file(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    run = lambda e, m, t: {"engine": e, "mem_mb": m, "duration_ms": t}
    path = scratch_path(spark, "summary") + ".csv"
    # the two runs are compared once, and told twice
    summary = written(compare.pair_summary(a, b, ["doc_id"], 4, 1000, run("join", 512, 1500), run("dfa", 256, 1000), 'a, "b"', "two\nlines", 1700000000), "summary-row")
    for later in (0, 1):
        sinks.append_summary(summary.withColumn("timestamp", F.col("timestamp") + later), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""select unnest(['| r_regionkey | r_name |', '|---|---|']) as line union all select '| ' || r_regionkey || ' | ' || r_name || ' |' from region""")
def markdown_report(spark, sf_dir):
    got = sinks.write_report(table(spark, sf_dir, "region", "r_regionkey", "r_name"), scratch_path(spark, "report"))
    return spark.createDataFrame([(x,) for x in got.split("\n")], "line string")


# ---- streams, graphs, errors -----------------------------------------------------------------


def _as_stream(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


_CONV = literal_sql(["the", "tion"], "conversations", "conv_id, turn", "text")


@query(f"with {_CONV} select conv_id, turn, pattern, start_pos, end_pos from m")
def stream_rows(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    out = match_stream(_as_stream(d, "stream-rows"), PatternSet.of(["the", "tion"]), keys=["conv_id", "turn"])
    name = "stream_rows_out"
    return run_to_table(out, name).drop("pattern_id")


@query(
    """with d as (select conv_id || '-' || turn as doc_id, text from conversations),
"""
    + run_sql("th[a-z]+|[0-9]+", "th[a-z]*|t|[0-9]+", "th[a-z]+|[0-9]+", "d", "doc_id", "text").lstrip()
    + " select doc_id, pattern_id, start_pos, end_pos from m"
)
def stream_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    chunks = _as_stream(chunk_texts(d, 50), "stream-chunks")
    out = match_chunks(chunks, PatternSet.of(["th[a-z]+|[0-9]+"]))
    name = "stream_chunks_out"
    return run_to_table(out, name)


@query(
    """with c as (select conv_id || '-' || turn as doc_id, text, greatest(ceil(length(text) / 50.0), 1)::int as n, turn % 5 = 3 as cut from conversations),
d as (select doc_id, case when cut then substr(text, 1, 50 * (n - 1)) else text end as text from c),
"""
    + run_sql("th[a-z]+|[0-9]+", "th[a-z]*|t|[0-9]+", "th[a-z]+|[0-9]+", "d", "doc_id", "text").lstrip()
    + " select doc_id, pattern_id, start_pos, end_pos, null as told from m union all select doc_id, null, n - 1, null, 'missing' from c where cut and n > 1"
)
def stream_chunks_timed(spark, sf_dir):
    """Chunks with times, of which some texts' last ones never come: those are closed when their time is over."""
    d = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text", "turn")
    chunks = chunk_texts(d, 50).join(d.select("doc_id", "turn"), "doc_id").where("not (is_last and turn % 5 = 3)").drop("turn")
    far = spark.sql("select 'far' as doc_id, 0L as seq, 'x' as text, true as is_last, timestamp'2030-01-01' as time")
    stream = _as_stream(chunks.withColumn("time", F.lit("2024-01-01").cast("timestamp")).unionByName(far), "stream-chunks-timed")
    return run_timed_to_table(match_chunks_timed(stream, PatternSet.of(["th[a-z]+|[0-9]+"]), "1 hour"), "stream_chunks_timed_out")


@query(
    """select * from (values ('ab|ac', 0, 1, 'a'), ('ab|ac', 1, 2, 'b'), ('ab|ac', 1, 3, 'c'), ('x[0-9]+', 0, 1, 'x'), ('x[0-9]+', 1, 2, '0-9'), ('x[0-9]+', 2, 2, '0-9')) t(pattern, src, dst, label)"""
)
def automaton_graph(spark, sf_dir):
    return dfa_graph(spark, PatternSet.of(["ab|ac", "x[0-9]+"]))[1]


@query("select * from (values ('[a-b]c', 0, 1, 'a-b'), ('[a-b]c', 1, 2, 'c')) t(pattern, src, dst, label)")
def path_graph(spark, sf_dir):
    return nfa_graph(spark, PatternSet.of(["[a-b]c"]))[1]


@query("select * from (values ('', 0, 'ab|ac', false), ('', 1, 'a.c', false), ('', 2, 'x+', false), ('a', 0, 'ab|ac', false), ('a', 1, 'a.c', false), ('ab', 0, 'ab|ac', true), ('ab', 1, 'a.c', false), ('abc', 1, 'a.c', true), ('x', 2, 'x+', true)) t(prefix, pattern_id, pattern, accepts)")
def live_patterns(spark, sf_dir):
    return live_sets(spark, PatternSet.of(["ab|ac", "a.c", "x+"]), ["", "a", "ab", "abc", "x", "q"])


@query("""select unnest(['digraph patterns {', '  "ab#0" [shape=circle];', '  "ab#1" [shape=circle];', '  "ab#2" [shape=doublecircle];', '  "ab#0" -> "ab#1" [label="a"];', '  "ab#1" -> "ab#2" [label="b"];', '}']) as line""")
def graphviz_text(spark, sf_dir):
    return graphviz(*dfa_graph(spark, PatternSet.of(["ab"]))).select("line")


@query(
    """select * from (values ('\\d', 'PatternSyntaxError'), ('[z-a]', 'PatternSyntaxError'), ('?a', 'PatternSyntaxError'), ('^a', 'UnsupportedPattern'), ('[abc', null), ('a{2}', null)) t(pattern, error)"""
)
def pattern_errors(spark, sf_dir):
    rows = [(p, (try_parse(p)[1] or "").partition(":")[0] or None) for p in ("\\d", "[z-a]", "?a", "^a", "[abc", "a{2}")]
    return spark.createDataFrame(rows, "pattern string, error string")
