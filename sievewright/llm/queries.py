"""The queries of this subpackage, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Vocabulary, round_trip
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language_id import detect_language
from .line_dedup import line_report
from .lm_score import lm_scores
from .mixing import mix_sources
from .near_dedup import near_dedup
from .phrases import collocations
from .url_filter import filter_urls
from .warc import archive_round_trip
from .whitening import whitened

#: The dated list of the URL query: key, action, date.
URL_LIST = (
    ("cheap-pills.example.com", "add", "2024-02-01"),
    ("cheap-pills.example.com", "remove", "2024-05-15"),
    ("cheap-pills.example.com", "add", "2024-09-01"),
    ("spam-farm.example.org", "add", "2023-06-01"),
    ("ads-track.example.com", "add", "2024-03-10"),
    ("ads-track.example.com", "remove", "2024-11-20"),
    ("tionsh.example.net/en", "add", "2024-04-01"),
    ("tionsh.example.net/en", "remove", "2024-08-01"),
    ("blog.tionsh.example.net", "add", "2024-01-15"),
    ("ththon.example.com/de", "add", "2024-07-04"),
    ("therha.example.com", "add", "2024-10-01"),
    ("never-listed.example.com", "remove", "2024-01-01"),
)
#: The pages carry no time of fetch; the query gives each one within 2024.
EPOCH_2024 = 1704067200


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{k}', '{a}', timestamp'{d} 00:00:00Z')" for k, a, d in URL_LIST)
    entries = spark.sql(f"select * from values {rows} as t(key, action, since)")
    captures = pages(spark, sf_dir).select("page_id", "url", F.timestamp_seconds(F.lit(EPOCH_2024) + F.pmod(F.col("page_id") * 37, F.lit(366)) * 86400 + F.pmod(F.col("page_id") * 7919, F.lit(86400))).alias("fetched_at"))
    out = filter_urls(captures, entries)
    return out.select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_at"), "blocked", "matched_key", F.unix_seconds("listed_since").alias("listed_since"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), weights=(1, 2, 3), max_epochs=3, share=1.0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir), min_docs=10, min_chars=1, batches=4)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), benchmark).select("doc_id", "contaminated", "n_items", F.array_join("items", ",").alias("items"), "best")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).drop("th")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), modulus=7, remainder=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(documents(spark, sf_dir), modulus=3, remainder=1).select("doc_id", "held_out", "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(pages(spark, sf_dir), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(pages(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), longest=5, min_count=100, cover_percent=100, top=2000)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP1 = """
with entries(key, action, since) as (values {rows}),
iv as (
  select key, action, since, coalesce(lead(since) over (partition by key order by since), 253402214400) as until from entries
),
cap as (
  select row_number() over () as rid, page_id,
    {epoch} + ((page_id * 37) % 366) * 86400 + (page_id * 7919) % 86400 as fetched_at,
    nullif(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '') as host,
    trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/([^?#]*)', 1), '/') as path
  from pages
),
hit as (
  select rid, arg_max(key, length(key)) as matched_key, arg_max(since, length(key)) as listed_since
  from cap join iv on action = 'add' and fetched_at >= since and fetched_at < until
    and (host = key or ends_with(host, '.' || key) or (contains(key, '/') and starts_with(host || '/' || path || '/', key || '/')))
  group by rid
)
select page_id, host, fetched_at, matched_key is not null as blocked, matched_key, listed_since
from cap left join hit using (rid)
"""

_OP2 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('20240229:' || doc_id::varchar), 1, 15))::bigint as key
  from documents
),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w, source_size * 3.0::double as cap from s),
r as (
  select *, cap / w as ratio,
    (sum(source_size) over ()::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level
  from w
),
t as (select source, source_size, least(cap, coalesce((select max(level) from r where level <= ratio) * w, cap)) as target from r),
p as (
  select d.*, t.source_size, t.target, floor(t.target)::bigint as budget,
    sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and current row)::bigint - size as ahead
  from d join t on d.source is not distinct from t.source
),
f as (select *, case when source_size > 0 then budget // source_size else 0 end as times from p)
select doc_id, source, size, source_size, target,
  (size * times + greatest(0, least(size, budget - times * source_size - ahead)))::bigint as taken
from f
"""

_OP3 = f"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select rid, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, true as common from k where length(key) >= 1 group by key having count(distinct rid) >= 10)
select doc_id, count(*)::bigint as n_lines, count(common)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where common is null), '')) as kept_sha256
from k left join c using (key) group by rid, doc_id
"""

# Brute force over all alignments, without seeds.
_OP4 = r"""
with d as (
  select row_number() over () as rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
),
b as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from benchmark),
dt as (select rid, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as pos from d),
bt as (select item_id, len(ws) as n, least(len(ws), 13) as wide, case when len(ws) >= 13 then 10 else len(ws) end as need, unnest(ws) as w, generate_subscripts(ws, 1) as pos from b),
m as (
  select rid, item_id, need, dt.pos - bt.pos as diagonal, bt.pos as ipos
  from dt join bt using (w)
  where least(dt.n - greatest(dt.pos - bt.pos, 0), bt.n - greatest(bt.pos - dt.pos, 0)) >= wide
),
c as (select rid, item_id, need, count(*) over (partition by rid, item_id, diagonal order by ipos range between current row and 12 following) as equal from m),
f as (select rid, item_id, max(equal) as best from c group by rid, item_id, need having max(equal) >= need),
g as (select rid, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id) as items, max(best)::bigint as best from f group by rid)
select doc_id, g.rid is not null as contaminated, coalesce(n_items, 0) as n_items, items, coalesce(best, 0) as best from d left join g using (rid)
"""

# Base32 of the 160-bit digest: four groups of 40 bits, eight digits each.
_OP8 = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, payload, sha1(payload) as hex, max(page_id) over (partition by payload) as top from p)
select page_id, octet_length(payload)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, ((i // 8) * 10 + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int, 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from h
"""

_OP10 = r"""
with d as (select row_number() over () as rid, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select *, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm)::bigint as group_size,
  row_number() over (partition by norm order by doc_id nulls last) as k from d)
select doc_id, keep_id, group_size, k = 1 as kept, sha256(norm) as text_sha256 from g
"""

_OP11 = r"""
with d as materialized (select row_number() over () as rid, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as materialized (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, ws, unnest([1, 2, 3, 4, 5]) as m from w),
h as (select lang, m, ws, unnest(range(1, len(ws) - m + 2)) as i from g where len(ws) >= m),
f as materialized (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase, count(*)::bigint as f from h group by all),
n as materialized (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
c as materialized (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m >= 2 and f >= 100),
k as (select *, unnest(range(1, m)) as k from c),
s as (
  select k.lang, k.phrase, k.a, k.k, x.f as l, y.f as r, n.n, ((1000::hugeint * k.a * n.n) // (x.f::hugeint * y.f))::bigint as score
  from k join f x on x.lang = k.lang and x.m = k.k and x.phrase = array_to_string(k.ws[:k.k], ' ')
    join f y on y.lang = k.lang and y.m = k.m - k.k and y.phrase = array_to_string(k.ws[k.k + 1:], ' ')
    join n on n.lang = k.lang
),
b as materialized (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, m, ws, a, unnest(range(2, m)) as size from c),
q as (select lang, a, array_to_string(ws[i:i + size - 1], ' ') as phrase from (select *, unnest(range(1, m - size + 2)) as i from o)),
z as materialized (select lang, phrase, max(a) as outer_f from q group by all),
e as (
  select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score
  from b left join z on z.lang = b.lang and z.phrase = b.phrase
  where coalesce(100 * outer_f < 100 * a, true)
)
select * from e where rank <= 2000
"""


def _op1_sql() -> str:
    from datetime import UTC, datetime

    stamp = lambda d: int(datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp())
    return _OP1.format(rows=", ".join(f"('{k}', '{a}', {stamp(d)}::bigint)" for k, a, d in URL_LIST), epoch=EPOCH_2024)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mix": op2_source_mix,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_dedup": op5_near_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_html_text": op9_html_text,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_phrases": op11_phrases,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op1_url_filter": _op1_sql(),
    "op2_source_mix": _OP2,
    "op3_line_dedup": _OP3,
    "op4_decontaminate": _OP4,
    "op8_warc": _OP8,
    "op10_exact_dedup": _OP10,
    "op11_phrases": _OP11,
}
