"""Line dedup over levelled sorted runs, with DataFrame operations only.

The store keeps, for each line key, in how many documents it was found, as
sorted runs of (128-bit line hash, documents).  Documents come in batches; a
batch adds one run at level 0, and ``fanout`` runs of a level are merged, two
and two, into one run of the next.  Runs are tables bucketed and sorted by the hash, with as many
buckets as shuffle partitions and one file a bucket, so Spark knows where a key
is and in what order: a merge is one full outer merge join of two scans, a
lookup one merge join, and neither shuffles nor sorts a run.

For a corpus, each new batch first merge-anti-joins the runs' settled keys -
those with at least ``min_docs`` documents in some run - and adds a run of its
other keys, so the hottest lines are counted a few times and never again.

Two ways to use it:

* ``add_corpus`` / ``drop_common_lines`` - a whole corpus in ``batches`` batches
  (by a hash of the id), one after the other; then lines found in at least
  ``min_docs`` documents go from every document.  All batches must be counted
  before the first line goes, as the tenth document may be in the last one.
* ``dedup_batch`` - the incremental way: lines that earlier batches have go
  from the batch by a merge anti-join with the runs, then its own run is added.

Line keys: the line stripped of space and U+0009..U+000D at both ends, A-Z in
lower case; keys shorter than ``min_chars`` code points are never dropped.

Defined cases: null or empty text is one empty line; a line repeated inside a
document counts once for it; repeated rows count as documents each; a document
that loses all lines keeps the empty text; empty table, empty result; columns
of any name are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, new_path, packed, partitions, quoted, session_conf, stash, text_or_empty, unpacked

KEY = ["h1", "h2"]
#: Keys that are broadcast when lines meet the runs; 100 bytes each.
HOT_KEYS = 20_000


def lines_of(text: Column) -> Column:
    """The text split at \\n; a limit of -1 keeps empty lines at the end."""
    return F.split(text, "\n", -1)


def folded(line: Column) -> Column:
    """(ascii, rest): equal for two stripped lines if and only if they are equal with A-Z in lower case.

    lower() also folds letters beyond A-Z, and translate() takes 100 ns a
    character.  So code points beyond ASCII are set apart: a line without any
    takes lower()'s ASCII path; else each becomes U+0001 in the first part
    (a real U+0001 is doubled) and all stand in the second.
    """
    plain = F.octet_length(line) == F.length(line)
    marked = F.regexp_replace(F.replace(line, F.lit("\x01"), F.lit("\x01\x02")), r"[^\x00-\x7F]", "\x01\x03")
    return F.struct(F.lower(F.when(plain, line).otherwise(marked)).alias("ascii"), F.when(~plain, F.regexp_replace(line, r"[\x00-\x7F]+", "")).alias("rest"))


def key_hash(fold: Column) -> Column:
    """128 bits of a line key, in two columns."""
    return F.struct(F.xxhash64(fold["ascii"], fold["rest"]).alias("h1"), F.xxhash64(F.lit(71), fold["rest"], fold["ascii"]).alias("h2"))


def hashes_of(lines: Column, min_chars: int) -> Column:
    """Array with a hash for each line, null for keys that are too short."""
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)))
    folds = F.transform(stripped, lambda x: F.when(F.length(x) >= min_chars, folded(x)))
    return F.transform(folds, lambda x: F.when(x.isNotNull(), key_hash(x)))


def distinct_keys(docs: DataFrame, lines: Column, min_chars: int, *more: Column) -> DataFrame:
    """Columns ``more`` and h1, h2: a row for each distinct key of a row.

    explode_outer, as plain explode makes the optimizer evaluate its array
    once more in a filter on the array's size; and ``more`` is computed below
    the explode, once a row and not once a line.
    """
    inner = docs.select(*more, F.array_distinct(hashes_of(lines, min_chars)).alias("k"))
    k = inner.withColumn("k", F.explode_outer("k")).where("k is not null")
    return k.select(*[c for c in k.columns if c != "k"], "k.h1", "k.h2")


class LineRuns:
    """Levelled sorted runs of line hashes in a shared folder.

    A run is known to Spark as an external table for as long as it takes to read
    its layout; the files stay in ``path``.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, min_chars: int = 1, path: str | None = None, settled_at: int | None = None):
        self.spark, self.fanout, self.min_chars, self.settled_at = spark, max(2, fanout), min_chars, settled_at
        self.path = path or new_path(spark, "line-runs")
        self.buckets = partitions(spark)
        self.levels: list[list[DataFrame]] = []

    def _sorted_scans(self):
        """Scans of runs count as sorted (each bucket is one file), and joins with them merge."""
        return session_conf(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__sources__bucketing__autoBucketedScan__enabled="false", spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__shuffle__partitions=self.buckets)

    def _write(self, counts: DataFrame) -> DataFrame:
        """counts (h1, h2, n), one row a key, dealt by key, to a run."""
        name = f"line_run_{uuid.uuid4().hex}"
        with self._sorted_scans():
            counts.write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"drop table {name}")  # an external table: its files stay
        return run

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """``keys`` without those settled in a run: a merge anti-join with each."""
        for r in self.runs() if self.settled_at else ():
            keys = keys.join(r.where(F.col("n") >= self.settled_at).select(*KEY), KEY, "left_anti")
        return keys

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """The batch's own run, at level 0; then full levels are merged."""
        counts = distinct_keys(docs, lines_of(text_or_empty(text_col)), self.min_chars).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        run, level = self._write(self.fresh(counts)), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            runs, self.levels[level] = self.levels[level], []
            run, level = self._one(runs), level + 1

    def _one(self, runs: list[DataFrame]) -> DataFrame:
        while len(runs) > 1:
            runs = [*runs[2:], self._write(self.merged(runs[0], runs[1]))]
        return runs[0]

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sorted runs as one: counts of a key are added."""
        x, y = (r.toDF(*[f"{c}_{side}" for c in r.columns]) for r, side in ((a, "a"), (b, "b")))
        both = x.join(y, (F.col("h1_a") == F.col("h1_b")) & (F.col("h2_a") == F.col("h2_b")), "full_outer")
        return both.select(*[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in KEY], (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"))

    def totals(self, min_docs: int = 1) -> DataFrame:
        """h1, h2 of keys found in at least ``min_docs`` documents of all runs."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._one(runs).where(F.col("n") >= min_docs).select(*KEY)

    def hits(self, each: DataFrame, min_docs: int) -> DataFrame:
        """(a, b, h1, h2) rows whose key is found in at least ``min_docs`` documents: (a, b, gone).

        A key with very many documents would put all of them into the task of its
        bucket.  Of keys whose count is over a 1/``HOT_KEYS``-th of all in a run there
        are fewer than ``HOT_KEYS``: those are broadcast and meet their rows where
        they are; the others are dealt to the buckets.  Written, so that the next join's sides are
        plain exchanges and a text with very many copies is split over tasks.
        """
        runs = self.runs()
        if not runs:
            return stash(each.select("a", "b", F.array("h1").alias("gone")).limit(0), "line-hits")
        # a key that one document has is found in some run; a count of more needs all of them
        found = [r.where(F.col("n") >= min_docs) for r in (runs if min_docs <= 1 else [self._one(runs)])]
        hot = None
        for r in found:
            least = (r.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
            part = r.where(F.col("n") > least).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"))
            hot = part if hot is None else hot.unionByName(part)
        each = stash(each.join(F.broadcast(hot.distinct()), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select("a", "b", *KEY, F.col("g1").isNotNull().alias("hot")), "line-keys")
        with self._sorted_scans():
            both = each.where("hot").select("a", "b", "h1")
            for r in found:
                both = both.unionByName(each.where("not hot").join(r.select(*KEY), KEY, "left_semi").select("a", "b", "h1"))
            return stash(both.groupBy("a", "b").agg(F.collect_set("h1").alias("gone")), "line-hits")


def _drop(docs: DataFrame, runs: LineRuns, min_docs: int, text_col: str) -> DataFrame:
    """(row, lines, kept): each row of ``docs`` packed, all its lines, and those not found in ``min_docs`` documents.

    Only hashes are joined with the runs.  What a document loses comes back as
    an array bounded by its own lines; the text moves once, to meet it.
    A text is known by its hash here, equal texts lose equal lines.
    """
    text = text_or_empty(text_col)
    a, b = F.xxhash64(text), F.xxhash64(F.lit(5), text, F.length(text))
    hit = runs.hits(distinct_keys(docs, lines_of(text), runs.min_chars, a.alias("a"), b.alias("b")), min_docs)
    keyed = docs.select(packed(docs), a.alias("ta"), b.alias("tb"))
    mine = F.coalesce(F.col(f"row.c{docs.columns.index(text_col)}").cast("string"), F.lit(""))
    both = keyed.join(hit, (F.col("ta") == F.col("a")) & (F.col("tb") == F.col("b")), "left").select("row", "gone", lines_of(mine).alias("lines"))
    pairs = F.filter(F.arrays_zip(F.col("lines").alias("line"), F.transform(hashes_of(F.col("lines"), runs.min_chars), lambda x: x["h1"]).alias("h1")), lambda x: x["h1"].isNull() | ~F.array_contains("gone", x["h1"]))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(pairs, lambda x: x["line"]))
    return both.select("row", "lines", kept.alias("kept"))


def add_corpus(docs: DataFrame, runs: LineRuns, batches: int, id_col: str, text_col: str) -> None:
    """The corpus goes through the runs batch by batch, dealt by a hash of the id."""
    batch = F.pmod(F.xxhash64(quoted(id_col).cast("string")), F.lit(batches))
    for i in range(batches):
        runs.add(docs.where(batch == i) if batches > 1 else docs, text_col)


def drop_common_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 1, fanout: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(row, lines, kept) after lines common to ``min_docs`` documents went; see ``with_kept_text``.

    ``batches``: in how many batches the corpus is added, dealt by a hash of the id.
    """
    runs = LineRuns(docs.sparkSession, fanout, min_chars, settled_at=min_docs)
    add_corpus(docs, runs, batches, id_col, text_col)
    return _drop(docs, runs, min_docs, text_col)


def dedup_batch(runs: LineRuns, batch: DataFrame, text_col: str = "text") -> DataFrame:
    """The incremental way: ``batch`` without the lines that earlier batches have.

    The runs are read before the batch adds its own, and the result is written
    before that, so a batch never meets itself.
    """
    out = stash(_drop(batch, runs, 1, text_col), "line-batch")
    runs.add(batch, text_col)
    return with_kept_text(out, text_col, batch.columns)


def with_kept_text(dropped: DataFrame, text_col: str, columns: list[str], n_chars_col: str | None = "n_chars") -> DataFrame:
    """Back to the columns of the documents, with the kept lines as text and its length."""
    kept, whole = F.array_join("kept", "\n"), F.size("kept") == F.size("lines")
    old = dict(zip(columns, unpacked(columns), strict=True))
    new = {text_col: F.when(whole, old[text_col]).otherwise(kept)}
    if n_chars_col in columns:
        new[n_chars_col] = F.when(whole, old[n_chars_col]).otherwise(F.length(kept).cast("long"))
    return dropped.select(*[new.get(c, old[c]).alias(c) for c in columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    d = drop_common_lines(docs.select(quoted(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "text", **kw)
    return d.select(F.col("row.c0").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))
