"""Shared pieces of the corpus operators: word pattern, scratch tables, keys.

Conventions used by every operator of this subpackage:

* a *word* is a run of code points other than space and U+0009..U+000D;
* a null text counts as the empty text unless an operator says otherwise;
* rows are never identified by position: where a decision has to be joined
  back to its row, the key is (id, 64-bit hash of the text).  Rows that share
  both are interchangeable, so repeated rows and null ids are safe;
* intermediate tables go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts, as regular-expression classes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors for intermediate tables.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset
    (tests, local mode) a temporary folder of this machine is chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="sievewright-")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(_local_scratch[app])
    return "file://" + _local_scratch[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/sievewright/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and read it again.

    Cuts the lineage: what is read afterwards survives the loss of any
    executor, and nothing is computed twice.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def session_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings (dots as __) for what is run inside; as before afterwards."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def arrow_bytes(spark: SparkSession, n: int):
    """Arrow batches of at most about ``n`` bytes for what is run inside."""
    return session_conf(spark, spark__sql__execution__arrow__maxBytesPerBatch=n)


#: Bytes of an Arrow batch where nothing asks for another size.
ARROW_BYTES = 8 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, changed where a column has them already (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``row``, so that none clashes with those of an operator."""
    return F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    """The columns given back from ``row``, under their names."""
    return [F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)]


def text_or_empty(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def single_spaced(c: Column) -> Column:
    """Every run of white space becomes one space.

    The pattern leaves the usual case, a single plain space, untouched.
    """
    return F.regexp_replace(c, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


#: Row keys up to this number (16 bytes each, a few MB as a hash table) are broadcast to meet the rows
#: where they are; above, rows are shuffled to meet the keys.
BROADCAST_KEYS = 100_000


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (id, text hash), all columns kept."""
    rid, rth, gid, gth = free_names(docs.columns, "__row_id", "__row_th", "__gone_id", "__gone_th")
    g = stash(gone.toDF(gid, gth).distinct(), "gone")
    g = F.broadcast(g) if g.count() <= BROADCAST_KEYS else g
    rows = docs.select("*", quoted(id_col).alias(rid), F.xxhash64(text_or_empty(text_col)).alias(rth))
    left = rows.join(g, F.col(rid).eqNullSafe(F.col(gid)) & (F.col(rth) == F.col(gth)), "left_anti")
    return left.select(*[quoted(c) for c in docs.columns])
