"""URL filters as a temporal list join, with DataFrame operations only.

A list is a table of dated entries (key, action, since): from ``since`` on,
the key is on the list (``add``) or off it (``remove``).  Keys are hosts,
which cover their subdomains, or ``host/path`` prefixes, which cover what
starts with those whole path segments.  The entries of a key become validity
intervals [since, until).  A capture (url, time of fetch) looks up the keys
that can cover it - the suffixes of its host and the prefixes of its path -
and is blocked if one of them has an interval that holds its time of fetch.

Captures are first folded to distinct (url, time), unfolded to their keys, and
only keys that are on the list at all go on.  The as-of join is by key and
period of ``period_days`` days, for those periods alone that captures of the key
have: what began in the period, and the one interval that was open when it
began, carried over by a window along the key's periods.  So a key with a long
history meets only what can hold in the capture's own period, a host that holds
a third of all captures is dealt over the periods, and neither far dates nor long
intervals add rows.

Defined cases: a null or unusable url or time is never blocked and has a null
host; of entries of one key at one time ``add`` wins; repeated entries count
once; an action other than ``remove`` is an add; entries without key or date
are left out; an empty list blocks nothing; other columns of the captures are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_KEYS, quoted, stash

#: A host has at most 253 characters, so at most 127 labels; a path is looked
#: up in full depth, so no limit applies.
FAR = "9999-12-31 00:00:00"


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and last dot; null if there is none."""
    h = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    h = F.regexp_replace(F.lower(h), r"\.+$", "")
    return F.when(h != "", h)


def url_path(url: Column) -> Column:
    """Path without leading and trailing slashes, query and fragment."""
    p = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    return F.btrim(p, F.lit("/"))


def lookup_keys(host: Column, path: Column) -> Column:
    """All list keys that cover the capture."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/")
    paths = F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.array_distinct(F.concat(hosts, paths))


def list_key(key: Column) -> Column:
    """List keys in the form of ``lookup_keys``: host in lower case, no scheme, no slash at the end."""
    k = F.regexp_replace(F.trim(key), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    k = F.regexp_replace(k, "/+$", "")
    host = F.regexp_replace(F.lower(F.substring_index(k, "/", 1)), r"\.+$", "")
    return F.when(F.instr(k, "/") > 0, F.concat(host, F.substring(k, F.instr(k, "/"), F.length(k)))).otherwise(host)


def validity(entries: DataFrame, key_col: str = "key", action_col: str = "action", since_col: str = "since") -> DataFrame:
    """Dated entries to intervals (key, valid_from, valid_to) in which the key is on the list."""
    e = entries.select(list_key(quoted(key_col)).alias("key"), (F.lower(quoted(action_col)) == "remove").alias("off"), quoted(since_col).cast("timestamp").alias("valid_from"))
    e = e.where("key is not null and key != '' and valid_from is not null")
    e = e.groupBy("key", "valid_from").agg(F.min(F.coalesce("off", F.lit(False))).alias("off"))
    along = Window.partitionBy("key").orderBy("valid_from")
    e = e.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(along), F.lit(FAR).cast("timestamp")))
    return e.where("not off").select("key", "valid_from", "valid_to")


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched_at",
    period_days: int = 32,
    key_col: str = "key",
    action_col: str = "action",
    since_col: str = "since",
) -> DataFrame:
    """One row per row of ``captures``: id, url, host, fetched_at, blocked, matched_key, listed_since.

    matched_key is the longest key that blocks (no two that cover a capture
    are equally long), listed_since the begin of its interval.
    """
    span = period_days * 86400
    number = lambda t: F.floor(F.unix_seconds(t) / F.lit(span)).cast("long")
    c = captures.select(quoted(id_col).alias(id_col), quoted(url_col).cast("string").alias("url"), quoted(time_col).cast("timestamp").alias("fetched_at"))
    c = c.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    asked = c.where("host is not null and fetched_at is not null").select("host", "path", "fetched_at").distinct()
    asked = asked.select("host", "path", "fetched_at", F.explode(lookup_keys(F.col("host"), F.col("path"))).alias("key"))
    iv = stash(validity(entries, key_col, action_col, since_col), "intervals")
    listed = iv.select("key").distinct()
    if iv.count() > BROADCAST_KEYS:  # then ask with each key once
        listed = stash(listed.join(asked.select("key").distinct(), "key", "left_semi"), "listed-keys")
    listed = F.broadcast(listed) if listed.count() <= BROADCAST_KEYS else listed
    asked = asked.join(listed, "key", "left_semi").withColumn("period", number(F.col("fetched_at")))
    began = iv.join(listed, "key", "left_semi").withColumn("period", number(F.col("valid_from")))
    interval = F.struct("valid_from", "valid_to")
    periods = asked.select("key", "period", F.lit(True).alias("is_asked"), F.lit(None).cast(began.select(interval.alias("i")).schema["i"].dataType).alias("last"))
    periods = periods.unionByName(began.select("key", "period", F.lit(False).alias("is_asked"), interval.alias("last"))).groupBy("key", "period").agg(F.max("is_asked").alias("is_asked"), F.max("last").alias("last"))
    along = Window.partitionBy("key").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    periods = periods.withColumn("carried", F.last("last", ignorenulls=True).over(along)).where("is_asked")
    held = periods.where("carried is not null").select("key", "period", "carried.valid_from", "carried.valid_to").unionByName(began.join(periods.select("key", "period"), ["key", "period"], "left_semi").select("key", "period", "valid_from", "valid_to"))
    hit = asked.join(held, ["key", "period"]).where("fetched_at >= valid_from and fetched_at < valid_to")
    best = hit.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("fetched_at").alias("b_at")).agg(F.max_by("key", F.struct(F.length("key"), F.col("valid_from"))).alias("matched_key"), F.max_by("valid_from", F.struct(F.length("key"), F.col("valid_from"))).alias("listed_since"))
    out = c.join(best, (c["host"] == best["b_host"]) & (c["path"] == best["b_path"]) & (c["fetched_at"] == best["b_at"]), "left")
    return out.select(id_col, "url", "host", "fetched_at", F.col("matched_key").isNotNull().alias("blocked"), "matched_key", "listed_since")
