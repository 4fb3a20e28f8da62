"""Lines of texts, and matching line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.patterns import PatternSet

from .match import match_all


def split_lines(df: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """(keys..., line_no, line): lines from 0; what follows the last line break is a line only if it isn't empty."""
    keys = keys or [c for c in df.columns if c != text_col]
    t = F.regexp_replace(F.col(text_col), r"\n\z", "")
    rows = df.where(F.length(text_col) > 0).select(*keys, t.alias("__t"))
    return rows.select(*keys, F.posexplode(F.split("__t", "\n", -1)).alias("line_no", "line"))


def match_lines(df: DataFrame, patterns: PatternSet, text_col: str = "text", keys: list[str] | None = None, **kw) -> DataFrame:
    """(keys..., line_no, pattern_id, pattern, start_pos, end_pos), places inside the line."""
    keys = keys or [c for c in df.columns if c != text_col]
    return match_all(split_lines(df, text_col, keys), patterns, "line", [*keys, "line_no"], **kw)


def from_position(df: DataFrame, position: int, text_col: str = "text") -> DataFrame:
    """Texts as seen by a reader that has read up to and including ``position``
    (-1: nothing), with the place of the first character left in ``__offset``."""
    return df.withColumn("__offset", F.lit(position + 1)).withColumn(text_col, F.substring(F.col(text_col), F.lit(position + 2), F.length(text_col)))
