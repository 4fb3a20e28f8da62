"""Character classes and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]$")


def is_letter(c: Column) -> Column:
    return c.rlike(r"^\p{L}$")


def is_digit(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}$")


def is_letter_or_digit(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{Nd}]$")


def is_whitespace(c: Column) -> Column:
    return c.rlike(r"^\p{javaWhitespace}$")


def is_word(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{Nd}_]$")


def first_non_ascii(text: Column, start: Column | int = 0) -> Column:
    """Place of the first character beyond ASCII from ``start`` on, or the length."""
    start = F.lit(start) if isinstance(start, int) else start
    at = F.regexp_instr(F.substring(text, start + 1, F.length(text)), F.lit(r"[^\x00-\x7F]"))
    return F.when(at > 0, start + at - 1).otherwise(F.length(text))


def is_all_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def sha1_hex(c: Column) -> Column:
    return F.sha1(c)


def csv_escape(c: Column) -> Column:
    """Line breaks become spaces; a value with a comma or quotes is quoted, its double quotes doubled."""
    flat = F.regexp_replace(c, r"[\r\n]", " ")
    return F.when(flat.rlike("[,\"']"), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)
