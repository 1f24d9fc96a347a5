"""Text predicates with the exact edge cases of the message formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace for trimming means every character up to U+0020, not only the blank.
_LOW = r"[\x00-\x20]"


def trim_low(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{_LOW}+|{_LOW}+\z", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but low characters; stops at the first other character."""
    return c.isNull() | ~c.rlike(r"[^\x00-\x20]")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def longer_than(c: Column, limit: int) -> Column:
    """UTF-16 length above ``limit``. UTF-8 is never shorter, so most rows skip the encode."""
    return F.when(F.octet_length(c) <= limit, F.lit(False)).otherwise(utf16_length(c) > limit)


def utf16_prefix(c: Column, limit: int) -> Column:
    """The first ``limit`` UTF-16 units; a character of two units that lies across the border is left out."""
    units = F.encode(c, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * limit - 1, 1)).between("D8", "DB")
    return F.decode(F.when(half, F.substring(units, 1, 2 * limit - 2)).otherwise(F.substring(units, 1, 2 * limit)), "UTF-16BE")


def json_shaped(c: Column) -> Column:
    return c.rlike(rf"(?s)\A{_LOW}*(\{{.*\}}|\[.*\]){_LOW}*\z")


def instant_text(ts: Column) -> Column:
    """ISO-8601 instant with millisecond precision, e.g. 2024-01-31T00:00:00.000Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
