"""Record headers: an ordered multimap in which the last value of a name wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidelog.schema import HEADERS_DDL


def no_headers() -> Column:
    return F.array().cast(HEADERS_DDL)


def header(name: str, text: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.encode(text, "UTF-8").alias("value"))


def header_if(condition: Column, name: str, text: Column) -> Column:
    return F.when(condition, header(name, text))


def add_headers(headers: Column, *new: Column) -> Column:
    """Append; entries that are null (their condition did not hold) vanish."""
    return F.concat(F.coalesce(headers, no_headers()), F.array_compact(F.array(*new)))


def last_header(headers: Column, name: str) -> Column:
    found = F.filter(headers, lambda h: h["key"] == F.lit(name))
    return F.decode(F.try_element_at(found, F.lit(-1))["value"], "UTF-8")


def has_header(headers: Column, name: str) -> Column:
    return F.coalesce(F.exists(headers, lambda h: h["key"] == F.lit(name)), F.lit(False))


def header_map(headers: Column) -> Column:
    """name -> text. Records whose names are all different, nearly all of them, become a map
    in one go; only the others look for the last value of each name."""
    def text(h: Column) -> Column:
        return F.struct(h["key"].alias("key"), F.decode(h["value"], "UTF-8").alias("value"))

    names = F.transform(headers, lambda h: h["key"])
    distinct = F.array_distinct(names)
    last = F.transform(distinct, lambda name: text(
        F.element_at(F.filter(headers, lambda h: h["key"] == name), -1)))
    return F.when(F.size(distinct) == F.size(headers), F.map_from_entries(F.transform(headers, text))).otherwise(
        F.map_from_entries(last))
