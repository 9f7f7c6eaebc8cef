"""Lenient parsing and normalisation of text, ids and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_SPACE = " \t\n\r\f\v"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return blank_to_null(text).isNull()


def lenient_enum(text: Column, domain: Sequence[str]) -> Column:
    return F.when(text.isin(*domain), text)


def rating_or_default(text: Column) -> Column:
    """A stored rating; 5.0 when missing or not a number."""
    return F.coalesce(text.try_cast("decimal(2,1)"), F.lit("5.0").cast("decimal(2,1)"))


def lenient_long(text: Column) -> Column:
    """A plain run of digits with an optional sign; anything else is null."""
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def ids_to_csv(ids: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(ids)), ","), F.lit(""))


def csv_to_ids(csv: Column) -> Column:
    """Set of ids. A piece that is not a number makes the whole value unreadable (null)."""
    pieces = F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda p: ~is_blank(p))
    ids = F.transform(pieces, lenient_long)
    return F.when(~F.exists(ids, lambda i: i.isNull()), F.array_sort(F.array_distinct(ids)))


def csv_with(csv: Column, *ids: Column) -> Column:
    """The stored set with more ids; null if what is stored is unreadable."""
    known = csv_to_ids(csv)
    return F.when(known.isNotNull(), ids_to_csv(F.array_union(known, F.array(*ids))))


def string_map(data: Column) -> Column:
    """Every value as text, entries without a value dropped."""
    texts = F.transform_values(data, lambda _, v: v.cast("string"))
    return F.coalesce(F.map_filter(texts, lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def json_to_map(text: Column) -> Column:
    """Decoded object; a blank text is the empty map."""
    return F.coalesce(F.from_json(blank_to_null(text), "map<string,string>"), F.create_map().cast("map<string,string>"))


def map_to_json(data: Column) -> Column:
    return F.coalesce(F.to_json(data), F.lit("{}"))


def provider_name(text: Column) -> Column:
    return F.lower(blank_to_null(text))


def limited_reference(text: Column, longest: int) -> Column:
    """Stripped text; null when blank or too long."""
    value = blank_to_null(text)
    return F.when(F.length(value) <= longest, value)


def parse_instant(text: Column, default: Column | None = None) -> Column:
    parsed = F.try_to_timestamp(text)
    return parsed if default is None else F.coalesce(parsed, default)
