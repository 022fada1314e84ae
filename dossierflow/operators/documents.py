"""Nested documents and lists: flattening, cleaning, ordered sets, defaults, first failed rule of each field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_texts(nested: Column, field: str) -> Column:
    """All texts of ``array<struct<field array<string>>>`` in order, trimmed, without empty ones."""
    return F.filter(F.transform(F.flatten(F.transform(nested, lambda n: F.coalesce(n[field], F.array().cast("array<string>")))), lambda t: F.trim(t)), lambda t: t != "")


def distinct_trimmed(values: Column) -> Column:
    """Trimmed values in order of first occurrence, without empty ones."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def distinct_by(values: Column, norm) -> Column:
    """The first spelling of each normal form, in order; values without one go."""
    keys = F.transform(values, norm)
    return F.filter(values, lambda v, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))


def difference_by(values: Column, other: Column, norm) -> Column:
    """Values whose normal form no value of ``other`` has, in order."""
    known = F.transform(other, norm)
    return F.filter(values, lambda v: ~F.array_contains(known, norm(v)))


def without_empty(fields: Column) -> Column:
    """A string map without null and blank values."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def stable_json(fields: Column) -> Column:
    """A string map as JSON with sorted keys, so equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def named(items: Column, name: str, field: str, otherwise: Column) -> Column:
    """``field`` of the first struct of that ``name``, else a fallback."""
    return F.coalesce(F.get(F.filter(items, lambda i: i["name"] == name), F.lit(0))[field], otherwise)


def with_defaults(fields: Column, defaults: dict[str, str]) -> Column:
    """A string map in which missing or null keys have their defaults."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_zip_with(base, fields, lambda k, d, v: F.coalesce(v, d))


def first_errors(rules: list[tuple[str, Column, str]]) -> Column:
    """``map<field, message>``: of each field the message of the first rule, in order, that does not hold."""
    fields = list(dict.fromkeys(f for f, _, _ in rules))
    messages = [F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for f, ok, m in rules if f == field]) for field in fields]
    return F.map_filter(F.create_map(*[x for f, m in zip(fields, messages, strict=True) for x in (F.lit(f), m)]), lambda k, v: v.isNotNull())
