"""Expressions over row snapshots (maps from column name to value) and templates with {name} places."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = re.compile(r"\{([A-Za-z_]\w*)\}", re.ASCII)


def text_of(value: Column) -> Column:
    """A value as text; a missing one, or JSON null, as empty text."""
    return F.coalesce(value.try_cast("string"), F.lit(""))


def template(text: str, snapshot: Column) -> Column:
    """The text with each {column} replaced by the row's value; other braces stay.  Split once, when the plan is made."""
    parts, at = [], 0
    for m in PLACE.finditer(text):
        parts += [F.lit(text[at : m.start()])] * (m.start() > at) + [text_of(snapshot[m[1]])]
        at = m.end()
    parts += [F.lit(text[at:])] * (at < len(text) or not parts)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def joined(snapshot: Column, columns: tuple[str, ...], separator: str = "|") -> Column:
    """The columns' texts with a separator between; missing ones count as empty text."""
    return F.concat_ws(separator, *[text_of(snapshot[c]) for c in columns])


def last_wins(entries: Column) -> Column:
    """Entries of a map in which a later one replaces the value of an earlier one with the same key, in its place."""
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda x: x["key"] == e["key"]))
    return F.transform(first, lambda e: F.struct(e["key"].alias("key"), F.element_at(F.filter(entries, lambda x: x["key"] == e["key"]), -1)["value"].alias("value")))


def project(snapshot: Column, include: tuple[str, ...], exclude: tuple[str, ...], rename: dict[str, str]) -> Column:
    """Some columns of a snapshot, in the row's order, some under another name; missing ones are left out."""
    entries = F.map_entries(snapshot)
    if include:
        entries = F.filter(entries, lambda e: e["key"].isin(*include))
    if exclude:
        entries = F.filter(entries, lambda e: ~e["key"].isin(*exclude))
    if not rename:
        return F.map_from_entries(entries)
    names = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
    renamed = F.transform(entries, lambda e: F.struct(F.coalesce(names[e["key"]], e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.transform(F.array(renamed), last_wins)[0])


def as_json(m: Column) -> Column:
    """A map as JSON with its nulls."""
    return F.to_json(m, {"ignoreNullFields": "false"})


def as_lines(m: Column) -> Column:
    """A map as name=value lines."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), text_of(e["value"]))), "\n")


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; the second wins."""
    first, second = (F.coalesce(m, F.expr("cast(map() as map<string,string>)")) for m in (first, second))
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)
