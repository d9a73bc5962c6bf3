"""`name=value` fields and one-entry maps.

Positions are read with `get` and `try_element_at`: a missing position is NULL,
also in a session with ANSI mode on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_value(field: Column) -> Column:
    """The value of one `name=value` field, NULL without an equals sign."""
    return F.get(F.split(field, "="), F.lit(1))


def keyed_field(line: Column, name: str, unless: str | None = None) -> Column:
    """The value of the last field of a line that contains `name`, or the empty string.

    A field that also contains `unless` belongs to that name and is passed over.
    """

    def named(field: Column) -> Column:
        found = F.contains(field, F.lit(name))
        return found if unless is None else found & ~F.contains(field, F.lit(unless))

    fields = F.filter(F.split(line, " "), named)
    return F.coalesce(field_value(F.try_element_at(fields, F.lit(-1))), F.lit(""))


def pair(key: Column, value: Column) -> Column:
    """A map with one entry."""
    return F.create_map(key, value)


def pair_key(entry: Column) -> Column:
    return F.get(F.map_keys(entry), F.lit(0))


def pair_value(entry: Column) -> Column:
    return F.get(F.map_values(entry), F.lit(0))
