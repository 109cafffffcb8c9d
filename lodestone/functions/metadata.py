"""Typed reading of findings' metadata, whatever the writer's spelling: VARIANT fields by name without case.

``fields`` parses a text once; the readers take its result. Defined results: metadata that are null, no
JSON, no object, or that repeat a key exactly have no fields; of keys that differ by case alone the exact
one counts, else the first in order of bytes; a field of the wrong shape is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(metadata) -> Column:
    """Fields by name. Make it a column of its own, so that several readers share one parse."""
    return F.try_parse_json(metadata).try_cast("map<string,variant>")


def field(of, name: str) -> Column:
    """The field as it is."""
    of = F.col(of) if isinstance(of, str) else of
    return F.coalesce(F.try_element_at(of, F.lit(name)), F.get(F.map_values(F.map_filter(of, lambda k, _: F.lower(k) == name.lower())), 0))


def text(of, name: str) -> Column:
    """A text as it is, any other value as JSON."""
    return field(of, name).try_cast("string")


def whole(of, name: str) -> Column:
    """A number without a fraction, or a text that holds one and no more."""
    said = F.trim(text(of, name))
    return F.when(said.rlike("^[+-]?[0-9]+$"), said).try_cast("long")


def rounded(of, name: str) -> Column:
    """A number, or a text that holds one, to the nearest whole number, halves to the even one."""
    said = F.trim(text(of, name)).try_cast("double")
    return F.when(F.abs(said) < 1e18, F.rint(said)).try_cast("long")


def flag(of, name: str) -> Column:
    """A truth value, or a text that names one in any case."""
    said = F.lower(F.trim(text(of, name)))
    return F.when(said.isin("true", "false"), said == "true")


def items(of, name: str) -> Column:
    """The fields of each object of an array, as an array; other elements are left out."""
    return F.filter(F.transform(field(of, name).try_cast("array<variant>"), lambda x: x.try_cast("map<string,variant>")), lambda x: x.isNotNull())
