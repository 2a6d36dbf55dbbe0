"""Typed views of dynamic (JSON) values as native column expressions.

Lists keep their string elements only; a list of whole numbers takes null as 0
and is null if it has any other element or none; map values that are not
strings are written as text; of equal keys the last one wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _strings(elements: Column) -> Column:
    kept = F.filter(elements, lambda e: F.schema_of_variant(e) == "STRING")
    return F.transform(kept, lambda e: F.try_variant_get(e, "$", "string"))


def string_list(json: Column | str) -> Column:
    """The string elements of a JSON array, in order."""
    return _strings(_elements(F.try_parse_json(_col(json))))


def int_list(json: Column | str) -> Column:
    """A JSON array of whole numbers (null is 0); null if an element is anything else."""
    elements = _elements(F.try_parse_json(_col(json)))

    def number(e: Column) -> Column:
        kind = F.schema_of_variant(e)
        return F.when(F.is_variant_null(e) | kind.isin("VOID"), F.lit(0)).when(
            kind == "BIGINT", F.try_variant_get(e, "$", "bigint")
        )

    numbers = F.transform(elements, number)
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def string_map(json: Column | str) -> Column:
    """A JSON object as string to string; other values as their JSON text."""
    return F.map_from_entries(F.map_entries(F.from_json(_col(json), "map<string,string>")))


def string_list_map(json: Column | str) -> Column:
    """A JSON object as string to list of its arrays' string elements (null for other values)."""
    entries = F.try_variant_get(F.try_parse_json(_col(json)), "$", "map<string,variant>")
    return F.transform_values(entries, lambda k, v: _strings(_elements(v)))


def char_map(json: Column | str) -> Column:
    """First character of each key to first character of its value, in document order."""
    first = F.transform(
        F.map_entries(F.from_json(_col(json), "map<string,string>")),
        lambda e: F.struct(F.substr(e["key"], F.lit(1), F.lit(1)).alias("key"), F.substr(e["value"], F.lit(1), F.lit(1)).alias("value")),
    )
    return F.map_from_entries(first)
