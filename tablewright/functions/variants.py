"""JSON column helpers on the variant type."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.predicates import as_col

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def path_steps(path: str) -> list[str | int]:
    """``.a.b[2]`` as ``['a', 'b', 2]``."""
    return [int(index) if index else name for name, index in _STEP.findall(path)]


def as_object(v: Column) -> Column:
    """Key to value map of an object; NULL for any other kind."""
    return v.try_cast("map<string,variant>")


def as_list(v: Column) -> Column:
    return v.try_cast("array<variant>")


def json_type(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    scalar = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null")
        .when(as_object(v).isNotNull(), "object")
        .when(as_list(v).isNotNull(), "array")
        .when(scalar == "STRING", "string")
        .when(scalar == "BOOLEAN", "boolean")
        .when(v.isNotNull(), "number")
    )


def json_get(json: Column | str, path: str, as_text: bool = True) -> Column:
    """The value at ``.a.b[0]``: as plain text, or as JSON text with strings quoted.

    A JSON null is NULL as text and ``null`` as JSON; a missing path is NULL either way.
    """
    steps = "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path_steps(path))
    value = F.try_variant_get(F.try_parse_json(as_col(json)), "$" + steps, "variant")
    return value.cast("string") if as_text else F.to_json(value)


def json_has_key(json: Column | str, key: str) -> Column:
    return F.coalesce(F.map_contains_key(as_object(F.try_parse_json(as_col(json))), key), F.lit(False))


def _set(v: Column, steps: list, value: Column, create: bool) -> Column:
    if not steps:
        return value
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        changed = F.transform(as_list(v), lambda x, i: F.when(i == step, _set(x, rest, value, create)).otherwise(x))
    elif rest or not create:
        changed = F.transform_values(
            as_object(v), lambda k, x: F.when(k == step, _set(x, rest, value, create)).otherwise(x)
        )
    else:
        others = F.map_filter(as_object(v), lambda k, _: k != step)
        changed = F.map_concat(others, F.create_map(F.lit(step), value))
    return F.coalesce(F.to_variant_object(changed), v)


def json_set(v: Column, path: str, value: Column, create: bool = True) -> Column:
    """Replace the value at ``path``; a missing last key is added, other missing steps change nothing."""
    return _set(v, path_steps(path), value, create)


def json_merge(v: Column, other: Column) -> Column:
    """Shallow merge of two objects; the right side wins."""
    right = as_object(other)
    left = F.map_filter(as_object(v), lambda k, _: ~F.map_contains_key(right, k))
    return F.to_variant_object(F.map_concat(left, right))


def json_delete(v: Column, path: str) -> Column:
    """Remove the key or list item at ``path``."""

    def drop(v: Column, steps: list) -> Column:
        step, rest = steps[0], steps[1:]
        if isinstance(step, int):
            items = as_list(v)
            if rest:
                left = F.transform(items, lambda x, i: F.when(i == step, drop(x, rest)).otherwise(x))
            else:
                left = F.filter(items, lambda x, i: i != step)
        else:
            entries = as_object(v)
            if rest:
                left = F.transform_values(
                    entries, lambda k, x: F.when(k == step, drop(x, rest)).otherwise(x)
                )
            else:
                left = F.map_filter(entries, lambda k, _: k != step)
        return F.coalesce(F.to_variant_object(left), v)

    return drop(v, path_steps(path))


def xpath_scalar(xml: Column | str, path: str, data_type: str = "string") -> Column:
    """One typed value out of XML text."""
    return F.xpath_string(as_col(xml), F.lit(path)).try_cast(data_type)
