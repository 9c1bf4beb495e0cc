"""Path expressions over VARIANT columns.

The subset: dotted fields, ``[n]``, ``x[]`` (flattening projection that drops
nulls) and ``a || b`` (the first operand that is not null, false, or an empty
string, list or object; else the last). An expression is compiled to one Column,
so a payload is parsed once however many paths are read from it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.?([A-Za-z_][A-Za-z0-9_]*)|\[(\d*)\]")


def is_null(value: Column) -> Column:
    """SQL null or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def as_array(value: Column) -> Column:
    """The elements of a JSON array as array<variant>; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    return as_array(value).isNotNull()


def as_string(value: Column) -> Column:
    """String form: strings as they are, other values as compact JSON; null for JSON null."""
    return F.when(~is_null(value), F.try_variant_get(value, "$", "string"))


def falsy(value: Column) -> Column:
    """Null, false, or an empty string, list or object. A list is known by its first element, without reading it."""
    some = F.try_variant_get(value, "$[0]", "variant").isNotNull()
    return F.when(some, False).otherwise(is_null(value) | F.to_json(value).isin("false", '""', "[]", "{}"))


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _steps(path: str) -> list[str | int | None]:
    """Field names, indexes, and None for a projection."""
    out, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"unsupported path: {path!r}")
        out.append(m[1] if m[1] else None if m[2] == "" else int(m[2]))
        at = m.end()
    return out


def _plain(value: Column, steps: list) -> Column:
    if not steps:
        return value
    return F.try_variant_get(value, "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps), "variant")


def _projection(items: Column, steps: list) -> Column:
    """array<variant> after applying further steps to each item."""
    cut = steps.index(None) if None in steps else len(steps)
    mapped = F.filter(F.transform(items, lambda x: _plain(x, steps[:cut])), lambda x: ~is_null(x))
    return _projection(_flat(mapped), steps[cut + 1 :]) if cut < len(steps) else mapped


def _flat(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda x: F.coalesce(as_array(x), F.array(x))))


def _operand(path: str, value: Column) -> Column:
    steps = _steps(path)
    if None not in steps:
        return _plain(value, steps)
    cut = steps.index(None)
    items = as_array(_plain(value, steps[:cut]))
    return F.when(items.isNotNull(), F.parse_json(F.to_json(_projection(_flat(items), steps[cut + 1 :]))))


def path_eval(path: str | None, value: Column) -> Column:
    """Column: the variant that ``path`` finds in ``value``; SQL null if it finds nothing."""
    if not path:
        return F.lit(None).cast("variant")
    *first, last = [_operand(p.strip(), value) for p in path.split("||")]
    out = bound(last, lambda x: F.when(~is_null(x), x))
    for operand in reversed(first):
        out = _or(operand, out)
    return out


def _or(value: Column, other: Column) -> Column:
    return bound(value, lambda x: F.when(~falsy(x), x).otherwise(other))
