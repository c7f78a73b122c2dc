"""Predicates on JSON payloads, compiled to Columns. Two dialects, both two-valued.

strict: JSON equality by type (1, 1.0 and true differ), comparisons of numbers with numbers only, `ne` true for a
missing field, contains for text in text only. loose: 1, 1.0 and true are equal, numbers in text are compared, every
condition on a missing or null field is false, contains also for members of lists and keys of objects.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains")


def variant(payload: Column) -> Column:
    """The payload as a VARIANT; null where it isn't JSON."""
    return F.try_parse_json(payload)


def get(payload: Column, name: str) -> Column:
    """A top-level field; no paths."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(payload, f"$['{quoted}']", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _number(v: Column) -> Column:
    k = _kind(v)
    return F.when(k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _sure(c: Column, missing: bool = False) -> Column:
    return F.coalesce(c, F.lit(missing))


def _same(v: Column, value) -> Column:
    """Strict JSON equality."""
    k = _kind(v)
    if value is None:
        return _sure(k == "VOID")
    if isinstance(value, bool):
        return _sure((k == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value))
    if isinstance(value, int):
        return _sure((k == "BIGINT") & (F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(value).cast("decimal(38,0)")))
    if isinstance(value, float):
        return _sure((k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")) & (F.try_variant_get(v, "$", "double") == value))
    if isinstance(value, str):
        return _sure(_text(v) == value)
    return _sure(F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))


def _compare(a: Column, op: str, b: float) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def strict_leaf(payload: Column, name: str, op: str, value) -> Column:
    v = get(payload, name)
    if op == "eq":
        return _same(v, value)
    if op == "ne":
        return ~_same(v, value)
    if op in ("gt", "gte", "lt", "lte"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return F.lit(False)
        return _sure(_compare(_number(v), op, float(value)))
    if op == "in":
        out = F.lit(False)
        for x in value if isinstance(value, (list, tuple)) else []:
            out = out | _same(v, x)
        return out
    if op == "contains":
        return _sure(_text(v).contains(value)) if isinstance(value, str) else F.lit(False)
    raise ValueError(f"unknown operation {op!r}; one of {OPS}")


def compile_filter(tree: Mapping | None, payload: Column, strict: bool = True) -> Column:
    """A Column from {"field", "op", "value"}, {"and": [...]}, {"or": [...]} and {"not": ...}; null trees are true.

    What isn't understood raises; with strict=False it is dropped instead (an unknown operation is taken as eq). A
    payload that is null or no JSON matches nothing.
    """

    def walk(t) -> Column | None:
        if isinstance(t, Mapping):
            if "field" in t:
                op = str(t.get("op", "eq")).lower()
                if op not in OPS and not strict:
                    op = "eq"
                return strict_leaf(payload, t["field"], op, t.get("value", ""))
            for name in ("and", "or"):
                if name in t:
                    parts = [x for x in map(walk, t[name]) if x is not None]
                    out = F.lit(name == "and")
                    for x in parts:
                        out = (out & x) if name == "and" else (out | x)
                    return out
            if "not" in t:
                x = walk(t["not"])
                return None if x is None else ~x
        if strict:
            raise ValueError(f"not a filter: {t!r}")
        return None

    c = None if tree is None else walk(tree)
    return F.lit(True) if c is None else payload.isNotNull() & c


def _loose_number(v: Column) -> Column:
    k = _kind(v)
    return F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(k == "STRING", F.expr("null").cast("double")).otherwise(_number(v))


def _loose_same(v: Column, value) -> Column:
    if isinstance(value, (bool, int, float)):
        return _sure(_loose_number(v) == float(value))
    if value is None:
        return F.lit(False)
    return _same(v, value)


def loose_leaf(payload: Column, name: str, op: str, value) -> Column:
    v = get(payload, name)
    there = _sure(_kind(v) != "VOID")
    if op == "eq":
        return there & _loose_same(v, value)
    if op == "ne":
        return there & ~_loose_same(v, value)
    if op in ("gt", "gte", "lt", "lte"):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return F.lit(False)
        k = _kind(v)
        mine = F.coalesce(_loose_number(v), F.when(k == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("double")))
        return _sure(_compare(mine, op, number) & ~F.isnan(mine))
    if op == "in":
        if isinstance(value, str):
            return _sure(F.lit(value).contains(_text(v)))
        out = F.lit(False)
        for x in value if isinstance(value, (list, tuple)) else []:
            out = out | _loose_same(v, x)
        return there & out
    if op == "contains":
        k = _kind(v)
        member = F.lit(False)
        items = F.try_variant_get(v, "$", "array<variant>")
        member = _sure(F.when(k.startswith("ARRAY"), F.exists(items, lambda x: _loose_same(x, value))))
        if isinstance(value, str):
            key = F.when(k.startswith("OBJECT"), F.array_contains(F.json_object_keys(F.to_json(v)), value))
            return _sure(_text(v).contains(value)) | member | _sure(key)
        return member
    return F.lit(False)


def compile_conditions(conditions: Sequence[Mapping], payload: Column, logic: str = "and") -> Column:
    """A Column from a flat list of {"field", "op", "value"} in the loose dialect; no condition is true, an unknown operation false."""
    if not conditions:
        return F.lit(True)
    parts = [loose_leaf(payload, c.get("field", ""), c.get("op", "eq"), c.get("value")) for c in conditions]
    out = parts[0]
    for p in parts[1:]:
        out = (out | p) if logic == "or" else (out & p)
    return out
