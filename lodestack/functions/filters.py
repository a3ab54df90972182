"""The metadata filter language: JSON nodes compiled to one Column over typed entries.

``metadata_map`` turns a JSON object column into map<field, array<struct<type,num,str,bool>>>; arrays give one entry per scalar, objects none.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, MAX_FIELDS, MAX_FIELD_BYTES = 32, 1024, 64, 127
ENTRY = "struct<type:string,num:double,str:string,bool:boolean>"
_BOUNDS = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_SCALAR = (str, int, float, bool, type(None))


def _entry(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    type_ = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(kind == "STRING", "string").when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), None).otherwise("number")
    return F.struct(
        type_.alias("type"),
        F.when(type_ == "number", F.try_variant_get(v, "$", "double")).alias("num"),
        F.when(type_.isin("string", "number"), F.try_variant_get(v, "$", "string")).alias("str"),
        F.when(type_ == "bool", F.try_variant_get(v, "$", "boolean")).alias("bool"),
    )


def entries(metadata: Column, field: str) -> Column:
    """The typed scalar entries of a dotted path; empty if the path is missing, an object or an empty array."""
    path = "$" + "".join(f"['{p}']" for p in field.split("."))
    m = F.try_parse_json(metadata)
    v = F.variant_get(m, path, "variant")
    many = F.try_variant_get(m, path, "array<variant>")
    items = F.when(v.isNull(), F.expr("cast(null as array<variant>)")).when(F.schema_of_variant(v).startswith("ARRAY"), many).otherwise(F.array(v))
    return F.coalesce(F.filter(F.transform(items, _entry), lambda e: e["type"].isNotNull()), F.expr(f"cast(array() as array<{ENTRY}>)"))


def metadata_map(metadata: Column, fields: list[str]) -> Column:
    if len(fields) > MAX_FIELDS or any(len(f.encode()) > MAX_FIELD_BYTES for f in fields):
        raise ValueError("too many or too long filterable fields")
    return F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[entries(metadata, f) for f in fields]))


def _equals(e: Column, value) -> Column:
    if value is None:
        return e["type"] == "null"
    if isinstance(value, bool):
        return (e["type"] == "bool") & (e["bool"] == value)
    if isinstance(value, str):
        return (e["type"] == "string") & (e["str"] == value)
    return (e["type"] == "number") & (e["num"] == float(value))


def compile_filter(node: dict, fields: list[str], over: str = "meta") -> Column:
    """A two-valued boolean Column for a filter node. ValueError if the node or a field is invalid."""
    nodes = 0

    def known(name) -> Column:
        if name not in fields:
            raise ValueError(f"unknown field {name!r}")
        return F.element_at(over, F.lit(name))

    def only(body, keys: set[str]) -> None:
        if not isinstance(body, dict) or set(body) != keys:
            raise ValueError(f"expected exactly {sorted(keys)}")

    def build(node, depth: int) -> Column:
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise ValueError("the filter is too deep or too large")
        if not isinstance(node, dict) or len(node) != 1:
            raise ValueError("a node has exactly one key")
        ((op, body),) = node.items()
        if op in ("and", "or"):
            if not isinstance(body, list) or not body:
                raise ValueError(f"{op} needs a list of nodes")
            parts = [build(x, depth + 1) for x in body]
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
        if op == "not":
            return ~build(body, depth + 1)
        if op == "exists":
            only(body, {"field"})
            return F.size(known(body["field"])) > 0
        if op == "eq":
            only(body, {"field", "value"})
            value = body["value"]
            if not isinstance(value, _SCALAR) or isinstance(value, float) and not math.isfinite(value):
                raise ValueError("eq compares with a scalar")
            return F.exists(known(body["field"]), lambda e: F.coalesce(_equals(e, value), F.lit(False)))
        if op == "in":
            only(body, {"field", "values"})
            values = body["values"]
            if not isinstance(values, list) or not values or not all(isinstance(v, _SCALAR) for v in values):
                raise ValueError("in needs a list of scalars")
            return F.exists(known(body["field"]), lambda e: F.coalesce(reduce(lambda a, b: a | b, [_equals(e, v) for v in values]), F.lit(False)))
        if op == "range":
            bounds = {k: v for k, v in body.items() if k != "field"} if isinstance(body, dict) else {}
            if not bounds or not set(bounds) <= set(_BOUNDS) or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in bounds.values()):
                raise ValueError("range needs a field and numeric bounds")
            return F.exists(known(body.get("field")), lambda e: F.coalesce(reduce(lambda a, b: a & b, [_BOUNDS[k](e["num"], float(v)) for k, v in bounds.items()], e["type"] == "number"), F.lit(False)))
        raise ValueError(f"unknown node {op!r}")

    return build(node, 1)
