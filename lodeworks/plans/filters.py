"""The filter language: a JSON tree or Python helpers -> one boolean Column.

Two-valued: a leaf over a missing field or another kind is false, and ``not`` turns it into true. Fields are columns, any expressions
with a presence flag (since "present but null" and "absent" differ), or entries of a map of tagged values, whose kind may differ by row.

A group holds its members under its own name: ``{"op": "and", "and": [...]}``, ``{"op": "or", "or": [...]}``, ``{"op": "not", "not": {...}}``; the
helpers write ``filters``, a list, for all three. A leaf's value is plain or tagged (``{"kind": "string", "str": "x"}``), a geo leaf has its region
inline or under ``geo``. ``{}`` and ``{"op": "and"}`` match all. Any other member is an error: a filter is never widened in silence.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payload as P
from ..functions import vectors as V

LEAVES = {
    "eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "match", "regex", "is_empty", "is_null",
    "dt_gt", "dt_gte", "dt_lt", "dt_lte", "geo_radius", "geo_bounding_box", "geo_polygon",
}
GROUPS = {"and", "or", "not"}
WORD_GAP = r"[^\p{L}\p{Nd}]+"


class FilterError(ValueError):
    """A filter that cannot be compiled."""


@dataclass(frozen=True)
class Field:
    """One payload field: its expression, its kind and where it is present."""

    value: Column
    kind: str  # string int float bool strings ints floats geo
    present: Column
    filled: bool = True  # present implies that the value is not null


@dataclass(frozen=True)
class Tagged:
    """An entry of a payload map of tagged values."""

    payload: Column
    name: str

    def of_kind(self, *kinds: str) -> list[Field]:
        entry = self.payload[self.name]
        value = {kind: F.struct(entry["lat"].alias("lat"), entry["lon"].alias("lon")) if kind == "geo" else entry[P.MEMBERS[kind]] for kind in kinds}
        return [Field(value[kind], kind, certain(entry["kind"] == kind)) for kind in kinds]

    @property
    def present(self) -> Column:
        return certain(F.map_contains_key(self.payload, self.name))

    @property
    def kind(self) -> Column:
        return self.payload[self.name]["kind"]


class TaggedFields(dict):
    """Fields of a payload map: any name may be asked for."""

    def __init__(self, payload: Column):
        super().__init__()
        self.payload = payload

    def get(self, name, default=None):
        return Tagged(self.payload, name)


_KINDS = {T.StringType: "string", T.BooleanType: "bool", T.DoubleType: "float", T.FloatType: "float", T.DecimalType: "float"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.ArrayType):
        return {"string": "strings", "int": "ints", "float": "floats"}.get(kind_of(t.elementType), "other")
    if isinstance(t, T.StructType) and {"lat", "lon"} <= set(t.names):
        return "geo"
    return next((k for c, k in _KINDS.items() if isinstance(t, c)), "other")


def fields_of(df: DataFrame, nulls: str = "absent") -> dict[str, Field]:
    """A field for each column; ``nulls`` says whether a null is an absent field or a present null."""
    out = {}
    for f in df.schema.fields:
        column, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        if kind == "time":  # datetimes are unix milliseconds
            column, kind = F.unix_millis(column.cast("timestamp")), "int"
        out[f.name] = Field(column, kind, F.lit(True) if nulls == "present" else column.isNotNull(), nulls != "present")
    return out


def _literal_kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    raise FilterError(f"no scalar: {value!r}")


def certain(x: Column) -> Column:
    """False for null: what a negation needs. Elsewhere null counts as false anyway, and plain predicates reach the scan."""
    return F.coalesce(x, F.lit(False))


def _is_nan(f: Field) -> Column:
    return F.isnan(f.value.cast("double")) if f.kind == "float" else F.lit(False)


def _equal(f: Field, value) -> Column:
    """Present, of the same kind and equal; NaN equals nothing."""
    if f.kind != _literal_kind(value) or isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    return f.present & (f.value == F.lit(value))  # the value is no NaN, so a NaN field differs from it


def _ordered(f: Field, op: str, value) -> Column:
    kind = _literal_kind(value)
    numeric = f.kind in ("int", "float") and kind in ("int", "float")
    if not numeric and not (f.kind == kind == "string") or isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    plain = f.kind == kind or f.kind == "float"  # else a whole number meets a fraction, both as doubles
    left, right = (f.value, F.lit(value)) if plain else (f.value.cast("double"), F.lit(float(value)))
    test = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
    if op in ("gt", "gte") and f.kind == "float":
        test = test & ~_is_nan(f)  # NaN is largest in Spark's order
    return f.present & test


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def _match(f: Field, query: str) -> Column:
    wanted = F.array_distinct(words_of(F.lit(query)))
    holds = lambda text: F.size(F.array_except(wanted, words_of(text))) == 0
    if f.kind == "string":
        return f.present & holds(f.value)
    return f.present & F.exists(f.value, holds) if f.kind == "strings" else F.lit(False)


def _regex(f: Field, pattern: str) -> Column:
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise FilterError("look-around and back references are not part of the language")
    pattern = pattern.replace("(?P<", "(?<")
    try:
        re.compile(pattern.replace("(?<", "(?P<"))
    except re.error as e:
        raise FilterError(str(e)) from e
    if f.kind == "string":
        return f.present & f.value.rlike(pattern)
    return f.present & F.exists(f.value, lambda x: x.rlike(pattern)) if f.kind == "strings" else F.lit(False)


def _millis(text: str) -> int:
    try:
        return round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)
    except ValueError as e:
        raise FilterError(f"no RFC 3339 time: {text!r}") from e


def _position(f: Field) -> tuple[Column, Column]:
    return f.value["lat"].cast("double"), f.value["lon"].cast("double")


def _geo(op: str, f: Field, spec: dict) -> Column:
    if f.kind != "geo":
        return F.lit(False)
    lat, lon = _position(f)
    if op == "geo_radius":
        y, x, r = float(spec["lat"]), float(spec["lon"]), float(spec["radius_m"])
        if not (math.isfinite(r) and r > 0 and abs(y) <= 90 and abs(x) <= 180):
            raise FilterError("bad circle")
        near = V.haversine_m(lat, lon, F.lit(y), F.lit(x)) <= r
        if box := V.radius_box(y, x, r):  # a cheap test that a scan can use, before the trigonometry
            near = lat.between(box[0], box[2]) & lon.between(box[1], box[3]) & near
        return f.present & near
    if op == "geo_bounding_box":
        a, b, c, d = (float(spec[k]) for k in ("min_lat", "min_lon", "max_lat", "max_lon"))
        if a > c or b > d:
            raise FilterError("an empty box, or one across the antimeridian")
        return f.present & lat.between(a, c) & lon.between(b, d)
    flat = [float(x) for x in spec["polygon"]]
    if len(flat) % 2 or len(flat) < 6:
        raise FilterError("a polygon has three corners at least")
    return f.present & V.in_polygon(lat, lon, list(zip(flat[::2], flat[1::2])))


_VALUED = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "match", "regex", "in", "dt_gt", "dt_gte", "dt_lt", "dt_lte")
_REGION = ("lat", "lon", "radius_m", "min_lat", "min_lon", "max_lat", "max_lon", "polygon")
_NEEDED = {"geo_radius": ("lat", "lon", "radius_m"), "geo_bounding_box": ("min_lat", "min_lon", "max_lat", "max_lon"), "geo_polygon": ("polygon",)}


def _plain(value):
    """A leaf's value, tagged or not."""
    if not isinstance(value, dict):
        return value
    try:
        return P.decode(value)
    except P.PayloadError as e:
        raise FilterError(str(e)) from e


def _known(node: dict, *allowed: str) -> None:
    """Members other than ``op`` must be among ``allowed``; an empty tagged value may stand anywhere."""
    odd = [k for k, v in node.items() if k != "op" and k not in allowed and not (k == "value" and v == {"kind": "none"}) and not (k == "field" and v == "")]
    if odd:
        raise FilterError(f"{node.get('op')} takes no {', '.join(map(repr, odd))}")


def _region(node: dict) -> dict:
    """The region of a geo leaf, inline or under ``geo``; coordinates that a ``geo`` leaves out are 0."""
    if "geo" in node:
        geo = dict(node["geo"])
        spec = {k.removeprefix("center_"): v for k, v in geo.items()}
        if odd := set(spec) - set(_REGION):
            raise FilterError(f"geo takes no {', '.join(sorted(odd))}")
        spec = {k: 0.0 for k in _REGION if k not in ("radius_m", "polygon")} | spec
    else:
        spec = node
    if missing := [k for k in _NEEDED[node["op"]] if k not in spec]:
        raise FilterError(f"{node['op']} needs {', '.join(missing)}")
    return spec


def _leaf(node: dict, fields: dict[str, Field]) -> Column:
    op, name = node["op"], node.get("field")
    if not name:
        raise FilterError(f"{op} needs a field")
    _known(node, "field", *(("value",) if op in _VALUED else ("geo", *_REGION) if op.startswith("geo_") else ()))
    if op in _VALUED and "value" not in node:
        raise FilterError(f"{op} needs a value")
    value = _plain(node.get("value"))
    if op == "in" and not isinstance(value, (list, tuple)):
        raise FilterError("in needs a list")
    if op not in ("in",) and isinstance(value, (list, tuple)):
        raise FilterError(f"{op} takes no list")
    if op in ("match", "regex") and not isinstance(value, str) or op.startswith("dt_") and not isinstance(value, str):
        raise FilterError(f"{op} needs a text")
    spec = _region(node) if op.startswith("geo_") else node
    f = fields.get(name)
    if f is None:
        return F.lit(op == "is_empty")
    return _tagged_test(op, f, value, spec) if isinstance(f, Tagged) else _test(op, f, value, spec)


def _tagged_test(op: str, f: Tagged, value, spec: dict) -> Column:
    """A leaf over a tagged entry: the tests of the kinds that the leaf may meet, each where the entry is of that kind."""
    if op == "is_null":
        return f.present & certain(f.kind == "none")
    if op == "is_empty":
        hollow = [certain(_test("is_empty", x, None, spec)) & x.present for x in f.of_kind("string", "strings", "ints", "floats")]
        return reduce(lambda a, b: a | b, hollow, ~f.present | certain(f.kind == "none"))
    if op == "ne":
        return f.present & ~certain(_tagged_test("eq", f, value, spec))
    kinds = {"geo_": ("geo",), "dt_": ("int", "float"), "match": ("string", "strings"), "regex": ("string", "strings"), "contains": ("strings", "ints", "floats")}
    found = next((v for k, v in kinds.items() if op.startswith(k)), ("string", "int", "float", "bool"))
    return certain(reduce(lambda a, b: a | b, [certain(_test(op, x, value, spec)) for x in f.of_kind(*found)]))


def _test(op: str, f: Field, value, spec: dict) -> Column:
    if op == "eq":
        return _equal(f, value)
    if op == "ne":
        same = _equal(f, value)
        return f.present & ~(same if f.filled else certain(same))
    if op in ("gt", "gte", "lt", "lte"):
        return _ordered(f, op, value)
    if op == "in":
        same = [x for x in value if _literal_kind(x) == f.kind and not (isinstance(x, float) and math.isnan(x))]
        return f.present & f.value.isin(*same) if same else F.lit(False)
    if op == "contains":
        if f.kind != _literal_kind(value) + "s" or isinstance(value, float) and math.isnan(value):
            return F.lit(False)
        return f.present & F.array_contains(f.value, F.lit(value))
    if op == "match":
        return _match(f, value)
    if op == "regex":
        return _regex(f, value)
    if op == "is_null":
        return f.present & f.value.isNull()
    if op == "is_empty":
        hollow = f.value.isNull()
        if f.kind == "string":
            hollow = hollow | (f.value == "")
        elif f.kind in ("strings", "ints", "floats"):
            hollow = hollow | (F.size(f.value) == 0)
        return ~f.present | F.coalesce(hollow, F.lit(True))
    if op.startswith("dt_"):
        return _ordered(f, op[3:], _millis(value)) if f.kind in ("int", "float") else F.lit(False)
    return _geo(op, f, spec)


def _members(node: dict) -> list[dict]:
    """A group's members."""
    op = node["op"]
    _known(node, op, "filters")
    if op in node and "filters" in node:
        raise FilterError(f"{op} has its members twice")
    found = node.get(op, node.get("filters"))
    if found is None:
        if op == "and":
            return []
        raise FilterError(f"{op} needs its members")
    found = [found] if isinstance(found, dict) else found
    if not isinstance(found, (list, tuple)) or not all(isinstance(x, dict) for x in found):
        raise FilterError(f"{op} needs filters as its members")
    return list(found)


def compile_filter(tree: dict | str | None, fields: dict[str, Field]) -> Column:
    """The predicate of a filter tree, for use in ``where``; an empty tree matches all."""
    try:
        node = json.loads(tree) if isinstance(tree, str) else tree
    except ValueError as e:
        raise FilterError(f"no JSON: {e}") from e
    if not node:
        return F.lit(True)
    if not isinstance(node, dict):
        raise FilterError(f"no filter: {node!r}")
    op = node.get("op")
    if op in GROUPS:
        parts = [compile_filter(x, fields) for x in _members(node)]
        if op == "and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        if op == "or":
            return reduce(lambda a, b: a | b, parts, F.lit(False))
        if len(parts) != 1:
            raise FilterError("not needs one filter")
        return ~certain(parts[0])
    if op not in LEAVES:
        raise FilterError(f"unknown operator {op!r}")
    return _leaf(node, fields)


def hollow(tree: dict | str | None) -> bool:
    """Whether a tree says nothing: it is empty, or a group without members."""
    node = json.loads(tree) if isinstance(tree, str) else tree
    return not node or node.get("op") in ("and", "or") and not _members(node)


def where(df: DataFrame, tree: dict | str | None, nulls: str = "absent") -> DataFrame:
    return df.where(compile_filter(tree, fields_of(df, nulls)))


def where_tagged(df: DataFrame, tree: dict | str | None, payload: str = "payload") -> DataFrame:
    """``where`` over a map of tagged values."""
    return df.where(compile_filter(tree, TaggedFields(F.col(payload))))


# filters of other libraries as trees


def from_conditions(filters: dict) -> dict:
    """A tree of a condition dictionary: ``{"field": ..., "operator": "==", "value": ...}`` leaves in ``{"operator": "AND", "conditions": [...]}`` groups."""
    op = filters.get("operator")
    if "conditions" in filters:
        parts = [from_conditions(x) for x in filters["conditions"]]
        if op == "NOT":
            return not_(and_(*parts))
        if op not in ("AND", "OR"):
            raise FilterError(f"unknown operator {op!r}")
        return and_(*parts) if op == "AND" else or_(*parts)
    name, value = filters.get("field", "").removeprefix("meta."), filters.get("value")
    # The comparison operators of condition dictionaries.
    plain = {"==": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "in": "in"}
    if op == "not in":
        return not_(in_(name, value))
    if op not in plain:
        raise FilterError(f"unknown operator {op!r}")
    return leaf(plain[op], name, value)


def from_equalities(filters: dict) -> dict:
    """A tree of ``{"field": value}``: equality, membership for a list, or operators as ``{"$gte": 3}``."""
    # The dollar operators.
    plain = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte", "$in": "in"}
    parts = []
    for name, value in filters.items():
        if name in ("$and", "$or"):
            parts.append((and_ if name == "$and" else or_)(*map(from_equalities, value)))
        elif isinstance(value, dict):
            if odd := set(value) - set(plain) - {"$nin"}:
                raise FilterError(f"unknown operator {sorted(odd)[0]!r}")
            parts += [not_(in_(name, v)) if op == "$nin" else leaf(plain[op], name, v) for op, v in value.items()]
        else:
            parts.append(in_(name, value) if isinstance(value, (list, tuple)) else eq(name, value))
    return parts[0] if len(parts) == 1 else and_(*parts)


# helpers that build trees


def leaf(op: str, field: str, value=None, **more) -> dict:
    return {"op": op, "field": field, **({"value": value} if value is not None else {}), **more}


def eq(field, value):
    return leaf("eq", field, value)


def ne(field, value):
    return leaf("ne", field, value)


def gt(field, value):
    return leaf("gt", field, value)


def gte(field, value):
    return leaf("gte", field, value)


def lt(field, value):
    return leaf("lt", field, value)


def lte(field, value):
    return leaf("lte", field, value)


def in_(field, values):
    return leaf("in", field, list(values))


def contains(field, value):
    return leaf("contains", field, value)


def and_(*filters):
    return {"op": "and", "filters": list(filters)}


def or_(*filters):
    return {"op": "or", "filters": list(filters)}


def not_(one):
    return {"op": "not", "filters": [one]}
