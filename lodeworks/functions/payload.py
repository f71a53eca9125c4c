"""Tagged payload values: JSON objects with a ``kind`` and one member that holds the value, as maps of structs on Spark's side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds and the member that holds each one's value ("none" has no member).
KINDS = ("none", "string", "int", "float", "bool", "strings", "ints", "floats", "geo")
MEMBERS = {"string": "str", "int": "int", "float": "flt", "bool": "bool", "strings": "strs", "ints": "ints", "floats": "flts"}

VALUE = "struct<kind:string,str:string,int:bigint,flt:double,bool:boolean,strs:array<string>,ints:array<bigint>,flts:array<double>,lat:double,lon:double>"
PAYLOAD = f"map<string,{VALUE}>"

_ZERO = {"string": "", "int": 0, "float": 0.0, "bool": False, "strings": [], "ints": [], "floats": []}


class PayloadError(ValueError):
    """A value that is no tagged value."""


def encode(value) -> dict:
    """The tagged form of a Python value. A dictionary of lat and lon is a geo value; a list is of one kind and not empty."""
    if value is None:
        return {"kind": "none"}
    if isinstance(value, dict):
        if set(value) != {"lat", "lon"}:
            raise PayloadError(f"no payload value: {value!r}")
        return {"kind": "geo", **{k: float(v) for k, v in value.items() if v}}
    kind = _kind(value)
    return {"kind": kind, MEMBERS[kind]: list(value) if kind.endswith("s") else value}


def _kind(value) -> str:
    for python, kind in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string")):
        if isinstance(value, python):
            return kind
    if isinstance(value, (list, tuple)):
        kinds = {_kind(x) for x in value}
        if len(kinds) == 1 and kinds < {"string", "int", "float"}:
            return kinds.pop() + "s"
    raise PayloadError(f"no payload value: {value!r}")


def decode(tagged: dict):
    """The Python value of a tagged one."""
    kind = tagged.get("kind")
    if kind not in KINDS or set(tagged) - {"kind", "lat", "lon", *MEMBERS.values()}:
        raise PayloadError(f"no tagged value: {tagged!r}")
    if kind == "none":
        return None
    if kind == "geo":
        return {"lat": float(tagged.get("lat", 0.0)), "lon": float(tagged.get("lon", 0.0))}
    value = tagged.get(MEMBERS[kind], _ZERO[kind])
    return float(value) if kind == "float" else [float(x) for x in value] if kind == "floats" else value


def tagged(value: Column, kind: str) -> Column:
    """A column as a tagged value of one kind; null becomes the kind none."""
    empty = {name: F.lit(None) for name in ("str", "int", "flt", "bool", "strs", "ints", "flts", "lat", "lon")}
    held = empty if kind == "none" else empty | ({"lat": value["lat"], "lon": value["lon"]} if kind == "geo" else {MEMBERS[kind]: value})
    fields = [F.when(value.isNull(), F.lit("none")).otherwise(F.lit(kind)).alias("kind"), *(c.alias(n) for n, c in held.items())]
    return F.struct(*fields).cast(VALUE)


def tagged_map(**values: tuple[Column, str]) -> Column:
    """A payload map of named columns with their kinds."""
    return F.create_map(*[x for name, (value, kind) in values.items() for x in (F.lit(name), tagged(value, kind))])


def to_json(payload: Column) -> Column:
    """A payload map as JSON text; members that a kind does not use are left out."""
    return F.to_json(payload)


def from_json(text: Column) -> Column:
    """JSON text as a payload map; a zero value whose member was left out is filled in."""
    zero = {"str": F.lit(""), "int": F.lit(0).cast("long"), "flt": F.lit(0.0), "bool": F.lit(False)}
    kinds = {"str": "string", "int": "int", "flt": "float", "bool": "bool"}

    def fill(_, v: Column) -> Column:
        for name, default in zero.items():
            v = v.withField(name, F.when(v["kind"] == kinds[name], F.coalesce(v[name], default)))
        for name in ("lat", "lon"):
            v = v.withField(name, F.when(v["kind"] == "geo", F.coalesce(v[name], F.lit(0.0))))
        for name, kind, element in (("strs", "strings", "string"), ("ints", "ints", "bigint"), ("flts", "floats", "double")):
            v = v.withField(name, F.when(v["kind"] == kind, F.coalesce(v[name], F.array().cast(f"array<{element}>"))))
        return v

    return F.transform_values(F.from_json(text, PAYLOAD), fill)
