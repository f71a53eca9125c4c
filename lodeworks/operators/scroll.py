"""Ordered scrolling with resumable cursors."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.filters import compile_filter, fields_of


class CursorError(ValueError):
    """A cursor or an order that cannot be used."""


@dataclass(frozen=True)
class Key:
    """An order key: a column, its kind (numeric, string, datetime) and direction."""

    field: str
    kind: str = "numeric"
    desc: bool = False

    def value(self) -> Column:
        c = F.col(self.field)
        if self.kind == "datetime":
            return F.unix_millis(c.cast("timestamp"))
        return c if self.kind == "string" else c.cast("double")


def parse_order(order: list[dict] | None) -> list[Key]:
    keys = []
    for x in order or ():
        if not x.get("field") or x.get("kind", "numeric") not in ("numeric", "string", "datetime"):
            raise CursorError(f"bad order key {x!r}")
        keys.append(Key(x["field"], x.get("kind", "numeric"), bool(x.get("desc", False))))
    if len({k.field for k in keys}) != len(keys):
        raise CursorError("an order key repeats")
    return keys


def _hash(keys: list[Key]) -> str:
    return hashlib.sha256(json.dumps([[k.field, k.kind, k.desc] for k in keys]).encode()).hexdigest()[:12]


def encode_cursor(keys: list[Key], values: list, last_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": _hash(keys), "v": values, "i": last_id}).encode()).decode()


def decode_cursor(token: str, keys: list[Key]) -> tuple[list, int]:
    try:
        found = json.loads(base64.urlsafe_b64decode(token.encode()))
        values, last_id, order = found["v"], found["i"], found["o"]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("not a cursor") from e
    if order != _hash(keys) or len(values) != len(keys):
        raise CursorError("the cursor belongs to another order")
    return values, last_id


def _after(keys: list[Key], values: list, last_id: int) -> Column:
    """Strictly after (k1, ..., kn, id): an OR of prefixes."""
    out, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, values):
        bound = F.lit(v if k.kind == "string" else float(v))
        value = k.value() if k.kind == "string" else k.value().cast("double")
        out = out | (equal & ((value < bound) if k.desc else (value > bound)))
        equal = equal & (value == bound)
    return out | (equal & (F.col("id") > last_id))


def ordered(df: DataFrame, order: list[dict] | None) -> tuple[DataFrame, list[Column], list[Key]]:
    """Rows that have every key (NaN is none), and the sort columns; ids ascend even where keys descend."""
    keys = parse_order(order)
    for k in keys:
        v = k.value()
        df = df.where(v.isNotNull() & (~F.isnan(v) if k.kind == "numeric" else F.lit(True)))
    return df, [*(k.value().desc() if k.desc else k.value().asc() for k in keys), F.col("id").asc()], keys


def scroll(df: DataFrame, limit: int, order: list[dict] | None = None, filter=None, cursor: str | None = None, after_id: int | None = None, start_from=None) -> DataFrame:
    """The next ``limit`` + 1 rows at most in order; the row over ``limit`` says that more follow (``page`` reads it)."""
    if filter:
        df = df.where(compile_filter(filter, fields_of(df)))
    df, sort, keys = ordered(df, order)
    if start_from is not None:
        if len(keys) != 1 or keys[0].kind == "string":
            raise CursorError("start_from takes one numeric or datetime key")
        bound = F.lit(float(start_from))
        df = df.where(keys[0].value() <= bound if keys[0].desc else keys[0].value() >= bound)
    if cursor:
        df = df.where(_after(keys, *decode_cursor(cursor, keys)))
    elif after_id is not None:
        df = df.where(F.col("id") > after_id)
    return df.orderBy(*sort).limit(limit + 1)


def page(df: DataFrame, limit: int, order: list[dict] | None = None, **more) -> tuple[list, str | None]:
    """A page's rows and the cursor of the next one, None at the end. The page is bounded by ``limit``."""
    keys = parse_order(order)
    values = [k.value().alias(f"__{i}") for i, k in enumerate(keys)]
    rows = scroll(df, limit, order, **more).select("*", *values).collect()
    if len(rows) <= limit:
        return rows, None
    last = rows[limit - 1]
    return rows[:limit], encode_cursor(keys, [last[f"__{i}"] for i in range(len(keys))], last["id"])
