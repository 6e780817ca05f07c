"""Writing: rows from constants, tables with differing fields put together, and the checks a write must pass."""

from __future__ import annotations

import datetime as dt
import difflib
import json
import secrets
from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.values import E, LanguageError


class Ref(str):
    """A reference written as such (``collection:key``)."""


def type_of(v: Any) -> T.DataType | None:
    """The type of a constant; None if its parts do not go together."""
    if v is None:
        return V.NULL
    if isinstance(v, bool):
        return V.BOOL
    if isinstance(v, int):
        return V.LONG
    if isinstance(v, float):
        return V.DOUBLE
    if isinstance(v, Decimal):
        return V.EXACT
    if isinstance(v, str):
        return V.STRING
    if isinstance(v, dt.datetime):
        return V.STAMP
    if isinstance(v, dt.timedelta):
        return V.DURATION
    if isinstance(v, (bytes, bytearray)):
        return V.BINARY
    if isinstance(v, (list, tuple)):
        inner = [type_of(x) for x in v]
        t = None if None in inner else V.common(inner)
        return None if t is None else T.ArrayType(t)
    if isinstance(v, dict):
        parts = {k: type_of(x) for k, x in v.items()}
        return None if None in parts.values() else T.StructType([T.StructField(k, t) for k, t in parts.items()])
    raise LanguageError(f"cannot store {type(v).__name__}")


def _fit(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(_fit(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [_fit(x, t.elementType) for x in v]
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.DecimalType):
        return Decimal(str(v)) if isinstance(v, float) else Decimal(v)
    if isinstance(t, T.StringType) and isinstance(v, str):
        return str(v)
    return v


def _json(v: Any) -> str:
    return json.dumps(v, default=lambda x: float(x) if isinstance(x, Decimal) else str(x))


def frame(spark: SparkSession, rows: list[dict[str, Any]], has: str | None = None) -> DataFrame:
    """A table of rows with differing fields; a field of mixed kinds becomes VARIANT.  ``has``: a column that lists each row's fields."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields, mixed = [], set()
    for n in names:
        each = [type_of(r[n]) for r in rows if n in r]
        t = None if None in each else V.common(each)
        if t is None:
            mixed.add(n)
            t = V.STRING
        fields.append(T.StructField(n, _stored(t)))
    data = [tuple(None if n not in r or r[n] is None else _json(r[n]) if n in mixed else _fit(r[n], f.dataType) for n, f in zip(names, fields)) + ((sorted(k for k in r if k != "id"),) if has else ()) for r in rows]
    schema = T.StructType(fields + ([T.StructField(has, T.ArrayType(V.STRING))] if has else []))
    df = spark.createDataFrame(data, schema)
    for n in mixed:
        df = df.withColumn(n, F.parse_json(F.col(f"`{n}`")))
    return df


def _stored(t: T.DataType) -> T.DataType:
    """Null types as strings: a table needs one."""
    if V.is_null(t):
        return V.STRING
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_stored(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _stored(f.dataType)) for f in t.fields])
    return t


def variant(e: E) -> Column:
    if isinstance(e.type, T.VariantType):
        return e.col
    return F.to_variant_object(e.col) if isinstance(e.type, (T.StructType, T.ArrayType, T.MapType)) else e.col.cast(T.VariantType())


def together(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of two tables; each column as wide as both need (VARIANT if nothing else fits)."""
    have_a, have_b = ({f.name: f.dataType for f in d.schema.fields} for d in (a, b))
    cols_a, cols_b = [], []
    for n in dict.fromkeys([*have_a, *have_b]):
        types = [h[n] for h in (have_a, have_b) if n in h]
        t = V.common(types) if not any(isinstance(x, T.VariantType) for x in types) else None
        for have, out in ((have_a, cols_a), (have_b, cols_b)):
            c = F.col(f"`{n}`")
            if n not in have:
                out.append(F.lit(None).cast(t if t is not None else T.VariantType()).alias(n))
            else:
                out.append((variant(E(c, have[n])) if t is None else V.widened(E(c, have[n]), t)).alias(n))
    return a.select(*cols_a).unionByName(b.select(*cols_b))


def new_key() -> str:
    return secrets.token_hex(11)[:21]


def document_id(collection: str, given: Any) -> str:
    """``collection:key`` from an ``id`` field (string, int or float), or a new one."""
    if given is None:
        return f"{collection}:{new_key()}"
    if isinstance(given, bool) or not isinstance(given, (str, int, float)):
        raise LanguageError("an id is a string or a number")
    key = str(given)
    key = key[len(collection) + 1 :] if key.startswith(collection + ":") else key
    if not key or ":" in key:
        raise LanguageError(f"{key!r} is no key")
    return f"{collection}:{key}"


# ---- checks


def fits(types: list[tuple], t: T.DataType) -> bool:
    return any(_fits(x, t) for x in types)


def _fits(x: tuple, t: T.DataType) -> bool:
    if V.is_null(t) or x[0] == "any":
        return True
    if isinstance(t, T.VariantType):
        return True
    word = V.type_word(t)
    if x[0] == "array":
        return isinstance(t, T.ArrayType) and (len(x) < 2 or _fits(x[1], t.elementType))
    if x[0] == "object":
        if not isinstance(t, T.StructType):
            return False
        own = {f["name"]: f for f in (x[1] if len(x) > 1 else [])}
        if len(x) > 2 and x[2] == "STRICT" and any(n not in own and n != "_" for n in t.names):
            return False
        return all(fits(own[f.name]["types"], f.dataType) for f in t.fields if f.name in own)
    if x[0] == "ref":
        return word == "string"
    if x[0] == "range":
        return isinstance(t, T.StructType)
    ok = {"float": ("float", "int"), "decimal": ("decimal", "int", "float"), "datetime": ("datetime", "string", "int"), "null": ("null",)}.get(x[0], (x[0],))
    return word in ok


def validate(df: DataFrame, fields: Iterable[dict], strict: bool) -> None:
    """Raise unless the rows keep to the declared fields."""
    own = {f["name"]: f for f in fields}
    have = {f.name: f.dataType for f in df.schema.fields if not f.name.startswith("__") and f.name != "id"}
    for n, t in have.items():
        if n not in own:
            if strict:
                near = difflib.get_close_matches(n, own, 1)
                raise LanguageError(f"unknown field {n}" + (f"; did you mean {near[0]}?" if near else ""))
        elif not fits(own[n]["types"], t):
            raise LanguageError(f"field {n} is {V.type_word(t)}, not {' or '.join(x[0] for x in own[n]['types'])}")
    bad = F.lit(False)
    told: list[str] = []
    for n, f in own.items():
        c = F.col(f"`{n}`") if n in have else F.lit(None)
        if f["required"]:
            bad = bad | c.isNull()
            told.append(n)
        for x in f["types"]:
            if x[0] == "ref" and x[1] and n in have and len(f["types"]) == 1:
                bad = bad | (c.isNotNull() & ~c.startswith(x[1] + ":"))
                told.append(n)
    if told and df.where(bad).limit(1).count():
        raise LanguageError(f"a required field is missing or a reference points elsewhere ({', '.join(dict.fromkeys(told))})")


def dimension(df: DataFrame, field: str, size: int | None) -> None:
    """Fail if a vector has not the number of entries that its index was made for."""
    kind = next((f.dataType for f in df.schema.fields if f.name == field), None)
    if size is None or kind is None or isinstance(kind, T.NullType):
        return
    if not isinstance(kind, T.ArrayType) or df.where(F.size(F.col(f"`{field}`")) != size).limit(1).count():
        raise LanguageError(f"{field} has to have {size} entries")


def unique(df: DataFrame, fields: Iterable[str]) -> None:
    """Raise if two rows agree in all of the fields (none of them null)."""
    cols = [F.col(f) for f in fields]
    d = df
    for c in cols:
        d = d.where(c.isNotNull())
    if d.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise LanguageError(f"unique constraint on {', '.join(fields)} violated")


def merged(old: DataFrame, new: DataFrame, key: str = "id", replace: bool = False) -> DataFrame:
    """An upsert of whole tables: rows of ``new`` replace those of ``old``, or (merge) fill in what they give."""
    if replace:
        return together(old.join(new.select(key), key, "left_anti"), new)
    shared = [c for c in old.columns if c in new.columns and c != key]
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")) if c in shared or c == key else F.col(f"o.`{c}`") if c in old.columns else F.col(f"n.`{c}`")
    return j.select(*[pick(c).alias(c) for c in dict.fromkeys([*old.columns, *new.columns])])
