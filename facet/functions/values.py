"""Typed expressions and the language's value semantics: truthiness, comparison, arithmetic, access."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LanguageError(ValueError):
    """A statement that parses but has no meaning: wrong types, unknown names, misplaced clauses."""


@dataclass(frozen=True)
class E:
    """A column expression and its static type."""

    col: Column
    type: T.DataType

    def cast(self, t: T.DataType | str) -> Column:
        return self.col.cast(t)


LONG, DOUBLE, STRING, BOOL, NULL, BINARY = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType(), T.BinaryType()
DURATION, STAMP = T.DayTimeIntervalType(), T.TimestampType()
SUMMED, EXACT = T.DecimalType(38, 0), T.DecimalType(28, 10)


def is_int(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_decimal(t: T.DataType) -> bool:
    return isinstance(t, T.DecimalType)


def is_number(t: T.DataType) -> bool:
    return is_int(t) or is_float(t) or is_decimal(t)


def is_stamp(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def type_word(t: T.DataType) -> str:
    for test, name in ((is_int, "int"), (is_float, "float"), (is_decimal, "decimal"), (is_stamp, "datetime"), (is_null, "null")):
        if test(t):
            return name
    return {T.StringType: "string", T.BooleanType: "bool", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.BinaryType: "bytes", T.DayTimeIntervalType: "duration", T.VariantType: "any"}.get(type(t), t.simpleString())


def literal(v: Any) -> E:
    """A constant from a Python value."""
    if v is None:
        return E(F.lit(None), NULL)
    if isinstance(v, bool):
        return E(F.lit(v), BOOL)
    if isinstance(v, int):
        return E(F.lit(v).cast(LONG), LONG)
    if isinstance(v, float):
        return E(F.lit(v), DOUBLE)
    if isinstance(v, Decimal):
        digits = max(-v.as_tuple().exponent, 0)
        t = T.DecimalType(28, min(digits, 28))
        return E(F.lit(str(v)).cast(t), t)
    if isinstance(v, str):
        return E(F.lit(v), STRING)
    if isinstance(v, dt.datetime):
        return E(F.lit(v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)), STAMP)
    if isinstance(v, dt.timedelta):
        return E(F.lit(v), DURATION)
    if isinstance(v, (bytes, bytearray)):
        return E(F.unhex(F.lit(bytes(v).hex())), BINARY)
    if isinstance(v, (list, tuple)):
        return array([literal(x) for x in v])
    if isinstance(v, dict):
        return obj([(k, literal(x)) for k, x in v.items()])
    raise LanguageError(f"no literal for {type(v).__name__}")


def duration(nanos: int) -> E:
    return literal(dt.timedelta(microseconds=nanos // 1000))


def common(types: list[T.DataType]) -> T.DataType | None:
    """The type all of these widen to, or None."""
    real = [t for t in types if not is_null(t)]
    if not real:
        return NULL
    if all(is_int(t) for t in real):
        return LONG
    if all(is_number(t) for t in real):
        return DOUBLE if any(is_float(t) for t in real) else EXACT
    if all(is_stamp(t) for t in real):
        return real[0] if len(set(map(str, real))) == 1 else STAMP
    if all(isinstance(t, T.ArrayType) for t in real):
        inner = common([t.elementType for t in real])
        return None if inner is None else T.ArrayType(inner)
    if all(isinstance(t, T.StructType) for t in real):
        names = list(dict.fromkeys(f.name for t in real for f in t.fields))
        fields = []
        for n in names:
            inner = common([t[n].dataType for t in real if n in t.names])
            if inner is None:
                return None
            fields.append(T.StructField(n, inner))
        return T.StructType(fields)
    return real[0] if all(t == real[0] for t in real) else None


def widened(e: E, t: T.DataType) -> Column:
    """``e`` as type ``t``, filling struct fields that it lacks with nulls."""
    if isinstance(t, T.StructType) and isinstance(e.type, T.StructType):
        have = {f.name: f.dataType for f in e.type.fields}
        made = F.struct(*[(widened(E(e.col[f.name], have[f.name]), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in t.fields])
        return F.when(e.col.isNull(), F.lit(None).cast(t)).otherwise(made)
    if isinstance(t, T.ArrayType) and isinstance(e.type, T.ArrayType) and e.type.elementType != t.elementType:
        return F.transform(e.col, lambda x: widened(E(x, e.type.elementType), t.elementType))
    return e.col if e.type == t else e.col.cast(t)


def array(items: list[E]) -> E:
    t = common([i.type for i in items])
    if t is None:  # mixed kinds
        t = T.VariantType()
        return E(F.array(*[F.to_variant_object(i.col) if isinstance(i.type, (T.StructType, T.ArrayType)) else i.col.cast(t) for i in items]), T.ArrayType(t))
    return E(F.array(*[widened(i, t) for i in items]) if items else F.array().cast(T.ArrayType(NULL)), T.ArrayType(t))


def obj(items: list[tuple[str, E]]) -> E:
    last = dict(items)
    if not last:
        return E(F.struct(F.lit(None).alias("_")), T.StructType([T.StructField("_", NULL)]))
    return E(F.struct(*[e.col.alias(k) for k, e in last.items()]), T.StructType([T.StructField(k, e.type) for k, e in last.items()]))


# ---- truth


def truthy(e: E) -> Column:
    """Null, false, zero and whatever is empty are false; never null."""
    t, c = e.type, e.col
    if is_null(t):
        return F.lit(False)
    if isinstance(t, T.BooleanType):
        v = c
    elif is_number(t):
        v = c != F.lit(0)
    elif isinstance(t, T.StringType):
        v = c != F.lit("")
    elif isinstance(t, (T.ArrayType, T.MapType)):
        v = F.size(c) > 0
    elif isinstance(t, T.BinaryType):
        v = F.octet_length(c) > 0
    elif isinstance(t, T.DayTimeIntervalType):
        v = c != F.lit(dt.timedelta(0))
    elif isinstance(t, T.VariantType):
        v = ~F.coalesce(F.try_variant_get(c, "$", "string"), F.lit("")).isin("", "false", "0", "0.0") & ~F.to_json(c).isin("[]", "{}")
    elif isinstance(t, T.StructType) and t.names == ["_"]:
        v = F.lit(False)
    else:
        v = c.isNotNull()
    return F.coalesce(v, F.lit(False))


def logic(op: str, a: E, b: E) -> E:
    for e in (a, b):
        if not isinstance(e.type, (T.BooleanType, T.NullType)):
            raise LanguageError(f"{op} needs booleans, not {type_word(e.type)}")
    x, y = a.cast(BOOL), b.cast(BOOL)
    return E(x & y if op == "AND" else x | y, BOOL)


def negate(e: E) -> E:
    if not isinstance(e.type, (T.BooleanType, T.NullType)):
        raise LanguageError(f"NOT needs a boolean, not {type_word(e.type)}")
    return E(~e.cast(BOOL), BOOL)


# ---- comparison


def _comparable(a: T.DataType, b: T.DataType, ordering: bool) -> bool:
    return is_number(a) and is_number(b) or is_stamp(a) and is_stamp(b) or type(a) is type(b) and isinstance(a, (T.StringType, T.BooleanType)) or type(a) is type(b) is T.DayTimeIntervalType and ordering


def compare(op: str, a: E, b: E) -> E:
    """Kinds that do not compare are unequal, and neither less nor greater; null if either is null."""
    if is_null(a.type) or is_null(b.type):
        return E(F.lit(None).cast(BOOL), BOOL)
    if isinstance(a.type, T.VariantType) ^ isinstance(b.type, T.VariantType):
        v, other, flip = (a, b, False) if isinstance(a.type, T.VariantType) else (b, a, True)
        word = "decimal(38,10)" if is_number(other.type) and not is_float(other.type) else other.type.simpleString()
        kind = F.schema_of_variant(v.col)
        numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        fits = numeric if is_number(other.type) else kind == F.lit(other.type.simpleString().upper())
        got = E(F.when(fits, F.try_variant_get(v.col, "$", word)), T.DecimalType(38, 10) if word.startswith("dec") else other.type)
        same = compare(op, other, got) if flip else compare(op, got, other)
        return E(F.when(F.is_variant_null(v.col) | v.col.isNull() | other.col.isNull(), F.lit(None).cast(BOOL)).otherwise(F.coalesce(same.col, F.lit(op == "!="))), BOOL)
    if not _comparable(a.type, b.type, True):
        return E(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!=")), BOOL)
    x, y = a.col, b.col
    return E({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOL)


def member(e: E, items: list[E], no: bool) -> E:
    """Three-valued IN over a list of expressions."""
    if not items:
        return E(F.lit(no), BOOL)
    if is_null(e.type):
        return E(F.lit(None).cast(BOOL), BOOL)
    if all(_comparable(e.type, i.type, False) for i in items) and not is_stamp(e.type):
        found = e.col.isin(*[i.col for i in items])
    else:
        found = F.lit(False)
        for i in items:
            found = found | compare("=", e, i).col
    return E(~found if no else found, BOOL)


def inside(e: E, arr: E, no: bool) -> E:
    """IN over an array value."""
    if is_null(arr.type):
        return E(F.lit(None).cast(BOOL), BOOL)
    if not isinstance(arr.type, T.ArrayType):
        raise LanguageError(f"IN needs an array, not {type_word(arr.type)}")
    t = arr.type.elementType
    hit = F.exists(arr.col, lambda x: F.coalesce(compare("=", e, E(x, t)).col, F.lit(False)))
    unknown = e.col.isNull() | arr.col.isNull() | (~hit & F.exists(arr.col, lambda x: x.isNull()))
    return E(F.when(~unknown, ~hit if no else hit), BOOL)


# ---- arithmetic


def arithmetic(op: str, a: E, b: E) -> E:
    if is_null(a.type) or is_null(b.type):
        other = b.type if is_null(a.type) else a.type
        return E(F.lit(None).cast(other), other)
    x, y, s, t = a.col, b.col, a.type, b.type
    if is_number(s) and is_number(t):
        return _numbers(op, a, b)
    if op == "+":
        if isinstance(s, T.StringType) and isinstance(t, T.StringType):
            return E(F.concat(x, y), STRING)
        if isinstance(s, T.ArrayType) and isinstance(t, T.ArrayType):
            both = common([s, t])
            if both is None:
                raise LanguageError("arrays of different kinds do not concatenate")
            return E(F.concat(widened(a, both), widened(b, both)), both)
        if is_stamp(s) and isinstance(t, T.DayTimeIntervalType):
            return E(x + y, s)
        if isinstance(s, T.DayTimeIntervalType) and is_stamp(t):
            return E(y + x, t)
        if isinstance(s, T.DayTimeIntervalType) and isinstance(t, T.DayTimeIntervalType):
            return E(x + y, DURATION)
    if op == "-":
        if is_stamp(s) and is_stamp(t):
            return E(F.abs(x.cast("timestamp") - y.cast("timestamp")), DURATION)
        if is_stamp(s) and isinstance(t, T.DayTimeIntervalType):
            return E(x - y, s)
        if isinstance(s, T.DayTimeIntervalType) and isinstance(t, T.DayTimeIntervalType):
            return E(F.greatest(x - y, F.lit(dt.timedelta(0))), DURATION)
    raise LanguageError(f"{type_word(s)} {op} {type_word(t)} has no meaning")


def _numbers(op: str, a: E, b: E) -> E:
    if is_int(a.type) and is_int(b.type):
        x, y = a.cast(LONG), b.cast(LONG)
        if op == "/":
            return E(F.call_function("div", x, y), LONG)
        return E({"+": x + y, "-": x - y, "*": x * y}[op], LONG)
    if is_decimal(a.type) or is_decimal(b.type):
        side = lambda e: e.col if is_decimal(e.type) else e.cast(T.DecimalType(19, 0) if is_int(e.type) else EXACT)
        x, y = side(a), side(b)
        t = T.DecimalType(38, 10)
        return E({"+": x + y, "-": x - y, "*": x * y, "/": x / y}[op].cast(t), t)
    x, y = a.cast(DOUBLE), b.cast(DOUBLE)
    return E({"+": x + y, "-": x - y, "*": x * y, "/": x / y}[op], DOUBLE)


def minus(e: E) -> E:
    if is_null(e.type):
        return e
    if not is_number(e.type):
        raise LanguageError(f"- needs a number, not {type_word(e.type)}")
    return E(-e.cast(LONG), LONG) if is_int(e.type) else E(-e.col, e.type)


# ---- access


def field(e: E, name: str) -> E:
    """A field of an object; null where there is none."""
    if isinstance(e.type, T.StructType):
        return E(e.col.getField(name), e.type[name].dataType) if name in e.type.names else literal(None)
    if isinstance(e.type, T.VariantType):
        return E(F.try_variant_get(e.col, f"$.{name}", "variant"), e.type)
    if isinstance(e.type, T.MapType):
        return E(F.try_element_at(e.col, F.lit(name)), e.type.valueType)
    if isinstance(e.type, T.ArrayType) and isinstance(e.type.elementType, T.StructType) and name in e.type.elementType.names:
        return E(F.transform(e.col, lambda x: x.getField(name)), T.ArrayType(e.type.elementType[name].dataType))
    return literal(None)


def index(e: E, i: E) -> E:
    """Element at a 0-based place, from the end if negative; null outside."""
    if is_null(e.type) or is_null(i.type):
        return literal(None)
    if not isinstance(e.type, T.ArrayType):
        raise LanguageError(f"only arrays have elements, not {type_word(e.type)}")
    if not is_number(i.type):
        raise LanguageError("a place in an array is an integer")
    at = i.cast("int")
    return E(F.try_element_at(e.col, F.when(at >= 0, at + 1).otherwise(at)), e.type.elementType)


def cut(e: E, start: E | None, end: E | None) -> E:
    """Elements from start to end, both included and clamped; negative places count from the end."""
    if is_null(e.type):
        return e
    if not isinstance(e.type, T.ArrayType):
        raise LanguageError(f"only arrays have slices, not {type_word(e.type)}")
    n = F.size(e.col)
    place = lambda x, other: other if x is None else F.when(x.cast("int") < 0, x.cast("int") + n).otherwise(x.cast("int"))
    a = F.greatest(F.lit(0), place(start, F.lit(0)))
    z = F.least(n - 1, place(end, n - 1))
    return E(F.when(e.col.isNull(), F.lit(None)).when(a > z, F.slice(e.col, 1, 0)).otherwise(F.slice(e.col, a + 1, F.greatest(z - a + 1, F.lit(0)))), e.type)


def sort_key(e: E) -> Column:
    """What ORDER sorts by: null first, then by kind, then by value."""
    if isinstance(e.type, T.VariantType):
        kind = F.schema_of_variant(e.col)
        number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        rank = F.when(F.is_variant_null(e.col), 0).when(kind == "BOOLEAN", 1).when(number, 2).when(kind == "STRING", 3).when(kind.startswith("ARRAY"), 4).otherwise(5)
        return F.struct(rank, F.when(number, F.try_variant_get(e.col, "$", "double")), F.when(~number, F.try_variant_get(e.col, "$", "string")))
    if isinstance(e.type, (T.StructType, T.MapType)):
        return F.to_json(e.col)
    return e.col
