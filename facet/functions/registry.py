"""The scalar functions, by ``namespace::name``; ``register`` adds more (built-in columns or UDFs)."""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V
from .values import BOOL, DOUBLE, DURATION, LONG, STRING, E, LanguageError

Function = Callable[..., E]
_FUNCTIONS: dict[str, tuple[int, int | None, Function]] = {}
CONSTANTS = {"math::pi": math.pi, "math::e": math.e, "math::tau": math.tau}


def register(name: str, least: int, most: int | None = -1) -> Callable[[Function], Function]:
    """Register a function of ``least`` to ``most`` arguments (None: any number; by default exactly ``least``)."""

    def put(f: Function) -> Function:
        _FUNCTIONS[name.lower()] = (least, least if most == -1 else most, f)
        return f

    return put


def names() -> list[str]:
    return sorted(_FUNCTIONS)


def call(name: str, args: list[E]) -> E:
    found = _FUNCTIONS.get(name.lower())
    if found is None:
        near = difflib.get_close_matches(name.lower(), _FUNCTIONS, 1)
        raise LanguageError(f"unknown function {name}" + (f"; did you mean {near[0]}?" if near else ""))
    least, most, f = found
    if len(args) < least or most is not None and len(args) > most:
        raise LanguageError(f"{name} takes {least if most == least else f'{least} to {most}' if most is not None else f'{least} or more'} arguments, not {len(args)}")
    return f(*args)


def constant(name: str) -> E:
    if name.lower() not in CONSTANTS:
        raise LanguageError(f"unknown constant {name}")
    return V.literal(CONSTANTS[name.lower()])


def _need(test: Callable[[T.DataType], bool], what: str) -> Callable[..., None]:
    def check(*args: E) -> None:
        for a in args:
            if not V.is_null(a.type) and not test(a.type):
                raise LanguageError(f"expected {what}, found {V.type_word(a.type)}")

    return check


_number = _need(V.is_number, "a number")
_string = _need(lambda t: isinstance(t, T.StringType), "a string")
_array = _need(lambda t: isinstance(t, T.ArrayType), "an array")
_stamp = _need(V.is_stamp, "a datetime")
_interval = _need(lambda t: isinstance(t, T.DayTimeIntervalType), "a duration")
_bytes = _need(lambda t: isinstance(t, T.BinaryType), "bytes")
_int = _need(V.is_int, "an int")


def _wide(e: E) -> E:
    return E(e.cast(LONG), LONG) if V.is_int(e.type) else E(e.cast(DOUBLE), DOUBLE) if V.is_float(e.type) or V.is_null(e.type) else e


# ---- math


@register("math::abs", 1)
def _abs(x: E) -> E:
    _number(x)
    x = _wide(x)
    return E(F.abs(x.col), x.type)


def _to_int(name: str, f) -> None:
    @register(f"math::{name}", 1)
    def _round(x: E) -> E:
        _number(x)
        return E(x.cast(LONG) if V.is_int(x.type) else f(x.col).cast(LONG), LONG)


_to_int("round", lambda c: F.round(c))
_to_int("floor", F.floor)
_to_int("ceil", F.ceil)
_to_int("trunc", lambda c: c)


@register("math::sign", 1)
def _sign(x: E) -> E:
    _number(x)
    return E(F.signum(x.cast(DOUBLE)).cast(LONG), LONG)


def _real(name: str, f) -> None:
    @register(f"math::{name}", 1)
    def _apply(x: E) -> E:
        _number(x)
        return E(f(x.cast(DOUBLE)), DOUBLE)


for _name, _f in (("sqrt", F.sqrt), ("exp", F.exp), ("sin", F.sin), ("cos", F.cos), ("tan", F.tan)):
    _real(_name, _f)


@register("math::pow", 2)
def _pow(b: E, e: E) -> E:
    _number(b, e)
    return E(F.pow(b.cast(DOUBLE), e.cast(DOUBLE)), DOUBLE)


@register("math::log", 2)
def _log(x: E, base: E) -> E:
    """The argument comes first, then the base."""
    _number(x, base)
    return E(F.ln(x.cast(DOUBLE)) / F.ln(base.cast(DOUBLE)), DOUBLE)


@register("math::modulo", 2)
def _modulo(a: E, b: E) -> E:
    _number(a, b)
    a, b = _wide(a), _wide(b)
    t = V.common([a.type, b.type])
    return E(a.cast(t) % b.cast(t), t)


def _pick(name: str, f) -> None:
    @register(f"math::{name}", 2)
    def _apply(a: E, b: E) -> E:
        _number(a, b)
        t = V.common([_wide(a).type, _wide(b).type])
        return E(F.when(a.col.isNotNull() & b.col.isNotNull(), f(a.cast(t), b.cast(t))), t)


_pick("min", F.least)
_pick("max", F.greatest)


# ---- string


def _text(name: str, f, out: T.DataType = STRING) -> None:
    @register(f"string::{name}", 1)
    def _apply(s: E) -> E:
        _string(s)
        return E(f(s.cast(STRING)), out)


_SPACE = r"[\s\u0085\p{Z}]"
_text("upper", F.upper)
_text("lower", F.lower)
_text("length", lambda c: F.length(c).cast(LONG), LONG)
_text("trim", lambda c: F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", ""))


@register("string::replace", 3)
def _replace(s: E, a: E, b: E) -> E:
    _string(s, a, b)
    return E(F.replace(s.cast(STRING), a.cast(STRING), b.cast(STRING)), STRING)


@register("string::split", 2)
def _split(s: E, d: E) -> E:
    _string(s, d)
    return E(F.split(s.cast(STRING), F.concat(F.lit(r"\Q"), d.cast(STRING), F.lit(r"\E")), -1), T.ArrayType(STRING))


def _affix(name: str, method: str) -> None:
    @register(f"string::{name}", 2)
    def _apply(s: E, part: E) -> E:
        _string(s, part)
        return E(getattr(s.cast(STRING), method)(part.cast(STRING)), BOOL)


_affix("starts_with", "startswith")
_affix("ends_with", "endswith")


@register("string::matches", 2)
def _matches(s: E, pattern: E) -> E:
    _string(s, pattern)
    return E(F.rlike(s.cast(STRING), pattern.cast(STRING)), BOOL)


@register("string::concat", 1, None)
def _concat(*args: E) -> E:
    def one(e: E):
        if isinstance(e.type, T.ArrayType):
            return F.lit("[array]")
        if isinstance(e.type, (T.StructType, T.MapType)):
            return F.lit("[object]")
        return F.coalesce(e.cast(STRING), F.lit(""))

    return E(F.concat(*map(one, args)), STRING)


@register("string::substring", 2, 3)
def _substring(s: E, start: E, size: E | None = None) -> E:
    _string(s)
    _number(start)
    n = size.cast("int") if size is not None else F.lit(2**31 - 1)
    known = s.col.isNotNull() & start.col.isNotNull() & n.isNotNull()
    got = F.when((start.cast("int") < 0) | (n <= 0), F.lit("")).otherwise(F.substring(s.cast(STRING), start.cast("int") + 1, n))
    return E(F.when(known, got), STRING)


# ---- array


@register("array::length", 1)
def _length(a: E) -> E:
    _array(a)
    return V.literal(None) if V.is_null(a.type) else E(F.when(a.col.isNotNull(), F.size(a.col).cast(LONG)), LONG)


@register("array::contains", 2)
def _contains(a: E, x: E) -> E:
    _array(a)
    if V.is_null(a.type):
        return E(F.lit(None).cast(BOOL), BOOL)
    t = a.type.elementType
    hit = lambda y: y.isNull() if V.is_null(x.type) else (y.isNull() & x.col.isNull()) | F.coalesce(V.compare("=", E(y, t), x).col, F.lit(False))
    return E(F.when(a.col.isNotNull(), F.exists(a.col, hit)), BOOL)


@register("array::append", 2)
def _append(a: E, x: E) -> E:
    _array(a)
    if V.is_null(a.type):
        return a
    both = V.common([a.type, T.ArrayType(x.type)])
    if both is None:
        raise LanguageError(f"cannot append {V.type_word(x.type)} to an array of {V.type_word(a.type.elementType)}")
    return E(F.when(a.col.isNotNull(), F.concat(V.widened(a, both), F.array(V.widened(x, both.elementType)))), both)


@register("array::reverse", 1)
def _reverse(a: E) -> E:
    _array(a)
    return a if V.is_null(a.type) else E(F.reverse(a.col), a.type)


@register("array::flatten", 1)
def _flatten(a: E) -> E:
    _array(a)
    if V.is_null(a.type) or not isinstance(a.type.elementType, T.ArrayType):
        return a
    inner = F.transform(a.col, lambda x: F.coalesce(x, F.array(F.lit(None).cast(a.type.elementType.elementType))))
    return E(F.flatten(inner), a.type.elementType)


@register("array::distinct", 1)
def _distinct(a: E) -> E:
    _array(a)
    return a if V.is_null(a.type) or V.is_null(a.type.elementType) else E(F.array_distinct(a.col), a.type)


# ---- type


def _scalar_text(x: E):
    return F.regexp_replace(x.cast(STRING), f"^{_SPACE}+|{_SPACE}+$", "")


@register("type::to_int", 1)
def _int_of(x: E) -> E:
    if isinstance(x.type, T.StringType):
        return E(_scalar_text(x).try_cast(LONG), LONG)
    if V.is_float(x.type):
        top = F.least(F.greatest(x.cast(DOUBLE), F.lit(-9.3e18)), F.lit(9.3e18))
        return E(F.when(x.col >= 9.223372036854775e18, F.lit((1 << 63) - 1)).when(x.col <= -9.223372036854775e18, F.lit(-(1 << 63))).otherwise(top.try_cast(LONG)), LONG)
    if V.is_int(x.type) or isinstance(x.type, T.BooleanType) or V.is_decimal(x.type):
        return E(x.col.try_cast(LONG), LONG)
    return E(F.lit(None).cast(LONG), LONG)


@register("type::to_float", 1)
def _float_of(x: E) -> E:
    if isinstance(x.type, T.StringType):
        return E(_scalar_text(x).try_cast(DOUBLE), DOUBLE)
    ok = V.is_number(x.type) or isinstance(x.type, T.BooleanType)
    return E(x.cast(DOUBLE) if ok else F.lit(None).cast(DOUBLE), DOUBLE)


@register("type::to_decimal", 1)
def _decimal_of(x: E) -> E:
    t = T.DecimalType(38, 18)
    if isinstance(x.type, T.StringType):
        return E(_scalar_text(x).try_cast(t), t)
    return E(x.col.try_cast(t) if V.is_number(x.type) else F.lit(None).cast(t), t)


@register("type::to_string", 1)
def _string_of(x: E) -> E:
    if V.is_null(x.type):
        return V.literal("null")
    c = F.to_json(x.col) if isinstance(x.type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else x.cast(STRING)
    return E(F.coalesce(c, F.lit("null")), STRING)


@register("type::to_bool", 1)
def _bool_of(x: E) -> E:
    return E(V.truthy(x), BOOL)


_VARIANT_KINDS = {"int": "BIGINT", "float": "DOUBLE|FLOAT|DECIMAL", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "string": "STRING", "bool": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def _is(name: str, test) -> None:
    @register(f"type::is_{name}", 1)
    def _apply(x: E) -> E:
        if isinstance(x.type, T.VariantType):
            return E(F.coalesce(F.schema_of_variant(x.col).rlike(f"^({_VARIANT_KINDS.get(name, 'NEVER')})"), F.lit(False)), BOOL)
        return E(x.col.isNotNull() & F.lit(test(x.type)), BOOL)


_is("int", V.is_int)
_is("float", V.is_float)
_is("number", lambda t: V.is_int(t) or V.is_float(t))
_is("string", lambda t: isinstance(t, T.StringType))
_is("bool", lambda t: isinstance(t, T.BooleanType))
_is("array", lambda t: isinstance(t, T.ArrayType))
_is("object", lambda t: isinstance(t, (T.StructType, T.MapType)))


@register("type::is_null", 1)
def _is_null(x: E) -> E:
    return E(x.col.isNull() | F.is_variant_null(x.col) if isinstance(x.type, T.VariantType) else x.col.isNull(), BOOL)


_REFERENCE = r"^[^:]+:[^:]+$"


@register("type::is_reference", 1)
def _is_reference(x: E) -> E:
    """Of values without catalog metadata, strings of the form collection:key (see the planner for references)."""
    return E(F.coalesce(x.col.rlike(_REFERENCE), F.lit(False)) if isinstance(x.type, T.StringType) else F.lit(False), BOOL)


@register("type::ref", 1)
def _ref(x: E) -> E:
    return E(F.when(x.col.rlike(_REFERENCE), x.col) if isinstance(x.type, T.StringType) else F.lit(None).cast(STRING), STRING)


@register("type::of", 1)
def _of(x: E) -> E:
    if isinstance(x.type, T.VariantType):
        kind = F.schema_of_variant(x.col)
        c = F.lit("null")
        for word in ("bool", "object", "array", "string", "float", "int"):
            c = F.when(kind.rlike(f"^({_VARIANT_KINDS[word]})"), word).otherwise(c)
        return E(c, STRING)
    return E(F.when(x.col.isNull(), "null").otherwise(V.type_word(x.type)), STRING)


@register("type::default", 2)
def _default(x: E, d: E) -> E:
    return _first(x, d)


@register("type::coalesce", 1, None)
def _first(*args: E) -> E:
    t = V.common([a.type for a in args])
    if t is None:
        raise LanguageError("the arguments are of different kinds")
    return E(F.coalesce(*[V.widened(a, t) for a in args]), t)


# ---- time, durations, bytes


@register("time::now", 0)
def _now() -> E:
    return E(F.date_trunc("MILLISECOND", F.current_timestamp()), V.STAMP)


for _name, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second)):

    def _part(f):
        def apply(x: E) -> E:
            _stamp(x)
            return E(f(x.cast(V.STAMP) if V.is_null(x.type) else x.col).cast(LONG), LONG)

        return apply

    register(f"time::{_name}", 1)(_part(_f))


def _micros(c):
    return F.unix_micros(F.timestamp_micros(F.lit(0).cast(LONG)) + c)


@register("duration::from_secs", 1)
def _from_secs(x: E) -> E:
    _int(x)
    return E(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x.cast("decimal(18,6)")), DURATION)


@register("duration::from_millis", 1)
def _from_millis(x: E) -> E:
    _int(x)
    return E(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (x.cast("decimal(20,0)") / 1000).cast("decimal(18,6)")), DURATION)


@register("duration::secs", 1)
def _secs(x: E) -> E:
    _interval(x)
    return E(F.call_function("div", _micros(x.cast(DURATION)), F.lit(1_000_000)), LONG)


@register("duration::millis", 1)
def _millis(x: E) -> E:
    _interval(x)
    return E(F.call_function("div", _micros(x.cast(DURATION)), F.lit(1000)), LONG)


@register("bytes::len", 1)
def _bytes_len(x: E) -> E:
    _bytes(x)
    return E(F.octet_length(x.cast(V.BINARY)).cast(LONG), LONG)


@register("bytes::base64_encode", 1)
def _encode(x: E) -> E:
    _bytes(x)
    return E(F.base64(x.cast(V.BINARY)), STRING)


@register("bytes::base64_decode", 1)
def _decode(x: E) -> E:
    _string(x)
    return E(F.to_binary(x.cast(STRING), F.lit("base64")), V.BINARY)


# ---- search


@register("vector::distance", 0)
def _distance() -> E:
    return E(F.col("$distance"), DOUBLE)


@register("fts::score", 0, 1)
def _score(name: E | None = None) -> E:
    return E(F.col("$score"), DOUBLE)


@register("fts::hybrid_score", 0, None)
def _hybrid(*args: E) -> E:
    return E(F.lit(None).cast(DOUBLE), DOUBLE)


@register("fts::highlight", 2, 4)
def _highlight(text: E, query: E, before: E | None = None, after: E | None = None) -> E:
    """The text with the query's words marked (by default ``<b>`` and ``</b>``)."""
    _string(text, query)
    words = F.array_join(F.regexp_extract_all(F.lower(query.cast(STRING)), F.lit(r"([\p{L}\p{N}]+)"), 1), "|")
    a = before.cast(STRING) if before is not None else F.lit("<b>")
    z = after.cast(STRING) if after is not None else F.lit("</b>")
    return E(F.when(words == "", text.col).otherwise(F.regexp_replace(text.cast(STRING), F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), words, F.lit(r")(?![\p{L}\p{N}])")), F.concat(a, F.lit("$1"), z))), STRING)
