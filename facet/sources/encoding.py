"""Results as JSON: plain (for people and other tools) and typed (nothing is lost)."""

from __future__ import annotations

import base64
import datetime as dt
from decimal import Decimal
from typing import Any

from pyspark.sql import Row

from ..operators.dml import Ref


def _nanos(v: dt.timedelta) -> int:
    return (v // dt.timedelta(microseconds=1)) * 1000


def _stamp(v: dt.datetime) -> str:
    return (v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)).astimezone(dt.timezone.utc).isoformat()


def plain(v: Any) -> Any:
    """Decimals as numbers, datetimes as RFC 3339, durations as nanoseconds under a tag, bytes in base 64."""
    if isinstance(v, Row):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return _stamp(v)
    if isinstance(v, dt.timedelta):
        return {"_type": "duration", "nanos": _nanos(v)}
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode()
    return str(v) if isinstance(v, Ref) else v


def typed(v: Any, references: frozenset[str] = frozenset(), name: str | None = None) -> Any:
    """Kinds that JSON lacks as ``{"$type": …, "value": …}``; ``references`` names the fields that hold references."""
    tagged = lambda kind, value: {"$type": kind, "value": value}
    if isinstance(v, Row):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: typed(x, references, k) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [typed(x, references, name) for x in v]
    if v is None or isinstance(v, (bool, float)):
        return v
    if isinstance(v, int):
        return tagged("int64", str(v))
    if isinstance(v, Decimal):
        return tagged("decimal", str(v))
    if isinstance(v, dt.datetime):
        return tagged("datetime", _stamp(v))
    if isinstance(v, dt.timedelta):
        return tagged("duration", str(_nanos(v)))
    if isinstance(v, (bytes, bytearray)):
        return tagged("bytes", base64.b64encode(bytes(v)).decode())
    return tagged("reference", str(v)) if isinstance(v, Ref) or name in references else v


_READ = {
    "int64": int, "decimal": Decimal, "datetime": dt.datetime.fromisoformat, "bytes": base64.b64decode, "reference": Ref,
    "duration": lambda s: dt.timedelta(microseconds=int(s) // 1000),
}


def untyped(v: Any) -> Any:
    """The values that ``typed`` encoded."""
    if isinstance(v, dict):
        return _READ[v["$type"]](v["value"]) if set(v) == {"$type", "value"} and v["$type"] in _READ else {k: untyped(x) for k, x in v.items()}
    return [untyped(x) for x in v] if isinstance(v, list) else v
