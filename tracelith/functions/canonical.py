"""Canonical JSON: one text for each value, kinds of numbers kept apart.

Keys are sorted at every depth, there is no white space, integers stay integers, floats are the shortest text that reads
back the same and always hold a point or an exponent; integers beyond [-2^63, 2^64) are floats; values that aren't finite are null.
"""

from __future__ import annotations

import json
import math
import re
from json.encoder import encode_basestring
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def _number(x: float) -> str:
    if not math.isfinite(x):
        return "null"
    text = repr(x)
    return text if any(c in text for c in ".e") else text + ".0"


def _float(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf


def whole_text(digits: str) -> int | float:
    """A JSON integer of any length; one of hundreds of digits is a float (infinite where it is out of range)."""
    return int(digits) if len(digits) <= 400 else float(digits)


_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode
#: As many digits as an integer out of range has at least.
_long = re.compile("[0-9]{19}").search


def canonical(x: Any) -> str:
    """The canonical text of a parsed JSON value."""
    kind = type(x)
    if kind is str:
        return encode_basestring(x)
    if kind is int and -(1 << 63) <= x < 1 << 64:
        return str(x)
    try:
        text = _encode(x)
        if not _long(text):
            return text
    except (ValueError, RecursionError):  # values that aren't finite; too deep for the encoder
        pass
    return _walk(x)


def _walk(x: Any) -> str:
    """The same for any value. Iterative, so that depth is bounded by memory only."""
    out: list[str] = []
    todo: list[Any] = [x]
    raw = object()  # marks texts that are ready
    while todo:
        v = todo.pop()
        if isinstance(v, tuple) and len(v) == 2 and v[0] is raw:
            out.append(v[1])
        elif v is None:
            out.append("null")
        elif v is True or v is False:
            out.append("true" if v else "false")
        elif isinstance(v, int):
            out.append(str(v) if -(1 << 63) <= v < 1 << 64 else _number(_float(v)))
        elif isinstance(v, float):
            out.append(_number(v))
        elif isinstance(v, str):
            out.append(json.dumps(v, ensure_ascii=False))
        elif isinstance(v, dict):
            todo.append((raw, "}"))
            for i, k in enumerate(sorted(v, reverse=True)):
                todo += [v[k], (raw, json.dumps(k, ensure_ascii=False) + ":")]
                todo.append((raw, "," if i < len(v) - 1 else ""))
            todo.append((raw, "{"))
        else:
            todo.append((raw, "]"))
            for i, e in enumerate(reversed(v)):
                todo += [e, (raw, "," if i < len(v) - 1 else "")]
            todo.append((raw, "["))
    return "".join(out)


def parse(text: str) -> Any:
    """The value of a JSON text; ValueError for all that isn't one, or is nested too deeply for the parser."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        raise
    except ValueError:  # more digits than int() takes
        return json.loads(text, parse_int=whole_text)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


@F.arrow_udf(StringType())
def canonical_json(text: pa.Array) -> pa.Array:
    """Canonical text of JSON texts; null for null, for what isn't JSON and for what is nested too deeply to be read."""

    def one(t):
        try:
            return None if t is None else canonical(parse(t))
        except ValueError:
            return None

    return pa.array([one(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(MapType(StringType(), StringType()))
def canonical_args(text: pa.Array) -> pa.Array:
    """The members of JSON objects, values as canonical texts; null for empty objects and for all else."""

    def one(t):
        try:
            x = None if t is None else parse(t)
        except ValueError:
            x = None
        return sorted((k, canonical(v)) for k, v in x.items()) if isinstance(x, dict) and x else None

    return pa.array([one(t) for t in text.to_pylist()], pa.map_(pa.string(), pa.string()))
