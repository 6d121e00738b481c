"""Canonical JSON (RFC 8785, integers only): one text for one value."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _reject(x: str) -> None:
    raise ValueError(f"not an integer: {x}")


def _write(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{_write(k)}:{_write(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_write, v)) + "]"
    if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**64:
        raise ValueError(f"out of range: {v}")
    return json.dumps(v, ensure_ascii=False)


def canonicalize(text: str) -> str:
    """Raises ValueError for what isn't one JSON value of integers, strings, booleans, nulls, arrays and objects."""
    out = _write(json.loads(text, parse_float=_reject, parse_constant=_reject))
    out.encode()  # lone surrogates
    return out


def _or_none(text: str) -> str | None:
    try:
        return canonicalize(text)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Null for null and for what can't be canonical."""
    return s.map(_or_none, na_action="ignore")
