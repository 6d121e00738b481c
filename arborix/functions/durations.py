"""Durations as text: numbers with units, such as 720h or 1h30m, optionally signed; a bare 0 needs no unit."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"ns": Decimal("0.001"), "us": Decimal(1), "µs": Decimal(1), "μs": Decimal(1), "ms": Decimal(10**3), "s": Decimal(10**6), "m": Decimal(60 * 10**6), "h": Decimal(3600 * 10**6)}  # in microseconds
_PART = r"((?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))(ns|us|µs|μs|ms|s|m|h)"
_WHOLE = rf"[+-]?(?:0|(?:{_PART})+)"


def micros(text: str) -> int:
    """Microseconds, parts below one cut off; ValueError for what is no duration."""
    if not re.fullmatch(_WHOLE, text):
        raise ValueError(f"not a duration: {text!r}")
    total = sum(Decimal(n) * UNITS[u] for n, u in re.findall(_PART, text))
    return int(-total if text.startswith("-") else total)


def micros_of(text: Column) -> Column:
    """The same of a column; null for what is no duration."""
    pieces = lambda i: F.regexp_extract_all(text, F.lit(_PART), i)
    unit = lambda u: F.element_at(F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v.quantize(Decimal("0.001"))))), u)
    each = F.zip_with(pieces(1), pieces(2), lambda n, u: F.concat(F.lit("0"), n, F.when(n.endswith("."), "0").otherwise("")).cast("decimal(24,9)") * unit(u).cast("decimal(14,3)"))
    total = F.aggregate(each, F.lit(0).cast("decimal(38,12)"), lambda a, x: (a + x).cast("decimal(38,12)"))
    return F.when(text.rlike(rf"\A{_WHOLE}\z"), F.when(text.startswith("-"), -F.floor(total)).otherwise(F.floor(total)).cast("long"))
