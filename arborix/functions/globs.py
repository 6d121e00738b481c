"""Glob patterns over whole paths, compiled to one regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """A malformed pattern."""


def _segment(seg: str) -> str:
    out, i = [], 0
    while i < len(seg):
        c = seg[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            negated = seg[i + 1 : i + 2] == "^"
            j = i + 1 + negated
            body = []
            while j < len(seg) and (seg[j] != "]" or not body):
                if seg[j] == "\\":
                    j += 1
                    if j == len(seg):
                        raise PatternError(seg)
                    body.append(re.escape(seg[j]))
                else:
                    body.append("\\" + seg[j] if seg[j] in "[&~^" else seg[j])
                j += 1
            if j >= len(seg):
                raise PatternError(f"unclosed class in {seg!r}")
            out.append(f"[{'^/' if negated else ''}{''.join(body)}]")
            i = j
        elif c == "\\":
            i += 1
            if i == len(seg):
                raise PatternError(seg)
            out.append(re.escape(seg[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def to_regex(pattern: str) -> str:
    """The expression that a path followed by / must match; ** stands for any number of segments, also none."""
    segments = pattern.split("/")
    if pattern == "" or any(s in ("", ".", "..") or ("**" in s and s != "**") for s in segments):
        raise PatternError(f"malformed pattern {pattern!r}")
    out = []
    for s in segments:
        part = "(?:[^/]+/)*" if s == "**" else _segment(s) + "/"
        if part != "(?:[^/]+/)*" or out[-1:] != [part]:
            out.append(part)
    return "".join(out)


def regex_of(patterns: list[str]) -> str:
    return r"\A(?:" + "|".join(to_regex(p) for p in sorted(set(patterns))) + r")\z"


def selected(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any include (all where there is none) and no exclude."""
    slashed = F.concat(path, F.lit("/"))
    ok = slashed.rlike(regex_of(include or ["**"]))
    return ok & ~slashed.rlike(regex_of(exclude)) if exclude else ok
