"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are exact and always stay. Further candidates
come from wider patterns and from a gazetteer of given names, so wide that many
are none. Six labelers - two by form, one by gazetteer, two by context, one by
length - vote for, against or not at all on each of these candidates, and only on
these, as base spans need no vote and would teach the labelers nothing but their
own certainty. The distinct patterns of votes and features are counted over the
whole corpus, expectation-maximisation estimates each labeler's reliability from
those counts, and a logistic span classifier is trained on the features (kind,
size, digits, what stands around, validity, gazetteer, context) against the
estimated truth. Candidates that it accepts are added.

Each text passes Python once: what is found there is written, and counting and
choosing are plain DataFrame operations over it.

Positions are code points, ends exclusive. A null text is empty and has no spans;
an empty table gives no rows; a null id is an id; repeated rows are judged alike.
Of overlapping candidates the leftmost stays, then the longest, then the first
kind by name. Every scan is linear in the text, so a very long text takes long in
proportion and is held whole. Columns other than those of keep and the text are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns, written

KINDS = ["email", "ip", "card", "phone", "name", "ssn", "secret"]
BASE_KINDS = KINDS[:4]
#: Given names, a small gazetteer; another, as a list or a table with column name, is a parameter.
GIVEN_NAMES = ["Alice", "Andrew", "Carlos", "Charles", "Claire", "David", "Elena", "Emily", "François", "George", "Hans", "Helen", "James", "Javier", "Jürgen", "Laura", "Maria", "Michael", "Pierre", "Robert", "Sarah", "Sophie", "Thomas", "William"]
MAX_NAMES = 100_000

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDER = {
    "phone": re.compile(r"\(?(?<![0-9])[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?([A-Za-z0-9+/_=-]{6,})")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{24,}")
_SPELLED = re.compile(r"\b[A-Za-z0-9._-]{2,64}\x20?[\[(]?\bat\b[\])]?\x20?[A-Za-z0-9-]{2,64}\x20?[\[(]?\bdot\b[\])]?\x20?[A-Za-z]{2,24}\b")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?")
_TWO_NAMES = re.compile(r"\b([^\W\d_]+)\x20[A-Z][a-z]{2,}\b")
_GOOD_CUE = re.compile(r"(?i)\b(?:call|phone|tel|mail|contact|fax|card|visa|name|mr|mrs|dr|ssn|social|login|user|password|token|secret|key|address|ip|from|host|write|meet|ask|dear)\b")
_BAD_CUE = re.compile(r"(?i)\b(?:version|license|page|isbn|order|section|figure|item|rfc|vol|no|under|part|chapter|commit|hash|sha|sum)\b")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield Span("email", start, end)
            at = text.find("@", end)
        else:
            # the run before this sign can't begin a match that ends elsewhere; a later sign has a run of its own
            end, at = at + 1, text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind in the order of BASE_KINDS."""
    out = list(_emails(text)) if "@" in text else []
    if any(d in text for d in "0123456789"):
        out += [Span("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int((x.lstrip("0") or "0")[:4]) <= 255 for x in m[0].split("."))] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append(Span("card", m.start(), m.end()))
        if "+" in text:
            out += [Span("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def wider_spans(text: str, base: list[Span], given: frozenset[str]) -> list[Span]:
    """Candidates beside the base spans, not overlapping those or one another; the leftmost wins, then the longest."""
    found: list[Span] = []
    if any(d in text for d in "0123456789"):
        for kind, pattern in _WIDER.items():
            found += [Span(kind, m.start(), m.end()) for m in pattern.finditer(text)]
        found += [Span("secret", m.start(), m.end()) for m in _OPAQUE.finditer(text)]
    if "=" in text or ":" in text:
        found += [Span("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    if "dot" in text:
        found += [Span("email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if any(t in text for t in ("Mr", "Ms", "Dr")):
        found += [Span("name", m.start(), m.end()) for m in _TITLE.finditer(text)]
    found += [Span("name", m.start(), m.end()) for m in _TWO_NAMES.finditer(text) if m[1] in given]
    out, taken = [], sorted((s.start, s.end) for s in base)
    end, at = -1, 0
    for s in sorted(found, key=lambda s: (s.start, -s.end, s.kind)):
        while at < len(taken) and taken[at][1] <= s.start:
            at += 1
        if s.start >= end and not any(a < s.end and b > s.start for a, b in taken[at : at + 8]):
            out.append(s)
            end = s.end
    return out


LABELERS = ["shape", "valid", "gazetteer", "context", "edges", "length"]
_DOMAINS = frozenset(["com", "org", "net", "edu", "gov", "info", "io", "co", "dev", "de", "fr", "es", "it", "uk", "us", "eu", "ch", "at"])
_LENGTHS = {"phone": (10, 14), "ssn": (11, 11), "secret": (12, 80), "email": (10, 60), "name": (6, 30)}


def votes(text: str, s: Span, given: frozenset[str]) -> tuple[int, ...]:
    """1 for, -1 against, 0 no opinion, by each of LABELERS."""
    body, before = text[s.start : s.end], text[max(0, s.start - 40) : s.start]
    digits = _digits(body)
    words = re.findall(r"\w+", body)[:8]
    keyed = bool(re.search(r"[=:]\x20{0,2}[\"']?$", before))
    shape = {"phone": 1 if body[0] == "(" or body.count("-") == 2 else -1, "ssn": 0, "secret": 1 if keyed else -1, "email": 1 if "[" in body or "(" in body else -1, "name": 1 if _TITLE.match(body) else 0}[s.kind]
    valid = {"phone": 1 if digits[-10:-9] in tuple("23456789") else -1, "ssn": -1 if digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1, "secret": 1 if len(digits) >= 3 and re.search("[A-Za-z]", body) else -1, "email": 1 if words[-1:] and words[-1].lower() in _DOMAINS else -1}.get(s.kind, 0)
    gazetteer = 0 if s.kind != "name" else 1 if any(w in given for w in words) else -1
    context = -1 if _BAD_CUE.search(before) else 1 if _GOOD_CUE.search(before) else 0
    left = s.start == 0 or not text[s.start - 1].isalnum()
    right = s.end == len(text) or not text[s.end].isalnum()
    low, high = _LENGTHS[s.kind]
    return shape, valid, gazetteer, context, 1 if left and right else -1, 1 if low <= len(body) <= high else -1


_SIZES = (len(KINDS), 6, 5, 2, 3, 3, 3, 3)


def features(text: str, s: Span, v: tuple[int, ...]) -> tuple[int, ...]:
    """Kind, size and surroundings of a span, and what some labelers say, as small integers."""
    body = text[s.start : s.end]
    share = 4 * len(_digits(body)) // max(len(body), 1)
    return KINDS.index(s.kind), min(len(body) // 8, 5), share, int(text[s.end : s.end + 1] in ("", " ", ",", ".", "\n", '"', "'")), v[0] + 1, v[1] + 1, v[2] + 1, v[3] + 1


def _design(f: np.ndarray) -> np.ndarray:
    """One column for each value of each feature, and one for all."""
    return np.concatenate([np.ones((len(f), 1)), *(np.eye(n)[f[:, i]] for i, n in enumerate(_SIZES))], axis=1)


class Model(NamedTuple):
    reliability: np.ndarray  # truth by labeler by vote
    prior: float
    weights: np.ndarray

    def accepts(self, f: tuple[int, ...]) -> bool:
        """Whether the classifier takes a candidate of these features."""
        return bool(_design(np.array([f]))[0] @ self.weights > 0)


def estimate(v: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Reliabilities, prior, and the probability that each vote pattern marks personal data; n counts the patterns."""
    truth = 1 / (1 + np.exp(-v.sum(axis=1)))
    one_hot = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        prior = float(np.clip((n * truth).sum() / n.sum(), 0.01, 0.99))
        rel = np.stack([np.einsum("p,plv->lv", n * t, one_hot) + 0.5 for t in (1 - truth, truth)])
        rel /= rel.sum(axis=2, keepdims=True)
        log = np.einsum("plv,tlv->pt", one_hot, np.log(rel)) + np.log([1 - prior, prior])
        truth = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return rel, prior, truth


def train(patterns: dict[tuple[tuple[int, ...], tuple[int, ...]], int]) -> Model | None:
    """Reliabilities by expectation-maximisation, then a logistic classifier on the features, from counts of (votes, features)."""
    if not patterns:
        return None
    items = sorted(patterns.items())
    v, f = np.array([k[0] for k, _ in items]), np.array([k[1] for k, _ in items])
    n = np.array([c for _, c in items], dtype=float)
    rel, prior, truth = estimate(v, n)
    x = _design(f)
    w = np.zeros(x.shape[1])
    weight = n / n.sum()
    for _ in range(50):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - truth)) + 1e-4 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return Model(rel, prior, w)


def _names(given: list[str] | DataFrame | None) -> frozenset[str]:
    """The gazetteer: a list, or a table's column name, MAX_NAMES of it at most."""
    if isinstance(given, DataFrame):
        given = [r.name for r in given.where("name is not null").select("name").distinct().orderBy("name").limit(MAX_NAMES).collect()]
    return frozenset(GIVEN_NAMES if given is None else given)


def _pattern(v: tuple[int, ...], f: tuple[int, ...]) -> str:
    return ",".join(map(str, (*v, *f)))


def candidates(docs: DataFrame, keep: list[str], given: list[str] | DataFrame | None = None) -> DataFrame:
    """The columns of keep and spans (kind, start, stop, base, pattern) of every whole text, written; pattern: votes and features of a candidate, null of a base span."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    kind = "array<struct<kind:string,start:int,stop:int,base:boolean,pattern:string>>"
    schema = with_columns(rows.schema.fields[:-1], f"spans {kind}")
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(_names(given))  # MAX_NAMES at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(len(keep)):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = [(s, None) for s in base]
                for s in wider_spans(text, base, shared.value):
                    v = votes(text, s, shared.value)
                    spans.append((s, _pattern(v, features(text, s, v))))
                spans.sort(key=lambda x: (x[0].start, KINDS.index(x[0].kind)))
                out.append([{"kind": s.kind, "start": s.start, "stop": s.end, "base": p is None, "pattern": p} for s, p in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, span_type)], names=[*keep, "spans"])

    return written(rows.mapInArrow(find, schema), "pii-candidates")


def learn(found: DataFrame) -> tuple[Model | None, list[str]]:
    """The model of all candidates, and the patterns that it accepts. Patterns are at most the combinations of votes and features, whatever the input."""
    got = found.select(F.explode("spans").alias("s")).where("s.pattern is not null").groupBy("s.pattern").agg(F.count("*").alias("n")).collect()
    split = {r.pattern: tuple(int(x) for x in r.pattern.split(",")) for r in got}
    cut = len(LABELERS)
    model = train({(split[r.pattern][:cut], split[r.pattern][cut:]): r.n for r in got})
    return model, sorted(p for p, x in split.items() if model.accepts(x[cut:]))


def find_spans(docs: DataFrame, keep: list[str], given: list[str] | DataFrame | None = None) -> DataFrame:
    """The columns of keep and spans (kind, start, stop, base), ordered by start and kind, of every whole text."""
    found = candidates(docs, keep, given)
    _, accepted = learn(found)
    kept = F.filter("spans", lambda s: s["base"] | s["pattern"].isin(accepted))
    return found.select(*keep, F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"))).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, ["doc_id"])
    line = lambda only: F.array_join(F.transform(F.filter("spans", (lambda s: s["base"]) if only else (lambda s: F.lit(True))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(line(True), 256).alias("base_sha256"), line(False).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
