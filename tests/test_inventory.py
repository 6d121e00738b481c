import hashlib
import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from arborix.functions import canonical_json, digests, globs, paths
from arborix.operators import inventory as inv
from arborix.plans import checks as queries

INVENTORY = "bundle_id string, path string, mode int, size long, digest string"


def tree(spark, rows, bundle="b"):
    return spark.createDataFrame([(bundle, p, m, len(c), "sha256:" + hashlib.sha256(c).hexdigest()) for p, m, c in rows], INVENTORY)


def records(domain, rows):
    """The hashed stream of a tree, packed by hand: domain, number of files, and each record in the order of its path's bytes."""
    out = domain.encode() + struct.pack(">Q", len(rows))
    for path, mode, content in sorted(rows, key=lambda r: r[0].encode()):
        out += struct.pack(">I", len(path.encode())) + path.encode() + struct.pack(">IQ", mode, len(content)) + hashlib.sha256(content).digest()
    return out


def some_files():
    """Files of several depths, scripts, modes and sizes, and the domain of their digest."""
    rng = random.Random(31)
    names = ["z", "a", "ä", "用", "B b", "c-d.e", "🙂"]
    paths_ = {"/".join(rng.choice(names) + str(i % 7) for _ in range(1 + i % 5)) for i in range(60)}
    return "a-domain-of-the-tests\0", [(p, 493 if i % 3 else 420, rng.randbytes(i * i)) for i, p in enumerate(sorted(paths_))]


@pytest.mark.parametrize("digest", [inv.tree_digest, inv.tree_digest_stream])
def test_tree_digest_is_that_of_the_packed_records(spark, digest):
    domain, rows = some_files()
    got = digest(tree(spark, rows[::-1]), domain).first()
    assert got.tree_digest == "sha256:" + hashlib.sha256(records(domain, rows)).hexdigest()


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned by a sort and broadcast once their sizes are known, and partitions stay apart, as on larger tables."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_streamed_digest_takes_a_bundle_whole_after_a_late_broadcast(spark, late_broadcast):
    domain, rows = some_files()
    spread = tree(spark, rows, "b").unionByName(tree(spark, rows[:7], "c")).repartition(4, "path")
    got = sorted((r.bundle_id, r.tree_digest) for r in inv.tree_digest_stream(spread, domain).collect())
    assert got == [(b, "sha256:" + hashlib.sha256(records(domain, x)).hexdigest()) for b, x in (("b", rows), ("c", rows[:7]))]


def test_diff_is_that_of_plain_dicts(spark):
    rng = random.Random(34)
    side = lambda: [(f"p{i}", rng.choice([420, 493]), rng.choice([b"x", b"y"])) for i in range(80) if rng.random() < 0.8]
    a, b = side(), side()
    old, new = ({p: (m, c) for p, m, c in x} for x in (a, b))
    want = {}
    for p in old.keys() | new.keys():
        if p not in old or p not in new:
            want[p] = "removed" if p in old else "added"
        elif old[p][1] != new[p][1]:
            want[p] = "modified"
        elif old[p][0] != new[p][0]:
            want[p] = "mode-changed"
    a, b = tree(spark, a), tree(spark, b)
    assert {r.path: r.change for r in inv.diff(a, b).collect()} == want and len(set(want.values())) == 4
    sums = inv.diff_summary(inv.diff(b, a)).first()
    count = lambda kind: sum(v == kind for v in want.values())
    assert (sums.added, sums.removed, sums.modified, sums.mode_changed) == (count("removed"), count("added"), count("modified"), count("mode-changed"))
    assert inv.diff(a, a).count() == 0


def plain_code(path, max_bytes=1024, max_segment=255, max_depth=64):
    """The rules of paths, one after the other."""
    if not path or path[0] == "/" or path[-1] == "/":
        return "unsafe-path"
    parts = path.split("/")
    if (max_bytes and len(path.encode()) > max_bytes) or (max_depth and len(parts) > max_depth):
        return "limit-exceeded"
    if not {"", ".", ".."} & set(parts) and max_segment and any(len(x.encode()) > max_segment for x in parts):
        return "limit-exceeded"
    for x in parts:
        control = any(ord(c) < 32 or 127 <= ord(c) < 160 for c in x)
        if x in ("", ".", "..") or control or set(x) & set('<>:"|?*\\') or x[-1] in " ." or x.split(".")[0].lower() in paths.RESERVED:
            return "unsafe-path"
    return "ok"


def test_path_rules(spark):
    """Every forbidden character, control, ending, special segment and reserved stem, in each place of a segment and of a path."""
    odd = [*'<>:"|?*\\', *(chr(c) for c in (0, 1, 31, 127, 128, 133, 159)), " ", ".", "..", "", "é", "界", "~", "$", "-"]
    pieces = [f(c) for c in odd for f in (lambda c: c, lambda c: "ab" + c, lambda c: c + "ab", lambda c: f"a{c}b")]
    pieces += [f(r) for r in [*paths.RESERVED, "com0", "lpt10", "conx", "xcon"] for f in (str, str.upper, str.title, lambda r: r + ".x", lambda r: r + ".x.y", lambda r: "x." + r)]
    rows = {place.format(x) for x in pieces for place in ("{}", "{}/q", "p/{}", "p/{}/q", "/{}", "{}/")}
    df = spark.createDataFrame([(p, plain_code(p)) for p in sorted(rows)], "p string, want string")
    assert df.withColumn("got", paths.path_code(F.col("p"))).where("got <> want").collect() == []
    assert {plain_code(p) for p in rows} == {"ok", "unsafe-path"}
    rng = random.Random(32)
    for bounds in ((30, 0, 0), (0, 7, 0), (0, 0, 3), (20, 6, 4)):
        rows = ["/".join(rng.choice("aé用") * rng.randint(0 if rng.random() < 0.1 else 1, 9) for _ in range(rng.randint(1, 6))) for _ in range(200)]
        df = spark.createDataFrame([(p, plain_code(p, *bounds)) for p in rows], "p string, want string")
        assert df.withColumn("got", paths.path_code(F.col("p"), *bounds)).where("got <> want").collect() == []
        assert {plain_code(p, *bounds) for p in rows} >= {"ok", "limit-exceeded"}


def plain_match(pattern, path):
    """Globs by trying every way: segment by segment, and character by character within one."""

    def text(p, s):
        if not p:
            return not s
        if p[0] == "*":
            return any(text(p[1:], s[i:]) for i in range(len(s) + 1))
        if p[0] == "[":
            end = p.index("]", 2)
            body, negated = (p[2:end], True) if p[1] == "^" else (p[1:end], False)
            return bool(s) and (s[0] in body) != negated and text(p[end + 1 :], s[1:])
        if p[0] == "\\":
            return s[:1] == p[1] and text(p[2:], s[1:])
        return bool(s) and p[0] in ("?", s[0]) and text(p[1:], s[1:])

    def parts(p, s):
        if not p:
            return not s
        if p[0] == "**":
            return any(parts(p[1:], s[i:]) for i in range(len(s) + 1))
        return bool(s) and text(p[0], s[0]) and parts(p[1:], s[1:])

    return parts(pattern.split("/"), path.split("/"))


def test_globs(spark):
    rng = random.Random(33)
    atoms = ["a", "b", ".", "*", "?", "[ab]", "[^a]", "\\*", "*a", "a*b"]
    pattern = lambda: "/".join(rng.choice(["**", "".join(rng.choice(atoms) for _ in range(rng.randint(1, 3)))]) for _ in range(rng.randint(1, 4)))
    patterns = {p for p in (pattern() for _ in range(250)) if not {".", ".."} & set(p.split("/")) and not any("**" in x and x != "**" for x in p.split("/"))}
    names = ["/".join("".join(rng.choice("ab.*") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    hits = 0
    for p in sorted(patterns):
        compiled = re.compile(globs.regex_of([p]).replace(r"\z", r"\Z"))
        for n in names:
            want = plain_match(p, n)
            hits += want
            assert bool(compiled.search(n + "/")) is want, (p, n)
    assert len(patterns) > 100 and hits > 500
    some = sorted(patterns)[:6]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n for r in df.where(globs.selected(F.col("n"), some[:4], some[4:])).collect()}
    assert got == {n for n in names if any(plain_match(p, n) for p in some[:4]) and not any(plain_match(p, n) for p in some[4:])}


def test_malformed_globs():
    """A sound pattern with one fault put into it, at each place."""
    sound = ["q", "r*", "**", "s[xy]"]
    for fault in ("", ".", "..", "t**", "**t", "u[v", "w\\"):
        for at in range(len(sound) + 1):
            with pytest.raises(globs.PatternError):
                globs.to_regex("/".join([*sound[:at], fault, *sound[at:]]))
    assert globs.to_regex("/".join(sound))


def test_fold_and_collisions(spark):
    """Every letter folds as its upper and lower forms of one character do, and no two letters that share neither; i without a dot has no partner."""
    letters = [chr(c) for c in range(0x20, 0x2500) if chr(c).isalpha() and chr(c) != "\u0131"]
    pairs = [(c, x) for c in letters for x in (c.upper(), c.lower()) if len(x) == 1]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(paths.fold_key("a") != paths.fold_key("b")).collect() == [] and sum(a != b for a, b in pairs) > 1000
    apart = [(c, x) for c in letters for x in (c.upper(), c.lower(), c.casefold()) if len(x) > 1]
    assert spark.createDataFrame(apart, "a string, b string").where(paths.fold_key("a") == paths.fold_key("b")).collect() == [] and len(apart) > 50
    plain = [(a, b) for a in "abcyz" for b in "ABCYZ"]
    same = spark.createDataFrame(plain, "a string, b string").where(paths.fold_key("a") == paths.fold_key("b")).collect()
    assert {tuple(r) for r in same} == {(a, b) for a, b in plain if a.upper() == b}
    rows = spark.createDataFrame([("b", "s", "Q/1"), ("b", "s", "q/2"), ("b", "t", "x"), ("b", "s", "x/y"), ("b", "s", "d"), ("b", "t", "d")], "bundle_id string, source string, path string")
    assert [r.path for r in inv.fold_clashes(rows).collect()] == ["Q"]
    assert [r.path for r in inv.file_directory_clashes(rows).collect()] == ["x"]
    assert [(r.path, r.message) for r in inv.duplicate_paths(rows).collect()] == [("d", "s,t")]


def test_canonical_json():
    """Random values written loosely come out in their one form; a value with one fault in it has none."""
    rng = random.Random(35)
    text = lambda: "".join(rng.choice('ab"\\/<&\n\t\x01\x1f\x7fé\ufffd\ue000\U0001f600') for _ in range(rng.randint(0, 5)))

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return [None, rng.random() < 0.5, rng.choice([0, 1, -1, 2**53 + 1, 2**64 - 1, -(2**63)]), text()][kind]
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {text(): value(depth - 1) for _ in range(rng.randint(0, 4))}

    def form(v):
        if isinstance(v, dict):
            return "{" + ",".join(f"{form(k)}:{form(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
        if isinstance(v, list):
            return "[" + ",".join(form(x) for x in v) + "]"
        if not isinstance(v, str):
            return {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else str(v)
        short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t"}
        return '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in v) + '"'

    for _ in range(400):
        v = value(3)
        loose = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert canonical_json._or_none(loose) == form(v)
        for fault in ("0.5", "1e2", "NaN", "Infinity", str(2**64), str(-(2**63) - 1), "", '"\\ud800"', "'x'", "01"):
            assert canonical_json._or_none(f"[{loose},{fault}]") is None
        assert canonical_json._or_none(loose + " 1") is None


def test_limits_take_the_least_positive_and_the_first_on_ties(spark):
    rows = spark.createDataFrame([("b", "maxFiles", 500, "client", 1), ("b", "maxFiles", 100, "policy", 2), ("b", "maxFiles", 100, "request", 3), ("b", "maxFiles", 0, "unset", 0)], "bundle_id string, bound string, value long, origin string, precedence int")
    assert tuple(inv.resolve_limits(rows).first())[2:] == (100, "policy")


def test_digest_codes(spark):
    h = "a" * 64
    df = spark.createDataFrame([("sha256:" + h, "ok"), ("sha256:" + h.upper(), "invalid"), ("sha512:" + h, "unsupported-version"), (h, "invalid"), ("sha256:" + h + "\n", "invalid")], "d string, want string")
    assert df.where(digests.digest_code(F.col("d")) != F.col("want")).collect() == []


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
