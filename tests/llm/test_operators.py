import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from arborix.llm import common, language_id, mixing, near_sets, pii, quality_knn, quality_rules, queries, samples, sharding, simhash, substring_dedup, url_filter
from arborix.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, shard int, __row string, fp string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(*r, "en", "s")[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)] + ["Ä", "é|x", "🙂"]
    base = [" ".join(rng.choice(vocab, rng.integers(0, 120))) for _ in range(60)]
    shared = " ".join(rng.choice(vocab, 40))
    out = base + base[:8] + [f"{t} {shared}\n{t}" for t in base[8:20]] + [None, "", " \t\n", "one", "x " * 3000]
    return [(i * 3 % len(out), t, "en", f"s{i % 3}" if i % 4 else "hot") for i, t in enumerate(out)]


def test_kernel_agrees_with_plain_python():
    samples = [None, "", " a b", "\ta  b\n\nc ", "Hello WORLD é ñ " + "q" * 100, "x" * 70, "a b c d e f g " * 40]
    for _, _, data, offsets in tk.slices(pa.array(samples), 60):
        norm, starts, ends, first = tk.single_spaced(data, offsets)
        assert [int(x) for x in tk.xxh64(norm, starts, ends)] == [xxhash.xxh64_intdigest(bytes(norm[a:b]), 42) for a, b in zip(starts, ends, strict=True)]
    assert [hi - lo for lo, hi, *_ in tk.slices(pa.array(samples), 1 << 20)] == [len(samples)]


def brute_dedup(rows, k):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if (key := tuple(w[s : s + k])) in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), kept)
    return out


@pytest.mark.parametrize("k", [3, 20])
def test_op1(spark, texts, k):
    got = substring_dedup.dedup_substrings(docs(spark, texts), k).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_dedup([r[:2] for r in texts], k)
    assert substring_dedup.dedup_substrings(docs(spark, []), k).count() == 0


def test_op1_repeated_rows_and_null_ids(spark):
    t = " ".join(f"u{i}" for i in range(30))
    got = substring_dedup.dedup_substrings(docs(spark, [(None, t), (1, t), (1, t), (2, None)]), 20).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 30), (False, 30), (True, 0)]


def test_sorted_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        v = np.unique(rng.integers(0, 1 << 20, n).astype(np.uint64))
        assert np.array_equal(substring_dedup.unpack_sorted(substring_dedup.pack_sorted(v, 20)), v)


def test_op2(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.com/en/x", None), (2, "http://www.example.com/en/", ""), (3, "http://b.net/es/1", None), (4, "http://b.net/de/1", None), (5, None, None), (6, "nohost", "x"), (7, "http://c.org", '<a href="//B.net/q">'), (8, "http://d.org/?u=http://b.net/", '<a href="http://x.com/">'), (8, "http://d.org/?u=http://b.net/", '<a href="http://x.com/">')],
        "page_id long, url string, html string",
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == {1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("b.net", "/es/1", "net/es/", "block"), 4: ("b.net", "/de/1", None, "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("c.org", "", None, "block"), 8: ("d.org", "/", None, "allow")}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_op2_agrees_with_plain_loops_on_a_graph_with_hubs(spark):
    """Cycles, hosts that link nowhere, a hub that all link to and that links to all, shared suffixes, repeated pages."""
    rng = np.random.default_rng(17)
    hosts = [f"h{i}.{d}" for i, d in enumerate(["com", "net", "org", "co.uk", "a.github.io", "x.dom.org"] * 12)] + ["hub.org"]
    pages = []
    for i, h in enumerate(hosts):
        to = rng.choice(hosts, int(rng.integers(0, 5))).tolist() if h != "hub.org" else hosts
        html = "".join(f'<a href="https://{x}/p">' for x in [*to, *(["hub.org"] if i % 3 else [])])
        for path in rng.choice(["/es/1", "/en/2", "/x", "/fr/"], int(rng.integers(1, 4))):
            pages.append((len(pages), f"http://{h}{path}", html))
    pages += pages[:5]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    edges, good, bad, ruled = set(), Counter(), Counter(), {}
    for page, url, html in pages:
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        edges |= {(host, x) for x in re.findall(r'href="https://([^/]*)/', html) if x != host}
        labels = host.split(".")
        names = [".".join(labels[i:]) for i in range(len(labels) - 1)]
        for a, b in zip(names, names[1:], strict=False):
            if not {a, b} & set(url_filter.SHARED_SUFFIXES):
                edges |= {(a, b), (b, a)}
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        ruled[page] = (host, rule)
        good[host] += rule is not None and rule.verdict == "allow"
        bad[host] += rule is not None and rule.verdict == "block"
    nodes = {x for e in edges for x in e} | set(good)
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    seeds = [{h: c[h] / sum(c.values()) for h in nodes} for c in (good, bad)]
    trust, distrust = (dict(s) for s in seeds)
    for _ in range(24):
        t, d = ({h: 0.15 * s[h] for h in nodes} for s in seeds)
        for a, b in edges:
            t[b] += 0.85 * trust[a] / out[a]
            d[a] += 0.85 * distrust[b] / into[b]
        trust, distrust = t, d
    want = {}
    for page, (host, rule) in ruled.items():
        spread = "block" if distrust[host] > 0 and distrust[host] / (trust[host] + distrust[host]) > 0.5 + 1e-9 else "allow"
        want[page] = (rule.host + rule.path if rule else None, rule.verdict if rule else spread)
    assert got == want and 10 < sum(r is None and v == "block" for r, v in want.values()) and sum(r is None and v == "allow" for r, v in want.values()) > 10


def test_op3(spark, texts):
    rows = texts + [(None, "n"), (None, "m"), (5, "dup"), (5, "dup")]
    got = sharding.shard_rows(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    for r in got:
        p = int(sharding.permuted(np.array([r.row]), len(rows), 7)[0])
        assert (r.shard, r.slot) == (p % 4, p // 4)
    known = {i: t or "" for i, t, *_ in texts if i != 5}
    assert all(r.size == len(known[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(known[r.doc_id].encode()) for r in got if r.doc_id in known)
    assert sharding.shard_rows(docs(spark, []), 4).count() == 0
    for n in (1, 2, 3, 17, 1000):
        assert sorted(sharding.permuted(np.arange(n), n, 9)) == list(range(n))


def test_op4(spark):
    rng = np.random.default_rng(2)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    train = [(make("abcde"), "aa") for _ in range(60)] + [(make("vwxyz"), "bb") for _ in range(60)]
    net = language_id.fit([*train, (None, "aa"), ("123", "aa")])
    got = {r.doc_id: r for r in language_id.identify(docs(spark, [(1, make("abcde") * 20), (2, make("vwxyz")), (3, None), (4, "12 .."), (5, "")]), net, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(docs(spark, [(1, "a")]), language_id.fit([]), ["doc_id"]).first().lang_pred == "und"


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_op5(spark):
    text = "Mail é a.b@c.de, call +1 (458) 555-3863 or (458) 555-3863; 4111 1111 1111 1111 at 10.0.0.256 and 10.0.0.25 password=897a334fdac2c39185"
    rows = docs(spark, [(1, text), (2, None), (3, ""), (None, text)])
    got = {r.doc_id: [(s.kind, text[s.start : s.stop]) for s in r.spans if s.base] for r in pii.find_spans(rows, ["doc_id"]).collect()}
    assert got[1] == got[None] == [("email", "a.b@c.de"), ("phone", "+1 (458) 555-3863"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.25")]
    assert got[2] == got[3] == []
    assert pii.find_spans(docs(spark, []), ["doc_id"]).count() == 0


def test_op5_base_spans_agree_with_the_patterns():
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    rng, seen = np.random.default_rng(4), Counter()
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "4111 1111 1111 1112", "+1 (458) 555-3863", "+44.20 7946 0958", "10.0.0.25", "256.1.1.1", "001.2.3.4.5.6.7.8", "a1.b@c.d"]
    for i in range(6000):
        t = "".join(rng.choice(list("ab12.@-+ %é()" if i % 2 else "0123456789 -+.( "), 40))
        if i % 3 == 0:
            t = f"{t[:20]} {rng.choice(cards)} {t[20:]}"
        base = pii.base_spans(t)
        for kind, (pattern, fits) in kinds.items():
            want = [m.span() for m in re.finditer(pattern, t) if fits(m[0])]
            assert [(s.start, s.end) for s in base if s.kind == kind] == want
            seen[kind] += len(want)
    assert min(seen.values()) > 50


def test_op5_added_spans_are_found_and_decoys_left(spark):
    """Secrets, spelled addresses, names, numbers in other forms, among things that look like them."""
    rng = np.random.default_rng(16)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    pad = lambda: " ".join("".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(8))
    digits = lambda n: "".join(rng.choice(list("23456789"), n))
    good = [lambda: f'token = "{hexa(36)}"', lambda: f"password={hexa(18)}", lambda: f"jo.{hexa(4)} [at] mail{digits(1)} [dot] com", lambda: f"Dr. Sarah {rng.choice(['Meyer', 'Stone'])}", lambda: f"call ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"ssn 4{digits(2)}-{digits(2)}-{digits(4)}"]
    bad = [lambda: f"commit {hexa(40)}", lambda: f"order no 9{digits(2)}-00-{digits(4)}", lambda: f"item {digits(3)} {digits(3)} {digits(4)}", lambda: "look at some dot here"]
    rows, planted = [], []
    for i in range(400):
        is_bad = i % 10 >= 6
        x = (bad[(i // 10) % 4] if is_bad else good[i % 6])()
        head = pad() + " "
        rows.append((i, f"{head}{x} {pad()}"))
        planted.append((is_bad, len(head), len(head) + len(x)))
    got = {r.doc_id: [s for s in r.spans if not s.base] for r in pii.find_spans(docs(spark, rows), ["doc_id"]).collect()}
    hit = [any(s.start < hi and s.stop > lo for s in got[i]) for i, (_, lo, hi) in enumerate(planted)]
    caught = [h for h, (b, *_) in zip(hit, planted, strict=True) if not b]
    wrong = [h for h, (b, *_) in zip(hit, planted, strict=True) if b]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.1 * len(wrong)


def test_op5_reliabilities_are_estimated():
    votes = np.array([[1, 1, 1], [1, 1, -1], [-1, -1, 1], [-1, -1, -1]])
    rel, prior, truth = pii.estimate(votes, np.array([40.0, 40.0, 40.0, 40.0]))
    assert truth[0] > 0.9 and truth[1] > 0.9 and truth[2] < 0.1 and truth[3] < 0.1
    assert rel[1][0][2] > 0.9 and abs(rel[1][2][2] - 0.5) < 0.1


def test_op6(spark, texts):
    rows = [(i, t, "en", s) for i, t, _, s in texts] + [(900, "a b", "en", None), (901, None, "en", "empty")]
    got = mixing.mix(docs(spark, rows), ["doc_id"], max_repeat=2.0).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    size = {s: sum(len(WORD.findall(t or "")) for _, t, _, x in rows if (x or "") == s) for s in {(r[3] or "") for r in rows}}
    live = {s: n for s, n in size.items() if n}
    lo, hi, total = 0.0, 1.0, sum(live.values())
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (max(live.values()) / min(live.values())) ** (1 - mid) <= 2 else (mid, hi)
    for s, n in live.items():
        repeat = round((max(live.values()) / n) ** (1 - hi), 9)
        took = sum(r["__tokens"] for r in got if r["__source"] == s)
        assert n <= took <= n * repeat + 1e-6
        assert took > n * repeat - 3001
    for key in {(r["__source"], r["__epoch"]) for r in got}:
        at = sorted(r["__position"] for r in got if (r["__source"], r["__epoch"]) == key)
        assert at == list(range(len(at)))
    assert mixing.mix(docs(spark, []), ["doc_id"]).count() == 0



def test_op6_entropy(spark):
    totals = spark.createDataFrame([("a", 1, 900), ("b", 1, 90), ("c", 1, 10)], "source string, n_rows long, n_tokens long")
    w = [r.weight for r in mixing.weights(totals, None, 1.0).collect()]
    assert abs(sum(w) - 1) < 1e-9 and abs(-sum(x * np.log(x) for x in w) - 1.0) < 1e-6


def test_op7(spark, texts):
    rows = [(i, t) for i, t, *_ in texts] + [(None, "lone words here now")]
    near = [(700 + i, "k " * i + " ".join(f"z{j}" for j in range(200))) for i in range(5)]
    got = simhash.near_duplicates(docs(spark, rows + near)).collect()
    prints = {}
    for i, t in rows + near:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        shingles = [" ".join(w[j : j + 4]) for j in range(max(len(w) - 3, 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == prints
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    group = {}
    for i in ids:
        if i is not None:
            group[find(i)] = min(group.get(find(i), i), i)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: group[find(i)] for i in ids if i is not None}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_op7_blocks_and_trie_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6).astype(np.uint64)
    v = np.unique(np.concatenate([centre ^ sum(np.uint64(1) << b for b in rng.integers(0, 64, (k, 6)).astype(np.uint64)) for k in (1, 2, 2, 3, 3, 4)] + [centre]))
    i, j = (np.concatenate(x) for x in zip(*simhash.trie_links(v, [np.array([0]), np.array([len(v)]), np.array([0]), np.array([len(v)])], 4), strict=True))
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= 4}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want)
    fps = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    whole, cut = simhash.Forest(len(v)), simhash.Forest(len(v))
    at = {int(x): k for k, x in enumerate(v.view(np.int64))}
    whole.add(i, j)
    rows = simhash.near_links(fps, 4, block=3).collect()
    cut.add(np.array([at[r.a] for r in rows]), np.array([at[r.b] for r in rows]))
    assert np.array_equal(whole.root, cut.root)


def jaccard(a, b):
    a, b = ({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block_bytes", [16 << 20, 1500])
def test_near_dedup_keeps_to_the_set_rule(spark, block_bytes):
    """Passages appended, replaced and cut out, at similarities on both sides of 0.8, in groups of one block and of several."""
    rng = np.random.default_rng(11)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(n))
    rows, groups = [], []
    for g in range(40):
        base = word(200).split()
        n = int(rng.integers(8, 60))
        edits = [base, base + word(n).split(), base[:50] + word(n // 2).split() + base[50 + n // 2 :], base[: 200 - n], base[:90] + base[90 + n // 2 :]]
        groups.append([len(rows) + k for k in range(len(edits))])
        rows += [(len(rows) + k, " ".join(e)) for k, e in enumerate(edits)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (None, rows[0][1])]
    keep = {900, 902}
    for ids in groups:
        root = {i: i for i in ids}
        for a in ids:
            for b in ids:
                if jaccard(rows[a][1], rows[b][1]) >= 0.8 and root[a] != root[b]:
                    root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
        keep |= set(root.values())
    assert 60 < len(keep) < 190
    got = near_sets.one_of_each(docs(spark, rows), block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in got) == sorted(keep) and got[0].shard == 1
    assert near_sets.one_of_each(docs(spark, [])).count() == 0


def test_op8(spark, texts):
    rows = docs(spark, [(i, t) for i, t, *_ in texts] + [(None, "a#b $ c"), (950, "l1 x\nl1 x\n\n \nl1 x")])
    got = quality_rules.judge(rows, [], ["doc_id"]).collect()
    want = {}
    for i, t in [(i, t) for i, t, *_ in texts] + [(None, "a#b $ c"), (950, "l1 x\nl1 x\n\n \nl1 x")]:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {x for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for x in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        want[i] = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), failed, not failed)
    assert {r.doc_id: tuple(r[c] for c in [*quality_rules.BASE, "base_failed", "kept"]) for r in got} == want


def test_op8_learns_a_threshold():
    zero = dict.fromkeys(quality_rules.FEATURES, 0)
    rows = [zero | {"bad": int(i % 4 == 0), "symbols_permille": 200 + i if i % 4 == 0 else i % 30, "n_words": 50 + i} for i in range(200)]
    rules = quality_rules.learn(rows)
    assert [c.feature for c in rules[0].conditions] == ["symbols_permille"]
    assert all(any(quality_rules._covers(r.conditions, x) for r in rules) == bool(x["bad"]) for x in rows)
    assert quality_rules.learn([]) == []


def test_op10(spark):
    rng = np.random.default_rng(6)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
    bad = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) + "$$$" for _ in range(40))
    model = quality_knn.fit([(good(), 1) for _ in range(40)] + [(bad(), 0) for _ in range(40)])
    got = {r.doc_id: r.score for r in quality_knn.score_quality(docs(spark, [(1, good()), (2, bad()), (3, None), (4, "")]), model, ["doc_id"]).collect()}
    assert got[1] > 0.9 and got[2] < 0.1 and got[3] == got[4] == 0.5
    assert quality_knn.score_quality(docs(spark, [(1, "a")]), None, ["doc_id"]).first().score == 0.5


def test_pipeline_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    text = lambda n=60: " ".join("".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(n))
    item = text(20)
    clean = [(i, text(), "en", "hot" if i % 3 else "rare") for i in range(30)]
    rows = [*clean, (40, clean[4][1], "en", "hot"), (41, f"{text(40)} {item} {text(20)}", "en", "hot"), (42, "few words", "en", "hot"), (43, None, None, None), (44, "same " * 50, "en", "rare")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(30))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontaminate", "mix_sources", "shard"]
    assert max(Counter(r.shard for r in out).values()) - min(Counter(r.shard for r in out).values()) <= 1



@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, texts, tmp_path, name):
    """On a fixture with null and empty texts and pages; Spark and DuckDB read the same files."""
    ids = [(i, t) for i, t, *_ in texts]
    spark.createDataFrame(ids, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, "http://A.b.example.com/en/x", '<a href="//b.net/q">'), (2, None, None), (3, "nohost", ""), (4, "http://b.net/es/?q#f", None), (5, "http://www.example.com/en/", '<img src=http://C.org/x>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    found = con.execute(queries.ORACLE_SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in got.columns]
    want = Counter(tuple(row[i] for i in at) for row in found.fetchall())
    assert Counter(map(tuple, got.collect())) == want


def test_op10_scores_depend_on_the_text_alone(spark):
    """Equal alone, in another order and in batches of one, and equal to plain loops over all cosines."""
    rng = np.random.default_rng(9)
    make = lambda: " ".join("".join(rng.choice(list("abcdeFG1$."), rng.integers(1, 8))) for _ in range(rng.integers(1, 30)))
    rows = [(i, make()) for i in range(60)]
    labelled = [(make(), int(rng.integers(0, 2))) for _ in range(40)]
    labelled += labelled[:6]  # ties
    model = quality_knn.fit(labelled)

    def scored(order, batch):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            return {r.doc_id: r.score for r in quality_knn.score_quality(docs(spark, [rows[i] for i in order]).coalesce(1), model, ["doc_id"]).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)

    got = scored(range(60), 10000)
    assert got == scored(range(59, -1, -1), 10000) == scored(rng.permutation(60), 1)
    one = lambda t: next(quality_knn._blocks(pa.array([t], pa.large_string())))[0]
    space = [model.basis.T @ (one(t) * model.idf - model.mean) for t, _ in labelled]
    for i, t in rows:
        v = model.basis.T @ (one(t) * model.idf - model.mean)
        near = sorted((round(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), 9), y) for u, (_, y) in zip(space, labelled, strict=True))[::-1]
        last = near[14][0]
        above, level = [x for x in near if x[0] > last], [x for x in near if x[0] == last]
        pairs = [(max(c, 1e-3) ** 8, y) for c, y in above] + [(max(c, 1e-3) ** 8 * (15 - len(above)) / len(level), y) for c, y in level]
        assert abs(sum(w * y for w, y in pairs) / sum(w for w, _ in pairs) - got[i]) < 1e-6


def test_op10_held_out(spark):
    """Accuracy on labelled rows that training didn't see, on the tables at hand."""
    sf = "/root/testdata/sf0.01"
    got = quality_knn.op10_quality_knn(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_op4_forward_and_gradient_agree_with_plain_python():
    rng = np.random.default_rng(15)
    net = language_id.ByteCnn(["a", "b", "c"])
    for p in net.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    x, y = rng.integers(0, language_id.CLASSES, (4, 12)), np.array([0, 2, 1, 2])

    def loss():
        total = 0.0
        for row, label in zip(x, y, strict=True):
            pooled = []
            for f, b, w in zip(net.filters, net.bias, language_id.WIDTHS, strict=True):
                for k in range(f.shape[1]):
                    pooled.append(max(0.0, max(sum(float(net.embed[row[i + j]] @ f[j * language_id.EMBED : (j + 1) * language_id.EMBED, k]) for j in range(w)) for i in range(len(row) - w + 1)) + float(b[k])))
            z = [sum(p * float(o) for p, o in zip(pooled, net.out[:, c], strict=True)) + float(net.out_bias[c]) for c in range(3)]
            e = [math.exp(v - max(z)) for v in z]
            probs.append([v / sum(e) for v in e])
            total -= math.log(probs[-1][label]) / len(y)
        return total

    probs = []
    loss()
    assert np.allclose(net.probabilities(x), probs, atol=1e-5)
    for p, g in zip(net.parameters(), net._gradient(x, y), strict=True):
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        before = p[at]
        p[at] = before + 1e-2
        up = loss()
        p[at] = before - 1e-2
        down = loss()
        p[at] = before
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_samples_survive_null_and_repeated_ids(spark):
    rows = [(None if i % 10 == 0 else i, f"t{i}") for i in range(5000)] + [(7, f"u{i}") for i in range(3000)] + [(8, "same")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = samples.sampled(df, 1000, "doc_id", "text").collect()
    assert len(got) == 1000
    assert 20 < sum(r.doc_id is None for r in got) < 80 and 150 < sum(r.text[0] == "u" for r in got) < 400
    again = samples.sampled(df.repartition(7), 1000, "doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert samples.sampled(df, 100_000, "doc_id").count() == len(rows)
    assert samples.sampled(spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string"), 100, "doc_id", "text").count() == 100
    assert samples.bounded(df.limit(0), 10, "doc_id") == []


def test_the_shared_folder_is_asked_for(spark):
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

            class _Conf:
                def get(self, *_):
                    return None

            getConf = classmethod(lambda cls: cls._Conf())

        conf = sparkContext._Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Elsewhere)
    kept = common.written(spark.range(5), "kept")
    assert kept.count() == 5
    common.drop_written(kept)
    fs, at = common._at(spark, kept._arborix_path)
    assert not fs.exists(at)
