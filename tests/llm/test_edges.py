"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborix.llm import decontaminate, language_id, mixing, near_sets, pii, quality_knn, quality_rules, sharding, simhash, substring_dedup, url_filter

from .test_operators import WORD, docs

CLASHING = "doc_id long, text string, lang string, source string, key long, chunk long, fp long, root long, spans string, score double, rule string, n_words long, kept boolean, __row string, __text string, __h long, item_id long, `a b` string, form int, n int, item long, band long, size long"
ITEM = "what does the quick brown fox do when seven lazy dogs sleep beside the old river bank"


@pytest.fixture(scope="module")
def long_text():
    """Over one slice of 4 MB, with a passage, a number to call and an item at its end."""
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(40000)]
    return " ".join(rng.choice(vocab, 700_000)) + f" {ITEM} +1 (458) 555-3863"


@pytest.fixture(scope="module")
def rows(long_text):
    t = " ".join(f"word{i}" for i in range(40))
    return [(1, t, "en", "hot"), (1, t, "en", "hot"), (2, t, "en", "hot"), (None, t, None, None), (None, t, None, None), (3, None, None, "hot"), (4, "", "en", None), (5, " \n\t", "en", "x"), (6, long_text, "en", "hot"), (7, "short", "en", "x")]


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    extra = (1, 2, 3, 4, "s", 0.5, "r", 9, True, "x", "y", 8, 7, "z", 1, 1, 1, 1, 1)
    path = str(tmp_path_factory.mktemp("edges") / "documents")
    spark.createDataFrame([(*r, *extra) for r in rows], CLASHING).write.parquet(path)
    return spark.read.parquet(path)


def multiset(found, *names):
    return Counter(tuple(r[n] for n in names) for r in found)


def test_op1(table, rows):
    got = substring_dedup.dedup_substrings(table).collect()
    # nulls come first, so one row of the copies with a null id keeps its words
    assert multiset(got, "doc_id", "n_words", "n_removed") == Counter([(None, 40, 0), (None, 40, 40), (1, 40, 40), (1, 40, 40), (2, 40, 40), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 700_020, 0), (7, 1, 0)])
    assert next(r.kept_text for r in got if r.doc_id == 6) == " ".join(WORD.findall(rows[8][1]))
    assert substring_dedup.dedup_substrings(table.limit(0)).count() == 0


def test_op1_chunks_are_bounded_by_bytes(spark):
    rows = [(i, "a" * (1 << (i % 19))) for i in range(4000)]
    size = spark.createDataFrame(rows, "doc_id long, text string").select(F.length("text").alias("n"), F.xxhash64(*substring_dedup._by_length(F.col("doc_id"))).alias("chunk"))
    worst = size.groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).agg(F.max("rows"), F.max("bytes")).first()
    assert worst[0] <= substring_dedup.CHUNK_ROWS and worst[1] <= substring_dedup.CHUNK_ROWS * substring_dedup.LONG_BYTES


def test_op2(spark):
    links = '<a href="https://b.net/x">' * 200_000
    pages = [(1, "http://b.net/es/1", links), (1, "http://b.net/es/1", links), (None, "http://c.org/", links), (2, None, None), (3, "", ""), (4, "http://b.net/x", None), (5, "http:///x", "")]
    df = spark.createDataFrame([(*p, "h", "r", 1.0, 2, "f") for p in pages], "page_id long, url string, html string, host string, rule string, trust double, n long, `from` string")
    got = url_filter.filter_urls(df).collect()
    assert multiset(got, "page_id", "host", "rule", "verdict") == Counter([(1, "b.net", "net/es/", "block")] * 2 + [(None, "c.org", None, "block"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "b.net", None, "block"), (5, "", None, "allow")])
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_op3(table, rows):
    got = sharding.shard_rows(table.select("doc_id", "text", "lang", "source"), 4).collect()
    assert len(got) == len(rows) and all([r.slot for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)] == list(range(sum(r.shard == s for r in got))) for s in range(4))
    assert {r.size for r in got if r.doc_id == 6} == {len(rows[8][1]) + 1}
    assert sharding.shard_rows(table.limit(0).select("doc_id", "text"), 4).count() == 0


def test_op4(spark, table):
    net = language_id.fit([("abcd efgh abc " * 20, "aa"), ("uvwx yzuv xyz " * 20, "bb")] * 20)
    got = language_id.identify(table, net, ["doc_id"]).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (3, 4, 5, 6)} == {3: "und", 4: "und", 5: "und", 6: "aa"}
    assert len({r.score for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert language_id.identify(table.limit(0), net, ["doc_id"]).count() == 0
    some = language_id.training_rows(table, F.lit(True), most=5, pieces=3)
    assert len(some) <= 15 and all(len(t) <= language_id.LENGTH for t, _ in some) and language_id.training_rows(table.limit(0), F.lit(True)) == []


def test_op5(table, rows):
    got = pii.find_spans(table, ["doc_id"]).collect()
    text = rows[8][1]
    assert {r.doc_id: [text[s.start : s.stop] for s in r.spans if s.base] for r in got if r.doc_id in (3, 4, 6)} == {3: [], 4: [], 6: ["+1 (458) 555-3863"]}
    assert len(got) == len(rows) and pii.find_spans(table.limit(0), ["doc_id"]).count() == 0
    assert {r.doc_id for r in pii.find_spans(table, ["doc_id"], table.select(F.lit("Zoe").alias("name"))).collect()} == {r[0] for r in rows}


def chained(*values):
    """The hash of several columns: each value's hash is the seed of the next; nulls leave it."""
    h = 42
    for v, width in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(width, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def test_op6_agrees_with_plain_loops(spark, table, rows):
    """Blocks, order and budget of every pass, row by row."""
    more = [(100 + i, "w " * (i % 7), "en", "abc"[i % 3] if i % 5 else "big") for i in range(200)]
    got = mixing.mix(docs(spark, more), ["doc_id"], max_repeat=2.5).collect()
    sources = {s: [r for r in more if r[3] == s] for s in {r[3] for r in more}}
    size = {s: sum(len(WORD.findall(t)) for _, t, *_ in part) for s, part in sources.items()}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (max(size.values()) / min(size.values())) ** (1 - mid) <= 2.5 else (mid, hi)
    want = set()
    for s, part in sources.items():
        repeat = round((max(size.values()) / size[s]) ** (1 - hi), 9)
        whole, rest, n_blocks = int(repeat), int(size[s] * (repeat - int(repeat))), int(np.ceil(np.sqrt(len(part))))
        for epoch in range(whole + (rest > 0)):
            order = []
            for i, t, *_ in part:
                key = chained((i, 8), (t, 0))
                block = chained((11, 4), (epoch, 4), (key, 8)) % n_blocks
                order.append((block, chained((12, 4), (epoch, 4), (key, 8)), key, i, len(WORD.findall(t))))
            spent = 0
            for place, (block, _, _, i, n) in enumerate(sorted(order)):
                spent += n
                if epoch < whole or spent <= rest:
                    want.add((i, s, n, epoch, block, place))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 200
    got = mixing.mix(table, ["doc_id", "root"]).collect()
    assert Counter(r.doc_id for r in got if r["__epoch"] == 0) == Counter(r[0] for r in rows)
    assert mixing.mix(table.limit(0), ["doc_id"]).count() == 0


def test_op6_entropy_of_many_sources(spark):
    rng = np.random.default_rng(22)
    n = rng.integers(1, 100_000, 300)
    totals = spark.createDataFrame([(f"s{i}", 1, int(x)) for i, x in enumerate(n)] + [("none", 3, 0)], "source string, n_rows long, n_tokens long")
    got = mixing.weights(totals, None, 5.6).collect()
    w = np.array([r.weight for r in got if r.weight])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() - 5.6) < 1e-6 and {r.weight for r in got if r.source == "none"} == {0.0}


def test_op7(table, rows):
    got = simhash.near_duplicates(table).collect()
    assert len(got) == len(rows) and len({r.fp for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert {r.component_id for r in got if r.doc_id in (None, 1, 2)} == {1} and {r.fp for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_op7_streams_keys(spark):
    """A walk that holds few rows at a time finds the same links, and no key is cut."""
    import pyarrow as pa

    rng = np.random.default_rng(23)
    key = np.sort(rng.integers(0, 50, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 37])], names=["k"]) for i in range(0, 1000, 37)]
    parts = [t.column("k").to_pylist() for t in simhash.whole_keys(iter(batches), ["k"], 60)]
    assert sum(parts, []) == key.tolist() and len(parts) > 8
    assert not any(set(a) & set(b) for a, b in zip(parts, parts[1:], strict=False)) and max(map(len, parts)) < 60 + 37 + 60


def test_op7_pairs_of_parts_lose_no_pair():
    rng = np.random.default_rng(24)
    parts = simhash._parts(4)
    assert sum(w for _, w in parts) == 64 and min(w for _, w in parts) >= 10
    for _ in range(300):
        flips = rng.choice(64, 4, replace=False)
        same = [i for i, (a, w) in enumerate(parts) if not any(a <= f < a + w for f in flips)]
        assert len(same) >= 2


def test_near_dedup(table):
    assert sorted((r.doc_id or 0) for r in near_sets.one_of_each(table).collect()) == [1, 3, 6, 7]
    assert near_sets.one_of_each(table).columns == table.columns and near_sets.one_of_each(table.limit(0)).count() == 0


def _edited(rng, n, rest):
    """Pairs of texts: one of n words, and one that differs from it in a passage of so many words or single words."""
    word = lambda k: ["".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(k)]
    base = word(n)
    edits = [base + word(rest), base[: n - rest], base[:20] + word(rest) + base[20 + rest :], [w if i % 40 else word(1)[0] for i, w in enumerate(base)]]
    return [(" ".join(base), " ".join(e)) for e in edits]


def test_near_dedup_walks_fingerprints_of_the_sets(spark):
    """The walk's groups are those of plain Python over xxhash, majority and differing bits."""
    import xxhash

    rng = np.random.default_rng(61)
    texts = sorted({t for n in range(1, 21) for pair in _edited(rng, 100, n) for t in pair} | {"one two", "Three  four"})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "doc_id as __k1", "doc_id as __k2")
    sets = near_sets._named_sets(docs, near_sets.SHINGLE).cache()
    name = {r.doc_id: r.set for r in sets.collect()}
    prints = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        h = [xxhash.xxh64_intdigest(x, 42) for x in {" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}]
        prints[name[i]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {x: x for x in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= near_sets.BUDGET and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {x: lo if r == hi else r for x, r in root.items()}
    want = sorted((x, r) for x, r in root.items() if x != r)
    assert sorted((r.a, r.b) for r in near_sets.walked_stars(sets, near_sets.BUDGET).collect()) == want and 20 < len(want) < len(texts) // 2


def test_near_dedup_finds_by_fingerprint_what_all_bands_miss(spark, tmp_path):
    """Two texts of similarity 0.8 (4 of 5 shingles) that agree on no band: one of 22 million such pairs that were tried."""
    import corpus_pipeline

    words = [f"v{c}2540502" for c in "abcdefghi"]
    rows = [(1, " ".join(words[:8])), (2, " ".join(words)), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_sets._named_sets(docs.selectExpr("*", "doc_id as __k1", "doc_id as __k2"), near_sets.SHINGLE)
    assert near_sets.band_stars(sets).count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_op8(spark, table, rows):
    labels = spark.createDataFrame([(1, 1, "t", 2), (1, 0, "t", 2), (None, 1, "t", 3), (6, 1, "t", 4), (6, None, "t", 4)], "doc_id long, quality int, text string, bad int")
    got = quality_rules.labelled(table, labels)
    assert len(got) == 3 and sorted(r["bad"] for r in got) == [0, 1, 1]
    assert len(quality_rules.labelled(table, labels, 2)) == 2 and quality_rules.labelled(table, labels.limit(0)) == []
    out = quality_rules.judge(table, quality_rules.learn(got), ["doc_id"]).collect()
    assert {r.doc_id: (r.n_words, r.kept) for r in out if r.doc_id in (3, 4, 5, 6, 7)} == {3: (0, False), 4: (0, False), 5: (0, False), 6: (700_020, True), 7: (1, False)}
    assert quality_rules.judge(table.limit(0), [], ["doc_id"]).count() == 0


def test_op8_held_out_precision(spark):
    """Rules learned from half of the labels agree with the other half, on the tables at hand."""
    sf = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality_rules.learn(quality_rules.labelled(documents, labels.where("doc_id % 2 = 0")))
    judged = quality_rules.judge(documents.join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id"), rules, ["doc_id", "quality"]).where("not base_failed").collect()
    fired = [r.quality for r in judged if not r.kept]
    bad = [r.kept for r in judged if not r.quality]
    assert rules and fired.count(0) >= 0.9 * len(fired) and bad.count(False) >= 0.5 * len(bad)


def test_op9(spark, table):
    items = spark.createDataFrame([(1, ITEM, 1, 2, "x"), (1, ITEM, 1, 2, "x"), (None, "word3 word4 word5", 1, 2, "x"), (2, None, 1, 2, "x"), (3, "", 1, 2, "x")], "item_id long, text string, doc_id long, key long, __keep string")
    got = decontaminate.find_leaks(table, items, ["doc_id", "root", "a b"]).collect()
    assert multiset(got, "doc_id", "item_id", "root", "a b") == Counter([(6, 1, 4, "z")] * 2 + [(i, None, 4, "z") for i in (1, 1, 2, None, None)])
    assert sorted((r.doc_id or 0) for r in decontaminate.without_leaks(table, items).collect()) == [3, 4, 5, 7]
    assert decontaminate.without_leaks(table, items).columns == table.columns


def test_op10(spark, table):
    labels = spark.createDataFrame([(1, 1, "t"), (1, 0, "t"), (None, 1, "t"), (6, 1, "t")], "doc_id long, quality int, text string")
    model = quality_knn.learn(table, labels, F.lit(True))
    got = quality_knn.score_quality(table, model, ["doc_id"]).collect()
    assert len(got) == table.count() and len({r.score for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert {r.score for r in got if r.doc_id in (3, 4)} == {model.share} and all(0 <= r.score <= 1 for r in got)
    assert quality_knn.learn(table, labels.limit(0), F.lit(True)) is None and quality_knn.score_quality(table.limit(0), model, ["doc_id"]).count() == 0


def test_pipeline_stages(spark, table, tmp_path):
    """Each stage keeps the columns, whatever their names, and takes nulls, empty tables and the long text."""
    import corpus_pipeline

    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {"quality_rules": [0, 0, 1, 1, 2, 6], "simhash_near_dedup": [1, 3, 6, 7], "decontaminate": [0, 0, 1, 1, 2, 3, 4, 5, 7], "mix_sources": None}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, table, str(tmp_path)), stage(spark, table.limit(0), str(tmp_path))
        assert none.count() == 0
        if name in left:
            assert out.columns == table.columns
            ids = sorted((r.doc_id or 0) for r in out.select("doc_id").collect())
            assert ids == left[name] if left[name] else set(ids) == {0, 1, 2, 3, 4, 5, 6, 7}
        else:
            assert out.count() == table.count()
