"""Each stage of the pipeline against plain Python, on what the stage before it kept."""

import numpy as np

import corpus_pipeline
from arborix.llm import quality_rules, sharding
from arborix.llm.common import table, written

from .test_decontaminate import brute_leaks
from .test_edges import chained
from .test_operators import WORD, jaccard


def corpus(rng):
    word = lambda: "".join(rng.choice(list("abcdefghijk"), 6))
    text = lambda n: " ".join(word() for _ in range(n))
    item = "In the shop Tom buys 5 apples and gives 2 kg to Ann before Tom walks home alone again"
    rows = [(i, text(int(rng.integers(30, 90))), "en", "big" if i % 4 else f"s{i % 3}") for i in range(120)]
    for i in range(0, 40, 2):  # copies with an edit, on both sides of the bound
        w = rows[i][1].split()
        rows.append((200 + i, " ".join([*w[: len(w) - i // 4], *text(i // 4).split()]), "en", "big"))
    rows += [(300, rows[3][1], "en", "big"), (301, rows[3][1], "en", "s1"), (302, f"{text(20)}. {item} {text(9)}", "en", "big"), (303, f"{text(20)}. {item.replace('Tom', 'Bob').replace('5', '8')} {text(9)}", "en", "big"), (304, "few words", "en", "big"), (305, "the same five words again " * 9, "en", "big"), (306, None, None, None)]
    rows += [(400 + i, " ".join(f"{word()}$$$$" for _ in range(40)), "en", "big") for i in range(40)]
    labels = [(i, 1, 0) for i in range(0, 120)] + [(400 + i, 0, 0) for i in range(0, 40)]
    return rows, labels, item


def test_stages_agree_with_plain_python(spark, tmp_path):
    rows, labels, item = corpus(np.random.default_rng(41))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "a question of few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    rules = quality_rules.learn(quality_rules.labelled(docs, table(spark, str(tmp_path), "labels")))
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        outputs.append([(r.doc_id, r.text, r.source) if "text" in docs.columns else r for r in docs.collect()])
    quality, deduped, clean, mixed, shards = outputs

    def passes(text):
        w = WORD.findall(text or "")
        seen = {}
        for j in range(len(w) - 4):
            seen.setdefault(tuple(w[j : j + 5]), []).append(j)
        repeated = {x for at in seen.values() if len(at) > 1 for j in at for x in range(j, j + 5)}
        if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
            return False
        symbols = sum(c in "#*$%&|<>" for c in text) * 1000 // sum(map(len, w))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        facts = {"symbols_permille": symbols, "capitals_permille": sum(c.isupper() for c in text) * 1000 // sum(map(len, w)), "exclaim_permille": text.count("!") * 1000 // sum(map(len, w)), "dup_lines_permille": (len(lines) - len(set(lines))) * 1000 // len(lines), "repeat_permille": len(repeated) * 1000 // len(w), "distinct_permille": len(set(w)) * 1000 // len(w), "word_length_permille": sum(map(len, w)) * 1000 // len(w), "n_words": len(w)}
        return not any(quality_rules._covers(r.conditions, facts) for r in rules)

    assert rules and sorted(i for i, *_ in quality) == sorted(i for i, t, *_ in rows if passes(t))
    assert not {i for i, *_ in quality} & set(range(400, 440))

    root = {i: i for i, *_ in quality}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    texts = {i: t for i, t, _ in quality}
    for a in texts:
        for b in texts:
            if a < b and jaccard(texts[a].lower(), texts[b].lower()) >= 0.8 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(i for i, *_ in deduped) == sorted(i for i in root if root[i] == i) and len(deduped) < len(quality) - 5

    leaks = {d for d, *_ in brute_leaks([(i, t) for i, t, _ in deduped], [(1, item), (2, "a question of few words")], 10, 6)}
    assert sorted(i for i, *_ in clean) == sorted(i for i, *_ in deduped if i not in leaks) and {302, 303} & leaks

    size = {}
    for _, t, s in clean:
        size[s] = size.get(s, 0) + len(t.split())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (max(size.values()) / min(size.values())) ** (1 - mid) <= 2 else (mid, hi)
    want = []
    for s in size:
        part = [(i, t) for i, t, x in clean if x == s]
        repeat = round((max(size.values()) / size[s]) ** (1 - hi), 9)
        whole, rest, blocks = int(repeat), int(size[s] * (repeat - int(repeat))), int(np.ceil(np.sqrt(len(part))))
        for epoch in range(whole + (rest > 0)):
            order = sorted((chained((11, 4), (epoch, 4), (k, 8)) % blocks, chained((12, 4), (epoch, 4), (k, 8)), i, t) for i, t in part for k in [chained((i, 8), (t, 0))])
            spent = 0
            for *_, i, t in order:
                spent += len(t.split())
                if epoch < whole or spent <= rest:
                    want.append(i)
    assert sorted(i for i, *_ in mixed) == sorted(want) and len(want) > len(clean)

    places = sorted((int(p) % 16, int(p) // 16) for p in sharding.permuted(np.arange(len(mixed)), len(mixed), 7))
    assert sorted((r.shard, r.slot) for r in shards) == places and sorted(r.doc_id for r in shards) == sorted(want)
