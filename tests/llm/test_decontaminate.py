import re

import numpy as np
import pyarrow as pa
import pytest

from arborix.llm import decontaminate
from arborix.llm import textkernel as tk

from .test_operators import docs


def test_op9(spark):
    bench = spark.createDataFrame([(1, "In the shop Tom buys 5 apples and gives 2 kg to Ann before Tom walks home alone again"), (2, None), (3, "too short")], "item_id long, text string")
    rows = [
        (1, "So it goes. In the shop Bob buys 7 apples and gives 3 kg to Eve before Bob walks home alone again. End"),
        (2, "So it goes. In the shop Bob buys 7 apples and gives 7 kg to Bob before Bob walks home, not at all alone"),
        (3, "SO IT GOES IN THE SHOP TOM BUYS 5 APPLES AND GIVES 2 KG TO ANN BEFORE TOM WALKS HOME ALONE AGAIN"),
        (4, None),
        (5, ""),
        (6, "too short a text about apples"),
        (7, "In the shop Tom buys 5 pears"),
    ]
    d = docs(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, bench).collect()} == {(1, 1), (3, 1), (6, 3)}
    exact = docs(spark, [(7, "x y z in the shop Tom buys 5 apples and gives 2 kg to Ann before Tom walks home alone again x"), (7, "clean"), (8, "clean"), (8, "clean"), (None, None)])
    assert sorted((r.text or "", r.shard) for r in decontaminate.without_leaks(exact, bench).collect()) == [("", 1), ("clean", 1), ("clean", 1), ("clean", 1)]
    assert decontaminate.find_leaks(d, bench, filter_bytes=8).count() == 3  # a filter that lets nearly everything pass
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == decontaminate.find_leaks(d, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(d, bench.limit(0)).count() == len(rows)


CAPITALS = {chr(c) for c in [*range(65, 91), *range(0xC0, 0xDF)]} - {"\xd7"}


def plain_forms(text):
    """The three forms of a text as lists of (token, value, is slot), by characters and loops."""
    words, begins, start = [], [], True
    for piece in re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text or ""):
        word, stop = "", start
        for c in piece:
            if c.isascii() and not c.isalnum():
                start = start or c in ".!?:\n"
                continue
            if not word:
                stop = start
            word, start = word + c, False
        if word:
            words.append(word)
            begins.append(stop)
    low = ["".join(c.lower() if c in CAPITALS else c for c in w) for w in words]
    number = [w[0] in "0123456789" for w in words]
    unit = [i > 0 and number[i - 1] and not number[i] and low[i] in decontaminate.UNITS for i in range(len(words))]
    capital = [w[0] in CAPITALS and len(w) > 1 and w[1] not in CAPITALS and not u for w, u in zip(words, unit, strict=True)]
    forms = []
    for name in ([c and not b for c, b in zip(capital, begins, strict=True)], capital):
        out = []
        for i, w in enumerate(low):
            if name[i] and i and name[i - 1]:
                out[-1] = ("NAME", tuple(sorted((*out[-1][1], w))), True)
            elif number[i] or unit[i] or name[i]:
                out.append(("NUMBER" if number[i] else "UNIT" if unit[i] else "NAME", (w,), True))
            else:
                out.append((w, (w,), False))
        forms.append(out)
    return [*forms, [(w, (w,), False) for w in low]]


def plain_windows(form, f, k, least):
    """The (length, template, slot pattern) of the windows that count, with their first tokens."""
    out = {}
    for n in ({k} if len(form) >= k else {len(form)}) - {0}:
        for p in range(len(form) - n + 1):
            w = form[p : p + n]
            if sum(not slot for *_, slot in w) < (min(least, n) if f < 2 else 1) or (f < 2 and n < min(least, k)):
                continue
            values = [v for _, v, slot in w if slot]
            out.setdefault((n, tuple(x for x, *_ in w), tuple(values.index(v) for v in values)), []).append(p)
    return out


def brute_leaks(rows, items, k, least):
    out = set()
    for item_id, item in items:
        for doc_id, text in rows:
            best = (0, 0)
            for f, (a, b) in enumerate(zip(plain_forms(item), plain_forms(text), strict=True)):
                want = plain_windows(a, f, k, least)
                hits = [(p, n) for n in {key[0] for key in want} for p in range(len(b) - n + 1) for key in plain_windows(b[p : p + n], f, k, least) if key in want]
                covered = {x for p, n in hits for x in range(p, p + n)}
                best = (max(best[0], len(covered)), max(best[1], len(hits)))
            if best[1]:
                out.add((doc_id, item_id, *best))
    return out


def test_op9_agrees_with_plain_python(spark):
    """Random sentences over few words, numbers, units and names, in which windows often meet with other values."""
    rng = np.random.default_rng(12)
    vocab = ["the", "a", "kilo", "kg", "Tom", "Ann", "Élan", "5", "7", "12", "red", "blue.", "bird!", "Paris,", "walks", "USA", "x-y", "no:"]
    sentence = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, sentence(int(rng.integers(1, 12)))) for i in range(25)]
    rows = [(i, sentence(int(rng.integers(0, 40)))) for i in range(60)]
    rows += [(100 + i, f"{sentence(5)} {x.replace('Tom', 'Max').replace('5', '9')} {sentence(3)}") for i, x in items]
    got = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), k=5, least_plain=2).collect()
    want = brute_leaks(rows, items, 5, 2)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_op9_finds_planted_passages(spark):
    """Copies of each kind that a benchmark leaks by: recall 1 and no clean text taken."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghijk"), 6))
    kinds = [lambda x: x, str.upper, str.lower, lambda x: x.replace("Kim", "Lou"), lambda x: x.replace(" 41 ", " 57 "), lambda x: x.replace(" 41 ", " 57 ", 1)]
    items = [(i, f"{' '.join(word() for _ in range(8))} Kim has 41 kg {' '.join(word() for _ in range(14))} 41 {' '.join(word() for _ in range(12))}") for i in range(40)]
    rows = [(i, f"{' '.join(word() for _ in range(30))}. {kinds[i % 6](x)} {' '.join(word() for _ in range(9))}") for i, x in items] + [(100 + i, " ".join(word() for _ in range(60))) for i in range(40)]
    got = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(40)}


def leaks(item, text):
    """(tokens, windows) of the match of one item and one text, or None."""
    (_, _, *i), (_, _, *t) = (next(tk.slices(pa.array([x], pa.large_string()))) for x in (item, text))
    keys, found = decontaminate.item_keys(*i, 10, 6), decontaminate.text_keys(*t, 10, 6, list(range(1, 10)))
    want = set(zip(keys.key.tolist(), keys.second.tolist(), strict=True))
    best = (0, 0)
    for form in range(3):
        hits = [(b, n) for key, second, b, n, f in zip(found.key.tolist(), found.second.tolist(), found.begin.tolist(), found.length.tolist(), found.form.tolist(), strict=True) if f == form and (key, second) in want]
        best = max(best, (len({x for b, n in hits for x in range(b, b + n)}), len(hits)))
    return best if best[1] else None


def test_op9_one_conflicting_slot_drops_no_other_window(spark, tmp_path):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)]
    item = " ".join([*words[:20], "7", *words[20:40], "7", *words[40:]])
    assert leaks(item, item)[0] == 52
    assert leaks(item, item.replace("7", "8", 1))[0] >= 41
    merged = " ".join([*words[:20], "5", *words[20:40], "7", *words[40:]])
    assert leaks(merged, merged.replace("5", "6").replace("7", "6"))[0] >= 41
    assert leaks("one two three 5 four five six seven 7 eight", "one two three 6 four five six seven 6 eight") is None
    spark.createDataFrame([(1, item.replace("7", "8", 1)), (2, "clean")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in decontaminate.op9_decontaminate(spark, str(tmp_path)).collect()] == [(1, 1)]


@pytest.mark.parametrize("item, bare", [("What is 12 + 7 * 3 - 4 / 2?", "What is 13 + 8 * 4 - 5 / 3?"), ("Name the largest moon", "Name the largest lake"), ("Convert 5 km 3 m 20 cm to mm", "Convert 6 km 2 m 30 cm to mm"), ("List Oslo Bern Rome Paris Kyiv Riga 1 2 3 4 5 6 7 8 9", "List Bonn Bern Rome Paris Kyiv Riga 2 3 4 5 6 7 8 9 1")])
def test_op9_finds_copies_of_items_with_few_plain_words(item, bare):
    assert leaks(item, f"some text before it. {item} and after") is not None
    assert leaks(item, f"some text before it. {bare} and after") is None
    assert leaks(item, "other text") is leaks("", item) is leaks(item, "") is None


def test_op9_names_by_case_and_place():
    item = "In the shop Tom buys 5 apples and gives 2 kg to Ann before Tom walks home alone again"
    assert leaks(item, item.upper()) and leaks(item, f"so it goes {item.lower()}") and leaks(item, item.title())
    assert leaks("The shop sells 5 red apples for each day", "Question The shop sells 5 red apples for each day")
    opened = "Tom carries 5 red apples down into the old kitchen"
    assert leaks(opened, "It is late. Bob carries 7 red apples down into the old kitchen")
    assert leaks(opened, "And then Bob carries 7 red apples down into the old kitchen")
    assert leaks(opened, "It is late. Bob carries 7 green apples down into the old kitchen") is None


