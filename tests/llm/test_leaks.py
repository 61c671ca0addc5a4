from __future__ import annotations

import random

from strataform.llm import leaks
from tests.conftest import rows

WORDS = [f"w{i}" for i in range(30)]


def edit_distance(pattern, text):
    """Least distance of the pattern to any part of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(before[j - 1] + (p != t), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_equals_the_table():
    rnd = random.Random(4)
    for _ in range(300):
        pattern = [rnd.choice("abcd") for _ in range(rnd.randint(1, 12))]
        text = [rnd.choice("abcd") for _ in range(rnd.randint(0, 20))]
        masks = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        assert leaks.myers(masks, len(pattern), text, len(pattern)) == edit_distance(pattern, text)


def brute(docs, items, n, errors):
    out = set()
    for d, t in docs:
        for i, s in items:
            if t is None or s is None:
                continue
            w, p = leaks.words(t), leaks.words(s)
            distances = [edit_distance(p[k : k + n], w) for k in range(len(p) - n + 1)]
            if distances and min(distances) <= errors:
                out.add((d, i, min(distances)))
    return sorted(out, key=repr)


def made(rnd):
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(8, 30)))) for i in range(6)]
    docs = []
    for d in range(60):
        w = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 25))]
        p = leaks.words(rnd.choice(items)[1])
        a = rnd.randint(0, max(0, len(p) - 10))
        part = p[a : a + rnd.randint(6, 14)]
        if rnd.random() < 0.6 and part:
            part[rnd.randrange(len(part))] = rnd.choice([*WORDS, "other", ""])
        docs.append((d, ", ".join(x for x in w + part + w if x).upper()))
    return docs, items


def run(spark, docs, items, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return rows(leaks.find_leaks(d, i, **k))


def test_leaks_equal_brute_force(spark):
    docs, items = made(random.Random(8))
    for errors in (0, 1, 2):
        assert run(spark, docs, items, errors=errors) == brute(docs, items, 10, errors)


def test_items_in_several_passes(spark):
    docs, items = made(random.Random(9))
    assert run(spark, docs, items, per_pass=2) == brute(docs, items, 10, 1)


def test_odd_texts_nulls_repeats_and_empty(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, "ONE­ two, three—four\nfive `six` seven 'eight' NINE​ ten"),
        (1, "ONE­ two, three—four\nfive `six` seven 'eight' NINE​ ten"),
        (2, None),
        (3, ""),
        (4, "x " * 50_000 + item),
        (5, "one two three four five six seven eight nine"),
        (None, item),
    ]
    items = [(7, item), (7, item), (8, None), (9, "too short"), (None, item)]
    assert run(spark, docs, items, errors=0) == [(1, 7, 0), (4, 7, 0)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
