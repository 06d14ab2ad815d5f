import random
import tracemalloc

import numpy as np
import pytest

from strandframe.llm import decontaminate as D


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_best_stretch_is_least_over_all():
    rnd = random.Random(2)
    for _ in range(200):
        a = np.array([rnd.randint(1, 4) for _ in range(rnd.randint(1, 9))])
        b = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(1, 14))])
        d, s, e = D.best_stretch(a, b)
        assert d == min(edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == edit(a, b[s:e])


def planted(rnd, n):
    voc = [f"w{i}" for i in range(800)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.randint(12, 50)))) for i in range(30)]
    docs, truth = [], []
    for _ in range(n):
        i, text = rnd.choice(items)
        w = text.split()
        for _ in range(rnd.randint(0, int(0.2 * len(w)))):
            k, op = rnd.randrange(len(w)), rnd.random()
            if op < 0.5:
                w[k] = rnd.choice(voc)
            elif op < 0.75:
                del w[k]
            else:
                w.insert(k, rnd.choice(voc))
        docs.append(" ".join([*rnd.choices(voc, k=rnd.randint(0, 60)), *w, *rnd.choices(voc, k=40)]))
        truth.append(i)
    clean = [" ".join(rnd.choices(voc, k=200)) for _ in range(100)]
    return items, docs, truth, clean


def test_recall_and_clean_documents():
    items, docs, truth, clean = planted(random.Random(5), 400)
    index = D.Index(items, 0.2, 32, 4)
    found = {(d, i) for d, i, *_ in index.matches(docs)}
    assert sum((n, i) in found for n, i in enumerate(truth)) >= 0.98 * len(truth)
    assert index.matches(clean) == []


def test_verified_against_brute_force():
    items, docs, truth, _ = planted(random.Random(6), 40)
    index = D.Index(items, 0.2, 32, 4)
    text = dict(items)
    for d, i, distance, a, b in index.matches(docs):
        assert edit(text[i].split(), docs[d].split()[a:b]) == distance <= int(0.2 * len(text[i].split()))


def test_operator_on_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a plain text of some words"), (2, None), (3, ""), (4, "a plain text of some words"), (5, "x" * 70_000)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in D.matches(odd, bench).collect())
    assert got == [(1, 1, 0), (1, 4, 0), (4, 5, 0), (5, 1, 0), (5, 1, 0), (5, 4, 0), (5, 4, 0)]
    assert D.matches(odd, bench, block_words=10_000).count() == 7  # in blocks
    left = D.clean(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 4
    assert D.matches(empty, bench).count() == 0 and D.clean(odd, bench.limit(0)).count() == odd.count()


def test_long_items_are_found_at_the_bound():
    rnd = random.Random(9)
    voc = [f"w{i}" for i in range(3000)]
    for width in (59, 100, 200):
        items = [(i, " ".join(rnd.choice(voc) for _ in range(width))) for i in range(8)]
        docs = []
        for n in range(60):
            w = items[n % 8][1].split()
            for k in sorted(rnd.sample(range(width), int(0.2 * width)), reverse=True):
                op = rnd.randrange(3)
                w[k : k + 1] = [[f"x{k}"], [f"x{k}", w[k]], []][op]
            docs.append(" ".join([*rnd.choices(voc, k=30), *w, *rnd.choices(voc, k=30)]))
        found = {(d, i) for d, i, *_ in D.Index(items, 0.2, 32, 4).matches(docs)}
        assert sum((n, n % 8) in found for n in range(60)) >= 0.95 * 60, width


def test_whole_result_against_all_windows():
    """Matches are found where any window of the item's width lies within the distance, and nowhere else."""
    items, docs, _, clean = planted(random.Random(12), 60)
    index = D.Index(items, 0.2, 32, 4)
    found = {(d, i) for d, i, *_ in index.matches(docs + clean[:20])}
    want = set()
    for d, text in enumerate(docs + clean[:20]):
        w = text.split()
        numbers = np.array([index.vocabulary.get(x.encode(), 0) for x in w], np.int64)
        for item_id, item, allowed in index.items:
            if D.best_stretch(item, numbers)[0] <= allowed:
                want.add((d, item_id))
    assert found <= want and len(found) >= 0.99 * len(want)


def test_the_walks_bits_tabled_or_worked_out_are_the_same():
    items, docs, _, _ = planted(random.Random(13), 60)
    assert D.Index(items, 0.2, 32, 4).matches(docs) == D.Index(items, 0.2, 32, 4, table_bytes=0).matches(docs)


def test_a_long_item_among_many_words_takes_memory_in_proportion():
    rnd = random.Random(14)
    items = [(i, " ".join(f"v{rnd.randrange(100_000)}" for _ in range(20))) for i in range(3000)] + [(-1, " ".join(f"l{i}" for i in range(1500)))]
    tracemalloc.start()
    index = D.Index(items, 0.2, 4, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak
    assert [m[1] for m in index.matches([items[-1][1], items[5][1]])] == [-1, 5]


def test_edits_that_leave_no_pair_are_refused():
    with pytest.raises(ValueError, match="third"):
        D.Index([(1, "a b c d e")], 0.4, 32, 4)
