import random

import pytest

from strandframe.llm import jaccard as J
from strandframe.llm.words import words


def brute(texts, ids, k=5, t=0.8):
    sets = []
    for x in texts:
        w = words(x)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    low = {}
    for i in range(len(sets)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], low[find(i)], links[i]) for i in range(len(sets)))


@pytest.fixture(scope="module")
def case(spark):
    rnd, texts = random.Random(4), []
    voc = [f"w{i}" for i in range(300)]
    for size in (3, 10, 60, 25):
        base = [rnd.choice(voc) for _ in range(rnd.randint(40, 150))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(voc)
            texts.append(" ".join(w))
    texts += ["a", "a", "a b", "", "", None, "A, b!", *texts[:4]]
    ids = list(range(len(texts)))
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4), brute(texts, ids)


@pytest.mark.parametrize("options", [{}, {"small": 2, "block": 4}, {"small": 5}, {"small": 2, "block_shingles": 300}])
def test_against_brute_force(case, options):
    df, want = case
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.join(df, **options).collect()) == want


def test_posterior_bound():
    assert J.least_matches(0.8, 1e-6)[0] == (16, 3) or J.least_matches(0.8, 1e-6)[0][1] < 8
    assert all(m <= 0.8 * n for n, m in J.least_matches(0.8, 1e-6))


def test_odd_rows_and_empty_table(odd, empty):
    got = J.join(odd).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r["doc_id"] in (1, 5)]
    assert {r["class_id"] for r in same} == {1} and {r["n_links"] for r in same} == {2}
    assert J.join(empty).count() == 0
