import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import suffixes as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_by_definition():
    rng = np.random.default_rng(1)
    for t in range(200):
        n = rng.integers(1, 200)
        data = np.append(rng.integers(1, rng.integers(2, 5), n), 0).astype(np.uint8)
        if t % 3 == 0:
            data[rng.integers(0, n, 5)] = 0
        depth = int(rng.choice([8, 16, 40, 64, 200]))
        order, raw = S.suffix_array(data, depth), data.tobytes()
        keys = [raw[i : i + depth].ljust(depth, b"\0") for i in order]
        assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 100}, {"shard_bytes": 3000}])
def test_against_brute_force(spark, options):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(1, 300))) for _ in range(12)]
    texts = ["".join(rnd.choice(base)[rnd.randint(0, 20) : rnd.randint(100, 300)] for _ in range(rnd.randint(0, 5))) for _ in range(120)] + [None, "", "x" * 1000, "xy" * 300]
    texts += texts[:5]
    df = spark.createDataFrame([(i % 120, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, h int").repartition(5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in S.deduplicate(df, length=40, **options).collect())
    assert got == sorted((i % 120, *x) for i, x in enumerate(brute(texts, 40)))


def test_suffixes_from_wanted_places_only():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(50, 400))
        data = np.append(rng.integers(1, rng.integers(2, 5), n), 0).astype(np.uint8)
        starts = np.unique(rng.integers(0, n - 40, 30))
        hit = S.repeated(data, starts, 40)
        raw = data.tobytes()
        count = Counter(raw[i : i + 40] for i in starts)
        assert [i for i in starts if count[raw[i : i + 40]] > 1] == list(np.flatnonzero(hit))


def test_a_line_that_most_texts_hold(spark):
    """Its anchors' groups exceed a shard many times over, at every split."""
    rnd = random.Random(8)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(44))
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
    texts = [f"{word()}{line}{word()}" for _ in range(600)] + [f"{word()}{line[:38]}{word()}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in S.deduplicate(df, length=40, shard_bytes=500).collect())
    assert got == sorted((i, *x) for i, x in enumerate(brute(texts, 40)))


def test_odd_rows_and_empty_table(odd, empty):
    rows = S.deduplicate(odd).collect()
    assert len(rows) == odd.count() and next(r for r in rows if r["doc_id"] == 4)["n_removed"] == 70_000
    assert S.deduplicate(empty).count() == 0
