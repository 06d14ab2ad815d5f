import zlib
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import ppm

TEXTS = ["the cat sat on the mat", "The CAT\tsat", None, "", "mat mat mat", "an owl \x0b é", "zzz", "the mat"]


def brute_model(train):
    """P(symbol | two bytes before) with escapes and exclusion, by definition."""
    follow = {k: {} for k in (0, 1, 2)}
    for t in train:
        seq = b"\xff\xff" + t + b"\xff"
        for i in range(2, len(seq)):
            for k in (0, 1, 2):
                follow[k].setdefault(seq[i - k : i], Counter())[seq[i]] += 1

    def log(context, symbol):
        out, excluded = 0.0, set()
        for k in (2, 1, 0):
            seen = follow[k].get(context[2 - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if left:
                total, kinds = sum(left.values()), len(left)
                if symbol in left:
                    return out + np.log10(left[symbol] / (total + kinds))
                out += np.log10(kinds / (total + kinds))
            excluded |= set(seen)
        return out + np.log10(1 / max(1, 256 - len(follow[0].get(b"", {}))))

    return log


def test_equals_the_definition(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    norm = [ppm.normal(t) for t in TEXTS]
    train = [t for i, t in enumerate(norm) if zlib.crc32(str(i).encode()) % 5 != 1]
    log = brute_model(train)
    words = Counter(w for t in train for w in t.split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    for common in (65_536, 2):
        rows = ppm.score(docs, common_tokens=common).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            t = norm[r["doc_id"]]
            seq = b"\xff\xff" + t + b"\xff"
            assert r["score"] == pytest.approx(sum(log(seq[i - 2 : i], seq[i]) for i in range(2, len(seq))), rel=1e-5)
            cs = [words[w] for w in t.split()] + [len(train)]
            assert r["base_score"] == pytest.approx(sum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs))
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(cs), sum(c > 0 for c in cs), n)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)


def test_odd_rows_and_empty_table(odd, empty):
    assert ppm.score(odd.select("doc_id", "text", "row", "token")).count() == odd.count()
    assert ppm.score(empty).count() == 0


def test_op6_counts_contexts_of_five_bytes(spark, tmp_path):
    texts = [f"{w} {w}s {a}ring {w}{a}" for w in ("cat", "at", "owl", "scatter") for a in ("st", "b", "scat", "é")] + TEXTS
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = [ppm.normal(t) for t in texts]
    follow = {k: {} for k in range(6)}
    for i, t in enumerate(norm):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            seq = b"\xff" * 5 + t + b"\xff"
            for j in range(5, len(seq)):
                for k in range(6):
                    follow[k].setdefault(seq[j - k : j], Counter())[seq[j]] += 1

    def log(context, symbol):
        out, excluded = 0.0, set()
        for k in range(5, -1, -1):
            left = {s: n for s, n in follow[k].get(context[5 - k :], {}).items() if s not in excluded}
            if left:
                total, kinds = sum(left.values()), len(left)
                if symbol in left:
                    return out + np.log10(left[symbol] / (total + kinds))
                out += np.log10(kinds / (total + kinds))
                excluded |= set(left)
        return out - np.log10(256 - len(follow[0][b""]))

    rows = ppm.op6_ppm_scores(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        seq = b"\xff" * 5 + norm[r["doc_id"]] + b"\xff"
        assert r["score"] == pytest.approx(sum(log(seq[j - 5 : j], seq[j]) for j in range(5, len(seq))), rel=1e-5)
