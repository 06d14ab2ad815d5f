import numpy as np
from pyspark.sql import functions as F

from strandframe.llm import vantage as V


def brute(ids, x, q, k):
    d = V.distances(x, x[q])
    mine = ids != ids[q]
    order = np.lexsort((ids[mine], d[mine]))[:k]
    return list(zip(ids[mine][order].tolist(), d[mine][order].tolist(), strict=True))


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


def test_exact_with_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3)).astype(np.float32)
    x[::3] = x[0]
    df = table(spark, x)
    ids, wide = np.arange(len(x)), x.astype(np.float64)
    for query_bytes in (16 << 20, 100):  # in one block, in several
        found = V.search(df, df.where("vec_id % 100 = 0"), shard_rows=200, query_bytes=query_bytes).orderBy("query_id", "rank").collect()
        for q in range(0, len(x), 100):
            assert [(r["id"], r["score"]) for r in found if r["query_id"] == q] == brute(ids, wide, q, 10)


def test_pruning_and_its_relaxation():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 2))
    ids = np.arange(len(x))
    counts, recall = [], []
    for relax in (1.0, 3.0):
        tree = V.Tree(ids, x)
        near, _ = tree.search(ids[:50], x[:50], 10, relax)
        hits = [len({i for i, _ in brute(ids, x, q, 10)} & set(near[q].tolist())) for q in range(50)]
        counts.append(tree.compared)
        recall.append(sum(hits) / 500)
    assert recall[0] == 1 and recall[1] >= 0.6 and counts[1] < counts[0] < 0.5 * 50 * 6000


def test_recall_of_a_mild_relaxation():
    x = np.random.default_rng(7).normal(size=(20_000, 4))
    ids, q = np.arange(len(x)), np.arange(0, 20_000, 200)
    near = [V.Tree(ids, x).search(q, x[q], 10, relax)[0] for relax in (1.0, 1.5)]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(*(n.tolist() for n in near), strict=True)]) >= 0.95


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = V.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 100, 0.5), (100, 1, 0, 0.5)]
    none = df.where("vec_id < 0")
    assert V.search(none, none).count() == 0


def test_repeated_queries(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    df = table(spark, x)
    df = df.unionByName(df.where("vec_id = 0"))
    got = V.search(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == brute(np.arange(60), x.astype(np.float64), 0, 10)
    # one id, two vectors: each ranked apart
    two = df.where("vec_id = 0").limit(1).unionByName(df.where("vec_id = 1").withColumn("vec_id", F.lit(0).cast("long")))
    ranks = [r["rank"] for r in V.search(df.where("vec_id > 1"), two).collect()]
    assert sorted(ranks) == sorted([*range(1, 11)] * 2)


def test_a_query_that_a_candidate_repeats(spark):
    x = np.ones((5, 2), np.float32)
    df = table(spark, x)
    got = V.search(df.unionByName(df.where("vec_id = 3")), df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 3, 4]
