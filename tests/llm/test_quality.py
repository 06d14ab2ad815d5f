import numpy as np
from pyspark.sql import functions as F

from strandframe.llm import quality as K

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = K.op8_knn_quality(spark, SF).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 1000 and len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(r["held_out"] == K.held_out(r["doc_id"]) for r in got)


def test_exact_products_in_blocks():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(700, K.DIMS))).astype(np.float32)
    model = K.fit(x, (rng.random(700) < 0.5).astype(np.float32), rank=8, neighbours=5)
    z = model.latent(x)
    near = z @ model.vectors.T
    for i in (0, 300, 699):
        top = np.argsort(-near[i])[:5]
        w = np.maximum(near[i][top], 1e-6) ** model.power
        assert abs(model.score(x)[i] - (w * model.labels[top]).sum() / w.sum()) < 1e-3


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (None, 1), (6, None), (4, 7)], "doc_id long, quality int")
    model = K.train(odd, labels)
    rows = K.scores(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = K.train(odd, labels.limit(0))
    assert {r["score"] for r in K.scores(odd, none).collect()} == {0.5}
    assert K.scores(empty, none).count() == 0
    kept = K.accepted(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_ties_go_to_the_first_row():
    rng = np.random.default_rng(5)
    near = rng.integers(0, 4, (50, 40)).astype(np.float32)
    got = np.sort(K.nearest(near, 7), axis=1)
    want = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :7], axis=1)
    assert np.array_equal(got, want)


def test_shapes_of_whole_tokens():
    a, b = K.features("x" + "Ab1" * 40 + "!"), K.features("x" + "Ab1" * 40 + "?")
    assert not np.array_equal(a, b)
    shapes = slice(K.WORD_DIMS, K.WORD_DIMS + K.SHAPE_DIMS)
    assert np.array_equal(K.features("AAAA!! abc")[shapes], K.features("BBBBBB!!! xyzw")[shapes])
    assert K.features("A1" * 400_000 + " " + "z" * 400_000).any()


def test_an_id_of_many_rows_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(40)] + [(2, "other words"), (3, None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    model = K.train(docs, labels)
    assert len(model.labels) == sum(not K.held_out(i) for i in (1, 2, 3))


def test_fit_and_scores_as_a_whole(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, " ".join(rnd.choice(["good", "fine", "calm"] if i % 2 else ["BAD!!", "junk", "1234"], 30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = K.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in K.scores(docs, model).collect()}
    # by definition: the features of the rows that may be learnt from, in order of their ids as text
    learnt = sorted((i for i, _ in rows if not K.held_out(i)), key=str)
    x = np.stack([K.features(rows[i][1]) for i in learnt]).astype(np.float16).astype(np.float32)
    again = K.fit(x, np.array([i % 2 for i in learnt], np.float32))
    for i, text in rows:
        z = again.latent(K.features(text)[None])[0]
        order = sorted(range(len(learnt)), key=lambda n: (-float(z @ again.vectors[n]), n))[: again.neighbours]
        w = [max(float(z @ again.vectors[n]), 1e-6) ** again.power for n in order]
        assert abs(got[i] - sum(a * again.labels[n] for a, n in zip(w, order, strict=True)) / sum(w)) < 5e-3
        assert (got[i] >= 0.3) == bool(i % 2)
