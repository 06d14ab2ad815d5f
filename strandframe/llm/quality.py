"""Quality by nearest-neighbour voting over latent-semantic vectors.

Method: a text is a bag of hashed terms: its words, the shapes of its tokens (letter case, digits and punctuation runs),
and a few terms for repetition. Weighted by inverse document frequency, the labelled texts are projected on their
leading singular vectors. The labelled latent vectors are broadcast (at most ``sample`` rows of ``rank`` numbers); every
document is compared with all of them by exact cosine products in blocks, and its nearest neighbours vote with their
similarity.

The classifier is fitted on a bounded sample of the labelled training rows: the ``sample`` rows (default 4,096) whose
hashed id is smallest. Every document is scored on its whole text.

Defined results: a null or empty text has no terms and gets the training rows' share of label 1; rows with a null
document id are scored, never learnt from; labels that are null or other than 0 or 1 are not used; of several labels of
one id the greatest holds; of several texts of one id one is learnt from, chosen by hash; with no labelled rows every
score is 0.5; ties between neighbours go to the row that comes first by id as text; repeated rows each give a row; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.filters import kept
from strandframe.llm.words import WORD_TABLE, slices

WORD_DIMS, SHAPE_DIMS, EXTRA = 1024, 480, 32
DIMS = WORD_DIMS + SHAPE_DIMS + EXTRA
#: Upper case to A, lower case and other scripts to a, digits to 9, white space to a space, punctuation as it is.
SHAPE_TABLE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else 32 if c <= 32 or c == 127 else c for c in range(256))


RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word) % WORD_DIMS
        if len(word) <= 256:
            self[word] = value
        return value


class _Shapes(dict):
    """Runs of one class count once or as two and more: AAAA!! is A+!+."""

    def __missing__(self, shape: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = WORD_DIMS + xxhash.xxh3_64_intdigest(RUN.sub(rb"\1+", shape)) % SHAPE_DIMS
        if len(shape) <= 256:  # longer ones are worked out each time, so that what is kept is bounded
            self[shape] = value
        return value


_WORDS, _SHAPES = _Words(), _Shapes()


def features(text: str | None) -> np.ndarray:
    """Term weights of one text, before document frequencies: square roots of shares, words and shapes alike."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIMS, np.float32)
    tokens = raw.translate(SHAPE_TABLE).split()
    if not tokens:
        return out
    words = raw.translate(WORD_TABLE).split()
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    shapes = np.fromiter(map(_SHAPES.__getitem__, tokens), np.int64, len(tokens))
    if len(ids):
        out[:WORD_DIMS] = np.sqrt(np.bincount(ids, minlength=WORD_DIMS) / len(ids))
    out[WORD_DIMS : WORD_DIMS + SHAPE_DIMS] = np.sqrt(np.bincount(shapes - WORD_DIMS, minlength=SHAPE_DIMS) / len(shapes))
    lines = raw.split(b"\n")
    extra = out[WORD_DIMS + SHAPE_DIMS :]
    extra[0] = 2 * np.sqrt(np.mean(ids[1:] == ids[:-1])) if len(ids) > 1 else 0  # a word said twice running
    extra[1] = np.sqrt(1 - len(set(lines)) / len(lines))  # lines said again
    extra[2] = np.sqrt(max(0.0, 1 - len(set(words)) / max(1, min(len(words), 400))))  # few different words
    extra[3 + min(9, int(np.log2(len(tokens))))] = 0.15  # length
    extra[14 + min(9, int(len(raw) / len(tokens)))] = 0.15  # length of words
    return out


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest values of each row; of equal ones at the bound the first."""
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, top, 1).min(1)
    for row in np.flatnonzero((near >= least[:, None]).sum(1) > k):
        above, level = np.flatnonzero(near[row] > least[row]), np.flatnonzero(near[row] == least[row])
        top[row] = np.concatenate([above, level[: k - len(above)]])
    return top


@dataclass
class Model:
    project: np.ndarray  # DIMS x rank
    vectors: np.ndarray  # rows x rank, of unit length
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        known = x.any(axis=1)
        for at in range(0, len(x), 256):
            near = self.latent(x[at : at + 256]) @ self.vectors.T
            top = nearest(near, k)
            weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6) ** self.power
            out[at : at + 256] = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.where(known, np.clip(out, 0, 1), self.prior)


def _leading(square: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of a symmetric matrix, by iterating a slightly larger subspace."""
    basis = np.random.default_rng(11).normal(size=(len(square), min(len(square), rank + 16)))
    for _ in range(10):
        basis, _ = np.linalg.qr(square @ basis)
    values, small = np.linalg.eigh(basis.T @ square @ basis)
    return (basis @ small)[:, ::-1][:, :rank]


def fit(x: np.ndarray, labels: np.ndarray, rank: int = 64, neighbours: int = 15, power: float = 8.0) -> Model:
    """x: a row of features per labelled text."""
    if not len(x):
        return Model(np.zeros((DIMS, rank), np.float32), np.zeros((0, rank), np.float32), labels, 0.5, neighbours, power)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float64) + 0.1
    scaled = x * idf
    rank = min(rank, len(x))
    project = (idf[:, None] * _leading(scaled.T.astype(np.float64) @ scaled, rank)).astype(np.float32)
    model = Model(project, np.zeros((0, rank), np.float32), labels.astype(np.float32), float(labels.mean()), neighbours, power)
    model.vectors = model.latent(x)
    return model


def training_id(doc_id) -> F.Column:
    """True for ids that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4096, **options) -> Model:
    """Fit on the bounded sample of the labelled rows that may be learnt from; their features, not texts, reach the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(training_id("id")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # an id may stand in many rows; partial aggregation leaves one a task before the shuffle
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")
    rows = rows.groupBy("id", "label").agg(one).select(F.col("id").cast("string"), "text", "label")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = [features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["id", "label", "x"])

    found = rows.mapInArrow(terms, "id string, label int, x binary").toArrow().to_pydict()
    order = sorted(range(len(found["id"])), key=lambda i: (found["id"][i], found["x"][i]))
    x = np.stack([np.frombuffer(found["x"][i], np.float16) for i in order]).astype(np.float32) if order else np.zeros((0, DIMS), np.float32)
    return fit(x, np.array([found["label"][i] for i in order], np.float32), **options)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *carry, score double`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts, found = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), 512):
                found.append(shared.value.score(np.stack([features(t) for t in texts[at : at + 512]])))
            kept = [batch.column(0), *batch.columns[2:]]
            yield pa.record_batch([*kept, pa.array(np.concatenate(found), pa.float64())], ["_id", *batch.schema.names[2:], "score"])

    out = rows.mapInArrow(score, ", ".join([f"_id {kinds['_id']}", *[f"_c{i} {kinds[f'_c{i}']}" for i in range(len(carry))], "score double"]))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "score")


def held_out(doc_id: object) -> bool:
    """The rule of training_id for one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op8_knn_quality(spark, sf_dir: str) -> DataFrame:
    """Score every whole text of documents; labels teach from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select("doc_id", (~training_id("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list[str | None]) -> np.ndarray:
        return np.concatenate([shared.value.score(np.stack([features(t) for t in texts[at : at + 512]])) >= threshold for at in range(0, len(texts), 512)])

    return kept(docs, decide, text_col)
