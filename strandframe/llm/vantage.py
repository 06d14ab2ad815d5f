"""Nearest neighbours by vantage-point trees, one a shard.

Method: the rows that a task reads make shards of ``shard_rows``; vectors are not shuffled. In each shard a vantage-point
tree is built: a node's vantage point is a vector of its own, the rest are halved by their distance to it, and each half
keeps its least and greatest distance. A branch is skipped where the triangle inequality shows that all its vectors are
farther than the k-th found so far, that bound multiplied by ``relax``: with relax = 1 the search is exact; above 1 more
is skipped, recall falls, and what is found depends on how rows are dealt to files.

Queries are broadcast in blocks of about ``query_bytes``, a pass over the vectors each. A task goes on from shard to shard
with the k nearest so far, and gives k rows a query; these are merged. So a task holds one tree and one block of queries
whatever the size of the table. Halving goes by rank, not by value, so that equal vectors, however many, do not
unbalance a tree.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
numbers take no part; ties go to the smaller id; repeated ids are candidates each, other than for the query's own id;
query rows of equal id and vector are one query, those of one id and different vectors a query each, ranked apart;
fewer candidates than k are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.session import stored

LEAF = 256


def distances(block: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares summed in the order of the components, so that every engine gets the same double."""
    total = np.zeros(np.broadcast_shapes(block.shape[:-1], point.shape[:-1]))
    for j in range(block.shape[-1]):
        d = block[..., j] - point[..., j]
        total += d * d
    return np.sqrt(total)


@dataclass
class Node:
    rows: np.ndarray  # of a leaf: all; else: the vantage point
    halves: list  # (least, greatest, node)


def build(x: np.ndarray, rows: np.ndarray) -> Node:
    if len(rows) <= LEAF:
        return Node(rows, [])
    # the point farthest from an arbitrary one lies at the border, where distances spread most
    first = distances(x[rows], x[rows[0]])
    at = int(np.argmax(first))
    rest = np.delete(rows, at)
    far = distances(x[rest], x[rows[at]])
    order = np.argsort(far, kind="stable")
    half = len(rest) // 2
    parts = [(float(far[o[0]]), float(far[o[-1]]), build(x, rest[o])) for o in (order[:half], order[half:])]
    return Node(rows[at : at + 1], parts)


class Tree:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.squares = np.einsum("ij,ij->i", x, x)
        self.root = build(x, np.arange(len(ids))) if len(ids) else None
        self.compared = 0

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, relax: float = 1.0, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), a row of k for each query, missing ones at infinity; best: those of other trees, to go on from."""
        best_i, best_d = best or (np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf))
        squares = np.einsum("ij,ij->i", q, q)

        def offer(active: np.ndarray, rows: np.ndarray) -> None:
            """Products of blocks rule out what is surely farther than the k-th so far; the rest is measured exactly."""
            self.compared += len(active) * len(rows)
            rough = squares[active][:, None] + self.squares[rows][None, :] - 2 * (q[active] @ self.x[rows].T)
            slack = 1e-9 * (squares[active][:, None] + self.squares[rows][None, :])
            a, r = np.nonzero((rough <= best_d[active, k - 1][:, None] ** 2 + slack) & (ids[active][:, None] != self.ids[rows][None, :]))
            if not len(a):
                return
            d = distances(self.x[rows[r]], q[active[a]])
            hit = np.unique(a)
            who = np.concatenate([np.repeat(hit, k), a])
            far = np.concatenate([best_d[active[hit]].ravel(), d])
            ident = np.concatenate([best_i[active[hit]].ravel(), self.ids[rows[r]]])
            order = np.lexsort((ident, far, who))
            first = np.searchsorted(who[order], hit)
            take = order[first[:, None] + np.arange(k)]
            best_d[active[hit]], best_i[active[hit]] = far[take], ident[take]

        def visit(node: Node, active: np.ndarray) -> None:
            offer(active, node.rows)
            if not node.halves:
                return
            d = distances(self.x[node.rows[0]], q[active])
            gaps = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi, _ in node.halves]
            near = gaps[0] <= gaps[1]
            # each query goes to its nearer half first
            for turn in (True, False):
                for h in (0, 1):
                    mine = near == (turn == (h == 0))
                    # a hair of slack for the rounding of distances; equal bounds are followed, for ties
                    todo = mine & (gaps[h] * relax <= best_d[active, k - 1] + 1e-9)
                    if todo.any():
                        visit(node.halves[h][2], active[todo])

        if self.root is not None:
            for at in range(0, len(q), 1024):
                visit(self.root, np.arange(at, min(at + 1024, len(q))))
        return best_i, best_d


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda v: F.coalesce((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, relax: float = 1.0, shard_rows: int = 8192, query_bytes: int = 16 << 20) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest rows of vectors for each row of queries, its own id excluded."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    rows = clean(vectors)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, key long, id long, score double"
    found = spark.createDataFrame([], schema)
    if top is not None:
        width = top["n"]
        asked = stored(clean(queries).where(F.size("v") == width).withColumn("key", F.xxhash64("v")).dropDuplicates(["id", "key"]), "vp-queries")
        blocks = -(-asked.count() * width * 8 // query_bytes)
        for block in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("id", "key"), F.lit(blocks)) == block).select("id", "key", "v").toArrow().combine_chunks()
            if part.num_rows:
                x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                shared = spark.sparkContext.broadcast((part.column("id").to_numpy(), part.column("key").to_numpy(), x))
                found = found.unionByName(rows.where(F.size("v") == width).mapInArrow(_nearest(shared, width, k, relax, shard_rows), schema))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _nearest(shared, width: int, k: int, relax: float, shard_rows: int):
    """Rows ``id, v`` to the k nearest of them for each query of a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, q = shared.value
        best, ids, xs, held = None, [], [], 0

        def look() -> None:
            nonlocal best, ids, xs, held
            if held:
                best = Tree(np.concatenate(ids), np.concatenate(xs)).search(own, q, k, relax, best)
                ids, xs, held = [], [], 0

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, batch.num_rows, shard_rows):
                ids.append(batch.column(0).to_numpy()[at : at + shard_rows].copy())
                xs.append(x[at : at + shard_rows].copy())
                held += len(ids[-1])
                if held >= shard_rows:
                    look()
        look()
        if best is not None:
            good = np.isfinite(best[1])
            yield pa.record_batch([pa.array(np.repeat(c, k)[good.ravel()]) for c in (own, keys)] + [pa.array(best[0][good]), pa.array(best[1][good])], ["query_id", "key", "id", "score"])

    return run


def op2_vp_tree_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for each whose id is divisible by 100; exact (relax = 1)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM g q JOIN g c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS "rank", vec_id, score FROM d)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
