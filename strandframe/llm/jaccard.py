"""Near-duplicate join on sets of word shingles, exact above the threshold.

Method: texts with equal sets are one class (their similarity is 1). A class has a MinHash signature; classes that agree
in one band of ``rows`` values or more are candidates. A candidate's signatures are compared a few values at a time, and
the pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls
below ``tolerance``. What is left is verified by the exact Jaccard coefficient of the whole sets.

With 32 bands of 5 rows a pair of similarity 0.8 is missed with probability 4e-6, and pruned wrongly with about
``tolerance``.

Buckets of up to ``small`` classes give pairs, made distinct. Larger buckets are cut into blocks of about ``block``
classes (fewer where the sets are large: about ``block_shingles`` shingles); each pair of blocks is a task that compares its classes as matrices and returns sums for each class and a
spanning forest of the links, never the pairs themselves. A pair that meets in several large buckets counts in the
first one only, and not among the pairs of small ones. So no link is lost and no group is gathered in one task.

Defined results: words are as in ``words``; a text of fewer than k words has one shingle of them all; null, empty and
wordless texts have no shingles, link with nothing and are classes of their own; repeated rows are copies, each counted;
a null id can be in a class, whose id is the smallest id that is not null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.words import HashCache, shingle_hashes, slices, word_hashes, words
from strandframe.session import dropped, held, released, stored

BANDS, ROWS, STEP = 32, 5, 16
HASHES = BANDS * ROWS
#: Pairs whose signatures a task compares at a time.
PAIRS = 8192
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(text: str | None, k: int, cache: HashCache) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words(text), cache), k))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, HASHES a row; the sets hold one shingle or more."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for h in range(HASHES):
            out[:, h] = np.minimum.reduceat(((flat * _A[h] + _B[h]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches to go on): below, P(similarity >= threshold | matches) < tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:  # P(Binomial(n + 1, threshold) <= m) is the posterior with a uniform prior
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Indices of the rows of two signature matrices that are not pruned."""
    alive, matched, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_matches(threshold, tolerance):
        matched[alive] += (a[alive, at:n] == b[alive, at:n]).sum(1, dtype=np.int32)
        alive, at = alive[matched[alive] >= least], n
        if not len(alive):
            break
    return alive


def reaches(inter: np.ndarray | int, na: np.ndarray | int, nb: np.ndarray | int, threshold: float):
    return inter >= threshold * (na + nb - inter) - 1e-9


def _first_hot_band(a: np.ndarray, b: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first band in which rows of a and b agree and whose bucket is large; BANDS if there is none."""
    same = (a.reshape(-1, BANDS, ROWS) == b.reshape(-1, BANDS, ROWS)).all(2) & ((hot[:, None] >> np.arange(BANDS)) & 1).astype(bool)
    return np.where(same.any(1), same.argmax(1), BANDS)


def _matrix(column: pa.Array, kind=np.uint32, width: int = HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a] and sets[b]; each left set is marked once, its partners counted together."""
    used = np.unique(np.concatenate([a, b]))
    values, code = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    ends = np.cumsum([len(sets[u]) for u in used])
    codes = np.split(code, ends[:-1])
    left, right = np.searchsorted(used, a), np.searchsorted(used, b)
    out, mark = np.zeros(len(a), np.int64), np.zeros(len(values), bool)
    order = np.argsort(left, kind="stable")
    cuts = np.flatnonzero(np.diff(left[order])) + 1
    for group in np.split(order, cuts):
        mine = codes[left[group[0]]]
        mark[mine] = True
        partners = [codes[r] for r in right[group]]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in partners])[:-1]])
        out[group] = np.add.reduceat(mark[np.concatenate(partners)], starts, dtype=np.int64)
        mark[mine] = False
    return out


def block_links(sig: np.ndarray, hot: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, band: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the copies of each row's links, root of each row) within one block (same) or between sides 0 and 1."""
    n = len(sig)
    left, right = (np.arange(n), np.arange(n)) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, root = np.zeros(n, np.int64), np.arange(n)
    edges_a, edges_b = [], []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        # the first step for all pairs as a matrix, the later ones for what is left
        first, least = least_matches(threshold, tolerance)[0]
        close = np.zeros((len(rows), len(right)), np.uint8)
        for h in range(first):
            close += sig[rows, h][:, None] == sig[right, h][None, :]
        i, j = np.nonzero(close >= least)
        a, b = rows[i], right[j]
        if same:
            a, b = a[a < b], b[a < b]
        # in a group of near copies all pairs are left: some signatures at a time, not all pairs' at once
        for at_pair in range(0, len(a), PAIRS):
            some_a, some_b = a[at_pair : at_pair + PAIRS], b[at_pair : at_pair + PAIRS]
            keep = survivors(sig[some_a], sig[some_b], threshold, tolerance)
            some_a, some_b = some_a[keep], some_b[keep]
            keep = _first_hot_band(sig[some_a], sig[some_b], hot[some_a]) == band
            edges_a.append(some_a[keep].astype(np.int32))
            edges_b.append(some_b[keep].astype(np.int32))
    a, b = np.concatenate([*edges_a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*edges_b, np.zeros(0, np.int64)]).astype(np.int64)
    if not len(a):
        return links, root
    sizes = np.array([len(s) for s in sets])
    inter = intersections(sets, a, b)
    good = reaches(inter, sizes[a], sizes[b], threshold)
    a, b = a[good], b[good]
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while True:  # least label of each component
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return links, root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """``node, root``, stored, from edges ``a, b``: the least node of each component, by passing the least label on and jumping to
    the label's own label; each round is written, and rounds grow with the logarithm of a component's width."""
    both = held(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct())
    before = labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels", small=True)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        passed = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        jumped = passed.join(jump, F.col("root") == F.col("n2"), "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "was")
        done = stored(jumped, "cc-labels", small=True)
        dropped(before)
        before, labels = done, done.select("node", "root")
        if not done.where(F.col("root") != F.col("was")).limit(1).count():
            released(both)
            return done


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, small: int = 24, block: int = 1024, block_shingles: int = 1_000_000) -> DataFrame:
    """``id_col, class_id, n_links, exact_id`` for every row.

    class_id: the smallest id of the texts joined by a chain of links; n_links: other rows of similarity threshold or
    more; exact_id: the smallest id of the rows with an equal set.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingles(t, k, cache) for t in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full) if full else [])
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["id", "cls", "sig", "size"])

    signed = stored(rows.mapInArrow(sign, f"id {kind}, cls binary, sig binary, size long"), "nd-signed")
    classes = held(signed.where("cls is not null").groupBy("cls").agg(F.min("id").alias("exact_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size")))
    width = ROWS * 4
    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr(F.col("sig"), i * width + 1, F.lit(width))))
    bands = classes.select("cls", "size", F.posexplode(bucket).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("size").alias("held")).where("m > 1")
    met = held(bands.drop("size").join(shared, "bucket"))
    large = met.where(F.col("m") > small)
    hot = large.groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("hot"))
    known = stored(met.select("cls").distinct().join(classes, "cls").join(hot, "cls", "left").select("cls", "exact_id", "copies", "sig", F.coalesce("hot", F.lit(0).cast("long")).alias("hot")), "nd-known")

    # small buckets: distinct pairs, pruned
    few = met.where(F.col("m") <= small).groupBy("bucket").agg(F.collect_list("cls").alias("l"))
    pairs = few.select("l", F.explode("l").alias("a")).select("a", F.explode("l").alias("b")).where("a < b").distinct()
    side = lambda s, *more: known.select(F.col("cls").alias(s), *[F.col(c).alias(c + s) for c in ("sig", "copies", *more)])
    paired = pairs.join(side("a", "hot"), "a").join(side("b"), "b").select("a", "b", "siga", "sigb", "hota", "copiesa", "copiesb")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, hot_bands = _matrix(batch.column(2)), _matrix(batch.column(3)), batch.column(4).to_numpy()
            keep = survivors(a, b, threshold, tolerance)
            keep = keep[_first_hot_band(a[keep], b[keep], hot_bands[keep]) == BANDS]
            yield batch.select(["a", "b", "copiesa", "copiesb"]).take(pa.array(keep))

    likely = stored(paired.mapInArrow(prune, "a binary, b binary, copiesa long, copiesb long"), "nd-likely", small=True)

    # whole sets of the classes that are still to be verified, made again from one text each
    wanted = likely.select(F.col("a").alias("cls")).unionByName(likely.select(F.col("b").alias("cls"))).unionByName(large.select("cls")).distinct()
    # a table, whose size the plan knows: the texts that it picks are then not shuffled
    wanted = stored(wanted.join(known.select("cls", "exact_id"), "cls"), "nd-wanted", small=True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in slices(batches, "text", 2 << 20):
            sets = [s.tobytes() for s in (shingles(t, k, cache) for t in batch.column(0).to_pylist())]
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["cls", "shingles"])

    texts = rows.join(wanted.select("exact_id"), F.col("id").eqNullSafe(F.col("exact_id")), "left_semi").select("text")
    sets = stored(texts.mapInArrow(again, "cls binary, shingles binary").join(wanted.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles")), "nd-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "seta", 4 << 20):
            keep = []
            for n, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if reaches(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), threshold):
                    keep.append(n)
            good = batch.take(pa.array(keep, pa.int64()))
            for x, y, copies in ((0, 1, 3), (1, 0, 2)):
                yield pa.record_batch([good.column(x), good.column(y), good.column(copies)], ["cls", "other", "links"])

    of = lambda s: sets.select(F.col("cls").alias(s), F.col("shingles").alias("set" + s))
    links = (likely.join(of("a"), "a").join(of("b"), "b").select("a", "b", "copiesa", "copiesb", "seta", "setb").mapInArrow(verify, "cls binary, other binary, links long"))

    # large buckets: tasks of two blocks
    blocks = F.ceil(F.greatest(F.col("m") / block, F.least(F.col("held") / block_shingles, F.col("m") / 2))).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls")
    filled = dealt.join(known.select("cls", "copies", "sig", "hot"), "cls").join(sets, "cls")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        lo, hi, band = int(get("lo")[0]), int(get("hi")[0]), int(get("band")[0])
        names = table.column("cls").to_pylist()
        members = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        found, root = block_links(_matrix(table.column("sig")), get("hot"), get("copies"), members, (get("own") == hi).astype(int), lo == hi, band, threshold, tolerance)
        keep = np.flatnonzero(found)
        return pa.table({"cls": pa.array([names[i] for i in keep], pa.binary()), "other": pa.array([names[root[i]] for i in keep], pa.binary()), "links": pa.array(found[keep], pa.int64())})

    dense = filled.groupBy("bucket", "lo", "hi").applyInArrow(compare, "cls binary, other binary, links long")

    # a row a link and side, and a row a class and pair of blocks with the sum of its links and one of the classes it reaches
    each = stored(links.unionByName(dense), "nd-each", small=True)
    counts = each.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(each.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = roots.join(known.select("cls", "exact_id"), F.col("node") == F.col("cls")).select("cls", "root", "exact_id")
    least = named.groupBy("root").agg(F.min("exact_id").alias("class_id"))
    joined = named.join(least, "root").join(counts, "cls", "left").select("cls", "class_id", "links")
    each_class = classes.select("cls", "exact_id", "copies").join(joined, "cls", "left")
    result = stored(each_class.select("cls", "exact_id", F.coalesce("class_id", "exact_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "nd-result", small=True)
    released(classes, met)
    dropped(known, likely, wanted, sets, each, roots)
    has = signed.select("id", "cls").where("cls is not null").join(result, "cls").select("id", "class_id", "n_links", "exact_id")
    none = signed.where("cls is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("exact_id"))
    return has.unionByName(none).withColumnRenamed("id", id_col)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of every document: five-word shingles, similarity 0.8 or more."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id, coalesce(k.n_links, 0) AS n_links FROM d
LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = d.doc_id
"""
