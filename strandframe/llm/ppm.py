"""Language-model scores by prediction by partial matching over bytes.

Method: a trie of byte contexts holds, for contexts of ``depth``, ..., one and no bytes, how often each symbol followed
in the training texts. A symbol is coded in its longest known context; where it did not follow there, an escape
(estimated by the number of different followers, method C) leads to the context one byte shorter, and the symbols that
the longer one has are excluded from its counts; below the empty context all unseen bytes are alike. A text starts
after ``depth`` marks and ends with one (byte 0xFF, which UTF-8 never holds). The model is pretrained; a text's score
is the sum of its symbols' log10 probabilities.

The trie grows with the training texts and is nowhere whole. Texts are dealt into slices of bounded size; a slice asks
for its different strings of depth + 1 bytes and tells how often each stood in its training texts. Requests are dealt
into blocks by the last two bytes of the context, so that a block has all counts of its contexts of two and more bytes;
only the 65,536 counts of byte pairs are broadcast. A block answers each slice, and the slice's texts meet its answers.

The word baseline (add one half) counts all tokens of all training texts. The ``common_tokens`` most frequent ones are
broadcast, a fixed number; the counts of the others are joined by token.

Defined results: null and empty texts have the end alone; a null id is not held out (crc32 of null is not 1) and its
text is trained on; with no training texts every symbol has probability 1/256; repeated rows each give a row and count
each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandframe.llm.words import slices
from strandframe.session import stored

MARK = b"\xff"
SYMBOLS = 256
SLICE_BYTES = 16 << 20


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; bytes methods leave other characters alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the ``depth`` bytes before each symbol and the symbol; the offset of each text's first)."""
    joined = np.frombuffer(b"".join(part for t in texts for part in (MARK * depth, t, MARK)), np.uint8)
    n = max(0, len(joined) - depth)
    keys = np.zeros(n, np.int64)
    for i in range(depth + 1):
        keys <<= 8
        keys |= joined[i : i + n]
    inner = np.ones(n, bool)  # leave out what spans two texts
    cut = np.cumsum([len(t) + depth + 1 for t in texts])[:-1]
    for i in range(1, depth + 1):
        inner[cut - i] = False
    return keys[inner], np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.int64))


def place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each key is in the sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def block_logs(keys: np.ndarray, counts: np.ndarray, depth: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probabilities of sorted keys, from the counts of all keys that share their last three bytes' contexts.

    ``pairs`` has how often each symbol followed each byte. From the empty context upwards, the value of an order is
    what a symbol costs once the next longer context has escaped to it: ``total`` and ``kinds`` of the context's
    followers, less those that the longer one has.
    """
    known = pairs > 0
    n0 = pairs.sum(0)
    kinds0 = int((n0 > 0).sum())
    symbol, one = keys & 0xFF, keys >> 8 & 0xFF
    # by order: count of the symbol, total and kinds of the context, and the shorter context's total of its followers
    orders = {0: (n0[symbol], n0.sum(), kinds0, 0), 1: (pairs[one, symbol], pairs.sum(1)[one], known.sum(1)[one], (known @ n0)[one])}
    level = {}
    found, n = keys[counts > 0], counts[counts > 0]
    for k in range(depth, 1, -1):
        found, n = summed(found & ((1 << 8 * (k + 1)) - 1), n)
        level[k] = (found, n)
    for k in range(2, depth + 1):
        found, n = level[k]
        contexts, of = np.unique(found >> 8, return_inverse=True)
        shorter = pairs[found >> 8 & 0xFF, found & 0xFF] if k == 2 else level[k - 1][1][np.searchsorted(level[k - 1][0], found & ((1 << 8 * k) - 1))]
        total, kinds, below = (np.bincount(of, x, len(contexts)) if len(of) else np.zeros(1) for x in (n, None, shorter))
        mine = keys & ((1 << 8 * (k + 1)) - 1)
        at, seen = place(found, mine)
        where, there = place(contexts, mine >> 8)
        orders[k] = (np.where(seen, n[at], 0) if len(n) else np.zeros(len(keys)), *(np.where(there, x[where], 0) for x in (total, kinds, below)))
    orders[depth + 1] = (0, 0, 0, 0)
    out = np.full(len(keys), -float(np.log10(max(1, SYMBOLS - kinds0))))
    for k in range(depth + 1):
        count, total, kinds, _ = orders[k]
        more = kinds - orders[k + 1][2]
        all_ = np.maximum(total - orders[k + 1][3] + more, 1)
        escape = np.log10(np.where(more > 0, more / all_, 1.0))
        out = np.where(count > 0, np.log10(np.maximum(count, 1) / all_), escape + out)
    return out


class Answers:
    """Values by key: a table of hashes finds most keys at once, a search the ones that lost their slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = len(keys).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(keys)]
        lost = np.flatnonzero(self.keys[at] != keys)
        at[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[at].astype(np.float64)


def trained_on(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 1, F.lit(True))


def pair_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each symbol followed each byte: 256 x 256."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            counts += np.bincount(grams([normal(t) for t in batch.column(0).to_pylist()], 1)[0], minlength=1 << 16)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["pair", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(256, 256)


def requests(dealt: DataFrame, depth: int, blocks: int) -> DataFrame:
    """``block, slice, size, keys, counts`` of the different keys of each slice, counted in its training texts."""

    def ask(group: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in slices(iter(group.select(["text", "train"]).to_batches()), "text", 2 << 20):
            train = batch.column(1).to_pylist()
            for kind in (True, False):
                texts = [normal(t) for t, k in zip(batch.column(0).to_pylist(), train, strict=True) if k == kind]
                if texts:
                    found = np.sort(grams(texts, depth)[0])
                    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                    keys.append(found[first])
                    counts.append(np.diff(np.concatenate([first, [len(found)]])) * kind)
        k, n = summed(np.concatenate(keys), np.concatenate(counts))
        of = (k >> 8 & 0xFFFF) * 40_503 % 65_521 % blocks
        order = np.argsort(of, kind="stable")
        k, n, of = k[order], n[order], of[order]
        ends = np.searchsorted(of, np.arange(blocks + 1))
        parts = [(b, s, e) for b, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if e > s]
        return pa.table(
            {
                "block": pa.array([b for b, _, _ in parts], pa.int32()),
                "slice": pa.array([group.column("slice")[0].as_py()] * len(parts), pa.int32()),
                "size": pa.array([e - s for _, s, e in parts], pa.int32()),
                "keys": pa.array([packed(np.diff(k[s:e], prepend=0)) for _, s, e in parts], pa.binary()),
                "counts": pa.array([packed(n[s:e]) for _, s, e in parts], pa.binary()),
            }
        )

    return dealt.groupBy("slice").applyInArrow(ask, "block int, slice int, size int, keys binary, counts binary")


def answers(asked: DataFrame, depth: int, pairs) -> DataFrame:
    """``slice, size, keys, logs``: a row a request. A block holds its requests packed and its different keys once."""

    def answer(group: pa.Table) -> pa.Table:
        sizes, packs = group.column("size").to_pylist(), group.column("keys").to_pylist()
        keys, counts, new, more, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], 0
        for i, (size, pack, count) in enumerate(zip(sizes, packs, group.column("counts").to_pylist(), strict=True)):
            new.append(unpacked_keys(pack, size))
            more.append(unpacked(count, size, np.int64))
            held += size
            if held > max(1 << 20, len(keys)) or i == len(sizes) - 1:
                keys, counts = summed(np.concatenate([keys, *new]), np.concatenate([counts, *more]))
                new, more, held = [], [], 0
        logs = block_logs(keys, counts, depth, pairs.value).astype(np.float32)
        found = [packed(logs[np.searchsorted(keys, unpacked_keys(pack, size))]) for size, pack in zip(sizes, packs, strict=True)]
        return pa.table({"slice": group.column("slice"), "size": group.column("size"), "keys": group.column("keys"), "logs": pa.array(found, pa.binary())})

    return asked.groupBy("block").applyInArrow(answer, "slice int, size int, keys binary, logs binary")


def token_counts(docs: DataFrame, text_col: str = "text", held: int = 200_000) -> DataFrame:
    """``token binary, n long`` of the words; pre-summed in each task, ``held`` different ones at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for batch in slices(batches, "text", 2 << 20):
            for text in batch.column(0).to_pylist():
                counts.update(normal(text).split())
            if len(counts) >= held:
                yield out()
                counts.clear()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common_tokens: int = 65_536, depth: int = 2) -> DataFrame:
    """Train on the rows that are not held out, score all: see op6_ppm_scores for the columns. Depth is 2 to 6 bytes."""
    if not 2 <= depth <= 6:
        raise ValueError("a depth of 2 to 6 bytes is needed")
    train = docs.where(trained_on(id_col))
    vocabulary = stored(token_counts(train, text_col), "ppm-tokens")
    # counts are taken from the table that was written, so that all uses agree
    words, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = train.count()
    total, distinct = words + texts, kinds + (texts > 0)
    bottom = float(total + 0.5 * (distinct + 1))
    log = lambda c: float(np.log10((c + 0.5) / bottom))
    common = vocabulary.orderBy(F.desc("n"), "token").limit(common_tokens).toArrow().to_pydict()
    context = docs.sparkSession.sparkContext
    pairs = context.broadcast(pair_counts(train, text_col))
    shared = context.broadcast({t: log(c) for t, c in zip(common["token"], common["n"], strict=True)})
    end, end_known = log(texts), int(texts > 0)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "token", "times", "id", "n_tokens", "hits", "base", "score"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.binary(), pa.int64(), to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)))
    # the slice is a function of the row alone, so that it is the same when a lost task is done again
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n_slices = max(16, size // SLICE_BYTES)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(n_slices)).cast("int").alias("slice"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        trained_on(id_col).alias("train"),
    ).repartition(2 * n_slices, "slice")
    answered = answers(requests(dealt, depth, min(4096, 32 + n_slices // 4)), depth, pairs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        # a fixed order, so that the numbers of rows are the same when a lost task is done again
        marks = [(str(i), xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass"))) for i, t in zip(left.column("id").to_pylist(), left.column("text").to_pylist(), strict=True)]
        left = left.take(pa.array(sorted(range(len(marks)), key=marks.__getitem__)))
        known = shared.value
        sizes = right.column("size").to_pylist()
        keys = np.concatenate([unpacked_keys(k, n) for k, n in zip(right.column("keys").to_pylist(), sizes, strict=True)])
        order = np.argsort(keys)
        found = Answers(keys[order], np.concatenate([unpacked(v, n, np.float32) for v, n in zip(right.column("logs").to_pylist(), sizes, strict=True)])[order])
        return pa.Table.from_batches(list(scored(left, known, found)), schema)

    def scored(left: pa.Table, known: dict, found: Answers) -> Iterator[pa.RecordBatch]:
        first = left.column("slice")[0].as_py() << 32
        for batch in slices(iter(left.select(["id", "text"]).to_batches()), "text", 2 << 20):
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            keys, starts = grams(texts, depth)
            logs = np.add.reduceat(found[keys], starts)
            numbers = pa.array(range(first, first + len(texts)), pa.int64())
            first += len(texts)
            row_ids, tokens, of, n = numbers.to_pylist(), [], [], []
            lengths, hits, sums = [], [], []
            for r, t in zip(row_ids, texts, strict=True):
                parts = t.split()
                values = list(map(known.get, parts))
                some = [v for v in values if v is not None]
                lengths.append(len(parts) + 1)
                hits.append(len(some) + end_known)
                sums.append(sum(some) + end)
                if len(some) < len(parts):
                    rare = Counter(p for p, v in zip(parts, values, strict=True) if v is None)
                    tokens += rare
                    n += rare.values()
                    of += [r] * len(rare)
            # a text's own row has a token that no text can hold, so that these rows are spread too
            own = [b" %d" % r for r in row_ids]
            more = len(tokens)
            null = lambda k: pa.nulls(more, k)
            yield pa.record_batch(
                [
                    pa.concat_arrays([numbers, pa.array(of, pa.int64())]),
                    pa.array(own + tokens, pa.binary()),
                    pa.array([0] * len(own) + n, pa.int64()),
                    pa.concat_arrays([batch.column(0), null(batch.column(0).type)]),
                    pa.array(lengths + [None] * more, pa.int64()),
                    pa.array(hits + [0] * more, pa.int64()),
                    pa.array(sums + [0.0] * more, pa.float64()),
                    pa.array(logs.tolist() + [None] * more, pa.float64()),
                ],
                schema=schema,
            )

    parts = dealt.groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(run, f"row long, token binary, times long, id {kind}, n_tokens long, hits long, base double, score double")
    joined = parts.join(vocabulary, "token", "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    out = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.col("hits") + F.when(count > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("times") * F.log10((count + 0.5) / F.lit(bottom))).alias("base_score"),
        F.max("score").alias("score"),
    )
    return out.select(F.col("id").alias(id_col), (~trained_on("id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_ppm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), depth=5)
