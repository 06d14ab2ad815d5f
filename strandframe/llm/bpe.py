"""Byte-level BPE encoding and decoding.

Method: texts longer than a chunk are cut into overlapping chunks that are pre-tokenised in parallel, each from a
cold start. Two neighbours are stitched at the first boundary that both have in their overlap: the splitting pattern
looks only forward, so from a common boundary on both give the same pieces. Where no boundary is common (a run longer
than the overlap) the text is split again from the last sure boundary. The pieces are then encoded one by one;
decoding concatenates the raw bytes of the ids.

Defined results: a null text counts as empty and gives no ids and no bytes; repeated rows each give a row; other
columns of the input, whatever their names, are not carried over.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.words import slices

#: Characters after a boundary that the pattern may look at.
LOOKAHEAD = 3
_CODECS: dict[str, "Codec"] = {}


class Codec:
    """Pieces to ids and back, for one rank file and pattern."""

    def __init__(self, ranks: bytes, pattern: str, cached: int = 100_000):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        # one piece at a time: to this pattern whatever it gets is one
        self._merge = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={}).encode_ordinary
        # \s of the tokenizer's engine is Unicode White_Space
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._bytes = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self._bytes[rank] = token
        self._cache: dict[str, array] = {}
        self._cached = cached

    def encode_pieces(self, pieces: list[str], out: array) -> None:
        cache, get = self._cache, self._cache.get
        for piece in pieces:
            ids = get(piece)
            if ids is None:
                ids = array("i", self._merge(piece))
                if len(piece) <= 64:
                    if len(cache) >= self._cached:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)

    def encode(self, text: str) -> array:
        out = array("i")
        self.encode_pieces(self.split(text), out)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


def codec(ranks: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Stitcher:
    """Takes the chunks of one text in order; gives its ids. Holds one chunk and what is open, not the text."""

    def __init__(self, coder: Codec):
        self.coder, self.ids = coder, array("i")
        self.text, self.start, self.pieces, self.ends = "", 0, [], np.zeros(0, np.int64)

    def _sure(self, final: bool) -> int:
        """How many pieces of the chunk in hand cannot change with what follows it."""
        return len(self.pieces) if final else int(np.searchsorted(self.ends, self.start + len(self.text) - LOOKAHEAD, "right"))

    def _take(self, text: str, start: int, pieces: list[str]) -> None:
        self.text, self.start, self.pieces = text, start, pieces
        self.ends = start + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def add(self, start: int, text: str, pieces: list[str]) -> None:
        if not self.text:
            self._take(text, start, pieces)
            return
        sure = self._sure(False)
        mine = self.ends[:sure]
        theirs = start + np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        known = np.concatenate([[self.start], mine])
        common = np.intersect1d(known, theirs)
        if len(common):
            at = int(common[0])
            self.coder.encode_pieces(self.pieces[: int(np.searchsorted(mine, at, "right"))], self.ids)
            rest = pieces[int(np.searchsorted(theirs, at)) :]
            self._take(text[at - start :], at, rest)
        else:
            at = int(known[-1])
            self.coder.encode_pieces(self.pieces[:sure], self.ids)
            joined = self.text[at - self.start :] + text[self.start + len(self.text) - start :]
            self._take(joined, at, self.coder.split(joined))

    def end(self) -> array:
        self.coder.encode_pieces(self.pieces, self.ids)
        return self.ids


def _lists(arrays: list[array]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate([np.frombuffer(a, np.int32) for a in arrays]) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap: int = 512, decoded: bool = False) -> DataFrame:
    """``id_col, ids array<int>`` and, if decoded, ``bytes binary``: the ids decoded again by the same task, which saves
    a second Python process a task. One row per input row, in no order.

    Texts of at most chunk_chars characters are encoded where they are read, without a shuffle. Longer ones are cut;
    their chunks are dealt out singly, so that one very long text keeps no task busy alone, and met again by text.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = df.schema[id_col].dataType

    names, kinds = ["id", "ids"] + ["bytes"] * decoded, "id string, ids array<int>" + ", bytes binary" * decoded

    def made(coder: Codec, idents: pa.Array, ids: list[array]) -> pa.RecordBatch:
        columns = [idents, _lists(ids)]
        if decoded:
            columns.append(pa.array([coder.decode(i) for i in ids], pa.binary()))
        return pa.record_batch(columns, names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in slices(batches, "text", 1 << 20):
            yield made(coder, batch.column(0), [coder.encode(t) for t in batch.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = f"{'null' if i is None else f'id {i}'}/{hashlib.sha256(t.encode('utf-8', 'surrogatepass')).hexdigest()}"
                starts = list(range(0, len(t), chunk_chars))
                for lo in range(0, len(starts), 64):
                    part = starts[lo : lo + 64]
                    yield pa.record_batch([pa.array([key] * len(part)), pa.array([i] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array([t[s : s + chunk_chars + overlap] for s in part])], ["key", "id", "start", "part"])

    def presplit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in slices(batches, "part"):
            lens = [np.fromiter(map(len, coder.split(t)), np.int32) for t in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([x.tobytes() for x in lens], pa.binary())], [*batch.schema.names, "lens"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        key, ident, copies, last, work = None, None, 0, -1, None

        def done() -> Iterator[pa.RecordBatch]:
            if work is not None:
                ids = work.end()
                for _ in range(copies):
                    yield made(coder, pa.array([ident], pa.string()), [ids])

        for batch in slices(batches, "part"):
            for k, i, s, text, lens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    yield from done()
                    key, ident, copies, last, work = k, i, 0, -1, Stitcher(coder)
                copies += s == 0
                if s == last:  # the same chunk of a repeated row
                    continue
                last, bounds = s, np.cumsum(np.frombuffer(lens, np.int32)).tolist()
                work.add(s, text, [text[a:b] for a, b in zip([0, *bounds], bounds, strict=False)])
        yield from done()

    is_long = F.length("text") > chunk_chars
    short = rows.where(~is_long).mapInArrow(whole, kinds)
    pieces = rows.where(is_long).mapInArrow(cut, "key string, id string, start long, part string").repartition("key", "start")
    split = pieces.mapInArrow(presplit, "key string, id string, start long, part string, lens binary")
    long = split.repartition("key").sortWithinPartitions("key", "start").mapInArrow(stitch, kinds)
    return short.unionByName(long).select(F.col("id").cast(id_type).alias(id_col), *names[1:])


def decode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", keep_ids: bool = False) -> DataFrame:
    """``id_col, bytes binary`` (and ids): the concatenated bytes of each row's ids; null ids count as none."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(1)
                flat, off = ids.flatten().to_numpy().tolist(), (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
                out = pa.array([coder.decode(flat[a:b]) for a, b in zip(off, off[1:], strict=False)], pa.binary())
                yield pa.record_batch([part.column(0), out] + [ids] * keep_ids, ["id", "bytes"] + ["ids"] * keep_ids)

    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(back, f"id {kind}, bytes binary" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)


def op1_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents; per document the digests of both."""
    import public_tokenizers as tokenizers

    ranks = read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, ranks, tokenizers.PATTERN, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
