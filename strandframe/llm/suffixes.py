"""Removal of repeated byte strings by suffix arrays.

Method: every window of ``length`` bytes has an anchor, the ANCHOR bytes of least hash in it; equal windows have equal
anchors, at the same place. Windows of a text with one anchor are neighbours and make a stretch. Stretches are met by
their anchor's hash; an anchor that occurs once has no repeated window. All others go through the suffix sort: of each
distinct stretch one copy, or the bytes of two of its copies where there are more, shards of whole anchor groups
concatenated. The suffix array of a shard is built by two-stage sorting (suffixes smaller than their successors are
sorted directly, the others induced by scans of the buckets), for the places that begin windows and what they are
induced from; adjacent common prefixes of ``length`` bytes show the repeated windows. The order matters to that depth
only, so direct sorting stops there. What is found for a distinct stretch holds for all its copies, which are told by a
digest of 128 bits.

A group whose bytes exceed ``shard_bytes`` is split before it is gathered: its stretches are cut into runs of 16 windows
at the same distance from the anchor, which are met by all the bytes that those windows have in common. Groups that are
still too large are cut into runs of 2 windows; of these a group has at most 65,536 distinct members, as they differ in
two bytes only. So a shard is bounded whatever the corpus, and every window goes through the same sort.

Defined results: null texts count as empty; texts shorter than ``length`` keep everything; repeated rows are texts of
their own, so a repeated long text is removed whole; other columns are ignored; rows are told apart by id and text,
and equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.words import mixed, slices
from strandframe.session import dropped, held, released, stored

ANCHOR = 24
PIECE = 1 << 20
#: A key with this part of the rows is hot; so there are at most as many hot keys.
HOT = 1000
#: Windows in a run, each time that a group is too large to be sorted at once.
RUNS = (16, 2)
_RNG = np.random.default_rng(97)
_TABLES = [_RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = int(_RNG.integers(0, 2**62)) * 2 + 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                while len(out) < n:
                    out = np.concatenate([out, out[: n - len(out)] * np.uint64(pow(base, len(out), 1 << 64))])
            _POWERS.append(out)
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes:
    """Hashes of all substrings of some bytes, by prefix sums; two tables make two independent ones."""

    def __init__(self, data: np.ndarray, table: int = 0):
        up, self.down = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLES[table][data] * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value among values[i : i + width], for all i."""
    n = len(values) - width + 1
    keys = (values & ~np.uint64((1 << 24) - 1)) | np.arange(len(values), dtype=np.uint64)
    full = -(-len(keys) // width) * width
    keys = np.concatenate([keys, np.full(full - len(keys), ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(keys, 1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def _contents(data: np.ndarray, hashes: Hashes, first: np.ndarray, stop: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the bytes from first to stop, their number and the place of ref among them."""
    with np.errstate(over="ignore"):
        shape = mixed(((stop - first) * 4096 + (ref - first)).astype(np.uint64))
        return mixed(hashes.of(first, stop) + shape).view(np.int64), mixed(Hashes(data, 1).of(first, stop) ^ shape).view(np.int64)


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, two content hashes, first start, last start, anchor's place) of the stretches of windows of some bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 6
    hashes = Hashes(data)
    at = np.arange(len(data) - ANCHOR + 1)
    grams = hashes.of(at, at + ANCHOR)
    anchor = least_in_windows(grams, length - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    place = anchor[first]
    return grams[place].view(np.int64), *_contents(data, hashes, first, last + length, place), first, last, place


def runs_of_windows(data: np.ndarray, ref: int, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(hash of the common bytes, two content hashes, first start, last start, where the common bytes begin) of the runs of
    width windows, counted from ref, that a stretch is cut into."""
    hashes = Hashes(data)
    first = np.arange(len(data) - length + 1)
    run = (ref - first) // width
    heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    first, last = heads, np.concatenate([heads[1:], [len(first)]]) - 1
    core = ref - run[heads] * width
    with np.errstate(over="ignore"):
        key = mixed(hashes.of(core, core - width + 1 + length) + mixed((run[heads] + (1 << 20)).astype(np.uint64))).view(np.int64)
    return key, *_contents(data, hashes, first, last + length, core), first, last, core


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do; zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next; the last, empty but for a sentinel, is."""
    n = len(data)
    out = np.zeros(n, bool)
    out[-1] = True
    if n > 1:
        differs = np.append(data[:-1] != data[1:], True)
        where = np.flatnonzero(differs)
        decides = where[np.searchsorted(where, np.arange(n))]  # the next place whose successor differs
        inner = np.minimum(decides, n - 2)
        out = np.where(decides == n - 1, True, data[inner] < data[inner + 1])
    return out


def _eight_from(eight: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.where(places < len(eight), eight[np.minimum(places, len(eight) - 1)], np.uint64(0))


def _sorted_directly(where: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """The places ordered by the ``depth`` bytes from them; eight bytes a round, of what is still tied. Of places with one
    hash of those bytes the first is sorted for all of them."""
    order = where[np.argsort(eight[where], kind="stable")]
    key = eight[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])  # of each group of equal ones
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    if not len(tied):
        return order
    group, places = np.cumsum(head[tied]), order[tied]
    whole = np.zeros(len(places), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(8, depth, 8):
            whole = mixed(whole + _eight_from(eight, places + at))
    by = np.lexsort((whole, group))
    order[tied], whole = places[by], whole[by]
    lead = np.ones(len(order), bool)
    lead[tied[1:]] = (whole[1:] != whole[:-1]) | (group[1:] != group[:-1])
    leads = np.flatnonzero(lead)
    picked, head = leads.copy(), head[leads]
    for at in range(8, depth, 8):
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        group = np.cumsum(head[tied])
        value = _eight_from(eight, order[picked[tied]] + at)
        again = np.lexsort((value, group))
        picked[tied], value = picked[tied][again], value[again]
        head[tied[1:]] |= value[1:] != value[:-1]
    size = np.diff(np.append(leads, len(order)))[np.searchsorted(leads, picked)]
    ends = np.cumsum(size)
    return order[np.repeat(picked - ends + size, size) + np.arange(len(order))]


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None, eight: np.ndarray | None = None) -> np.ndarray:
    """The suffixes by their first ``depth`` bytes: all, or those at the sorted places wanted and the ones they are induced
    from. data ends with a byte 0 that counts as the sentinel."""
    small = smaller_than_successor(data)
    need = np.ones(len(data), bool)
    if wanted is not None:
        # a greater suffix is induced from its successor, and so on up to the next smaller one
        ends = np.flatnonzero(small)
        ends = ends[np.searchsorted(ends, wanted)]
        need = np.cumsum(np.bincount(wanted, minlength=len(data) + 1) - np.bincount(ends + 1, minlength=len(data) + 1))[:-1] > 0
    direct = _sorted_directly(np.flatnonzero(small & need), _words8(data) if eight is None else eight, depth)
    heads = data[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    greater = ~small & need
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(places: np.ndarray, c: int) -> np.ndarray:
        """Hand the greater predecessors of sorted suffixes to their buckets; give those of this bucket."""
        before = places[places > 0] - 1
        before = before[greater[before]]
        if not len(before):
            return before
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        same = before[:0]
        for a, b in zip(cuts, [*cuts[1:], len(before)], strict=True):
            if first[a] == c:
                same = before[a:b]
            else:
                waiting[first[a]].append(before[a:b])
        return same

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        part = direct[bounds[c] : bounds[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out)


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the sorted places, all with length bytes from them, begin a string that another of them begins too."""
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    eight = _words8(data)
    order = suffix_array(data, length, starts, eight)
    order = order[wanted[order]]
    a, b = order[:-1], order[1:]
    alike = np.arange(len(a))
    for at in [*range(0, length - 7, 8), length - 8]:
        alike = alike[eight[a[alike] + at] == eight[b[alike] + at]]
    out = np.zeros(len(data), bool)
    out[a[alike]] = out[b[alike]] = True
    return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


HITS = "gid long, c1 long, c2 long, lo long, hi long"


def _sorter(length: int, shard_bytes: int):
    """Rows ``gid, c1, c2, times, data``, sorted by the first three, to HITS: the bytes of data that repeated windows cover."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        gid, c1, c2, times = (table.column(i).to_numpy() for i in range(4))
        of = np.repeat(np.arange(len(gid)), times)
        raw = table.column(4).to_pylist()
        data = np.frombuffer(b"\0".join([raw[i] for i in of]) + b"\0", np.uint8)
        size = np.array([len(r) for r in raw])[of]
        begins = np.cumsum(size + 1) - size - 1
        count = size - length + 1
        starts = np.repeat(begins - np.cumsum(count) + count, count) + np.arange(count.sum())
        hit = np.flatnonzero(repeated(data, starts, length))
        # the first copy of each content speaks for it
        new = (np.diff(gid, prepend=gid[:1]) != 0) | (np.diff(c1, prepend=c1[:1]) != 0) | (np.diff(c2, prepend=c2[:1]) != 0)
        new[0] = True
        speaks = new[of] & np.concatenate([[True], of[1:] != of[:-1]])
        row = np.searchsorted(begins, hit, "right") - 1
        hit, row = hit[speaks[row]], row[speaks[row]]
        cut = np.flatnonzero((np.diff(hit) > length) | (np.diff(row) != 0))
        head, tail = np.append(0, cut + 1)[: len(hit)], np.append(cut, len(hit) - 1)[: len(hit)]
        at = of[row[head]]
        return pa.record_batch([pa.array(x) for x in (gid[at], c1[at], c2[at], hit[head] - begins[row[head]], hit[tail] - begins[row[head]] + length)], ["gid", "c1", "c2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column(0).to_numpy()
            weight = np.append(0, np.cumsum(pc.binary_length(batch.column(4)).to_numpy().astype(np.int64) * batch.column(3).to_numpy()))
            new_group = np.concatenate([[last is not None and gid[0] != last], gid[1:] != gid[:-1]])
            start, last = 0, gid[-1]
            for at in np.flatnonzero(new_group).tolist():
                if size + weight[at] - weight[start] >= shard_bytes:
                    yield flush([*held, batch.slice(start, at - start)])
                    held, size, start = [], 0, at
            held.append(batch.slice(start))
            size += weight[-1] - weight[start]
        if held:
            yield flush(held)

    return run


def _hits(pieces: DataFrame, length: int, shard_bytes: int, runs: tuple[int, ...]) -> DataFrame:
    """HITS of rows ``gid, c1, c2, times, ref, crowd, data``; crowded groups are cut into runs and sorted as groups of those."""
    small = pieces if not runs else pieces.where(~F.col("crowd"))
    # dealt by a function of the key: a partitioning that is there already, of a join, may be split by adaptive execution
    shards = small.select("gid", "c1", "c2", "times", "data").repartition(F.xxhash64("gid")).sortWithinPartitions("gid", "c1", "c2")
    found = shards.mapInArrow(_sorter(length, shard_bytes), HITS)
    if not runs or not pieces.where("crowd").limit(1).count():
        return found
    width = runs[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", 1 << 20):
            of, columns, pieces_of = [], [], []
            for n, (ref, raw) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                *found, first, last, core = runs_of_windows(np.frombuffer(raw, np.uint8), ref, length, width)
                of.append(np.full(len(first), n))
                columns.append((*found, first, core - first))
                pieces_of += [raw[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            at = pa.array(np.concatenate(of))
            k, c1, c2, first, ref = (pa.array(np.concatenate([c[i] for c in columns])) for i in range(5))
            yield pa.record_batch([*[batch.column(i).take(at) for i in range(4)], k, c1, c2, first, ref.cast(pa.int32()), pa.array(pieces_of, pa.binary())], ["pgid", "p1", "p2", "times", "gid", "c1", "c2", "off", "ref", "data"])

    crowded = pieces.where("crowd").select("gid", "c1", "c2", "times", "ref", "data").repartition("gid", "c1", "c2")
    parts = stored(crowded.mapInArrow(cut, "pgid long, p1 long, p2 long, times int, gid long, c1 long, c2 long, off long, ref int, data binary"), "sa-runs", small=True)
    met = parts.groupBy("gid").agg(F.sum("times").alias("met")).where("met > 1").select("gid")
    distinct = parts.join(met, "gid", "left_semi").groupBy("gid", "c1", "c2").agg(F.least(F.sum("times"), F.lit(2)).cast("int").alias("times"), F.first("ref").alias("ref"), F.first("data").alias("data"))
    inner = _hits(_weighed(stored(distinct, "sa-distinct", small=True), shard_bytes, "times * length(data)"), length, shard_bytes, runs[1:])
    links = parts.select("pgid", "p1", "p2", "gid", "c1", "c2", "off").distinct()
    of_runs = links.join(inner, ["gid", "c1", "c2"]).select(F.col("pgid").alias("gid"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    return found.unionByName(of_runs)


def _weighed(rows: DataFrame, shard_bytes: int, weight: str) -> DataFrame:
    """rows with ``crowd``: whether the bytes of their group exceed a shard."""
    over = rows.groupBy("gid").agg(F.sum(F.expr(weight)).alias("held")).where(F.col("held") > shard_bytes).select("gid", F.lit(True).alias("over"))
    return rows.join(over, "gid", "left").withColumn("crowd", F.coalesce("over", F.lit(False))).drop("over")


def repeats(docs: DataFrame, length: int = 200, shard_bytes: int = 1 << 20) -> DataFrame:
    """``id, h, lo, hi``: byte ranges of texts that repeated windows cover, from rows ``id, h, text``; they may overlap."""
    if length < ANCHOR + 8:
        raise ValueError(f"length must be {ANCHOR + 8} or more")
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            of, found = [], []
            for n, text in enumerate(batch.column(2).to_pylist()):
                data = np.frombuffer(_raw(text), np.uint8)
                for s in range(0, max(1, len(data) - length + 1), PIECE):
                    *keys, first, last, place = stretches(data[s : s + PIECE + length - 1], length)
                    of.append(np.full(len(first), n))
                    found.append((*keys, first + s, last + s, place - first))
            if found:
                at = pa.array(np.concatenate(of))
                columns = [pa.array(np.concatenate([x[i] for x in found])) for i in range(6)]
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *columns[:5], columns[5].cast(pa.int32())], ["id", "h", "gid", "c1", "c2", "first", "last", "ref"])

    all_ = stored(docs.where(F.octet_length("text") >= length).select("id", "h", "text").mapInArrow(cut, f"id {kind}, h long, gid long, c1 long, c2 long, first long, last long, ref int"), "sa-stretches")
    # keys that hold a thousandth of the rows or more, a thousand at most, are met by broadcast; no other is hot
    often = max(2, all_.count() // HOT)
    shared = held(all_.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1"))
    hot = [r["gid"] for r in shared.where(F.col("n") >= often).select("gid").collect()]
    is_hot = F.col("gid").isin(hot) if hot else F.lit(False)
    met = stored(all_.where(is_hot).unionByName(all_.where(~is_hot).join(shared.select("gid"), "gid", "left_semi")), "sa-shared")
    released(shared)
    dropped(all_)

    # of each content one member, or two where there are more
    one = F.struct("id", "h", "first", "last", "ref")
    contents = stored(met.groupBy("gid", "c1", "c2").agg(F.count("*").alias("n"), F.min(one).alias("one"), F.max(one).alias("two")), "sa-contents")
    listed = _weighed(contents, shard_bytes, "least(n, 2) * (one.last - one.first + %d)" % length)
    picked = listed.select("gid", "c1", "c2", "crowd", F.explode(F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))).alias("m"))
    by_text = picked.groupBy(F.col("m.id").alias("i2"), F.col("m.h").alias("h2")).agg(F.collect_list(F.struct("gid", "c1", "c2", "m.ref", "crowd", "m.first", "m.last")).alias("parts"))
    with_text = by_text.join(docs, docs["id"].eqNullSafe(F.col("i2")) & (docs["h"] == F.col("h2"))).select("text", "parts")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows, data = [], []
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = _raw(text)
                flat = pa.RecordBatch.from_struct_array(parts.values)
                rows.append(flat)
                data += [raw[a : b + length] for a, b in zip(flat.column("first").to_pylist(), flat.column("last").to_pylist(), strict=True)]
            if rows:
                table = pa.Table.from_batches(rows).combine_chunks()
                columns = {c: table.column(c).chunk(0) for c in ("gid", "c1", "c2", "ref", "crowd")}
                yield pa.record_batch([columns["gid"], columns["c1"], columns["c2"], pa.array(np.ones(len(data), np.int32)), columns["ref"], columns["crowd"], pa.array(data, pa.binary())], ["gid", "c1", "c2", "times", "ref", "crowd", "data"])

    sources = stored(with_text.mapInArrow(bytes_of, "gid long, c1 long, c2 long, times int, ref int, crowd boolean, data binary"), "sa-sources")
    hits = stored(_hits(sources, length, shard_bytes, RUNS), "sa-hits", small=True)
    key = ["gid", "c1", "c2"]
    common = F.broadcast(contents.where(F.col("n") >= often).select(*key))
    few = met.join(F.broadcast(hits.join(common, key, "left_semi")), key)
    many = met.join(common, key, "left_anti").join(hits, key)
    return few.unionByName(many).select("id", "h", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **options) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept binary`` for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.octet_length(text)).alias("h"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    spans = stored(repeats(rows, length, **options).groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "sa-spans", small=True)
    marked = rows.join(spans.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "spans"), rows["id"].eqNullSafe(F.col("i2")) & (rows["h"] == F.col("h2")), "left").select("id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, removed, runs, kept = [], [], [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, out, at, n, gone = _raw(text), [], 0, 0, 0
                end = -1
                for lo, hi in sorted((p["lo"], p["hi"]) for p in parts or []):
                    if lo > end:
                        n += 1
                        out.append(data[at:lo])
                        gone += hi - lo
                        at = end = hi
                    elif hi > end:
                        gone += hi - end
                        at = end = hi
                sizes.append(len(data))
                removed.append(gone)
                runs.append(n)
                kept.append(b"".join([*out, data[at:]]))
            yield pa.record_batch([batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)], pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = marked.mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Remove what is covered by strings of 200 bytes that stand elsewhere too, from every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: By definition: all windows of 200 bytes, as hexadecimal digits, that occur twice.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200) a),
r AS (SELECT w.doc_id, w.i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) t ON t.k = w.k),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) a GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM s),
m AS (SELECT p.doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last, string_agg(substr(d.x, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(m.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(m.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(concat(coalesce(m.kept, ''), substr(d.x, 2 * coalesce(m.last, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN m ON m.doc_id = d.doc_id
"""
