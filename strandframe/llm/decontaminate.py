"""Benchmark decontamination by edit distance in words.

Method: for each length of an item, all windows of that many words are considered in every document. The CGK random
walk embeds a window in three times its length: at step j the current word is written, and one random bit of (j, word)
says whether to go on to the next; windows near in edit distance become near in Hamming distance. Each of ``rounds``
repetitions samples up to ``sampled`` places of its own embedding; a window that agrees with an item in all of them is
a candidate. Each width takes the most places at which windows with all allowed edits are found with a chance of TARGET
in a simulation of the walk; where one place is too many, each window that is embedded is a candidate. Candidates are verified by the exact edit distance of the item to the best stretch of the text around them.

A window that shares fewer word pairs with the benchmark than any window within the distance must (each edit destroys
at most two of the item's pairs) cannot match and is not embedded: that is exact and loses nothing, as edits of under a
third of an item's words leave a pair or more.

The benchmark is small against the documents; it is broadcast in blocks of at most ``block_words`` words, one pass over
the texts for each block. The walks' bits are tabled where they fit into 64 MB, else worked out, so that an index takes
memory in proportion to its words and items. Nothing is shuffled.

Defined results: a match is a stretch within ``floor(edits * words)`` word edits of the item; null and empty texts and
items match nothing; items with equal words match alike, each under its own id; repeated rows each give their matches;
texts shorter than an item can match it within the distance; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.filters import kept
from strandframe.llm.words import mixed, slices, words

#: Chance to find a window that has as many edits as are allowed.
TARGET = 0.99
SCHEMA = "item_id long, distance int, start_word long, end_word long"


class Bits:
    """bits[j][word]: whether step j of a walk goes on after writing the word; a table where all rounds' tables have room
    in table_bytes, else worked out from the word's hash each time."""

    def __init__(self, hashes: np.ndarray, seeds: np.ndarray, rounds: int, table_bytes: int):
        self.hashes, self.seeds = hashes, seeds
        self.table = (mixed(hashes ^ seeds) >> np.uint64(63)).astype(np.int8) if len(hashes) * len(seeds) * rounds <= table_bytes else None

    def __len__(self) -> int:
        return len(self.seeds)

    def of(self, step: int, word: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[step][word]
        return (mixed(self.hashes[word] ^ self.seeds[step]) >> np.uint64(63)).astype(np.int8)


def embedded(windows: np.ndarray, bits: Bits, steps: int | None = None) -> np.ndarray:
    """The CGK walk of all windows (rows of word numbers) at once: out[:, j] is the word written at step j, 0 past the end."""
    steps = len(bits) if steps is None else steps
    n, w = windows.shape
    flat = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], 1).ravel()
    base, last = np.arange(n) * (w + 1), np.arange(n) * (w + 1) + w
    at = base.copy()
    out = np.empty((n, steps), windows.dtype)
    for j in range(steps):
        word = flat[at]
        out[:, j] = word
        at += bits.of(j, word)
        np.minimum(at, last, out=at)
    return out


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): the stretch of text nearest the item, the first and shortest of equal ones."""
    m, n = len(item), len(text)
    step = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), step.copy()
    for i in range(m):
        sub = np.concatenate([[row[0] + 1], row[:-1] + (text != item[i])])
        down = row + 1
        take = sub < down
        take[0] = False
        best = np.where(take, sub, down)
        start = np.where(take, np.concatenate([[0], origin[:-1]]), origin)
        best[0], start[0] = i + 1, 0
        # insertions: running minimum of best - position
        shifted = best - step
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, step, 0))
        row, origin = low + step, start[source]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def stretches(item: np.ndarray, allowed: int, ids: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(distance, start, end) of stretches apart from each other within ids[lo:hi], the nearest ones first."""
    spans = [(lo, hi)]
    while spans:
        lo, hi = spans.pop()
        if hi - lo < max(1, len(item) - allowed):
            continue
        distance, a, b = best_stretch(item, ids[lo:hi])
        if distance <= allowed:
            yield distance, lo + a, lo + b
            if b > a:
                spans += [(lo, lo + a), (lo + b, hi)]


def edited(rng: np.random.Generator, item: np.ndarray, edits: int, fresh: int) -> np.ndarray:
    """The item after so many words replaced, put in or left out, at places apart; new words count on from fresh."""
    places, out = set(rng.choice(len(item), edits, replace=False).tolist()), []
    for i, word in enumerate(item.tolist()):
        kind = rng.integers(3) if i in places else 3
        if kind in (0, 1):
            out.append(fresh)
            fresh += 1
        if kind in (1, 3):
            out.append(word)
    return np.array(out, np.int64)


def places_for(width: int, allowed: int, rounds: int, most: int, seed: int = 7, pairs: int = 48, walks: int = 8) -> int:
    """The most places a round that still find a window at the bound with a chance of TARGET; 0 if even one does not."""
    rng = np.random.default_rng([seed, width, allowed])
    item = np.arange(1, width + 1)
    size = 2 * (width + allowed) + 2
    windows = np.stack([np.append(edited(rng, item, allowed, width + 1), np.arange(width + allowed + 1, size))[:width] for _ in range(pairs)])
    same = np.empty((walks, pairs))
    for k in range(walks):
        bits = Bits(rng.integers(0, 2**63, size, np.uint64), rng.integers(0, 2**63, (2 * width, 1), np.uint64), 1, 1 << 21)
        same[k] = (embedded(windows, bits) == embedded(item[None], bits)).mean(1)
    for n in range(most, 0, -1):
        if (1 - (1 - (same**n).mean(0)) ** rounds).mean() >= TARGET:
            return n
    return 0


class Index:
    """What one block of the benchmark is looked up by."""

    def __init__(self, items: list[tuple[int, str]], edits: float, rounds: int, sampled: int, seed: int = 7, table_bytes: int = 1 << 26):
        if not 0 <= edits < 1 / 3:
            raise ValueError("edits must be under a third, so that a match has a word pair of its item")
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item_id, text in items:
            found = words(text)
            if found:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64)
                self.items.append((item_id, ids, int(edits * len(ids))))
        self.size = len(self.vocabulary) + 1
        self.widths = np.array([len(i[1]) for i in self.items], np.int64)
        self.allowed = np.array([i[2] for i in self.items], np.int64)
        self.needed = self.widths - 1 - 2 * self.allowed  # word pairs of the item that any match still has
        # word pairs, each with its items; an item of one word has that word, paired with nothing
        both = [np.unique(np.append(ids[:-1] * self.size + ids[1:], ids[0] * self.size if len(ids) == 1 else []).astype(np.int64), return_counts=True) for _, ids, _ in self.items]
        own, times = [p for p, _ in both], np.concatenate([*[t for _, t in both], np.zeros(0, np.int64)])
        pairs, of = np.concatenate([*own, np.zeros(0, np.int64)]), np.repeat(np.arange(len(own)), [len(o) for o in own])
        order = np.argsort(pairs, kind="stable")
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.pair_items, self.pair_at = of[order], np.append(first, len(pairs))
        # how often an item has a word pair
        owned = of * max(1, len(self.pairs)) + np.searchsorted(self.pairs, pairs)
        order = np.argsort(owned)
        self.owned, self.times = owned[order], times[order]
        self.single = bool((self.widths == 1).any())
        self.coarse = np.zeros(1 << 22, bool)
        self.coarse[self._slot(self.pairs)] = True
        self.hashes = mixed(np.arange(self.size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        self.hashes[0] = 0
        self.longest = int(self.widths.max(initial=0))
        rng = np.random.default_rng(seed)
        self.tables = []
        widths = np.unique(self.widths)
        allowed = {w: int(self.allowed[self.widths == w].max()) for w in widths.tolist()}
        used = {w: places_for(w, a, rounds, sampled, seed) for w, a in allowed.items()}
        for _ in range(rounds if len(self.items) else 0):
            seeds = rng.integers(0, 2**63, (2 * self.longest, 1), dtype=np.uint64)
            bits = Bits(self.hashes, seeds, rounds, table_bytes)
            # by width; places of the walk's first two thirds: it mostly ends there, at one word in two steps
            places = np.zeros((self.longest + 1, sampled), np.int64)
            for w in widths:
                places[w] = np.sort(rng.integers(0, 2 * w, sampled))
                places[w, used[w] :] = -1
            keys = np.empty(len(self.items), np.uint64)
            for some in self._by_width(self.widths):
                padded = np.zeros((len(some), int(self.widths[some].max())), np.int32)
                for row, n in enumerate(some):
                    padded[row, : self.widths[n]] = self.items[n][1]
                keys[some] = self._keys(padded, self.widths[some], bits, places)
            order = np.argsort(keys, kind="stable")
            self.tables.append((bits, places, keys[order], order))

    @staticmethod
    def _by_width(widths: np.ndarray, most: int = 8192, cells: int = 1 << 20) -> Iterator[np.ndarray]:
        """Numbers of windows of about the same width, as many as have room in so many cells."""
        order, at = np.argsort(widths, kind="stable"), 0
        while at < len(order):
            widest = int(widths[order[min(at + most, len(order)) - 1]])
            n = max(1, min(most, cells // max(1, widest)))
            yield order[at : at + n]
            at += n

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (mixed(pairs.astype(np.uint64)) >> np.uint64(42)).astype(np.int64)

    def _keys(self, windows: np.ndarray, widths: np.ndarray, bits: np.ndarray, places: np.ndarray) -> np.ndarray:
        at = places[widths]
        walk = embedded(windows, bits, int(at.max(initial=0)) + 1)
        sampled = np.where(at < 0, np.uint64(0), self.hashes[np.take_along_axis(walk, np.maximum(at, 0), 1)])
        key = mixed(widths.astype(np.uint64))
        with np.errstate(over="ignore"):
            for j in range(sampled.shape[1]):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sampled[:, j])
        return key

    @staticmethod
    def _distinct(block: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different windows, their widths, and the number of each window's own among them."""
        key = mixed(width.astype(np.uint64))
        with np.errstate(over="ignore"):
            for j in range(block.shape[1]):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + block[:, j].astype(np.uint64))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        return block[first], width[first], of

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, widths) of all windows that hold enough word pairs of an item of their width."""
        known = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        pairs = ids[known] * self.size + ids[known + 1]
        if self.single:
            lone = np.flatnonzero(ids > 0)
            known, pairs = np.concatenate([known, lone]), np.concatenate([pairs, ids[lone] * self.size])
        sure = self.coarse[self._slot(pairs)]
        known, pairs = known[sure], pairs[sure]
        if not len(known):
            return known, known
        slot = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        sure = self.pairs[slot] == pairs
        known, slot = known[sure], slot[sure]
        n = self.pair_at[slot + 1] - self.pair_at[slot]
        item = self.pair_items[np.repeat(self.pair_at[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else slot
        place = np.repeat(known, n)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        # runs of as many hits as needed, near enough for one window
        last = np.arange(len(item)) + np.maximum(self.needed[item], 1) - 1
        inside = np.minimum(last, max(0, len(item) - 1))
        good = np.flatnonzero((last < len(item)) & (item[inside] == item) & (place[inside] - place <= np.maximum(self.widths[item] - 2, 0)))
        w = self.widths[item[good]]
        low = np.maximum(0, place[inside[good]] - np.maximum(w - 2, 0))
        count = place[good] - low + 1
        starts = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(good) else good
        # of those, what still has enough when a pair counts no more often than the item has it
        slots = np.full(len(ids) + self.longest, -1, np.int64)
        slots[known] = slot
        unique = np.unique(starts * len(self.items) + np.repeat(item[good], count))
        enough = [np.zeros(0, np.int64)]
        step = max(1, min(4096, (1 << 19) // max(1, self.longest)))
        for at in range(0, len(unique), step):
            start, it = unique[at : at + step] // len(self.items), unique[at : at + step] % len(self.items)
            steps = np.arange(max(1, self.longest - 1))
            here = np.where(steps < np.maximum(self.widths[it] - 1, 1)[:, None], slots[start[:, None] + steps], -1)
            key = np.sort(np.where(here >= 0, it[:, None] * len(self.pairs) + here, -1), axis=1)
            new = np.concatenate([np.ones((len(key), 1), bool), key[:, 1:] != key[:, :-1]], 1)
            found = np.minimum(np.searchsorted(self.owned, key), len(self.owned) - 1)
            have = np.where(new & (self.owned[found] == key), self.times[found], 0).sum(1)
            enough.append(at + np.flatnonzero(have >= np.maximum(self.needed[it], 1)))
        kept = unique[np.concatenate(enough)]
        both = np.unique(kept // len(self.items) * (self.longest + 1) + self.widths[kept % len(self.items)])
        return both // (self.longest + 1), both % (self.longest + 1)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item id, distance, start, end) for all matches of a batch of texts."""
        pad, get = self.longest, self.vocabulary.get
        parts, starts, counts, at = [], [], [], pad
        for text in texts:
            found = words(text)
            parts.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
            starts.append(at)
            counts.append(len(found))
            at += len(found) + pad
        if not self.items or not texts:
            return []
        ids = np.zeros(at + pad, np.int64)
        for a, p in zip(starts, parts, strict=True):
            ids[a : a + len(p)] = p
        here, widths = self.windows(ids)
        text_of = np.array(starts)
        hits: dict[tuple[int, int], set[int]] = {}
        for some in self._by_width(widths):
            place, width = here[some], widths[some]
            steps = np.arange(int(width.max()))
            block = np.where(steps < width[:, None], ids[place[:, None] + steps], 0).astype(np.int32)
            block, width, first_of = self._distinct(block, width)
            for bits, places, keys, members in self.tables:
                found = self._keys(block, width, bits, places)
                left, right = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                for row in np.flatnonzero((right > left)[first_of]):
                    p, row = int(place[row]), first_of[row]
                    doc = max(0, int(np.searchsorted(text_of, p, "right")) - 1)
                    if doc + 1 < len(starts) and p + width[row] > starts[doc + 1]:
                        doc += 1  # the window begins in the padding before a text
                    for n in members[left[row] : right[row]]:
                        hits.setdefault((doc, int(n)), set()).add(p)
        out = set()
        for (doc, n), places in hits.items():
            item_id, item, allowed = self.items[n]
            first, end = starts[doc], starts[doc] + counts[doc]
            reach, covered, spans = len(item) + 4 * allowed, first, []
            for p in sorted(places):
                # a window with enough pairs may lie two edits' room off the stretch
                lo, hi = max(first, p - 2 * allowed), min(end, p + len(item) + 2 * allowed)
                if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 4 * reach:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                for distance, a, b in stretches(item, allowed, ids, max(lo, covered), hi):
                    out.add((doc, item_id, distance, a - first, b - first))
                    covered = max(covered, b)
        return sorted(out)


_INDEXES: dict[str, Index] = {}


def _index(key: str, *made_of) -> Index:
    """One index a worker and benchmark block; workers live on between tasks."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(*made_of)
    return _INDEXES[key]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, edits: float, rounds: int, sampled: int, block_words: int) -> list:
    """(name, broadcast block) for blocks of the benchmark of bounded size; one block if there are no items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    # a word takes a byte or more and a separator, so characters bound the words of a block
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-total // (2 * block_words))), []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").toArrow().to_pydict()
        block = (list(zip(part["item"], part["text"], strict=True)), edits, rounds, sampled)
        out.append((hashlib.sha256(repr(block).encode()).hexdigest(), benchmark.sparkSession.sparkContext.broadcast(block)))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = 0.2, rounds: int = 32, sampled: int = 4, block_words: int = 1_000_000) -> DataFrame:
    """``id_col, item_id, distance, start_word, end_word``: all stretches of documents near an item."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for name, shared in _blocks(benchmark, item_col, item_text_col, edits, rounds, sampled, block_words):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, *shared.value)
            for batch in slices(batches, "text", 4 << 20):
                made = index.matches(batch.column(1).to_pylist())
                if made:
                    columns = list(zip(*made, strict=True))
                    ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                    yield pa.record_batch([ids, pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["id", "item_id", "distance", "start_word", "end_word"])

        one = rows.mapInArrow(run, f"id {kind}, {SCHEMA}")
        found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = 0.2, rounds: int = 32, sampled: int = 4, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that no item matches."""
    for name, shared in _blocks(benchmark, item_col, item_text_col, edits, rounds, sampled, block_words):

        def decide(texts: list[str | None], name=name, shared=shared) -> np.ndarray:
            mask = np.ones(len(texts), bool)
            mask[[m[0] for m in _index(name, *shared.value).matches(texts)]] = False
            return mask

        docs = kept(docs, decide, text_col)
    return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every stretch of documents within a fifth of a benchmark item's words of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
