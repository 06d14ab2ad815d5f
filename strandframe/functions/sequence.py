"""Column functions and small operators on sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.randomness import uniform_of

# Base order, IUPAC codes, the repeat that masks what is no base.
BASES = "ACGT"
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
MASK_REPEAT = "TTAGGG"

#: Long sequences are cut to pieces of this many bases before anything is exploded: substring walks from the start.
PIECE = 1024


def upper(seq: Column) -> Column:
    return F.upper(seq)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, BASES[::-1]))


def rotate(seq: Column) -> Column:
    """The second half before the first; the first half is the longer one of an odd length."""
    half = F.ceil(F.length(seq) / 2).cast("int")
    return F.concat(F.substr(seq, half + 1), F.substr(seq, F.lit(1), half))


def ambiguity_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{''.join(IUPAC)}]", "")).cast("long")


def gc_fraction(seq: Column) -> Column:
    """G and C among A, C, G, T; 0 where there are none."""
    acgt = F.length(F.regexp_replace(seq, "[^ACGT]", ""))
    return F.when(acgt == 0, 0.0).otherwise(F.length(F.regexp_replace(seq, "[^GC]", "")) / acgt)


def gc_index(fraction: Column) -> Column:
    """Percent, half to even, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(fraction * 100).cast("int")))


def trinucleotide_index(tri: Column) -> Column:
    """16 l + 4 m + r in base order; null where a letter is no base."""
    at = lambda i: F.instr(F.lit(BASES), F.substr(tri, F.lit(i), F.lit(1))) - 1
    return F.when(tri.rlike("^[ACGT]{3}$"), 16 * at(1) + 4 * at(2) + at(3))


def resolved(contigs: DataFrame, seed: int) -> DataFrame:
    """Ambiguity codes in ``seq`` replaced by one of their bases, drawn by seed, contig and place; other letters stay."""
    at, name = contigs.columns.index("seq"), contigs.columns.index("contig")
    codes = np.zeros(256, bool)
    codes[list("".join(IUPAC).encode())] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for contig, seq in zip(batch.column(name).to_pylist(), batch.column(at).to_pylist(), strict=True):
                letters = np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)
                places = np.flatnonzero(codes[letters])
                if len(places):
                    letters = letters.copy()
                    for i in places.tolist():
                        bases = IUPAC[chr(letters[i])]
                        letters[i] = ord(bases[int(uniform_of(seed, contig, i) * len(bases))])
                    seq = letters.tobytes().decode("latin-1")
                out.append(seq)
            yield pa.record_batch([pa.array(out, pa.string()) if n == at else batch.column(n) for n in range(batch.num_columns)], batch.schema.names)

    return contigs.mapInArrow(run, contigs.schema)


def masked(seq: Column) -> Column:
    """Letters that are no base become those of the repeat at their place."""
    return F.array_join(F.transform(F.split(seq, ""), lambda c, i: F.when(c.isin(*BASES), c).otherwise(F.substr(F.lit(MASK_REPEAT), i % len(MASK_REPEAT) + 1, F.lit(1)))), "")


def masked_qualities(seq: Column, quality: Column, low: Column | int) -> Column:
    return F.zip_with(F.split(seq, ""), quality, lambda c, q: F.when(c.isin(*BASES), q).otherwise(F.lit(low)))


def enough_bases(seq: Column, share: float = 0.9) -> Column:
    """Whether more than the share of letters are not N."""
    return F.length(F.replace(seq, F.lit("N"), F.lit(""))) / F.length(seq) > share


def wrapped(seq: Column, width: int = 80) -> Column:
    """FASTA lines of width letters, no line end after the last."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def pieces(contigs: DataFrame, overlap: int, *carry: str | Column, size: int = PIECE) -> DataFrame:
    """``*carry, base, piece``: sequences cut so that each start within ``size`` has overlap letters after it."""
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))
    cut = contigs.where(F.length("seq") > 0).select(*carry, "seq", F.explode(starts).alias("k"))
    return cut.select(*cut.columns[: len(carry)], (F.col("k").cast("long") * size).alias("base"), F.substr("seq", F.col("k") * size + 1, F.lit(size + overlap)).alias("piece"))


def bases_at(rows: DataFrame, contigs: DataFrame, start: Column, n: Column | int, name: str, most: int = 256, size: int = 4096, bounded: bool = False) -> DataFrame:
    """rows ``contig, ...`` with ``name``: the n letters of their contig from a place; rows of other contigs are left out.

    Up to most letters are cut from the one piece that holds them all, met by contig and piece, so that nothing walks a
    contig from its start; the few longer ones meet the whole contig. An n that is an int, of at most most, from starts
    that are not negative, is never longer, so that whole contigs are not moved; bounded: the caller knows as much of a
    column.
    """
    short_only, n = bounded or isinstance(n, int) and n <= most, F.lit(n) if isinstance(n, int) else n
    rows = rows.withColumns({"_start": start.cast("long"), "_n": n.cast("long")})
    few = F.coalesce((F.col("_n") <= most) & (F.col("_start") >= 0), F.lit(False))
    cut = pieces(contigs, most, F.col("contig").alias("_contig"), size=size).withColumn("_k", F.floor(F.col("base") / size)).drop("base")
    near = (rows if short_only else rows.where(few)).withColumn("_at", F.floor(F.col("_start") / size))
    short = near.join(cut, (F.col("contig") == F.col("_contig")) & (F.col("_at") == F.col("_k")))
    short = short.withColumn(name, F.substr("piece", (F.col("_start") - F.col("_k") * size + 1).cast("int"), F.col("_n").cast("int")))
    keep = [c for c in rows.columns if c not in ("_start", "_n")]
    if short_only:
        return short.select(*keep, name)
    whole = rows.where(~few).join(contigs.select(F.col("contig").alias("_contig"), F.col("seq").alias("piece")), F.col("contig") == F.col("_contig"))
    whole = whole.withColumn(name, F.substr("piece", (F.col("_start") + 1).cast("int"), F.col("_n").cast("int")))
    return short.select(*keep, name).unionByName(whole.select(*keep, name))


def kmers(contigs: DataFrame, k: int, *carry: str) -> DataFrame:
    """``*carry, pos, kmer`` for every place with k letters from it."""
    cut = pieces(contigs, k - 1, *carry)
    n = F.least(F.length("piece") - (k - 1), F.lit(PIECE))
    spread = cut.where(F.length("piece") >= k).select(*carry, "base", "piece", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    return spread.select(*carry, (F.col("base") + F.col("i") - 1).alias("pos"), F.substr("piece", F.col("i"), F.lit(k)).alias("kmer"))


_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
#: As above for upper-case letters only, others 4.
_UPPER = np.full(256, 4, np.int16)
for _i, _b in enumerate(b"ACGT"):
    _UPPER[_b] = _i


def letter_codes(seq: str | None) -> np.ndarray:
    """0 to 3 for bases of either case, 255 for other letters (one each, also where UTF-8 takes more bytes)."""
    return _CODE[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]


def trinucleotide_codes(seq: str | None) -> np.ndarray:
    """The index of the trinucleotide at each place that has two letters after it; -1 where one is no upper-case base."""
    codes = _UPPER[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
    left, middle, right = codes[:-2], codes[1:-1], codes[2:]
    return np.where((left | middle | right) < 4, (left << 4) | (middle << 2) | right, -1)


def trinucleotide_windows(contigs: DataFrame) -> DataFrame:
    """``contig, windows, index_sum``: how many places have three letters from them, and the sum of their indices, null
    where no place has bases only. Sequences are looked at as arrays, no row is made a place."""
    kind = contigs.schema["contig"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trinucleotide_codes(s) for s in batch.column(1).to_pylist()]
            sums = [int(c[c >= 0].sum()) if (c >= 0).any() else None for c in found]
            yield pa.record_batch([batch.column(0), pa.array([len(c) for c in found], pa.int64()), pa.array(sums, pa.int64())], ["contig", "windows", "index_sum"])

    rows = contigs.select("contig", "seq").mapInArrow(count, f"contig {kind}, windows long, index_sum long").where("windows > 0")
    return rows.groupBy("contig").agg(F.sum("windows").alias("windows"), F.sum("index_sum").alias("index_sum"))


def trinucleotide_counts(contigs: DataFrame) -> DataFrame:
    """``tri, n`` over all places whose three letters are bases of either case.

    Each task counts its sequences as arrays and hands on at most 64 rows; exploding a row a place took longer by far.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64, np.int64)
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                c = letter_codes(seq)
                if len(c) >= 3:
                    good = (c[:-2] < 4) & (c[1:-1] < 4) & (c[2:] < 4)
                    total += np.bincount((c[:-2][good] << 4) | (c[1:-1][good] << 2) | c[2:][good], minlength=64)
        seen = np.flatnonzero(total)
        names = [BASES[i >> 4] + BASES[i >> 2 & 3] + BASES[i & 3] for i in seen.tolist()]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(total[seen], pa.int64())], ["tri", "n"])

    return contigs.select("seq").mapInArrow(count, "tri string, n long").groupBy("tri").agg(F.sum("n").alias("n"))


def kept_trinucleotide_counts(contigs: DataFrame, path: str) -> DataFrame:
    """The counts of a table that an earlier run kept at the path; counted and kept there if there is none."""
    from strandframe.session import exists

    spark = contigs.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        trinucleotide_counts(contigs).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def gc_window_counts(contigs: DataFrame, width: int) -> DataFrame:
    """``gc_pct, n``: how many whole windows of width letters have each percent, as gc_windows gives them one by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(101, np.int64)
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                total += np.bincount(window_percents(letter_codes(seq), width), minlength=101)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["gc_pct", "n"])

    return contigs.select("seq").mapInArrow(count, "gc_pct int, n long").groupBy("gc_pct").agg(F.sum("n").alias("n"))


def chunk_size(total: int, cores: int, least: int = 100_000, most: int = 50_000_000, per_core: int = 8) -> int:
    """Bases in a chunk, so that each core gets about as many chunks as wanted, within bounds."""
    return max(least, min(most, total // max(1, cores * per_core)))


def chunks(contigs: DataFrame, size: int, overlap: int) -> DataFrame:
    """``contig, chunk, st, en, own_end``: overlapping slices that end with the contig; own_end is the next one's start."""
    if size <= overlap:
        raise ValueError("a chunk must be longer than the overlap")
    step = size - overlap
    last = F.ceil(F.greatest(F.col("length") - size, F.lit(0)) / step).cast("int")
    cut = contigs.select("contig", "length", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    cut = cut.withColumn("st", F.col("chunk").cast("long") * step)
    end = F.least(F.col("st") + size, F.col("length"))
    own = F.when(end == F.col("length"), F.col("length")).otherwise(F.col("st") + step)
    return cut.select("contig", "chunk", "st", end.alias("en"), own.alias("own_end"))


def gc_windows(contigs: DataFrame, width: int) -> DataFrame:
    """``contig, pos, gc_pct`` for every whole window of width letters, by differences of running counts.

    Counts run within pieces that overlap by a window, so nothing is shuffled and no task needs a whole contig.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, base, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pct = window_percents(letter_codes(piece), width)
                if len(pct):
                    yield pa.record_batch([pa.array([contig] * len(pct), batch.schema.field(0).type), pa.array(base + np.arange(len(pct))), pa.array(pct, pa.int32())], ["contig", "pos", "gc_pct"])

    kind = contigs.schema["contig"].dataType.simpleString()
    return pieces(contigs, width - 1, "contig", size=1 << 16).mapInArrow(count, f"contig {kind}, pos long, gc_pct int")


def window_percents(codes: np.ndarray, width: int) -> np.ndarray:
    """The percent of G and C among the bases of each whole window of coded letters, half to even; 0 without bases."""
    if len(codes) < width:
        return np.zeros(0, np.int64)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((codes == 1) | (codes == 2), codes < 4)]
    gc, acgt = (x[width:] - x[:-width] for x in sums)
    return np.clip(np.rint(np.where(acgt > 0, gc / np.maximum(acgt, 1), 0.0) * 100).astype(np.int64), 0, 100)
