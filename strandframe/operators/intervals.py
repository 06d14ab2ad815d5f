"""Interval operators: half-open, zero-based, by contig."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places in a bin of the joins by range.
BIN = 1 << 14


def overlaps(a_st: Column, a_en: Column, b_st: Column, b_en: Column) -> Column:
    return (a_st < b_en) & (b_st < a_en)


def in_block(pos: Column, start: int, end: int) -> Column:
    return (pos >= start) & (pos < end)


def binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """A row for each bin of width that the interval touches."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor((F.greatest(end, start + 1) - 1) / width).cast("long"))))


def point_join(points: DataFrame, regions: DataFrame, how: str = "inner", bin_width: int = BIN) -> DataFrame:
    """Points ``contig, pos`` with regions ``contig, st, en`` that hold them; how: inner, left, left_semi or left_anti.

    By contig and bin, the range a residual, so that a long contig with many regions is many keys. A point has one bin, so
    no pair is found twice.
    """
    r = binned(regions.select(F.col("contig").alias("r_contig"), *[c for c in regions.columns if c != "contig"]), F.col("st"), F.col("en"), bin_width)
    points = points.withColumn("p_bin", F.floor(F.col("pos") / bin_width).cast("long"))
    held = (F.col("pos") >= F.col("st")) & (F.col("pos") < F.col("en")) & (points["contig"] == F.col("r_contig")) & (F.col("p_bin") == F.col("bin"))
    return points.join(r, held, how).drop("r_contig", "bin", "p_bin")


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int = BIN) -> DataFrame:
    """All pairs of left ``contig, st, en`` and right ``contig, r_st, r_en`` that overlap, with the other columns of both.

    Both are dealt to the bins that they touch; a pair counts in the first bin that they share.
    """
    r = binned(right.withColumnRenamed("contig", "r_contig"), F.col("r_st"), F.col("r_en"), bin_width).withColumnRenamed("bin", "r_bin")
    both = binned(left, F.col("st"), F.col("en"), bin_width).join(r, (F.col("contig") == F.col("r_contig")) & (F.col("bin") == F.col("r_bin")) & overlaps(F.col("st"), F.col("en"), F.col("r_st"), F.col("r_en")))
    first = F.floor(F.greatest("st", "r_st") / bin_width).cast("long")
    return both.where(F.col("bin") == first).drop("r_contig", "bin", "r_bin")


def interval_filter(reads: DataFrame, regions: DataFrame, keep: bool, bin_width: int = BIN) -> DataFrame:
    """Reads ``contig, st, en`` that overlap a region (keep) or none.

    Whether one does depends on these three only, so each distinct span is tested once, by bins, and reads meet the spans
    that overlap by equality.
    """
    spans = reads.select("contig", "st", "en").distinct()
    r = regions.select("contig", F.col("st").alias("r_st"), F.col("en").alias("r_en"))
    met = overlap_join(spans, r, bin_width).select("contig", "st", "en").distinct()
    return reads.join(met, ["contig", "st", "en"], "left_semi" if keep else "left_anti").select(*reads.columns)


def clip(regions: DataFrame, start: int, end: int) -> DataFrame:
    """The parts of regions within a block."""
    out = regions.withColumn("st", F.greatest("st", F.lit(start))).withColumn("en", F.least("en", F.lit(end)))
    return out.where(F.col("st") < F.col("en"))


def covering(regions: DataFrame, start: int, end: int, default: float = 0.0) -> DataFrame:
    """A block as its clipped regions ``contig, st, en, rate`` and the tail after the last of them at the default rate;
    contigs without a region in the block have all of it at the default."""
    parts = clip(regions, start, end).select("contig", "st", "en", F.col("rate").cast("double").alias("rate"))
    last = regions.select("contig").distinct().join(parts.groupBy("contig").agg(F.max("en").alias("last")), "contig", "left")
    tail = last.where(F.coalesce("last", F.lit(start)) < end)
    return parts.unionByName(tail.select("contig", F.coalesce("last", F.lit(start)).cast("long").alias("st"), F.lit(end).cast("long").alias("en"), F.lit(default).alias("rate")))


def fill_gaps(regions: DataFrame, lengths: DataFrame, default: float = 0.0) -> DataFrame:
    """``contig, st, en, rate`` that cover each contig from 0 to its length.

    Regions are taken in file order (``line_no``); one that starts before the end of the last one taken is left out. The
    operator is a fold in that order, so a contig's regions stream through one task, which holds one row of them.
    """
    kind = regions.schema["contig"].dataType.simpleString()
    rows = regions.select("contig", F.col("line_no").cast("long").alias("line_no"), F.col("st").cast("long").alias("st"), F.col("en").cast("long").alias("en"), F.col("rate").cast("double").alias("rate"))
    ends = lengths.select("contig", F.lit(None).cast("long").alias("line_no"), F.col("length").cast("long").alias("st"), F.lit(None).cast("long").alias("en"), F.lit(None).cast("double").alias("rate"))
    every = rows.join(lengths.select("contig"), "contig", "left_semi").withColumn("last", F.lit(False)).unionByName(ends.withColumn("last", F.lit(True)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contig, at = None, 0
        for batch in batches:
            out = []
            for name, _, st, en, rate, last in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if name != contig:
                    contig, at = name, 0
                if st > at:
                    out.append((name, at, st, default))
                if not last and st >= at:
                    out.append((name, st, en, rate))
                    at = en
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(columns[0], batch.schema.field(0).type), *[pa.array(x, pa.int64()) for x in columns[1:3]], pa.array(columns[3], pa.float64())], ["contig", "st", "en", "rate"])

    # dealt by a function of the key: a partitioning that the join and the union have already is not kept to by all plans
    ordered = every.select("contig", "line_no", "st", "en", "rate", "last").repartition(F.xxhash64("contig")).sortWithinPartitions("contig", "last", "line_no", "st", "en")
    return ordered.mapInArrow(fold, f"contig {kind}, st long, en long, rate double")


def recalibrated(regions: DataFrame, start: int, end: int, run_rate: float) -> DataFrame:
    """``contig, st, en, rate`` that cover a block of each contig of regions: parts within the block, a null rate as the
    run's, and gaps filled with the run's rate; places count from the contig's start."""
    parts = clip(regions, start, end).withColumn("rate", F.coalesce(F.col("rate").cast("double"), F.lit(run_rate)))
    moved = parts.withColumns({"st": F.col("st") - start, "en": F.col("en") - start})
    blocks = regions.select("contig").distinct().withColumn("length", F.lit(end - start).cast("long"))
    return fill_gaps(moved, blocks, run_rate).withColumns({"st": F.col("st") + start, "en": F.col("en") + start})


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """``contig``: the names in a that b has not."""
    return a.select("contig").distinct().join(b.select("contig"), "contig", "left_anti")


def first_match(points: DataFrame, regions: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Each point, 1-based, with the region of least ``line_no`` that has it between its start and its end, both
    included; points in none are left out.

    By contig and bin: a bin's regions stream through one task, the one of least line last, each over what earlier ones
    left in an array of the bin's places; then its distinct places are looked up. So a region costs the same however many
    points or other regions lie there, and a task holds one bin's array. Regions have a line_no.
    """
    kind = regions.schema["contig"].dataType.simpleString()
    closed = regions.select("contig", F.col("st").cast("long").alias("st"), (F.col("en").cast("long") + 1).alias("en"), F.col("line_no").cast("long").alias("line")).where("st < en and contig is not null and line is not null")
    painted = binned(closed, F.col("st"), F.col("en"), bin_width).select("contig", "bin", "st", "en", "line")
    places = points.select("contig", F.col("pos").cast("long").alias("st")).where("contig is not null and st is not null").distinct()
    asked = places.select("contig", F.floor(F.col("st") / bin_width).cast("long").alias("bin"), "st", F.lit(None).cast("long").alias("en"), F.lit(None).cast("long").alias("line"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, top, first, last, known = None, *(np.zeros(bin_width, np.int64) for _ in range(3)), np.zeros(bin_width, bool)
        for batch in batches:
            # runs of rows of one contig, bin and kind
            bins, st, en, line = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            names, point = batch.column(0).to_pylist(), np.asarray(batch.column(4).is_null())
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or bins[i] != bins[i - 1] or point[i] != point[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (names[a], bins[a]) != here:
                    here = names[a], bins[a]
                    known[:] = False
                base = int(bins[a]) * bin_width
                if not point[a]:
                    regions_here = (x[a:b].astype(np.int64) for x in (st, en, line))
                    for s, e, n in zip(*(x.tolist() for x in regions_here), strict=True):
                        low, high = max(0, s - base), e - base
                        top[low:high], first[low:high], last[low:high], known[low:high] = n, s, e, True
                    continue
                pos = st[a:b].astype(np.int64)
                pos = pos[known[pos - base]]
                at = pos - base
                yield pa.record_batch([pa.array([names[a]] * len(pos), batch.schema.field(0).type), pa.array(pos), pa.array(first[at]), pa.array(last[at] - 1), pa.array(top[at])], ["contig", "pos", "st", "en", "r_line"])

    # dealt by a function of the key, as in fill_gaps
    ordered = painted.unionByName(asked).repartition(F.xxhash64("contig", "bin")).sortWithinPartitions("contig", "bin", F.desc_nulls_last("line"))
    found = ordered.mapInArrow(paint, f"contig {kind}, pos long, st long, en long, r_line long")
    return points.join(found, ["contig", "pos"]).select(*points.columns, "st", "en", "r_line").distinct()


def points_in(spans: DataFrame, points: DataFrame, key: str, bin_width: int = 256) -> DataFrame:
    """``key, n, places``: for each key of spans ``contig, st, en`` how many points ``contig, pos`` stand in its spans, a
    point once for each, and their distinct places in order; keys without any are left out.

    Points are counted by place and places gathered by bin, so that a span is looked up in one row of at most two bins and
    makes no row a point. Keys of several spans, and spans longer than a bin, meet each bin that they touch and are put
    together.
    """
    at = points.groupBy("contig", F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("pos") / bin_width).cast("long"))
    gathered = F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("held")
    one = at.groupBy("contig", "bin").agg(gathered)
    # a bin's row with the places of the next one
    two = at.withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") - 1))).groupBy("contig", "bin").agg(gathered)

    kind = spans.schema[key].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            st, en = (batch.column(i).to_numpy() for i in (1, 2))
            held = batch.column(3)
            row = np.repeat(np.arange(len(st)), held.value_lengths().to_numpy())
            pos, n = (held.flatten().field(i).to_numpy() for i in (0, 1))
            hit = (pos >= st[row]) & (pos < en[row])
            row, pos, n = row[hit], pos[hit], n[hit]
            ends = np.cumsum(np.bincount(row, minlength=len(st)))
            sums = np.bincount(row, n, minlength=len(st)).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(sums), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(pos))], [key, "n", "places"])

    def looked_up(rows: DataFrame, bins: DataFrame) -> DataFrame:
        met = rows.join(bins, ["contig", "bin"]).select(key, "st", "en", "held")
        return met.mapInArrow(look_up, f"{key} {kind}, n long, places array<long>").where("n > 0")

    mine = spans.where("st < en").select(key, "contig", F.col("st").cast("long").alias("st"), F.col("en").cast("long").alias("en"), (F.count("*").over(Window.partitionBy(key)) == 1).alias("alone"))
    short = F.col("alone") & (F.col("en") - F.col("st") <= bin_width)
    direct = looked_up(mine.where(short).withColumn("bin", F.floor(F.col("st") / bin_width).cast("long")), two)
    parts = looked_up(binned(mine.where(~short), F.col("st"), F.col("en"), bin_width), one)
    together = parts.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    return direct.unionByName(together)


def in_order(rows: DataFrame, *order: str, number: str = "place") -> DataFrame:
    """rows numbered from 1 within their contig by the order; narrow rows, one sort a contig."""
    return rows.withColumn(number, F.row_number().over(Window.partitionBy("contig").orderBy(*order)))


def next_starts(regions: DataFrame, end: Column) -> DataFrame:
    """regions with ``own``: how far it is to the next region's start in the contig, to end after the last one."""
    following = F.lead("st").over(Window.partitionBy("contig").orderBy("st", "line_no"))
    return regions.withColumn("own", F.coalesce(following, end) - F.col("st"))


def contig_numbers(rows: DataFrame) -> DataFrame:
    """``contig, contig_idx``: contigs numbered from 0 by their first line; one row a contig."""
    first = rows.groupBy("contig").agg(F.min("line_no").alias("first"))
    return first.select("contig", (F.row_number().over(Window.orderBy("first")) - 1).alias("contig_idx"))


def clusters(values: DataFrame, by: str, value: str, delta: int) -> DataFrame:
    """Adjacent values at most delta apart share a cluster, numbered from 0 within ``by``."""
    w = Window.partitionBy(by).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > delta).cast("int")
    return values.withColumn("cluster", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def coverage(spans: DataFrame, bin_width: int = 1 << 20) -> DataFrame:
    """``contig, pos, depth`` where the depth changes: running sum of starts and ends, which are pre-summed by place.

    The sum runs within bins; each bin starts from the sum of the bins before it, a row a bin, so that no task has a whole
    contig's places.
    """
    ends = spans.select("contig", F.explode(F.array(F.struct(F.col("st").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("en").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    events = ends.select("contig", "e.pos", "e.d").groupBy("contig", "pos").agg(F.sum("d").alias("d")).withColumn("bin", F.floor(F.col("pos") / bin_width).cast("long"))
    sums = events.groupBy("contig", "bin").agg(F.sum("d").alias("d"))
    earlier = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("contig", "bin", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("contig", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return events.join(base, ["contig", "bin"]).select("contig", "pos", (F.col("base") + F.sum("d").over(within)).alias("depth"))
