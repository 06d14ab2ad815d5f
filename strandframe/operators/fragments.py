"""Fragment lengths and GC bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequence import gc_fraction, gc_index, gc_window_counts
from strandframe.operators.intervals import overlap_join

# Least mapping quality, median absolute deviations kept.
MIN_MAPQ, DEVIATIONS = 10, 10


def counted(flag: Column, mapq: Column, contig: Column, mate: Column) -> Column:
    """Paired, first of its pair, mapped well, both on one contig."""
    return (flag.bitwiseAND(1) != 0) & (flag.bitwiseAND(64) != 0) & (mapq > MIN_MAPQ) & (contig == mate)


def lengths(alignments: DataFrame) -> DataFrame:
    good = counted(F.col("flag"), F.col("mapq"), F.col("contig"), F.col("mate_contig"))
    return alignments.where(good).groupBy(F.abs("tlen").alias("len")).agg(F.count("*").alias("n"))


def filtered(counts: DataFrame, min_reads: int = 2) -> DataFrame:
    """Lengths up to the median and ten median absolute deviations, of min_reads reads or more (0: no filter).

    Medians are of reads, from the histogram: its rows are lengths, not reads.
    """
    if not min_reads:
        return counts
    middle = counts.agg(F.expr("percentile(len, 0.5, n)").alias("m"))
    spread = counts.crossJoin(F.broadcast(middle)).agg(F.max("m").alias("m"), F.expr("percentile(abs(len - m), 0.5, n)").alias("d"))
    return counts.crossJoin(F.broadcast(spread)).where((F.col("len") > 0) & (F.col("len") <= F.col("m") + DEVIATIONS * F.col("d")) & (F.col("n") >= min_reads)).select("len", "n")


def moments(counts: DataFrame) -> DataFrame:
    n, s, s2 = F.sum("n"), F.sum(F.col("n") * F.col("len")), F.sum(F.col("n") * F.col("len") * F.col("len"))
    return counts.agg((s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s / n) * (s / n))).alias("sd"))


def gc_weights(contigs: DataFrame, depth: DataFrame, width: int) -> DataFrame:
    """``gc_pct, weight`` for 0 to 100 from windows ``width`` long and ``contig, pos, depth`` where depth changes.

    Windows start every max(width, length div 1000) before length - width; a weight is the mean depth of its windows by
    the greatest; percents without windows get the mean of the positive ones, and all are scaled to a greatest of 1.
    """
    step = F.greatest(F.lit(width), F.floor(F.col("length") / 1000)).cast("long")
    starts = contigs.where(F.col("length") > width).select("contig", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - width - 1, step)).alias("w"))
    windows = starts.select("contig", "w", gc_index(gc_fraction(F.substr("seq", (F.col("w") + 1).cast("int"), F.lit(width)))).alias("gc_pct"))
    # runs of equal depth, cut at the windows
    from pyspark.sql.window import Window

    runs = depth.withColumn("until", F.lead("pos").over(Window.partitionBy("contig").orderBy("pos"))).where("until is not null and depth > 0")
    runs = runs.select("contig", F.col("pos").alias("r_st"), F.col("until").alias("r_en"), "depth")
    spans = windows.select("contig", F.col("w").alias("st"), (F.col("w") + width).alias("en"), "gc_pct")
    part = (F.least("r_en", "en") - F.greatest("r_st", "st")) * F.col("depth")
    covered = overlap_join(spans, runs).select("contig", "st", "gc_pct", part.alias("part"))
    every = covered.unionByName(spans.select("contig", "st", "gc_pct", F.lit(0).cast("long").alias("part")))
    sums = every.groupBy("contig", "st", "gc_pct").agg(F.sum("part").alias("bases"))
    mean = sums.groupBy("gc_pct").agg((F.avg("bases") / width).alias("depth"))
    dense = contigs.sparkSession.range(101).select(F.col("id").cast("int").alias("gc_pct")).join(mean, "gc_pct", "left").select("gc_pct", F.coalesce("depth", F.lit(0.0)).alias("depth"))
    means = dense.agg(F.max("depth").alias("top"), F.avg(F.when(F.col("depth") > 0, F.col("depth"))).alias("middle"))
    rows = dense.crossJoin(F.broadcast(means))
    filled = F.when(F.col("depth") > 0, F.col("depth")).otherwise(F.coalesce("middle", F.lit(1.0)))
    return rows.select("gc_pct", (filled / F.coalesce(F.nullif("top", F.lit(0.0)), F.lit(1.0))).alias("weight"))


def weighted_windows(windows: DataFrame, weights: DataFrame) -> DataFrame:
    """Windows ``gc_pct, ...`` with the ``weight`` of their percent; a percent without one has none."""
    return windows.join(F.broadcast(weights.select("gc_pct", "weight").limit(101)), "gc_pct", "left")


def genome_mean_weight(contigs: DataFrame, weights: DataFrame, width: int) -> DataFrame:
    """``mean``: the weights' mean over all whole windows of contigs longer than width, from the windows' histogram."""
    counts = gc_window_counts(contigs.where(F.col("length") > width), width)
    return counts.join(F.broadcast(weights), "gc_pct").agg((F.sum(F.col("n") * F.col("weight")) / F.sum("n")).alias("mean"))


def uniform_weights(spark) -> DataFrame:
    return spark.range(101).select(F.col("id").cast("int").alias("gc_pct"), F.lit(1.0).alias("weight"))
