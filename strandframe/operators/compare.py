"""Compare called variants with a truth set: names, attribution of misses, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.intervals import point_join

# Reasons, and the names of the mitochondrial contig.
OUTSIDE_CONTIGS, OUTSIDE_MUTATIONS, OUTSIDE_TARGETS, UNKNOWN = "outside_simulated_contigs", "outside_mutation_bed", "outside_target_bed", "unknown"
MITOCHONDRIAL = ("M", "MT", "chrM", "chrMT")


def name_candidates(name: Column) -> Column:
    """Other names that the contig may have, sorted."""
    flipped = F.when(F.startswith(name, F.lit("chr")), F.substr(name, F.lit(4))).otherwise(F.concat(F.lit("chr"), name))
    more = F.when(name.isin(*MITOCHONDRIAL), F.array(*map(F.lit, MITOCHONDRIAL))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array_union(F.array(flipped), more), F.array(name)))


def found_aliases(source: DataFrame, target: DataFrame) -> DataFrame:
    """``source, canonical`` for contigs of source that target has under another name only."""
    names = target.select(F.col("contig").alias("canonical")).distinct()
    lone = source.select(F.col("contig").alias("source")).distinct().join(names, F.col("source") == F.col("canonical"), "left_anti")
    tried = lone.select("source", F.explode(name_candidates(F.col("source"))).alias("candidate"))
    return tried.join(names, F.col("candidate") == F.col("canonical")).groupBy("source").agg(F.min("canonical").alias("canonical"))


def with_aliases(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """The rows with contig renamed where aliases ``source, canonical`` has it."""
    rest = [c for c in df.columns if c != "contig"]
    joined = df.join(aliases, df["contig"] == aliases["source"], "left")
    return joined.select(F.coalesce("canonical", "contig").alias("contig"), *rest)


def mismatched(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row with samples of five names if no contig of source is in target; none otherwise."""
    s, t = source.select("contig").distinct(), target.select("contig").distinct()
    sample = lambda df, n: df.agg(F.slice(F.array_sort(F.collect_set("contig")), 1, 5).alias(n))
    shared = s.intersect(t).agg(F.count("*").alias("shared"))
    return sample(s, "source_sample").crossJoin(sample(t, "target_sample")).crossJoin(shared).where("shared = 0").drop("shared")


def attributed(misses: DataFrame, contigs: DataFrame, mutation: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """misses ``contig, pos`` (zero-based) with ``reasons``: a contig not simulated stands alone, else each region set
    without the place, else unknown."""
    rows, places = misses, misses.select("contig", "pos").distinct()
    checks = [F.when(F.lit(False), F.lit(""))]
    for reason, regions in ((OUTSIDE_MUTATIONS, mutation), (OUTSIDE_TARGETS, target)):
        if regions is not None:
            inside = point_join(places, regions.select("contig", "st", "en"), "left_semi").select("contig", "pos", F.lit(True).alias(reason))
            rows = rows.join(inside, ["contig", "pos"], "left")
            checks.append(F.when(F.col(reason).isNull(), F.lit(reason)))
    rows = rows.join(contigs.select("contig", F.lit(True).alias("_known")).distinct(), "contig", "left")
    reasons = F.array_compact(F.array(*checks))
    reasons = F.when(F.col("_known").isNull(), F.array(F.lit(OUTSIDE_CONTIGS))).when(F.size(reasons) == 0, F.array(F.lit(UNKNOWN))).otherwise(reasons)
    return rows.select(*misses.columns, reasons.alias("reasons"))


def reason_counts(attributed_misses: DataFrame) -> DataFrame:
    return attributed_misses.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def metrics(counts: DataFrame) -> DataFrame:
    """``tp, fn, fp`` with precision, recall and f1; null where undefined."""
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def formatted(metric: Column) -> Column:
    return F.when(metric.isNull(), "N/A").otherwise(F.format_string("%.4f", metric))


def annotated(info: Column, reasons: Column, key: str = "MISS_REASON") -> Column:
    """INFO with the reasons of a miss."""
    more = F.concat(F.lit(f"{key}="), F.array_join(reasons, ","))
    return F.when(info.isNull() | (info == "."), more).otherwise(F.concat(info, F.lit(";"), more))
