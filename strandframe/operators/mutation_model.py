"""Fit a mutation model: small tables of shares from contigs and variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.sequence import BASES, bases_at, trinucleotide_codes, trinucleotide_counts, trinucleotide_index
from strandframe.operators.variants import DELETION, INSERTION, SNV, homozygous

# Shares where there is nothing to count.
DEFAULT_HOMOZYGOUS = 0.001


def share(df: DataFrame, *within: str, n: str = "n") -> DataFrame:
    """p: n as a share of its group's sum; the whole table's without a group."""
    return df.withColumn("p", F.col(n) / F.sum(n).over(Window.partitionBy(*within)))


def contexts(snvs: DataFrame, contigs: DataFrame) -> DataFrame:
    """``ref_tri, alt_tri`` of variants with a base on either side, upper-cased."""
    cut = bases_at(snvs.where("pos > 0"), contigs, F.col("pos") - 1, 3, "_tri", most=3)
    tri = F.upper("_tri")
    found = cut.select(tri.alias("ref_tri"), F.concat(F.substr(tri, F.lit(1), F.lit(1)), F.col("alt"), F.substr(tri, F.lit(3), F.lit(1))).alias("alt_tri"))
    return found.where(F.col("ref_tri").rlike("^[ACGT]{3}$"))


def trinucleotide_transitions(snvs: DataFrame, contigs: DataFrame) -> DataFrame:
    return contexts(snvs, contigs).groupBy("ref_tri", "alt_tri").agg(F.count("*").alias("n"))


def snp_transitions(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("type") == SNV).groupBy("ref", "alt").agg(F.count("*").alias("n"))


def indel_lengths(variants: DataFrame) -> DataFrame:
    """``len, n``: length of alt less that of ref, negative for deletions."""
    rows = variants.where(F.col("type").isin(INSERTION, DELETION))
    return rows.groupBy((F.length("alt") - F.length("ref")).alias("len")).agg(F.count("*").alias("n"))


def length_shares(variants: DataFrame) -> DataFrame:
    """``kind, len, p`` within insertions and within deletions."""
    rows = indel_lengths(variants).select(F.when(F.col("len") > 0, INSERTION).otherwise(DELETION).alias("kind"), F.abs("len").alias("len"), "n")
    return share(rows, "kind").select("kind", "len", "p")


def type_shares(variants: DataFrame) -> DataFrame:
    return share(variants.groupBy("type").agg(F.count("*").alias("n"))).select("type", "p")


def mutation_shares(snvs: DataFrame, contigs: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """``tri, p``: mutated places by places there are, in the regions where there are any; 0 where none was mutated."""
    mutated = trinucleotide_transitions(snvs, contigs).groupBy(F.col("ref_tri").alias("tri")).agg(F.sum("n").alias("mutated"))
    return trinucleotide_counts(contigs if regions is None else region_sequences(contigs, regions)).join(mutated, "tri", "left").select("tri", (F.coalesce("mutated", F.lit(0)) / F.col("n")).alias("p"))


def transition_shares(snvs: DataFrame, contigs: DataFrame) -> DataFrame:
    return share(trinucleotide_transitions(snvs, contigs), "ref_tri").select("ref_tri", "alt_tri", "p")


def dense_transitions(snvs: DataFrame, contigs: DataFrame) -> DataFrame:
    """All 64 contexts with their three other middles, 0 where unseen: a grid of fixed size."""
    spark = snvs.sparkSession
    grid = [(a + b + c, a + x + c) for a in BASES for b in BASES for c in BASES for x in BASES if x != b]
    return spark.createDataFrame(grid, "ref_tri string, alt_tri string").join(transition_shares(snvs, contigs), ["ref_tri", "alt_tri"], "left").select("ref_tri", "alt_tri", F.coalesce("p", F.lit(0.0)).alias("p"))


def snp_matrix(variants: DataFrame) -> DataFrame:
    """``ref, A, C, G, T``: one row a reference base."""
    shares = share(snp_transitions(variants), "ref")
    return shares.groupBy("ref").pivot("alt", list(BASES)).agg(F.first("p")).select("ref", *[F.coalesce(b, F.lit(0.0)).alias(b) for b in BASES])


def mutation_rate(variants: DataFrame, contigs: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """``rate``: variants by bases other than N; by the regions' length, both ends included, where there are regions."""
    if regions is not None:
        length = regions.join(contigs.select("contig"), "contig", "left_semi").agg(F.sum(F.col("en") - F.col("st") + 1).alias("bases"))
        return variants.agg(F.count("*").alias("n")).crossJoin(length).select(F.try_divide(F.col("n"), F.col("bases")).alias("rate"))
    bases = contigs.agg(F.sum(F.length(F.replace("seq", F.lit("N"), F.lit("")))).alias("bases"))
    return variants.agg(F.count("*").alias("n")).crossJoin(bases).select(F.try_divide(F.col("n"), F.col("bases")).alias("rate"))


def homozygous_share(variants: DataFrame, sample: Column) -> DataFrame:
    hom = F.count_if(homozygous(sample)) / F.count("*")
    return variants.agg(F.when(F.count_if(homozygous(sample)) > 0, hom).otherwise(DEFAULT_HOMOZYGOUS).alias("p"))


def local_bias(contigs: DataFrame, bias: DataFrame) -> DataFrame:
    """``contig, pos, p``: each place's share of its contig's bias, by the three letters around it; none for others."""
    from strandframe.functions.sequence import kmers

    at = kmers(contigs, 3, "contig").join(F.broadcast(bias.withColumnRenamed("p", "w")), F.col("kmer") == F.col("tri"))
    return at.select("contig", (F.col("pos") + 1).alias("pos"), (F.col("w") / F.sum("w").over(Window.partitionBy("contig"))).alias("p"))


def greatest_bias(contigs: DataFrame, bias: DataFrame) -> DataFrame:
    """``contig, places, top``: how many places of a contig local_bias gives, and the greatest of their shares; NaN where
    all weights are 0. Sums are made by sequence, no row is made a place."""
    kind = contigs.schema["contig"].dataType.simpleString()
    # one row of at most 64 weights
    weights = bias.agg(F.collect_list(F.struct(trinucleotide_index(F.col("tri")).alias("i"), F.col("p").cast("double").alias("p"))).alias("weights"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, known = np.zeros(65), np.zeros(65, bool)
            for w in batch.column(2)[0].as_py() if batch.num_rows else []:
                if w["i"] is not None:
                    weight[w["i"]], known[w["i"]] = w["p"], True
            counts = [np.bincount(trinucleotide_codes(s) & 127, minlength=128) for s in batch.column(1).to_pylist()]
            counts = [np.where(known[:64], n[:64], 0) for n in counts]
            places = [int(n.sum()) for n in counts]
            yield pa.record_batch([batch.column(0), pa.array(places, pa.int64()), pa.array([float(n @ weight[:64]) for n in counts], pa.float64()), pa.array([float(weight[:64][n > 0].max(initial=0.0)) for n in counts], pa.float64())], ["contig", "places", "total", "top"])

    rows = contigs.select("contig", "seq").crossJoin(F.broadcast(weights)).mapInArrow(weigh, f"contig {kind}, places long, total double, top double").where("places > 0")
    sums = rows.groupBy("contig").agg(F.sum("places").alias("places"), F.sum("total").alias("total"), F.max("top").alias("top"))
    return sums.select("contig", "places", F.when(F.col("total") == 0, float("nan")).otherwise(F.col("top") / F.col("total")).alias("top"))


def indexed(shares: DataFrame) -> DataFrame:
    """``i, p``: the 64 shares by index."""
    return shares.select(trinucleotide_index(F.col("tri")).alias("i"), "p")


def region_sequences(contigs: DataFrame, regions: DataFrame, size: int = 1 << 14) -> DataFrame:
    """``seq``: the letters of the regions, cut to parts of size that overlap by two, so that each trinucleotide of a
    region is in one part; a region's end is included."""
    spans = regions.join(contigs.select("contig", "length"), "contig").select("contig", F.greatest("st", F.lit(0)).alias("st"), F.least(F.col("en") + 1, F.col("length")).alias("en")).where("st < en")
    part = spans.select("contig", "en", F.explode(F.sequence(F.col("st"), F.col("en") - 1, F.lit(size).cast("long"))).alias("at"))
    return bases_at(part, contigs, F.col("at"), F.least(F.col("en") - F.col("at"), F.lit(size + 2)), "seq", most=size + 2, size=size).select("seq")


#: Names of human contigs, which may have chr before them.
HUMAN = (*(str(i) for i in range(1, 30)), "x", "y", "X", "Y", "mt", "Mt", "MT")


def of_human_names(contigs: DataFrame) -> DataFrame:
    """Contigs named as human ones, with or without chr."""
    return contigs.where(F.regexp_replace("contig", "^chr", "").isin(*HUMAN))


def fit(variants: DataFrame, contigs: DataFrame, regions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The model's tables by name, from typed variants ``contig, pos, ref, alt, type`` and, for genotypes, ``sample``."""
    snvs = variants.where(F.col("type") == SNV)
    return {
        "types": type_shares(variants),
        "snp": share(snp_transitions(variants), "ref").select("ref", "alt", "p"),
        "trinucleotides": dense_transitions(snvs, contigs),
        "bias": mutation_shares(snvs, contigs, regions),
        "lengths": length_shares(variants),
        "rate": mutation_rate(variants, contigs, regions),
        "homozygous": homozygous_share(variants, F.col("sample") if "sample" in variants.columns else F.lit(None).cast("string")),
    }


def save(model: dict[str, DataFrame], folder: str) -> None:
    """A Parquet table a part."""
    for name, table in model.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("types", "snp", "trinucleotides", "bias", "lengths", "rate", "homozygous")}
