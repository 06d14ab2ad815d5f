"""Variant operators: fields of VCF records, classes, duplicates, covered places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.randomness import uniform
from strandframe.functions.sequence import bases_at

# Classes, and the quality that stands in for a missing one.
SNV, INSERTION, DELETION, UNKNOWN = "SNV", "INS", "DEL", "UNK"
MISSING_QUALITY = "42"


def variant_type(ref: Column, alt: Column) -> Column:
    """Null where ref and alt are equal (no variant)."""
    one = (F.length(ref) == 1) & (F.length(alt) == 1)
    return F.when(ref == alt, None).when(one, SNV).when(F.startswith(ref, alt), DELETION).when(F.startswith(alt, ref), INSERTION).otherwise(UNKNOWN)


def alleles(gt: Column) -> Column:
    """Alleles of 0/1 or 0|1 as numbers; what is no number is null."""
    return F.transform(F.split(gt, r"[/|]"), lambda a: a.try_cast("int"))


def genotype_of(gt: Column, which: Column | int) -> Column:
    """1 for each copy that has the allele."""
    which = which if isinstance(which, Column) else F.lit(which)
    return F.transform(alleles(gt), lambda a: F.coalesce(a == which, F.lit(False)).cast("int"))


def genotype_text(genotype: Column) -> Column:
    return F.array_join(F.transform(genotype, lambda a: a.cast("string")), "/")


def info_field(info: Column, key: str) -> Column:
    return F.try_element_at(F.str_to_map(info, F.lit(";"), F.lit("=")), F.lit(key))


def allele_frequency(info: Column, default: float = 1e-5) -> Column:
    """The second number of CAF."""
    return F.coalesce(F.try_element_at(F.split(info_field(info, "CAF"), ","), F.lit(2)).try_cast("double"), F.lit(default))


def homozygous(sample: Column) -> Column:
    """Whether the first item of a sample field has equal alleles, two or more."""
    parts = F.split(F.split(sample, ":")[0], r"[/|]")
    return (F.size(parts) > 1) & (F.size(F.array_distinct(parts)) == 1)


def quality(qual: Column) -> Column:
    return F.when(qual.isNull() | (qual == "."), MISSING_QUALITY).otherwise(qual)


def field(metadata: Column, key: str, default: str = ".") -> Column:
    return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(default))


def first_alt(alt: Column) -> Column:
    return F.split(alt, ",")[0]


def only_bases(value: Column) -> Column:
    return value.rlike("^[ACGT]+$")


def model_variants(records: DataFrame) -> DataFrame:
    """Records ``contig, pos, ref, alt`` a mutation model learns from: first alternative, bases only, one side of length 1."""
    rows = records.withColumn("alt", first_alt(F.col("alt"))).where(only_bases(F.col("ref")) & only_bases(F.col("alt")))
    rows = rows.where((F.length("ref") == 1) | (F.length("alt") == 1)).withColumn("type", variant_type(F.col("ref"), F.col("alt")))
    return rows.where(F.col("type").isNotNull())


def matching_reference(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """Variants whose REF is what the contig has there."""
    return bases_at(variants, contigs, F.col("pos"), F.length("ref"), "_ref").where(F.col("_ref") == F.upper("ref")).drop("_ref")


def matching_places(contigs: DataFrame, refs: list[str]) -> DataFrame:
    """``contig, pos, ref``: of variants at each place of the contigs, whose REFs are refs by turns, those whose REF is what
    the contig has there. Variants that come with their contig are compared with its letters as an array: they need not
    be joined with it, nor be rows before they match."""
    kind = contigs.schema["contig"].dataType.simpleString()
    upper, turns = [np.frombuffer(r.upper().encode("utf-32-le"), np.uint32) for r in refs], len(refs)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, seq in enumerate(batch.column(1).to_pylist()):
                letters = np.frombuffer((seq or "").encode("utf-32-le"), np.uint32)
                for turn, ref in enumerate(upper):
                    # places from which the whole REF fits
                    room = max(0, len(letters) - max(1, len(ref)) + 1)
                    same = np.ones(len(range(turn, room, turns)), bool)
                    for k, letter in enumerate(ref.tolist()):
                        same &= letters[turn + k : room + k : turns] == letter
                    pos = np.flatnonzero(same) * turns + turn
                    if len(pos):
                        yield pa.record_batch([batch.column(0).take(pa.array(np.full(len(pos), i))), pa.array(pos), pa.repeat(pa.scalar(refs[turn], pa.string()), len(pos))], ["contig", "pos", "ref"])

    return contigs.select("contig", "seq").mapInArrow(match, f"contig {kind}, pos long, ref string")


def rendered(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """``ref, alt`` of typed variants ``contig, pos, type, length, inserted`` from the contig: a deletion's first base stays."""
    deletion = F.col("type") == DELETION
    cut = bases_at(variants, contigs, F.col("pos"), F.when(deletion, F.col("length")).otherwise(1), "_cut")
    base = F.substr("_cut", F.lit(1), F.lit(1))
    return cut.select(*variants.columns, F.col("_cut").alias("ref"), F.when(deletion, base).otherwise(F.col("inserted")).alias("alt"))


def distinct_variants(variants: DataFrame) -> DataFrame:
    """The first (by line_no) of equal contig, place, type and alternative; deletions of one place are equal whatever their length."""
    alt = F.when(F.col("type") == DELETION, "").otherwise(F.col("alt"))
    w = Window.partitionBy("contig", "pos", "type", "_alt").orderBy("line_no")
    return variants.withColumn("_alt", alt).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_alt", "_n")


def covered(variants: DataFrame, kind: str) -> DataFrame:
    """``contig, pos, covers, gt``: each place that variants of a kind span, deletions by ref, insertions by alt."""
    long = F.length("ref") if kind == DELETION else F.length("alt")
    rows = variants.where(F.col("type") == kind)
    return rows.select("contig", F.col("line_no").alias("covers"), "gt", F.explode(F.sequence(F.col("pos"), F.col("pos") + long - 1)).alias("pos"))


def under(variants: DataFrame, kind: str) -> DataFrame:
    """``line_no, covers``: variants that stand on a place covered by another one of the kind with equal genotype."""
    return variants.join(covered(variants, kind), ["contig", "pos", "gt"]).where(F.col("line_no") != F.col("covers")).select("line_no", "covers").distinct()


def counted_under(variants: DataFrame, kind: str) -> DataFrame:
    """``line_no, n``: how many other lines of the kind ``under`` finds for each line; lines under none are left out.

    No pair of lines is made where they share one place: a place's covering lines are counted once for all that stand on
    it. Only where a line has several records can it meet another one on several places; the pairs of places that both
    have, joined by both places, tell how often such a pair of lines was counted too much.
    """
    key = ["contig", "pos", "gt"]
    long = F.length("ref") if kind == DELETION else F.length("alt")
    rows = variants.where("line_no is not null and contig is not null and pos is not null and gt is not null")
    # records go to their line's task before they are spread, so that all that follows by line is there
    rows = rows.select("line_no", "contig", F.col("pos").cast("long").alias("at"), "gt", F.when(F.col("type") == kind, long).otherwise(0).alias("span")).repartition("line_no")
    spread = rows.select("line_no", "contig", "at", "gt", "span", F.explode(F.sequence(F.col("at"), F.col("at") + F.greatest("span", F.lit(1)) - 1)).alias("pos"))
    flags = F.max(F.when(F.col("pos") == F.col("at"), 1).otherwise(0)).alias("stands"), F.max(F.when(F.col("span") > 0, 1).otherwise(0)).alias("covers")
    places = spread.groupBy("line_no", *key).agg(*flags)
    stands, covers = places.where("stands = 1"), places.where("covers = 1")
    most = stands.join(covers.groupBy(*key).agg(F.count("*").alias("c")), key).groupBy("line_no").agg(F.sum(F.col("c") - F.col("covers")).alias("most"))

    def pairs(df: DataFrame, line: str) -> DataFrame:
        a = df.select(F.col("line_no").alias(line), *[F.col(k).alias(f"a_{k}") for k in key])
        b = df.select("line_no", *[F.col(k).alias(f"b_{k}") for k in key])
        before = F.struct("a_contig", "a_gt", "a_pos") < F.struct("b_contig", "b_gt", "b_pos")
        return a.join(b, (F.col(line) == F.col("line_no")) & before).drop("line_no").withColumn("apart", F.greatest(F.lit(-64), F.least(F.lit(64), F.col("b_pos") - F.col("a_pos"))))

    met = pairs(stands, "line_no_1")
    # a row of at most 129 distances: pairs of places at another one meet none
    seen = met.agg(F.collect_set("apart").alias("seen"))
    other = pairs(covers, "line_no_2").crossJoin(F.broadcast(seen)).where(F.array_contains("seen", F.col("apart"))).drop("seen")
    both = met.join(other, [*[f"{x}_{k}" for x in "ab" for k in key], "apart"]).where("line_no_1 <> line_no_2").groupBy("line_no_1", "line_no_2").agg(F.count("*").alias("q"))
    # q pairs of s shared places are s (s - 1) / 2; the two lines count once
    over = both.groupBy(F.col("line_no_1").alias("line_no")).agg(F.sum(F.rint((F.sqrt(8 * F.col("q") + 1) + 1) / 2).cast("long") - 1).alias("over"))
    return most.join(over, "line_no", "left").select("line_no", (F.col("most") - F.coalesce("over", F.lit(0))).alias("n")).where("n > 0")


def contains(start: Column, length: Column, pos: Column) -> Column:
    """Whether a variant that begins at start and spans length has the place in it."""
    return (start <= pos) & (pos < start + length)


def deletion_contains(start: Column, length: Column, pos: Column, genotype: Column, other: Column) -> Column:
    """The same for a deletion, which another variant meets only if their genotypes are equal."""
    return contains(start, length, pos) & genotype.eqNullSafe(other)


def five_prime(start: Column, pos: Column, or_at: bool = False) -> Column:
    """Whether a place lies before a variant (or at its start)."""
    return pos <= start if or_at else pos < start


def three_prime(start: Column, length: Column, pos: Column, or_at: bool = False) -> Column:
    """Whether a place lies after a variant's end (or at it)."""
    return pos >= start + length if or_at else pos > start + length


def free_copy(taken: Column, u: Column) -> Column:
    """A genotype text that has one of the copies that ``taken`` (0 and 1) leaves free, by u; null if none is."""
    free = F.filter(F.sequence(F.lit(0), F.size(taken) - 1), lambda i: F.get(taken, i) == 0)
    chosen = F.get(free, F.floor(u * F.size(free)).cast("int"))
    return F.when(F.size(free) > 0, F.array_join(F.transform(taken, lambda _, i: F.when(i == chosen, "1").otherwise("0")), "/"))


def on_free_copies(added: DataFrame, present: DataFrame, seed: int) -> DataFrame:
    """Variants ``contig, pos, line_no, ...`` with ``gt`` on a copy that those present at their place leave free; where
    there are none at the place the genotype stays, and where no copy is free the variant is left out."""
    taken = composite_genotypes(present).withColumnRenamed("genotype", "_taken")
    joined = added.join(taken, ["contig", "pos"], "left")
    gt = F.when(F.col("_taken").isNull(), F.col("gt")).otherwise(free_copy(F.col("_taken"), uniform(F.lit(seed), F.col("contig"), F.col("pos"), F.col("line_no"), "free")))
    return joined.withColumn("gt", gt).where("gt is not null").select(*added.columns)


def composite_genotypes(variants: DataFrame) -> DataFrame:
    """``contig, pos, genotype``: for each copy whether any variant at the place has it."""
    rows = variants.select("contig", "pos", F.posexplode(genotype_of(F.col("gt"), 1)).alias("i", "g"))
    each = rows.groupBy("contig", "pos", "i").agg(F.max("g").alias("g"))
    return each.groupBy("contig", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda s: s["g"]).alias("genotype"))


def exact_matches(truth: DataFrame, called: DataFrame) -> DataFrame:
    """``contig, pos, ref, alt, truth_bd, query_bd``: records matched on all four; what one side lacks is '.'."""
    key = ["contig", "pos", "ref", "alt"]
    t = truth.select(*key, F.lit(True).alias("t")).distinct()
    c = called.select(*key, F.lit(True).alias("c")).distinct()
    both = t.join(c, key, "full")
    truth_bd = F.when(F.col("t") & F.col("c"), "TP").when(F.col("t"), "FN").otherwise(".")
    query_bd = F.when(F.col("t") & F.col("c"), "TP").when(F.col("c"), "FP").otherwise(".")
    return both.select(*key, truth_bd.alias("truth_bd"), query_bd.alias("query_bd"))


def bucket(truth_bd: Column, query_bd: Column) -> Column:
    """TP before FN before FP; null for none."""
    return F.when((truth_bd == "TP") | (query_bd == "TP"), "TP").when(truth_bd == "FN", "FN").when(query_bd == "FP", "FP")


def renamed_by_reference(variants: DataFrame, contigs: DataFrame, accessions: DataFrame) -> DataFrame:
    """Variants of the reference's contigs, by name, else by the name that ``accession, name`` gives, or the accession."""
    names = contigs.select(F.col("contig").alias("known")).distinct()
    turned = accessions.select(F.col("accession").alias("a"), F.col("name").alias("b"))
    either = turned.unionByName(turned.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = either.join(names, F.col("b") == F.col("known")).groupBy("a").agg(F.min("b").alias("other"))
    rest = [c for c in variants.columns if c != "contig"]
    joined = variants.join(names, F.col("contig") == F.col("known"), "left").join(second, F.col("contig") == F.col("a"), "left")
    return joined.select(F.coalesce("known", "other").alias("contig"), *rest).where("contig is not null")


def distinct_records(records: DataFrame) -> DataFrame:
    return records.select("contig", "pos", "ref", "alt").distinct()


def without(variants: DataFrame, removed: DataFrame) -> DataFrame:
    """The variants that are not among those removed, told by line, contig and place."""
    return variants.join(removed.select("line_no", "contig", "pos"), ["line_no", "contig", "pos"], "left_anti").select(*variants.columns)


def per_contig(variants: DataFrame) -> DataFrame:
    return variants.groupBy("contig").agg(F.count("*").alias("n"))


def counters(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """``found, skipped, same``: variants of the contigs, of others, and without a change."""
    known = contigs.select("contig", F.lit(True).alias("known")).distinct()
    return variants.join(known, "contig", "left").agg(F.count_if("known").alias("found"), F.count_if(F.col("known").isNull()).alias("skipped"), F.count_if(F.col("ref") == F.col("alt")).alias("same"))
