"""Whole runs: simulate, fit, compare. Each is one plan a product, written in parallel."""

from __future__ import annotations

import json
import logging
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.randomness import uniform
from strandframe.functions.sequence import rotate
from strandframe.operators import compare as C
from strandframe.operators import fragments as G
from strandframe.operators import intervals as I
from strandframe.operators import mutation_model as M
from strandframe.operators import quality_model as P
from strandframe.operators import sim_models as Z
from strandframe.operators import simulate as S
from strandframe.operators import variants as V
from strandframe.plans.config import ConfigError, RunConfig, write_summary
from strandframe.session import exists, stored, write_file
from strandframe.sources import bam
from strandframe.sources import text as T

log = logging.getLogger("strandframe")

#: Names of quality bins of common machines.
QUALITY_PRESETS = {"novaseq": [2, 12, 23, 37], "nextseq2000": [2, 12, 26, 37], "nextseq500": [2, 12, 23, 27, 37]}


class OutputExists(FileExistsError):
    """An output that is there already, where overwriting was not asked for."""


def checked(spark: SparkSession, inputs: list[str | None], outputs: list[str], overwrite: bool) -> str:
    """The mode to write with; inputs must be there, outputs must not, unless they may be overwritten."""
    for path in inputs:
        if path and not exists(spark, path):
            raise FileNotFoundError(path)
    for path in outputs:
        if not overwrite and exists(spark, path):
            raise OutputExists(path)
    return "overwrite" if overwrite else "errorifexists"


def settings(spark: SparkSession, config: RunConfig) -> S.Settings:
    """What the configuration and the fitted models that it names come to; its own numbers go before a model's."""
    mutations = Z.Mutations.fitted(M.load(spark, config.mutation_model)) if config.mutation_model else Z.Mutations()
    if config.mutation_rate is not None:
        mutations = replace(mutations, rate=config.mutation_rate)
    errors, qualities, bins = Z.Errors(), Z.Qualities(), tuple(config.quality_bins or ())
    if config.error_model:
        if exists(spark, f"{config.error_model}/transitions"):
            qualities = Z.MarkovQualities.fitted(Z.load(spark, config.error_model, "initial", "marginal", "transitions"))
        else:
            qualities = Z.Qualities.fitted(Z.load(spark, config.error_model, "moments")["moments"], bins)
        errors = replace(errors, rate=min(0.3, Z.load(spark, config.error_model, "error")["error"].first()["error"]))
    elif bins:
        qualities = replace(qualities, bins=bins)
    if config.error_rate is not None:
        errors = replace(errors, rate=config.error_rate)
    if config.uniform_quality:
        qualities = Z.Qualities(uniform=errors.rate)
    mean, sd = config.fragment_mean, config.fragment_sd
    if config.fragment_model:
        fitted = Z.load(spark, config.fragment_model, "moments")["moments"].first()
        mean, sd = mean or fitted["mean"], sd or fitted["sd"]
    weights, width = (), 100
    if config.gc_model:
        rows = Z.load(spark, config.gc_model, "weights")["weights"].collect()
        found = {r["gc_pct"]: r["weight"] for r in rows}
        weights, width = tuple(found.get(i, 1.0) for i in range(101)), rows[0]["width"]
    size = config.read_length
    return S.Settings(read_length=size, coverage=config.coverage, paired=config.paired, ploidy=config.ploidy, seed=config.seed or 0, min_mutations=config.min_mutations, fragment_mean=mean or 2.0 * size, fragment_sd=sd if sd is not None else 0.4 * size, mutations=mutations, errors=errors, qualities=qualities, gc_weights=weights, gc_window=width)


def included(spark: SparkSession, path: str, contigs: DataFrame, s: S.Settings | None = None) -> DataFrame:
    """Variants of a VCF that match the reference, as the simulator's variants, one for each alternative.

    The genotype is the first sample's GT, else WP of INFO, else drawn by the record's key; an alternative that no copy
    has is left out, as are records of other contigs or with another REF, and all but the first of equal variants.
    """
    s = s or S.Settings()
    records = T.read_vcf(spark, path).where("pos is not null").withColumn("ref", F.upper("ref"))
    records = V.matching_reference(records, contigs)
    keys = F.split(F.coalesce("format", F.lit("")), ":")
    place = F.array_position(keys, "GT").cast("int")
    gt = F.when(place > 0, F.try_element_at(F.split(F.get("samples", F.lit(0)), ":"), F.greatest(place, F.lit(1))))
    key = lambda *slot: uniform(F.lit(s.seed), "vcf", F.col("contig"), F.col("pos"), F.col("line_no"), *slot)
    drawn = S.genotype(key("hom"), lambda p: key("ploid", p), s.ploidy, s.mutations.homozygous)
    rows = records.withColumn("given", F.coalesce(gt, V.info_field(F.col("info"), "WP"))).select("contig", "pos", "line_no", "ref", "given", F.posexplode(F.split(F.upper("alt"), ",")).alias("k", "alt"))
    rows = rows.where(V.only_bases(F.col("alt")) & V.only_bases(F.col("ref")))
    rows = rows.withColumn("gt", F.when(F.col("given").isNull(), drawn).otherwise(V.genotype_text(V.genotype_of(F.col("given"), F.col("k") + 1))))
    rows = rows.withColumn("type", V.variant_type(F.col("ref"), F.col("alt"))).where("type is not null and gt like '%1%'")
    return V.distinct_variants(rows.select("contig", "pos", "line_no", "type", (F.length("ref") - F.length("alt")).alias("shrink"), "ref", "alt", "gt"))


def inclusion_counts(spark: SparkSession, path: str, contigs: DataFrame) -> dict:
    """Records of a VCF that are taken, of contigs that are not there, and of another REF."""
    records = T.read_vcf(spark, path).where("pos is not null").withColumn("ref", F.upper("ref"))
    known = records.join(contigs.select("contig"), "contig", "left_semi")
    total, here, good = records.count(), known.count(), V.matching_reference(known, contigs).count()
    return {"taken": good, "other_contigs": total - here, "other_reference": here - good}


def products(spark: SparkSession, config: RunConfig, s: S.Settings, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, reads) of the contigs, both stored."""
    bed = lambda p: T.read_bed(spark, p).join(contigs.select("contig"), "contig", "left_semi") if p else None
    new = S.variants(contigs, s, bed(config.mutation_bed))
    if config.include_vcf:
        given = stored(included(spark, config.include_vcf, contigs, s), "included")
        new = given.unionByName(new.join(given.select("contig", "pos"), ["contig", "pos"], "left_anti"))
    found = stored(new, "variants")
    fragments = S.restricted(S.placements(contigs, s), bed(config.target_bed), bed(config.discard_bed))
    return found, stored(S.reads(contigs, fragments, found, s), "reads")


def simulate(spark: SparkSession, config: RunConfig, circular: bool = False) -> dict:
    """Run a configuration; gives what was delivered. Outputs are folders of parts under ``config.output``.

    circular: half of the coverage comes from the contigs as they are, half from the same begun at their middle, so that
    reads span the place where a circular genome was cut open.
    """
    out = config.output.rstrip("/")
    outputs = {f"fastq_{i}": f"{out}/fastq_{i}" for i in ((1, 2) if config.paired else (1,)) if config.produce_fastq}
    outputs |= {n: f"{out}/{n}" for n, wanted in (("bam", config.produce_bam), ("vcf", config.produce_vcf)) if wanted}
    beds = [config.target_bed, config.discard_bed, config.mutation_bed, config.include_vcf]
    mode = checked(spark, [config.reference, config.mutation_model, config.error_model, config.fragment_model, config.gc_model, *beds], [*outputs.values(), f"{out}/run_summary.json"], config.overwrite)
    s = settings(spark, config)
    if circular:
        if any(beds):
            raise ConfigError("a circular run takes no regions or variants, whose places would not fit the turned contigs")
        s = replace(s, coverage=s.coverage / 2)
    contigs = stored(T.read_fasta(spark, config.reference, s.seed), "contigs")
    log.info("simulating %s at coverage %s, seed %s", config.reference, config.coverage, s.seed)
    found, reads = products(spark, config, s, contigs)
    if circular:
        turned = stored(contigs.withColumns({"seq": rotate(F.col("seq")), "contig": F.concat("contig", F.lit("_turned"))}), "turned")
        more_found, more_reads = products(spark, config, s, turned)
        found, reads, contigs = found.unionByName(more_found), reads.unionByName(more_reads), contigs.unionByName(turned)
    names = [(r["contig"], r["length"]) for r in contigs.select("contig", "length").collect()]
    if config.produce_fastq:
        for mate in (False, True) if config.paired else (False,):
            T.write_fastq(S.fastq(reads, mate, config.quality_offset), outputs[f"fastq_{1 + mate}"], mode=mode)
    if config.produce_bam:
        bam.write_bam(reads.drop("reverse"), outputs["bam"] if "://" in out else f"file://{outputs['bam']}", names).collect()
    if config.produce_vcf:
        index = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(names)], "contig string, contig_idx int")
        records = found.join(index, "contig").selectExpr("contig", "contig_idx", "pos", "cast(null as string) id", "ref", "alt", "'42' qual", "'PASS' filter", "'.' info", "'GT' format", "gt sample")
        T.write_vcf(records, outputs["vcf"], names, mode=mode)
    delivered = {"contigs_simulated": [c for c, n in names if n >= s.read_length], "reads": reads.count(), "variants": {r["contig"]: r["count"] for r in found.groupBy("contig").count().collect()}}
    if config.include_vcf:
        delivered["included"] = inclusion_counts(spark, config.include_vcf, contigs)
    write_summary(spark, out, config, outputs, delivered)
    return delivered


def _saved(spark: SparkSession, tables: dict[str, DataFrame], inputs: list[str], folder: str, overwrite: bool) -> dict:
    mode = checked(spark, inputs, [f"{folder}/{n}" for n in tables], overwrite)
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")
    return {n: spark.read.parquet(f"{folder}/{n}").count() for n in tables}


def fit_mutations(spark: SparkSession, reference: str, vcf: str, folder: str, bed: str | None = None, human: bool = False, overwrite: bool = False) -> dict:
    """Fit and save a mutation model from the variants of a VCF, within the regions of a BED where one is given, there
    also its rate and its counts of trinucleotides."""
    contigs = T.read_fasta(spark, reference)
    if human:
        contigs = M.of_human_names(contigs)
        if not contigs.limit(1).count():
            raise T.FormatError(f"{reference} has no contig of a human name")
    aliases = T.contig_accessions(T.vcf_header(spark, vcf))
    records = V.renamed_by_reference(T.read_vcf(spark, vcf), contigs, spark.createDataFrame(list(aliases.items()), "accession string, name string"))
    gt = F.get("samples", F.lit(0)).alias("sample")
    records = V.model_variants(records.select("contig", "pos", "ref", "alt", gt))
    regions = T.read_bed(spark, bed).select("contig", "st", "en", "line_no") if bed else None
    if regions is not None:
        one_based = records.withColumn("pos", F.col("pos") + 1)
        records = I.first_match(one_based, regions).drop("st", "en", "r_line").withColumn("pos", F.col("pos") - 1)
    model = M.fit(stored(V.matching_reference(records, contigs), "model-variants"), contigs, regions)
    return _saved(spark, model, [reference, vcf, *([bed] if bed else [])], folder, overwrite)


def fit_fragments(spark: SparkSession, alignments: str, folder: str, min_reads: int = 2, overwrite: bool = False) -> dict:
    """Fit and save a model of fragment lengths from a SAM or BAM file."""
    counts = G.filtered(G.lengths(read_alignments(spark, alignments)), min_reads)
    moments = G.moments(counts).where("mean is not null")
    if not moments.count():
        raise T.FormatError(f"{alignments} has no pairs to learn lengths from")
    return _saved(spark, {"moments": moments, "lengths": counts}, [alignments], folder, overwrite)


def fit_gc(spark: SparkSession, reference: str, alignments: str, folder: str, width: int = 100, overwrite: bool = False) -> dict:
    """Fit and save weights by GC from the coverage of a SAM or BAM file."""
    contigs = T.read_fasta(spark, reference)
    spans = bam.spans(read_alignments(spark, alignments))
    weights = G.gc_weights(contigs, I.coverage(spans), width).withColumn("width", F.lit(width))
    return _saved(spark, {"weights": weights}, [reference, alignments], folder, overwrite)


def read_qualities(spark: SparkSession, paths: list[str], offset: int = 33, most: int | None = None) -> DataFrame:
    """``q`` of the reads of FASTQ files, of the first read's length; the first ``most`` of each where a number is given."""
    out, length = None, None
    for path in paths:
        rows = T.read_fastq(spark, path)
        rows = P.limited(rows, most) if most else rows
        if length is None:
            first = rows.orderBy("file", "record_no").select(F.length("qual").alias("n")).first()
            if first is None:
                raise T.FormatError(f"{path} has no reads")
            length = first["n"]
        one = P.conforming(rows.select(P.decoded(F.col("qual"), offset).alias("q")), length)
        out = one if out is None else out.unionByName(one)
    return out


def fit_qualities(spark: SparkSession, paths: list[str], folder: str, allowed: int | list[int] = 42, offset: int = 33, most: int | None = None, markov: bool = False, preset: str | None = None, overwrite: bool = False) -> dict:
    """Fit and save a quality model of FASTQ files: moments by place, or a Markov chain, and the mean error."""
    bins = QUALITY_PRESETS[preset] if preset else P.prepared_bins(allowed)
    markov = markov or preset is not None
    reads = stored(read_qualities(spark, paths, offset, most).withColumn("q", F.transform("q", lambda q: P.binned(q, bins))), "qualities")
    length = reads.select(F.size("q").alias("n")).first()
    if length is None:
        raise T.FormatError("no reads to learn qualities from")
    counts = P.by_position(reads)
    tables = {"error": P.mean_error(counts), "moments": P.moments(counts)}
    if markov:
        tables |= P.markov_model(reads, length["n"])
    return _saved(spark, tables, paths, folder, overwrite)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM text, or BAM by its name."""
    return bam.read_bam(spark, path) if path.rstrip("/").endswith(("bam", ".bam")) else T.read_sam(spark, path)


def compare(spark: SparkSession, truth: str, called: str, summary: dict, aliases: DataFrame | None = None, folder: str | None = None, overwrite: bool = False) -> dict:
    """Counts, metrics and reasons of misses of called against truth, matched exactly; in a folder also as JSON, as text,
    and the misses as VCF with their reasons."""
    mode = checked(spark, [truth, called], [f"{folder}/{n}" for n in ("comparison.json", "comparison.txt", "missed")] if folder else [], overwrite)
    known = T.read_vcf(spark, truth)
    matched = stored(V.exact_matches(known, T.read_vcf(spark, called)).withColumn("bucket", V.bucket(F.col("truth_bd"), F.col("query_bd"))), "matched")
    counts = {r["bucket"]: r["count"] for r in matched.groupBy("bucket").count().collect()}
    one = spark.createDataFrame([tuple(counts.get(k, 0) for k in ("TP", "FN", "FP"))], "tp long, fn long, fp long")
    contigs = spark.createDataFrame([(c,) for c in summary["delivered"]["contigs_simulated"]], "contig string")
    beds = {}
    for name in ("mutation_bed", "target_bed"):
        path = summary["config"].get(name)
        regions = T.read_bed(spark, path, strict=False) if path else None
        beds[name] = C.with_aliases(regions, aliases) if regions is not None and aliases is not None else regions
    missed = stored(C.attributed(matched.where("bucket = 'FN'").select("contig", "pos", "ref", "alt"), contigs, beds["mutation_bed"], beds["target_bed"]), "missed")
    made = {"counts": counts, "metrics": C.metrics(one).first().asDict(), "reasons": {r["reason"]: r["n"] for r in C.reason_counts(missed).collect()}}
    if folder:
        write_file(spark, f"{folder}/comparison.json", json.dumps(made, indent=2, sort_keys=True))
        write_file(spark, f"{folder}/comparison.txt", report(made))
        noted = known.join(missed.select("contig", "pos", "ref", "alt", "reasons").distinct(), ["contig", "pos", "ref", "alt"])
        records = noted.select("contig", F.lit(0).alias("contig_idx"), "pos", "id", "ref", "alt", "qual", "filter", C.annotated(F.col("info"), F.col("reasons")).alias("info"), "format", F.get("samples", F.lit(0)).alias("sample"))
        T.write_vcf(records, f"{folder}/missed", [], mode=mode)
    return made


def report(made: dict) -> str:
    """The comparison as text."""
    shown = {k: "N/A" if made["metrics"][k] is None else f"{made['metrics'][k]:.4f}" for k in ("precision", "recall", "f1")}
    lines = ["Variants", *(f"  {n:<22}{made['counts'].get(n, 0)}" for n in ("TP", "FN", "FP")), "Metrics", *(f"  {k:<22}{v}" for k, v in shown.items()), "Reasons of misses"]
    return "\n".join([*lines, *(f"  {k:<28}{v}" for k, v in sorted(made["reasons"].items())), ""])
