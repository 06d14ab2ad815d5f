"""Queries over files: tables written in their format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.plans.views import view, with_views
from strandframe.session import scratch
from strandframe.sources import bam
from strandframe.sources import text as T

Q: dict = {}
O: dict[str, str] = {}
c = F.col


def _add(name, sources, make, sql):
    sources = sources.split()
    Q[name] = lambda spark, d: make(spark, scratch(spark, name), *[view(spark, d, s) for s in sources])
    O[name] = with_views(sql, *sources)


def _fasta(spark, folder, contigs):
    T.write_fasta(contigs, f"{folder}/fa")
    return T.read_fasta(spark, f"{folder}/fa").select("contig", "seq", "length")


def _fastq(spark, folder, contigs):
    T.write_fastq(contigs.select(c("contig").alias("name"), "seq", F.expr("repeat('I', cast(length as int))").alias("qual")), f"{folder}/fq")
    return T.read_fastq(spark, f"{folder}/fq").select("name", "seq", F.length("qual").cast("long").alias("n"))


def _bed(spark, folder, regions, strict=True):
    line = F.concat_ws("\t", "contig", c("st").cast("string"), c("en").cast("string"), F.when(c("flag"), F.concat(F.lit("mut_rate="), F.round(c("rate"), 6).cast("string"), F.lit(";x"))))
    broken = [] if strict else ["chr1\t5", "chr1\tx\t9"]
    more = spark.createDataFrame([(x,) for x in ["# a comment", "track of no use", "", *broken]], "value string")
    regions.select(line.alias("value")).unionByName(more).write.text(f"{folder}/bed")
    return T.read_bed(spark, f"{folder}/bed", strict).select("contig", "st", "en", F.round("rate", 6).alias("rate"))


def _vcf(spark, folder, typed):
    records = typed.select("contig", F.regexp_extract("contig", r"(\d+)", 1).cast("int").alias("contig_idx"), "pos", c("line_no").cast("string").alias("id"), "ref", "alt", "qual", F.lit("PASS").alias("filter"), F.lit(".").alias("info"), F.lit("GT").alias("format"), c("gt").alias("sample"))
    T.write_vcf(records, f"{folder}/vcf", [(f"chr{i}", 100_000) for i in range(1, 23)])
    return T.read_vcf(spark, f"{folder}/vcf")


def _aligned(a):
    seq = F.expr("substring(repeat('ACGTTGCA', 14), cast(event_id % 8 + 1 as int), cast(96 + event_id % 5 as int))")
    rows = a.select("event_id", c("flag").cast("int").alias("flag"), "contig", "pos", c("mapq").cast("int").alias("mapq"), "mate_contig", (c("pos") + 50).alias("mate_pos"), c("tlen").cast("int").alias("tlen"), seq.alias("seq"))
    size = F.length("seq")
    return rows.select(F.concat(F.lit("r"), "event_id").alias("name"), "flag", "contig", "pos", "mapq", F.concat(F.lit("10M2I20M3D"), (size - 32).cast("string"), F.lit("M")).alias("cigar"), "mate_contig", "mate_pos", "tlen", "seq", F.expr("repeat('F', length(seq))").alias("qual"))


_NAMES = [(f"chr{i}", 200_000) for i in range(1, 23)]
_ALIGNED = "SELECT concat('r', event_id) AS name, CAST(flag AS INTEGER) AS flag, contig, pos, CAST(mapq AS INTEGER) AS mapq, concat('10M2I20M3D', 64 + event_id % 5, 'M') AS cigar, mate_contig, pos + 50 AS mate_pos, CAST(tlen AS INTEGER) AS tlen, substr(repeat('ACGTTGCA', 14), CAST(event_id % 8 + 1 AS INT), CAST(96 + event_id % 5 AS INT)) AS seq, repeat('F', CAST(96 + event_id % 5 AS INT)) AS qual FROM alignments"


def _sam(spark, folder, a):
    T.write_sam(_aligned(a), f"{folder}/sam", _NAMES)
    return T.read_sam(spark, f"{folder}/sam")


def _bam(spark, folder, a):
    bam.write_bam(_aligned(a), f"{folder}/bam", _NAMES).collect()
    return bam.read_bam(spark, f"{folder}/bam")


def _lines(spark, folder, regions):
    regions.select(F.concat_ws(" ", "contig", "line_no").alias("value"), "line_no").orderBy("line_no").coalesce(1).select("value").write.text(f"{folder}/lines")
    return T.lines(spark, f"{folder}/lines").select("line_no", "value")


def _bgzf(spark, folder, regions):
    bam.write_bgzf(regions.select(F.concat_ws(" ", "contig", "line_no").alias("value")), f"{folder}/z").collect()
    return T.texts(spark, f"{folder}/z")


def _names(spark, folder, chroms):
    chroms.select(F.concat_ws("\t", F.substr("contig", F.lit(4)), "contig").alias("value")).unionByName(spark.createDataFrame([("# names",), ("short",)], "value string")).write.text(f"{folder}/names")
    return T.read_names(spark, f"{folder}/names")


def _status(spark, folder, typed):
    bd = lambda m: F.when(c("pos") % m == 0, "TP").when(c("pos") % m == 1, "FN").otherwise("FP")
    records = typed.select("contig", "pos", F.when(c("extra_") == 0, "GT").otherwise("GT:BD").alias("format"), F.array(F.concat("gt", F.lit(":"), bd(5)), F.concat("gt", F.lit(":"), bd(7))).alias("samples"))
    return T.truth_status(records).groupBy("truth_bd", "query_bd").agg(F.count("*").alias("n"))


_add("s1_lines", "regions", _lines, "SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, concat(contig, ' ', line_no) AS value FROM regions")
_add("s3_fasta", "contigs", _fasta, "SELECT contig, seq, length FROM contigs")
_add("s5_fastq", "contigs", _fastq, "SELECT contig AS name, seq, length AS n FROM contigs")
_add("s7_bed", "regions", _bed, "SELECT contig, st, en, CASE WHEN flag THEN round(rate, 6) END AS rate FROM regions")
_add("s8_bed_lenient", "regions", lambda spark, folder, r: _bed(spark, folder, r, strict=False), "SELECT contig, st, en, CASE WHEN flag THEN round(rate, 6) END AS rate FROM regions")
_add("s9_vcf", "typed", lambda spark, folder, v: _vcf(spark, folder, v).select("contig", "pos", "id", "ref", "alt", "qual", "filter", F.get("samples", F.lit(0)).alias("sample")), "SELECT contig, pos, CAST(line_no AS VARCHAR) AS id, ref, alt, qual, 'PASS' AS filter, gt AS sample FROM typed")
_add("t4_vcf_in_order", "typed", lambda spark, folder, v: _vcf(spark, folder, v).groupBy("contig").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")), "SELECT contig, count(*) AS n, min(pos) AS first, max(pos) AS last FROM typed GROUP BY contig")
_add("s14_sam", "alignments", _sam, _ALIGNED)
_add("s14_bam", "alignments", _bam, _ALIGNED)
_add("s15_spans", "alignments", lambda spark, folder, a: bam.spans(_bam(spark, folder, a)).groupBy("contig").agg(F.count("*").alias("n"), F.sum("st").alias("st"), F.sum("en").alias("en")), "SELECT contig, count(*) AS n, CAST(sum(pos) AS BIGINT) AS st, CAST(sum(pos + 97 + event_id % 5) AS BIGINT) AS en FROM alignments WHERE (flag & 4) = 0 GROUP BY contig")
_add("s16_truth_status", "typed", lambda spark, folder, v: _status(spark, folder, v.withColumn("extra_", c("line_no") % 3)), "SELECT CASE pos % 5 WHEN 0 THEN 'TP' WHEN 1 THEN 'FN' ELSE 'FP' END AS truth_bd, CASE pos % 7 WHEN 0 THEN 'TP' WHEN 1 THEN 'FN' ELSE 'FP' END AS query_bd, count(*) AS n FROM typed WHERE line_no % 3 <> 0 GROUP BY 1, 2")
_add("s18_names", "chroms", _names, "SELECT substr(contig, 4) AS source, contig AS canonical FROM chroms")
_add("k13_bgzf", "regions", _bgzf, "SELECT concat(contig, ' ', line_no) AS value FROM regions")
