"""Text formats as DataFrames: lines with numbers, FASTA, FASTQ, BED, VCF, SAM, contig names; and their sinks."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.sequence import resolved
from strandframe.session import files, first_bytes

GZIP_MAGIC = b"\x1f\x8b"


class FormatError(ValueError):
    """An input that is not of its format."""


def is_compressed(spark: SparkSession, path: str) -> bool:
    """By the first two bytes of the file, whatever its name; nothing more of it is read."""
    return first_bytes(spark, path, 2) == GZIP_MAGIC


def _split_paths(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files that the text reader can read, gzip files under names that it does not take for such)."""
    found = files(spark, path)
    if not found:
        raise FormatError(f"{path} names no file")
    misnamed = [p for p in found if not p.endswith((".gz", ".bgz")) and is_compressed(spark, p)]
    return [p for p in found if p not in set(misnamed)], misnamed


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value``: lines of text files, numbered from 0 in each file.

    A split knows where in its file it starts; the lines of a split are numbered where they are read, and the counts of
    the splits before it, a small table, are added. Files whose name ends in .gz are inflated by the reader; a gzip file
    of another name, told by its first bytes, is inflated whole by one task.
    """
    plain, misnamed = _split_paths(spark, path)
    out = None
    if plain:
        out = _numbered(spark, plain)
    if misnamed:
        more = _inflated(spark, misnamed, "\n")
        out = more if out is None else out.unionByName(more)
    return out


def _numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.text(paths).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    joined = rows.join(before, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return joined.select("file", (F.col("before") + F.col("i") - F.col("first")).alias("line_no"), "value")


def texts(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``value``: what stands between separators in text files, gzip files of any name among them."""
    plain, misnamed = _split_paths(spark, path)
    # without a separator of its own the reader takes line ends of all kinds
    reader = spark.read if separator == "\n" else spark.read.option("lineSep", separator)
    out = reader.text(plain).select("value") if plain else None
    if misnamed:
        more = _inflated(spark, misnamed, separator).select("value")
        out = more if out is None else out.unionByName(more)
    return out


def _inflated(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    mark = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with gzip.open(io.BytesIO(content), "rb") as f:
                    rest, at, ended = b"", 0, False
                    while not ended:
                        data = f.read(1 << 20)
                        ended = not data
                        *held, rest = (rest + data).split(mark)
                        if ended and rest:
                            held.append(rest)
                        values = [x.rstrip(b"\r").decode("utf-8", "replace") if mark == b"\n" else x.decode("utf-8", "replace") for x in held]
                        yield pa.record_batch([pa.array([name] * len(held), pa.string()), pa.array(np.arange(at, at + len(held))), pa.array(values, pa.string())], ["file", "line_no", "value"])
                        at += len(held)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "file string, line_no long, value string")


def read_fasta(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """``contig, description, seq, length``: upper-cased sequences; a row each, so a contig of up to 2 GB. With a seed,
    ambiguity codes become one of their bases, by contig and place."""
    rows = texts(spark, path, "\n>").where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s", ""))
    out = rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("contig"), head.alias("description"), seq.alias("seq"))
    if seed is not None:
        out = resolved(out, seed)
    return out.withColumn("length", F.length("seq").cast("long"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``file, record_no, name, seq, qual``; a last record that is cut, or lines out of place, are an error.

    The lines of a gzip file come to one task in order, which puts its records together without a shuffle; those of a
    plain file, which many tasks read, are met by their numbers.
    """
    plain, misnamed = _split_paths(spark, path)
    packed = [p for p in plain if p.endswith((".gz", ".bgz"))]
    loose = [p for p in plain if p not in set(packed)]
    parts = []
    if packed:
        parts.append(spark.read.text(packed).select(F.input_file_name().alias("file"), "value").mapInArrow(_records, FASTQ))
    if misnamed:
        parts.append(_inflated(spark, misnamed, "\n").select("file", "value").mapInArrow(_records, FASTQ))
    if loose:
        numbered = _numbered(spark, loose).where("value != '' or line_no % 4 in (1, 3)")
        rows = numbered.withColumn("record_no", F.floor(F.col("line_no") / 4)).withColumn("part", F.col("line_no") % 4)
        pick = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
        out = rows.groupBy("file", "record_no").agg(pick(0).alias("name"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("qual"))
        good = F.startswith(F.col("name"), F.lit("@")) & F.startswith(F.col("plus"), F.lit("+")) & (F.length("seq") == F.length("qual"))
        bad = F.raise_error(F.concat(F.lit("bad FASTQ record "), F.col("record_no").cast("string"))).cast("string")
        parts.append(out.select("file", "record_no", F.when(F.coalesce(good, F.lit(False)), F.substr("name", F.lit(2))).otherwise(bad).alias("name"), "seq", "qual"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


FASTQ = "file string, record_no long, name string, seq string, qual string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``file, value`` in order to FASTQ records; a file's lines follow each other, blank ones may end it."""
    file, rest, number = None, [], 0

    def checked(held: list[str]) -> pa.RecordBatch:
        nonlocal number
        name, seq, plus, qual = held[0::4], held[1::4], held[2::4], held[3::4]
        for i, (n, s, p, q) in enumerate(zip(name, seq, plus, qual, strict=True)):
            if n[:1] != "@" or p[:1] != "+" or len(s) != len(q):
                raise FormatError(f"bad FASTQ record {number + i} of {file}")
        out = pa.record_batch([pa.array([file] * len(name), pa.string()), pa.array(np.arange(number, number + len(name))), pa.array([n[1:] for n in name], pa.string()), pa.array(seq, pa.string()), pa.array(qual, pa.string())], ["file", "record_no", "name", "seq", "qual"])
        number += len(name)
        return out

    def ended() -> Iterator[pa.RecordBatch]:
        while rest and not rest[-1]:
            rest.pop()
        if len(rest) % 4 == 3 and not rest[-2]:  # a read without letters
            rest.append("")
        if len(rest) % 4:
            raise FormatError(f"bad FASTQ record {number + len(rest) // 4} of {file}")
        if rest:
            yield checked(rest)

    for batch in batches:
        names, values = batch.column(0), batch.column(1).to_pylist()
        cuts = [0, *(np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(names)] if len(names) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (name := names[a].as_py()) != file:
                yield from ended()
                file, rest, number = name, [], 0
            rest += values[a:b]
            # some lines are kept back: blank ones at the end are no records
            full = max(0, (len(rest) - 8) // 4 * 4)
            if full and rest[full - 4]:
                yield checked(rest[:full])
                del rest[:full]
    yield from ended()


def write_fastq(reads: DataFrame, path: str, codec: str = "gzip", mode: str = "errorifexists") -> None:
    """Reads ``name, seq, qual`` as text parts, in the rows' order."""
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    reads.select(record.alias("value")).write.mode(mode).option("compression", codec).text(path)


def read_bed(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``contig, st, en, rate, line_no``; the fourth field's mut_rate= is the rate.

    Comments (#), headers (@, track, browser) and blank lines are skipped. A row of fewer than three fields, or of places
    that are no numbers, is an error if strict, else left out.
    """
    rows = lines(spark, path).where(~F.col("value").rlike(r"^(\s*$|#|@|track|browser)"))
    f = F.split("value", "\t")
    st, en = F.get(f, F.lit(1)).try_cast("long"), F.get(f, F.lit(2)).try_cast("long")
    good = st.isNotNull() & en.isNotNull()
    rate = F.regexp_extract(F.coalesce(F.get(f, F.lit(3)), F.lit("")), r"mut_rate=([^;\s]*)", 1).try_cast("double")
    contig = f[0]
    if strict:
        contig = F.when(good, contig).otherwise(F.raise_error(F.concat(F.lit("bad BED row "), F.col("line_no").cast("string"))).cast("string"))
    else:
        rows = rows.where(good)
    return rows.select(contig.alias("contig"), st.alias("st"), en.alias("en"), rate.alias("rate"), "line_no")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``source, canonical``: two fields apart by a tab, else by white space; shorter lines are left out."""
    rows = texts(spark, path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    fields = F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+"))
    return rows.select(fields.alias("f")).where("size(f) >= 2").select(F.trim(F.col("f")[0]).alias("source"), F.trim(F.col("f")[1]).alias("canonical"))


VCF_FIELDS = ("contig", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``contig, pos (zero-based), id, ref, alt, qual, filter, info, format, samples, line_no``."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^(#|\s*$)"))
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    plain = [get(i).alias(n) for i, n in enumerate(VCF_FIELDS) if n != "pos"]
    samples = F.when(F.size(f) > 9, F.slice(f, 10, F.size(f) - 9)).otherwise(F.array().cast("array<string>"))
    return rows.select(plain[0], (get(1).try_cast("long") - 1).alias("pos"), *plain[1:], samples.alias("samples"), "line_no")


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """The lines from the top that begin with #; an error if the column line is missing. Of files in a folder the first by
    name has them; no more than its head is read."""
    found = head(spark, min(files(spark, path), default=path), "#")
    if not any(line.startswith("#CHROM") for line in found):
        raise FormatError(f"{path} has no #CHROM line")
    return found


def head(spark: SparkSession, path: str, mark: str) -> list[str]:
    """The lines from the top of a file that begin with the mark."""
    size = 1 << 16
    while True:
        raw = first_bytes(spark, path, size)
        whole = len(raw) < size
        data = zlib.decompressobj(31).decompress(raw) if raw[:2] == GZIP_MAGIC else raw
        if raw[:2] == GZIP_MAGIC and raw[3:4] == b"\x04":  # BGZF: one member after the other
            data = b"".join(_members(raw))
        rows = data.decode("utf-8", "replace").splitlines()
        if not whole and rows and not data.endswith(b"\n"):
            rows.pop()
        other = next((i for i, r in enumerate(rows) if not r.startswith(mark)), None)
        if other is not None or whole:
            return rows[:other]
        size *= 4


def _members(raw: bytes) -> Iterator[bytes]:
    """What the gzip members of some bytes inflate to; the last may be cut."""
    while raw:
        inflate = zlib.decompressobj(31)
        yield inflate.decompress(raw)
        raw = inflate.unused_data


def contig_accessions(header: list[str]) -> dict[str, str]:
    """Accession to name, of the header's contig lines that have both."""
    import re

    pairs = (re.search(r"^##contig=<.*?\bID=([^,>]+).*?\baccession=\"?([^\",>]+)", line) for line in header)
    return {m[2]: m[1] for m in pairs if m}


def write_vcf(records: DataFrame, path: str, contigs: list[tuple[str, int]], source: str = "strandframe", mode: str = "errorifexists") -> None:
    """VCF text: header parts sort before the records, which are sorted by contig order and place.

    records: ``contig, contig_idx, pos, id, ref, alt, qual, filter, info, format, sample``.
    """
    spark = records.sparkSession
    head = ["##fileformat=VCFv4.1", f"##source={source}", *[f"##contig=<ID={c},length={n}>" for c, n in contigs], '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]
    body = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), *[F.coalesce(c, F.lit(".")) for c in ("id", "ref", "alt", "qual", "filter", "info", "format", "sample")])
    rows = records.select(F.lit(1).alias("k"), F.col("contig_idx").cast("long").alias("c"), "pos", body.alias("value"))
    first = spark.createDataFrame([(0, 0, n, line) for n, line in enumerate(head)], "k int, c long, pos long, value string")
    first.unionByName(rows).orderBy("k", "c", "pos", "value").select("value").write.mode(mode).text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """``name, flag, contig, pos, mapq, cigar, mate_contig, mate_pos, tlen, seq, qual`` (places zero-based, = resolved)."""
    rows = texts(spark, path).where(~F.col("value").rlike(r"^(@[A-Z]{2}\t|\s*$)"))
    f = F.split("value", "\t")
    mate = F.when(f[6] == "=", f[2]).otherwise(f[6])
    return rows.select(f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), mate.alias("mate_contig"), (f[7].cast("long") - 1).alias("mate_pos"), f[8].cast("int").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"))


def sam_line() -> Column:
    mate = F.when(F.col("mate_contig") == F.col("contig"), "=").otherwise(F.col("mate_contig"))
    numbers = {"pos": 1, "mate_pos": 1}
    text = lambda n: (F.col(n) + numbers.get(n, 0)).cast("string")
    return F.concat_ws("\t", "name", text("flag"), "contig", text("pos"), text("mapq"), "cigar", mate, text("mate_pos"), text("tlen"), "seq", "qual")


def write_sam(alignments: DataFrame, path: str, contigs: list[tuple[str, int]], mode: str = "errorifexists") -> None:
    spark = alignments.sparkSession
    head = ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs]]
    order = {c: i for i, (c, _) in enumerate(contigs)}
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("contig")), F.lit(len(order)))
    rows = alignments.select(F.lit(1).alias("k"), place.cast("long").alias("c"), "pos", sam_line().alias("value"))
    first = spark.createDataFrame([(0, 0, n, line) for n, line in enumerate(head)], "k int, c long, pos long, value string")
    first.unionByName(rows).orderBy("k", "c", "pos", "value").select("value").write.mode(mode).text(path)


def write_fasta(contigs: DataFrame, path: str, width: int = 80, mode: str = "errorifexists") -> None:
    from strandframe.functions.sequence import wrapped

    contigs.select(F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")).write.mode(mode).text(path)


def truth_status(records: DataFrame) -> DataFrame:
    """records of two samples with the BD of both: ``truth_bd, query_bd``; rows without BD in FORMAT are left out."""
    keys = F.split("format", ":")
    bd = lambda i: F.try_element_at(F.map_from_arrays(keys, F.slice(F.concat(F.split(F.get("samples", F.lit(i)), ":"), F.array_repeat(F.lit("."), F.size(keys))), F.lit(1), F.size(keys))), F.lit("BD"))
    rows = records.where("size(samples) >= 2").where(F.array_contains(keys, "BD"))
    return rows.withColumns({"truth_bd": F.coalesce(bd(0), F.lit(".")), "query_bd": F.coalesce(bd(1), F.lit("."))})
