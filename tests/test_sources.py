import gzip
import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandframe.session import first_bytes
from strandframe.sources import bam
from strandframe.sources import text as T


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first > one\nacgt\nAC\n\n>c2\nNNR\n")
    rows = [tuple(r) for r in T.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("contig").collect()]
    assert rows == [("c1", "c1 first > one", "ACGTAC", 6), ("c2", "c2", "NNR", 3)]
    T.write_fasta(T.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "b"), 4)
    assert {r["seq"] for r in T.read_fasta(spark, str(tmp_path / "b")).collect()} == {"ACGTAC", "NNR"}


def test_lines_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = T.lines(spark, str(tmp_path / "a.txt"))
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gzip_by_magic(spark, tmp_path):
    with gzip.open(tmp_path / "plain.txt", "wt") as f:
        f.write("a\nb\n")
    assert [tuple(r) for r in T.lines(spark, str(tmp_path / "plain.txt")).select("line_no", "value").orderBy("line_no").collect()] == [(0, "a"), (1, "b")]


def test_fastq_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([("r1", "ACGT", "@+AB"), ("r2", "GG", "!~")], "name string, seq string, qual string")
    T.write_fastq(reads, str(tmp_path / "q"))
    back = T.read_fastq(spark, str(tmp_path / "q")).select("name", "seq", "qual")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, reads.collect()))
    (tmp_path / "bad.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="bad FASTQ record 0"):
        T.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# c\ntrack x\nbrowser y\n\nchr1\t0\t10\tmut_rate=0.5;x\nchr2\t5\t9\nchr3\t1\nchr4\tNaN\t3\n")
    rows = [(r["contig"], r["st"], r["en"], r["rate"]) for r in T.read_bed(spark, str(tmp_path / "a.bed"), strict=False).orderBy("line_no").collect()]
    assert rows == [("chr1", 0, 10, 0.5), ("chr2", 5, 9, None)]
    with pytest.raises(Exception, match="bad BED row"):
        T.read_bed(spark, str(tmp_path / "a.bed")).collect()


def test_vcf_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("c2", 1, 4, "A", "T"), ("c1", 0, 9, "AC", "A"), ("c1", 0, 2, "G", "GT")], "contig string, contig_idx int, pos long, ref string, alt string")
    records = records.selectExpr("*", "cast(null as string) id", "'42' qual", "'PASS' filter", "'.' info", "'GT' format", "'0/1' sample")
    T.write_vcf(records, str(tmp_path / "v"), [("c1", 20), ("c2", 12)])
    parts = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    assert parts[0] == "##fileformat=VCFv4.1" and [p.split("\t")[:2] for p in parts if p[0] != "#"] == [["c1", "3"], ["c1", "10"], ["c2", "5"]]
    back = T.read_vcf(spark, str(tmp_path / "v"))
    assert sorted((r["contig"], r["pos"], r["ref"], r["alt"], r["samples"][0]) for r in back.collect()) == [("c1", 2, "G", "GT", "0/1"), ("c1", 9, "AC", "A", "0/1"), ("c2", 4, "A", "T", "0/1")]
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.2\n##contig=<ID=c1,accession=\"NC_1\">\n#CHROM\tPOS\n")
    assert T.contig_accessions(T.vcf_header(spark, str(tmp_path / "x.vcf"))) == {"NC_1": "c1"}


def test_truth_status(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT\tQ\n"
    row = "c\t{}\t.\tA\tT\t.\t.\t.\tGT:BD\t0/1:{}\t0/1:{}\n"
    (tmp_path / "h.vcf").write_text(head + row.format(100, "TP", "TP") + row.format(200, "FN", ".") + row.format(300, ".", "FP") + row.format(400, ".", "."))
    from strandframe.operators.variants import bucket

    rows = T.truth_status(T.read_vcf(spark, str(tmp_path / "h.vcf"))).withColumn("b", bucket(F.col("truth_bd"), F.col("query_bd"))).orderBy("pos").collect()
    assert [r["b"] for r in rows] == ["TP", "FN", "FP", None]


ALIGNMENTS = [("r1", 99, "c1", 3, 70, "4M", "c1", 9, 10, "ACGT", "IIII"), ("r2", 0, "c2", 0, 60, "2M1I2M", None, None, 0, "ACGTN", "!IIII"), ("r0", 147, "c1", 9, 70, "4M", "c1", 3, -10, "GGCC", "FFFF")]


def test_bam_and_sam_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(ALIGNMENTS, bam.COLUMNS)
    contigs = [("c1", 100), ("c2", 50)]
    made = bam.write_bam(rows, f"file://{tmp_path}/bam", contigs).collect()
    assert sum(r["records"] for r in made) == 3
    back = bam.read_bam(spark, str(tmp_path / "bam"))
    assert sorted(map(tuple, back.collect())) == sorted(ALIGNMENTS)
    data = sorted((tmp_path / "bam").glob("*.bam"))[0].read_bytes()
    assert data.endswith(bam.END_OF_FILE) and gzip.decompress(data)[:4] == b"BAM\1"
    paired = rows.where("mate_contig is not null")
    T.write_sam(paired, str(tmp_path / "s"), contigs)
    assert sorted(map(tuple, T.read_sam(spark, str(tmp_path / "s")).collect())) == sorted(a for a in ALIGNMENTS if a[6])


def test_names(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("1\tchr1\nX chrX\nlone\n# c\n")
    assert sorted(map(tuple, T.read_names(spark, str(tmp_path / "n.tsv")).collect())) == [("1", "chr1"), ("X", "chrX")]


def test_the_first_bytes_of_a_very_long_file(spark, tmp_path):
    """2.2 GB of holes after one line: no more than its first bytes is read to tell what it is."""
    path = tmp_path / "long.bed"
    with open(path, "wb") as f:
        f.write(b"c\t1\t2\n")
        f.truncate(2_200_000_000)
    assert not T.is_compressed(spark, str(path))
    assert first_bytes(spark, str(path), 5) == b"c\t1\t2" and first_bytes(spark, str(path), 0) == b""


def test_gzip_under_other_names_in_all_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a").write_bytes(gzip.compress(text.encode()))
        (tmp_path / name / "b").write_text(text)
        return str(tmp_path / name)

    assert sorted(r["contig"] for r in T.read_fasta(spark, put("fa", ">x d\nAC\nGT\n>y\nNN\n")).collect()) == ["x", "x", "y", "y"]
    assert T.read_sam(spark, put("sam", "r\t0\tc\t5\t60\t4M\t=\t9\t0\tACGT\tFFFF\n")).count() == 2
    assert T.read_names(spark, put("names", "a\tb\r\n")).distinct().collect() == [("a", "b")]
    assert T.read_bed(spark, put("bed", "c\t1\t2\nc\t3\t4\n")).groupBy("line_no").count().orderBy("line_no").collect() == [(0, 2), (1, 2)]
    with pytest.raises(T.FormatError):
        T.lines(spark, str(tmp_path / "nothing"))


def test_ambiguity_codes_are_resolved_on_reading(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">x\nACRYNACGTSWKMBDHV\n")
    one, two = (T.read_fasta(spark, str(tmp_path / "x.fa"), 7).first()["seq"] for _ in range(2))
    assert one == two and len(one) == 17 and set(one) <= set("ACGTN") and one[:2] == "AC" and one[4] == "N"


def test_bgzf_text_is_gzip(spark, tmp_path):
    rows = spark.createDataFrame([(f"line {i} " + "x" * 50,) for i in range(5000)], "value string").coalesce(1)
    made = bam.write_bgzf(rows, f"file://{tmp_path}/z", "head\n").collect()
    data = open(made[0]["path"], "rb").read()
    assert gzip.decompress(data).decode().split("\n")[:2] == ["head", "line 0 " + "x" * 50] and data.endswith(bam.END_OF_FILE)
    assert T.texts(spark, f"file://{tmp_path}/z").count() == 5001


def test_bam_index_leads_to_the_records(spark, tmp_path):
    rows = [(f"r{i}", 0, "c1" if i < 3000 else "c2", i * 37 % 90_000, 60, "50M", None, None, 0, "ACGTN" * 10, "F" * 50) for i in range(4000)]
    made = bam.write_bam(spark.createDataFrame(rows, bam.COLUMNS).coalesce(1), f"file://{tmp_path}/bam", [("c1", 90_100), ("c2", 90_100)]).collect()
    seen = 0
    for part in made:
        data, index = open(part["path"], "rb").read(), open(part["path"] + ".bai", "rb").read()
        assert index[:4] == b"BAI\1"
        at = 8
        for contig in ("c1", "c2"):
            (n,), at = struct.unpack_from("<i", index, at), at + 4
            for _ in range(n):
                (number, chunks), at = struct.unpack_from("<Ii", index, at), at + 8
                for _ in range(chunks):
                    (a, b), at = struct.unpack_from("<QQ", index, at), at + 16
                    raw = bam.inflated(data[a >> 16 :])[a & 0xFFFF :]
                    (size,) = struct.unpack_from("<i", raw)
                    ref, pos = struct.unpack_from("<ii", raw, 4)
                    assert ("c1", "c2")[ref] == contig and bam.bin_of(pos, pos + 50) == number and a < b
                    seen += 1
            (n,), at = struct.unpack_from("<i", index, at), at + 4
            at += 8 * n
        assert at == len(index)
    assert seen >= 10
    assert sorted(map(tuple, bam.read_bam(spark, f"file://{tmp_path}/bam").collect())) == sorted((*r[:6], None, None, *r[8:]) for r in rows)


def test_the_head_of_a_file_is_all_that_a_header_takes(spark, tmp_path):
    top = [f"##contig=<ID=c{i},accession=\"a{i}\">" for i in range(5000)] + ["#CHROM\tPOS"]
    text = "\n".join([*top, *(f"c1\t{i}\t.\tA\tC" for i in range(20_000))]) + "\n"
    (tmp_path / "plain.vcf").write_text(text)
    (tmp_path / "packed.vcf").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "blocks.vcf.gz").write_bytes(b"".join(bam.bgzf_block(text.encode()[i : i + 60_000]) for i in range(0, len(text), 60_000)) + bam.END_OF_FILE)
    for name in ("plain.vcf", "packed.vcf", "blocks.vcf.gz"):
        assert T.vcf_header(spark, str(tmp_path / name)) == top, name
    assert T.contig_accessions(top)["a7"] == "c7"
    (tmp_path / "none.vcf").write_text("c1\t5\n")
    with pytest.raises(T.FormatError):
        T.vcf_header(spark, str(tmp_path / "none.vcf"))


def test_fastq_of_all_kinds_of_files(spark, tmp_path):
    rnd = random.Random(4)
    reads = [(f"r{i}", "".join(rnd.choice("ACGT") for _ in range(n)), "".join(rnd.choice("@+IJ") for _ in range(n))) for i, n in enumerate([*(rnd.randint(1, 40) for _ in range(25_000)), 0])]
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.fq.gz").write_bytes(gzip.compress((text + "\n\n").encode()))
    (tmp_path / "a/y.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "a/z.fq").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "a/w.fq").write_text(text)
    found = T.read_fastq(spark, str(tmp_path / "a")).collect()
    want = [(i, *r) for i, r in enumerate(reads)]
    for name in ("x.fq.gz", "y.fq.gz", "z.fq", "w.fq"):
        assert sorted((r["record_no"], r["name"], r["seq"], r["qual"]) for r in found if r["file"].endswith(name)) == want, name
    for cut in (text[:-30], text.replace("\n+\n", "\n-\n", 1), text.replace("@r7\n", "r7\n")):
        (tmp_path / "bad.fq.gz").write_bytes(gzip.compress(cut.encode()))
        with pytest.raises(Exception, match="bad FASTQ record"):
            T.read_fastq(spark, str(tmp_path / "bad.fq.gz")).collect()


def test_a_cut_bam_is_an_error():
    data = bam.bgzf_block(bam.header([("c", 9)]) + b"\1\2\3")
    with pytest.raises(ValueError, match="cut"):
        list(bam.unpacked(io.BytesIO(data).read))
    with pytest.raises(ValueError, match="cut"):
        list(bam.unpacked(io.BytesIO(data[:-20]).read))
    with pytest.raises(ValueError, match="no BAM"):
        list(bam.unpacked(io.BytesIO(bam.bgzf_block(b"SAM file of some kind")).read))
    assert list(bam.unpacked(io.BytesIO(bam.bgzf_block(bam.header([("c", 9)])) + bam.END_OF_FILE).read)) == []
