import random
import re

from pyspark.sql import functions as F

from strandframe.functions import sequence as Q
from strandframe.functions.randomness import normal_quantile
from strandframe.operators import mutation_model as M
from strandframe.operators import reads as R
from strandframe.operators import variants as V
from strandframe.sources import bam


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_alignments_have_the_fewest_edits(spark):
    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("AC") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("ACG") for _ in range(rnd.randint(0, 9)))) for _ in range(150)] + [(None, "A")]
    rows = R.aligned_cigars(spark.createDataFrame(pairs, "template string, query string").repartition(3)).collect()
    assert len(rows) == 151 and [r["cigar"] for r in rows if r["template"] is None] == [None]
    for r in rows:
        if r["template"] is None:
            continue
        at = i = cost = 0
        for n, op in re.findall(r"(\d+)([MID])", r["cigar"]):
            n = int(n)
            cost += n if op != "M" else sum(x != y for x, y in zip(r["template"][at : at + n], r["query"][i : i + n], strict=True))
            at, i = at + n * (op != "I"), i + n * (op != "D")
        assert (at, i, cost) == (len(r["template"]), len(r["query"]), edits(r["template"], r["query"]))
    assert R.global_alignment("ACGTACGT", "ACGTCGT") == "4M1D3M"


def test_free_copies(spark):
    df = spark.createDataFrame([([0, 1, 0],), ([1, 1, 1],), ([1, 0, 1],)], "g array<int>")
    got = [r[0] for r in df.select(V.free_copy(F.col("g"), F.lit(0.9))).collect()]
    assert got == ["0/0/1", None, "0/1/0"]


def test_sides_and_insides(spark):
    df = spark.range(12).select(F.col("id").alias("p"))
    col = lambda c: [r["p"] for r in df.where(c).collect()]
    assert col(V.contains(F.lit(4), F.lit(3), F.col("p"))) == [4, 5, 6]
    assert col(V.five_prime(F.lit(4), F.col("p"))) == [0, 1, 2, 3] and col(V.five_prime(F.lit(4), F.col("p"), True)) == [0, 1, 2, 3, 4]
    assert col(V.three_prime(F.lit(4), F.lit(3), F.col("p"))) == [8, 9, 10, 11] and col(V.three_prime(F.lit(4), F.lit(3), F.col("p"), True)) == [7, 8, 9, 10, 11]
    assert col(V.deletion_contains(F.lit(4), F.lit(3), F.col("p"), F.lit("0/1"), F.lit("1/1"))) == []


def test_counts_are_kept(spark, tmp_path):
    contigs = spark.createDataFrame([("a", "ACGTACGT")], "contig string, seq string")
    first = sorted(map(tuple, Q.kept_trinucleotide_counts(contigs, f"{tmp_path}/n").collect()))
    again = sorted(map(tuple, Q.kept_trinucleotide_counts(contigs.where("false"), f"{tmp_path}/n").collect()))
    assert first == again == [("ACG", 2), ("CGT", 2), ("GTA", 1), ("TAC", 1)]


def test_chunk_size_is_within_bounds():
    assert [Q.chunk_size(t, 4) for t in (10, 32_000_000, 10**12)] == [100_000, 1_000_000, 50_000_000]


def test_letters_cut_from_pieces(spark):
    rnd = random.Random(2)
    seqs = {c: "".join(rnd.choice("ACGT") for _ in range(n)) for c, n in (("a", 9000), ("b", 5), ("c", 4096))}
    contigs = spark.createDataFrame([(c, s, len(s)) for c, s in seqs.items()], "contig string, seq string, length long")
    rows = [(rnd.choice("abcd"), rnd.randint(0, 9100), rnd.choice([1, 3, 40, 300, 6000])) for _ in range(200)]
    df = spark.createDataFrame(rows, "contig string, p long, n int")
    got = sorted((r["contig"], r["p"], r["n"], r["x"]) for r in Q.bases_at(df, contigs, F.col("p"), F.col("n"), "x").collect() if r["x"])
    want = sorted((c, p, n, seqs[c][p : p + n]) for c, p, n in rows if c in seqs and seqs[c][p : p + n])
    assert got == want


def test_region_sequences_have_each_trinucleotide_once(spark):
    rnd = random.Random(3)
    seq = "".join(rnd.choice("ACGT") for _ in range(5000))
    contigs = spark.createDataFrame([("a", seq, 5000)], "contig string, seq string, length long")
    regions = spark.createDataFrame([("a", 10, 2500), ("a", 4990, 6000), ("b", 0, 9), ("a", 20, 21)], "contig string, st long, en long")
    got = {r["tri"]: r["n"] for r in Q.trinucleotide_counts(M.region_sequences(contigs, regions, 256)).collect()}
    want = {}
    for a, b in ((10, 2501), (4990, 5000), (20, 22)):
        for i in range(a, b - 2):
            want[seq[i : i + 3]] = want.get(seq[i : i + 3], 0) + 1
    assert got == want


def test_spans_by_cigar(spark):
    rows = [(0, "c", 5, "3S10M2I4M1D6N2M5H"), (4, "c", 5, "10M"), (0, "*", 5, "10M"), (16, "c", 7, "*"), (0, None, 1, "5M")]
    got = bam.spans(spark.createDataFrame(rows, "flag int, contig string, pos long, cigar string")).collect()
    assert [tuple(r) for r in got] == [("c", 5, 28)]


def test_normal_quantile(spark):
    points = [(0.5, 0.0), (0.975, 1.959963985), (0.02, -2.053748911), (0.999999, 4.753424309), (1e-9, -5.997807015)]
    df = spark.createDataFrame(points, "u double, want double")
    assert df.where(F.abs(normal_quantile(F.col("u")) - F.col("want")) > 1e-6).count() == 0
