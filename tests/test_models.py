import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import compare as C
from strandframe.operators import fragments as G
from strandframe.operators import mutation_model as M
from strandframe.operators import quality_model as P
from strandframe.operators import reads as D
from strandframe.operators import variants as V


def quals(spark, *rows):
    return spark.createDataFrame([(list(r),) for r in rows], "q array<int>")


def test_markov_counts(spark):
    assert sorted(map(tuple, P.initial(quals(spark, [30, 31, 32], [30, 28, 27], [35, 30, 29])).collect())) == [(30, 2), (35, 1)]
    assert sorted(map(tuple, P.by_position(quals(spark, [30, 35, 40], [30, 36, 41])).collect())) == [(0, 30, 2), (1, 35, 1), (1, 36, 1), (2, 40, 1), (2, 41, 1)]
    assert sorted(map(tuple, P.transitions(quals(spark, [30, 31, 32], [30, 31, 33])).collect())) == [(0, 30, 31, 2), (1, 31, 32, 1), (1, 31, 33, 1)]
    assert P.conforming(quals(spark, [30, 31, 32], [30, 31]), 3).count() == 1
    assert P.transitions(quals(spark, [], [1])).count() == 0


def test_bins():
    assert P.prepared_bins([42]) == list(range(43)) and P.prepared_bins([12, 2, 12]) == [2, 12]


def test_cigars(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    indels = lambda *rows: F.array(*[F.struct(F.lit(a).alias("loc"), F.lit(k).alias("kind"), F.lit(n).alias("len")) for a, k, n in rows])
    assert one(D.run_lengths(F.lit("M" * 11 + "I" + "M" * 138))) == "11M1I138M"
    assert one(D.run_lengths(F.lit("M"))) == "1M"
    assert one(D.cigar(150, indels((10, "I", 1)))) == "11M1I138M"
    assert one(D.cigar(150, indels((10, "I", 1), (135, "D", 1)))) == "11M1I125M1D13M"
    assert one(D.cigar(10, indels((9, "I", 3)))) == "10M"


def test_flags(spark):
    rows = [(True, False, 99), (True, True, 147), (False, False, 9), (False, True, 25)]
    df = spark.createDataFrame(rows, "p boolean, r boolean, want int")
    assert df.where(D.flags(True, F.col("p"), F.col("r")) != F.col("want")).count() == 0
    assert {r[0] for r in df.select(D.flags(False, F.col("p"), F.col("r"))).collect()} == {0}


def test_rotation(spark):
    df = spark.createDataFrame([("ABBCBB", "CBBABB"), ("ABBCBBC", "BBCABBC")], "s string, want string")
    assert df.where(S.rotate(F.col("s")) != F.col("want")).count() == 0


def test_kmers_cross_pieces(spark):
    seq = "ACGT" * 700
    got = {(r["pos"], r["kmer"]) for r in S.kmers(spark.createDataFrame([(seq,)], "seq string"), 3).collect()}
    assert got == {(i, seq[i : i + 3]) for i in range(len(seq) - 2)}
    assert S.trinucleotide_counts(spark.createDataFrame([("AC",), ("",), ("NNNACG",)], "seq string")).collect()[0]["tri"] == "ACG"


def test_chunks_guard(spark):
    c = spark.createDataFrame([("c", 1000)], "contig string, length long")
    assert [(r["st"], r["en"], r["own_end"]) for r in S.chunks(c, 600, 200).collect()] == [(0, 600, 400), (400, 1000, 1000)]
    with pytest.raises(ValueError):
        S.chunks(c, 200, 200)


def test_classes_and_matching(spark):
    df = spark.createDataFrame([("A", "T", "SNV"), ("ACG", "A", "DEL"), ("A", "ACC", "INS"), ("AC", "TG", "UNK"), ("A", "A", None)], "ref string, alt string, want string")
    assert df.where(~V.variant_type(F.col("ref"), F.col("alt")).eqNullSafe(F.col("want"))).count() == 0
    contigs = spark.createDataFrame([("chr1", "ACGT" * 5), ("chr2", "TTGG" * 3)], "contig string, seq string")
    v = spark.createDataFrame([("chr1", 0, "A"), ("chr1", 1, "A"), ("chr2", 2, "GG"), ("chr9", 0, "A")], "contig string, pos long, ref string")
    assert sorted((r["contig"], r["pos"]) for r in V.matching_reference(v, contigs).collect()) == [("chr1", 0), ("chr2", 2)]


def test_attribution_and_metrics(spark):
    misses = spark.createDataFrame([("chr1", 499), ("chr2", 99), ("chrZ", 99)], "contig string, pos long")
    contigs = spark.createDataFrame([("chr1",), ("chr2",)], "contig string")
    bed = spark.createDataFrame([("chr1", 0, 1000)], "contig string, st long, en long")
    got = {(r["contig"], tuple(r["reasons"])) for r in C.attributed(misses, contigs, bed).collect()}
    assert got == {("chr1", ("unknown",)), ("chr2", ("outside_mutation_bed",)), ("chrZ", ("outside_simulated_contigs",))}
    rows = C.metrics(spark.createDataFrame([(90, 10, 5), (0, 0, 0), (0, 5, 0)], "tp long, fn long, fp long")).collect()
    assert rows[0]["precision"] == pytest.approx(90 / 95) and rows[0]["recall"] == 0.9
    assert rows[1]["precision"] is None and rows[1]["f1"] is None and rows[2]["recall"] == 0 and rows[2]["precision"] is None


def test_names(spark):
    df = spark.createDataFrame([("chr1", "1"), ("X", "chrX"), ("M", "MT,chrM,chrMT")], "n string, want string")
    assert df.where(F.array_join(C.name_candidates(F.col("n")), ",") != F.col("want")).count() == 0


def test_gc_training(spark):
    seq = "A" * 5000 + "G" * 5000
    contigs = spark.createDataFrame([("c", len(seq), seq)], "contig string, length long, seq string")
    from strandframe.operators.intervals import coverage

    reads = [("c", i, i + 50) for i in range(0, 4900, 490)] + [("c", 5000 + i % 4900, 5050 + i % 4900) for i in range(0, 49000, 245)]
    w = {r["gc_pct"]: r["weight"] for r in G.gc_weights(contigs, coverage(spark.createDataFrame(reads, "contig string, st long, en long")), 50).collect()}
    assert len(w) == 101 and max(w.values()) == 1 and w[100] > w[0]
    weights = spark.range(101).select(F.col("id").cast("int").alias("gc_pct"), F.when(F.col("id") == 100, 1.0).otherwise(0.5).alias("weight"))
    assert 0.7 < G.genome_mean_weight(contigs, weights, 100).first()["mean"] < 0.8


def test_model_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([("c", 8, "ACGTACGT")], "contig string, length long, seq string")
    v = spark.createDataFrame([("c", 1, "C", "T", "SNV"), ("c", 4, "A", "AG", "INS")], "contig string, pos long, ref string, alt string, type string")
    M.save(M.fit(v, contigs), str(tmp_path))
    back = M.load(spark, str(tmp_path))
    assert back["trinucleotides"].count() == 192 and back["rate"].first()["rate"] == 0.25
    assert back["types"].agg(F.sum("p")).first()[0] == 1
