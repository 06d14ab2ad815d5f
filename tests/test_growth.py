"""Figures that must not grow faster than the input: what used to make a row a place or a pair."""

import random
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import intervals as I
from strandframe.operators import mutation_model as M
from strandframe.operators import reads as D
from strandframe.operators import sim_models as Z
from strandframe.operators import simulate as R
from strandframe.operators import synthesis as Y
from strandframe.operators import variants as V
from strandframe.plans import views


def test_lines_under_others_are_counted_without_pairs(spark):
    rnd = random.Random(4)
    rows = [(f"c{rnd.randint(0, 1)}", rnd.randint(0, 9), rnd.choice(["0/1", "1/1", None]), rnd.randint(0, 60), rnd.choice(["DEL", "SNV"]), "ACGT"[: rnd.randint(1, 4)], "A") for _ in range(200)]
    some = spark.createDataFrame(rows, "contig string, pos long, gt string, line_no long, type string, ref string, alt string")
    want = Counter(r["line_no"] for r in V.under(some, "DEL").collect())
    assert {r["line_no"]: r["n"] for r in V.counted_under(some, "DEL").collect()} == want
    # 60,000 records of one place are 3.6e9 pairs
    many = spark.range(60_000).select(F.lit("c").alias("contig"), F.lit(3).cast("long").alias("pos"), F.lit("0/1").alias("gt"), F.col("id").alias("line_no"), F.lit("DEL").alias("type"), F.lit("AC").alias("ref"), F.lit("A").alias("alt"))
    assert [tuple(r) for r in V.counted_under(many, "DEL").groupBy("n").count().collect()] == [(59_999, 60_000)]


def test_places_that_match_by_turns(spark):
    seqs = {"a": "ACGACGTTCG", "b": "C", "c": "", "d": None, "e": "CCGAC"}
    contigs = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    refs = ["A", "cg", "CG"]
    got = sorted(map(tuple, V.matching_places(contigs, refs).collect()))
    assert got == sorted((k, i, refs[i % 3]) for k, s in seqs.items() for i in range(len(s or "")) if s.startswith(refs[i % 3].upper(), i))
    assert "Join" not in V.matching_places(contigs, refs)._jdf.queryExecution().toString()


def test_greatest_bias_is_that_of_all_places(spark):
    contigs = spark.createDataFrame([("a", "ACGTACGA"), ("b", "acgTTT"), ("c", "AAA"), ("d", "AC"), ("e", None), ("f", "CCCC")], "contig string, seq string")
    bias = spark.createDataFrame([("ACG", 0.5), ("CGT", 0.25), ("TTT", 1.0), ("CCC", 0.0)], "tri string, p double")
    want = {r["contig"]: (r["n"], r["top"]) for r in M.local_bias(contigs.where("contig <> 'f'"), bias).groupBy("contig").agg(F.count("*").alias("n"), F.max("p").alias("top")).collect()}
    got = {r["contig"]: (r["places"], r["top"]) for r in M.greatest_bias(contigs, bias).collect()}
    zero = got.pop("f")
    assert got == want and zero[0] == 2 and zero[1] != zero[1]


def test_points_in_spans_are_gathered_without_pairs(spark):
    rnd = random.Random(6)
    spans = [(rnd.randint(0, 80), rnd.choice("ab"), s, s + rnd.choice([0, 5, 16, 17, 200])) for s in (rnd.randint(-20, 300) for _ in range(100))]
    points = [(rnd.choice("ab"), rnd.randint(-30, 400)) for _ in range(300)]
    n, places = Counter(), defaultdict(set)
    for key, k, st, en in spans:
        for c, p in points:
            if c == k and st <= p < en:
                n[key] += 1
                places[key].add(p)
    a, b = spark.createDataFrame(spans, "id long, contig string, st long, en long"), spark.createDataFrame(points, "contig string, pos long")
    got = I.points_in(a, b, "id", bin_width=16).collect()
    assert {r["id"]: (r["n"], r["places"]) for r in got} == {k: (n[k], sorted(places[k])) for k in n} and len(got) == len(n)
    # 20,000 spans over 20,000 points of one place are 4e8 pairs
    rows = spark.range(20_000).select("id", F.lit("c").alias("contig"), F.lit(5).cast("long").alias("st"), F.lit(9).cast("long").alias("en"), F.lit(7).cast("long").alias("pos"))
    assert [tuple(r) for r in I.points_in(rows, rows, "id").groupBy("n", "places").count().collect()] == [(20_000, [7], 20_000)]


def test_first_match_under_many_regions(spark):
    rnd = random.Random(8)
    rs = [(rnd.choice("ab"), s, s + rnd.choice([-1, 0, 3, 90, 700]), n) for n, s in enumerate(rnd.randint(-50, 900) for _ in range(150))]
    points = [(rnd.choice("abc"), rnd.randint(-80, 1600), n) for n in range(300)]
    find = lambda c, p: next(((st, en, n) for k, st, en, n in rs if k == c and st <= p <= en), None)
    a, b = spark.createDataFrame(points, "contig string, pos long, id long"), spark.createDataFrame(rs, "contig string, st long, en long, line_no long")
    got = sorted(tuple(r) for r in I.first_match(a, b, bin_width=64).collect())
    assert got == sorted((c, p, n, *find(c, p)) for c, p, n in points if find(c, p))
    # 30,000 regions over 30,000 points of one place are 9e8 pairs
    many = spark.range(30_000).select(F.lit("c").alias("contig"), F.lit(5).cast("long").alias("st"), F.lit(9).cast("long").alias("en"), F.col("id").alias("line_no"), F.lit(9).cast("long").alias("pos"))
    assert I.first_match(many.select("contig", "pos", "line_no"), many).agg(F.count("*"), F.max("r_line")).first() == (30_000, 0)


def test_windows_of_sequences(spark):
    seqs = [("a", "ACGTNACG"), ("b", "NNN"), ("c", "AC"), ("d", None), ("e", "acgT"), ("f", "A" * 1023 + "CGTA")]
    contigs = spark.createDataFrame(seqs, "contig string, seq string")
    want = S.kmers(contigs, 3, "contig").groupBy("contig").agg(F.count("*").alias("windows"), F.sum(S.trinucleotide_index(F.col("kmer"))).cast("long").alias("index_sum"))
    assert sorted(map(tuple, S.trinucleotide_windows(contigs).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_contigs_are_those_of_the_sql(spark):
    texts = ["Haanth.\nReoush", "\u212a \u0130stanbul \u00df\u01c5", "", None, "123", "xyz" * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").createOrReplaceTempView("documents")
    for name, codes in (("contigs", views.BASES), ("raw_contigs", views.CODES)):
        want = spark.sql(views.VIEWS[name].format(**views.SPARK))
        got = views.contigs_of(spark.table("documents"), codes).select(*want.columns)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_run_lengths_of_long_texts(spark):
    texts = ["", None, "A", "A" * 1000 + "C" * 9 + "G" * 10 + "T", "AACCA", "\u00e9\u00e9x", "AB" * 500]
    want = [x and "".join(f"{len(list(g))}{b}" for b, g in groupby(x)) for x in texts]
    got = D.run_length_texts(spark.createDataFrame(list(enumerate(texts)), "id int, x string"), "x", "runs").orderBy("id").collect()
    assert [r["runs"] for r in got] == want


def test_contexts_move_no_whole_contigs(spark):
    seq = "ACGTACGA" * 700
    contigs = spark.createDataFrame([("a", seq), ("b", "AC")], "contig string, seq string")
    snvs = spark.createDataFrame([("a", 0, "C"), ("a", 2, "T"), ("a", 4096, "G"), ("a", 5599, "A"), ("b", 1, "G")], "contig string, pos long, alt string")
    found = M.contexts(snvs, contigs)
    assert sorted(map(tuple, found.collect())) == sorted((seq[p - 1 : p + 2], seq[p - 1] + b + seq[p + 1]) for p, b in ((2, "T"), (4096, "G")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_reads_stream_by_piece_and_are_those_of_their_segments(spark, monkeypatch):
    rnd = random.Random(9)
    seqs = {c: "".join(rnd.choice(letters) for _ in range(n)) for c, letters, n in (("a", "ACGT", 2000), ("b", "ACGTACGTNR\u00e9", 700), ("c", "ACGT", 130), ("none", "A", 0))}
    contigs = spark.createDataFrame([(c, len(x), x) for c, x in seqs.items()], "contig string, length long, seq string")
    found = []
    for c, x in seqs.items():
        for at in range(3, len(x) - 10, 17):
            ref = x[at : at + rnd.choice([1, 1, 1, 3])]
            found.append((c, at, ref, rnd.choice([ref[0] + "GA", "T", "C"]) if len(ref) == 1 else ref[0], rnd.choice(["0/1", "1|1", "1/0"])))
    found += [("a", 20, seqs["a"][20], "G", "1/1"), ("elsewhere", 5, "A", "C", "1/1")]
    errors = Z.Errors(rate=0.05, types=((R.INSERTION, 0.3), (R.DELETION, 0.3), (R.SNV, 0.4)))
    s = R.Settings(coverage=6, fragment_mean=140, seed=11, errors=errors)
    placed = R.placements(contigs, s)
    others = spark.createDataFrame([("elsewhere", 130, 0, 0, 100, 30, 130), ("a", 2000, 9999, 1950, 2050, 3000, 3100)], placed.schema)
    fragments = placed.unionByName(others)
    variants = spark.createDataFrame(found, "contig string, pos long, ref string, alt string, gt string")
    mates = fragments.select("contig", "read_no", F.explode(F.array(F.struct(F.col("s1").alias("st"), F.lit(False).alias("reverse")), F.struct(F.col("s2").alias("st"), F.lit(True).alias("reverse")))).alias("m"))
    mates = mates.select("contig", "m.st", F.xxhash64(F.lit(11), F.col("contig"), F.col("read_no"), F.col("m.reverse")).alias("key"), F.col("m.reverse").alias("reverse")).collect()
    want = []
    for contig, st, key, reverse in mates:
        if contig in seqs and st <= 2000:
            mine = [{"at": at - st, "ref": ref, "alt": alt, "gt": gt} for c, at, ref, alt, gt in sorted(found) if c == contig and st <= at < st + 100]
            made = Y.build(np.array([key]), [seqs[contig][st : st + 120]], [mine], 100, errors, s.qualities)
            want.append((contig, st, reverse, *(x[0] for x in made)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        # pieces shorter than a read, of about a read, and the usual ones; what a piece has goes over several batches
        for size in (37, 128, R.READ_PIECE):
            monkeypatch.setattr(R, "READ_PIECE", size)
            got = R.reads(contigs, fragments, variants, s).where("pos <= 2000").select("contig", "pos", "reverse", "seq", "qual", "cigar")
            assert sorted(map(tuple, got.collect())) == sorted(want), size
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # no segment is moved, and no fragment made twice
    plan = R.reads(contigs, placed, variants, s)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert plan.count(", start) as binary") == 1


def test_new_variants_move_no_whole_contigs(spark):
    contigs = spark.createDataFrame([("a", 8, "ACGTACGA")], "contig string, length long, seq string")
    plan = R.variants(contigs, R.Settings())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Union" not in plan


def test_names_are_those_of_the_formatter(spark):
    rows = spark.createDataFrame([("a", 0, 99), ("b", -5, 7), ("c", 10**10 - 1, 10**10 - 2), ("d", None, 3), (None, 1, 2)], "contig string, st long, en long")
    got = rows.select(D.name("read", F.col("contig"), F.col("st"), F.col("en")), F.format_string("read_%s_%010d_%010d", "contig", F.col("st") + 1, F.col("en") + 1)).collect()
    assert all(a == b for a, b in got) and got[0][0] == "read_a_0000000001_0000000100"
