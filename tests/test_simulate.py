import re

import numpy as np
from pyspark.sql import functions as F

from strandframe.operators import sim_models as Z
from strandframe.operators import simulate as S
from strandframe.operators import synthesis as Y


def contigs(spark, *rows):
    return spark.createDataFrame([(c, len(s), s) for c, s in rows], "contig string, length long, seq string")


def genome(n, seed=1):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), n))


def spans(cigar):
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MID])", cigar)]
    return sum(n for n, o in ops if o in "MI"), sum(n for n, o in ops if o in "MD")


def test_placements_cover_and_do_not_depend_on_partitions(spark):
    c = contigs(spark, ("a", "A" * 5000), ("short", "ACGT" * 10))
    s = S.Settings(coverage=5, fragment_mean=150, fragment_sd=30, seed=42)
    one = S.placements(c.repartition(1), s)
    rows = one.collect()
    assert len(rows) == 125 and all(r["s1"] >= 0 and r["e2"] <= 5000 and r["e2"] - r["s1"] >= 110 for r in rows)
    assert sorted(rows) == sorted(S.placements(c.repartition(7), s).collect())
    depth = sum(2 * 100 for _ in rows) / 5000
    assert depth >= 0.85 * 5


def test_gc_weights_draw_reads_to_gc(spark):
    c = contigs(spark, ("a", "A" * 3000 + "G" * 3000))
    s = S.Settings(coverage=4, paired=False, gc_weights=tuple([0.1] * 50 + [1.0] * 51), seed=3)
    rows = S.placements(c, s).collect()
    assert 200 <= len(rows) <= 280
    assert sum(r["s1"] >= 2900 for r in rows) > 0.8 * len(rows)


def test_all_wanted_fragments_are_placed(spark):
    c = contigs(spark, ("a", "ACGT" * 27 + "AC"), ("b", "ACGT" * 28), ("c", "ACGT" * 50), ("d", "ACGT" * 27))
    for weights in ((), tuple([1.0] * 101)):
        s = S.Settings(coverage=200, fragment_mean=105, fragment_sd=10, seed=4, gc_weights=weights)
        rows = S.placements(c, s).collect()
        found = {k: sum(r["contig"] == k for r in rows) for k in "abcd"}
        assert found == {"a": 110, "b": 112, "c": 200, "d": 0}, (weights, found)
        assert all(0 <= r["s1"] and r["e1"] <= r["e2"] <= r["length"] and r["e2"] - r["s1"] >= 110 for r in rows)
        assert {r["s1"] for r in rows if r["contig"] == "b"} == {0, 1, 2}


def test_variants_match_the_reference_and_stand_apart(spark):
    seq = genome(20000)
    c = contigs(spark, ("a", seq), ("n", "N" * 3000))
    v = S.variants(c, S.Settings(mutations=Z.Mutations(rate=0.01), seed=5)).orderBy("pos").collect()
    assert 120 < len(v) < 280
    end = -1
    for r in v:
        assert r["contig"] == "a" and seq[r["pos"] : r["pos"] + len(r["ref"])] == r["ref"] and r["ref"] != r["alt"] and r["pos"] >= end
        end = r["pos"] + len(r["ref"])
        assert r["gt"] in ("0/1", "1/0", "1/1")
    assert {r["type"] for r in v} == {"SNV", "INS", "DEL"}
    assert v == S.variants(c.repartition(5), S.Settings(mutations=Z.Mutations(rate=0.01), seed=5)).orderBy("pos").collect()


def test_mutation_regions_set_the_rate(spark):
    c = contigs(spark, ("a", genome(20000)))
    regions = spark.createDataFrame([("a", 0, 10000, 0.02, 1)], "contig string, st long, en long, rate double, line_no long")
    v = S.variants(c, S.Settings(mutations=Z.Mutations(rate=0.0), seed=5), regions).collect()
    assert 120 < len(v) < 280 and max(r["pos"] for r in v) < 10000


def test_targets_and_discards(spark):
    c = contigs(spark, ("a", genome(5000)))
    f = S.placements(c, S.Settings(coverage=3, seed=1))
    r = spark.createDataFrame([("a", 1000, 1200)], "contig string, st long, en long")
    kept, rest = S.restricted(f, target=r).collect(), S.restricted(f, discard=r).collect()
    hit = lambda x: (x["s1"] < 1200 and 1000 < x["e1"]) or (x["s2"] < 1200 and 1000 < x["e2"])
    assert kept and all(map(hit, kept)) and not any(map(hit, rest)) and len(kept) + len(rest) == f.count()


def test_reads_are_consistent(spark):
    seq = genome(8000, 2)
    c = contigs(spark, ("a", seq))
    s = S.Settings(coverage=6, seed=9, mutations=Z.Mutations(rate=0.01, homozygous=1.0), errors=Z.Errors(rate=0.0))
    v = S.variants(c, s)
    a = S.reads(c, S.placements(c, s), v, s).collect()
    snvs = {r["pos"]: r["alt"] for r in v.collect() if r["type"] == "SNV"}
    assert len(a) == 2 * 240
    seen = 0
    for r in a:
        q, ref = spans(r["cigar"])
        assert q == len(r["seq"]) == len(r["qual"]) == 100
        if r["cigar"] == "100M":
            for i, b in enumerate(r["seq"]):
                if b != seq[r["pos"] + i]:
                    assert snvs[r["pos"] + i] == b
                    seen += 1
    assert seen > 100
    assert {r["flag"] for r in a} == {99, 147}
    fq = S.fastq(S.reads(c, S.placements(c, s), v, s), True)
    assert fq.count() == 240 and fq.where(F.length("seq") != F.length("qual")).count() == 0


def keys(n, seed=0):
    return np.random.default_rng(seed).integers(0, 2**63, n)


def test_errors_lower_qualities_and_keep_cigars():
    errors = Z.Errors(rate=0.05, types=((S.INSERTION, 0.3), (S.DELETION, 0.3), (S.SNV, 0.4)))
    segments = [genome(120, i) for i in range(400)]
    seqs, quals, cigars = Y.build(keys(400), segments, [None] * 400, 100, errors, Z.Qualities())
    kinds = set()
    for segment, seq, qual, cigar in zip(segments, seqs, quals, cigars, strict=True):
        q, ref = spans(cigar)
        assert len(seq) == len(qual) == q == 100 and ref <= 120
        kinds |= set(re.findall("[MID]", cigar))
        at, i = 0, 0
        for n, op in re.findall(r"(\d+)([MID])", cigar):
            n = int(n)
            for k in range(n if op == "M" else 0):
                assert seq[i + k] == segment[at + k] or qual[i + k] == "\""  # quality 1
            assert op != "I" or qual[i : i + n] == "\"" * n
            at, i = at + n * (op in "MD"), i + n * (op in "MI")
    assert kinds == {"M", "I", "D"}


def test_errors_are_as_many_as_the_rate_gives():
    q = Y.draw_qualities(keys(3000), 100, Z.Qualities())
    row, place = Y.error_places(keys(3000), q, 0.013)
    assert 1.1 < len(row) / 3000 <= 1.3 and place.min() >= 0 and place.max() < 100
    uniform = Y.draw_qualities(keys(10), 100, Z.Qualities(uniform=0.01))
    assert (uniform == 20).all() and len(Y.error_places(keys(10), uniform, 0.02)[0]) > 10
    seqs, quals, cigars = Y.build(keys(5), ["ACGT" * 30] * 5, [None] * 5, 100, Z.Errors(rate=0.0), Z.Qualities())
    assert seqs == ["ACGT" * 25] * 5 and cigars == ["100M"] * 5


def test_batches_change_nothing():
    segments, k = [genome(120, i) for i in range(50)], keys(50)
    found = [[{"at": 5, "ref": s[5], "alt": "T" if s[5] != "T" else "A", "gt": "0/1"}, {"at": 20, "ref": s[20:23], "alt": s[20], "gt": "1/1"}] if i % 3 == 0 else None for i, s in enumerate(segments)]
    whole = Y.build(k, segments, found, 100, Z.Errors(rate=0.03), Z.Qualities())
    single = [Y.build(k[i : i + 1], segments[i : i + 1], found[i : i + 1], 100, Z.Errors(rate=0.03), Z.Qualities()) for i in range(50)]
    assert [x[0][0] for x in single] == whole[0] and [x[1][0] for x in single] == whole[1] and [x[2][0] for x in single] == whole[2]
    assert all("2D" in c for i, c in enumerate(whole[2]) if i % 3 == 0)


def test_letters_that_are_no_base_are_masked():
    seqs, quals, _ = Y.build(keys(1), ["ACGTN" * 24], [None], 100, Z.Errors(rate=0.0), Z.Qualities())
    assert set(seqs[0]) <= set("ACGT") and all(quals[0][i] == "\"" for i in range(4, 100, 5))


def test_qualities_by_model():
    q = Y.draw_qualities(keys(4000), 50, Z.Qualities((30.0, 20.0), (0.5, 2.0)))
    assert abs(q[:, :25].mean() - 30) < 0.1 and abs(q[:, 25:].mean() - 20) < 0.1 and abs(q[:, 40].std() - 2) < 0.2
    binned = Y.draw_qualities(keys(400), 50, Z.Qualities((30.0, 20.0), (0.5, 2.0), (2, 12, 23, 37)))
    assert set(np.unique(binned)) <= {2, 12, 23, 37}


def test_markov_qualities():
    chain = Z.MarkovQualities(((30, 1.0),), (((30, 1.0),), ((35, 1.0),), ((40, 1.0),)), (((30, ((33, 1.0),)),), ()))
    assert Y.draw_qualities(keys(4), 3, chain).tolist() == [[30, 33, 40]] * 4
    two = Z.MarkovQualities(((10, 0.5), (20, 0.5)), (((10, 0.5), (20, 0.5)),) * 2, (((10, ((20, 0.9), (10, 0.1))), (20, ((10, 1.0),))),))
    q = Y.draw_qualities(keys(5000), 2, two)
    assert abs((q[q[:, 0] == 10, 1] == 20).mean() - 0.9) < 0.03 and (q[q[:, 0] == 20, 1] == 10).all()


def test_models_bend_variants(spark):
    c = contigs(spark, ("a", genome(60000)))
    only_c = Z.Mutations(rate=0.01, types=((S.SNV, 1.0),), alleles=tuple((t, t[0] + "G" + t[2], 1.0) for t in Z.TRINUCLEOTIDES if t[1] == "C"), bias=tuple((t, float(t[1] == "C" and t[2] == "G")) for t in Z.TRINUCLEOTIDES))
    v = S.variants(c, S.Settings(seed=5, mutations=only_c)).collect()
    seq = genome(60000)
    assert len(v) > 300 and all(r["ref"] == "C" and r["alt"] == "G" and seq[r["pos"] + 1] == "G" for r in v)
    plain = S.variants(c, S.Settings(seed=5, mutations=Z.Mutations(rate=0.01))).collect()
    snvs = [r for r in plain if r["type"] == "SNV"]
    assert abs(np.mean([Z.PARTNER[r["ref"]] == r["alt"] for r in snvs]) - 0.7) < 0.08
    assert {len(r["ref"]) - 1 for r in S.variants(c, S.Settings(seed=5, mutations=Z.Mutations(rate=0.01, types=((S.DELETION, 1.0),)))).collect()} == {1, 2, 3, 4, 5}


def test_numbers_of_variants_are_bounded(spark):
    c = contigs(spark, *((f"c{i}", genome(1200, i)) for i in range(40)))
    n = {r["contig"]: r["count"] for r in S.variants(c, S.Settings(seed=1, mutations=Z.Mutations(rate=0.001, types=((S.SNV, 1.0),)))).groupBy("contig").count().collect()}
    assert n and max(n.values()) <= 2
    areas = spark.createDataFrame([("a", 0, 100, 0.0001), ("a", 100, 200, 0.0001), ("b", 0, 100, 0.05)], "contig string, st long, en long, rate double")
    got = {(r["contig"], r["st"]): r["n"] for r in S.candidate_counts(areas, S.Settings(seed=2, min_mutations=3)).collect()}
    assert got["a", 0] + got["a", 100] == 3 and 3 <= got["b", 0] <= 10
