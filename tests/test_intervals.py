import random

from pyspark.sql import functions as F

from strandframe.operators import intervals as I


def regions(spark, *rows):
    return spark.createDataFrame([("c", a, b, float(r), n) for n, (a, b, r) in enumerate(rows)], "contig string, st long, en long, rate double, line_no long")


def lengths(spark, n=1000):
    return spark.createDataFrame([("c", n)], "contig string, length long")


def spans(df):
    return [(r["st"], r["en"], r["rate"]) for r in df.orderBy("st").collect()]


def test_clip(spark):
    got = spans(I.clip(regions(spark, (3, 9, 0.5), (12, 40, 0.25), (40, 41, 0.125), (77, 78, 1)), 7, 40))
    assert got == [(7, 9, 0.5), (12, 40, 0.25)]


def test_covering(spark):
    rs = regions(spark, (3, 9, 0.5), (12, 30, 0.25))
    assert spans(I.covering(rs, 7, 40, 0.75)) == [(7, 9, 0.5), (12, 30, 0.25), (30, 40, 0.75)]
    assert spans(I.covering(rs, 50, 60, 0.75)) == [(50, 60, 0.75)] and spans(I.covering(rs, 4, 8, 0.75)) == [(4, 8, 0.5)]


def by_hand(rs, length, default):
    at, out = 0, []
    for a, b, r in rs:
        if a < at:
            continue
        out += [(at, a, default)] * (a > at) + [(a, b, float(r))]
        at = b
    return out + [(at, length, default)] * (at < length)


def test_fill_gaps(spark):
    rnd = random.Random(3)
    for n in range(6):
        rs = [(a, a + rnd.randint(1, 90), round(rnd.random(), 3)) for a in (rnd.randint(0, 700) for _ in range(n * 5))]
        assert spans(I.fill_gaps(regions(spark, *rs) if rs else regions(spark, (0, 1, 0)).limit(0), lengths(spark, 790), 0.07)) == by_hand(rs, 790, 0.07)


def test_recalibrated(spark):
    rs = regions(spark, (10, 20, 0.5), (30, 45, 0.25)).withColumn("rate", F.when(F.col("st") > 20, F.col("rate")))
    assert spans(I.recalibrated(rs, 15, 40, 0.125)) == [(15, 20, 0.125), (20, 30, 0.125), (30, 40, 0.25)]


def test_overlaps_by_shared_places(spark):
    ends = [(a, b) for a in range(6) for b in range(a, 7)]
    pairs = [(a, b, c, d, bool(set(range(a, b)) & set(range(c, d)))) for a, b in ends for c, d in ends if b > a and d > c]
    df = spark.createDataFrame(pairs, "a long, b long, c long, d long, want boolean")
    assert df.where(I.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("want")).count() == 0


def test_filters_and_joins_by_bins(spark):
    rnd = random.Random(9)
    make = lambda n: [(rnd.choice("ab"), s, s + rnd.randint(1, 300)) for s in (rnd.randint(0, 4000) for _ in range(n))]
    left, right = make(150), make(25)
    left += left[:5]
    a = spark.createDataFrame([(*x, i) for i, x in enumerate(left)], "contig string, st long, en long, id long")
    b = spark.createDataFrame(right, "contig string, st long, en long")
    hit = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    want = {i for i, x in enumerate(left) if any(hit(x, y) for y in right)}
    for keep in (True, False):
        got = [r["id"] for r in I.interval_filter(a, b, keep, bin_width=64).collect()]
        assert sorted(got) == sorted(i for i in range(len(left)) if (i in want) == keep)
    both = I.overlap_join(a, b.withColumnsRenamed({"st": "r_st", "en": "r_en"}), bin_width=64).select("id", "r_st", "r_en").collect()
    assert sorted(map(tuple, both)) == sorted((i, y[1], y[2]) for i, x in enumerate(left) for y in right if hit(x, y))


def test_first_match_has_both_ends(spark):
    points = spark.createDataFrame([("c", p) for p in (4, 5, 9, 10, 11)], "contig string, pos long")
    rs = regions(spark, (5, 10, 1), (10, 12, 1))
    assert {(r["pos"], r["r_line"]) for r in I.first_match(points, rs).collect()} == {(5, 0), (9, 0), (10, 0), (11, 1)}


def test_bins_change_nothing(spark):
    points = spark.range(3000).select(F.lit("c").alias("contig"), "id", (F.col("id") * 7 % 5000).alias("pos"))
    rs = spark.range(80).select(F.lit("c").alias("contig"), (F.col("id") * 61 % 4800).alias("st"), (F.col("id") * 61 % 4800 + F.col("id") * 3).alias("en"))
    for how in ("inner", "left_semi", "left_anti"):
        a, b = I.point_join(points, rs, how, bin_width=1 << 40), I.point_join(points, rs, how, bin_width=64)
        assert sorted(map(tuple, a.select("id").collect())) == sorted(map(tuple, b.select("id").collect()))


def test_coverage(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 3, 8), ("c", 3, 8)], "contig string, st long, en long")
    for width in (1, 4, 1 << 20):
        assert [(r["pos"], r["depth"]) for r in I.coverage(df, width).orderBy("pos").collect()] == [(0, 1), (3, 3), (5, 2), (8, 0)]


def test_block_bounds(spark):
    df = spark.createDataFrame([(10,), (50,), (100,), (200,)], "pos long")
    assert [r[0] for r in df.where(I.in_block(F.col("pos"), 50, 200)).collect()] == [50, 100]
