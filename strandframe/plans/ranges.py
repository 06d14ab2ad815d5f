"""Queries on intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import intervals as I
from strandframe.operators import variants as V
from strandframe.plans.views import view, with_views

Q: dict = {}
O: dict[str, str] = {}


def _add(name, sources, make, sql):
    sources = sources.split()
    Q[name] = lambda spark, d: make(*[view(spark, d, s) for s in sources])
    O[name] = with_views("", *sources).rstrip() + sql if sql.startswith(",") else with_views(sql, *sources)


def _reads(a):
    return a.select("event_id", "contig", F.col("pos").alias("st"), (F.col("pos") + F.col("span")).alias("en"))


_R = "(SELECT event_id, contig, pos AS st, pos + span AS en FROM alignments)"
_add("f1_overlap", "regions", lambda r: r.where(I.overlaps(F.col("st"), F.col("en"), F.lit(2000), F.lit(9000))).select("contig", "st", "en"), "SELECT contig, st, en FROM regions WHERE st < 9000 AND 2000 < en")
_add("f2_block_variants", "typed", lambda v: v.where(I.in_block(F.col("pos"), 1000, 50000)).groupBy("contig").agg(F.count("*").alias("n")), "SELECT contig, count(*) AS n FROM typed WHERE pos >= 1000 AND pos < 50000 GROUP BY contig")
_add("f3_block_regions", "regions", lambda r: r.where(I.overlaps(F.col("st"), F.col("en"), F.lit(500), F.lit(600))).groupBy("contig").agg(F.count("*").alias("n")), "SELECT contig, count(*) AS n FROM regions WHERE st < 600 AND 500 < en GROUP BY contig")
_add("f4_contains", "regions", lambda r: r.where(V.contains(F.col("st"), F.col("en") - F.col("st"), F.lit(5000))).select("contig", "line_no"), "SELECT contig, line_no FROM regions WHERE st <= 5000 AND 5000 < en")
_add(
    "j1_reads_variants",
    "alignments typed",
    lambda a, v: I.points_in(_reads(a), v, "event_id").select("event_id", "n", F.array_join(F.col("places").cast("array<string>"), ",").alias("places")),
    f"SELECT event_id, count(*) AS n, string_agg(DISTINCT CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places FROM typed v JOIN {_R} r ON v.contig = r.contig AND pos >= st AND pos < en GROUP BY event_id".replace("string_agg(DISTINCT CAST(pos AS VARCHAR), ',' ORDER BY pos)", "array_to_string(list_sort(list(DISTINCT pos)), ',')"),
)
_add("j2_clip", "regions", lambda r: I.clip(r, 20000, 21000).select("contig", "st", "en", F.round("rate", 9).alias("rate")), "SELECT contig, greatest(st, 20000) AS st, least(en, 21000) AS en, round(rate, 9) AS rate FROM regions WHERE greatest(st, 20000) < least(en, 21000)")
_add(
    "j2_covering",
    "regions",
    lambda r: I.covering(r.withColumn("st", F.col("st") + F.col("line_no") % 3), 20000, 20400, 0.25).select("contig", "st", "en", F.round("rate", 9).alias("rate")),
    """, p AS (SELECT contig, greatest(st + line_no % 3, 20000) AS st, least(en, 20400) AS en, round(rate, 9) AS rate FROM regions WHERE greatest(st + line_no % 3, 20000) < least(en, 20400)),
t AS (SELECT r.contig, coalesce(max(p.en), 20000) AS last FROM (SELECT DISTINCT contig FROM regions) r LEFT JOIN p ON p.contig = r.contig GROUP BY r.contig)
SELECT * FROM p UNION ALL SELECT contig, last, 20400, 0.25 FROM t WHERE last < 20400""",
)
_add(
    "j6_recalibrated",
    "regions",
    lambda r: I.recalibrated(r.withColumn("rate", F.when(F.col("flag"), F.lit(None)).otherwise(F.col("rate"))), 20000, 60000, 0.5).groupBy("contig").agg(F.sum(F.col("en") - F.col("st")).alias("bases"), F.min("st").alias("st"), F.max("en").alias("en"), F.count_if(F.col("rate").isNull()).alias("unknown")),
    "SELECT DISTINCT contig, CAST(40000 AS BIGINT) AS bases, CAST(20000 AS BIGINT) AS st, CAST(60000 AS BIGINT) AS en, CAST(0 AS BIGINT) AS unknown FROM regions",
)
_add("j3_reads_in_targets", "alignments regions", lambda a, r: I.interval_filter(_reads(a), r.where("flag"), True).select("event_id"), f"SELECT event_id FROM {_R} a WHERE EXISTS (SELECT 1 FROM regions r WHERE r.flag AND r.contig = a.contig AND a.st < r.en AND r.st < a.en)")
_add("j4_reads_not_discarded", "alignments regions", lambda a, r: I.interval_filter(_reads(a), r.where("flag"), False).select("event_id"), f"SELECT event_id FROM {_R} a WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.flag AND r.contig = a.contig AND a.st < r.en AND r.st < a.en)")
_add(
    "j5_first_region",
    "typed regions",
    lambda v, r: I.first_match(v.select("contig", "pos", F.col("line_no").alias("variant")), r).select("variant", "r_line"),
    "SELECT v.line_no AS variant, min(r.line_no) AS r_line FROM typed v JOIN regions r ON v.contig = r.contig AND v.pos BETWEEN r.st AND r.en GROUP BY v.line_no, v.contig, v.pos",
)
_add("j9_position_in_regions", "typed regions", lambda v, r: I.point_join(v, r.where("flag"), "left_semi").groupBy("contig").agg(F.count("*").alias("n")), "SELECT v.contig, count(*) AS n FROM typed v WHERE EXISTS (SELECT 1 FROM regions r WHERE r.flag AND r.contig = v.contig AND v.pos >= r.st AND v.pos < r.en) GROUP BY v.contig")
_FOLD = """, o AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY line_no) AS rn FROM regions),
f AS (SELECT contig, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS cur, false AS taken, CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS en, CAST(0 AS DOUBLE) AS rate, CAST(0 AS BIGINT) AS was FROM chroms
  UNION ALL SELECT o.contig, o.rn, CASE WHEN o.st >= f.cur THEN o.en ELSE f.cur END, o.st >= f.cur, o.st, o.en, o.rate, f.cur FROM f JOIN o ON o.contig = f.contig AND o.rn = f.rn + 1)
SELECT contig, st, en, round(rate, 9) AS rate FROM f WHERE taken
UNION ALL SELECT contig, was, st, 0.0 FROM f WHERE taken AND st > was
UNION ALL SELECT c.contig, m.cur, c.length, 0.0 FROM chroms c JOIN (SELECT contig, max(cur) AS cur FROM f GROUP BY contig) m ON m.contig = c.contig WHERE m.cur < c.length"""


Q["w3_fill_gaps"] = lambda spark, d: I.fill_gaps(view(spark, d, "regions"), view(spark, d, "chroms")).withColumn("rate", F.round("rate", 9))
O["w3_fill_gaps"] = with_views("", "regions", "chroms").rstrip() + _FOLD
_add("w3_gap_bases", "regions chroms", lambda r, c: I.fill_gaps(r, c).groupBy("contig").agg(F.sum(F.col("en") - F.col("st")).alias("bases")), "SELECT contig, length AS bases FROM chroms")
_add("w4_next_start", "regions", lambda r: I.next_starts(r, F.lit(100_000)).select("contig", "line_no", "own"), "SELECT contig, line_no, lead(st, 1, 100000) OVER (PARTITION BY contig ORDER BY st, line_no) - st AS own FROM regions")
_add("w6_clusters", "regions", lambda r: I.clusters(r.select("contig", "st").distinct(), "contig", "st", 100).groupBy("contig").agg((F.max("cluster") + 1).alias("clusters")), "SELECT contig, CAST(sum(new) AS BIGINT) AS clusters FROM (SELECT contig, CASE WHEN st - lag(st) OVER (PARTITION BY contig ORDER BY st) <= 100 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT contig, st FROM regions) x) y GROUP BY contig")
_add("w9_contig_index", "regions", I.contig_numbers, "SELECT contig, CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS INTEGER) AS contig_idx FROM regions GROUP BY contig")
_add(
    "a23_coverage",
    "alignments",
    lambda a: I.coverage(_reads(a)).select("contig", "pos", "depth"),
    f"SELECT contig, pos, CAST(sum(d) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS depth FROM (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, st AS pos, 1 AS d FROM {_R} UNION ALL SELECT contig, en, -1 FROM {_R}) e GROUP BY contig, pos) x",
)
_add("d9_contigs_without_regions", "chroms regions", lambda c, r: I.only_in(c, r.where("st > 99900")), "SELECT contig FROM chroms c WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.contig = c.contig AND r.st > 99900)")
_add("d9_regions_without_contig", "regions chroms", lambda r, c: I.only_in(r, c.where("length % 2 = 0")), "SELECT DISTINCT contig FROM regions WHERE contig NOT IN (SELECT contig FROM chroms WHERE length % 2 = 0)")
_add("f8_known_contigs", "typed chroms", lambda v, c: v.join(c.where("length % 2 = 0"), "contig", "left_semi").groupBy("contig").agg(F.count("*").alias("n")), "SELECT contig, count(*) AS n FROM typed WHERE contig IN (SELECT contig FROM chroms WHERE length % 2 = 0) GROUP BY contig")
_add("t1_sorted_fragments", "alignments", lambda a: I.in_order(_reads(a), "st", "event_id").select("event_id", "place"), f"SELECT event_id, CAST(row_number() OVER (PARTITION BY contig ORDER BY st, event_id) AS INTEGER) AS place FROM {_R}")
