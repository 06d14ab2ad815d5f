"""Queries on sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.plans.views import view, with_views

Q: dict = {}
O: dict[str, str] = {}


def _add(name, source, make, sql):
    Q[name] = lambda spark, d: make(view(spark, d, source))
    O[name] = with_views(sql, source)


_acgt = "length(regexp_replace(seq, '[^ACGT]', '', 'g'))"
_gc = "length(regexp_replace(seq, '[^GC]', '', 'g'))"
_share = f"CASE WHEN {_acgt} = 0 THEN 0.0 ELSE {_gc}::DOUBLE / {_acgt} END"
_pct = "CAST(greatest(0, least(100, round_even(({}) * 100, 0))) AS INTEGER)"
_letters = "SELECT contig, length, unnest(range(0, length)) AS pos, unnest(string_split(seq, '')) AS b FROM contigs"

_add("s4_total_length", "contigs", lambda c: c.agg(F.count("*").alias("contigs"), F.sum("length").cast("long").alias("bases")), "SELECT count(*) AS contigs, CAST(sum(length) AS BIGINT) AS bases FROM contigs")
_add("p1_upper", "contigs", lambda c: c.select("contig", S.upper(F.lower("seq")).alias("seq")), "SELECT contig, upper(lower(seq)) AS seq FROM contigs")
_add("p2_ambiguity_count", "raw_contigs", lambda c: c.select("contig", S.ambiguity_count(F.col("seq")).alias("n")), "SELECT contig, CAST(length(regexp_replace(seq, '[^RYSWKMBDHV]', '', 'g')) AS BIGINT) AS n FROM raw_contigs")
_add("p8_gc_fraction", "raw_contigs", lambda c: c.select("contig", F.round(S.gc_fraction(F.col("seq")), 9).alias("gc")), f"SELECT contig, round({_share}, 9) AS gc FROM raw_contigs")
_add("p9_gc_index", "contigs", lambda c: c.select("contig", S.gc_index(S.gc_fraction(F.col("seq"))).alias("gc_pct")), f"SELECT contig, {_pct.format(_share)} AS gc_pct FROM contigs")
_add("p11_rotate", "contigs", lambda c: c.select("contig", S.rotate(F.col("seq")).alias("seq")), "SELECT contig, concat(substring(seq, CAST((length(seq) + 1) // 2 + 1 AS INT)), substring(seq, 1, CAST((length(seq) + 1) // 2 AS INT))) AS seq FROM contigs")
_add("p12_reverse_complement", "contigs", lambda c: c.select("contig", S.reverse_complement(F.col("seq")).alias("seq")), "SELECT contig, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM contigs")
_add(
    "p13_masked",
    "raw_contigs",
    lambda c: c.select("contig", S.masked(F.col("seq")).alias("seq")),
    "SELECT contig, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN seq[i] IN ('A','C','G','T') THEN seq[i] ELSE substr('TTAGGG', CAST((i - 1) % 6 + 1 AS INT), 1) END), '') AS seq FROM raw_contigs",
)
_add("f13_enough_bases", "raw_contigs", lambda c: c.where(S.enough_bases(F.col("seq"))).select("contig"), "SELECT contig FROM raw_contigs WHERE length(replace(seq, 'N', ''))::DOUBLE / length(seq) > 0.9")
_add("f15_long_enough", "contigs", lambda c: c.where(F.col("length") >= 1500).select("contig", "length"), "SELECT contig, length FROM contigs WHERE length >= 1500")
_add("k5_fasta_lines", "contigs", lambda c: c.select("contig", S.wrapped(F.col("seq")).alias("body")), r"SELECT contig, regexp_replace(regexp_replace(seq, '(.{{80}})', '\1' || chr(10), 'g'), chr(10) || '$', '') AS body FROM contigs".replace("{{", "{").replace("}}", "}"))
_add("a1_trinuc_counts", "contigs", S.trinucleotide_counts, "SELECT tri, count(*) AS n FROM (SELECT substr(seq, CAST(i AS INT), 3) AS tri FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM contigs) x) y GROUP BY tri")
_add(
    "w1_trinuc_windows",
    "raw_contigs",
    S.trinucleotide_windows,
    "SELECT contig, count(*) AS windows, CAST(sum(CASE WHEN regexp_matches(t, '^[ACGT]{3}$') THEN 16 * (instr('ACGT', t[1]) - 1) + 4 * (instr('ACGT', t[2]) - 1) + instr('ACGT', t[3]) - 1 END) AS BIGINT) AS index_sum FROM (SELECT contig, substr(seq, CAST(i AS INT), 3) AS t FROM (SELECT contig, seq, unnest(range(1, length(seq) - 1)) AS i FROM raw_contigs) x) y GROUP BY contig",
)
_add(
    "p10_trinuc_index",
    "contigs",
    lambda c: S.trinucleotide_counts(c).select("tri", S.trinucleotide_index(F.col("tri")).alias("i")),
    "SELECT DISTINCT tri, 16 * (instr('ACGT', tri[1]) - 1) + 4 * (instr('ACGT', tri[2]) - 1) + instr('ACGT', tri[3]) - 1 AS i FROM (SELECT substr(seq, CAST(i AS INT), 3) AS tri FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM contigs) x) y",
)
_add(
    "w2_gc_windows",
    "contigs",
    lambda c: S.gc_window_counts(c, 100),
    f"SELECT gc_pct, count(*) AS n FROM (SELECT {_pct.format('gc::DOUBLE / 100')} AS gc_pct FROM (SELECT length, pos, sum(CASE WHEN b IN ('G','C') THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS gc FROM ({_letters}) x) y WHERE pos <= length - 100) z GROUP BY gc_pct",
)
_add(
    "w5_chunks",
    "contigs",
    lambda c: S.chunks(c, 1000, 200),
    """SELECT contig, CAST(k AS INTEGER) AS chunk, k * 800 AS st, least(k * 800 + 1000, length) AS en, CASE WHEN k * 800 + 1000 >= length THEN length ELSE (k + 1) * 800 END AS own_end
FROM (SELECT contig, length, unnest(range(0, CAST(ceil(greatest(length - 1000, 0) / 800.0) AS BIGINT) + 1)) AS k FROM contigs) x""",
)
_add(
    "w8_cumulative_weights",
    "contigs",
    lambda c: S.gc_window_counts(c, 100).select("gc_pct", F.expr("sum(n) over (order by gc_pct)").alias("running"), F.expr("sum(n) over ()").alias("total")),
    f"SELECT gc_pct, CAST(sum(n) OVER (ORDER BY gc_pct) AS BIGINT) AS running, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT gc_pct, count(*) AS n FROM (SELECT {_pct.format('gc::DOUBLE / 100')} AS gc_pct FROM (SELECT length, pos, sum(CASE WHEN b IN ('G','C') THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS gc FROM (SELECT contig, length, unnest(range(0, length)) AS pos, unnest(string_split(seq, '')) AS b FROM contigs) x) y WHERE pos <= length - 100) z GROUP BY gc_pct) t",
)
