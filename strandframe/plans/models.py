"""Queries that fit models."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions.sequence import gc_windows, trinucleotide_counts
from strandframe.operators import fragments as G
from strandframe.operators import intervals as I
from strandframe.operators import mutation_model as M
from strandframe.operators import quality_model as P
from strandframe.operators.variants import variant_type
from strandframe.plans.variants import KINDS
from strandframe.plans.views import VIEWS, view, with_views
from strandframe.session import stored

Q: dict = {}
O: dict[str, str] = {}
c = F.col

VIEWS["quals"] = """SELECT vec_id AS record_no, embedding FROM embeddings"""
#: SNVs with the contigs' own bases as reference: a place in each contig, the alternative by turns.
VIEWS["snvs"] = """SELECT contig, pos, substring(seq, CAST(pos + 1 AS INT), 1) AS ref, substring('ACGT', CAST((instr('ACGT', substring(seq, CAST(pos + 1 AS INT), 1)) + length % 3) % 4 + 1 AS INT), 1) AS alt, 'SNV' AS type
    FROM (SELECT contig, seq, length, (contig_idx * 7919) % length AS pos FROM contigs UNION ALL SELECT contig, seq, length, (contig_idx * 104729 + 13) % length AS pos FROM contigs) p"""


def _add(name, sources, make, sql):
    sources = sources.split()

    def run(spark, d):
        if "snvs" not in sources:
            return make(*[view(spark, d, s) for s in sources])
        # used by several branches of a plan, which would each make the sequences anew
        contigs = stored(view(spark, d, "contigs"), "contigs")
        contigs.createOrReplaceTempView("contigs")
        return make(*[contigs if s == "contigs" else view(spark, d, s) for s in sources])

    Q[name] = run
    O[name] = with_views(sql, *sources, *(["contigs"] if "snvs" in sources else []))


def _typed(v):
    return v.withColumn("type", variant_type(c("ref"), c("alt"))).where("type is not null")


def _q(e):
    return e.select("record_no", F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 100) % 42).cast("int")).alias("q"))


_TRI = "(SELECT contig, unnest(range(1, length - 1)) AS i, seq FROM contigs)"
_COUNTS = f"(SELECT substr(seq, CAST(i AS INT), 3) AS tri, count(*) AS n FROM {_TRI} t GROUP BY 1)"
_CTX = "(SELECT substr(c.seq, CAST(v.pos AS INT), 3) AS ref_tri, concat(substr(c.seq, CAST(v.pos AS INT), 1), v.alt, substr(c.seq, CAST(v.pos + 2 AS INT), 1)) AS alt_tri FROM snvs v JOIN contigs c ON v.contig = c.contig WHERE v.pos > 0 AND v.pos < c.length - 1)"
_TT = f"(SELECT ref_tri, alt_tri, count(*) AS n FROM {_CTX} x GROUP BY 1, 2)"
_K = f"(SELECT * FROM {KINDS} k WHERE type IS NOT NULL)"
r9 = lambda name: F.round(name, 9).alias(name)
_add("a2_trinuc_transitions", "snvs contigs", lambda v, s: M.trinucleotide_transitions(v, s), f"SELECT * FROM {_TT} t")
_add("a3_snp_transitions", "typed", lambda v: M.snp_transitions(_typed(v)), f"SELECT ref, alt, count(*) AS n FROM {_K} k WHERE type = 'SNV' GROUP BY ref, alt")
_add("a4_indel_lengths", "typed", lambda v: M.indel_lengths(_typed(v)), f"SELECT CAST(length(alt) - length(ref) AS INTEGER) AS len, count(*) AS n FROM {_K} k WHERE type IN ('INS', 'DEL') GROUP BY 1")
_add("a5_mutation_shares", "snvs contigs", lambda v, s: M.mutation_shares(v, s).select("tri", r9("p")), f"SELECT c.tri, round(coalesce(m.n, 0)::DOUBLE / c.n, 9) AS p FROM {_COUNTS} c LEFT JOIN (SELECT ref_tri, count(*) AS n FROM {_CTX} x GROUP BY 1) m ON m.ref_tri = c.tri")
_add("a6_transition_shares", "snvs contigs", lambda v, s: M.transition_shares(v, s).select("ref_tri", "alt_tri", r9("p")), f"SELECT ref_tri, alt_tri, round(n::DOUBLE / sum(n) OVER (PARTITION BY ref_tri), 9) AS p FROM {_TT} t")
_add("a7_snp_shares", "typed", lambda v: M.share(M.snp_transitions(_typed(v)), "ref").select("ref", "alt", r9("p")), f"SELECT ref, alt, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY ref), 9) AS p FROM {_K} k WHERE type = 'SNV' GROUP BY ref, alt")
_add("a8_type_shares", "typed", lambda v: M.type_shares(_typed(v)).select("type", r9("p")), f"SELECT type, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS p FROM {_K} k GROUP BY type")
_add("a8_length_shares", "typed", lambda v: M.length_shares(_typed(v)).select("kind", "len", r9("p")), f"SELECT type AS kind, CAST(abs(length(alt) - length(ref)) AS INTEGER) AS len, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY type), 9) AS p FROM {_K} k WHERE type IN ('INS', 'DEL') GROUP BY 1, 2")
_add("a9_mutation_rate", "snvs contigs", lambda v, s: M.mutation_rate(v, s).select(r9("rate")), "SELECT round((SELECT count(*) FROM snvs)::DOUBLE / (SELECT sum(length(replace(seq, 'N', ''))) FROM contigs), 9) AS rate")
_add("a10_homozygous_share", "typed", lambda v: M.homozygous_share(v, c("gt")).select(r9("p")), "SELECT round(count(CASE WHEN gt = '1/1' THEN 1 END)::DOUBLE / count(*), 9) AS p FROM typed")
_add("a11_snp_matrix", "typed", lambda v: M.snp_matrix(_typed(v)).select("ref", *[r9(b) for b in "ACGT"]), "SELECT ref, " + ", ".join(f"round(count(CASE WHEN alt = '{b}' THEN 1 END)::DOUBLE / count(*), 9) AS \"{b}\"" for b in "ACGT") + f" FROM {_K} k WHERE type = 'SNV' GROUP BY ref")
_add("a11_bias_by_index", "snvs contigs", lambda v, s: M.indexed(M.mutation_shares(v, s)).select("i", r9("p")), f"SELECT 16 * (instr('ACGT', c.tri[1]) - 1) + 4 * (instr('ACGT', c.tri[2]) - 1) + instr('ACGT', c.tri[3]) - 1 AS i, round(coalesce(m.n, 0)::DOUBLE / c.n, 9) AS p FROM {_COUNTS} c LEFT JOIN (SELECT ref_tri, count(*) AS n FROM {_CTX} x GROUP BY 1) m ON m.ref_tri = c.tri")
_B = "(SELECT unnest(['A','C','G','T']) AS b)"
_add(
    "a12_dense_transitions",
    "snvs contigs",
    lambda v, s: M.dense_transitions(v, s).select("ref_tri", "alt_tri", r9("p")),
    f"SELECT g.ref_tri, g.alt_tri, coalesce(round(t.p, 9), 0) AS p FROM (SELECT concat(a.b, m.b, z.b) AS ref_tri, concat(a.b, x.b, z.b) AS alt_tri FROM {_B} a, {_B} m, {_B} z, {_B} x WHERE x.b <> m.b) g LEFT JOIN (SELECT ref_tri, alt_tri, n::DOUBLE / sum(n) OVER (PARTITION BY ref_tri) AS p FROM {_TT} t) t ON t.ref_tri = g.ref_tri AND t.alt_tri = g.alt_tri",
)
_add(
    "j14_local_bias",
    "snvs contigs",
    lambda v, s: M.greatest_bias(s, M.mutation_shares(v, s)).select("contig", "places", r9("top")),
    f"SELECT contig, count(*) AS places, round(max(p), 9) AS top FROM (SELECT t.contig, b.p / sum(b.p) OVER (PARTITION BY t.contig) AS p FROM (SELECT contig, substr(seq, CAST(i AS INT), 3) AS tri FROM (SELECT contig, seq, unnest(range(1, length - 1)) AS i FROM contigs) y) t JOIN (SELECT c.tri, coalesce(m.n, 0)::DOUBLE / c.n AS p FROM {_COUNTS} c LEFT JOIN (SELECT ref_tri, count(*) AS n FROM {_CTX} x GROUP BY 1) m ON m.ref_tri = c.tri) b ON b.tri = t.tri) z GROUP BY contig",
)
# qualities
_QL = "(SELECT record_no, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS INTEGER) % 42) AS q FROM quals)"
_QP = f"(SELECT record_no, unnest(range(0, len(q))) AS pos, unnest(q) AS q FROM {_QL} l)"
_HIST = f"(SELECT CAST(pos AS INTEGER) AS pos, q, count(*) AS n FROM {_QP} p GROUP BY 1, 2)"
_TRANS = f"(SELECT CAST(pos AS INTEGER) AS pos, q, q_next, count(*) AS n FROM (SELECT pos, q, lead(q) OVER (PARTITION BY record_no ORDER BY pos) AS q_next FROM {_QP} p) x WHERE q_next IS NOT NULL GROUP BY 1, 2, 3)"
_add("p3_decoded", "quals", lambda e: _q(e).select("record_no", F.array_join(P.decoded(P.encoded(c("q"))).cast("array<string>"), ",").alias("q")), f"SELECT record_no, array_to_string(q, ',') AS q FROM {_QL} l")
_add("p4_encoded", "quals", lambda e: _q(e).select("record_no", P.encoded(c("q")).alias("q")), f"SELECT record_no, array_to_string(list_transform(q, lambda x: chr(x + 33)), '') AS q FROM {_QL} l")
_add("p5_error_probability", "quals", lambda e: P.by_position(_q(e)).select("q", F.round(P.error_probability(c("q")), 9).alias("p")).distinct(), f"SELECT DISTINCT q, round(pow(10, -q / 10.0), 9) AS p FROM {_HIST} h")
_add("p6_binned", "quals", lambda e: P.by_position(_q(e)).groupBy(P.binned(c("q"), [5, 12, 23, 37]).alias("bin")).agg(F.sum("n").alias("n")), f"SELECT CASE WHEN q >= 37 THEN 37 WHEN q >= 23 THEN 23 WHEN q >= 12 THEN 12 ELSE 5 END AS bin, CAST(sum(n) AS BIGINT) AS n FROM {_HIST} h GROUP BY 1")
_add("p7_bins", "quals", lambda e: e.sparkSession.createDataFrame([(v,) for v in P.prepared_bins([37, 2, 12, 2, 23])], "bin int"), "SELECT unnest([2, 12, 23, 37]) AS bin")
_add("f17_conforming", "quals", lambda e: P.conforming(_q(e).withColumn("q", F.slice("q", F.lit(1), 60 + (c("record_no") % 5).cast("int"))), 62).select("record_no"), "SELECT record_no FROM quals WHERE 60 + record_no % 5 = 62")
_add("t6_limited", "quals", lambda e: P.limited(_q(e), 100).select("record_no"), "SELECT record_no FROM quals WHERE record_no < 100")
_add("a13_quality_histogram", "quals", lambda e: P.by_position(_q(e)), f"SELECT * FROM {_HIST} h")
_add("a14_quality_moments", "quals", lambda e: P.moments(P.by_position(_q(e))).select("pos", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")), f"SELECT CAST(pos AS INTEGER) AS pos, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS sd FROM {_QP} p GROUP BY 1")
_add("a15_mean_error", "quals", lambda e: P.mean_error(P.by_position(_q(e))).select(r9("error")), f"SELECT round(avg(pow(10, -q / 10.0)), 9) AS error FROM {_QP} p")
_add("a16_mean_of_files", "quals", lambda e: P.mean_error_of_files(*(P.by_position(_q(e.where(c("record_no") % 2 == k))) for k in (0, 1))).select(r9("error")), f"SELECT round((a.e + b.e) / 2, 9) AS error FROM (SELECT avg(pow(10, -q / 10.0)) AS e FROM {_QP} p WHERE record_no % 2 = 0) a, (SELECT avg(pow(10, -q / 10.0)) AS e FROM {_QP} p WHERE record_no % 2 = 1) b")
_add("a17_initial", "quals", lambda e: P.initial(_q(e)), f"SELECT q, n FROM {_HIST} h WHERE pos = 0")
_add("a18_position_shares", "quals", lambda e: P.shares(P.by_position(_q(e)), "pos").select("pos", "q", r9("p")), f"SELECT pos, q, round(n::DOUBLE / sum(n) OVER (PARTITION BY pos), 9) AS p FROM {_HIST} h")
_add("a19_transitions", "quals", lambda e: P.transitions(_q(e)), f"SELECT * FROM {_TRANS} t")
_add("a20_greatest_quality", "quals", lambda e: P.greatest_quality(P.by_position(_q(e)), [2, 12, 23, 37]), f"SELECT least(max(q), 37) AS top FROM {_HIST} h")
_add("a21_transition_shares", "quals", lambda e: P.markov_model(_q(e), 64)["transitions"].select("pos", "q", "q_next", r9("p")), f"SELECT pos, q, q_next, round(n::DOUBLE / sum(n) OVER (PARTITION BY pos, q), 9) AS p FROM {_TRANS} t")
_add("w7_successors", "quals", lambda e: P.transitions(_q(e)).groupBy("q", "q_next").agg(F.sum("n").alias("n")), f"SELECT q, q_next, CAST(sum(n) AS BIGINT) AS n FROM {_TRANS} t GROUP BY 1, 2")
_add("p42_position_for_length", "quals", lambda e: e.sparkSession.range(150).select(c("id").cast("int").alias("pos"), P.position_for_length(c("id"), 150, 64).alias("at")), "SELECT CAST(i AS INTEGER) AS pos, CAST(greatest(0, least(63, round_even(i / 149.0 * 63, 0))) AS INTEGER) AS at FROM (SELECT unnest(range(0, 150)) AS i) x")
_add("p43_row_for_length", "quals", lambda e: e.sparkSession.range(150).select(c("id").cast("int").alias("pos"), P.row_for_length(c("id"), 150, 64).alias("at")), "SELECT CAST(i AS INTEGER) AS pos, CAST(64 * i // 150 AS INTEGER) AS at FROM (SELECT unnest(range(0, 150)) AS i) x")
# fragments and GC
_GOOD = "flag & 1 <> 0 AND flag & 64 <> 0 AND mapq > 10 AND contig = mate_contig"
_LEN = f"(SELECT abs(tlen) AS len, count(*) AS n FROM alignments WHERE (flag & 1) <> 0 AND (flag & 64) <> 0 AND mapq > 10 AND contig = mate_contig GROUP BY 1)"
_ROWS = "(SELECT abs(tlen) AS len FROM alignments WHERE (flag & 1) <> 0 AND (flag & 64) <> 0 AND mapq > 10 AND contig = mate_contig)"
_KEPT = f"(SELECT l.len, l.n FROM {_LEN} l, (SELECT m, median(abs(len - m)) AS d FROM {_ROWS} x, (SELECT median(len) AS m FROM {_ROWS} y) z GROUP BY m) s WHERE l.len > 0 AND l.len <= s.m + 10 * s.d AND l.n >= 2)"
_add("f11_fragment_lengths", "alignments", G.lengths, f"SELECT * FROM {_LEN} l")
_add("f12_fragment_outliers", "alignments", lambda a: G.filtered(G.lengths(a), 2), f"SELECT * FROM {_KEPT} k")
_add("a22_fragment_moments", "alignments", lambda a: G.moments(G.filtered(G.lengths(a), 2)).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")), f"SELECT round(sum(len * n)::DOUBLE / sum(n), 6) AS mean, round(sqrt(sum(n * len * len)::DOUBLE / sum(n) - pow(sum(len * n)::DOUBLE / sum(n), 2)), 6) AS sd FROM {_KEPT} k")
VIEWS["spans"] = "SELECT concat('doc', user_id % 200) AS contig, (event_id * 31) % 700 AS st, (event_id * 31) % 700 + 150 AS en FROM events"
_WIN = "(SELECT contig, seq, unnest(range(0, length - 100, greatest(100, length // 1000))) AS w FROM contigs WHERE length > 100)"
_PCT = "CAST(greatest(0, least(100, round_even(length(regexp_replace(substr(seq, CAST(w + 1 AS INT), 100), '[^GC]', '', 'g')), 0))) AS INTEGER)"
_add(
    "a24_gc_weights",
    "contigs spans",
    lambda s, a: G.gc_weights(s, I.coverage(a), 100).select("gc_pct", r9("weight")),
    f"""SELECT CAST(g.i AS INTEGER) AS gc_pct, round(CASE WHEN coalesce(d.depth, 0) > 0 THEN d.depth ELSE t.middle END / t.top, 9) AS weight FROM (SELECT unnest(range(0, 101)) AS i) g
LEFT JOIN dd d ON d.gc_pct = g.i, (SELECT max(depth) AS top, avg(CASE WHEN depth > 0 THEN depth END) AS middle FROM dd) t""",
)
O["a24_gc_weights"] = O["a24_gc_weights"].replace(
    "\nSELECT CAST(g.i",
    f""",
ww AS (SELECT contig, w, {_PCT} AS gc_pct FROM {_WIN} x),
dd AS (SELECT gc_pct, avg(bases) / 100 AS depth FROM (SELECT ww.contig, ww.w, ww.gc_pct, coalesce(sum(CASE WHEN s.st IS NOT NULL THEN least(s.en, ww.w + 100) - greatest(s.st, ww.w) END), 0) AS bases FROM ww LEFT JOIN spans s ON s.contig = ww.contig AND s.st < ww.w + 100 AND ww.w < s.en GROUP BY 1, 2, 3) y GROUP BY gc_pct)
SELECT CAST(g.i""",
)
_add(
    "a25_genome_mean_weight",
    "contigs",
    lambda s: G.genome_mean_weight(s, s.sparkSession.range(101).select(c("id").cast("int").alias("gc_pct"), ((c("id") % 7 + 1) / 7).alias("weight")), 100).select(r9("mean")),
    "SELECT round(avg((gc % 7 + 1) / 7.0::DOUBLE), 9) AS mean FROM (SELECT length, pos, CAST(sum(CASE WHEN b IN ('G','C') THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS INTEGER) AS gc FROM (SELECT contig, length, unnest(range(0, length)) AS pos, unnest(string_split(seq, '')) AS b FROM contigs WHERE length > 100) x) y WHERE pos <= length - 100",
)
_WEIGHTS = lambda s: s.sparkSession.range(101).select(c("id").cast("int").alias("gc_pct"), ((c("id") % 7 + 1) / 7).alias("weight"))
_add(
    "j13_weight_lookup",
    "contigs",
    lambda s: G.weighted_windows(gc_windows(s, 100), _WEIGHTS(s)).groupBy("contig").agg(F.count("*").alias("windows"), F.round(F.sum("weight"), 6).alias("weight")),
    "SELECT contig, count(*) AS windows, round(sum((gc % 7 + 1) / 7.0::DOUBLE), 6) AS weight FROM (SELECT contig, length, pos, CAST(sum(CASE WHEN b IN ('G','C') THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS INTEGER) AS gc FROM (SELECT contig, length, unnest(range(0, length)) AS pos, unnest(string_split(seq, '')) AS b FROM contigs WHERE length >= 100) x) y WHERE pos <= length - 100 GROUP BY contig",
)
_add("r16_uniform_weights", "chroms", lambda s: G.uniform_weights(s.sparkSession), "SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS gc_pct, CAST(1.0 AS DOUBLE) AS weight")
_add(
    "a1_region_counts",
    "contigs spans",
    lambda s, a: trinucleotide_counts(M.region_sequences(s, a)),
    "SELECT substr(seq, CAST(i + 1 AS INT), 3) AS tri, count(*) AS n FROM (SELECT c.seq, unnest(range(greatest(s.st, 0), least(s.en + 1, c.length) - 2)) AS i FROM spans s JOIN contigs c ON c.contig = s.contig) x GROUP BY 1",
)
_add("a9_region_rate", "snvs contigs spans", lambda v, s, a: M.mutation_rate(v, s, a).select(r9("rate")), "SELECT round((SELECT count(*) FROM snvs)::DOUBLE / (SELECT sum(en - st + 1) FROM spans WHERE contig IN (SELECT contig FROM contigs)), 9) AS rate")
_add("f9_human_names", "chroms", lambda s: M.of_human_names(s.unionByName(s.select(F.concat(F.lit("un_"), "contig").alias("contig"), "length"))).select("contig"), "SELECT contig FROM chroms")
