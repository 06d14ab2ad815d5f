"""Queries on reads, comparisons and random draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import randomness as R
from strandframe.functions.sequence import IUPAC, bases_at, resolved
from strandframe.operators import compare as C
from strandframe.operators import reads as D
from strandframe.operators import sim_models as Z
from strandframe.operators import simulate as S
from strandframe.plans.views import view, with_views

Q: dict = {}
O: dict[str, str] = {}
c = F.col


def _add(name, sources, make, sql):
    sources = sources.split()
    Q[name] = lambda spark, d: make(*[view(spark, d, s) for s in sources])
    O[name] = with_views(sql, *sources)


_paired, _rev = lambda: c("flag") % 2 == 1, lambda: c("flag") % 4 >= 2
_P, _V = "flag % 2 = 1", "flag % 4 >= 2"
_add("p35_read_names", "alignments", lambda a: a.select("event_id", D.name("r", c("contig"), c("pos"), c("pos") + c("span")).alias("name")), "SELECT event_id, concat('r_', contig, '_', lpad(CAST(pos + 1 AS VARCHAR), 10, '0'), '_', lpad(CAST(pos + span + 1 AS VARCHAR), 10, '0')) AS name FROM alignments")
_add("p18_flags", "alignments", lambda a: a.groupBy(D.flags(c("event_id") % 3 > 0, _paired(), _rev()).alias("sam_flag")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN event_id % 3 = 0 THEN 0 WHEN {_P} AND {_V} THEN 147 WHEN {_P} THEN 99 WHEN {_V} THEN 25 ELSE 9 END AS sam_flag, count(*) AS n FROM alignments GROUP BY 1")
_add("p19_mates", "alignments", lambda a: a.select("event_id", D.mate_position(_paired(), _rev(), c("pos"), c("pos") + 150).alias("mate"), D.template_length(_paired(), _rev(), c("pos"), c("pos") + c("tlen")).alias("tlen")), f"SELECT event_id, CASE WHEN NOT ({_P}) THEN 0 WHEN {_V} THEN pos ELSE pos + 150 END AS mate, CASE WHEN NOT ({_P}) OR tlen + 1 < 0 THEN 0 WHEN {_V} THEN -(tlen + 1) ELSE tlen + 1 END AS tlen FROM alignments")
_add("p36_segments", "contigs", lambda s: s.where("length > 300").select("contig", D.segment(c("seq"), c("length") % 100, c("length") % 100 + 100, D.padding(100), False).alias("fwd"), D.segment(c("seq"), c("length") % 100, c("length") % 100 + 100, D.padding(100), True).alias("rev")), "SELECT contig, substr(seq, CAST(length % 100 + 1 AS INT), 120) AS fwd, substr(seq, CAST(greatest(length % 100 - 20, 0) + 1 AS INT), CAST(length % 100 + 100 - greatest(length % 100 - 20, 0) AS INT)) AS rev FROM contigs WHERE length > 300")
_errors = lambda: F.array(F.struct((c("length") % 20).cast("int").alias("loc"), F.substr("seq", (c("length") % 20 + 1).cast("int"), F.lit(1)).alias("ref"), F.lit("GTT").alias("alt")), F.struct(((c("length") % 20) + 30).cast("int").alias("loc"), F.substr("seq", (c("length") % 20 + 31).cast("int"), F.lit(4)).alias("ref"), F.lit("C").alias("alt")))
_add("p14_errors_applied", "contigs", lambda s: s.where("length >= 100").select("contig", D.with_errors(c("seq"), _errors()).alias("seq")), "SELECT contig, concat(substr(seq, 1, CAST(k AS INT)), 'GTT', substr(seq, CAST(k + 2 AS INT), 29), 'C', substr(seq, CAST(k + 35 AS INT))) AS seq FROM (SELECT contig, seq, length % 20 AS k FROM contigs WHERE length >= 100) x")
_quals = lambda: F.transform(F.sequence(F.lit(0), c("length").cast("int") - 1), lambda i: (i % 40 + 2).cast("int"))
_add("p16_error_qualities", "contigs", lambda s: s.where("length >= 100").select("contig", F.array_join(D.error_qualities(_quals(), _errors(), 1).cast("array<string>"), ",").alias("q")), "SELECT contig, array_to_string(list_concat(list_concat(list_concat(q[1:k], [1, 1]), q[k + 2:k + 30]), q[k + 35:length]), ',') AS q FROM (SELECT contig, length, length % 20 AS k, list_transform(range(0, length), lambda i: i % 40 + 2) AS q FROM contigs WHERE length >= 100) x")
_indels = lambda: F.array(F.struct((c("length") % 20).cast("int").alias("loc"), F.lit("I").alias("kind"), F.lit(2).alias("len")), F.struct(((c("length") % 20) + 30).cast("int").alias("loc"), F.lit("D").alias("kind"), F.lit(3).alias("len")))
_add("p21_cigar", "contigs", lambda s: s.select("contig", D.cigar(100, _indels()).alias("cigar")), "SELECT contig, concat(k + 1, 'M2I30M3D', 100 - k - 33, 'M') AS cigar FROM (SELECT contig, length % 20 AS k FROM contigs) x")
_add("p20_plain_cigar", "contigs", lambda s: s.select("contig", D.cigar(c("length").cast("int"), F.filter(_indels(), lambda e: e["len"] > 9)).alias("cigar")), "SELECT contig, concat(length, 'M') AS cigar FROM contigs")
_add("p23_run_lengths", "contigs", lambda s: D.run_length_texts(s.select("contig", "seq"), "seq", "runs").select("contig", "runs"), """SELECT contig, string_agg(concat(n, b), '' ORDER BY g) AS runs FROM (SELECT contig, g, b, count(*) AS n FROM (SELECT contig, i, b, sum(new) OVER (PARTITION BY contig ORDER BY i) AS g FROM (SELECT contig, i, b, CASE WHEN b = lag(b) OVER (PARTITION BY contig ORDER BY i) THEN 0 ELSE 1 END AS new FROM (SELECT contig, unnest(range(1, length + 1)) AS i, unnest(string_split(seq, '')) AS b FROM contigs) x) y) z GROUP BY contig, g, b) w GROUP BY contig""")
_add("k4_reg2bin", "regions", lambda r: r.select("line_no", D.reg2bin(c("st") * 997, c("en") * 1009).alias("bin")), "SELECT line_no, CAST(CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20) WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = e >> 26 THEN 1 + (b >> 26) ELSE 0 END AS INTEGER) AS bin FROM (SELECT line_no, st * 997 AS b, en * 1009 - 1 AS e FROM regions) x")
# comparison
_NAMES = "(SELECT DISTINCT CASE WHEN line_no % 3 = 0 THEN contig WHEN line_no % 3 = 1 THEN substr(contig, 4) ELSE 'M' END AS contig FROM regions)"
_names = lambda r: r.select(F.when(c("line_no") % 3 == 0, c("contig")).when(c("line_no") % 3 == 1, F.substr("contig", F.lit(4))).otherwise("M").alias("contig")).distinct()
_add("p37_name_candidates", "regions", lambda r: _names(r).select("contig", F.array_join(C.name_candidates(c("contig")), ",").alias("others")), f"SELECT contig, CASE WHEN contig = 'M' THEN 'MT,chrM,chrMT' WHEN starts_with(contig, 'chr') THEN substr(contig, 4) ELSE concat('chr', contig) END AS others FROM {_NAMES} n")
_add("j11_found_aliases", "regions chroms", lambda r, s: C.found_aliases(_names(r), s), f"SELECT contig AS source, concat('chr', contig) AS canonical FROM {_NAMES} n WHERE contig NOT LIKE 'chr%' AND concat('chr', contig) IN (SELECT contig FROM chroms)")
_add("p38_renamed", "regions chroms", lambda r, s: C.with_aliases(r.select(F.substr("contig", F.lit(4)).alias("contig"), "line_no"), C.found_aliases(r.select(F.substr("contig", F.lit(4)).alias("contig")), s)), "SELECT contig, line_no FROM regions")
_add("t7_mismatch_sample", "regions chroms", lambda r, s: C.mismatched(r.select(F.substr("contig", F.lit(4)).alias("contig")), s).select(F.array_join("source_sample", ",").alias("s"), F.array_join("target_sample", ",").alias("t")), "SELECT (SELECT string_agg(contig, ',' ORDER BY contig) FROM (SELECT DISTINCT substr(contig, 4) AS contig FROM regions ORDER BY 1 LIMIT 5) x) AS s, (SELECT string_agg(contig, ',' ORDER BY contig) FROM (SELECT contig FROM chroms ORDER BY 1 LIMIT 5) y) AS t")
_MISS = "(SELECT contig, pos, line_no FROM typed)"
_IN = "EXISTS (SELECT 1 FROM regions r WHERE {} AND r.contig = m.contig AND m.pos >= r.st AND m.pos < r.en)"
_REASONS = f"(SELECT m.line_no, m.contig, m.pos, CASE WHEN m.contig NOT IN (SELECT contig FROM chroms WHERE length % 3 > 0) THEN 'outside_simulated_contigs' ELSE CASE WHEN {_IN.format('NOT r.flag AND r.rate < 0.2')} AND {_IN.format('r.flag')} THEN 'unknown' WHEN {_IN.format('NOT r.flag AND r.rate < 0.2')} THEN 'outside_target_bed' WHEN {_IN.format('r.flag')} THEN 'outside_mutation_bed' ELSE 'outside_mutation_bed,outside_target_bed' END END AS reasons FROM {_MISS} m)"
_att = lambda v, r, s: C.attributed(v.select("contig", "pos", "line_no"), s.where("length % 3 > 0"), r.where("NOT flag AND rate < 0.2"), r.where("flag"))
_add("j10_attributed", "typed regions chroms", lambda v, r, s: _att(v, r, s).select("contig", "pos", "line_no", F.array_join("reasons", ",").alias("reasons")), f"SELECT contig, pos, line_no, reasons FROM {_REASONS} x")
_add("a29_reason_counts", "typed regions chroms", lambda v, r, s: C.reason_counts(_att(v, r, s)), f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM {_REASONS} x) y GROUP BY reason")
_add("k9_annotated", "typed regions chroms", lambda v, r, s: _att(v, r, s).select("contig", "pos", "line_no", C.annotated(F.when(c("line_no") % 2 == 0, F.lit(".")).otherwise(F.lit("DP=3")), c("reasons")).alias("info")), f"SELECT contig, pos, line_no, CASE WHEN line_no % 2 = 0 THEN concat('MISS_REASON=', reasons) ELSE concat('DP=3;MISS_REASON=', reasons) END AS info FROM {_REASONS} x")
_COUNTS = "(SELECT contig, count(CASE WHEN flag = 'A' THEN 1 END) AS tp, count(CASE WHEN flag = 'N' THEN 1 END) AS fn, count(CASE WHEN flag = 'R' THEN 1 END) AS fp FROM typed GROUP BY contig UNION ALL SELECT 'none', 0, 0, 0)"


def _counts(v):
    found = v.groupBy("contig").agg(*[F.count_if(c("flag") == f).alias(n) for f, n in (("A", "tp"), ("N", "fn"), ("R", "fp"))])
    return found.unionByName(v.sparkSession.createDataFrame([("none", 0, 0, 0)], found.schema))


_add("p39_metrics", "typed", lambda v: C.metrics(_counts(v)).select("contig", *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")]), f"SELECT contig, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM {_COUNTS} x")
_add("p40_formatted", "typed", lambda v: C.metrics(_counts(v)).select("contig", C.formatted(c("recall")).alias("recall")), f"SELECT contig, coalesce(printf('%.4f', tp::DOUBLE / nullif(tp + fn, 0)), 'N/A') AS recall FROM {_COUNTS} x")
# random draws
_u = R.duck_uniform
_add("r_uniform", "chroms", lambda s: s.sparkSession.range(500).select("id", R.uniform(7, c("id"), "x").alias("u")), f"SELECT i AS id, {_u('7', 'i', chr(39) + 'x' + chr(39))} AS u FROM (SELECT unnest(range(0, 500)) AS i) t")
_n = lambda *k: f"sqrt(-2 * ln(1 - {_u(*k, chr(39) + 'a' + chr(39))})) * cos({2 * 3.141592653589793!r} * {_u(*k, chr(39) + 'b' + chr(39))})"
_add("r3_fragment_lengths", "chroms", lambda s: s.sparkSession.range(500).select("id", F.abs(F.rint(300 + 50 * R.normal(7, c("id")))).cast("long").alias("len")), f"SELECT i AS id, CAST(abs(round_even(300 + 50 * {_n('7', 'i')}, 0)) AS BIGINT) AS len FROM (SELECT unnest(range(0, 500)) AS i) t")
_add("p41_stochastic_round", "contigs", lambda s: s.select("contig", R.stochastic_round(c("length") * 0.013, 3, c("contig")).alias("n")), f"SELECT contig, CAST(floor(length * 0.013::DOUBLE) + CASE WHEN {_u('3', 'contig')} < length * 0.013::DOUBLE - floor(length * 0.013::DOUBLE) THEN 1 ELSE 0 END AS BIGINT) AS n FROM contigs")
_add("r6_types", "typed", lambda v: v.select("line_no", "contig", R.categorical(R.uniform(5, c("line_no")), [("INS", 0.03), ("DEL", 0.02), ("SNV", 0.95)]).alias("type")), f"SELECT line_no, contig, CASE WHEN u < 0.03 THEN 'INS' WHEN u < 0.05 THEN 'DEL' ELSE 'SNV' END AS type FROM (SELECT line_no, contig, {_u('5', 'line_no')} AS u FROM typed) x")
_pick = f"CASE code {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN substr({chr(39)}{v}{chr(39)}, CAST(floor(u * {len(v)}) + 1 AS INT), 1)' for k, v in IUPAC.items())} ELSE code END"


_add("p2_resolved", "raw_contigs", lambda s: resolved(s.select("contig", "seq"), 11), f"SELECT contig, string_agg({_pick}, '' ORDER BY i) AS seq FROM (SELECT contig, i, code, {_u('11', 'contig', 'i')} AS u FROM (SELECT contig, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS code FROM raw_contigs) x) y GROUP BY contig")
_sq = lambda x: f"'{x}'"
_add(
    "r11_ploids",
    "typed",
    lambda v: v.select("line_no", "contig", "pos", S.genotype(R.uniform(2, c("line_no"), "hom"), lambda p: R.uniform(2, c("line_no"), "ploid", p), 2, 0.1).alias("gt")),
    f"SELECT line_no, contig, pos, CASE WHEN {_u('2', 'line_no', _sq('hom'))} < 0.1 THEN '1/1' WHEN {_u('2', 'line_no', _sq('ploid'), '0')} <= {_u('2', 'line_no', _sq('ploid'), '1')} THEN '1/0' ELSE '0/1' END AS gt FROM typed",
)
_add(
    "r8_inserted_bases",
    "typed",
    lambda v: v.select("line_no", "contig", "pos", S.random_bases((c("line_no") % 4).cast("int"), lambda k: R.uniform(9, c("line_no"), k)).alias("bases")),
    "SELECT line_no, contig, pos, concat(" + ", ".join(f"CASE WHEN line_no % 4 >= {k} THEN substr('ACGT', CAST(floor({_u('9', 'line_no', str(k))} * 4) + 1 AS INT), 1) ELSE '' END" for k in (1, 2, 3)) + ") AS bases FROM typed",
)


def _cumulative(pairs, u="u") -> str:
    at, out = 0.0, []
    for value, p in pairs[:-1]:
        at += p / sum(p for _, p in pairs)
        out.append(f"WHEN {u} < {at!r} THEN {value}")
    return f"CASE {' '.join(out)} ELSE {pairs[-1][0]} END"


_add(
    "r9_lengths",
    "typed",
    lambda v: v.select("line_no", "contig", "pos", R.categorical(R.uniform(4, c("line_no"), "i"), list(Z.INSERTION_LENGTHS)).alias("insertion"), R.categorical(R.uniform(4, c("line_no"), "d"), list(Z.DELETION_LENGTHS)).alias("deletion")),
    f"SELECT line_no, contig, pos, CAST({_cumulative(Z.INSERTION_LENGTHS, _u('4', 'line_no', _sq('i')))} AS INTEGER) AS insertion, CAST({_cumulative(Z.DELETION_LENGTHS, _u('4', 'line_no', _sq('d')))} AS INTEGER) AS deletion FROM typed",
)
_add(
    "r7_snv_alleles",
    "contigs",
    lambda s: bases_at(s.where("length > 2").select("contig", (1 + c("contig_idx") * 31 % (c("length") - 2)).alias("pos")), s, c("pos") - 1, F.lit(3), "tri").select("contig", "pos", "tri", Z.snv_alternative(R.uniform(6, c("contig"), c("pos")), c("tri"), Z.Mutations()).alias("alt")),
    f"""SELECT contig, pos, tri, CASE tri[2] WHEN 'A' THEN CASE WHEN u < 0.15 THEN 'C' WHEN u < 0.85 THEN 'G' ELSE 'T' END WHEN 'C' THEN CASE WHEN u < 0.15 THEN 'A' WHEN u < 0.3 THEN 'G' ELSE 'T' END
WHEN 'G' THEN CASE WHEN u < 0.7 THEN 'A' WHEN u < 0.85 THEN 'C' ELSE 'T' END ELSE CASE WHEN u < 0.15 THEN 'A' WHEN u < 0.85 THEN 'C' ELSE 'G' END END AS alt
FROM (SELECT contig, pos, substr(seq, CAST(pos AS INT), 3) AS tri, {_u('6', 'contig', 'pos')} AS u FROM (SELECT contig, seq, 1 + contig_idx * 31 % (length - 2) AS pos FROM contigs WHERE length > 2) x) y""",
)
#: Weights that doubles hold exactly: 64ths, by the index of the trinucleotide.
_BIAS = Z.Mutations(bias=tuple((t, (i % 8 + 1) / 64) for i, t in enumerate(Z.TRINUCLEOTIDES)))
_IDX = "16 * (instr('ACGT', t[1]) - 1) + 4 * (instr('ACGT', t[2]) - 1) + instr('ACGT', t[3]) - 1"
_add(
    "r10_biased_places",
    "contigs",
    lambda s: S.drawn_places(s.where("length > 2").select("contig", c("seq").alias("letters"), (c("length") - 2).cast("int").alias("n"), R.uniform(8, c("contig")).alias("u"), F.lit(True).alias("biased")), _BIAS.place_weights()).select("contig", (c("offset") + 1).alias("pos")),
    f"""SELECT contig, min(pos) AS pos FROM (SELECT contig, pos, u, sum(w) OVER (PARTITION BY contig ORDER BY pos) AS upto, sum(w) OVER (PARTITION BY contig) AS total FROM
(SELECT contig, pos, {_u('8', 'contig')} AS u, (({_IDX}) % 8 + 1) / 64.0::DOUBLE AS w FROM (SELECT contig, pos, substr(seq, CAST(pos AS INT), 3) AS t FROM (SELECT contig, seq, unnest(range(1, length - 1)) AS pos FROM contigs WHERE length > 2) x) y) z) q WHERE upto > u * total GROUP BY contig""",
)
_add(
    "a27_expected_variants",
    "regions",
    lambda r: S.candidate_counts(r.groupBy("contig").agg(F.min("st").alias("st"), F.max("en").alias("en")).withColumn("rate", F.lit(1e-5)), S.Settings(seed=3, min_mutations=1)).select("contig", "n"),
    f"""SELECT contig, greatest(least(n, greatest(CAST(round_even(2 * mean, 0) AS BIGINT), 1)), 1) AS n FROM (SELECT contig, mean, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (ORDER BY k) AS upto FROM (SELECT unnest(range(0, 60)) AS k) a) b WHERE upto <= u) AS n
FROM (SELECT contig, (max(en) - min(st)) * 1e-5::DOUBLE AS mean, {_u('3', 'contig', 'min(st)', _sq('n'))} AS u FROM regions GROUP BY contig) x) y""",
)
