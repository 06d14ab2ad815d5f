"""Queries that simulate; draws are functions of keys, so that SQL can make all but the letters of reads again."""

from __future__ import annotations

from strandframe.functions.randomness import duck_normal_quantile, duck_uniform
from strandframe.operators import simulate as S
from strandframe.operators.sim_models import Mutations
from strandframe.plans.views import view, with_views
from strandframe.session import small_batches, stored

Q: dict = {}
O: dict[str, str] = {}
SETTINGS = S.Settings(coverage=2.0, seed=17, mutations=Mutations(rate=0.002))
WEIGHTED = S.Settings(coverage=2.0, seed=17, gc_weights=tuple((i + 1) / 101 for i in range(101)))


def _contigs(spark, d):
    small_batches(spark)
    # used by several branches of a plan, which would each make the sequences anew
    return stored(view(spark, d, "contigs").select("contig", "length", "seq"), "contigs")


Q["r1_placements"] = lambda spark, d: S.placements(_contigs(spark, d), SETTINGS)
Q["r1_gc_placements"] = lambda spark, d: S.placements(_contigs(spark, d), WEIGHTED)
Q["r4_variants"] = lambda spark, d: S.variants(_contigs(spark, d), SETTINGS)


def reads(spark, d):
    c = _contigs(spark, d)
    return S.reads(c, S.placements(c, SETTINGS), S.variants(c, SETTINGS), SETTINGS)


Q["c2_reads"] = reads


def _u(*key) -> str:
    return duck_uniform("17", "contig", *key)


_PER, _NEED = 2 * SETTINGS.read_length, SETTINGS.read_length + S.MIN_MATE_EXTRA


def _normal(a: int) -> str:
    u, v = (_u("read_no", str(a), "'len'", f"'{x}'") for x in "ab")
    return f"sqrt(-2 * ln(1 - {u})) * cos({2 * 3.141592653589793!r} * {v})"


def _round(x: str, *key) -> str:
    return f"CAST(floor({x}) + CASE WHEN {_u(*key)} < {x} - floor({x}) THEN 1 ELSE 0 END AS BIGINT)"


_ENDS = ", ".join(f"least(start + CAST(abs(round_even({SETTINGS.fragment_mean} + {SETTINGS.fragment_sd} * {_normal(a)}, 0)) AS BIGINT), length)" for a in range(SETTINGS.attempts))
_PLACED = f"""SELECT contig, length, read_no, start AS s1, start + {SETTINGS.read_length} AS e1, e - {SETTINGS.read_length} AS s2, e AS e2 FROM
(SELECT contig, length, read_no, start, coalesce(list_filter([{_ENDS}], lambda e: e - start >= {_NEED})[1], start + {_NEED}) AS e FROM {{starts}} s) x"""
O["r1_placements"] = with_views(
    _PLACED.format(
        starts=f"""(SELECT contig, length, read_no, CAST(floor({_u('read_no', "'start'")} * (length - {_NEED} + 1)) AS BIGINT) AS start FROM
(SELECT contig, length, unnest(range(0, {_round(f"(length * {SETTINGS.coverage}::DOUBLE / {_PER})", "'reads'")})) AS read_no FROM contigs WHERE length >= {_NEED}) r)"""
    ),
    "contigs",
)
_TAIL = _NEED - WEIGHTED.gc_window
O["r1_gc_placements"] = with_views("", "contigs").rstrip() + f""",
w AS (SELECT contig, pos, sum(weight) OVER (PARTITION BY contig ORDER BY pos) AS upto, weight FROM (SELECT contig, pos, (CAST(round_even(gc, 0) AS INTEGER) + 1) / 101.0::DOUBLE AS weight, rest FROM
  (SELECT contig, pos, length - {_TAIL} AS rest, sum(CASE WHEN b IN ('G','C') THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS gc
   FROM (SELECT contig, length, unnest(range(0, length - {_TAIL})) AS pos, unnest(string_split(substr(seq, 1, CAST(length - {_TAIL} AS INT)), '')) AS b FROM contigs WHERE length >= {_NEED}) l) y) z WHERE pos <= rest - 100),
t AS (SELECT contig, sum(weight) AS total, count(*) AS windows FROM w GROUP BY contig),
n AS (SELECT contig, length, total, unnest(range(0, {_round("x", "'gc'")})) AS read_no FROM (SELECT c.contig, c.length, t.total, c.length * {WEIGHTED.coverage}::DOUBLE / {_PER} * t.total / t.windows / (SELECT sum(total) / sum(windows) FROM t) AS x FROM contigs c JOIN t ON t.contig = c.contig) q),
s AS (SELECT contig, length, read_no, {_u("read_no", "'gc'")} * total AS at FROM n)
""" + _PLACED.format(starts="(SELECT s.contig, s.length, s.read_no, w.pos AS start FROM s JOIN w ON w.contig = s.contig AND s.at >= w.upto - w.weight AND s.at < w.upto)")


def _cumulative(pairs, u: str) -> str:
    at, total, out = 0.0, sum(p for _, p in pairs), []
    for value, p in pairs[:-1]:
        at += p / total
        out.append(f"WHEN {u} < {at!r} THEN {value!r}")
    return f"CASE {' '.join(out)} ELSE {pairs[-1][0]!r} END"


_M = SETTINGS.mutations
_LONGEST = max(n for n, _ in _M.deletions) + 1
_v = lambda *slot: _u("0", "i", *slot)
O["r4_variants"] = with_views("", "contigs").rstrip() + f""",
p AS (SELECT contig, length AS total, seq, mean, {_u("0", "'n'")} AS u FROM (SELECT contig, length, seq, length * {_M.rate}::DOUBLE AS mean FROM contigs) a),
k AS (SELECT contig, count(*) AS n FROM (SELECT contig, u, sum(exp(j * ln(mean) - mean - lgamma(j + 1))) OVER (PARTITION BY contig ORDER BY j) AS upto FROM (SELECT contig, mean, u, unnest(range(0, 200)) AS j FROM p WHERE mean <= 50) b) d WHERE upto <= u GROUP BY contig
  UNION ALL SELECT contig, greatest(0, CAST(round_even(mean + sqrt(mean) * ({duck_normal_quantile("u")}), 0) AS BIGINT)) FROM p WHERE mean > 50),
c AS (SELECT p.contig, p.total, p.seq, unnest(range(1, least(k.n, CAST(round_even(2 * p.mean, 0) AS BIGINT)) + 1)) AS i FROM p JOIN k ON k.contig = p.contig WHERE p.total > 2),
d AS (SELECT *, {_cumulative(_M.types, _v("'type'"))} AS type, 1 + CAST(floor({_v("'window'")} * (total - 2)) AS BIGINT) AS begins FROM c),
e AS (SELECT *, begins + CAST(floor({_v("'pos'")} * least({S.WINDOW}, total - 1 - begins)) AS BIGINT) AS pos, CASE type WHEN 'INS' THEN {_cumulative(_M.insertions, _v("'len'"))} WHEN 'DEL' THEN {_cumulative(_M.deletions, _v("'len'"))} ELSE 0 END AS size FROM d),
f AS (SELECT *, substr(seq, CAST(pos + 1 AS INT), CASE WHEN type = 'DEL' THEN size + 1 ELSE 1 END) AS ref, {_v("'alt'")} AS ua FROM e),
g AS (SELECT contig, i, pos, type, ref, CASE type WHEN 'DEL' THEN ref[1] WHEN 'INS' THEN concat(ref, array_to_string(list_transform(range(1, size + 1), lambda x: substr('ACGT', CAST(floor({_v("'ins'", "x")} * 4) + 1 AS INT), 1)), ''))
  ELSE CASE ref WHEN 'A' THEN CASE WHEN ua < 0.15 THEN 'C' WHEN ua < 0.85 THEN 'G' ELSE 'T' END WHEN 'C' THEN CASE WHEN ua < 0.15 THEN 'A' WHEN ua < 0.3 THEN 'G' ELSE 'T' END
  WHEN 'G' THEN CASE WHEN ua < 0.7 THEN 'A' WHEN ua < 0.85 THEN 'C' ELSE 'T' END ELSE CASE WHEN ua < 0.15 THEN 'A' WHEN ua < 0.85 THEN 'C' ELSE 'G' END END END AS alt,
  CASE WHEN {_v("'hom'")} < {_M.homozygous} THEN '1/1' WHEN {_v("'ploid'", "0")} <= {_v("'ploid'", "1")} THEN '1/0' ELSE '0/1' END AS gt
  FROM f WHERE pos + length(ref) < total AND (type <> 'DEL' OR length(ref) = size + 1)),
h AS (SELECT *, max(pos + length(ref)) OVER (PARTITION BY contig ORDER BY pos, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT contig, pos, pos AS line_no, type, CAST(length(ref) - length(alt) AS INTEGER) AS shrink, ref, alt, gt FROM h WHERE before IS NULL OR pos >= before"""
