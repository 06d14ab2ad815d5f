from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandframe.plans import catalog
from strandframe.plans.views import view

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seqs(spark):
    return {r["contig"]: r["seq"] for r in view(spark, D, "contigs").collect()}


def rows(spark, name):
    return catalog.QUERIES[name](spark, D).collect()


def test_weights_of_all_contigs(spark, seqs):
    n = Counter(round(100 * (s.count("G", i, i + 100) + s.count("C", i, i + 100)) / 100) for s in seqs.values() for i in range(len(s) - 99))
    got = {r["gc_pct"]: (r["running"], r["total"]) for r in rows(spark, "w8_cumulative_weights")}
    assert got == {g: (sum(v for k, v in n.items() if k <= g), sum(n.values())) for g in n}
    assert rows(spark, "a25_genome_mean_weight")[0]["mean"] == pytest.approx(sum(v * (g % 7 + 1) / 7 for g, v in n.items()) / sum(n.values()), abs=1e-6)


def test_kmers_and_places_of_all_contigs(spark, seqs):
    percent = lambda s, i: round(s.count("G", i, i + 100) + s.count("C", i, i + 100))
    got = {r["contig"]: (r["windows"], r["weight"]) for r in rows(spark, "j13_weight_lookup")}
    assert got == {k: (len(s) - 99, pytest.approx(sum(percent(s, i) % 7 + 1 for i in range(len(s) - 99)) / 7, abs=1e-5)) for k, s in seqs.items() if len(s) >= 100}
    assert {r["contig"]: r["places"] for r in rows(spark, "j14_local_bias")} == {k: len(s) - 2 for k, s in seqs.items() if len(s) > 2}


def test_all_contigs_are_resolved(spark):
    raw = {r["contig"]: r["seq"] for r in view(spark, D, "raw_contigs").collect()}
    got = {r["contig"]: r["seq"] for r in rows(spark, "p2_resolved")}
    codes = {"R": "AG", "Y": "CT", "K": "GT", "M": "AC"}
    assert got.keys() == raw.keys()
    assert all(len(got[k]) == len(s) and all(b in codes.get(a, a) for a, b in zip(s, got[k], strict=True)) for k, s in raw.items())


def test_all_regions_are_folded(spark):
    regions = defaultdict(list)
    for r in view(spark, D, "regions").collect():
        regions[r["contig"]].append((r["line_no"], r["st"], r["en"]))
    lengths = {r["contig"]: r["length"] for r in view(spark, D, "chroms").collect()}
    want = set()
    for k, length in lengths.items():
        at = 0
        for _, st, en in sorted(regions[k]):
            if st >= at:
                want |= {(k, st, en)} | ({(k, at, st)} if st > at else set())
                at = en
        want |= {(k, at, length)} if at < length else set()
    assert {(r["contig"], r["st"], r["en"]) for r in rows(spark, "w3_fill_gaps")} == want
    assert {r["contig"]: r["bases"] for r in rows(spark, "w3_gap_bases")} == {k: sum(e - s for c, s, e in want if c == k) for k in lengths}


def test_all_variants(spark):
    typed = view(spark, D, "typed").collect()
    by = defaultdict(list)
    for r in typed:
        by[r["contig"]].append((r["pos"], r["line_no"], r["ref"], r["alt"]))
    want = Counter((k, v[0], n) for k, vs in by.items() for n, v in enumerate(sorted(vs), 1))
    assert Counter((r["contig"], r["pos"], r["place"]) for r in rows(spark, "t3_sorted_variants")) == want
    kind = lambda r: "SNV" if len(r["ref"]) == len(r["alt"]) == 1 else "DEL" if r["ref"].startswith(r["alt"]) else "INS" if r["alt"].startswith(r["ref"]) else "UNK"
    deep = [(r["contig"], r["pos"] % 500, r["gt"], r["line_no"], kind(r), r) for r in typed if r["ref"] != r["alt"]]
    at = defaultdict(list)
    for k, p, gt, line, *_ in deep:
        at[k, p, gt].append(line)
    for which, side in (("DEL", "ref"), ("INS", "alt")):
        met = {(line, own) for k, p, gt, own, t, r in deep if t == which for q in range(p, p + len(r[side])) for line in at[k, q, gt] if line != own}
        assert {r["line_no"]: r["n"] for r in rows(spark, f"j12_under_{which.lower()}")} == Counter(line for line, _ in met)


def test_all_misses_have_reasons_and_draws(spark):
    typed = Counter((r["line_no"], r["contig"], r["pos"]) for r in view(spark, D, "typed").collect())
    key = lambda found: Counter((r["line_no"], r["contig"], r["pos"]) for r in found)
    known = {r["contig"] for r in view(spark, D, "chroms").collect() if r["length"] % 3 > 0}
    spans = [defaultdict(list), defaultdict(list)]
    for r in view(spark, D, "regions").collect():
        if r["flag"] or r["rate"] < 0.2:
            spans[r["flag"]][r["contig"]].append((r["st"], r["en"]))
    inside = lambda i, k, p: any(a <= p < b for a, b in spans[i][k])
    names = {(True, True): "unknown", (True, False): "outside_target_bed", (False, True): "outside_mutation_bed", (False, False): "outside_mutation_bed,outside_target_bed"}
    reason = lambda k, p: names[inside(0, k, p), inside(1, k, p)] if k in known else "outside_simulated_contigs"
    found = rows(spark, "j10_attributed")
    assert key(found) == typed and all(r["reasons"] == reason(r["contig"], r["pos"]) for r in found)
    assert {r["reason"]: r["n"] for r in rows(spark, "a29_reason_counts")} == Counter(x for r in found for x in r["reasons"].split(","))
    for r in (noted := rows(spark, "k9_annotated")):
        assert r["info"] == ("" if r["line_no"] % 2 == 0 else "DP=3;") + "MISS_REASON=" + reason(r["contig"], r["pos"])
    assert key(noted) == typed
    for name, column, allowed in (("r11_ploids", "gt", "1/1 1/0 0/1".split()), ("r8_inserted_bases", "bases", None)):
        found = rows(spark, name)
        assert key(found) == typed and all(r[column] in allowed if allowed else len(r[column]) == r["line_no"] % 4 and set(r[column]) <= set("ACGT") for r in found)


def test_whole_sequences_are_looked_at(spark, seqs):
    assert {r["contig"]: r["runs"] for r in rows(spark, "p23_run_lengths")} == {k: "".join(f"{len(list(g))}{b}" for b, g in groupby(s)) for k, s in seqs.items()}
    want = {(k, i) for k, s in seqs.items() for i in range(len(s)) if s.startswith("A" if i % 3 == 0 else "CG", i)}
    assert {(r["contig"], r["pos"]) for r in rows(spark, "f7_reference_matches")} == want
