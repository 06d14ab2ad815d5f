import json

import numpy as np
import pytest

from strandframe import cli
from strandframe.plans import config, runs
from strandframe.sources import bam
from strandframe.sources import text as T


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    rng = np.random.default_rng(3)
    (folder / "ref.fa").write_text("".join(f">{c}\n{''.join(rng.choice(list('ACGT'), n))}\n" for c, n in (("c1", 4000), ("c2", 3000), ("tiny", 20))))
    given = {"reference": str(folder / "ref.fa"), "output": str(folder / "out"), "read_length": 50, "coverage": 4, "paired": True, "fragment_mean": 200, "fragment_sd": 20, "mutation_rate": 0.01, "produce_bam": True, "produce_vcf": True, "seed": 42, "target_bed": "."}
    made = config.from_dict(given)
    return folder, made, runs.simulate(spark, made)


def test_outputs_agree(spark, run):
    folder, made, delivered = run
    summary = config.read_summary(spark, str(folder / "out"))
    assert summary["delivered"] == delivered and delivered["contigs_simulated"] == ["c1", "c2"]
    one, two = (T.read_fastq(spark, str(folder / f"out/fastq_{i}")).count() for i in (1, 2))
    back = bam.read_bam(spark, str(folder / "out/bam"))
    assert one == two and one + two == delivered["reads"] == back.count() == 560
    truth = T.read_vcf(spark, str(folder / "out/vcf"))
    assert truth.count() == sum(delivered["variants"].values()) > 20


def test_compare_and_fit(spark, run):
    folder, made, delivered = run
    vcf = str(folder / "out/vcf")
    n = sum(delivered["variants"].values())
    same = runs.compare(spark, vcf, vcf, config.read_summary(spark, str(folder / "out")))
    assert same["counts"] == {"TP": n} and same["metrics"]["f1"] == 1 and same["reasons"] == {}
    (folder / "none.vcf").write_text("#CHROM\tPOS\n")
    missed = runs.compare(spark, vcf, str(folder / "none.vcf"), config.read_summary(spark, str(folder / "out")))
    assert missed["counts"] == {"FN": n} and missed["reasons"] == {"unknown": n}
    assert runs.fit_mutations(spark, made.reference, vcf, str(folder / "model"))["trinucleotides"] == 192


def test_config_is_checked(spark, tmp_path):
    base = {"reference": "r", "output": "o"}
    for bad in ({"coverage": 0}, {"read_length": "x"}, {"ploidy": 0}, {"nonsense": 1}, {"paired": True}):
        with pytest.raises(config.ConfigError):
            config.from_dict(base | bad)
    with pytest.raises(config.ConfigError):
        config.from_dict({"output": "o"})
    assert 2**52 <= config.from_dict(base).seed < 2**53 and config.from_dict(base | {"coverage": "."}).coverage == 10
    same = config.from_dict({"reference": "r", "output_dir": "o", "read_len": 80, "paired_ended": True, "fragment_mean": 300, "fragment_st_dev": 20, "rng_seed": 5, "threads": 4, "avg_seq_error": 0.01})
    assert (same.read_length, same.paired, same.fragment_sd, same.seed, same.error_rate) == (80, True, 20, 5, 0.01)
    with pytest.raises(config.ConfigError, match="two names"):
        config.from_dict(base | {"read_len": 80, "read_length": 90})
    with pytest.raises(config.SummaryError):
        config.read_summary(spark, str(tmp_path))
    (tmp_path / "run_summary.json").write_text('{"schema_version": 99}')
    with pytest.raises(config.SummaryError):
        config.read_summary(spark, str(tmp_path))


def test_outputs_are_not_overwritten_unasked(spark, run):
    folder, made, _ = run
    with pytest.raises(runs.OutputExists):
        runs.simulate(spark, made)
    with pytest.raises(FileNotFoundError):
        runs.simulate(spark, config.from_dict({"reference": str(folder / "nowhere.fa"), "output": str(folder / "x")}))


def call(monkeypatch, spark, capsys, *argv):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main([str(a) for a in argv]) == 0
    return json.loads(capsys.readouterr().out)


def test_every_command_end_to_end(spark, run, monkeypatch, capsys):
    folder, made, delivered = run
    go = lambda *argv: call(monkeypatch, spark, capsys, *argv)
    out = folder / "out"
    assert go("fit-mutations", made.reference, out / "vcf", folder / "m1")["trinucleotides"] == 192
    (folder / "part.bed").write_text("c1\t100\t2000\n")
    assert go("fit-mutations", made.reference, out / "vcf", folder / "m2", "--bed", folder / "part.bed")["bias"] > 40
    assert go("fit-fragments", out / "bam", folder / "f1")["moments"] == 1
    moments = spark.read.parquet(str(folder / "f1/moments")).first()
    assert 185 < moments["mean"] < 215 and moments["sd"] < 40
    assert go("fit-gc", made.reference, out / "bam", folder / "g1", "--width", 50)["weights"] == 101
    assert go("fit-errors", folder / "e1", out / "fastq_1", out / "fastq_2")["moments"] == 50
    assert go("fit-qualities", folder / "e2", out / "fastq_1", "--preset", "novaseq")["initial"] >= 1
    with pytest.raises(runs.OutputExists):
        go("fit-errors", folder / "e1", out / "fastq_1")
    for n, error_model in enumerate(("e1", "e2")):
        given = {"reference": made.reference, "output": str(folder / f"again{n}"), "read_length": 50, "coverage": 3, "paired": True, "seed": 7, "produce_vcf": True, "min_mutations": 2, "mutation_model": str(folder / "m1"), "error_model": str(folder / error_model), "fragment_model": str(folder / "f1"), "gc_model": str(folder / "g1")}
        (folder / "again.yml").write_text(json.dumps(given))
        again = go("simulate", folder / "again.yml")
        assert again["reads"] > 300 and sum(again["variants"].values()) >= 4
        quals = "".join(r["qual"] for r in T.read_fastq(spark, str(folder / f"again{n}/fastq_1")).select("qual").collect())
        assert n == 0 or {ord(c) - 33 for c in quals} <= {1, 2, 12, 23, 37}
    (folder / "round.yml").write_text(json.dumps({"reference": made.reference, "output": str(folder / "round"), "read_length": 50, "coverage": 4, "seed": 3}))
    turned = go("simulate-circular", folder / "round.yml")
    assert "c1_turned" in turned["contigs_simulated"] and 480 <= turned["reads"] <= 640
    (folder / "none.vcf").write_text("#CHROM\tPOS\n")
    (folder / "names.tsv").write_text("chr1\tc1\n")
    missed = go("compare", out / "vcf", folder / "none.vcf", out, "--aliases", folder / "names.tsv", "--out", folder / "report")
    assert missed["metrics"]["recall"] == 0 and json.loads((folder / "report/comparison.json").read_text()) == missed
    assert "recall" in (folder / "report/comparison.txt").read_text()
    noted = T.read_vcf(spark, str(folder / "report/missed")).collect()
    assert len(noted) == missed["counts"]["FN"] and all("MISS_REASON=unknown" in r["info"] for r in noted)


def test_included_variants_follow_the_reader_s_rules(spark, tmp_path):
    seq = "ACGTACGTACGTACGTACGT" * 10
    contigs = spark.createDataFrame([("c", len(seq), seq)], "contig string, length long, seq string")
    rows = [("c", 10, "C", "T,G", "GT:X", "1|2:0"), ("c", 20, "T", "A", "X", "3"), ("c", 30, "C", "G", "GT", "0/0"), ("c", 40, "A", "T", "GT", "0/1"), ("other", 5, "A", "T", "GT", "1/1"), ("c", 50, "C", "CTT", "GT", "1/1"), ("c", 50, "C", "CTT", "GT", "0/1")]
    text = "".join("\t".join([c, str(p), ".", r, a, ".", "PASS", "WP=1/0" if f == "X" else ".", f, s]) + "\n" for c, p, r, a, f, s in rows)
    (tmp_path / "in.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n" + text + "c\t60\t.\tT\tG\t.\tPASS\t.\n")
    got = {(r["pos"] + 1, r["alt"], r["gt"]) for r in runs.included(spark, str(tmp_path / "in.vcf"), contigs).collect()}
    fixed = {(10, "T", "1/0"), (10, "G", "0/1"), (20, "A", "1/0"), (50, "CTT", "1/1")}
    assert fixed <= got and {(p, a) for p, a, _ in got - fixed} == {(60, "G")}
    assert runs.inclusion_counts(spark, str(tmp_path / "in.vcf"), contigs) == {"taken": 6, "other_contigs": 1, "other_reference": 1}
