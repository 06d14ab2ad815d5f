"""Run configuration and run summaries: plain files read and written by the driver."""

from __future__ import annotations

import json
import logging
import secrets
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timezone

from strandframe.session import exists, write_file

log = logging.getLogger("strandframe")

SCHEMA_VERSION = 1


class ConfigError(ValueError):
    """A key that is unknown, of the wrong type or out of its range."""


class SummaryError(ValueError):
    """A run summary that is missing, no JSON or of another version."""


@dataclass(frozen=True)
class RunConfig:
    """What a simulation needs; a value of '.' in a file means the default."""

    reference: str
    output: str
    read_length: int = 151
    coverage: float = 10.0
    paired: bool = False
    fragment_mean: float | None = None
    fragment_sd: float | None = None
    ploidy: int = 2
    mutation_rate: float | None = None
    error_rate: float | None = None
    target_bed: str | None = None
    discard_bed: str | None = None
    mutation_bed: str | None = None
    include_vcf: str | None = None
    mutation_model: str | None = None
    error_model: str | None = None
    fragment_model: str | None = None
    gc_model: str | None = None
    quality_bins: list | None = None
    uniform_quality: bool = False
    quality_offset: int = 33
    min_mutations: int = 0
    produce_fastq: bool = True
    produce_bam: bool = False
    produce_vcf: bool = False
    seed: int | None = None
    overwrite: bool = False


RANGES = {"read_length": (10, 10**6), "coverage": (0.0001, 10**6), "fragment_mean": (10, 10**7), "fragment_sd": (0, 10**6), "ploidy": (1, 100), "mutation_rate": (0, 0.3), "error_rate": (0, 0.3), "quality_offset": (33, 64), "min_mutations": (0, 10**9)}


#: Other names of keys, and keys that ask for what Spark decides or what has no effect here.
OTHER_NAMES = {"read_len": "read_length", "avg_seq_error": "error_rate", "paired_ended": "paired", "fragment_st_dev": "fragment_sd", "rng_seed": "seed", "overwrite_output": "overwrite", "output_dir": "output"}
WITHOUT_EFFECT = ("threads", "parallel_block_size", "no_coverage_bias", "rescale_qualities")


def from_dict(values: dict) -> RunConfig:
    known = {f.name: f for f in fields(RunConfig)}
    if twice := [k for k, v in OTHER_NAMES.items() if k in values and v in values]:
        raise ConfigError(f"given under two names: {', '.join(twice)}")
    values = {OTHER_NAMES.get(k, k): v for k, v in values.items()}
    for name in WITHOUT_EFFECT:
        if values.pop(name, ".") not in (".", None):
            log.warning("%s has no effect", name)
    if unknown := sorted(set(values) - set(known)):
        raise ConfigError(f"unknown keys: {', '.join(unknown)}")
    given = {k: v for k, v in values.items() if v not in (".", None)}
    for name in ("reference", "output"):
        if name not in given:
            raise ConfigError(f"{name} is needed")
    out = {}
    for name, value in given.items():
        kind = known[name].type.split(" | ")[0]
        if kind == "bool" and not isinstance(value, bool) or kind in ("int", "float") and (isinstance(value, bool) or not isinstance(value, (int, float) if kind == "float" else int)):
            raise ConfigError(f"{name} must be a {kind}")
        if name in RANGES and not RANGES[name][0] <= value <= RANGES[name][1]:
            raise ConfigError(f"{name} must be within {RANGES[name][0]} and {RANGES[name][1]}")
        if kind == "list" and not (isinstance(value, list) and value and all(isinstance(v, int) and 0 <= v <= 93 for v in value)):
            raise ConfigError(f"{name} must be a list of whole numbers of 0 to 93")
        out[name] = float(value) if kind == "float" else str(value) if kind == "str" else value
    if out.get("paired") and "fragment_model" not in out and not {"fragment_mean", "fragment_sd"} <= set(out):
        raise ConfigError("paired runs need fragment_mean and fragment_sd, or a fragment_model")
    out.setdefault("seed", 2**52 + secrets.randbelow(2**52))
    return RunConfig(**out)


def read_yaml(path: str) -> RunConfig:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})


def iso_utc(moment: datetime | None = None) -> str:
    return (moment or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_summary(spark, folder: str, config: RunConfig, outputs: dict, delivered: dict) -> str:
    """The summary as JSON, in whatever store the folder is, under another name until it is whole."""
    path = f"{folder.rstrip('/')}/run_summary.json"
    body = {"schema_version": SCHEMA_VERSION, "run": {"finished": iso_utc(), "seed": config.seed}, "config": asdict(config), "outputs": outputs, "delivered": delivered}
    write_file(spark, path, json.dumps(body, indent=2, sort_keys=True))
    return path


def read_summary(spark, folder: str) -> dict:
    path = f"{folder.rstrip('/')}/run_summary.json"
    if not exists(spark, path):
        raise SummaryError(f"{path} does not exist")
    try:
        body = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))
    except ValueError as e:
        raise SummaryError(f"{path} is no JSON: {e}") from e
    if not isinstance(body, dict) or body.get("schema_version") != SCHEMA_VERSION:
        raise SummaryError(f"{path} is not of version {SCHEMA_VERSION}")
    return body
