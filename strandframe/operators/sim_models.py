"""What a simulation draws from: tables of fixed or small size, given as defaults or collected from fitted models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequence import BASES
from strandframe.operators.variants import DELETION, INSERTION, SNV

# Shares of variant classes, lengths and alternatives, and of sequencing errors, where no model is given.
MUTATION_RATE = 0.001
HOMOZYGOUS = 0.001
TYPE_SHARES = ((INSERTION, 0.03), (DELETION, 0.02), (SNV, 0.95))
INSERTION_LENGTHS = ((1, 0.4), (2, 0.2), (3, 0.1), (4, 0.05), (5, 0.05), (6, 0.05), (7, 0.05), (8, 0.034), (9, 0.033), (10, 0.033))
DELETION_LENGTHS = ((1, 0.3), (2, 0.2), (3, 0.2), (4, 0.2), (5, 0.1))
TRANSITION, TRANSVERSION = 0.7, 0.15
ERROR_RATE = 0.009228843915252066
ERROR_SHARES = ((INSERTION, 0.004), (DELETION, 0.006), (SNV, 0.99))
ERROR_LENGTHS = ((1, 0.999), (2, 0.001))
ERROR_TRANSITIONS = ((0.0, 0.4918, 0.3377, 0.1705), (0.5238, 0.0, 0.2661, 0.2101), (0.3755, 0.2355, 0.0, 0.389), (0.2505, 0.2552, 0.4943, 0.0))

TRINUCLEOTIDES = tuple(a + b + c for a in BASES for b in BASES for c in BASES)
#: The base that a transition leads to.
PARTNER = dict(zip("AGCT", "GATC", strict=True))


class ModelError(ValueError):
    """A model whose tables are missing or do not fit together."""


def _shares(pairs) -> tuple:
    pairs = tuple((v, float(p)) for v, p in pairs if p)
    if not pairs or abs(sum(p for _, p in pairs) - 1) > 1e-6:
        raise ModelError("shares must add up to 1")
    return pairs


@dataclass(frozen=True)
class Mutations:
    """Rate, classes, lengths, alternatives by context ``(tri, alt, p)`` and bias of places ``(tri, p)``; no contexts: by
    base, transitions first; no bias: all places alike."""

    rate: float = MUTATION_RATE
    homozygous: float = HOMOZYGOUS
    types: tuple = TYPE_SHARES
    insertions: tuple = INSERTION_LENGTHS
    deletions: tuple = DELETION_LENGTHS
    alleles: tuple = ()
    bias: tuple = ()

    def __post_init__(self):
        for name in ("types", "insertions", "deletions"):
            _shares(getattr(self, name))
        if any(p < 0 for _, p in self.bias) or self.bias and not any(p for _, p in self.bias):
            raise ModelError("the bias of places must not be negative, nor all zero")

    def alternatives(self) -> dict[str, list[tuple[str, float]]]:
        """By context the other bases and their shares up to each; all alike where a context has none."""
        given = {(tri, alt[1] if len(alt) == 3 else alt): p for tri, alt, p in self.alleles}
        out = {}
        for tri in TRINUCLEOTIDES:
            ref = tri[1]
            rest = [b for b in BASES if b != ref]
            weight = [given.get((tri, b), 0.0) for b in rest] if given else [TRANSITION if b == PARTNER[ref] else TRANSVERSION for b in rest]
            weight = weight if sum(weight) else [1.0] * 3
            out[tri] = list(zip(rest, np.cumsum(weight) / sum(weight), strict=True))
        return out

    def place_weights(self) -> np.ndarray:
        """By index of the trinucleotide around a place."""
        found = dict(self.bias)
        return np.array([found.get(t, 0.0) if found else 1.0 for t in TRINUCLEOTIDES])

    @staticmethod
    def fitted(tables: dict[str, DataFrame]) -> "Mutations":
        """From the tables of a fitted mutation model, all of fixed size but the lengths."""
        rows = {n: t.collect() for n, t in tables.items() if n in ("types", "trinucleotides", "bias", "lengths", "rate", "homozygous")}
        of = lambda kind, default: tuple(sorted((int(r["len"]), r["p"]) for r in rows["lengths"] if r["kind"] == kind)) or default
        types = tuple((k, sum(r["p"] for r in rows["types"] if r["type"] == k)) for k in (INSERTION, DELETION, SNV))
        known = sum(p for _, p in types)
        if not known:
            raise ModelError("a mutation model without insertions, deletions or SNVs")
        bias = tuple(sorted((r["tri"], r["p"]) for r in rows["bias"]))
        return Mutations(
            rate=rows["rate"][0]["rate"] or 0.0,
            homozygous=rows["homozygous"][0]["p"] if rows.get("homozygous") else HOMOZYGOUS,
            types=tuple((k, p / known) for k, p in types),
            insertions=of(INSERTION, INSERTION_LENGTHS),
            deletions=of(DELETION, DELETION_LENGTHS),
            alleles=tuple(sorted((r["ref_tri"], r["alt_tri"], r["p"]) for r in rows["trinucleotides"] if r["p"])),
            bias=bias if any(p for _, p in bias) else (),
        )


def snv_alternative(u: Column, tri: Column, model: Mutations) -> Column:
    """The base that replaces the middle of a context, by its shares; null where the context holds another letter."""
    rows = [(F.lit(t), F.array(*[F.struct(F.lit(b).alias("b"), F.lit(float(p) if n < 2 else 2.0).alias("upto")) for n, (b, p) in enumerate(alts)])) for t, alts in model.alternatives().items()]
    options = F.try_element_at(F.create_map(*[x for pair in rows for x in pair]), tri)
    return F.get(F.filter(options, lambda o: u < o["upto"]), F.lit(0))["b"]


@dataclass(frozen=True)
class Errors:
    """Sequencing errors: their rate, classes, lengths, and the shares of other bases for each of ACGT."""

    rate: float = ERROR_RATE
    types: tuple = ERROR_SHARES
    lengths: tuple = ERROR_LENGTHS
    transitions: tuple = ERROR_TRANSITIONS

    def __post_init__(self):
        _shares(self.types)
        _shares(self.lengths)
        if np.shape(self.transitions) != (4, 4):
            raise ModelError("transitions must be 4 by 4")


def _default_moments(length: int = 151) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """By place: a plateau that falls off towards the end of a read, while the spread grows."""
    t = np.arange(length) / (length - 1)
    mean = 35.2 - 0.5 * t - 2.5 * t**4 - 3.7 * t**20
    sd = 5.4 + 0.6 * t + 2.2 * t**4 + 2.05 * t**20
    return tuple(mean.tolist()), tuple(sd.tolist())


@dataclass(frozen=True)
class Qualities:
    """Normal qualities by place, rounded, within 1 and 42, down to the next bin where there are bins; or, uniform, the
    one quality of the error rate."""

    mean: tuple = field(default_factory=lambda: _default_moments()[0])
    sd: tuple = field(default_factory=lambda: _default_moments()[1])
    bins: tuple = ()
    uniform: float | None = None

    @staticmethod
    def fitted(moments: DataFrame, bins: tuple = ()) -> "Qualities":
        rows = sorted((r["pos"], r["mean"], r["sd"]) for r in moments.collect())
        if not rows:
            raise ModelError("a quality model without places")
        return Qualities(tuple(r[1] for r in rows), tuple(r[2] for r in rows), bins)


@dataclass(frozen=True)
class MarkovQualities:
    """A chain over places: the first quality's shares, those of each place, and those after each quality of a place."""

    initial: tuple  # (q, p)
    marginal: tuple  # by place: (q, p)
    transitions: tuple  # by place: (q, ((next, p), ...))
    top: int = 42

    @staticmethod
    def fitted(tables: dict[str, DataFrame], top: int = 42) -> "MarkovQualities":
        initial = tuple(sorted((r["q"], r["p"]) for r in tables["initial"].collect()))
        by_pos: dict[int, list] = {}
        for r in tables["marginal"].collect():
            by_pos.setdefault(r["pos"], []).append((r["q"], r["p"]))
        after: dict[tuple[int, int], list] = {}
        for r in tables["transitions"].collect():
            after.setdefault((r["pos"], r["q"]), []).append((r["q_next"], r["p"]))
        if not initial or not by_pos:
            raise ModelError("a quality model without places")
        length = max(by_pos) + 1
        rows = tuple(tuple((q, tuple(sorted(n))) for (p, q), n in sorted(after.items()) if p == i) for i in range(length - 1))
        return MarkovQualities(initial, tuple(tuple(sorted(by_pos.get(i, [(0, 1.0)]))) for i in range(length)), rows, top)


def load(spark, folder: str, *names: str) -> dict[str, DataFrame]:
    """A model's tables, a Parquet folder each."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException as e:
            raise ModelError(f"{folder} has no table {name}") from e
    return out
