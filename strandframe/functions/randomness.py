"""Random numbers as functions of keys: the same in every partitioning, and in any engine that has md5."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """In [0, 1), from the first 52 bits of md5 of the key's parts joined by bars."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform_of(*key) -> float:
    """The number that uniform gives for the key, in Python."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


def normal(*key: Column | str | int) -> Column:
    u, v = uniform(*key, "a"), uniform(*key, "b")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def stochastic_round(x: Column, *key: Column | str | int) -> Column:
    """The whole part, and one more with the probability of the rest; 0 for what is not positive."""
    whole = F.floor(x)
    return F.when(x <= 0, 0).otherwise(whole + (uniform(*key) < x - whole).cast("long")).cast("long")


def categorical(u: Column, shares: list[tuple[object, float]]) -> Column:
    """The value in whose cumulative share u falls; the last one where rounding leaves some."""
    total, at = sum(p for _, p in shares), 0.0
    out = None
    for value, p in shares[:-1]:
        at += p / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    last = F.lit(shares[-1][0])
    return last if out is None else out.otherwise(last)


# Coefficients of a rational approximation of the normal quantile (relative error under 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416)


def normal_quantile(u: Column) -> Column:
    """The standard normal's quantile of u, which is held within 1e-15 of 0 and 1."""
    u = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), u))

    def along(x, coefficients):
        out = F.lit(0.0)
        for k in coefficients:
            out = out * x + F.lit(k)
        return out

    middle, low = u - 0.5, F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    r = middle * middle
    tail = along(low, _C) / (along(low, _D) * low + 1)
    return F.when(F.abs(middle) <= 0.47575, middle * along(r, _A) / (along(r, _B) * r + 1)).otherwise(F.when(middle < 0, tail).otherwise(-tail))


def poisson(mean: Column, u: Column, most: int = 400) -> Column:
    """Inverse of the distribution function up to a mean of 50; beyond it a rounded normal of the same u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(s, i):
        p = s["p"] * mean / i
        go = u >= s["c"]
        return F.struct(F.when(go, p).otherwise(s["p"]).alias("p"), F.when(go, s["c"] + p).otherwise(s["c"]).alias("c"), F.when(go, i).otherwise(s["k"]).alias("k"))

    # far enough for any u of 52 bits, and no farther
    steps = F.least(F.lit(most), F.ceil(F.least(mean, F.lit(50.0)) + 9 * F.sqrt(F.greatest(mean, F.lit(0.0)) + 1) + 12).cast("int"))
    small = F.aggregate(F.sequence(F.lit(1), steps), start, step)["k"].cast("long")
    quantile = normal_quantile(u)
    return F.when(mean <= 0, F.lit(0).cast("long")).when(mean <= 50, small).otherwise(F.greatest(F.lit(0).cast("long"), F.rint(mean + F.sqrt(mean) * quantile).cast("long")))


def duck_normal_quantile(u: str) -> str:
    """The SQL text of normal_quantile for DuckDB, within 1e-15 of 0 and 1."""

    def along(x, coefficients):
        out = "0.0"
        for k in coefficients:
            out = f"({out} * {x} + ({k!r}))"
        return out

    middle, low = f"({u} - 0.5)", f"sqrt(-2 * ln(least({u}, 1 - {u})))"
    r = f"({middle} * {middle})"
    tail = f"({along(low, _C)} / ({along(low, _D)} * {low} + 1))"
    return f"CASE WHEN abs({middle}) <= 0.47575 THEN {middle} * {along(r, _A)} / ({along(r, _B)} * {r} + 1) WHEN {middle} < 0 THEN {tail} ELSE -{tail} END"


def duck_uniform(*key: str) -> str:
    """The SQL text of uniform for DuckDB; parts are SQL expressions."""
    joined = ", '|', ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(('0x' || substr(md5(concat({joined})), 1, 13))::BIGINT / pow(2, 52))"
