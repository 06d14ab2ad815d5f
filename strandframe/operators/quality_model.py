"""Base qualities: decoding, bins, histograms, transitions, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decoded(text: Column, offset: int = 33) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset)


def encoded(qualities: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(qualities, lambda q: F.char(q + offset)), "")


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def binned(q: Column, allowed: list[int]) -> Column:
    """The greatest allowed value up to q, else the least; q where nothing is given."""
    if not allowed:
        return q
    values = F.array(*[F.lit(v) for v in sorted(set(allowed))])
    return F.coalesce(F.array_max(F.filter(values, lambda v: v <= q)), F.array_min(values))


def prepared_bins(allowed: int | list[int]) -> list[int]:
    """0 to n for a number (or one in a list), the sorted different values of a list."""
    if isinstance(allowed, list) and len(allowed) == 1:
        allowed = allowed[0]
    return list(range(allowed + 1)) if isinstance(allowed, int) else sorted(set(allowed))


def conforming(reads: DataFrame, length: int, q: str = "q") -> DataFrame:
    return reads.where(F.size(q) == length)


def limited(reads: DataFrame, n: int, number: str = "record_no") -> DataFrame:
    """The first n records by number, the same ones in every run."""
    return reads.where(F.col(number) < n)


def by_position(reads: DataFrame, q: str = "q") -> DataFrame:
    """``pos, q, n``."""
    return reads.select(F.posexplode(q).alias("pos", "q")).groupBy("pos", "q").agg(F.count("*").alias("n"))


def moments(counts: DataFrame) -> DataFrame:
    """``pos, mean, sd`` (of the population) from the histogram."""
    n, s, s2 = F.sum("n"), F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * F.col("q") * F.col("q"))
    return counts.groupBy("pos").agg((s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s / n) * (s / n))).alias("sd"))


def mean_error(counts: DataFrame) -> DataFrame:
    return counts.agg((F.sum(error_probability(F.col("q")) * F.col("n")) / F.sum("n")).alias("error"))


def mean_error_of_files(*counts: DataFrame) -> DataFrame:
    """The mean of the files' mean errors, each file counted alike."""
    each = mean_error(counts[0])
    for more in counts[1:]:
        each = each.unionByName(mean_error(more))
    return each.agg(F.avg("error").alias("error"))


def greatest_quality(counts: DataFrame, allowed: list[int] | None = None) -> DataFrame:
    """``top``: the greatest quality seen, at most the greatest that is allowed."""
    top = F.max("q")
    return counts.agg((F.least(top, F.lit(max(allowed))) if allowed else top).alias("top"))


def initial(reads: DataFrame, q: str = "q") -> DataFrame:
    return reads.where(F.size(q) > 0).groupBy(F.col(q)[0].alias("q")).agg(F.count("*").alias("n"))


def transitions(reads: DataFrame, q: str = "q") -> DataFrame:
    """``pos, q, q_next, n``: each value with the next one of its read, without a shuffle of the reads."""
    pairs = F.arrays_zip(F.slice(q, F.lit(1), F.size(q) - 1).alias("a"), F.slice(q, F.lit(2), F.size(q) - 1).alias("b"))
    rows = reads.where(F.size(q) > 1).select(F.posexplode(pairs).alias("pos", "z"))
    return rows.groupBy("pos", F.col("z.a").alias("q"), F.col("z.b").alias("q_next")).agg(F.count("*").alias("n"))


def shares(counts: DataFrame, *within: str) -> DataFrame:
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*within))).drop("n")


def position_for_length(pos: Column, length: int, model_length: int) -> Column:
    """The model's position for a position of a read of another length."""
    if length <= 1:
        return F.lit(0)
    at = F.rint(pos / F.lit(length - 1) * F.lit(model_length - 1)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(model_length - 1), at))


def row_for_length(i: Column, length: int, model_length: int) -> Column:
    return F.floor(F.lit(model_length) * i / F.lit(length)).cast("int")


def markov_model(reads: DataFrame, length: int, allowed: list[int] | None = None, q: str = "q") -> dict[str, DataFrame]:
    """initial, marginal and transition shares of reads of the length."""
    rows = conforming(reads, length, q)
    if allowed:
        rows = rows.withColumn(q, F.transform(q, lambda v: binned(v, allowed)))
    return {"initial": shares(initial(rows, q)), "marginal": shares(by_position(rows, q), "pos"), "transitions": shares(transitions(rows, q), "pos", "q")}
