"""Read fields and transforms: names, flags, mates, CIGAR, errors, bins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def name(prefix: str, contig: Column, start: Column, end: Column) -> Column:
    """1-based, ten digits."""
    digits = lambda x: F.when(x.between(0, 10**10 - 1), F.lpad(x.cast("string"), 10, "0"))
    usual = F.concat(F.lit(f"{prefix}_"), contig, F.lit("_"), digits(start + 1), F.lit("_"), digits(end + 1))
    # others, and nulls, by the formatter, which takes longer
    return F.coalesce(usual, F.format_string(f"{prefix}_%s_%010d_%010d", contig, start + 1, end + 1))


def flags(paired_run: Column | bool, paired: Column, reverse: Column) -> Column:
    """SAM flags: a pair is proper, its first read forward and its second reverse."""
    run = F.lit(paired_run) if isinstance(paired_run, bool) else paired_run
    on = lambda c, v: F.when(c, v).otherwise(0)
    total = 1 + on(paired, 2) + on(~paired, 8) + on(reverse, 16) + on(~reverse & paired, 32 + 64) + on(reverse & paired, 128)
    return F.when(run, total).otherwise(0)


def mate_position(paired: Column, reverse: Column, first: Column, second: Column) -> Column:
    return F.when(~paired, 0).when(reverse, first).otherwise(second)


def template_length(paired: Column, reverse: Column, first: Column, end: Column) -> Column:
    span = end - first + 1
    return F.when(~paired | (span < 0), 0).when(reverse, -span).otherwise(span)


def padding(read_length: int) -> int:
    return read_length // 5


def segment(seq: Column, start: Column, end: Column, pad: int, reverse: bool) -> Column:
    """The read's part of the contig with room for deletions: after it, or before it for a reverse read."""
    lo = F.greatest(start - pad, F.lit(0)) if reverse else start
    hi = end if reverse else end + pad
    return F.substr(seq, (lo + 1).cast("int"), (hi - lo).cast("int"))


def with_errors(seq: Column, errors: Column) -> Column:
    """Splice errors ``loc, ref, alt`` (ascending, apart) into the sequence in one fold."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, e):
        out = F.concat(s["out"], F.substr(seq, s["at"] + 1, e["loc"] - s["at"]), e["alt"])
        return F.struct((e["loc"] + F.length(e["ref"])).alias("at"), out.alias("out"))

    return F.aggregate(errors, start, step, lambda s: F.concat(s["out"], F.substr(seq, s["at"] + 1)))


def error_qualities(qualities: Column, errors: Column, low: int) -> Column:
    """Qualities after the same splice: an insertion brings as many low ones as inserted bases, a deletion none, else one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s, e):
        n = F.when(F.length(e["alt"]) > 1, F.length(e["alt"]) - 1).when(F.length(e["ref"]) > 1, 0).otherwise(1)
        out = F.concat(s["out"], F.slice(qualities, s["at"] + 1, F.greatest(e["loc"] - s["at"], F.lit(0))), F.array_repeat(F.lit(low), n))
        return F.struct((e["loc"] + F.length(e["ref"])).alias("at"), out.alias("out"))

    return F.aggregate(errors, start, step, lambda s: F.concat(s["out"], F.slice(qualities, s["at"] + 1, F.greatest(F.size(qualities) - s["at"], F.lit(0)))))


def cigar(length: Column | int, indels: Column) -> Column:
    """CIGAR of a forward read with indels ``loc, kind ('I' or 'D'), len`` in ascending order of their anchors.

    Runs of the same kind do not meet: an anchor's base stands between two indels; what is left of the read is M.
    """
    n = length if isinstance(length, Column) else F.lit(length)
    start = F.struct(F.lit(0).alias("ref"), n.alias("left"), F.lit(0).alias("m"), F.lit("").alias("out"))

    def step(s, e):
        lead = F.least(F.greatest(e["loc"] - s["ref"] + 1, F.lit(0)), s["left"])
        left, m = s["left"] - lead, s["m"] + lead
        size = F.when(e["kind"] == "I", F.least(e["len"], left)).otherwise(e["len"])
        go = (left > 0) & (size > 0)
        out = F.when(go, F.concat(s["out"], F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""), size.cast("string"), e["kind"])).otherwise(s["out"])
        return F.struct(
            (F.greatest(e["loc"] + 1, s["ref"]) + F.when((e["kind"] == "D") & go, e["len"]).otherwise(0)).alias("ref"),
            (left - F.when((e["kind"] == "I") & go, size).otherwise(0)).alias("left"),
            F.when(go, 0).otherwise(m).alias("m"),
            out.alias("out"),
        )

    def close(s):
        m = s["m"] + s["left"]
        return F.when(m > 0, F.concat(s["out"], m.cast("string"), F.lit("M"))).otherwise(s["out"])

    return F.aggregate(indels, start, step, close)


def global_alignment(template: str, query: str) -> str:
    """CIGAR of the query against the template, both from end to end, with the fewest edits; of equal ones matches go
    before deletions, and these before insertions, from the end."""
    a, b = np.frombuffer(template.encode(), np.uint8), np.frombuffer(query.encode(), np.uint8)
    n, m = len(a), len(b)
    step, row = np.arange(m + 1), np.arange(m + 1)
    came = np.zeros((n + 1, m + 1), np.uint8)  # 0 match or mismatch, 1 deletion, 2 insertion
    came[0, 1:] = 2
    for i in range(1, n + 1):
        best, down = np.append(i, row[:-1] + (b != a[i - 1])), row + 1
        kind = np.where(down < best, 1, 0).astype(np.uint8)
        kind[0] = 1
        best = np.minimum(best, down)
        best[0] = i
        low = np.minimum.accumulate(best - step) + step
        came[i] = np.where(low < best, 2, kind)
        row = low
    ops, i, j = [], n, m
    while i or j:
        k = came[i, j]
        ops.append("MDI"[k])
        i, j = i - (k != 2), j - (k != 1)
    return "".join(f"{len(list(g))}{op}" for op, g in groupby(reversed(ops)))


def aligned_cigars(rows: DataFrame, template: str = "template", query: str = "query") -> DataFrame:
    """rows with ``cigar``: the query aligned with its template; null where either is."""
    at = [rows.columns.index(c) for c in (template, query)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None or y is None else global_alignment(x, y) for x, y in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "cigar"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("cigar", StringType())]))


def run_lengths(ops: Column) -> Column:
    """MMMIMM as 3M1I2M."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit("").alias("out"))
    flush = lambda s: F.when(s["n"] > 0, F.concat(s["out"], s["n"].cast("string"), s["c"])).otherwise(s["out"])

    def step(s, c):
        same = s["c"] == c
        return F.struct(c.alias("c"), F.when(same, s["n"] + 1).otherwise(1).alias("n"), F.when(same, s["out"]).otherwise(flush(s)).alias("out"))

    return F.aggregate(F.filter(F.split(ops, ""), lambda c: c != ""), start, step, flush)


def run_length_text(text: str) -> str:
    """MMMIMM as 3M1I2M, by arrays."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(letters):
        return ""
    starts = np.append(0, np.flatnonzero(letters[1:] != letters[:-1]) + 1)
    n = np.diff(np.append(starts, len(letters)))
    digits, least = np.ones(len(n), np.int64), 10
    while (longer := n >= least).any():
        digits += longer
        least *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1], np.uint32)
    out[ends - 1] = letters[starts]
    at = ends - 2
    while len(n):
        out[at] = 48 + n % 10
        more = n >= 10
        n, at = n[more] // 10, at[more] - 1
    return out.astype(np.uint8).tobytes().decode("ascii") if text.isascii() else out.tobytes().decode("utf-32-le")


def run_length_texts(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with ``name``: the run lengths of a column of long texts, which a fold over letters takes too long for."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else run_length_text(x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(name, StringType())]))


def reg2bin(beg: Column, end: Column) -> Column:
    """The bin of the binning index that SAM and BAM use."""
    last = end - 1
    out = None
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        same = F.shiftright(beg, shift) == F.shiftright(last, shift)
        value = F.shiftright(beg, shift) + offset
        out = F.when(same, value) if out is None else out.when(same, value)
    return out.otherwise(0).cast("int")
