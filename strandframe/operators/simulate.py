"""Simulate reads and variants with known truth.

Every draw is a function of (seed, contig, entity, slot): results do not depend on partitions, retries or the number of
executors. Placement, filters, joins and truth are DataFrame plans; places drawn by weights and the letters of reads are
made in Arrow functions, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from strandframe.functions.randomness import categorical, normal, poisson, stochastic_round, uniform, uniform_of
from strandframe.functions.sequence import BASES, bases_at, letter_codes, pieces, reverse_complement, window_percents
from strandframe.operators import synthesis
from strandframe.operators.intervals import fill_gaps, interval_filter
from strandframe.operators.reads import padding
from strandframe.operators.sim_models import Errors, MarkovQualities, Mutations, Qualities, snv_alternative
from strandframe.operators.variants import DELETION, INSERTION, SNV, only_bases

#: Places in which a candidate's own place is drawn by its weights.
WINDOW = 1000
MIN_MATE_EXTRA = 10


@dataclass(frozen=True)
class Settings:
    read_length: int = 100
    coverage: float = 10.0
    paired: bool = True
    fragment_mean: float = 300.0
    fragment_sd: float = 50.0
    ploidy: int = 2
    seed: int = 0
    min_mutations: int = 0
    attempts: int = 8
    gc_window: int = 100
    gc_weights: tuple[float, ...] = field(default=())
    mutations: Mutations = field(default_factory=Mutations)
    errors: Errors = field(default_factory=Errors)
    qualities: Qualities | MarkovQualities = field(default_factory=Qualities)

    def __post_init__(self):
        if self.read_length < 10 or self.coverage <= 0 or self.ploidy < 1 or not 0 <= self.mutations.rate <= 0.3:
            raise ValueError("read_length >= 10, coverage > 0, ploidy >= 1 and a mutation rate of 0 to 0.3 are needed")


def _need(s: Settings) -> int:
    """The least length of a fragment."""
    return s.read_length + (MIN_MATE_EXTRA if s.paired else 0)


def wanted_reads(contigs: DataFrame, s: Settings) -> DataFrame:
    """contigs long enough for a fragment, with ``n``: reads (pairs) by coverage, rounded at random without bias."""
    per = s.read_length * (2 if s.paired else 1)
    return contigs.where(F.col("length") >= _need(s)).withColumn("n", stochastic_round(F.col("length") * s.coverage / per, s.seed, F.col("contig"), "reads"))


def _fragment(start: Column, draw: Column, s: Settings) -> Column:
    return F.least(start + F.abs(F.rint(s.fragment_mean + s.fragment_sd * draw)).cast("long"), F.col("length"))


def _tried(rows: DataFrame, start: Column, s: Settings) -> DataFrame:
    """rows with ``f`` of ``s, e``: the first drawn length that is enough; after all attempts the least one, for which start
    leaves room."""
    end = lambda a: _fragment(start, normal(s.seed, F.col("contig"), F.col("read_no"), a, "len"), s)
    # the first, which will mostly do, is a column of its own: it would be drawn once to be judged and again to be taken
    ends = [F.col("_end"), *(end(a) for a in range(1, s.attempts))]
    tries = [F.when(e - start >= _need(s), F.struct(start.alias("s"), e.alias("e"))) for e in ends]
    return rows.withColumn("_end", end(0)).withColumn("f", F.coalesce(*tries, F.struct(start.alias("s"), (start + _need(s)).alias("e"))))


def placements(contigs: DataFrame, s: Settings) -> DataFrame:
    """``contig, length, read_no, s1, e1, s2, e2``: a row a fragment; no mate where reads are single.

    Starts leave room for the least fragment. A fragment tries ``attempts`` lengths, all functions of its key, takes the
    first that is long enough, and else the least: all that are wanted are placed. Contigs too short for any fragment
    have none. With GC weights, starts fall by the weights of windows.
    """
    wanted = wanted_reads(contigs, s)
    if s.gc_weights:
        return _weighted(wanted, s)
    each = wanted.where("n > 0").select("contig", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("read_no"))
    # a column of its own: inside the attempts it would be drawn again at each
    start = F.floor(uniform(s.seed, F.col("contig"), F.col("read_no"), "start") * (F.col("length") - _need(s) + 1)).cast("long")
    return _ends(_tried(each.withColumn("start", start), F.col("start"), s), s)


def _ends(rows: DataFrame, s: Settings) -> DataFrame:
    mate = (F.col("f.e") - s.read_length, F.col("f.e")) if s.paired else (F.lit(None).cast("long"), F.lit(None).cast("long"))
    return rows.select("contig", "length", "read_no", F.col("f.s").alias("s1"), (F.col("f.s") + s.read_length).alias("e1"), mate[0].alias("s2"), mate[1].alias("e2"))


#: Bases in a piece of a contig whose windows are weighed by one task at a time, and draws made at a time.
GC_PIECE, GC_DRAWS = 1 << 16, 1 << 16


def _weighted(wanted: DataFrame, s: Settings) -> DataFrame:
    """Starts by inverse distribution over the weights of a contig's windows.

    Each piece's windows are weighed in an array; a contig's row holds its pieces' sums, by which its draws, a range of
    their numbers a task, are dealt to pieces; a piece's draws meet its letters and are looked up in its running weights.
    Windows that begin where no fragment has room are left out, so that each draw is a valid start.
    """
    weights = np.array(s.gc_weights, float)
    kind = wanted.schema["contig"].dataType.simpleString()
    tail = max(0, _need(s) - s.gc_window)
    roomy = wanted.withColumn("seq", F.left("seq", F.col("length") - tail))
    parts = pieces(roomy.where(F.length("seq") >= s.gc_window), s.gc_window - 1, "contig", size=GC_PIECE)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weights[window_percents(letter_codes(p), s.gc_window)] for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([float(w.sum()) for w in found], pa.float64()), pa.array([len(w) for w in found], pa.int64())], ["contig", "base", "weight", "windows"])

    sums = parts.mapInArrow(weigh, f"contig {kind}, base long, weight double, windows long")
    total = sums.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("base", "weight"))).alias("pieces"), F.sum("weight").alias("total"), F.sum("windows").alias("windows"))
    overall = total.agg((F.sum("total") / F.sum("windows")).alias("mean"))
    per = s.read_length * (2 if s.paired else 1)
    n = stochastic_round(F.col("length") * s.coverage / per * F.col("total") / F.col("windows") / F.col("mean"), s.seed, F.col("contig"), "gc")
    scaled = wanted.select("contig", "length").join(total, "contig").crossJoin(F.broadcast(overall)).where("total > 0").withColumn("n", n).where("n > 0")
    ranges = scaled.select("contig", "length", "n", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(GC_DRAWS).cast("long"))).alias("first"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, length, count, listed, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                numbers = np.arange(first, min(count, first + GC_DRAWS))
                upto = np.cumsum([p["weight"] for p in listed])
                at = np.array([uniform_of(s.seed, contig, i, "gc") for i in numbers.tolist()]) * upto[-1]
                last = int(np.flatnonzero([p["weight"] for p in listed])[-1])
                hit = np.minimum(np.searchsorted(upto, at, "right"), last)
                bases = np.array([p["base"] for p in listed])[hit]
                yield pa.record_batch([pa.array([contig] * len(numbers), batch.schema.field(0).type), pa.array([length] * len(numbers), pa.int64()), pa.array(numbers), pa.array(bases, pa.int64()), pa.array(at - (upto[hit] - np.array([p["weight"] for p in listed])[hit]))], ["contig", "length", "read_no", "base", "rest"])

    drawn = ranges.repartition("contig", "first").select("contig", "length", "n", "pieces", "first").mapInArrow(draw, f"contig {kind}, length long, read_no long, base long, rest double")

    def place(letters: pa.Table, draws: pa.Table) -> pa.Table:
        if not letters.num_rows or not draws.num_rows:
            return draws.select(["contig", "length", "read_no"]).slice(0, 0).append_column("pos", pa.array([], pa.int64()))
        found = weights[window_percents(letter_codes(letters.column("piece")[0].as_py()), s.gc_window)]
        last = int(np.flatnonzero(found)[-1])
        pos = np.minimum(np.searchsorted(np.cumsum(found), draws.column("rest").to_numpy(), "right"), last) + letters.column("base")[0].as_py()
        return draws.select(["contig", "length", "read_no"]).append_column("pos", pa.array(pos, pa.int64()))

    placed = parts.groupBy("contig", "base").cogroup(drawn.groupBy("contig", "base")).applyInArrow(place, f"contig {kind}, length long, read_no long, pos long")
    return _ends(_tried(placed, F.col("pos"), s), s)


def restricted(fragments: DataFrame, target: DataFrame | None = None, discard: DataFrame | None = None) -> DataFrame:
    """Fragments of which either mate meets a target region, and neither a discarded one; contig coordinates."""
    for regions, keep in ((target, True), (discard, False)):
        if regions is None:
            continue
        mates = fragments.select("contig", "read_no", F.explode(F.array(F.struct(F.col("s1").alias("st"), F.col("e1").alias("en")), F.struct(F.col("s2").alias("st"), F.col("e2").alias("en")))).alias("m")).select("contig", "read_no", "m.st", "m.en").where("st is not null")
        met = interval_filter(mates, regions, True).select("contig", "read_no").distinct()
        fragments = fragments.join(met, ["contig", "read_no"], "left_semi" if keep else "left_anti")
    return fragments


def drawn_places(windows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Rows ``letters, n, u, biased, ...`` with ``offset``: which of the n places is drawn by u.

    letters are the n places' and one on either side. Biased rows weigh a place by its trinucleotide, others weigh all
    bases alike; letters that are no base are never drawn, and rows without a place that can be are left out.
    """
    keep = [c for c in windows.columns if c not in ("letters", "n", "u", "biased")]
    schema = StructType([*[windows.schema[c] for c in keep], windows.schema["letters"], StructField("offset", LongType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            rows, offsets = [], []
            for i, (text, n, u, biased) in enumerate(zip(*(batch.column(at[c]).to_pylist() for c in ("letters", "n", "u", "biased")), strict=True)):
                code = letter_codes(text).astype(np.int64)[: n + 2]
                middle = code[1:-1]
                weight = (middle < 4).astype(float)
                if biased:
                    known = (middle < 4) & (code[:-2] < 4) & (code[2:] < 4)
                    weight = np.where(known, weights[np.where(known, 16 * code[:-2] + 4 * middle + code[2:], 0)], 0.0)
                upto = np.cumsum(weight)
                if len(upto) and upto[-1] > 0:
                    rows.append(i)
                    offsets.append(min(int(np.searchsorted(upto, u * upto[-1], "right")), int(np.flatnonzero(weight)[-1])))
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*[picked.column(at[c]) for c in [*keep, "letters"]], pa.array(offsets, pa.int64())], [*keep, "letters", "offset"])

    return windows.mapInArrow(draw, schema)


def genotype(u_hom: Column, u_copy, ploidy: int, homozygous: float) -> Column:
    """Which copies have the allele: all with the probability homozygous, else half of them, one at least; u_copy(p) ranks
    the copies."""
    copies = F.when(u_hom < homozygous, ploidy).otherwise(max(1, ploidy // 2))
    ranks = F.array_sort(F.array(*[F.struct(u_copy(p).alias("u"), F.lit(p).alias("p")) for p in range(ploidy)]))
    chosen = F.transform(F.slice(ranks, F.lit(1), copies), lambda r: r["p"])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ploidy - 1)), lambda p: F.when(F.array_contains(chosen, p), "1").otherwise("0")), "/")


def random_bases(n: Column, u) -> Column:
    """n bases, the k-th by u(k), k from 1; none for n under 1."""
    one = lambda k: F.substr(F.lit(BASES), (F.floor(u(k) * 4) + 1).cast("int"), F.lit(1))
    return F.when(n < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), ""))


def candidate_counts(areas: DataFrame, s: Settings) -> DataFrame:
    """areas ``contig, st, en, rate`` with ``n``: a Poisson number each, together within the least number of the run and
    twice the expected one of the contig; what exceeds it is left out from the last areas, what lacks is put in the
    first."""
    key = [F.lit(s.seed), F.col("contig"), F.col("st")]
    # draws are columns of their own: inside a fold or a case they would be made again at each step
    drawn = areas.withColumns({"_mean": (F.col("en") - F.col("st")) * F.col("rate"), "_u": uniform(*key, "n")})
    counted = drawn.withColumn("n", poisson(F.col("_mean"), F.col("_u")))
    order = Window.partitionBy("contig").orderBy("st")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.greatest(F.rint(2 * F.sum("_mean").over(whole)), F.lit(s.min_mutations)).cast("long")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    capped = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), most - before))
    lacking = F.greatest(F.lit(0).cast("long"), F.lit(s.min_mutations) - F.sum("n").over(whole))
    return counted.withColumn("_capped", capped + F.when(F.row_number().over(order) == 1, lacking).otherwise(0)).select(*areas.columns, F.col("_capped").alias("n"))


def variants(contigs: DataFrame, s: Settings, regions: DataFrame | None = None) -> DataFrame:
    """``contig, pos, line_no, type, shrink, ref, alt, gt``: new variants, apart from each other.

    Each region of one rate (the model's where none is given) has a Poisson number of candidates. A candidate's window,
    class, place in the window, alleles and genotype are functions of its key and of the letters there: SNVs fall by the
    model's bias, others on any base. In order of place, one that begins before the end of an earlier one is left out, as
    are later ones of equal place.
    """
    model = s.mutations
    lengths = contigs.select("contig", "length")
    areas = fill_gaps(regions, lengths, model.rate) if regions is not None else lengths.select("contig", F.lit(0).cast("long").alias("st"), F.col("length").alias("en"), F.lit(model.rate).alias("rate"))
    areas = candidate_counts(areas.withColumn("rate", F.coalesce("rate", F.lit(model.rate))), s)
    each = areas.where("n > 0").select("contig", "st", "en", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    u = lambda slot: uniform(F.lit(s.seed), F.col("contig"), F.col("st"), F.col("i"), slot)
    rows = each.select("contig", "st", "en", "i", categorical(u("type"), list(model.types)).alias("type"), u("window").alias("u_window"), u("pos").alias("u"), u("len").alias("u_len"), u("alt").alias("u_alt"), u("hom").alias("u_hom"))
    size = F.when(F.col("type") == INSERTION, categorical(F.col("u_len"), list(model.insertions))).when(F.col("type") == DELETION, categorical(F.col("u_len"), list(model.deletions))).otherwise(0).cast("int")
    longest = max(n for n, _ in model.deletions) + 1
    rows = rows.withColumn("size", size).join(lengths.withColumnRenamed("length", "total"), "contig").where("total > 2")
    low, high = F.greatest("st", F.lit(1)), F.least(F.col("en"), F.col("total") - 1)
    rows = rows.withColumns({"low": low, "high": high}).where("low < high")
    rows = rows.withColumn("from", (F.col("low") + F.floor(F.col("u_window") * (F.col("high") - F.col("low")))).cast("long"))
    rows = rows.withColumn("n", F.least(F.lit(WINDOW).cast("long"), F.col("high") - F.col("from")).cast("int"))
    windows = bases_at(rows, contigs, F.col("from") - 1, F.col("n") + 1 + longest, "letters", most=WINDOW + 1 + longest, size=1 << 12, bounded=True)
    biased = (F.col("type") == SNV) if model.bias else F.lit(False)
    placed = drawn_places(windows.select("contig", "st", "i", "type", "size", "total", "from", "u_alt", "u_hom", "letters", "n", "u", biased.alias("biased")), model.place_weights())
    at = F.col("offset").cast("int")
    pos = F.col("from") + F.col("offset")
    ref = F.substr("letters", at + 2, F.when(F.col("type") == DELETION, F.col("size") + 1).otherwise(1))
    cut = placed.select("contig", "st", "i", "type", "size", "total", "u_alt", "u_hom", pos.alias("pos"), ref.alias("ref"), F.substr("letters", at + 1, F.lit(3)).alias("tri"))
    cut = cut.where((F.col("pos") + F.length("ref") < F.col("total")) & only_bases(F.col("ref")) & ((F.col("type") != DELETION) | (F.length("ref") == F.col("size") + 1)))
    cut = cut.withColumn("inserted", random_bases(F.when(F.col("type") == INSERTION, F.col("size")).otherwise(0), lambda k: uniform(F.lit(s.seed), F.col("contig"), F.col("st"), F.col("i"), "ins", k)))
    base = F.substr("ref", F.lit(1), F.lit(1))
    alt = F.when(F.col("type") == SNV, snv_alternative(F.col("u_alt"), F.col("tri"), model)).when(F.col("type") == INSERTION, F.concat(base, "inserted")).otherwise(base)
    gt = genotype(F.col("u_hom"), lambda p: uniform(F.lit(s.seed), F.col("contig"), F.col("st"), F.col("i"), "ploid", p), s.ploidy, model.homozygous)
    made = cut.select("contig", "pos", "type", "ref", alt.alias("alt"), gt.alias("gt"), (F.col("pos") + F.length("ref")).alias("end"), "st", "i").where("alt is not null")
    order = Window.partitionBy("contig").orderBy("pos", "st", "i").rowsBetween(Window.unboundedPreceding, -1)
    apart = made.withColumn("before", F.max("end").over(order)).where("before is null or pos >= before")
    return apart.select("contig", "pos", F.col("pos").alias("line_no"), "type", (F.length("ref") - F.length("alt")).alias("shrink"), "ref", "alt", "gt")


#: Bases in a piece of a contig, whose letters and variants a task of reads() holds at a time.
READ_PIECE = 1 << 14


def reads(contigs: DataFrame, fragments: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """Alignments ``name, flag, contig, pos, mapq, cigar, mate_contig, mate_pos, tlen, seq, qual, reverse``.

    seq and qual are as aligned (forward); FASTQ turns reverse reads around. By contig and piece: a piece's letters, its
    variants and the reads that begin in it stream through one task, so that no segment is moved and a read is moved once.
    """
    size, pad = READ_PIECE, padding(s.read_length)
    group = lambda place: F.floor(place / size).cast("long")
    nothing = {"kind": F.lit(2), "read_no": F.lit(None).cast("long"), "s1": F.lit(None).cast("long"), "s2": F.lit(None).cast("long"), "e2": F.lit(None).cast("long"), "mates": F.lit(0), "st": F.lit(0).cast("long"), "text": F.lit(None).cast("string"), "ref": F.lit(None).cast("string"), "alt": F.lit(None).cast("string"), "gt": F.lit(None).cast("string")}
    row = lambda rows, **given: rows.select("contig", "k", *[given.get(c, default).alias(c) for c, default in nothing.items()])
    # contigs in pieces, with the letters that reads may take from the next one
    piece = contigs.where("length > 0").select("contig", "seq", F.explode(F.sequence(group(F.lit(0)), group(F.col("length") - 1))).alias("k"))
    letters = row(piece, kind=F.lit(0), text=F.substr("seq", (F.col("k") * size + 1).cast("int"), F.lit(size + s.read_length + pad)))
    # a variant goes to all pieces from which a read may reach it
    reach = F.sequence(group(F.greatest(F.col("pos") - s.read_length + 1, F.lit(0))), group(F.col("pos")))
    known = row(found.where("pos >= 0").withColumn("k", F.explode(reach)), kind=F.lit(1), st=F.col("pos").cast("long"), ref=F.col("ref"), alt=F.col("alt"), gt=F.col("gt"))
    # a fragment is one row for the mates (1: first, 2: second) that begin in a piece
    mates = lambda k, which: F.struct(k.alias("k"), F.lit(which).alias("mates"))
    k1, k2 = group(F.col("s1")), group(F.col("s2"))
    parts = F.when(k1 == k2, F.array(mates(k1, 3))).otherwise(F.array(mates(k1, 1), mates(k2, 2))) if s.paired else F.array(mates(k1, 1))
    asked = fragments.select("contig", "read_no", "s1", "s2", "e2", F.explode(parts).alias("m")).where("m.k is not null").withColumn("k", F.col("m.k"))
    asked = row(asked, st=F.col("s1"), mates=F.col("m.mates"), **{c: F.col(c) for c in ("read_no", "s1", "s2", "e2")})
    # dealt by a function of the key, as in fill_gaps
    dealt = letters.unionByName(known).unionByName(asked).where("contig is not null").withColumn("h", F.xxhash64("contig", "k")).repartition("h")
    ordered = dealt.sortWithinPartitions("h", "contig", "k", "kind", "st", "ref", "alt", "gt", "text")
    keep = ["contig", "read_no", "s1", "s2", "e2"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held = max(1, (1 << 16) // s.read_length), None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            k, kind, st, mates = (column[c].to_numpy() for c in ("k", "kind", "st", "mates"))
            new = (k[1:] != k[:-1]) | pc.not_equal(column["contig"][1:], column["contig"][:-1]).to_numpy(zero_copy_only=False)
            run = np.append(0, np.cumsum(new))
            held = batch.take(pa.array(np.flatnonzero((run == run[-1]) & (kind < 2))))
            base = (run << 40) - k * size  # with it, places within a piece and as many letters more as a read has
            pieces_at, variants_at, reads_at = (np.flatnonzero(kind == x) for x in range(3))
            text, at, width = synthesis.joined(column["text"].take(pa.array(pieces_at)))
            piece_of = np.full(run[-1] + 1, -1)
            piece_of[run[pieces_at][::-1]] = np.arange(len(pieces_at))[::-1]
            reads_at = reads_at[piece_of[run[reads_at]] >= 0]
            known_at = (base + st)[variants_at]
            mine = [column[c].take(pa.array(variants_at)).to_pylist() for c in ("ref", "alt", "gt")]
            begin, keys = ([column[f"{c}{mate}"].fill_null(0).to_numpy() for mate in (1, 2)] for c in ("s", "key"))
            for i in range(0, len(reads_at), step):
                both = [reads_at[i : i + step][mates[reads_at[i : i + step]] & mate > 0] for mate in (1, 2)]
                some, start, key = (np.concatenate([x if y is None else y[m][x] for m, x in enumerate(both)]) for y in (None, begin, keys))
                which, offset = piece_of[run[some]], start - k[some] * size
                low, high = (np.searchsorted(known_at, base[some] + start + x) for x in (0, s.read_length))
                owner = np.repeat(np.arange(len(some)), high - low)
                hit = np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - high, high - low)
                carried = owner, st[variants_at[hit]] - start[owner], *([m[j] for j in hit.tolist()] for m in mine)
                widths = np.clip(width[which] - offset, 0, s.read_length + pad)
                lengths, *made, cigars = synthesis.made(key, text, at[which] + offset, widths, carried, s.read_length, s.errors, s.qualities)
                ends = pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32))
                strings = [pa.StringArray.from_buffers(len(some), ends, pa.py_buffer(x)) for x in made]
                reverse = np.arange(len(some)) >= len(both[0])
                yield pa.record_batch([*[column[c].take(pa.array(some)) for c in keep], pa.array(start), pa.array(reverse), *strings, pa.array(cigars, pa.string())], [*keep, "st", "reverse", "seq", "qual", "cigar"])

    from strandframe.operators.reads import flags, mate_position, name, template_length

    keys = [F.xxhash64(F.lit(s.seed), F.col("contig"), F.col("read_no"), F.lit(reverse)).alias(f"key{reverse + 1}") for reverse in (False, True)]
    done = ordered.select("k", "kind", "mates", "st", *keep, "text", "ref", "alt", "gt", *keys).mapInArrow(build, "contig string, read_no long, s1 long, s2 long, e2 long, st long, reverse boolean, seq string, qual string, cigar string")
    paired = F.col("s2").isNotNull()
    end = F.coalesce("e2", F.col("s1") + s.read_length)
    return done.select(
        F.concat(name("read", F.col("contig"), F.col("s1"), end - 1), F.lit("_"), F.col("read_no").cast("string")).alias("name"),
        flags(s.paired, paired, F.col("reverse")).alias("flag"),
        "contig",
        F.col("st").alias("pos"),
        F.lit(70).alias("mapq"),
        "cigar",
        F.when(paired, F.col("contig")).alias("mate_contig"),
        F.when(paired, mate_position(paired, F.col("reverse"), F.col("s1"), F.col("s2"))).alias("mate_pos"),
        template_length(paired, F.col("reverse"), F.col("s1"), end - 1).cast("int").alias("tlen"),
        "seq",
        "qual",
        "reverse",
    )


def fastq(alignments: DataFrame, reverse: bool, offset: int = 33) -> DataFrame:
    """``name, seq, qual`` of the first or second reads; second ones with their strand's sequence and qualities."""
    rows = alignments.where(F.col("reverse") == reverse)
    if offset != 33:
        plain = "".join(chr(33 + i) for i in range(94))
        moved = "".join(chr(min(126, offset + i)) for i in range(94))
        rows = rows.withColumn("qual", F.translate("qual", plain, moved))
    return rows.select(F.concat("name", F.lit("/2" if reverse else "/1")).alias("name"), (reverse_complement(F.col("seq")) if reverse else F.col("seq")).alias("seq"), (F.reverse("qual") if reverse else F.col("qual")).alias("qual"))


def rotated_union(contigs: DataFrame, simulate) -> DataFrame:
    """Both halves of circular genomes: simulate(contigs) and simulate(contigs begun at their middle), one after the other."""
    from strandframe.functions.sequence import rotate

    return simulate(contigs).unionByName(simulate(contigs.withColumn("seq", rotate(F.col("seq")))))
