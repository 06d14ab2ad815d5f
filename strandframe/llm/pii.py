"""Personal data: patterns, and terms that give protected entities away.

Method: e-mail addresses, IP addresses, card numbers and phone numbers are found by pattern; each distinct value is a
protected entity. A term (a word of at least four bytes, no digits) stands with an entity where it is among the
``window`` words on either side of a mention. Over the whole corpus it is counted in how many documents a term stands
with an entity, and in how many it occurs at all; their quotient estimates how likely the entity is where the term is
seen. Where that reaches ``disclosure``, from ``support`` documents or more, the term reveals the entity: all its
occurrences are sensitive spans of kind ``term``. Sanitising replaces pattern spans by their kind (generalised) and
removes revealing terms.

Counts are pre-summed in each task and again by the aggregation, so that an entity or a term that a third of all
documents hold is a few rows a task; the candidates are joined with the counts of all words. The revealing terms are
broadcast while they are at most ``broadcast_terms`` of 16 bytes on average; beyond that each text's distinct words are joined with them, and
the terms of each text come to it by the digest of the text. Both ways find the same spans.

Defined results: null texts count as empty and have no spans; positions are code points, ends exclusive; a term that
overlaps a pattern span gives no span of its own; of the entities that a term reveals alike the one seen with it more
often is named, then the last by name; repeated rows each give a row and count as documents of their own;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.words import WORD_TABLE, slices
from strandframe.session import stored

#: The kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: Matches as IP does, since no match begins within a run of digits; so a long run costs one look.
IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ADDRESS_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DIGITS = re.compile(r"[^0-9]")
#: ASCII digit bytes and whatever may join them, for the quick look whether a text can hold a number at all.
LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
DOTTED = re.compile(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Equal to the leftmost matches of EMAIL, but found from the @ signs, so that long runs cost no backtracking."""
    out, last = [], 0
    for m in ADDRESS_END.finditer(text):
        at = m.start()
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            last = m.end()
    return out


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all pattern spans, by start, then kind."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, b, 0) for a, b in _emails(text)]
    if DOTTED.search(text):
        for m in IP_ONCE.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                found.append((m.start(), m.end(), 1))
    if LONG_NUMBER.search(text):
        for m in CARD.finditer(text):
            digits = DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m.group())) <= 15:
                found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The protected value: lower case, numbers without what joins their digits."""
    start, end, kind = span
    value = text[start:end].lower()
    return f"{KINDS[kind]}:{value if kind < 2 else DIGITS.sub('', value)}"


def _term(word: bytes) -> bool:
    return len(word) >= 4 and not any(48 <= c <= 57 for c in word)


def _near(text: str, span: tuple[int, int, int], window: int) -> set[bytes]:
    """The terms among the window words on either side, however long they are."""
    before, after = _words_before(text, span[0], window), _words_after(text, span[1], window)
    return {w for w in [*before, *after] if _term(w)}


def _words_before(text: str, end: int, window: int) -> list[bytes]:
    """The last words before a place; as much is looked through as holds one more, as the first may be cut."""
    reach = window * 16
    while True:
        start = max(0, end - reach)
        found = text[start:end].encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
        if start == 0 or len(found) > window:
            return found[-window:]
        reach *= 4


def _words_after(text: str, start: int, window: int) -> list[bytes]:
    reach = window * 16
    while True:
        found = text[start : start + reach].encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
        if start + reach >= len(text) or len(found) > window:
            return found[:window]
        reach *= 4


def pairs(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``term, entity, both``: in how many documents a term stands with an entity."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            return pa.record_batch([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "entity", "both"])

        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                found = set()
                for span in pattern_spans(text or ""):
                    name = entity(text, span)
                    found.update((t, name) for t in _near(text, span, window))
                counts.update(found)
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term binary, entity string, both long")
    return rows.groupBy("term", "entity").agg(F.sum("both").alias("both"))


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, seen``: in how many documents each word that can be a term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            terms = [(t, n) for t, n in counts.items() if _term(t)]
            return pa.record_batch([pa.array([t for t, _ in terms], pa.binary()), pa.array([n for _, n in terms], pa.int64())], ["term", "seen"])

        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(set(text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()))
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term binary, seen long").groupBy("term").agg(F.sum("seen").alias("seen"))


def revealing(docs: DataFrame, text_col: str = "text", window: int = 5, support: int = 3, disclosure: float = 0.5) -> DataFrame:
    """``term, entity, both, seen, share``: the terms that reveal an entity, each with the entity that it reveals most."""
    candidates = pairs(docs, text_col, window).where(F.col("both") >= support)
    found = candidates.join(document_counts(docs, text_col), "term").withColumn("share", F.col("both") / F.col("seen")).where(F.col("share") >= disclosure)
    best = F.max(F.struct("share", "both", "entity", "seen")).alias("best")
    return found.groupBy("term").agg(best).select("term", "best.entity", "best.both", "best.seen", "best.share")


def _spans(text: str, terms: frozenset[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    base = pattern_spans(text)
    extra: list[tuple[int, int]] = []
    if terms and not terms.isdisjoint(text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()):
        at, covered = 0, 0
        for m in TOKEN.finditer(text):
            if m.group().encode("utf-8", "surrogatepass").translate(WORD_TABLE) not in terms:
                continue
            start, end = m.span()
            while at < len(base) and base[at][0] < end:
                covered, at = max(covered, base[at][1]), at + 1
            if covered <= start:
                extra.append((start, end))
    return base, extra


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows ``_id, _text, ...`` with ``_terms``: the terms that occur in the text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            of, found = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                words = [w for w in set((text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()) if _term(w)]
                of += [n] * len(words)
                found += words
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), pa.array(found, pa.binary())], ["_key", "term"])

    keyed = rows.withColumn("_key", F.unhex(F.sha2("_text", 256)))
    words = keyed.select("_key", "_text").mapInArrow(split, "_key binary, term binary")
    listed = words.join(terms, "term").groupBy("_key").agg(F.collect_set("term").alias("_terms"))
    return keyed.join(listed, "_key", "left").select(*rows.columns, "_terms")


def find(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), broadcast_terms: int = 200_000) -> DataFrame:
    """``id_col, *carry, spans array<struct<kind, start, end>>, clean string`` for every row.

    ``clean`` is the text with pattern spans replaced by their kind in angle brackets and revealing terms removed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    known: list[bytes] = []
    joined = False
    if terms is not None:
        terms = terms.select(F.col("term").cast("binary").alias("term")).distinct()
        number, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        joined = number > broadcast_terms or size > 16 * broadcast_terms
        known = [] if joined else terms.toArrow().column(0).to_pylist()
    shared = spark.sparkContext.broadcast(frozenset(known))
    if joined:
        rows = _with_terms(rows, terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            spans, clean = [], []
            own = batch.column(batch.schema.get_field_index("_terms")).to_pylist() if joined else None
            for n, text in enumerate(batch.column(1).to_pylist()):
                base, extra = _spans(text or "", shared.value if own is None else frozenset(own[n] or []))
                found = sorted([*base, *((a, b, 4) for a, b in extra)], key=lambda s: (s[0], s[2]))
                spans.append([{"kind": (*KINDS, "term")[k], "start": a, "end": b} for a, b, k in found])
                clean.append(redacted(text, found))
            kept = [batch.column(0), *batch.columns[2 : 2 + len(carry)]]
            yield pa.record_batch([*kept, pa.array(spans, span_type), pa.array(clean, pa.string())], ["_id", *batch.schema.names[2 : 2 + len(carry)], "spans", "clean"])

    carried = [f"_c{i} {kinds[f'_c{i}']}" for i in range(len(carry))]
    out = rows.mapInArrow(search, ", ".join([f"_id {kinds['_id']}", *carried, "spans array<struct<kind string, start long, end long>>, clean string"]))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "spans", "clean")


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start < at:  # inside or across the last one: widen it
            at = max(at, end)
            continue
        out += [text[at:start], "" if kind == 4 else f"<{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])


def op7_pii_spans(spark, sf_dir: str) -> DataFrame:
    """All spans of every whole text of documents, with the terms that the corpus shows to reveal an entity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    terms = stored(revealing(docs), "pii-terms")
    found = find(docs, terms)
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "term")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", named), ",").alias("spans"))
