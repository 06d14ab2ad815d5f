"""BAM: packed little-endian records in BGZF blocks, written and read without other libraries."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandframe.session import files

# Fixed values of the format: 4-bit bases, CIGAR letters, the block that ends a file.
BASE_CODES = "=ACMGRSVTWYHKDBN"
CIGAR_CODES = "MIDNSHP=X"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
_NIBBLE = {c: i for i, c in enumerate(BASE_CODES)}
COLUMNS = "name string, flag int, contig string, pos long, mapq int, cigar string, mate_contig string, mate_pos long, tlen int, seq string, qual string"


def bgzf_block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def header(contigs: list[tuple[str, int]]) -> bytes:
    text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)).encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(contigs))]
    for c, n in contigs:
        name = c.encode() + b"\0"
        out += [struct.pack("<i", len(name)), name, struct.pack("<i", n)]
    return b"".join(out)


def bin_of(beg: int, end: int) -> int:
    last = end - 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == last >> shift:
            return offset + (beg >> shift)
    return 0


_CIGARS: dict[str, tuple[bytes, int, int]] = {}


def _cigar(text: str | None) -> tuple[bytes, int, int]:
    """(packed operations, their number, places they span); kept, as few different ones make most of a file."""
    found = _CIGARS.get(text or "")
    if found is None:
        ops = [(int(n) << 4) | CIGAR_CODES.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text or "")]
        if len(_CIGARS) > 50_000:
            _CIGARS.clear()
        found = _CIGARS[text or ""] = struct.pack(f"<{len(ops)}I", *ops), len(ops), sum(c >> 4 for c in ops if CIGAR_CODES[c & 15] in "MDN=X") or 1
    return found


_TO_NIBBLE = bytes(_NIBBLE.get(chr(c), 15) for c in range(256))
_TO_QUALITY = bytes(max(0, c - 33) for c in range(256))


def packed(batch: pa.RecordBatch, index: dict[str, int]) -> Iterator[tuple[int, int, int, bytes]]:
    """(contig, start, end, record) of a batch of alignments; letters and qualities of all of them are coded at once."""
    get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
    seqs, quals = get("seq"), get("qual")
    even = "".join(s + "=" * (len(s) % 2) for s in seqs).encode().translate(_TO_NIBBLE)
    pairs = np.frombuffer(even, np.uint8).reshape(-1, 2)
    bases, scores, at, to = ((pairs[:, 0] << 4) | pairs[:, 1]).tobytes(), "".join(quals).encode().translate(_TO_QUALITY), 0, 0
    for name, flag, contig, pos, mapq, cigar, mate, mate_pos, tlen, seq in zip(*map(get, ("name", "flag", "contig", "pos", "mapq", "cigar", "mate_contig", "mate_pos", "tlen")), seqs, strict=True):
        ops, n_ops, span = _cigar(cigar)
        label, half = name.encode() + b"\0", (len(seq) + 1) // 2
        fixed = struct.pack("<iiBBHHHiiii", index[contig], pos, len(label), mapq, bin_of(pos, pos + span), n_ops, flag, len(seq), -1 if mate is None else index[mate], -1 if mate_pos is None else mate_pos, tlen or 0)
        body = b"".join((fixed, label, ops, bases[at : at + half], scores[to : to + len(seq)]))
        at, to = at + half, to + len(seq)
        yield index[contig], pos, pos + span, struct.pack("<i", len(body)) + body


class Index:
    """A BAI index: for each contig its bins' chunks and the first record that reaches each 16,384 places; places of
    records are kept as numbers of inflated bytes until the blocks' places in the file are known."""

    def __init__(self, contigs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(contigs)]
        self.linear: list[list[int]] = [[] for _ in range(contigs)]

    def add(self, contig: int, start: int, end: int, at: int, until: int) -> None:
        chunks = self.bins[contig].setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] == at:
            chunks[-1][1] = until
        else:
            chunks.append([at, until])
        rows = self.linear[contig]
        for window in range(len(rows), ((end - 1) >> 14) + 1):
            rows.append(at if window >= start >> 14 else -1)

    def packed(self, blocks: list[int]) -> bytes:
        """The index's bytes; blocks are the places in the file at which each BLOCK inflated bytes begin."""
        where = lambda u: 0 if u < 0 else (blocks[u // BLOCK] << 16) | (u % BLOCK)
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, linear in zip(self.bins, self.linear, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)))
                out += [struct.pack("<QQ", where(a), where(b)) for a, b in chunks]
            out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *map(where, linear)))
        return b"".join(out)


class _Bytes:
    """Inflated bytes of a stream of gzip members, taken as they are asked for; what was taken is let go."""

    def __init__(self, read, step: int = 1 << 20):
        self.read, self.step, self.held, self.at, self.rest, self.inflate = read, step, bytearray(), 0, b"", None

    def more(self) -> bool:
        if not self.rest:
            self.rest = self.read(self.step)
            if not self.rest:
                if self.inflate is not None and not self.inflate.eof:
                    raise ValueError("a BAM file that is cut")
                return False
        if self.inflate is None or self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(self.rest)
        self.rest = self.inflate.unused_data if self.inflate.eof else b""
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if self.at > 1 << 20:
                del self.held[: self.at]
                self.at = 0
            if not self.more():
                raise ValueError("a BAM file that is cut")
        self.at += n
        return bytes(self.held[self.at - n : self.at])

    def ended(self) -> bool:
        while self.at == len(self.held):
            if not self.more():
                return True
        return False


def unpacked(read) -> Iterator[dict]:
    """The alignments of a BAM file, whose bytes ``read(n)`` gives one after the other."""
    data = _Bytes(read)
    number = lambda: struct.unpack("<i", data.take(4))[0]
    if data.take(4) != b"BAM\1":
        raise ValueError("no BAM")
    data.take(number())
    names = []
    for _ in range(number()):
        names.append(data.take(number())[:-1].decode())
        number()
    pick = lambda i: None if i < 0 else names[i]
    while not data.ended():
        row = data.take(number())
        ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", row)
        p = 32
        name, p = row[p : p + n_name - 1].decode(), p + n_name
        cigar, p = struct.unpack_from(f"<{n_cigar}I", row, p), p + 4 * n_cigar
        raw, p = row[p : p + (n_seq + 1) // 2], p + (n_seq + 1) // 2
        seq = raw.hex().translate(_FROM_NIBBLE)[:n_seq]
        qual = row[p : p + n_seq].translate(_FROM_QUALITY).decode()
        yield {"name": name, "flag": flag, "contig": pick(ref), "pos": pos, "mapq": mapq, "cigar": "".join(f"{c >> 4}{CIGAR_CODES[c & 15]}" for c in cigar), "mate_contig": pick(mate), "mate_pos": None if mate_pos < 0 else mate_pos, "tlen": tlen, "seq": seq, "qual": qual}


#: Hexadecimal digits to the bases that they stand for; qualities to letters.
_FROM_NIBBLE = {ord(f"{i:x}"): b for i, b in enumerate(BASE_CODES)}
_FROM_QUALITY = bytes(min(126, q + 33) for q in range(256))


def inflated(data: bytes) -> bytes:
    out = []
    while data:
        inflate = zlib.decompressobj(31)
        out.append(inflate.decompress(data))
        data = inflate.unused_data
    return b"".join(out)


def write_bam(alignments: DataFrame, folder: str, contigs: list[tuple[str, int]]) -> DataFrame:
    """One BAM file a range of places, each sorted and with a BAI index; in name order the files are sorted as a whole.
    Gives ``path, records``.

    ``folder`` is a URI that all executors share. A task writes under its attempt's name and renames at the end.
    """
    from pyspark.sql import functions as F

    order = F.create_map(*[F.lit(x) for i, (c, _) in enumerate(contigs) for x in (c, i)])
    rows = alignments.withColumn("_c", F.element_at(order, F.col("contig")))
    rows = rows.repartitionByRange("_c", "pos").sortWithinPartitions("_c", "pos", "name").select(*[c.split()[0] for c in COLUMNS.split(", ")])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context, (store, root) = TaskContext.get(), fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        index = {c: i for i, (c, _) in enumerate(contigs)}
        final = f"{root}/part-{context.partitionId():06d}.bam"
        part, held, n, found = f"{final}.{context.taskAttemptId()}", bytearray(header(contigs)), 0, Index(len(contigs))
        blocks, gone, written = [], 0, 0  # places of blocks, inflated bytes in them, bytes of the file

        def flush(out, size: int) -> None:
            nonlocal gone, written
            data = bgzf_block(bytes(held[:size]))
            blocks.append(written)
            out.write(data)
            gone, written = gone + size, written + len(data)
            del held[:size]

        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for contig, start, end, record in packed(batch, index):
                    at = gone + len(held)
                    held += record
                    n += 1
                    found.add(contig, start, end, at, at + len(record))
                    while len(held) >= BLOCK:
                        flush(out, BLOCK)
            if held:
                flush(out, len(held))
            blocks.append(written)
            out.write(END_OF_FILE)
        with store.open_output_stream(f"{part}.bai", compression=None) as out:
            out.write(found.packed(blocks))
        store.move(part, final)
        store.move(f"{part}.bai", f"{final}.bai")
        yield pa.record_batch([pa.array([final]), pa.array([n], pa.int64())], ["path", "records"])

    return rows.mapInArrow(save, "path string, records long")


def _opened(paths: list[str]) -> bool:
    """Whether the executors' Arrow can open files in the store of the paths."""
    from pyarrow import ArrowException, fs

    try:
        fs.FileSystem.from_uri(paths[0])
        return True
    except (ArrowException, ValueError, OSError):
        return False


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files, a task a file, read block by block; in stores that only Spark can open, a file is held."""
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (c.split() for c in COLUMNS.split(", "))])

    def rows(read) -> Iterator[pa.RecordBatch]:
        held = []
        for row in unpacked(read):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(name)
                with store.open_input_stream(root, compression=None) as stream:
                    yield from rows(stream.read)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield from rows(io.BytesIO(content).read)

    found = [p for p in files(spark, path) if not p.endswith(".bai")]
    if not found:
        raise ValueError(f"{path} names no file")
    if _opened(found):
        return spark.createDataFrame([(p,) for p in found], "path string").repartition(len(found)).mapInArrow(streamed, COLUMNS)
    return spark.read.format("binaryFile").load(found).select("content").mapInArrow(held, COLUMNS)


def spans(alignments: DataFrame) -> DataFrame:
    """``contig, st, en`` of mapped alignments, ends by their CIGARs; those without one are left out."""
    from pyspark.sql import functions as F

    taken = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    width = F.aggregate(taken, F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    rows = alignments.where((F.col("flag").bitwiseAND(4) == 0) & F.col("contig").isNotNull() & (F.col("contig") != "*"))
    return rows.select("contig", F.col("pos").alias("st"), (F.col("pos") + width).alias("en")).where("en > st")


def write_bgzf(lines: DataFrame, folder: str, head: str = "") -> DataFrame:
    """Lines ``value`` as files of BGZF blocks, which gzip readers read too; the first begins with head. Gives
    ``path, lines``."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context, (store, root) = TaskContext.get(), fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        final, n = f"{root}/part-{context.partitionId():06d}.gz", 0
        part, held = f"{final}.{context.taskAttemptId()}", bytearray(head.encode() if context.partitionId() == 0 else b"")
        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    held += line.encode() + b"\n"
                    n += 1
                    while len(held) >= BLOCK:
                        out.write(bgzf_block(bytes(held[:BLOCK])))
                        del held[:BLOCK]
            if held:
                out.write(bgzf_block(bytes(held)))
            out.write(END_OF_FILE)
        store.move(part, final)
        yield pa.record_batch([pa.array([final]), pa.array([n], pa.int64())], ["path", "lines"])

    return lines.select("value").mapInArrow(save, "path string, lines long")
