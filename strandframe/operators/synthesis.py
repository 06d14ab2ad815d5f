"""Reads from their segments, a batch at a time: qualities and errors as matrices of draws that depend on each read's key.

Everything is drawn as numbers of (key of the read, slot), so that batches, partitions and retries change nothing. Reads
without insertions or deletions are letters of a matrix with some replaced; only the others are spliced one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandframe.functions.sequence import BASES, MASK_REPEAT
from strandframe.operators.sim_models import Errors, MarkovQualities, Qualities
from strandframe.operators.variants import DELETION, INSERTION, SNV

LOW = 1
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(BASES.encode()):
    _CODE[_b] = _i
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_REPEAT = np.frombuffer(MASK_REPEAT.encode(), np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of 64 bits, by a finaliser that works in their own memory."""
    with np.errstate(over="ignore"):
        shifted = x >> np.uint64(30)
        x ^= shifted
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(27), out=shifted)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=shifted)
        x >>= np.uint64(11)
        return x * (1.0 / (1 << 53))


def uniforms_at(keys: np.ndarray, slots, columns) -> np.ndarray:
    """What uniforms has for each key in a slot and a column of its own."""
    with np.errstate(over="ignore"):
        column = np.asarray(columns).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + (np.asarray(slots) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return _mixed(keys.astype(np.uint64) + column)


def uniforms(keys: np.ndarray, slot: int, width: int) -> np.ndarray:
    """len(keys) x width numbers in [0, 1): a finaliser over key, slot and column."""
    return uniforms_at(keys[:, None], slot, np.arange(width)[None, :])


def normals(keys: np.ndarray, slot: int, width: int) -> np.ndarray:
    u, v = uniforms(keys, slot, width), uniforms(keys, slot + 1, width)
    np.log1p(np.negative(u, out=u), out=u)
    u *= -2
    v *= 2 * np.pi
    np.sqrt(u, out=u)
    u *= np.cos(v, out=v)
    return u


def draw_qualities(keys: np.ndarray, length: int, model: Qualities | MarkovQualities) -> np.ndarray:
    """A row of qualities a read; a model of another read length is spread over the read."""
    if isinstance(model, MarkovQualities):
        return _draw_markov(keys, length, model)
    if model.uniform is not None:
        return np.full((len(keys), length), min(42, int(-10 * np.log10(max(model.uniform, 1e-9)) + 0.5)), np.int64)
    mean, sd = np.array(model.mean), np.array(model.sd)
    at = np.arange(length) * len(mean) // max(1, length)
    drawn = normals(keys, 0, length)
    drawn *= sd[at]
    drawn += mean[at]
    q = np.clip(np.rint(drawn, out=drawn), 1, 42, out=drawn).astype(np.int16)
    if model.bins:
        bins = np.array(sorted(set(model.bins)))
        q = bins[np.clip(np.searchsorted(bins, q, "right") - 1, 0, len(bins) - 1)]
    return q


def _pick(u: np.ndarray, pairs: tuple) -> np.ndarray:
    values, p = np.array([v for v, _ in pairs]), np.array([p for _, p in pairs], float)
    return values[np.minimum(np.searchsorted(np.cumsum(p) / p.sum(), u, "right"), len(values) - 1)]


def _draw_markov(keys: np.ndarray, length: int, model: MarkovQualities) -> np.ndarray:
    """Place by place, all reads at once: the row of the quality before where there is one, else the place's own shares."""
    size, out = len(model.marginal), np.zeros((len(keys), length), np.int64)
    where = [min(size - 1, max(0, int(np.rint(i / max(1, length - 1) * (size - 1))))) for i in range(length)]
    for i in range(length):
        u = uniforms(keys, 2 + i, 1)[:, 0]
        if i == 0:
            out[:, 0] = _pick(u, model.initial)
            continue
        out[:, i] = _pick(u, model.marginal[where[i]])
        rows = dict(model.transitions[min(where[i - 1], len(model.transitions) - 1)]) if model.transitions else {}
        for q in np.intersect1d(out[:, i - 1], list(rows)).tolist():
            mine = out[:, i - 1] == q
            out[mine, i] = _pick(u[mine], rows[q])
        np.clip(out[:, i], 0, model.top, out=out[:, i])
    return np.clip(out, 0, model.top)


def error_places(keys: np.ndarray, q: np.ndarray, rate: float, base: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(read, place) of the errors, sorted: as many a read as the rate gives, rounded at random; places are accepted by
    their quality, and what is missing is forced on places of at most the median quality."""
    n, length = q.shape
    if not n or not length:
        return (np.zeros(0, np.int64),) * 2
    expected = rate * length
    wanted = int(np.floor(expected)) + (uniforms(keys, base, 1)[:, 0] < expected - np.floor(expected))
    # only where the read's least quality would accept it is a place drawn at all
    chance, u = 10.0 ** (-np.arange(int(q.max()) + 1) / 10.0), uniforms(keys, base + 2, length)
    row, column = np.nonzero(u < chance[q.min(axis=1)][:, None])
    tried = (uniforms_at(keys[row], base + 1, column) * length).astype(np.int64)
    taken = u[row, column] < chance[q[row, tried]]
    row, tried = row[taken], tried[taken]
    accepted = np.bincount(row, minlength=n)
    keep = np.arange(len(row)) - (np.cumsum(accepted) - accepted)[row] < wanted[row]
    missing = wanted - np.minimum(accepted, wanted)
    short = np.flatnonzero(missing)
    rows, places = [row[keep]], [tried[keep]]
    if len(short):
        u, mine, middle = uniforms(keys[short], base + 3, int(missing.max())), q[short], ((length - 1) // 2, length // 2)
        ordered = np.sort(mine, axis=1)  # of small numbers quicker than a partition
        # twice the median is a whole number
        rank = np.cumsum(2 * mine <= (ordered[:, middle[0]] + ordered[:, middle[1]])[:, None], axis=1, dtype=np.int32)
        for k in range(u.shape[1]):
            on = np.flatnonzero(missing[short] > k)
            nth = (u[on, k] * rank[on, -1]).astype(np.int64) + 1
            rows.append(short[on])
            places.append((rank[on] >= nth[:, None]).argmax(axis=1))
    both = np.unique(np.concatenate(rows) * length + np.concatenate(places))
    return both // length, both % length


def spliced(segment: str, edits: list[tuple[int, str, str, bool]], q: np.ndarray, length: int) -> tuple[str, np.ndarray, str]:
    """(sequence, qualities, CIGAR) of a read: edits (place, ref, alt, whether an error) put into its segment.

    Edits are sorted and apart. The CIGAR is written in the same pass, so that it always describes the sequence.
    """
    seq, low, ops, at, n = [], [], [], 0, 0
    for place, ref, alt, wrong in edits:
        seq.append(segment[at:place] + alt)
        ops += [("M", place - at + 1), ("I", len(alt) - 1), ("D", len(ref) - 1)]
        n += place - at
        if wrong:
            low += range(n + (len(ref) != len(alt)), n + len(alt))
        n, at = n + len(alt), place + len(ref)
    seq.append(segment[at:])
    text = "".join(seq)[:length]
    values = q[: len(text)].copy()
    values[[i for i in low if i < len(text)]] = LOW
    runs, left = [], len(text)
    for op, count in [*ops, ("M", length)]:
        count = count if op == "D" else min(count, left)
        if not left or not count:
            continue
        left -= count if op != "D" else 0
        if runs and runs[-1][1] == op:
            runs[-1][0] += count
        else:
            runs.append([count, op])
    return text, values, "".join(f"{count}{op}" for count, op in runs)


def _chosen_errors(keys, row, place, letters, q, errors: Errors, base: int = 1100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class 0 insertion, 1 deletion, 2 SNV; length; replaced letter's code) of errors at (row, place)."""
    at = keys[row] + place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    names = [t for t, _ in errors.types]
    kinds = _pick(uniforms(at, base, 1)[:, 0], tuple((names.index(t), p) for t, p in errors.types))
    kind = np.array([(INSERTION, DELETION, SNV).index(t) for t in names])[kinds] if len(kinds) else kinds
    longest = max(n for n, _ in errors.lengths)
    kind = np.where((place > 0) & (place < q.shape[1] - longest), kind, 2)
    size = _pick(uniforms(at, base + 1, 1)[:, 0], errors.lengths)
    shares = np.array(errors.transitions, float)
    upto = np.cumsum(shares / np.maximum(shares.sum(1, keepdims=True), 1e-300), 1)
    code = _CODE[letters[row, place]]
    alt = (upto[np.minimum(code, 3)] <= uniforms(at, base + 2, 1)).sum(1)
    return kind, size, np.minimum(alt, 3)


def _inserted(key: int, slot: int, n: int) -> str:
    return "".join(BASES[int(u * 4)] for u in uniforms(np.array([key], np.uint64), slot, n)[0])


def joined(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all letters in a row, where each text begins, how many it has), a byte a letter."""
    ends, buffer = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64), texts.buffers()[2]
    text = buffer.to_pybytes()[ends[0] : ends[-1]] if buffer is not None else b""
    if not text.isascii():
        each = [(x or "").encode("latin-1", "replace") for x in texts.to_pylist()]
        text, ends = b"".join(each), np.cumsum([0, *map(len, each)])
    return text, ends[:-1] - ends[0], np.diff(ends)


def build(keys: np.ndarray, segments: list[str], found: list[list[dict] | None], length: int, errors: Errors, qualities: Qualities | MarkovQualities) -> tuple[list[str], list[str], list[str]]:
    """(sequences, qualities, CIGARs) of forward reads from their segments and variants ``at, ref, alt, gt`` within them."""
    text = "".join(segments).encode("latin-1", "replace")
    widths = np.array([len(s) for s in segments], np.int64)
    listed = [(i, v) for i, f in enumerate(found) for v in sorted(f or (), key=lambda v: (v["at"], v["ref"], v["alt"]))]
    carried = np.array([i for i, _ in listed], np.int64), np.array([v["at"] for _, v in listed], np.int64), *([v[c] for _, v in listed] for c in ("ref", "alt", "gt"))
    size, letters, values, cigars = made(np.asarray(keys), text, np.cumsum(widths) - widths, widths, carried, length, errors, qualities)
    ends, letters, values = np.cumsum(size).tolist(), letters.tobytes().decode("latin-1"), values.tobytes().decode("latin-1")
    return [letters[a:b] for a, b in zip([0, *ends], ends)], [values[a:b] for a, b in zip([0, *ends], ends)], cigars.tolist()  # noqa: B905


def made(keys: np.ndarray, text: bytes, starts: np.ndarray, widths: np.ndarray, variants: tuple, length: int, errors: Errors, qualities: Qualities | MarkovQualities) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, letters, qualities as characters, CIGARs) of forward reads, letters and qualities of all reads in a row.

    Segments are parts of the text. Variants are (read, place in its segment, ref, alt, gt), sorted by all but the last.
    A variant is in a read if a copy of the genome drawn at random has it. Letters that are no base become those of the
    repeat, at low quality.
    """
    n, keys = len(starts), keys.astype(np.int64).view(np.uint64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, object)
    size, columns, whole = np.minimum(widths, length), np.arange(length), np.frombuffer(text or b"N", np.uint8)
    letters = whole[np.minimum(starts[:, None] + columns, len(whole) - 1)]
    if (size < length).any():
        letters[columns >= size[:, None]] = ord("N")
    q = draw_qualities(keys, length, qualities)
    row, place = error_places(keys, q, errors.rate) if errors.rate else (np.zeros(0, np.int64),) * 2
    inside = (place < size[row]) & (_CODE[letters[row, place]] < 4)
    row, place = row[inside], place[inside]
    kind, extent, alt = _chosen_errors(keys, row, place, letters, q, errors)
    # variants that the read's copy has
    carried: dict[int, list[tuple[int, str, str]]] = {}
    long = np.zeros(n, bool)
    reads = variants[0]
    nth = np.arange(len(reads)) - np.searchsorted(reads, reads)
    copies = {gt: gt.replace("|", "/").split("/") for gt in set(variants[4])}
    last, end, room = -1, -1, 0
    for i, u, at, ref, new, gt in zip(reads.tolist(), uniforms_at(keys[reads], 1200 + nth, 0).tolist(), variants[1].tolist(), *variants[2:], strict=True):
        if i != last:
            last, end, room = i, -1, int(widths[i]) - length
        lost = max(0, len(ref) - len(new))
        if copies[gt][int(u * len(copies[gt]))] != "0" and at > end and lost <= room:
            begin = int(starts[i])
            if text[begin + at : begin + min(at + len(ref), int(widths[i]))] == ref.encode("latin-1", "replace"):
                carried.setdefault(i, []).append((at, ref, new))
                end, room = at + len(ref) - 1, room - lost
    put = [(i, at, ref, new) for i, mine in carried.items() for at, ref, new in mine]
    long[[i for i, _, ref, new in put if len(ref) != 1 or len(new) != 1]] = True
    long[row[kind < 2]] = True
    held = np.array([i * length + p for i, at, ref, _ in put for p in range(at, min(at + len(ref), length))], np.int64)
    free = ~np.isin(row * length + place, held)
    row, place, kind, extent, alt = (x[free] for x in (row, place, kind, extent, alt))
    values = q.astype(np.uint8)
    flat = ~long[row]
    letters[row[flat], place[flat]] = _LETTERS[alt[flat]]
    values[row[flat], place[flat]] = LOW
    single = [(i, at, ord(new.encode("latin-1", "replace"))) for i, at, _, new in put if not long[i] and at < length]
    if single:
        i, at, new = zip(*single, strict=True)
        letters[list(i), list(at)] = new
    other = _CODE[letters] > 3
    if other.any():
        other &= columns < size[:, None]
        r, p = np.nonzero(other)
        letters[r, p], values[r, p] = _REPEAT[p % len(_REPEAT)], LOW
    cigars = np.array([f"{m}M" if m else "" for m in range(length + 1)], object)[size]
    at = np.searchsorted(row, np.arange(n + 1))
    for i in np.flatnonzero(long).tolist():
        segment = text[starts[i] : starts[i] + widths[i]].decode("latin-1")
        edits = [(a, ref, b, False) for a, ref, b in carried.get(i, [])]
        room = len(segment) - length - sum(max(0, len(r) - len(b)) for _, r, b, _ in edits)
        held_here, indels = {p for a, ref, _, _ in edits for p in range(a, a + len(ref))}, 0
        for j in range(at[i + 1] - 1, at[i] - 1, -1):  # from the end, so that an earlier deletion cannot reach a later one
            p, what, m = int(place[j]), int(kind[j]), int(extent[j])
            what = what if indels <= length // 4 else 2
            if what == 1:
                ref = segment[p : p + m + 1]
                if m > room or len(ref) <= m or not held_here.isdisjoint(range(p, p + m + 1)):
                    continue
                edits.append((p, ref, ref[0], True))
                held_here.update(range(p, p + m + 1))
                room, indels = room - m, indels + m
            elif p not in held_here:
                base = segment[p]
                edits.append((p, base, base + _inserted(int(keys[i]), 1500 + p, m) if what == 0 else BASES[alt[j]], True))
                held_here.add(p)
                indels += m if what == 0 else 0
        seq, v, cigars[i] = spliced(segment, sorted(edits), q[i], length)
        wrong = [k for k, b in enumerate(seq) if b not in BASES]
        if wrong:
            v[wrong] = LOW
            seq = "".join(MASK_REPEAT[k % len(MASK_REPEAT)] if b not in BASES else b for k, b in enumerate(seq))
        size[i] = len(seq)
        letters[i, : len(seq)], values[i, : len(seq)] = np.frombuffer(seq.encode(), np.uint8), v
    values += np.uint8(33)
    if (size < length).any():
        used = columns < size[:, None]
        return size, letters[used], values[used], cigars
    return size, letters.reshape(-1), values.reshape(-1), cigars
