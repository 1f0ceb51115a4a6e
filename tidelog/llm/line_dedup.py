"""Line dedup by a segment-partition edit join.

A line is what lies between line feeds; blank lines are left alone. Equal lines form one class. Two classes are linked
if their edit distance (code points inserted, deleted or replaced) is at most what the shorter one's length allows: 1 from
SHORT code points, EDITS = 2 from NEAR, and one in SHARE from LONG, without an upper bound. Lines below SHORT count as
equal only if they are.

Join. A line of length L < LONG that allows e edits is cut into e + 1 segments, which are its index entries under
(L, segment). Two lines within e edits share a segment, and the substrings that must be looked up for it are known by
length: for each indexed length from L - e to L, twelve in all for two edits (the window that multiple matches leave of the
shifts). Longer lines are cut into e + 1 segments by their content instead, as looking up all shifts of all lengths grows
with the cube of e: of the e + 1 stretches between edits one is as long as the mean, so the least hashed GRAM of every
window of that length is an entry (winnowing), and lines that share the stretch share an entry. Entries are told apart by
bands of length, lines at a band's low end entering the one below as well.

Entries (13 bytes each, with the line's length within its band and the place in the line) are dealt to buckets as packed arrays;
a bucket sorts its own, divides the lines of a key where places or lengths leave a gap too wide for a link, and keeps what
has an index entry and two lines.
Keys that gather the same lines are one group. Groups are cut into blocks of BLOCK lines
and block pairs are spread over tasks, twice: first with a sketch of each line (length and character counts), which leaves
lines that may be near another of the block; then with the lines themselves. A pair is looked at in one group only, the
first that both have in order of size (lists of the TOPS largest tell for most, the whole lists for the rest). It is verified by how far the diagonals get with each edit. A task gives counts and a spanning forest of its links, never a
list of pairs, and nothing is capped. Lines are named by 47 bits of a hash where candidates are sought, and by md5 elsewhere.

Result: one row a class with its first occurrence, copies, links and the first occurrence of its component (links
followed throughout). `deduplicated` keeps that one alone. Defined results: null texts have no lines; rows without
doc_id come last in order; rows of one doc_id count as copies; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnum as T
from tidelog.llm.components import components
from tidelog.llm.scratch import Scratch, freed, spark_of

EDITS, SHORT, NEAR, SHARE, BLOCK, BINS = 2, 10, 24, 40, 256, 32
LONG = (EDITS + 1) * SHARE
GRAM, BAND, TOPS = 16, 1.25, 8
STEP, GAP = 0.001, 26  # lengths within a band by logarithm; two lines a share of 1 / SHARE apart differ by ln(1.025) / STEP, and 1 by rounding
BUCKET, FLUSH, SLICE = 64 << 20, 1 << 20, 1 << 19  # bytes of text a bucket, entries a flush, characters a slice
PAIRS, ROWS, BYTES = 1 << 19, 1 << 12, 16 << 20  # pairs looked at together, rows, and bytes of them
CELLS, STRIDE = 1 << 17, 16  # diagonals of pairs that are verified together, words of each that are compared at once
BROADCAST = 1_000_000  # line names, 8 bytes each, sent to all executors at most; more are joined by a shuffle, after
MARKS, PLACES = 27, 3  # a Bloom filter of up to 2 ** MARKS bits, PLACES a name, has left few others
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_ONE = T.U(1)
_HIGH = T.U(0xFFFFFFFF00000000)
_MIXED = T.mix(np.arange(1 << 16, dtype=T.U))


def _slices(column):
    """Texts of about SLICE characters joined by line feeds, as code points; a longer text is cut where a line ends."""
    held, size = [], 0
    for text in column:
        text, low = text.as_py(), 0
        while text and low < len(text):
            high = len(text)
            if high - low > 2 * SLICE:
                high = text.find("\n", low + SLICE)
                high = len(text) if high < 0 else high
            held.append(text[low:high] if low or high < len(text) else text)
            size += high - low
            low = high + 1
            if size >= SLICE:
                yield np.frombuffer("\n".join(held).encode("utf-32-le"), np.uint32)
                held, size = [], 0
    if held:
        yield np.frombuffer("\n".join(held).encode("utf-32-le"), np.uint32)


def _mixed(points: np.ndarray) -> np.ndarray:
    """T.mix of code points."""
    out = _MIXED.take(points, mode="clip")
    beyond = np.flatnonzero(points >= len(_MIXED))
    out[beyond] = T.mix(points[beyond].astype(T.U))
    return out


class _Lines:
    """Lines of SHORT code points or more of one slice, with prefix sums that name any stretch of them."""

    def __init__(self, points: np.ndarray):
        cuts = np.flatnonzero(points == 10)
        start, end = np.append(0, cuts + 1), np.append(cuts, len(points))
        long = end - start >= SHORT
        self.points, self.start, self.length = points, start[long], (end - start)[long]
        with np.errstate(over="ignore"):
            mixed = _mixed(points)
            mixed *= T._power(_B, len(points))
            self.sums = np.empty(len(points) + 1, T.U)
            self.sums[0] = 0
            np.cumsum(mixed, out=self.sums[1:])
        self.names = self.hash(self.start, self.length) >> T.U(17) << _ONE
        self.names, one = np.unique(self.names, return_index=True)
        self.start, self.length = self.start[one], self.length[one]

    def only(self, some: np.ndarray) -> None:
        self.names, self.start, self.length = self.names[some], self.start[some], self.length[some]

    def hash(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return T.mix((self.sums[start + length] - self.sums[start]) * T._power(_INVERSE, len(self.points) + 1)[start] + length.astype(T.U))


def allowed(length):
    """How many edits link a line of `length` code points to a line as long or longer."""
    length = np.asarray(length)
    return np.where(length < SHORT, 0, np.where(length < NEAR, 1, np.maximum(EDITS, length // SHARE)))


def _segments(length: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment k of `parts` of lines of `length`; later ones are longer by one if it does not divide."""
    base, longer = length // parts, length % parts
    before = np.maximum(0, k - (parts - longer))
    return k * base + before, base + (k >= parts - longer)


def entries_of(lines: _Lines) -> tuple[np.ndarray, ...]:
    """Of all index entries and probes the key, the name of the line, the lowest bit marking an index entry, the line's length
    within its band and the place in the line in steps of what edits can shift it."""
    keys, owners, codes, places = [], [], [], []
    with np.errstate(over="ignore"):
        for edits, low, high in ((1, SHORT, NEAR), (EDITS, NEAR, LONG)):  # of indexed lengths
            for less in range(edits + 1):
                some = np.flatnonzero((lines.length - less >= low) & (lines.length - less < high))
                start, length, names = lines.start[some], lines.length[some], lines.names[some]
                for k in range(edits + 1):
                    place, size = _segments(length - less, k, edits + 1)
                    tag = T.mix((length - less).astype(T.U) * T.U(8) + T.U(k))
                    for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                        at = place + shift
                        ok = (at >= 0) & (at + size <= length)
                        keys.append(T.mix(lines.hash((start + at)[ok], size[ok]) ^ tag[ok]))
                        owners.append(names[ok] | T.U(less == 0 and shift == 0))
                        codes.append(np.zeros(len(owners[-1]), np.uint8))  # the key has the length and the place
                        places.append(codes[-1])
        for found in _winnowed(lines):
            for column, part in zip((keys, owners, codes, places), found, strict=True):
                column.append(part)
    return tuple(np.concatenate(column) for column in (keys, owners, codes, places))


def _band(length) -> np.ndarray:
    return np.floor(np.log(length) / np.log(BAND) + 1e-9).astype(np.int64)


@functools.cache
def _window(band: int) -> int:
    """How many GRAMs there are in the stretch that lines of a band share: between e edits on L characters one is (L - e) / (e + 1) long."""
    length = np.arange(max(LONG, int(BAND**band) - 1), int(BAND ** (band + 1)) + 2)
    edits = allowed(length)
    return int((-(-(length - edits) // (edits + 1))).min()) - GRAM + 1


def _winnowed(lines: _Lines):
    """Entries of the lines of LONG code points or more, by band of length."""
    some = np.flatnonzero(lines.length >= LONG)
    if not len(some):
        return
    start, length, names = lines.start[some], lines.length[some], lines.names[some]
    own, low = _band(length), np.maximum(_band(LONG), _band(length / (1 + 1.01 / SHARE)))  # the shortest line it may be linked to
    n = len(lines.sums) - GRAM
    grams = lines.sums[GRAM:] - lines.sums[:-GRAM]
    grams *= T._power(_INVERSE, len(lines.sums))[:n]
    # half a hash and the place: of all, and the least of 8 and of 16 from each on; those across lines are not used
    of16, of8 = grams & _HIGH, np.empty(n, T.U)
    of16 |= np.arange(n, dtype=T.U)
    for k, of, out in ((1, of16, of8), (2, of8, of16), (4, of16, of8), (8, of8, of16)):
        n -= k
        np.minimum(of[:n], of[k : n + k], out=out[:n])
    lower = np.flatnonzero(low < own)  # these enter the band below as well
    here, band = np.concatenate([np.arange(len(some)), lower]), np.concatenate([own, low[lower]])
    bands, band = np.unique(band, return_inverse=True)
    window = np.array([_window(b) for b in bands.tolist()])[band]
    count = length[here] - GRAM - window + 2
    ends = np.cumsum(count)
    heads = ends - count
    found = np.empty(ends[-1], T.U)
    for at, n, w, head in zip(start[here].tolist(), count.tolist(), window.tolist(), heads.tolist(), strict=True):
        of, more = (of8, w - 8) if w <= 16 else (of16, w - 16)
        np.minimum(of[at : at + n], of[at + more : at + more + n], out=found[head : head + n])
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    new[heads] = True
    new = np.flatnonzero(new)
    of = np.searchsorted(ends, new, "right")
    gram = (found[new] & T.U(0xFFFFFFFF)).astype(np.int64)
    steps = allowed((BAND ** (bands + 1)).astype(np.int64) + 1)[band]
    place = ((gram - start[here][of]) // steps[of]).astype(np.uint8)  # 42 at most
    grams = grams[gram]
    new = _new(of, grams, place)  # what repeats goes once
    of, place = of[new], place[new]
    code = np.clip(np.floor((np.log(length[here]) - np.log(BAND) * bands[band]) / STEP), 0, 255).astype(np.uint8)
    tag = T.mix((bands * 8 + 7).astype(T.U))[band]
    yield T.mix(grams[new] ^ tag[of]), (names[here] | _ONE)[of], code[of], place


def _entries(bits: int):
    """Batches (bucket, entries): of each entry 40 bits of the key, below the bucket's, the owner's 48, the length's 8 and the place's 8."""

    def run(batches):
        keys, held = [], 0
        seen = np.zeros(0, T.U)  # names whose entries are given already

        def flush():
            k, o, c, p = (np.concatenate(x) for x in zip(*keys, strict=True))
            order = np.argsort((k >> T.U(48)).astype(np.uint16) if bits <= 16 else k, kind="stable")  # 16 bits are sorted by radix
            k, o, c, p = k[order], o[order], c[order], p[order]
            there = (k >> T.U(64 - bits)).astype(np.int64)
            first = np.flatnonzero(_new(there))
            there = there[first]
            k = k >> T.U(24 - bits)
            parts = (k.astype(np.uint32), o.astype(np.uint32), (o >> T.U(32)).astype(np.uint16), (k >> T.U(32)).astype(np.uint8), c, p)
            blobs = [b"".join(x[a:b].tobytes() for x in parts) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(k)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(there), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for points in _slices(batch.column(0)):
                lines = _Lines(points)
                lines.only(~_among(seen)(lines.names))
                if not len(lines.names):
                    continue
                seen = np.sort(np.concatenate([seen if len(seen) < FLUSH else seen[:0], lines.names]))
                keys.append(entries_of(lines))
                held += len(keys[-1][0])
                if held >= FLUSH:
                    yield flush()
                    keys, held = [], 0
        if keys:
            yield flush()

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n = len(blob) // 13
    at = lambda kind, offset: np.frombuffer(blob, kind, n, offset * n)
    wide = lambda low, kind, high: at(np.uint32, low).astype(T.U) | at(kind, high).astype(T.U) << T.U(32)
    return wide(0, np.uint8, 10), wide(4, np.uint16, 8), at(np.uint8, 11), at(np.uint8, 12)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where any of sorted columns changes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _shared(keys: np.ndarray, owners: np.ndarray, codes: np.ndarray, places: np.ndarray):
    """(signature, size, line name) of the groups of one bucket's entries."""
    if len(keys) < 1 << 24:  # key and place in one number, which is sorted faster
        order = np.sort(keys << T.U(24) | np.arange(len(keys), dtype=T.U))
        sorted_keys, order = order >> T.U(24), (order & T.U((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if not twice.any():
        return None
    order = order[twice]
    keys, owners, codes, places = sorted_keys[twice], owners[order], codes[order].astype(np.int16), places[order].astype(np.int16)
    order = np.argsort(keys << T.U(8) | places.astype(T.U))  # first the lines of a key are divided by place, then each part by length
    keys, owners, codes, places = keys[order], owners[order], codes[order], places[order]
    part = np.cumsum(_new(keys) | np.concatenate([[True], places[1:] > places[:-1] + 1]))
    if len(part) < 1 << 24:  # 32 bits of a name do to bring the entries of a line together, as its code is one
        order = np.argsort(part.astype(T.U) << T.U(40) | codes.astype(T.U) << T.U(32) | owners & T.U(0xFFFFFFFF))
    else:
        order = np.lexsort((owners, codes, part))
    owners, codes, part = owners[order], codes[order], part[order]
    part = np.cumsum(_new(part) | np.concatenate([[True], codes[1:] > codes[:-1] + GAP]))
    names = owners & ~_ONE
    last = np.append(_new(part, names)[1:], True)  # the entry that marks an index entry, if a line has both
    owners, names, part = owners[last], names[last], part[last]
    group = np.cumsum(_new(part)) - 1
    good = ((np.bincount(group) > 1) & (np.bincount(group, owners & _ONE) > 0))[group]
    names, group = names[good], group[good]
    if not len(names):
        return None
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, len(group)))
    with np.errstate(over="ignore"):
        sign = np.add.reduceat(T.mix(names), first)
    keep = np.zeros(len(sign), bool)
    keep[np.unique(sign, return_index=True)[1]] = True
    keep = np.repeat(keep, size)
    return np.repeat(sign, size)[keep].view(np.int64), np.repeat(size, size)[keep], names[keep].view(np.int64)


def _groups(batches):
    """Rows (bucket, entries) sorted by bucket."""
    now, held, size = None, [], 0

    def close():
        found = _shared(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if found:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["sign", "size", "name"])

    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and bucket != now:
                if out := close():
                    yield out
                held, size = [], 0
            now = bucket
            held.append(_unpacked(blob.as_buffer().to_pybytes()))
            size += len(held[-1][0])
            if size > 1 << 23:  # entries of one line in many slices
                keys, owners, codes, places = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((places, owners, keys))
                order = order[_new(keys[order], owners[order], places[order])]
                held = [(keys[order], owners[order], codes[order], places[order])]
                size = min(size // 2, len(held[0][0]))
    if held and (out := close()):
        yield out


def _among(wanted: np.ndarray):
    """Where names are among `wanted` (sorted)."""

    def held(names):
        spot = np.minimum(np.searchsorted(wanted, names), max(0, len(wanted) - 1))
        return wanted[spot] == names if len(wanted) else np.zeros(len(names), bool)

    return held


def _spots(names: np.ndarray, bits: int):
    """The PLACES bits of each name in a filter of 2 ** bits."""
    with np.errstate(over="ignore"):
        for k in range(PLACES):
            yield T.mix(names + T.U(k) * T.U(_B)) >> T.U(64 - bits)


def _marked(names: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter, as words of 64 bits, of all names."""

    def run(batches):
        words = np.zeros(1 << bits - 6, T.U)
        for batch in batches:
            for spot in _spots(batch.column(0).to_numpy(zero_copy_only=False).view(T.U), bits):
                np.bitwise_or.at(words, spot >> T.U(6), _ONE << (spot & T.U(63)))
        some = np.flatnonzero(words)
        for low in range(0, len(some), 1 << 16):
            at = some[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["word", "bits"])

    rows = names.select("name").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, T.U)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(T.U)
    return words


def _maybe_among(words: np.ndarray):
    """Where names may be among those of a filter."""
    bits = 6 + (len(words) - 1).bit_length()

    def held(names):
        out = np.ones(len(names), bool)
        for spot in _spots(names, bits):
            out &= (words[spot >> T.U(6)] >> (spot & T.U(63)) & _ONE).astype(bool)
        return out

    return held


def _texts(held):
    """Lines (name, class, line, length, sketch) of the names that are `held`. The sketch counts characters by their low bits."""

    def run(batches):
        for batch in batches:
            for points in _slices(batch.column(0)):
                lines = _Lines(points)
                keep = np.flatnonzero(held(lines.names))
                parts = [points[s : s + n] for s, n in zip(lines.start[keep].tolist(), lines.length[keep].tolist(), strict=True)]
                texts = [p.tobytes().decode("utf-32-le") for p in parts]
                ids = [hashlib.md5(t.encode()).digest() for t in texts]
                sketches = [c.tobytes() for c in _counts(parts).astype(np.uint16)]
                columns = [pa.array(lines.names[keep].view(np.int64)), pa.array(ids, pa.binary()), pa.array(texts, pa.string()), pa.array(lines.length[keep]), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "class", "line", "length", "sketch"])

    return run


def _counts(parts: list[np.ndarray]) -> np.ndarray:
    """How often characters with each value of the low bits occur, up to 65,535."""
    if not parts:
        return np.zeros((0, BINS), np.int32)
    line = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    counts = np.bincount(line * BINS + (np.concatenate(parts) & (BINS - 1)), minlength=len(parts) * BINS)
    return np.minimum(counts, 0xFFFF).reshape(-1, BINS).astype(np.int32)


def _pairs(block: np.ndarray):
    """All pairs (i < j) of neighbours with equal `block`, about PAIRS of them at a time."""
    n = len(block)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(np.append(first, n))
    more = np.repeat(first + size, size) - np.arange(n) - 1
    done, low = np.cumsum(more), 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS, "right")))
        left = np.repeat(np.arange(low, high), more[low:high])
        step = np.arange(len(left)) - np.repeat(np.cumsum(more[low:high]) - more[low:high], more[low:high])
        yield left, left + 1 + step
        low = high


def _may_be_near(table: pa.Table, block: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block to look at, and whether it is settled that this is their only block.

    Lengths and character counts admit them (an edit changes two counts by one at most). A pair whose `tops` meet is looked
    at in the group of the first they share; lists being in the same order, none that both have can come before it.
    """
    across, chunk, sign = table["lo"].to_numpy() != table["hi"].to_numpy(), table["chunk"].to_numpy(), table["sign"].to_numpy()
    tops = table["tops"].combine_chunks()
    size = tops.value_lengths().to_numpy()
    top = np.full((len(sign), TOPS), -1, np.int64)
    rest = np.arange(TOPS) < size[:, None]
    top[rest] = tops.flatten().to_numpy()
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    folded = counts.reshape(len(counts), -1, 4).sum(2, dtype=np.int32)  # differ by no more than the counts do
    apart = lambda counts, a, b: np.einsum("ij->i", np.abs(counts.take(a, 0) - counts.take(b, 0)))
    for i, j in _pairs(block):
        most = allowed(np.minimum(length[i], length[j]))
        ok = (np.abs(length[i] - length[j]) <= most) & (~across[i] | (chunk[i] != chunk[j]))
        i, j, most = i[ok], j[ok], most[ok]
        for low in range(0, len(i), 1 << 16):
            a, b = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            edits = 2 * most[low : low + (1 << 16)]
            near = np.flatnonzero(apart(folded, a, b) <= edits)
            a, b, edits = a[near], b[near], edits[near]
            near = apart(counts, a, b) <= edits
            a, b = a[near], b[near]
            both = (top[a][:, :, None] == top[b][:, None, :]).view(T.U)[:, :, 0] != 0  # any of TOPS bytes
            both &= rest[a]
            settled = both.any(1)
            keep = ~settled | (top[a, both.argmax(1)] == sign[a])
            out.append((a[keep], b[keep], settled[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks_of(batches, most: int):
    """Tables (sign, lo, hi, ...) of `most` rows or BYTES, about, sorted and whole by (sign, lo, hi), with a number for each block."""
    held, size, weight = [], 0, 0

    def numbered(table):
        columns = [table.column(k).to_numpy() for k in range(3)]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        weight += batch.nbytes
        if size >= most or weight >= BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            block = numbered(table)
            whole = int(np.searchsorted(block, block[-1]))
            if whole:
                yield table.slice(0, whole), block[:whole]
            held, size = table.slice(whole).to_batches(), table.num_rows - whole
            weight = table.slice(whole).nbytes
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, numbered(table)


def _sketched(batches):
    """Rows (sign, lo, hi, chunk, tops, name, class, length, sketch): those to be looked at with another of their block, without the last two."""
    for table, block in _blocks_of(batches, ROWS):
        counts = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32)
        left, right, _ = _may_be_near(table, block, table["length"].to_numpy(), counts)
        some = np.unique(np.concatenate([left, right]))
        yield from table.take(pa.array(some)).select(["sign", "lo", "hi", "chunk", "tops", "name", "class"]).to_batches()


def _words(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each place the eight bytes of characters from it on, and how many characters these are; the end is padded."""
    peak = int(points.max()) if len(points) else 0
    kind = np.dtype(np.uint8 if peak <= 0xFF else np.uint16 if peak <= 0xFFFF else np.uint32)
    padded = np.zeros(len(points) + 8, kind)
    padded[: len(points)] = points
    return np.ndarray((len(points) + 1,), T.U, padded, strides=(kind.itemsize,)).copy(), 8 // kind.itemsize


def _distances(words: np.ndarray, many: int, at_a: np.ndarray, la: np.ndarray, at_b: np.ndarray, lb: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of stretches of the characters of `words`, or `most` + 1 beyond that.

    How far each diagonal gets with 0, 1, 2... edits, for all pairs at once; a diagonal that is further from the last one
    than edits are left is not followed. Equal characters are passed a word of `many` at a time.
    """
    out = most + 1
    live = np.flatnonzero(np.abs(la - lb) <= most)
    if not len(live):
        return out
    at_a, la, at_b, lb, most = at_a[live], la[live], at_b[live], lb[live], most[live]
    widest, bits = int(most.max()), 64 // many
    width = 2 * widest + 3  # one more at either side
    reach = np.full((len(live), width), -(1 << 40))
    reach[:, widest + 1] = 0
    for edits in range(widest + 1):
        diagonal = np.arange(-edits, edits + 1)
        low, high = widest + 1 - edits, widest + 2 + edits
        now, shift = reach[:, low:high], (lb - la)[:, None]
        if edits:
            further = np.maximum(np.maximum(now, reach[:, low + 1 : high + 1]) + 1, reach[:, low - 1 : high - 1])
            now[:] = np.minimum(further, np.minimum(la[:, None], lb[:, None] - diagonal))
        row, column = np.nonzero((now >= np.maximum(0, -diagonal)) & (np.abs(diagonal - shift) <= (most - edits)[:, None]))
        at = row * width + (column + low)
        flat, aside = reach.reshape(-1), diagonal[column]
        i = flat[at]
        x, y = at_a[row] + i, at_b[row] + i + aside
        room = np.minimum(la[row] - i, lb[row] - i - aside)
        step = np.zeros(1, np.int64)  # a word where most end, then STRIDE at once
        while len(at):
            other = words.take(x[:, None] + step, mode="clip") ^ words.take(y[:, None] + step, mode="clip")
            word = (other != 0).argmax(1)
            other = other[np.arange(len(at)), word]  # the first that differs; its equal characters are zeros below the lowest one
            run = word * many + np.bitwise_count((other & (~other + _ONE)) - _ONE).astype(np.int64) // bits
            run[other == 0] = len(step) * many
            flat[at] += np.minimum(run, room)
            more = np.flatnonzero((other == 0) & (room > run))
            at, x, y, room, step = at[more], x[more] + run[more], y[more] + run[more], room[more] - run[more], np.arange(STRIDE) * many
        shift = shift[:, 0]
        ended = (np.abs(shift) <= edits) & (reach[np.arange(len(live)), widest + 1 + np.clip(shift, -edits, edits)] == la)
        out[live[ended]] = edits
        stay = np.flatnonzero(~ended & (most > edits))
        if not len(stay):
            break
        if len(stay) < len(live):
            live, reach = live[stay], reach[stay]
            at_a, la, at_b, lb, most = at_a[stay], la[stay], at_b[stay], lb[stay], most[stay]
    return out


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings one after the other, where each begins and its length."""
    size = np.array([len(x) for x in texts], np.int64)
    return np.concatenate(texts) if texts else np.zeros(0, np.uint32), np.cumsum(size) - size, size


def distances_within(a: list[np.ndarray], b: list[np.ndarray], most: int = EDITS) -> np.ndarray:
    """Edit distance of each pair of code point arrays, or `most` + 1 beyond that."""
    points, at, size = _laid(a + b)
    n = len(a)
    return _distances(*_words(points), at[:n], size[:n], at[n:], size[n:], np.full(n, most, np.int64))


def distances_beyond(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether each pair is within its own `most`, of any size."""
    points, at, size = _laid(a + b)
    n = len(a)
    return _distances(*_words(points), at[:n], size[:n], at[n:], size[n:], most.astype(np.int64)) <= most


def _bigrams(points: list[np.ndarray]) -> np.ndarray:
    """How often pairs of neighbouring characters occur, by 512 values of a hash."""
    flat = np.concatenate(points)
    line = np.repeat(np.arange(len(points)), [len(p) for p in points])
    both = (flat[:-1] * np.uint32(37) + flat[1:]) & np.uint32(511)
    inside = line[1:] == line[:-1]
    return np.bincount(line[1:][inside] * 512 + both[inside], minlength=512 * len(points)).reshape(-1, 512).astype(np.int32)


def _verify(points: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether pairs are as near as the shorter one's length allows. An edit takes and gives two pairs of neighbours at most, so
    their counts rule most of the others out; then by the edit distance, in chunks that allow about as many edits."""
    flat, at, size = _laid(points)
    most = allowed(np.minimum(size[left], size[right]))
    counts, out = _bigrams(points), np.zeros(len(left), bool)
    for low in range(0, len(left), 1 << 13):
        high = low + (1 << 13)
        out[low:high] = np.abs(counts[left[low:high]] - counts[right[low:high]]).sum(1) <= 4 * most[low:high]
    order, first = np.flatnonzero(out), 0
    order = order[np.argsort(most[order], kind="stable")]
    words, many = _words(flat)
    while first < len(order):
        last = first + 1
        while last < len(order) and (last - first) * (2 * int(most[order[last]]) + 3) < CELLS:
            last += min(64, len(order) - last)
        here = order[first:last]
        a, b = left[here], right[here]
        out[here] = _distances(words, many, at[a], size[a], at[b], size[b], most[here]) <= most[here]
        first = last
    return out


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what `left`, `right` connect: each node to the least of its component."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _links(batches):
    """Block pairs (sign, lo, hi, chunk, tops, signs, class, line), sorted: rows (class, links, other), `other` null in rows that count."""
    for table, block in _blocks_of(batches, ROWS):
        ids = table["class"].combine_chunks().dictionary_encode()
        names, line = ids.dictionary.to_pylist(), ids.indices.to_numpy().astype(np.int64)
        texts = table["line"].take(pa.array(np.unique(line, return_index=True)[1])).to_pylist()
        points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        size = np.array([len(p) for p in points])
        left, right, settled = _may_be_near(table, block, size[line], _counts(points)[line])
        open_, sign = np.flatnonzero(~settled), table["sign"].to_numpy()
        lists = {i: table["signs"][i].as_py() for i in np.unique(np.concatenate([left[open_], right[open_]])).tolist()}
        sets = {i: set(x) for i, x in lists.items()}
        for k, i, j in zip(open_.tolist(), left[open_].tolist(), right[open_].tolist(), strict=True):  # the first of all groups that both have
            settled[k] = next(x for x in lists[i] if x in sets[j]) == sign[i]
        left, right = line[left[settled]], line[right[settled]]
        good = _verify(points, left, right)
        left, right = left[good], right[good]
        links = np.bincount(left, minlength=len(names)) + np.bincount(right, minlength=len(names))
        some = np.flatnonzero(links)
        a, b = _forest(len(names), left, right)
        out = [[names[i] for i in some] + [names[i] for i in b], links[some].tolist() + [0] * len(b), [None] * len(some) + [names[i] for i in a]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["class", "links", "other"])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line number, line) of all lines that are not blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line", "words"))
    return rows.where(F.regexp_like("words", F.lit(r"[^\x20\x09-\x0D]")))


def classes(docs: DataFrame) -> DataFrame:
    """(class, copies, first) of all distinct lines; `first` orders occurrences, those without doc_id last."""
    first = F.struct(F.col("doc_id").isNull().alias("unnumbered"), F.col("doc_id"), F.col("line").cast("long").alias("line"))
    return _lines(docs).groupBy(F.unhex(F.md5("words")).alias("class")).agg(F.count("*").alias("copies"), F.min(first).alias("first"))


def _every_and_near(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All classes, and those with links (class, n_links, component, first), in tables of `scratch`."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (total // BUCKET).bit_length())
    dealt = texts.mapInArrow(_entries(bits), "bucket long, entries binary").repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    groups = dealt.mapInArrow(_groups, "sign long, size long, name long")
    groups = scratch.keep(groups.groupBy("sign", "name").agg(F.max("size").alias("size")), "groups")
    order = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("size"), "sign")))  # as many as a line has entries
    names = scratch.keep(groups.groupBy("name").agg(order["sign"].alias("signs")), "names")

    count = names.count()
    exact = count <= BROADCAST
    if exact:
        held = _among(np.sort(names.select("name").toArrow().column(0).to_numpy().view(T.U)) if count else np.zeros(0, T.U))
    else:
        held = _maybe_among(_marked(names, min(MARKS, max(10, (8 * count).bit_length()))))
    found = scratch.keep(texts.mapInArrow(_texts(held), "name long, class binary, line string, length long, sketch binary"), "texts")
    sketches = found.select("name", "class", "length", "sketch")
    sketches = (sketches if exact else sketches.join(names, "name", "left_semi")).groupBy("name", "class").agg(F.first("length").alias("length"), F.first("sketch").alias("sketch"))

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    tops = names.select("name", F.slice("signs", 1, TOPS).alias("tops"))
    rows = groups.join(tops.join(sketches, "name"), "name").withColumn("blocks", blocks)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sign", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "tops", "name", "class", "length", "sketch")
    dealt = lambda df: df.repartition("sign", "lo", "hi").sortWithinPartitions("sign", "lo", "hi")
    near = scratch.keep(dealt(rows).mapInArrow(_sketched, "sign long, lo int, hi int, chunk int, tops array<long>, name long, class binary"), "near")
    some = scratch.keep(near.select("class").distinct(), "some")
    few = F.broadcast(some) if some.count() <= BROADCAST else some
    lines = found.select("class", "line").join(few, "class", "left_semi").groupBy("class").agg(F.first("line").alias("line"))
    near = near.join(lines, "class").join(names, "name").select("sign", "lo", "hi", "chunk", "tops", "signs", "class", "line")
    linked = scratch.keep(dealt(near).mapInArrow(_links, "class binary, links long, other binary"), "links")
    scratch.drop("groups", "names", "texts", "near", "some")
    joined = components(linked.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")), scratch, "lines")
    degree = linked.where("other is null").groupBy("class").agg(F.sum("links").alias("n_links"))
    near = degree.join(joined, F.col("class") == F.col("node"), "left").select("class", "n_links", "component")

    every = scratch.keep(classes(docs), "classes")
    return every, scratch.keep(near.join(every.select("class", "first"), "class"), "near-first")


def near_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, copies, n_links, component_doc, component_line, kept) of every distinct line of `docs` (doc_id, text)."""
    scratch = Scratch(spark_of(docs), "lines")
    with freed(scratch.spark):
        every, near = _every_and_near(docs, scratch)
    heads = near.groupBy("component").agg(F.min("first").alias("head"))
    near = near.join(heads, "component").select("class", "n_links", "head")
    out = every.join(near, "class", "left").withColumn("head", F.coalesce("head", "first"))
    return out.select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"), "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("head.doc_id").alias("component_doc"), F.col("head.line").alias("component_line"), (F.col("first") == F.col("head")).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with their text cut to its first occurrences of lines (and blank lines); other columns as they are.

    Rows of one doc_id keep the same lines. Rows without doc_id, whose lines cannot be told apart, stay whole.
    """
    keep = near_lines(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.col("line").cast("int")).alias("__keep"))
    lines = F.split(F.col("text"), "\n")
    numbered = F.transform(lines, lambda x, k: F.when(F.array_contains(F.coalesce(F.col("__keep"), F.array().cast("array<int>")), k) | ~F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")), x))
    cut = F.array_join(F.filter(numbered, lambda x: x.isNotNull()), "\n")
    out = docs.join(keep, F.col("doc_id").cast("long") == F.col("__id"), "left")
    return out.withColumn("text", F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(cut)).drop("__id", "__keep")
