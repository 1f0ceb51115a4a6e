"""Vectorised word and shingle hashing over Arrow string columns (numpy, no per-word Python).

A word is a maximal run of bytes other than space and 0x09-0x0D, A-Z lower-cased on request. Words are
named by a 64-bit hash: a polynomial over a fixed random byte table (prefix sums make every word O(1)),
then a finaliser. Texts are handled in pieces of about `PIECE` bytes cut at white space, so scratch memory
does not grow with a text. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        out = np.full(size, base, dtype=U)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(out, dtype=U)
    return have[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n+1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of byte spans of `data`; equal spans have equal names."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(TABLE[data] * _power(_B, n), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power(_BINV, n + 1)[starts] + (ends - starts).astype(U))


def _pieces(data: np.ndarray, at: np.ndarray):
    """Ranges of bytes of about PIECE, cut between texts or, in a long text, at white space."""
    low, end = int(at[0]), int(at[-1])
    while low < end:
        high = min(low + PIECE, end)
        if high < end:
            k = int(np.searchsorted(at, high, "right")) - 1
            if at[k] > low:
                high = int(at[k])
            else:
                stop = int(at[k + 1])
                while high < stop:  # on to the next white space of this text
                    gap = np.flatnonzero(SPACE[data[high : min(high + PIECE, stop)]])
                    if len(gap):
                        high += int(gap[0])
                        break
                    high = min(high + PIECE, stop)
        yield low, high
        low = high


def words(data: np.ndarray, at: np.ndarray, lower: bool = True, spans: bool = False):
    """Hash and text index of every word in order; with `spans`, also first and end byte."""
    names, docs, firsts, lasts = [], [], [], []
    for low, high in _pieces(data, at):
        part = data[low:high]
        if lower:
            part = part + (((part >= 65) & (part <= 90)) * np.uint8(32))
        solid = ~SPACE[part]
        before = np.empty_like(solid)
        before[0], before[1:] = False, solid[:-1]
        after = np.empty_like(solid)
        after[-1], after[:-1] = False, solid[1:]
        cuts = at[np.searchsorted(at, low, "left") : np.searchsorted(at, high, "left")] - low
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
        first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        names.append(span_hashes(part, first, last))
        docs.append(np.searchsorted(at, first + low, "right") - 1)
        if spans:
            firsts.append(first + low)
            lasts.append(last + low)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    out = cat(names, U), cat(docs, np.int64)
    return (*out, cat(firsts, np.int64), cat(lasts, np.int64)) if spans else out


_STEP = mix(np.arange(1, 65, dtype=U)) | U(1)


def shingles(names: np.ndarray, docs: np.ndarray, n: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each run of `size` words; a text of 1 to size-1 words has one, its whole sequence."""
    count = np.bincount(docs, minlength=n)
    with np.errstate(over="ignore"):
        full = max(0, len(names) - size + 1)
        h = np.zeros(full, dtype=U)
        for k in range(size):
            h += names[k : k + full] * _STEP[k]
        keep = docs[:full] == docs[size - 1 : size - 1 + full]
        out, where = [mix(h[keep] + U(size))], [docs[:full][keep]]
        first = np.concatenate([[0], np.cumsum(count)[:-1]]) if n else np.zeros(0, np.int64)
        for length in range(1, size):
            short = np.flatnonzero(count == length)
            if len(short):
                h = np.zeros(len(short), dtype=U)
                for k in range(length):
                    h += names[first[short] + k] * _STEP[k]
                out.append(mix(h + U(length)))
                where.append(short)
    return np.concatenate(out), np.concatenate(where)


def sets(hashes: np.ndarray, docs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each of n texts."""
    order = np.argsort(docs, kind="stable")
    hashes, cut = hashes[order], np.searchsorted(docs[order], np.arange(n + 1))
    return [np.unique(hashes[cut[i] : cut[i + 1]]) for i in range(n)]


def groups_of(at: np.ndarray, limit: int):
    """Row ranges whose texts hold about `limit` bytes, one row at least."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)
