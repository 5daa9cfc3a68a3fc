"""Vectorised word and shingle hashing over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Hashes are 64-bit
and depend on the bytes alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = U64(0xD6E8FEB86659FD93)
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_BASE))[_LOWER]
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _tables[key] = np.cumprod(steps, dtype=U64)
    return _tables["p"][:n], _tables["i"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if column.null_count and (np.diff(offsets)[~np.asarray(column.is_valid())] > 0).any():
        return buffers(column.fill_null(""))
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all documents in order, first word of each document and the end).

    With ``prefixes`` each word gives a row: its hash, then those of its first so many bytes, or of all
    if it is shorter, each kind apart from the others. Memory beyond the result is bounded by the piece size or the longest single word."""
    hashes, firsts = [], []
    begin, end = int(offsets[0]), int(offsets[-1])
    cuts = offsets[1:-1]
    while begin < end:
        stop = min(begin + _PIECE, end)
        while stop < end:  # never cut inside a word
            blank = np.flatnonzero(_SPACE[data[max(begin, stop - 4096) : stop]])
            if len(blank):
                stop = max(begin, stop - 4096) + int(blank[-1]) + 1
                break
            stop = min(stop + _PIECE, end)
        part = data[begin:stop]
        word = ~_SPACE[part]
        start = word.copy()
        start[1:] &= ~word[:-1]
        inner = cuts[np.searchsorted(cuts, begin) : np.searchsorted(cuts, stop)] - begin
        start[inner] = word[inner]  # a document's first byte opens a word
        first = np.flatnonzero(start)
        if len(first):
            last = word.copy()
            last[:-1] &= ~word[1:] | start[1:]
            last = np.flatnonzero(last) + 1
            power, inverse = _powers(len(part))
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_CODES[part] * power, dtype=U64, out=total[1:])
            own = [mix((total[last] - total[first]) * inverse[first] + (last - first).astype(U64))]
            for cut in prefixes:
                upto = np.minimum(last, first + cut)
                own.append(mix((total[upto] - total[first]) * inverse[first] + (upto - first).astype(U64) + U64(cut << 32)))
            hashes.append(np.stack(own, axis=1) if prefixes else own[0])
            firsts.append(first + begin)
        begin = stop
    flat = np.concatenate(hashes) if hashes else np.zeros((0, 1 + len(prefixes)) if prefixes else 0, U64)
    at = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return flat, np.searchsorted(at, offsets)


def hash_word(text: str) -> int:
    """The hash that word_hashes gives to one word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


def shingle_sets(flat: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its word shingles; with fewer words than ``width``
    the whole sequence is the one shingle; without words the set is empty."""
    rolled = np.zeros(0, U64)
    if len(flat) >= width:
        rolled = flat[: len(flat) - width + 1].copy()
        for j in range(1, width):
            rolled = rolled * _STEP + flat[j : len(flat) - width + 1 + j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = flat[a : a + 1].copy()
            for j in range(a + 1, b):
                h = h * _STEP + flat[j : j + 1]
            out.append(mix(h + U64(b - a)))
        else:
            out.append(flat[:0])
    return out
