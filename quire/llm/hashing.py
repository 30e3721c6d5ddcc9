"""Vectorised word and n-gram hashing over Arrow text columns, and compact packing of sorted hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits and depend on content only, so that
equal words and windows have equal hashes on every executor.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE, _PIECE = 0x9E3779B97F4A7C15, 1 << 19
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two consecutive pieces from theirs."""
    return mix(a * U(0xD6E8FEB86659FD93) + (b ^ (b >> U(29))) * U(0xA0761D6478BD642F) + U(1))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 12), base & (2**64 - 1), dtype=U)
        grown[0] = 1
        _powers[kind] = have = np.multiply.accumulate(grown)
    return have[:n]


class Words(NamedTuple):
    """Of each word: first byte and the byte after the last in `data`, and its row; of each row: its first word (and one past)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(col: pa.Array, lower: bool = False) -> Words:
    data, at = bytes_of(col)
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~solid[:-1]
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(first))
    return Words(data, start, end, row, first)


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hashes of the words, over pieces of bounded size."""
    out, lo = np.empty(len(w.start), U), 0
    while lo < len(w.start):
        hi = max(lo + 1, int(np.searchsorted(w.end, w.start[lo] + _PIECE, side="right")))
        a, b = int(w.start[lo]), int(w.end[hi - 1])
        total = np.empty(b - a + 1, U)
        total[0] = 0
        np.cumsum(_TABLE[w.data[a:b]] * _power("up", _BASE, b - a), out=total[1:])
        s, e = w.start[lo:hi] - a, w.end[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * _power("down", _INVERSE, b - a)[s] + (e - s).astype(U))
        lo = hi
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive words, by doubling; one for each start that has that many words after it."""
    if len(h) < size:
        return np.zeros(0, U)
    parts, span, level, done = [], 1, h, 0
    while True:
        if size & span:
            parts.append((done, level))
            done += span
        if done == size:
            break
        level, span = join(level[: len(level) - span], level[span:]), span * 2
    n = len(h) - size + 1
    out = parts[0][1][parts[0][0] :][:n]
    for skip, level in parts[1:]:
        out = join(out, level[skip:][:n])
    return out


def inside(row: np.ndarray, size: int) -> np.ndarray:
    """Which windows lie in one row."""
    return row[: len(row) - size + 1] == row[size - 1 :] if len(row) >= size else np.zeros(0, bool)


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by the keys: where a new key begins."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def chained_to(group: np.ndarray, member: np.ndarray, members: int) -> np.ndarray:
    """For each member (numbered from 0) the least one that it is connected with through equal groups."""
    order = np.argsort(group, kind="stable")
    member = member[order]
    at = group_starts(group[order])
    size = np.diff(np.append(at, len(member)))
    own = np.repeat(size > 1, size)  # groups of one connect nothing
    member, size = member[own], size[size > 1]
    label = np.arange(members)
    if not len(member):
        return label
    at = np.cumsum(size) - size
    while True:
        now = label[member]
        low = np.repeat(np.minimum.reduceat(now, at), size)
        if (low == now).all():
            return label
        np.minimum.at(label, now, low)
        while (label[label] != label).any():
            label = label[label]


def pack(x: np.ndarray, sorted_values: bool = False) -> bytes:
    """Integers as differences (if sorted), byte planes apart, compressed."""
    x = np.ascontiguousarray(x)
    if sorted_values and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.copy() if len(x) else np.zeros(0, np.uint8)
    return pa.Codec("zstd", 1).compress(pa.py_buffer(planes), asbytes=True)


def unpack(blob: bytes, n: int, kind: type, sorted_values: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(blob, decompressed_size=n * size, asbytes=True) if n else b""
    x = np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(kind).reshape(n)
    return np.cumsum(x, dtype=kind) if sorted_values else x


def spans(data: np.ndarray, at: np.ndarray, solid: np.ndarray) -> Words:
    """Like words_of, but words are the runs of bytes that `solid` marks; a word never crosses a row."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~solid[:-1]
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    return Words(data, start, end, np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(first)), first)
