"""Vectorised text kernels shared by the operators of this subpackage.

All of them work on the byte buffers of Arrow string columns, so that no Python
string is made for a document.  A word is a maximal run of bytes outside
``0x20, 0x09-0x0D`` with A-Z lower-cased; hashes are 64-bit and depend on nothing
but the bytes, so every executor gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
STEP = np.array([pow(0xD6E8FEB86659FD93, i + 1, 2**64) for i in range(64)], dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_CODE = BYTE_CODE[LOWER]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges (lo, hi) of at most ``limit`` bytes, or one row where that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def powers(n: int, base: np.uint64 = BASE, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """At least n powers of ``base``, from 1."""
    if base not in _kept or len(_kept[base]) < n:
        full = np.full(max(n, 4096), base, dtype=np.uint64)
        full[0] = 1
        _kept[base] = np.multiply.accumulate(full)
    return _kept[base]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows: (hash per word, start byte, end byte, first word of each row and the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = ~IS_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    lens = ends - starts
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), starts, ends, np.zeros(len(offsets), dtype=np.int64)
    # sum(code[i] * BASE**(i - start)) over a word is a difference of prefix sums, divided by BASE**start
    sums = np.zeros(n + 1, dtype=np.uint64)
    code = (LOWER_CODE if lower else BYTE_CODE)[data]
    code *= powers(n)[:n]
    np.cumsum(code, out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(n, BACK)[starts]
    return mix64(h + lens.astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets)


def word_shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and each row's first; a row of 1 to k-1 words has one, of all its words."""
    n = np.diff(rows)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(m)])
    at = np.arange(first[-1], dtype=np.int64) + np.repeat(rows[:-1] - first[:-1], m)
    end = np.repeat(rows[1:], m)
    out = np.zeros(first[-1], dtype=np.uint64)
    whole = bool((n[n > 0] >= k).all())
    for i in range(k):
        if whole:
            out += hashes[at + i] * STEP[i]
        else:
            ok = at + i < end
            out[ok] += hashes[at[ok] + i] * STEP[i]
    return mix64(out), first


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each character of UTF-8 rows, and each row's first."""
    if not len(data) or data.max() < 0x80:
        return BYTE_CODE[data], offsets
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    follow = np.flatnonzero((data & 0xC0) == 0x80)
    code = BYTE_CODE[points & np.uint32(0xFF)]
    wide = np.flatnonzero(points > 0x7F)
    code[wide] = mix64(points[wide].astype(np.uint64) + BASE)
    return code, offsets - np.searchsorted(follow, offsets)


def runs(codes: np.ndarray, k: int) -> np.ndarray:
    """sum(codes[i + j] * BASE**j for j < k) at each i, with 0 beyond the end, by doubling."""
    out, width, done = None, 1, 0
    part = codes
    shift = lambda a, n: np.concatenate([a[n:], np.zeros(min(n, len(a)), dtype=np.uint64)])
    while True:
        if k & width:
            out = part.copy() if out is None else out + shift(part, done) * powers(done + 1)[done]
            done += width
        if done == k:
            return out
        part = part + shift(part, width) * powers(width + 1)[width]
        width *= 2


def char_shingles(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k character codes and each row's first; a row of 1 to k-1 has one, of them all."""
    n = np.diff(offsets)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(m)])
    use = np.ones(len(codes), dtype=bool)
    ends = offsets[1:][n >= k]
    for j in range(1, k):
        use[ends - j] = False
    out = runs(codes, k) if len(codes) else codes
    short = np.flatnonzero((n > 0) & (n < k))
    for r in short:
        lo, hi = offsets[r], offsets[r + 1]
        use[lo + 1 : hi] = False
        out[lo] = ((codes[lo:hi] * powers(k)[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + STEP[63:] * np.uint64(hi - lo))[0]
    return mix64(out[use]), first


class MinHash:
    """``bands`` x ``rows`` minwise values of shingle hashes, and their band keys."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, self.n = bands, rows, bands * rows
        self.a = (rng.integers(0, 2**31, self.n, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.x = rng.integers(0, 2**32, self.n, dtype=np.int64).astype(np.uint32)
        self.c = rng.integers(1, 2**62, rows, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def values(self, shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
        """uint32 per row and function; rows without shingles get the largest value."""
        full = np.flatnonzero(np.diff(first))
        out = np.full((len(first) - 1, self.n), 0xFFFFFFFF, dtype=np.uint32)
        if not len(full):
            return out
        low, at = (shingles >> np.uint64(32)).astype(np.uint32), first[full]
        buf = np.empty_like(low)
        got = np.empty((self.n, len(full)), dtype=np.uint32)
        for i in range(self.n):
            np.bitwise_xor(low, self.x[i], out=buf)
            np.multiply(buf, self.a[i], out=buf)
            np.minimum.reduceat(buf, at, out=got[i])
        out[full] = got.T
        return out

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One int64 for each row and band."""
        v = values.reshape(len(values), self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        h = (v * self.c).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * BASE
        return mix64(h).view(np.int64)


def rows_hash(values: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """An order-sensitive 64-bit hash of each row's values."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.arange(first[-1], dtype=np.int64) - np.repeat(first[:-1], n)
        w = mix64(values ^ np.uint64(salt)) * powers(int(n.max()))[at]
        out[full] = np.add.reduceat(w, first[full])
    return mix64(out + n.astype(np.uint64) * np.uint64(salt | 1))
