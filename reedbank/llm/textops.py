"""Vectorised text kernels over Arrow string columns, shared by the free-style operators.

A column of texts is seen as one UTF-8 byte array with row offsets.  Words, word hashes and hashes of
word runs come from a few NumPy passes over these bytes, with no Python loop over words.  Hashes of words and of
other byte ranges mix eight bytes at a time in a chain, where each step depends on all before (mixed_ranges).  Where only a place is to be chosen and
equality is not decided, ByteHashes are cheaper: 64-bit polynomials over random byte values, so that any range is a difference of two prefix sums.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text that a kernel works on at a time; a single longer row makes a larger block.
BLOCK_BYTES = 1 << 21

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


with np.errstate(over="ignore"):
    _BYTE_VALUES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
    _RUN_FACTORS = mix64((np.arange(64, dtype=np.uint64) + np.uint64(1000)) * _GOLD) | np.uint64(1)

_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK_BYTES + 1), _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(step)
        _powers[kind] = have
    return have[:n]


def class_table(word_bytes) -> np.ndarray:
    """A table of 256 flags: which bytes belong to words."""
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


#: Words of anything but ASCII white space; bytes of multi-byte characters are never white space.
NON_SPACE = class_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of ASCII digits, lower-case letters and all characters beyond ASCII (texts are lower-cased before).
ALNUM = class_table(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its row offsets, starting at 0; a null is an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Cut rows into runs of at most limit bytes (or one longer row): (first row, end row, bytes, offsets)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: Ranges up to this many bytes are mixed side by side, longer ones one by one.
SIDE_BY_SIDE = 256


def mixed_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), of their bytes and lengths alone."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    with np.errstate(over="ignore"):
        out = mix64(size.astype(np.uint64) * _GOLD + _M1)
    active = np.flatnonzero((size > 0) & (size <= SIDE_BY_SIDE))
    at, left = start[active], size[active]
    while len(active):
        cut = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        x = (eights[at] << cut) >> cut
        with np.errstate(over="ignore"):
            out[active] = mix64((out[active] ^ x) * _GOLD + _M2)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > SIDE_BY_SIDE):
        import xxhash

        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


class ByteHashes:
    """Hashes of arbitrary byte ranges of one block, for choices only: texts can be made that agree in them."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[data] * _power_table("up", len(data)), out=self.sums[1:])
            self.down = _power_table("down", len(data) + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _GOLD)


class Words:
    """Words of a block: byte ranges, hashes, and for each row where its words begin (first has a row more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True, hashed: bool = True):
        data = lower_ascii(data) if lower else data
        n = len(data)
        word = table[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        inner = offsets[:-1]
        before[inner[inner < n]] = False  # a row's first byte starts a word whatever the row before ends with
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        last = offsets[1:] - 1
        after[last[(last >= 0) & (last < n)]] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.data = data
        if hashed:
            self.hash = mixed_ranges(data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; runs across rows are included, see valid_runs."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k) * _GOLD, dtype=np.uint64)
        for j in range(k):
            out += hashes[j : j + n] * _RUN_FACTORS[j]
    return mix64(out)


def valid_runs(first: np.ndarray, k: int, n_runs: int) -> np.ndarray:
    """Which runs of k words lie in one row."""
    ok = np.ones(n_runs, dtype=bool)
    for back in range(1, k):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < n_runs)]] = False
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def cut_list(values: np.ndarray, lengths: np.ndarray, kind):
    """An Arrow list column from flat values and row lengths."""
    import pyarrow as pa

    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
