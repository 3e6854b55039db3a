"""Whole Arrow batches of texts as flat byte arrays: words, hashes, pieces.

All hashes are 64-bit. Two different values collide with probability about 2**-64 a pair. Where the values of a whole corpus meet by hash alone, suffix and line
deduplication use two independent hashes (128 bits); the Jaccard join names a set by one, so among 10**10 different sets some three pairs are expected to share a name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACES = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[list(_SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
BYTE_1 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BYTE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are worked on in runs of so many bytes: the arrays of a run take some hundred times as much.
PIECE_BYTES = 500_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_powers = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; grows by doubling and is kept."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        p = np.empty(size, U)
        p[0] = 1
        have = 1
        while have < size:
            p[have : 2 * have] = p[:have] * U(pow(base, have, 2**64))
            have *= 2
        _powers[base] = p
    return p[:n]


def text_pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, at, data = col.buffers()
    offs = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(col)
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def trimmed(run):
    """``run``, a function over batches, that returns its freed memory to the system at the end of the task: an executor may have
    several idle workers besides those at work, and each would keep what its peak took."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of every word (run of bytes that aren't spaces; none crosses documents)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Spans of up to so many bytes are hashed eight bytes at a time, longer ones as polynomials.
SHORT = 256


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span; spans must not overlap and must be in order, none empty."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    h = lens.astype(U) * U(0x9E3779B97F4A7C15)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(lens <= SHORT)
    at, left = starts[live], lens[live]
    while len(live):
        w = eight[at] & _MASK[np.minimum(left, 8)]
        x = (h[live] ^ w) * U(0xFF51AFD7ED558CCD)
        h[live] = x ^ (x >> U(32))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lens > SHORT):
        v = BYTE_1[data[starts[i] : ends[i]]] * powers(int(lens[i]))
        h[i] ^= v.sum(dtype=U)
    return mix(h)


class HashIndex:
    """From distinct 64-bit keys to their places, by open addressing; ``find`` gives -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.slots = np.full(1 << max(4, int(4 * len(keys)).bit_length()), -1, np.int32)
        entry = np.arange(len(keys), dtype=np.int32)
        mask = U(len(self.slots) - 1)
        place = keys & mask
        while len(entry):
            free = self.slots[place] < 0
            self.slots[place[free]] = entry[free]
            rest = self.slots[place] != entry
            entry, place = entry[rest], (place[rest] + U(1)) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        mask = U(len(self.slots) - 1)
        live, place = np.arange(len(h)), h & mask
        while len(live):
            entry = self.slots[place]
            got = entry >= 0
            same = got & (self.keys[entry] == h[live])
            out[live[same]] = entry[same]
            on = got & ~same
            live, place = live[on], (place[on] + U(1)) & mask
        return out
