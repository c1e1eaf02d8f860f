"""Vectorised words and hashes over Arrow text columns.

A column's UTF-8 bytes are handled as one numpy array: words are maximal runs of
bytes of a class, and a word's hash comes from prefix sums of a polynomial over
its bytes.  All classes used here are decided by single bytes, since every byte
of a non-ASCII character is 0x80 or more."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once (a longer document is handled alone).
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but white space.
NON_SPACE = ~SPACE
#: Words are runs of digits, a-z and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """The bytes of some texts, their offsets, and their words once asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: np.ndarray, lower: bool = False) -> Texts:
        """Find words: ``starts``, ``ends`` (byte places), ``first`` (the first
        word of each text, and the total) and ``doc`` (the text of each word)."""
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = kind[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:n]
        stops[:-1] &= ~inside[1:] | cut[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(self)), np.diff(self.first))
        return self

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def lane_hashes(texts: Texts) -> np.ndarray:
    """A 64-bit hash of each word, from its length and its bytes eight at a time."""
    n = len(texts.data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = texts.data
    eights = np.ndarray(n + 1, "<u8", padded, 0, (1,))
    left = texts.ends - texts.starts
    h = mix(left.astype(np.uint64) + _BASE)
    at, rest = np.arange(len(left)), left
    places = texts.starts
    while len(at):
        short = np.uint64(8) * np.clip(8 - rest, 0, 7).astype(np.uint64)
        lane = (eights[places] << short) >> short
        h[at] = mix(h[at] ^ (lane * _BASE + _BASE))
        more = rest > 8
        at, rest, places = at[more], rest[more] - 8, places[more] + 8
    return h


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` consecutive values."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    n = len(h) - width + 1
    return mix((sums[width:] - sums[:n]) * down[:n])


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Split a batch into slices of at most ``limit`` bytes of text; null is empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    if not len(texts):
        return
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(places, places[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield batch.slice(at, to - at), Texts(data[places[at]:places[to]], places[at:to + 1] - places[at])
        at = to


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """``run`` for mapInArrow, with the task's free memory given back at its end: a
    Python worker waits for its next task beside the executor's JVM."""
    def task(batches):
        yield from run(batches)
        give_back()
    return task


def names_of(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False)
