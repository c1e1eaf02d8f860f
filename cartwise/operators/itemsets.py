"""Counts of short itemsets (R1): the sets for which no FP-tree has to be grown.

A task turns its baskets into item codes and lists their sets of two or three by
position; Spark adds up the counts.  Tasks hold the frequent items and pairs only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Baskets whose sets are listed at once.
SLICE = 1000


def positions(lists: pa.ListArray, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List number and code of every item found in ``values``, by list and code, and
    the position at which its list ends."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    code = pc.index_in(lists.flatten(), value_set=values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, code = row[code >= 0], code[code >= 0]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    return row, code, np.searchsorted(row, row, side="right")


def longer(sets: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Every set of positions with one later position of its list."""
    last = sets[:, -1]
    more = end[last] - last - 1
    at = np.repeat(np.arange(len(sets)), more)
    step = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
    return np.column_stack([sets[at], last[at] + 1 + step])


def keys_of(code: np.ndarray, sets: np.ndarray, width: int) -> np.ndarray:
    """One number for each set: its codes as digits to the base ``width``."""
    key = np.zeros(len(sets), np.int64)
    for column in sets.T:
        key = key * width + code[column]
    return key


def listed(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def sets_of(code: np.ndarray, end: np.ndarray, size: int, width: int, pairs: np.ndarray | None) -> np.ndarray:
    """Positions of all sets of ``size`` (2 or 3) items; of three only those whose pairs
    are all among ``pairs``."""
    sets = longer(np.arange(len(code))[:, None], end)
    if size == 2:
        return sets
    sets = longer(sets[listed(keys_of(code, sets, width), pairs)], end)
    return sets[listed(keys_of(code, sets[:, [0, 2]], width), pairs) & listed(keys_of(code, sets[:, 1:], width), pairs)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.column(0).slice(at, SLICE)


def counter(values: pa.Array, size: int, pairs: np.ndarray | None = None) -> Callable:
    """Task: baskets in, (key, n) of their sets of ``size`` out."""
    def run(batches):
        for lists in _slices(batches):
            _, code, end = positions(lists, values)
            key, n = np.unique(keys_of(code, sets_of(code, end, size, len(values), pairs), len(values)),
                               return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "freq"])
    return run


def decoder(values: pa.Array, size: int) -> Callable:
    """Task: (key, freq) in, (items, freq) out."""
    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            digits = [key // len(values) ** i % len(values) for i in reversed(range(size))]
            flat = np.column_stack(digits).astype(np.int64).ravel()
            ends = np.arange(0, len(flat) + 1, size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), values.take(pa.array(flat))), batch.column(1)],
                ["items", "freq"])
    return run


def trimmer(values: pa.Array, size: int, known: np.ndarray | None, pairs: np.ndarray | None) -> Callable:
    """Task: baskets in, those out that can hold a frequent set of more than ``size``
    items, with the items that can be in it: an item of such a set is in ``size`` of
    its subsets of ``size`` items, all of them frequent (``known``) and in the basket."""
    def run(batches):
        for lists in _slices(batches):
            row, code, end = positions(lists, values)
            if size > 1:
                sets = sets_of(code, end, size, len(values), pairs)
                sets = sets[listed(keys_of(code, sets, len(values)), known)]
                stays = np.bincount(sets.ravel(), minlength=len(code)) >= size
                row, code = row[stays], code[stays]
            long = np.bincount(row, minlength=len(lists))[row] > size
            row, code = row[long], code[long]
            ends = np.flatnonzero(np.diff(row, prepend=-1, append=-1)).astype(np.int32) if len(row) else np.zeros(1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), values.take(pa.array(code)))], ["items"])
    return run
