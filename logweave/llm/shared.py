"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from logweave.session import written  # noqa: F401


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """The worker's object of ``key``, made once.  A worker keeps one at a time: what an operator before has
    left goes when the next one's task begins."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class Remembered:
    """Arrays of 32-bit values by 64-bit key, of up to about ``most`` bytes: sorted arrays, no objects a key."""

    def __init__(self, most: int = 32 << 20):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.values = np.zeros(1, np.int64), np.zeros(1 << 12, np.uint32)

    def size(self) -> int:
        return self.keys.nbytes + self.slot.nbytes + self.first.nbytes + self.values.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if it isn't known."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.slot[at], -1) if len(self.keys) else np.full(len(keys), -1)

    def add(self, keys: np.ndarray, values: list) -> np.ndarray:
        """Slots of new keys (sorted, all different) with a list of values each."""
        ends = self.first[-1] + np.cumsum([len(v) for v in values])
        slots = np.arange(len(keys), dtype=np.int32) + np.int32(len(self.first) - 1)
        while ends[-1] > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        self.values[self.first[-1] : ends[-1]] = [x for v in values for x in v]
        self.first = np.concatenate((self.first, ends))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)
        return slots
