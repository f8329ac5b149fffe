"""Bloom filters that grow: a chain of links, each larger and stricter than the one before.

Where a link ends depends on the order of arrival, so a chain is a fold of one key in one task, whose
rows are put in order in many (`ordered`). Prefer `bloom` with a capacity taken from approx_count_distinct where order doesn't matter.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchwell.functions.hashing import pair
from sketchwell.functions.ordered import folded, pieces
from sketchwell.operators.bloom import CHAIN_BYTES, LINK_BYTES
from sketchwell.options import BloomOptions

_HEAD = struct.Struct("<QdQI")


class Chain:
    """Links of (capacity, error, bits, hashes), their bits and how many items each took."""

    def __init__(self, o: BloomOptions):
        self.o, self.links = o, []
        self._grow()

    def _grow(self) -> None:
        shape = self.o.link(len(self.links))
        self.links.append([shape, bytearray(shape[2] // 8), 0])

    @staticmethod
    def _hash(item: str) -> tuple[int, int]:
        d = hashlib.md5(str(item).encode()).hexdigest()
        return int(d[:8], 16), int(d[8:16], 16) | 1

    @staticmethod
    def _has(link, a: int, b: int) -> bool:
        (_, _, bits, hashes), data, _ = link
        return all(data[p >> 3] >> (p & 7) & 1 for p in ((a + i * b) % bits for i in range(hashes)))

    def __contains__(self, item: str) -> bool:
        a, b = self._hash(item)
        return any(self._has(x, a, b) for x in reversed(self.links))

    def add(self, item: str) -> bool | None:
        """True if new, False if maybe known, None where the filter is full and may not grow."""
        a, b = self._hash(item)
        if any(self._has(x, a, b) for x in reversed(self.links)):
            return False
        if self.links[-1][2] >= self.links[-1][0][0]:
            if self.o.nonscaling:
                return None
            self._grow()
        (_, _, bits, hashes), data, _ = self.links[-1]
        for i in range(hashes):
            p = (a + i * b) % bits
            data[p >> 3] |= 1 << (p & 7)
        self.links[-1][2] += 1
        return True

    def add_all(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        """Adds items of these hashes as `add` would one by one; how many were new, and how many were looked at: all,
        or those before the first that a full filter refuses.

        An item is known if all its places of a link are set, and then sets none: so an item is new if it is the first
        of these at one of its places that isn't set.
        """
        a, b, new, seen = a.astype(np.int64), b.astype(np.int64) | 1, 0, 0
        old = self.links[:-1]
        while len(a):
            wait = np.arange(len(a))
            for link in reversed(old):
                wait = wait[~self._has_all(link, a[wait], b[wait])]
            (capacity, _, bits, hashes), data, held = self.links[-1]
            places = (a[wait, None] + np.arange(hashes) * b[wait, None]) % bits
            view = np.frombuffer(data, np.uint8)
            at = np.flatnonzero((view[places >> 3] >> (places & 7) & 1 == 0).ravel())
            _, first = np.unique(places.ravel()[at], return_index=True)
            fresh = np.unique(at[first] // hashes)  # in order: those of wait that are new
            fits = fresh[: capacity - held]
            p = places[fits].ravel()
            np.bitwise_or.at(view, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
            self.links[-1][2] += len(fits)
            new += len(fits)
            if len(fits) == len(fresh):
                return new, seen + len(a)
            start = int(wait[fresh[len(fits)]])  # finds the link full
            seen += start
            if self.o.nonscaling:
                return new, seen
            old = self.links[:]
            self._grow()
            a, b = a[start:], b[start:]
        return new, seen

    @staticmethod
    def _has_all(link, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (_, _, bits, hashes), data, _ = link
        view, left = np.frombuffer(data, np.uint8), np.arange(len(a))
        for i in range(hashes):
            p = (a[left] + i * b[left]) % bits
            left = left[view[p >> 3] >> (p & 7) & 1 == 1]
        has = np.zeros(len(a), bool)
        has[left] = True
        return has

    @property
    def size(self) -> int:
        return sum(x[2] for x in self.links)

    @property
    def memory(self) -> int:
        return CHAIN_BYTES + sum(LINK_BYTES + len(x[1]) for x in self.links)

    def dump(self, most: int = 16 << 20):
        """Chunks (number, bytes): the header, then bits of the links in parts of at most `most` bytes."""
        o = self.o
        yield 0, struct.pack("<dQI?I", o.error_rate, o.capacity, o.expansion, o.nonscaling, len(self.links)) + b"".join(_HEAD.pack(x[0][0], x[0][1], x[0][2], x[0][3]) + struct.pack("<Q", x[2]) for x in self.links)
        number = 1
        for _, data, _ in self.links:
            for at in range(0, len(data), most):
                yield number, bytes(data[at : at + most])
                number += 1

    @classmethod
    def load(cls, chunks) -> Chain:
        """A chain from dumped chunks in any order; missing, odd or surplus bytes are a ValueError."""
        parts = [d for _, d in sorted(chunks)]
        try:
            error, capacity, expansion, fixed, n = struct.unpack_from("<dQI?I", parts[0])
            at, heads = struct.calcsize("<dQI?I"), []
            for _ in range(n):
                heads.append((_HEAD.unpack_from(parts[0], at), struct.unpack_from("<Q", parts[0], at + _HEAD.size)[0]))
                at += _HEAD.size + 8
        except (struct.error, IndexError) as e:
            raise ValueError("a header can't be read") from e
        self = cls(BloomOptions(error_rate=error, capacity=capacity, nonscaling=True) if fixed else BloomOptions(error_rate=error, capacity=capacity, expansion=expansion))
        body = b"".join(parts[1:])
        if at != len(parts[0]) or not heads or len(body) != sum(h[0][2] // 8 for h in heads):
            raise ValueError("chunks don't fit their header")
        self.links, at = [], 0
        for number, (shape, held) in enumerate(heads):
            if tuple(shape) != self.o.link(number) or held > shape[0]:
                raise ValueError("a link doesn't fit its filter")
            self.links.append([tuple(shape), bytearray(body[at : at + shape[2] // 8]), held])
            at += shape[2] // 8
        return self


def links(items: DataFrame, o: BloomOptions) -> DataFrame:
    """(key, link, capacity, error, bits, hashes, size) of the chain that items(key, seq, item) make in order of seq, then
    item. An item that comes again is known, whatever the chain: only the first of each is folded."""

    def fold(parts):
        c = Chain(o)
        for a, b in parts:
            if c.add_all(a, b)[1] < len(a):
                break  # full: nothing after this item is looked at
        shape = [x[0] for x in c.links]
        yield {"link": np.arange(len(shape), dtype=np.int32), "capacity": [s[0] for s in shape], "error": [s[1] for s in shape], "bits": [s[2] for s in shape], "hashes": np.array([s[3] for s in shape], np.int32), "size": [x[2] for x in c.links]}

    firsts = items.where("item is not null").select("key", "seq", F.col("item").cast("string").alias("item")).groupBy("key", "item").agg(F.min("seq").alias("seq"))
    a, b = pair(F.col("item"))
    return folded(pieces(firsts, {"a": (a, "u4"), "b": (b, "u4")}), ["u4", "u4"], fold, "link int, capacity long, error double, bits long, hashes int, size long")
