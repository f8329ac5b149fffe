"""Hash columns. The md5 family has the same values in any SQL engine; xxhash64 is the fast one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("md5", "xxhash64")


def _part(digest: Column, number: int) -> Column:
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def pair(item: Column, family: str = "md5") -> tuple[Column, Column]:
    """Two independent hashes of 32 bits: enough for any number of probes."""
    if family == "md5":
        d = F.md5(item.cast("binary"))
        return _part(d, 0), _part(d, 1)
    if family == "xxhash64":
        h = F.xxhash64(item)
        return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    raise ValueError(f"family must be one of {FAMILIES}")


def seeded(item: Column, seed: Column, family: str = "md5") -> Column:
    """A hash of 32 bits for a seed."""
    if family == "md5":
        return _part(F.md5(F.concat(seed.cast("string"), F.lit("|"), item.cast("string")).cast("binary")), 0)
    if family == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(seed, item), 32)
    raise ValueError(f"family must be one of {FAMILIES}")


def probes(item: Column, bits: Column, hashes: Column, family: str = "md5") -> Column:
    """Array of the places of an item: (a + i * b) mod bits for i below hashes; b is odd, as bits may be a power of two."""
    a, b = pair(item, family)
    b = b.bitwiseOR(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(a + i * b, bits))
