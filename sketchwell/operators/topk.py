"""Heavy hitters: exact by partial aggregation, approximate built-ins, and the decaying-counter fold.

The exact form aggregates per item before anything is ranked; of each partition's ranking only k rows
per key travel further (a two-step rank), so no key gathers all its items in one task.
"""

from __future__ import annotations

import heapq
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchwell.functions.workers import reachable
from sketchwell.options import MAX_INCREMENT, TopKOptions


def counts(items: DataFrame) -> DataFrame:
    """(key, item, cnt) of items(key, item, inc); increments from 0 to 100,000, checked before anything is counted."""
    ok = items.where("item is not null and inc is not null")
    bad = F.raise_error(F.lit(f"increments lie between 0 and {MAX_INCREMENT}"))
    inc = F.when((F.col("inc") < 0) | (F.col("inc") > MAX_INCREMENT), bad).otherwise(F.col("inc")).cast("long")
    return ok.groupBy("key", "item").agg(F.sum(inc).alias("cnt"))


def top(counted: DataFrame, k: int, salts: int = 32) -> DataFrame:
    """(key, rank, item, cnt): the k most frequent of each key, ties by item; zero counts are left out."""
    order = (F.desc("cnt"), F.asc("item"))
    salted = counted.where("cnt > 0").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).where(F.col("r") <= k).drop("r", "salt")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= k).select("key", "rank", "item", "cnt")


def contains(probe: DataFrame, listed: DataFrame) -> DataFrame:
    """probe(key, item) with listed: whether the item is among its key's top."""
    return probe.join(listed.select("key", "item", F.lit(True).alias("listed")), ["key", "item"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def count_of(probe: DataFrame, counted: DataFrame) -> DataFrame:
    """probe(key, item) with cnt; unknown items have 0."""
    return probe.join(counted, ["key", "item"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def expelled(items: DataFrame, k: int) -> DataFrame:
    """(key, item, inc, before, after): items of the batch that were in the top before it and no longer are after it.

    items has a column batch; the list before holds all earlier batches.
    """
    last = items.groupBy("key").agg(F.max("batch").alias("last"))
    marked = items.join(last, "key")
    before = top(counts(marked.where("batch < last")), k).select("key", "item", F.col("cnt").alias("before"))
    now = counts(items)
    gone = before.join(top(now, k).select("key", "item"), ["key", "item"], "left_anti")
    return gone.join(now.withColumnRenamed("cnt", "after"), ["key", "item"])


def info(listed: DataFrame, o: TopKOptions) -> DataFrame:
    """(key, k, width, depth, decay, listed, held, bytes): bytes that a list with decaying counters of that shape takes:
    16 for each counter, 24 and its item for each entry."""
    entry = F.sum(F.lit(24) + F.octet_length("item"))
    shape = [F.lit(o.k).alias("k"), F.lit(o.width).cast("long").alias("width"), F.lit(o.depth).cast("long").alias("depth"), F.lit(float(o.decay)).alias("decay")]
    return listed.groupBy("key").agg(*shape, F.count("*").alias("listed"), F.sum("cnt").alias("held"), (F.lit(16 * o.width * o.depth) + entry).cast("long").alias("bytes"))


def approximate(items: DataFrame, k: int, tracked: int = 10_000) -> DataFrame:
    """(key, item, cnt) by the built-in mergeable summary: one pass, bounded state."""
    got = items.where("item is not null").groupBy("key").agg(F.expr(f"approx_top_k(item, {int(k)}, {int(tracked)})").alias("t"))
    return got.select("key", F.explode("t").alias("t")).select("key", F.col("t.item").alias("item"), F.col("t.count").alias("cnt"))


class DecayingTopK:
    """The order-dependent form: rows of fingerprint counters that lose to newcomers with probability decay ** count."""

    def __init__(self, o: TopKOptions, seed: int = 0):
        self.o, self.rng = o, random.Random(seed)
        self.cells: list[list] = [[(None, 0)] * o.width for _ in range(o.depth)]
        self.listed: dict[str, int] = {}

    def _add(self, item: str, inc: int) -> int:
        best = 0
        for row, cells in enumerate(self.cells):
            at = hash_of(row, item) % self.o.width
            held, n = cells[at]
            if held == item or not n:
                held, n = item, (n if held == item else 0) + inc
            else:
                left = inc
                while left and n:
                    left -= 1
                    n -= self.rng.random() < self.o.decay**n
                if not n:
                    held, n = item, left + 1
            cells[at] = (held, n)
            best = max(best, n if held == item else 0)
        return best

    def add(self, item: str, inc: int = 1) -> str | None:
        """Counts an item; what it expels from the list, if anything."""
        if not 0 <= inc <= MAX_INCREMENT:
            raise ValueError(f"increments lie between 0 and {MAX_INCREMENT}")
        n = self._add(item, inc)
        if item in self.listed:
            self.listed[item] = n
            return None
        if len(self.listed) < self.o.k:
            if n:
                self.listed[item] = n
            return None
        low = min(self.listed, key=lambda x: (self.listed[x], x))
        if n < self.listed[low] or not n:
            return None
        del self.listed[low]
        self.listed[item] = n
        return low

    def count(self, item: str) -> int:
        return max((n for row, c in enumerate(self.cells) for held, n in [c[hash_of(row, item) % self.o.width]] if held == item), default=0)

    def ranking(self) -> list[tuple[str, int]]:
        return heapq.nsmallest(self.o.k, ((i, n) for i, n in self.listed.items() if n), key=lambda x: (-x[1], x[0]))


def hash_of(row: int, item: str) -> int:
    import hashlib

    return int(hashlib.md5(f"{row}|{item}".encode()).hexdigest()[:8], 16)


def sequential(items: DataFrame, o: TopKOptions, seed: int = 0) -> DataFrame:
    """(key, item, cnt) of the order-dependent form, one key a task, rows by seq."""

    def fold(key, rows):
        sketch = DecayingTopK(o, seed)
        for _, item, inc in rows.sort_values("seq", kind="stable")[["seq", "item", "inc"]].itertuples(index=False):
            sketch.add(item, int(inc))
        got = sketch.ranking()
        return pd.DataFrame({"key": [key[0]] * len(got), "item": [g[0] for g in got], "cnt": [g[1] for g in got]})

    reachable(items.sparkSession)
    kind = items.schema["key"].dataType.simpleString()
    return items.where("item is not null").select("key", "seq", F.col("item").cast("string").alias("item"), "inc").groupBy("key").applyInPandas(fold, f"key {kind}, item string, cnt long")
