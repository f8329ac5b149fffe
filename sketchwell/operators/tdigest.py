"""t-digests (key, compression, low, high, n, centroids): mergeable summaries of observations.

Each task folds its rows into one digest per key (Arrow batches, numpy); centroids are shuffled, not rows,
and merged per key as a tree: first those of a key and a salt, then those of a key. Merging sorts centroids and
joins neighbours between two steps of the published arcsine scale: fine at both tails.
Small inputs stay exact: every observation is a centroid of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchwell.functions.workers import reachable
from sketchwell.operators.quantiles import finite
from sketchwell.options import TDigestOptions

#: Partial digests of a key are first merged by so many salts.
SALTS = 256
CENTROIDS = "array<struct<mean:double,weight:double>>"


def compress(mean: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids whose middles lie between two steps of the scale are joined."""
    order = np.lexsort((weight, mean))
    mean, weight = mean[order], weight[order]
    if len(mean) <= compression:
        return mean, weight
    q = (np.cumsum(weight) - weight / 2) / weight.sum()
    k = np.floor(compression * (np.arcsin(2 * q - 1) / np.pi + 0.5)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    total = np.add.reduceat(weight, start)
    return np.add.reduceat(mean * weight, start) / total, total


def _fold_sorted(v: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Many observations at once: cut the sorted values where the integral of the size bound steps."""
    v = np.sort(v)
    n = len(v)
    if n <= 4 * compression:
        return v, np.ones(n)
    q = (np.arange(n) + 0.5) / n
    k = np.floor(compression / 2 * (np.arcsin(2 * q - 1) / np.pi + 0.5) * 2).astype(np.int64)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    weight = np.diff(np.r_[start, n]).astype(float)
    return np.add.reduceat(v, start) / weight, weight


class Digest:
    """Answers from centroids: linear between the middles of neighbours, exact at both ends."""

    def __init__(self, mean, weight, low: float, high: float, compression: int = 100):
        self.mean, self.weight = np.asarray(mean, float), np.asarray(weight, float)
        self.low, self.high, self.compression, self.n = low, high, compression, float(np.sum(weight))

    @classmethod
    def of(cls, values, compression: int = 100) -> Digest:
        v = np.asarray(values, float)
        if not np.isfinite(v).all():
            raise ValueError("observations are finite")
        m, w = compress(*_fold_sorted(v, compression), compression) if len(v) else (v, v)
        return cls(m, w, v.min() if len(v) else float("nan"), v.max() if len(v) else float("nan"), compression)

    def merge(self, *others: Digest, compression: int | None = None) -> Digest:
        """Explicit compression, else this one's."""
        every = [d for d in (self, *others) if d.n]
        c = compression or self.compression
        if not every:
            return Digest([], [], float("nan"), float("nan"), c)
        m, w = compress(np.concatenate([d.mean for d in every]), np.concatenate([d.weight for d in every]), c)
        return Digest(m, w, min(d.low for d in every), max(d.high for d in every), c)

    def _middles(self) -> np.ndarray:
        return np.cumsum(self.weight) - self.weight / 2

    def quantile(self, q: float) -> float:
        if not 0 <= q <= 1:
            raise ValueError("quantiles lie in [0, 1]")
        if not self.n:
            return float("nan")
        if q in (0, 1):
            return self.high if q else self.low
        if (self.weight == 1).all():
            return float(self.mean[min(int(q * self.n), len(self.mean) - 1)])
        return float(np.interp(q * self.n, np.r_[0, self._middles(), self.n], np.r_[self.low, self.mean, self.high]))

    def cdf(self, x: float) -> float:
        if not self.n:
            return float("nan")
        if x < self.low or x > self.high:
            return 0.0 if x < self.low else 1.0
        if (self.weight == 1).all():
            return float(((self.mean < x).sum() + (self.mean == x).sum() / 2) / self.n)
        return float(np.interp(x, np.r_[self.low, self.mean, self.high], np.r_[0, self._middles(), self.n]) / self.n)

    def rank(self, x: float, reverse: bool = False) -> int:
        """Observations below x and half the equal ones, halves rounded down; -1 below the least, all above the
        largest, -2 without observations. reverse: counted from the other end."""
        if x != x:
            raise ValueError("ranks of NaN aren't defined")
        if not self.n:
            return -2
        n = int(self.n)
        if x < self.low or x > self.high:
            return n if (x < self.low) == reverse else -1
        below = self.cdf(x) * self.n
        return n - int(np.floor(below + 0.5 + 1e-9)) if reverse else int(np.ceil(below - 0.5 - 1e-9))

    def by_rank(self, r: int, reverse: bool = False) -> float:
        """The value at place r from 0 in ascending (descending) order; infinite beyond the last, NaN without observations."""
        if isinstance(r, bool) or not isinstance(r, int) or r < 0:
            raise ValueError(f"ranks are whole numbers from 0, not {r!r}")
        if not self.n:
            return float("nan")
        if r >= self.n:
            return float("-inf") if reverse else float("inf")
        place = self.n - 1 - r if reverse else r
        if place in (0, self.n - 1):
            return self.high if place else self.low
        return self.quantile((place + 0.5) / self.n)

    def trimmed_mean(self, lo: float, hi: float) -> float:
        """Mean of the weight between two quantiles; a centroid on a cut counts in part."""
        if not 0 <= lo < hi <= 1:
            raise ValueError("the cuts must hold 0 <= lo < hi <= 1")
        if not self.n:
            return float("nan")
        end = np.cumsum(self.weight)
        a, z = np.floor(self.n * lo), np.ceil(self.n * hi)
        take = np.clip(np.minimum(end, z) - np.maximum(end - self.weight, a), 0, None)
        return float((self.mean * take).sum() / take.sum())


def build(obs: DataFrame, options: TDigestOptions | None = None, flush: int = 1 << 20) -> DataFrame:
    """(key, compression, low, high, n, centroids) of obs(key, v)."""
    c = (options or TDigestOptions()).compression
    reachable(obs.sparkSession)
    kind = obs.schema["key"].dataType
    schema = f"key {kind.simpleString()}, salt int, low double, high double, means array<double>, weights array<double>"

    def partial(batches):
        held: dict = {}
        rows = 0
        salt = TaskContext.get().partitionId() % SALTS

        def out():
            data = {"key": [], "salt": [], "low": [], "high": [], "means": [], "weights": []}
            for k, parts in held.items():
                v = np.concatenate(parts)
                m, w = _fold_sorted(v, c)
                for name, x in zip(data, (k, salt, float(v.min()), float(v.max()), m.tolist(), w.tolist())):
                    data[name].append(x)
            return pa.RecordBatch.from_pandas(pd.DataFrame(data).astype({"salt": "int32"}), preserve_index=False)

        for b in batches:
            v = b.column(1).to_numpy(zero_copy_only=False)
            codes = b.column(0).dictionary_encode()
            index = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            names = [*codes.dictionary.to_pylist(), None]
            order = np.argsort(index, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(index[order]) != 0]) if len(order) else []
            for at, to in zip(cut, [*cut[1:], len(order)]):
                held.setdefault(names[index[order[at]]], []).append(v[order[at:to]])
            rows += len(v)
            if rows >= flush:
                yield out()
                held, rows = {}, 0
        if held:
            yield out()

    parts = finite(obs).select("key", "v").mapInArrow(partial, schema)
    final = f"key {kind.simpleString()}, compression int, low double, high double, n long, centroids {CENTROIDS}"
    def near(key, rows):
        m, w = compress(np.concatenate(rows["means"].to_list()), np.concatenate(rows["weights"].to_list()), c)
        return pd.DataFrame({"key": [key[0]], "salt": [0], "low": [rows["low"].min()], "high": [rows["high"].max()], "means": [m.tolist()], "weights": [w.tolist()]})

    def whole(key, rows):
        m, w = compress(np.concatenate(rows["means"].to_list()), np.concatenate(rows["weights"].to_list()), c)
        return pd.DataFrame({"key": [key[0]], "compression": [c], "low": [rows["low"].min()], "high": [rows["high"].max()], "n": [int(round(w.sum()))], "centroids": [[{"mean": float(a), "weight": float(b)} for a, b in zip(m, w)]]})

    return parts.groupBy("key", "salt").applyInPandas(near, schema).groupBy("key").applyInPandas(whole, final)


def merge(digests: list[DataFrame], compression: int | None = None) -> DataFrame:
    """Digests of the same keys joined; compression is the given one or the largest of the sources."""
    if not digests:
        raise ValueError("nothing to merge")
    every = digests[0]
    for d in digests[1:]:
        every = every.unionByName(d)
    reachable(every.sparkSession)
    kind = every.schema["key"].dataType.simpleString()

    def merged(key, rows):
        c = compression or int(rows["compression"].max())
        m, w = compress(np.array([x["mean"] for r in rows["centroids"] for x in r]), np.array([x["weight"] for r in rows["centroids"] for x in r]), c)
        return pd.DataFrame({"key": [key[0]], "compression": [c], "low": [rows["low"].min()], "high": [rows["high"].max()], "n": [int(rows["n"].sum())], "centroids": [[{"mean": float(a), "weight": float(b)} for a, b in zip(m, w)]]})

    return every.groupBy("key").applyInPandas(merged, f"key {kind}, compression int, low double, high double, n long, centroids {CENTROIDS}")


def evaluate(digests: DataFrame, qs: list[float] = (), xs: list[float] = (), ranks: list[int] = (), trims: list[tuple[float, float]] = ()) -> DataFrame:
    """(key, n, low, high, quantiles, cdfs, ranks, revranks, byranks, byrevranks, trimmed_means) in the order asked
    for: quantiles of qs, shares and ranks of the values xs, values at ranks, means between the cuts of trims; null
    (ranks: -2) where a digest is empty."""
    blank = Digest([1.0], [1.0], 1.0, 1.0)  # bad arguments fail here, not in a task
    for x in xs:
        blank.rank(x)
    _ = [blank.quantile(q) for q in qs], [blank.by_rank(r) for r in ranks], [blank.trimmed_mean(a, z) for a, z in trims]
    reachable(digests.sparkSession)
    kind = digests.schema["key"].dataType.simpleString()

    def run(batches):
        for rows in batches:
            ds = [Digest([x["mean"] for x in r.centroids], [x["weight"] for x in r.centroids], r.low, r.high, r.compression) for r in rows.itertuples()]
            found = {"quantiles": [[d.quantile(q) for q in qs] for d in ds], "cdfs": [[d.cdf(x) for x in xs] for d in ds]}
            found |= {"ranks": [[d.rank(x) for x in xs] for d in ds], "revranks": [[d.rank(x, True) for x in xs] for d in ds]}
            found |= {"byranks": [[d.by_rank(r) for r in ranks] for d in ds], "byrevranks": [[d.by_rank(r, True) for r in ranks] for d in ds]}
            yield pd.DataFrame({c: rows[c] for c in ("key", "n", "low", "high")} | found | {"trimmed_means": [[d.trimmed_mean(a, z) for a, z in trims] for d in ds]})

    form = f"key {kind}, n long, low double, high double, quantiles array<double>, cdfs array<double>, ranks array<long>, revranks array<long>, byranks array<double>, byrevranks array<double>, trimmed_means array<double>"
    return digests.select("key", "compression", "n", "low", "high", "centroids").mapInPandas(run, form)


def reset(digests: DataFrame) -> DataFrame:
    """The same keys and compressions without observations: extremes NaN, no centroids."""
    none = F.lit(float("nan"))
    return digests.select("key", "compression", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("n"), F.expr(f"cast(array() as {CENTROIDS})").alias("centroids"))


def info(digests: DataFrame) -> DataFrame:
    """(key, compression, capacity, nodes, unmerged_nodes, merged_weight, unmerged_weight, observations, bytes). Nodes of
    one observation are unmerged; digests are compressed whenever they are merged, so there is no buffer to count."""
    cap = 6 * F.col("compression") + 10
    alone = F.filter("centroids", lambda x: x.weight == 1)
    single = F.size(alone).cast("long")
    return digests.select("key", "compression", cap.cast("int").alias("capacity"), F.size("centroids").alias("nodes"), single.alias("unmerged_nodes"), (F.col("n") - single).alias("merged_weight"), single.alias("unmerged_weight"), F.col("n").alias("observations"), (80 + 16 * cap).cast("long").alias("bytes"))
