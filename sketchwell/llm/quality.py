"""Quality by importance resampling: hashed n-gram generative models, Gumbel top-k.

Two bags of hashed words and word pairs are counted: of the target (documents labelled good) and of
the raw corpus (all documents). A document's log weight is the log ratio of its probabilities under
the two smoothed models: the sum over its n-grams. With `length` it is the mean times that number instead, so that
longer texts don't weigh more either way.
Adding Gumbel noise, seeded by doc_id, and keeping the k largest sums samples k documents without
replacement in proportion to their weights. k is a share of the rows.

Null and empty texts hold no n-gram: log weight 0. Repeated rows: the same key each; ties at the cut are broken by
doc_id, and rows equal in both are kept alike. A null doc_id has noise of its own. Without target
documents all weights are 0 (uniform sampling). Empty input: no rows. Whole texts of any length. Columns other than
id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchwell.llm.common import CACHES, fresh, mix, reachable, slices, stored, text_bytes


@dataclass(frozen=True)
class ResampleOptions:
    """length: n-grams that a text counts as; None: as many as it has. keep: share of the rows that is sampled. smooth: added to each bucket.
    Up to broadcast_ids target ids are broadcast; more are joined by a shuffle."""

    buckets: int = 1 << 16
    length: float | None = None
    keep: float = 0.5
    smooth: float = 1.0
    seed: int = 3
    broadcast_ids: int = 4_000_000


class Grams:
    """Texts -> bucket numbers of their words and word pairs."""

    def __init__(self, buckets: int, most: int = 1 << 18):
        self.buckets, self.most, self.known = np.uint64(buckets), most, {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        try:
            w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for x in set(words).difference(known):
                known[x] = xxhash.xxh3_64_intdigest(x)
            w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
        return np.concatenate([w % self.buckets, pairs % self.buckets]).astype(np.int64)


_GRAMS: dict[int, Grams] = {}
CACHES.append(_GRAMS)


def _grams(buckets: int) -> Grams:
    return _GRAMS.setdefault(buckets, Grams(buckets))


def _texts(b: pa.RecordBatch, column: int, limit: int = 2 << 20):
    for lo, hi in slices(b.column(column), limit):
        raw, off = text_bytes(b.column(column).slice(lo, hi - lo))
        yield lo, [raw[off[i] : off[i + 1]].tobytes() for i in range(hi - lo)]


def counts(docs: DataFrame, target: DataFrame, o: ResampleOptions) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts (target, raw) over all documents; target: (doc_id) of the good ones.

    Each task sends blocks of 4096 counters, summed in Spark; the driver gets 2 x buckets numbers.
    """
    ids = stored(target.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct(), "target")
    block = 4096
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("hits", pa.list_(pa.int64()))])
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    small = ids.count() <= o.broadcast_ids
    if small:  # 8 bytes an id
        rows = named.select("*", F.lit(False).alias("good"))
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))
    else:
        rows = named.join(ids.withColumn("good", F.lit(True)), "id", "left").select("id", "text", F.coalesce("good", F.lit(False)).alias("good"))

    def counted(batches):
        fresh("quality")
        to, total = _grams(o.buckets), np.zeros((2, -(-o.buckets // block) * block), np.int64)
        for b in batches:
            good = b.column(2).to_numpy(zero_copy_only=False)
            if small and len(sent.value):
                at = np.searchsorted(sent.value, i := b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                at[at == len(sent.value)] = 0
                good = (sent.value[at] == i) & ~b.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, texts in _texts(b, 1):
                grams = [to.of(t) for t in texts]
                total[0] += np.bincount(np.concatenate(grams), minlength=total.shape[1])
                chosen = [g for k, g in enumerate(grams, lo) if good[k]]
                if chosen:
                    total[1] += np.bincount(np.concatenate(chosen), minlength=total.shape[1])
        for kind in (0, 1):
            parts = total[kind].reshape(-1, block)
            on = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), kind, np.int32)), pa.array(on.astype(np.int32)), pa.array([parts[i] for i in on], pa.list_(pa.int64()))], schema=schema)

    every = rows.mapInArrow(counted, "kind int, block int, hits array<long>")
    summed = every.select("kind", "block", F.posexplode("hits").alias("i", "n")).groupBy("kind", "block", "i").agg(F.sum("n").alias("n")).where("n > 0")
    out = np.zeros((2, -(-o.buckets // block) * block))
    found = summed.select("kind", (F.col("block") * block + F.col("i")).alias("at"), "n").toArrow()
    out[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy()
    return out[1][: o.buckets], out[0][: o.buckets]


def log_ratio(good: np.ndarray, raw: np.ndarray, o: ResampleOptions) -> np.ndarray:
    """Per bucket log p_target - log p_raw; the target is smoothed towards the raw model."""
    if not good.sum() or not raw.sum():
        return np.zeros(len(raw))
    q = (raw + o.smooth) / (raw.sum() + o.smooth * len(raw))
    p = (good + o.smooth * len(raw) * q) / (good.sum() + o.smooth * len(raw))
    return np.log(p) - np.log(q)


def weighed(docs: DataFrame, ratio: np.ndarray, o: ResampleOptions) -> DataFrame:
    """(doc_id, log_weight, key): key is the log weight with Gumbel noise."""
    reachable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("key", pa.float64())])

    def run(batches):
        fresh("quality")
        to, r = _grams(o.buckets), sent.value
        for b in batches:
            ids = b.column(0)
            known = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            noise = mix(mix(known + np.uint64(o.seed * 0x9E3779B97F4A7C15 % (1 << 64))) + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))
            u = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            w = np.zeros(len(b))
            for lo, texts in _texts(b, 1):
                for i, t in enumerate(texts, lo):
                    g = to.of(t)
                    w[i] = (r[g].sum() if o.length is None else o.length * r[g].mean()) if len(g) else 0.0
            yield pa.RecordBatch.from_arrays([ids, pa.array(w), pa.array(w - np.log(-np.log(u)))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, log_weight double, key double")


def top_k_cut(rows: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest key: histograms of ever narrower ranges until one bin holds a single key."""
    lo, hi, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n or n == 0:
        return float("-inf")
    if k <= 0:
        return float("inf")
    need = k
    for _ in range(12):
        width = (hi - lo) / bins
        if width <= 0 or lo + width <= lo:
            return lo
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        found = {r.b: (r.n, r.a, r.z) for r in rows.where(F.col("key").between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()}
        for b in sorted(found, reverse=True):
            if need <= found[b][0]:
                break
            need -= found[b][0]
        n, lo, hi = found[b]
        if lo == hi or need == n:
            return lo
    return lo


def resample(docs: DataFrame, target: DataFrame, o: ResampleOptions | None = None) -> DataFrame:
    """(doc_id, log_weight, key, kept): every row of docs(doc_id, text) with its weight and whether it is sampled."""
    o = o or ResampleOptions()
    reachable(docs.sparkSession)
    rows = stored(weighed(docs, log_ratio(*counts(docs, target, o), o), o), "weights")
    k = int(o.keep * rows.count())
    cut = top_k_cut(rows, k)
    over, at = rows.where(F.col("key") > cut).count(), rows.where(F.col("key") == cut)
    last = at.agg(F.count("*")).first()[0] and at.orderBy(F.col("doc_id").asc_nulls_first()).limit(max(1, k - over)).agg(F.max("doc_id")).first()[0]
    tie = (F.col("key") == cut) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(last))) if last is not None else F.col("key") == cut
    return rows.withColumn("kept", F.when((F.col("key") > cut) | tie, 1).otherwise(0))
