"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on running passages of ordinary texts, one on passages of toxic
texts. A toxic text is mostly ordinary prose, so its passages are the runs of its telling words, as they
follow one another in it (telling: by log-likelihood ratio of document frequencies). A window is toxic as far as the
toxic dictionary makes it shorter. Thresholds are calibrated: the gains that given shares of the ordinary training
windows reach; counts of windows beyond them become a probability.

Nulls and empty texts: one window of one blank, so a score near the base rate. Texts of any
length: all windows count. Repeated rows: the same score each. Empty input: no rows. Without
both labels among the training rows every score is 0. Other columns pass through unread.
"""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchwell.llm.common import fresh, reachable, slices, trimmed


@dataclass(frozen=True)
class ToxicityOptions:
    """max_train_docs and max_train_bytes bound the labelled sample (half of either for toxic texts at most, by hash of
    doc_id; texts beyond 1/64 of the bytes aren't trained on); everything else covers all rows. Telling words are the
    key_words of the highest log-likelihood ratio, beyond keyness. shares: of ordinary windows beyond each threshold.
    threshold is the rejection limit."""

    max_train_docs: int = 6000
    max_train_bytes: int = 48 << 20
    toxic_dict: int = 2048
    ordinary_dict: int = 8192
    level: int = 6
    window: int = 64
    step: int = 52
    keyness: float = 12.0
    key_words: int = 80
    shares: tuple = (0.05, 0.02, 0.01, 0.004, 0.001)
    most_passages: int = 100_000
    threshold: float = 0.3
    seed: int = 1


#: Letters, digits and bytes beyond ASCII stay, the rest becomes blank; A-Z become a-z.
_WORD_BYTES = bytes((c | 32 if 65 <= c < 91 else c) if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> bytes:
    """The words of a text, one blank between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())


class CompressionModel:
    """Dictionaries, thresholds and weights; small, picklable, of fixed size."""

    def __init__(self, options: ToxicityOptions):
        self.options, self.ordinary, self.toxic, self.steps, self.weights = options, b"", b"", (), None

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], options: ToxicityOptions, odds: float | None = None) -> CompressionModel:
        """odds: toxic to ordinary among all labelled rows; the sample may hold relatively more toxic ones."""
        self = cls(options)
        docs, y = [words_of(t) for t in texts], np.array(labels, float)
        if not 0 < y.sum() < len(y):
            return self
        rng = random.Random(options.seed)
        bad, good = [d for d, v in zip(docs, y) if v], [d for d, v in zip(docs, y) if not v]
        in_bad, in_good = Counter(w for d in bad for w in set(d.split())), Counter(w for d in good for w in set(d.split()))
        scored = sorted(((_keyness(in_bad[w], in_good[w], len(bad), len(good)), w) for w in in_bad), reverse=True)
        telling = {w for k, w in scored[: options.key_words] if k > options.keyness}
        runs = [[w for w in d.split() if w in telling] for d in bad]
        toxic = [b" " + b"  ".join(r) + b" " for r in runs if r]
        rng.shuffle(toxic)
        self.toxic = _trained(options.toxic_dict, toxic, 32)
        plain = [b" " + b" ".join(w[i : i + 16]) + b" " for w in map(bytes.split, good) for i in range(0, len(w), 16)]
        rng.shuffle(plain)
        self.ordinary = _trained(options.ordinary_dict, plain[: options.most_passages], 64)
        self.steps = self._calibrated(good)
        measure = self.measure()
        mean, spread, w = _logistic(np.array([measure(d) for d in docs]), y)
        if odds:
            w[-1] += math.log(odds) - math.log(y.sum() / (len(y) - y.sum()))
        self.weights = mean, spread, w
        return self

    def _gains(self):
        """Words of a text -> bytes that the toxic dictionary saves in each window."""
        o = self.options
        plain, both = (_compressor(x, o) for x in (self.ordinary, self.toxic + self.ordinary))

        def gains(words: bytes) -> np.ndarray:
            data = b" " + words + b" "
            windows = [data[i : i + o.window] for i in range(0, max(1, len(data) - (o.window - o.step)), o.step)]
            return np.array([len(plain(w)) - len(both(w)) for w in windows])

        return gains

    def _calibrated(self, good: list[bytes]) -> tuple[int, ...]:
        """The least gains that no more than each share of the ordinary windows reach, and the next ones up where shares agree."""
        gains, held = self._gains(), Counter()
        for d in good:
            held.update(gains(d).tolist())
        total, top = sum(held.values()), max(held, default=0) + 2
        tail = {t: sum(n for g, n in held.items() if g >= t) / total for t in range(1, top + 1)}
        found = sorted({next((t for t in tail if tail[t] <= share), top) for share in self.options.shares})
        while len(found) < len(self.options.shares):
            found = sorted({*found, next(t for t in range(found[0], top + len(self.options.shares) + 1) if t not in found)})
        return tuple(found)

    def measure(self):
        """Words of a text -> features: how many windows shrink by each threshold, their share, the most, their number."""
        gains = self._gains()

        def features(words: bytes) -> list[float]:
            gain = gains(words)
            over = [int((gain >= t).sum()) for t in self.steps]
            return [*(math.log1p(k) for k in over), math.log(len(gain)), float(gain.max()), over[0] / len(gain), over[1] / len(gain)]

        return features

    def scores(self, texts) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        measure = self.measure()
        return _probability(np.array([measure(words_of(t)) for t in texts]), self.weights).tolist() if len(texts) else []


def _keyness(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio of document frequencies a of na and b of nb; negative where the second is higher."""
    n, k = na + nb, a + b
    part = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
    g = 2 * (part(a, k * na / n) + part(b, k * nb / n) + part(na - a, (n - k) * na / n) + part(nb - b, (n - k) * nb / n))
    return g if a * nb > b * na else -g


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
        return b"".join(samples)[-size:]


def _compressor(content: bytes, o: ToxicityOptions):
    params = zstandard.ZstdCompressionParameters.from_level(o.level, source_size=o.window, dict_size=max(8, len(content)), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params).compress
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, pull = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge
    pull[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (p - y) + pull @ w)
    return mean, spread, w


def _probability(x: np.ndarray, fitted) -> np.ndarray:
    mean, spread, w = fitted
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / spread, np.ones(len(x))] @ w, -30, 30)))


def held_out():
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None) -> CompressionModel:
    """Learn from a bounded sample of labelled rows that aren't held out. One task holds the sample and trains; only the model,
    of fixed size, comes to the driver."""
    o = options or ToxicityOptions()
    reachable(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out())
    number = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    half = o.max_train_docs // 2
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(half).unionAll(known.where("toxic = 0").orderBy(*order).limit(o.max_train_docs - half))
    some = F.broadcast(some.dropDuplicates(["doc_id"]))  # at most max_train_docs rows
    size = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    size = size.join(some, "doc_id").where(F.col("size") <= o.max_train_bytes // 64)
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(*order, "size"))  # rows of the sample only, without texts
    some = F.broadcast(size.withColumn("upto", upto).where(F.col("upto") <= o.max_train_bytes // 2).select("doc_id", "toxic").dropDuplicates(["doc_id"]))
    rows = docs.select("doc_id", "text").join(some, "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= o.max_train_bytes // 64)
    odds = number.get(1, 0) / max(1, number.get(0, 0))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh("training")
        got = sorted(((r["doc_id"], r["text"] or "", r["toxic"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        model = CompressionModel.fit([r[1] for r in got], [r[2] for r in got], o, odds)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]}, schema=pa.schema([("model", pa.binary())]))

    sample = rows.select("doc_id", F.col("text").cast("string").alias("text"), "toxic").limit(o.max_train_docs).coalesce(1)
    found = sample.mapInArrow(train, "model binary").collect()  # one row; none where Spark knows that nothing is left to train on
    trimmed(docs.sparkSession)
    return pickle.loads(bytes(found[0].model)) if found else CompressionModel(o)


def score(docs: DataFrame, model: CompressionModel, out: str = "toxicity") -> DataFrame:
    """docs with a column of scores from 0 to 1, in place of one of that name; no shuffle, whole texts.

    Only texts go to the workers and only scores come back; the other columns stay where they are."""
    reachable(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fresh("toxicity")
        for column in texts:
            found = [model.scores(column.slice(lo, hi - lo).to_pylist()) for lo, hi in slices(column, 2 << 20)]
            yield pa.array([x for part in found for x in part], pa.float64())

    return docs.withColumn(out, scored(F.col("text").cast("string")))
