"""Helpers that the operators share: shared storage, bounded id filters, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchwell.functions.workers import reachable  # noqa: F401  the operators' one way to it

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one below the warehouse is set only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def trimmed(spark: SparkSession) -> None:
    """Memory that the driver's JVM has freed outside its heap goes back to the system."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    try:  # by the interface's method: the bean's own class is hidden
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(beans, values)
    except Py4JError:  # another JVM or C library: it has no such call
        pass


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    trimmed(spark)
    return spark.read.schema(df.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Delete the files of frames that came from stored, and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(at))  # names come as URIs
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64), element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * M1
    h = h ^ (h >> np.uint64(27))
    h = h * M2
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def slices(column, limit: int):
    """Row ranges (from, to) of at most limit bytes each, one row at least."""
    _, off = text_bytes(column)
    start, n = 0, len(off) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(raw: np.ndarray, off: np.ndarray, plain: np.ndarray | None = None, cut: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (runs of bytes that aren't ASCII white space) of texts from off to off, which of them each word is, and
    how many words each text has. off starts at 0; plain: bytes that stand for raw's; cut: where words are cut, too."""
    begin = np.empty(len(raw), bool)
    space = SPACE.take(raw)
    begin[:1], begin[1:] = True, space[:-1]
    if cut is not None:
        begin |= cut
    begin[off[:-1][off[:-1] < len(raw)]] = True
    keep = ~space
    begin &= keep
    count = np.diff(np.searchsorted(np.flatnonzero(begin), off))
    data = (raw if plain is None else plain)[keep]
    at = np.append(np.flatnonzero(begin[keep]), len(data))
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    _, at, data = words.dictionary.buffers()
    at = np.frombuffer(at, np.int64)[: len(words.dictionary) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:z] for a, z in zip(at, at[1:])], words.indices.to_numpy(), count


# ---- what a Python worker keeps --------------------------------------------------------

#: Tables that a worker keeps from task to task, and whose they are.
CACHES: list[dict] = []
_OWNER: list[str] = [""]


def fresh(owner: str) -> None:
    """Called where a task's function starts: what another step left in this worker is dropped, its memory given back."""
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    for cache in CACHES:
        cache.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it has no such call
        pass


# ---- a filter of bounded size for ids -------------------------------------------------

MOST_BITS = 1 << 26  # 8 MB: the filter never grows beyond this, it only passes more


def _bits_of(ids: np.ndarray, bits: int) -> np.ndarray:
    a = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    b = mix(a) | np.uint64(1)
    return np.concatenate([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(4)]).astype(np.int64)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the long ids, as packed bits. Bounded: at most MOST_BITS.

    False positives only let more rows through; each caller joins exactly afterwards.
    """
    count = ids.count()
    bits = 1 << 16
    while bits < min(12 * count, MOST_BITS):
        bits <<= 1

    def build(batches):
        fresh("id filter")
        mine = np.zeros(bits, bool)
        for b in batches:
            x = b.column(0).drop_null()
            if len(x):
                mine[_bits_of(x.to_numpy(zero_copy_only=False), bits)] = True
        packed = np.packbits(mine)
        step = 1 << 13
        for at in range(0, len(packed), step):
            part = packed[at : at + step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"at": [at], "part": [part.tobytes()]}, schema=pa.schema([("at", pa.int64()), ("part", pa.binary())]))

    few = ids.select(F.col(column).cast("long")).coalesce(max(1, min(16, parallelism(ids.sparkSession))))
    out = np.zeros(bits >> 3, np.uint8)
    for row in few.mapInArrow(build, "at long, part binary").toLocalIterator():
        part = np.frombuffer(bytes(row.part), np.uint8)
        out[row.at : row.at + len(part)] |= part
    return out


def in_filter(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bits = len(packed) * 8
    at = _bits_of(ids, bits)
    hit = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return hit.reshape(4, len(ids)).all(axis=0)


# ---- connected components ---------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without edges are absent.

    Alternating large-star and small-star steps. Every step is a shuffle with partial
    aggregation; hot nodes split by AQE's skew join. Nothing is gathered on the driver. Rounds grow with the
    logarithm of the longest path; beyond most_rounds it fails instead of answering in part.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        new = stored(small, "links")
        # each node has one parent and no parent has one: all trees are stars
        parents = new.groupBy("a").agg(F.count("*").alias("n"))
        left = parents.where("n > 1").limit(1).count() or new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        now = new
        if not left:
            break
    else:
        raise RuntimeError(f"components aren't finished after {most_rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
