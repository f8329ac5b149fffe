"""Sketches of streams: per window under a watermark, and ever growing by merged batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sketchwell.functions.hashing import seeded
from sketchwell.options import CmsOptions


def read_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with the schema of what is there."""
    at, _, end = path.rpartition(".")  # as a pattern, a path may name a file
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(f"{at}[.]{end}" if at and "/" not in end else path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: in spark.checkpoint.dir, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def windowed_cms(events: DataFrame, o: CmsOptions, ts: str = "ts", every: str = "1 day", slide: str | None = None, late: str = "1 day", family: str = "md5") -> DataFrame:
    """(start, key, row, col, cnt) of events(ts, key, item, inc): one stateful aggregation, later rows are dropped.

    A gap such as "session 1 hour" in `every` makes session windows.
    """
    w = F.session_window(ts, every.removeprefix("session ")) if every.startswith("session ") else F.window(ts, every, slide or every)
    rows = events.where("item is not null").withWatermark(ts, late).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(o.depth - 1))))
    cells = rows.withColumn("col", F.pmod(seeded(F.col("item"), F.col("row"), family), F.lit(o.width)).cast("long"))
    return cells.groupBy(w.alias("w"), "key", "row", "col").agg(F.sum("inc").cast("long").alias("cnt")).select(F.col("w.start").alias("start"), "key", "row", "col", "cnt")


def windowed_counts(events: DataFrame, ts: str = "ts", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, item, cnt): what top-k lists and exact counts per window are made of."""
    got = events.where("item is not null").withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), "key", "item").agg(F.sum("inc").cast("long").alias("cnt"))
    return got.select(F.col("w.start").alias("start"), "key", "item", "cnt")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write all there is of an append-only stream and read it back."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def merged_batches(stream: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """An ever-growing sketch: version n + 1 is version n merged with the sketch of batch n.

    A batch that is replayed writes the same version again from the same version before it, so sums are
    not counted twice. The version before the last stays until the next batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = build(batch)
        if number:
            new = merge(batch.sparkSession.read.parquet(f"{path}/v{number}"), new)
        new.write.mode("overwrite").parquet(f"{path}/v{number + 1}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
