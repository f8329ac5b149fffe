import time

from pyspark.sql import functions as F

from sketchwell.operators import bloom, cms
from sketchwell.options import BloomOptions, CmsOptions
from sketchwell.streaming import sketches


def files(spark, data, at):
    ev = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("item"), F.lit(1).alias("inc"))
    # the file source takes files by time of modification: later ranges are written later
    for k in range(3):
        ev.where(F.expr(f"dayofmonth(ts) between {10 * k + 1} and {10 * k + 10 + k // 2}")).coalesce(1).write.mode("append").parquet(str(at))
        time.sleep(1.1)
    return ev


def test_windowed_cells_equal_the_batch(spark, data, tmp_path):
    ev = files(spark, data, tmp_path / "in")
    o = CmsOptions(50, 3)
    s = sketches.windowed_cms(sketches.read_stream(spark, str(tmp_path / "in"), 10), o, late="60 days")
    got = sketches.run_to_end(s.where("start is not null"), str(tmp_path / "out"), str(tmp_path / "ck"))
    # with this watermark no window is closed by the stream itself: what is out is a prefix of the batch
    batch = sketches.windowed_cms(ev, o)
    assert got.join(batch.withColumnRenamed("cnt", "b"), ["start", "key", "row", "col"]).where("cnt <> b").count() == 0
    s2 = sketches.windowed_counts(sketches.read_stream(spark, str(tmp_path / "in"), 1), late="1 hour")
    got2 = sketches.run_to_end(s2, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    batch2 = sketches.windowed_counts(ev)
    # windows that end an hour before the last event are closed, and only those
    closed = batch2.where(F.col("start") + F.expr("interval 1 day") <= ev.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0])
    assert closed.count() and got2.exceptAll(closed).count() == 0 == closed.exceptAll(got2).count()


def test_session_and_sliding_windows(spark, data):
    ev = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("item"), F.lit(1).alias("inc"))
    o = CmsOptions(20, 2)
    total = ev.count() * o.depth
    assert sketches.windowed_cms(ev, o, every="session 1 hour").agg(F.sum("cnt")).first()[0] == total
    assert sketches.windowed_cms(ev, o, every="2 days", slide="1 day").agg(F.sum("cnt")).first()[0] == 2 * total


def test_growing_sketches(spark, data, tmp_path):
    ev = files(spark, data, tmp_path / "in")
    o = CmsOptions(50, 3)
    q = sketches.merged_batches(sketches.read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "cms"), str(tmp_path / "ck"), lambda b: cms.build(b, o), lambda a, b: cms.merge([(a, 1), (b, 1)], saturate=True))
    q.awaitTermination()
    last = spark.read.parquet(str(tmp_path / "cms/v3"))
    assert last.exceptAll(cms.build(ev, o)).count() == 0
    h = bloom.reserve(ev.select("key").distinct(), BloomOptions(capacity=1000))
    q = sketches.merged_batches(sketches.read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "b"), str(tmp_path / "ck2"), lambda b: bloom.build(b, h), bloom.merge)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b/v3")).exceptAll(bloom.build(ev, h)).count() == 0
