import pytest
from pyspark.sql import functions as F

from sketchwell.functions.spread import spread
from sketchwell.operators import bloom
from sketchwell.options import BloomOptions


@pytest.fixture
def shuffled(spark):
    """Joins that shuffle, as AQE chooses where the few keys leave most partitions empty."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks(df):
    return df.select(F.spark_partition_id().alias("at")).distinct().count()


@pytest.mark.parametrize("keys", [1, 3, 200])
def test_spread_gives_what_a_join_does(shuffled, keys):
    rows = shuffled.range(1000).select((F.col("id") % (keys + 1)).alias("key"), F.col("id").cast("string").alias("item"))
    small = shuffled.range(keys).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    for how in ("inner", "left"):
        got, want = spread(rows, small, ["key"], how), rows.join(small, "key", how)
        assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_bloom_deals_the_rows_of_a_key_over_tasks(shuffled):
    items = shuffled.range(2000).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.col("id").cast("string").alias("item"))
    h = bloom.reserve(items.select("key").distinct(), BloomOptions(capacity=500, nonscaling=True))
    assert tasks(bloom._places(items.select("key", "item"), h, "md5")) > 1
    flags = items.withColumn("added", F.col("seq") % 2 == 0)
    got = bloom.nonscaling_flags(flags, h)
    assert tasks(got) > 1 and got.where("added is null").count() == 1000
