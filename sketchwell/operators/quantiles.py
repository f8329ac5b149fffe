"""Exact ranks, quantiles and trimmed means of observations(key, v), in closed form.

Observations are first counted per (key, v) with partial aggregation; what is ordered is distinct
values. NaN and infinite observations are dropped or fail, nulls are ignored. Empty keys: NaN, and -2 for ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAN = float("nan")


def finite(obs: DataFrame, strict: bool = False) -> DataFrame:
    ok = ~F.isnan("v") & (F.abs("v") < float("inf"))
    known = obs.where("v is not null").withColumn("v", F.col("v").cast("double"))
    return known.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit("an observation isn't finite")))) if strict else known.where(ok)


def _slot(low: str, high: str, slots: int) -> Column:
    """The slot of v among equal widths from low to high; ascends with v."""
    width = F.col(high) / slots - F.col(low) / slots
    return F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(slots - 1), F.floor(F.col("v") / width - F.col(low) / width)))).otherwise(0).cast("int")


def stepped(obs: DataFrame, slots: int = 256) -> DataFrame:
    """(key, v, n, before, total): distinct values, how often each occurs, how many are below, how many there are.

    A key's values are cut into slots of equal width between its extremes, and those of a slot again between the
    slot's own extremes, so that outliers don't leave the rest in one slot: running sums cross slots by one row each,
    and only values of an inner slot are ordered together. A key of any size is spread.
    """
    c = finite(obs).groupBy("key", "v").agg(F.count("*").alias("n"))
    ends = c.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    c = c.join(ends, "key").select("key", "v", "n", _slot("low", "high", slots).alias("outer"))
    inner_ends = c.groupBy("key", "outer").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    c = c.join(inner_ends, ["key", "outer"]).select("key", "v", "n", (F.col("outer") * slots + _slot("low", "high", slots)).alias("slot"))
    sums = c.groupBy("key", "slot").agg(F.sum("n").alias("t"))
    by_key = Window.partitionBy("key")
    base = F.coalesce(F.sum("t").over(by_key.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key", "slot", base.alias("base"), F.sum("t").over(by_key).alias("total"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("key", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("inner", inner).join(sums, ["key", "slot"]).select("key", "v", "n", (F.col("base") + F.col("inner")).alias("before"), "total")


def extremes(obs: DataFrame) -> DataFrame:
    """(key, low, high, n)."""
    ok = ~F.isnan("v") & (F.abs("v") < float("inf"))
    v = F.when(ok, F.col("v"))
    return obs.groupBy("key").agg(F.coalesce(F.min(v), F.lit(NAN)).alias("low"), F.coalesce(F.max(v), F.lit(NAN)).alias("high"), F.count(v).alias("n"))


def by_rank(steps: DataFrame, ranks: list[int], reverse: bool = False) -> DataFrame:
    """(key, r, v): the r-th smallest (largest) from 0; beyond the last, plus (minus) infinity."""
    for r in ranks:
        if isinstance(r, bool) or not isinstance(r, int) or r < 0:
            raise ValueError(f"ranks are whole numbers from 0, not {r!r}")
    each = steps.select("*", F.explode(F.array(*(F.lit(r).cast("long") for r in ranks))).alias("r"))
    place = F.col("total") - 1 - F.col("r") if reverse else F.col("r")
    hit = F.when((place >= F.col("before")) & (place < F.col("before") + F.col("n")), F.col("v"))
    return each.groupBy("key", "r").agg(F.coalesce(F.max(hit), F.lit(float("-inf") if reverse else float("inf"))).alias("v"))


def quantile(steps: DataFrame, qs: list[float]) -> DataFrame:
    """(key, q, v): the least value with at least q of the observations up to it; 0 the least, 1 the largest."""
    for q in qs:
        if not 0 <= q <= 1:
            raise ValueError(f"quantiles lie in [0, 1], not {q!r}")
    each = steps.select("*", F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("q"))
    upto = F.col("before") + F.col("n")
    return each.groupBy("key", "q").agg(F.min(F.when(upto >= F.greatest(F.ceil(F.col("q") * F.col("total")), F.lit(1)), F.col("v"))).alias("v"))


def _below(obs: DataFrame, values: list[float]) -> DataFrame:
    """(key, x, below, same, total, low, high) for each probe value: one aggregation, no ordering."""
    aggs = [F.count("*").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")]
    parts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.count_if(F.col("v") < float(x)).alias("below"), F.count_if(F.col("v") == float(x)).alias("same")) for x in values))
    return finite(obs).groupBy("key").agg(*aggs, parts.alias("p")).select("key", "total", "low", "high", F.explode("p").alias("p")).select("key", "p.x", "p.below", "p.same", "total", "low", "high")


def rank(obs: DataFrame, values: list[float], reverse: bool = False) -> DataFrame:
    """(key, x, rank): below the least -1, above the largest the number of observations, else values below plus half
    the equal ones, halves rounded down (for reverse: counted from the other end, halves rounded up before)."""
    if any(x != x for x in values):
        raise ValueError("ranks of NaN aren't defined")
    b = _below(obs, values)
    low, high = (F.col("total"), F.lit(-1)) if reverse else (F.lit(-1), F.col("total"))
    half = (2 * F.col("below") + F.col("same"))  # twice the rank
    inner = F.col("total") - F.floor((half + 1) / 2) if reverse else F.ceil((half - 1) / 2)
    return b.select("key", "x", F.when(F.col("x") < F.col("low"), low).when(F.col("x") > F.col("high"), high).otherwise(inner).cast("long").alias("rank"))


def cdf(obs: DataFrame, values: list[float]) -> DataFrame:
    """(key, x, cdf): share of observations below, plus half the share of equal ones."""
    return _below(obs, values).select("key", "x", ((2 * F.col("below") + F.col("same")) / (2 * F.col("total"))).alias("cdf"))


def trimmed_mean(steps: DataFrame, lo: float, hi: float) -> DataFrame:
    """(key, mean) of the observations at places floor(N lo) to ceil(N hi) - 1 in order."""
    if not (0 <= lo < hi <= 1):
        raise ValueError("the cuts must hold 0 <= lo < hi <= 1")
    a, z = F.floor(F.col("total") * lo), F.ceil(F.col("total") * hi)
    take = F.greatest(F.lit(0), F.least(F.col("before") + F.col("n"), z) - F.greatest("before", a))
    s = steps.select("key", "v", take.alias("t"))
    return s.groupBy("key").agg((F.sum(F.col("v") * F.col("t")) / F.sum("t")).alias("mean"))
