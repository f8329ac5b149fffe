"""Count-min sketches as tables of cells (key, row, col, cnt) and a header (key, width, depth, count).

Items are summed before their rows are expanded, so a frequent item moves once per partition. Cells
saturate after summing, which for increments of zero and more equals saturating on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchwell.functions.hashing import seeded
from sketchwell.options import CELL_MAX, CmsOptions

WIDE = "decimal(38,0)"


def shapes(dims: DataFrame) -> DataFrame:
    """dims(width, depth), checked: both from 1 up to what 32 bits hold."""
    for c in ("width", "depth"):
        ok = F.col(c).between(1, CELL_MAX)
        dims = dims.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is out of range")).cast("long")))
    return dims


def shapes_by_probability(rows: DataFrame) -> DataFrame:
    """rows(error, probability) with width and depth: cells for that error rate, rows for that chance to exceed it."""
    ok = (F.col("error") > 0) & (F.col("error") < 1) & (F.col("probability") > 0) & (F.col("probability") < 1)
    bad = F.raise_error(F.lit("error and probability lie between 0 and 1")).cast("long")
    depth = F.ceil(F.log10("probability") / F.log10(F.lit(0.5))).cast("long")
    return rows.withColumn("width", F.when(ok, F.ceil(2 / F.col("error")).cast("long")).otherwise(bad)).withColumn("depth", F.when(ok, depth).otherwise(bad))


def _cells(items: DataFrame, o: CmsOptions, family: str) -> DataFrame:
    rows = items.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(o.depth - 1))))
    return rows.withColumn("col", F.pmod(seeded(F.col("item"), F.col("row"), family), F.lit(o.width)).cast("long"))


def checked(items: DataFrame) -> DataFrame:
    """items(key, item, inc): fails on increments below zero; null items and increments are ignored."""
    ok = items.where("item is not null and inc is not null")
    return ok.withColumn("inc", F.when(F.col("inc") < 0, F.raise_error(F.lit("an increment is below zero"))).otherwise(F.col("inc")).cast("long"))


def build(items: DataFrame, o: CmsOptions, family: str = "md5") -> DataFrame:
    """(key, row, col, cnt) of items(key, item, inc)."""
    summed = checked(items).groupBy("key", "item").agg(F.sum(F.col("inc").cast(WIDE)).alias("inc"))
    cells = _cells(summed, o, family).groupBy("key", "row", "col").agg(F.sum("inc").alias("cnt"))
    return cells.withColumn("cnt", F.least(F.col("cnt"), F.lit(CELL_MAX).cast(WIDE)).cast("long"))


def memory(headers: DataFrame) -> DataFrame:
    """(key, bytes) that a packed sketch takes: 4 for each cell and a header of 32."""
    return headers.select("key", (4 * F.col("width") * F.col("depth") + 32).cast("long").alias("bytes"))


def header(items: DataFrame, o: CmsOptions) -> DataFrame:
    """(key, width, depth, count): count doesn't saturate."""
    return checked(items).groupBy("key").agg(F.lit(o.width).cast("long").alias("width"), F.lit(o.depth).cast("long").alias("depth"), F.sum("inc").alias("count"))


def query(probe: DataFrame, cells: DataFrame, o: CmsOptions, family: str = "md5") -> DataFrame:
    """(key, item, estimate, saturated) of the distinct (key, item) of probe: the least of the item's cells."""
    want = _cells(probe.select("key", "item").where("item is not null").distinct(), o, family)
    got = want.join(cells, ["key", "row", "col"], "left").groupBy("key", "item").agg(F.min(F.coalesce("cnt", F.lit(0).cast("long"))).alias("estimate"))
    return got.withColumn("saturated", F.col("estimate") >= CELL_MAX)


def increment(items: DataFrame, cells: DataFrame, o: CmsOptions, family: str = "md5") -> tuple[DataFrame, DataFrame]:
    """Cells after adding items to a sketch, and the new estimates of those items."""
    total = merge([(cells, 1), (build(items, o, family), 1)], saturate=True)
    return total, query(items, total, o, family)


def merge(parts: list[tuple[DataFrame, int]], saturate: bool = False) -> DataFrame:
    """Weighted sum of sketches of equal shape. A cell below zero or beyond 32 bits fails, unless it is to saturate."""
    if not parts:
        raise ValueError("nothing to merge")
    every: DataFrame | None = None
    for cells, weight in parts:
        if isinstance(weight, bool) or not isinstance(weight, int):
            raise ValueError(f"weights are whole numbers, not {weight!r}")
        one = cells.select("key", "row", "col", (F.col("cnt").cast(WIDE) * F.lit(weight)).cast(WIDE).alias("cnt"))
        every = one if every is None else every.unionByName(one)
    total = every.groupBy("key", "row", "col").agg(F.sum("cnt").cast(WIDE).alias("cnt"))
    top = F.lit(CELL_MAX).cast(WIDE)
    bad = F.raise_error(F.lit("a merged cell is below zero or beyond 32 bits"))
    value: Column = F.least("cnt", top) if saturate else F.when((F.col("cnt") < 0) | (F.col("cnt") > top), bad).otherwise(F.col("cnt"))
    return total.withColumn("cnt", value.cast("long"))
