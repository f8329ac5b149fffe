"""Bloom filters as tables.

A filter is a header row (key, bits, hashes, capacity, error, expansion) and pages (key, page, bitmap):
4 KiB bitmaps of 32,768 places each, built by bitmap_construct_agg with partial aggregation, so a
filter of any size is spread over the cluster. Keys are grouping columns; null items are ignored on
build and give null on probe; the empty string is an item.

A set of items gives the same bits in any order, so filters of equal shape merge by bitmap_or_agg.
"Newly added" follows the order of seq: the first item to reach a place set it, and an item is new if
it was the first at one of its places at least. That is what adding one by one would answer, false
positives included, without a sequential pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchwell.functions.hashing import probes
from sketchwell.functions.spread import spread
from sketchwell.operators.quantiles import stepped
from sketchwell.options import BloomOptions

PAGE = 32768
#: Bytes that a chain and a link take besides their bits. Fixed values.
CHAIN_BYTES, LINK_BYTES = 32, 64


def reserve(keys: DataFrame, options: BloomOptions, capacity: Column | None = None) -> DataFrame:
    """Headers for keys(key): one filter each, for options.capacity entries or those of a column."""
    cap = F.lit(options.capacity) if capacity is None else capacity
    per = -math.log(options.link_error) / math.log(2) ** 2
    bits = F.greatest(F.lit(64), F.ceil(F.floor(cap * F.lit(per)) / 64) * 64).cast("long")
    return keys.select("key", cap.cast("long").alias("capacity"), F.lit(options.link_error).alias("error"), bits.alias("bits"), F.lit(math.ceil(math.log(2) * per)).cast("int").alias("hashes"), F.lit(options.expansion).cast("int").alias("expansion"))


def _places(items: DataFrame, headers: DataFrame, family: str) -> DataFrame:
    """items(key, item, ...) with pos, one row per probe."""
    known = spread(items.where(F.col("item").isNotNull()), headers.select("key", "bits", "hashes"), ["key"])
    return known.withColumn("pos", F.explode(probes(F.col("item"), F.col("bits"), F.col("hashes"), family)))


def build(items: DataFrame, headers: DataFrame, family: str = "md5") -> DataFrame:
    """Pages (key, page, bitmap) of the filters of items(key, item); items are made distinct before they are hashed."""
    pos = _places(items.select("key", "item").distinct(), headers, family)
    return pos.groupBy("key", F.floor(F.col("pos") / PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.col("pos") % PAGE).alias("bitmap"))


def merge(*pages: DataFrame) -> DataFrame:
    """Union of filters of equal shape and family."""
    all_pages = pages[0].select("key", "page", "bitmap")
    for p in pages[1:]:
        all_pages = all_pages.unionByName(p.select("key", "page", "bitmap"))
    return all_pages.groupBy("key", "page").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def fill(pages: DataFrame) -> DataFrame:
    """(key, ones): set bits."""
    return pages.groupBy("key").agg(F.sum(F.bitmap_count("bitmap")).cast("long").alias("ones"))


def bit(bitmap: Column, at: Column) -> Column:
    """The bit of a page at a place in it, by the byte that holds it."""
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def exists(probe: DataFrame, headers: DataFrame, pages: DataFrame, family: str = "md5") -> DataFrame:
    """probe(key, item) with found: true if maybe present, false for a missing filter, null for a null item.

    Distinct (key, item) are hashed once; their places meet the pages by a join on (key, page). Where there are few
    pages these are repeated, so that the places of one page are dealt over many tasks; all of an item's in a page stay together.
    """
    want = probe.select("key", "item").where("item is not null").distinct()
    pos = _places(want, headers, family).withColumn("page", F.floor(F.col("pos") / PAGE).cast("long"))
    most = headers.agg(F.coalesce(F.sum(F.ceil(F.col("bits") / PAGE)), F.lit(1)).alias("n"))
    hit = spread(pos, pages.select("key", "page", "bitmap"), ["key", "page"], counted=most).where(bit(F.col("bitmap"), F.col("pos") % PAGE))
    found = hit.groupBy("key", "item", "hashes").agg(F.count("*").alias("on")).select("key", "item", (F.col("on") == F.col("hashes")).alias("found"))
    return probe.join(found, ["key", "item"], "left").withColumn("found", F.when(F.col("item").isNotNull(), F.coalesce("found", F.lit(False))))


def add_flags(items: DataFrame, headers: DataFrame, pages: DataFrame | None = None, family: str = "md5") -> DataFrame:
    """items(key, seq, item) with added: whether the item was new when it came, as adding in order of seq would say.

    pages: bits set before. Order is by seq, so equal seq share an answer.
    """
    each = items.where("item is not null").groupBy("key", "item").agg(F.min("seq").alias("first"))
    pos = _places(each, headers, family)
    first_at = pos.groupBy("key", "pos").agg(F.min("first").alias("opened"))
    if pages is not None:
        old = first_at.withColumn("page", F.floor(F.col("pos") / PAGE).cast("long")).join(pages, ["key", "page"], "left")
        first_at = old.where(~F.coalesce(bit(F.col("bitmap"), F.col("pos") % PAGE), F.lit(False))).select("key", "pos", "opened")
    new = pos.join(first_at, ["key", "pos"]).where("first = opened").select("key", "item", "first").distinct()
    flagged = items.join(new.withColumn("is_new", F.lit(True)), ["key", "item"], "left")
    return flagged.withColumn("added", F.when(F.col("item").isNotNull(), F.coalesce(F.col("is_new") & (F.col("seq") == F.col("first")), F.lit(False)))).drop("is_new", "first")


def nonscaling_flags(flags: DataFrame, headers: DataFrame) -> DataFrame:
    """Flags of filters that may not grow: null from the first new item that finds its filter full, and for all after
    it. Known items are still told as such by a full filter.

    The cut is the place by seq of the item after the last that fits, found by counts over slots: no key is put in
    order as a whole. Order is by seq (as a double: up to 2^53).
    """
    steps = stepped(flags.where("added").select("key", F.col("seq").alias("v")))
    over = steps.join(headers.where("expansion = 0").select("key", "capacity"), "key").where("before + n > capacity")
    cut = over.groupBy("key").agg(F.min("v").alias("cut"))
    return spread(flags, cut, ["key"], "left", by=("seq", "item")).withColumn("added", F.when(F.col("cut").isNull() | (F.col("seq") < F.col("cut")), F.col("added"))).drop("cut")


def cardinality(flags: DataFrame) -> DataFrame:
    """(key, items): how many items were new."""
    return flags.groupBy("key").agg(F.sum(F.col("added").cast("long")).alias("items"))


def estimated_cardinality(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, estimate) from the share of set bits; infinite where all are set, as any number of items may lie behind them."""
    ones = F.coalesce("ones", F.lit(0))
    part = -F.col("bits") / F.col("hashes") * F.log1p(-ones / F.col("bits"))
    return headers.join(fill(pages), "key", "left").select("key", F.when(ones < F.col("bits"), part).otherwise(F.lit(float("inf"))).alias("estimate"))


def info(headers: DataFrame, items: DataFrame) -> DataFrame:
    """(key, capacity, size, filters, items, expansion); expansion is null where the filter doesn't scale."""
    joined = headers.join(items, "key", "left")
    return joined.select("key", "capacity", (F.lit(CHAIN_BYTES + LINK_BYTES) + F.col("bits") / 8).cast("long").alias("size"), F.lit(1).alias("filters"), F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.nullif(F.col("expansion"), F.lit(0)).alias("expansion"))


def describe(headers: DataFrame, items: DataFrame) -> DataFrame:
    """(key, line): a line for the filter and one for its bits."""
    i = info(headers, items).drop("capacity", "expansion").join(headers, "key")
    lines = F.array(F.concat(F.lit("size:"), F.col("items").cast("string")), F.format_string("bytes:%d bits:%d hashes:%d capacity:%d size:%d", (F.col("bits") / 8).cast("long"), "bits", "hashes", "capacity", "items"))
    return i.select("key", F.explode(lines).alias("line"))
