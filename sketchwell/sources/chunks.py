"""Dump and load of sketches as chunks (key, chunk, data): chunk 0 is the header, the others hold records.

A record of a Bloom filter is a page number (8 bytes) and its bitmap; of a cuckoo filter a fingerprint
(1 byte), its slot and count (8 bytes each). Chunks are bounded, so any filter can be moved in parts and
in any order. Loading checks headers and lengths before anything is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES, PAGE_BYTES = 64, 4096
ENTRIES = 4096


def _number(c: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), digits, "0"))


def _read(data: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(F.substr(data, at + 1, F.lit(size))), 16, 10).cast("long")


def dump_bloom(headers: DataFrame, pages: DataFrame) -> DataFrame:
    held = headers.join(pages.groupBy("key").agg(F.count("*").alias("pages")), "key", "left").fillna(0, ["pages"])
    head = held.select("key", F.lit(0).cast("long").alias("chunk"), F.to_json(F.struct("capacity", "error", "bits", "hashes", "expansion", "pages")).cast("binary").alias("data"))
    rec = pages.select("key", (F.floor(F.col("page") / PAGES) + 1).cast("long").alias("chunk"), "page", F.concat(_number(F.col("page"), 16), "bitmap").alias("r"))
    return head.unionByName(rec.groupBy("key", "chunk").agg(F.expr("listagg(r) within group (order by page)").alias("data")))


def load_bloom(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, pages) of dumped chunks; a body without a header, of a wrong length or beyond its filter fails, and so
    does a filter whose header counts other pages than there are: a lost chunk would make present items absent."""
    form = "capacity long, error double, bits long, hashes int, expansion int, pages long"
    head = chunks.where("chunk = 0").select("key", F.from_json(F.col("data").cast("string"), form).alias("h")).select("key", "h.*")
    head = head.withColumn("bits", F.when(F.col("bits") > 0, F.col("bits")).otherwise(F.raise_error(F.lit("a header can't be read")).cast("long")))
    size = 8 + PAGE_BYTES
    body = chunks.where("chunk > 0").join(head.select("key", "bits"), "key", "left")
    ok = F.col("bits").isNotNull() & (F.length("data") % size == 0)
    body = body.withColumn("n", F.when(ok, F.floor(F.length("data") / size)).otherwise(F.raise_error(F.lit("a chunk has no header or a wrong length")).cast("long")))
    each = body.select("key", "bits", "data", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    page = _read(F.col("data"), F.col("i") * size, 8)
    rows = each.select("key", "bits", page.alias("page"), F.substr(F.col("data"), F.col("i") * size + 9, F.lit(PAGE_BYTES)).alias("bitmap"))
    inside = F.when(F.col("page") * 8 * PAGE_BYTES < F.col("bits"), F.col("page")).otherwise(F.raise_error(F.lit("a page lies beyond its filter")).cast("long"))
    rows = rows.select("key", inside.alias("page"), "bitmap")
    there = head.select("key", F.col("pages").alias("wanted")).join(rows.groupBy("key").agg(F.count_distinct("page").alias("there"), F.count("*").alias("n")), "key", "left").fillna(0, ["there", "n"])
    whole = (F.col("there") == F.coalesce("wanted", F.lit(-1))) & (F.col("n") == F.col("there"))
    checked = there.select("key", F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("chunks are missing or there twice")).cast("boolean")).alias("ok"))
    return head.drop("pages").join(checked, "key").where("ok").drop("ok"), rows.join(checked, "key", "left").where(F.coalesce("ok", F.raise_error(F.lit("a chunk has no header")).cast("boolean"))).drop("ok")


def dump_cuckoo(store: DataFrame, buckets: int) -> DataFrame:
    keys = store.groupBy("key").agg(F.sum("cnt").alias("items"))
    head = keys.select("key", F.lit(0).cast("long").alias("chunk"), F.to_json(F.struct(F.lit(buckets).cast("long").alias("buckets"), "items")).cast("binary").alias("data"))
    r = F.concat(_number(F.col("fp"), 2), _number(F.col("slot"), 16), _number(F.col("cnt"), 16))
    rec = store.select("key", (F.floor(F.col("slot") / ENTRIES) + 1).cast("long").alias("chunk"), "slot", "fp", r.alias("r"))
    return head.unionByName(rec.groupBy("key", "chunk").agg(F.expr("listagg(r) within group (order by slot, fp)").alias("data")))


def load_cuckoo(chunks: DataFrame) -> DataFrame:
    """The store of dumped chunks, checked against its header's count of items."""
    head = chunks.where("chunk = 0").select("key", F.from_json(F.col("data").cast("string"), "buckets long, items long").alias("h")).select("key", "h.*")
    ok = F.length("data") % 17 == 0
    body = chunks.where("chunk > 0").withColumn("n", F.when(ok, F.floor(F.length("data") / 17)).otherwise(F.raise_error(F.lit("a chunk has a wrong length")).cast("long")))
    each = body.select("key", "data", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    at = F.col("i") * 17
    rows = each.select("key", _read(F.col("data"), at, 1).cast("int").alias("fp"), _read(F.col("data"), at + 1, 8).alias("slot"), _read(F.col("data"), at + 9, 8).alias("cnt"))
    total = rows.groupBy("key").agg(F.sum("cnt").alias("total"))
    good = head.join(total, "key").select("key", F.when((F.col("total") == F.col("items")), F.lit(True)).otherwise(F.raise_error(F.lit("chunks are missing")).cast("boolean")).alias("ok"))
    return rows.join(good, "key").where("ok").select("key", "fp", "slot", "cnt")
