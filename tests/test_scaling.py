import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchwell.functions.sql import register
from sketchwell.operators import cms, cuckoo, scaling
from sketchwell.options import BloomOptions, CmsOptions, CuckooOptions


@pytest.mark.parametrize("expansion,links", [(1, (22, 25)), (2, (5, 5)), (4, (4, 4))])
def test_links(expansion, links):
    c = scaling.Chain(BloomOptions(error_rate=0.01, capacity=4, expansion=expansion))
    new = [c.add(str(i)) for i in range(100)]
    assert links[0] <= len(c.links) <= links[1] and sum(new) == c.size >= 95  # each link errs at its rate, half the filter's or less
    assert all(str(i) in c for i in range(100))


def test_sizes_follow_capacity_and_error():
    c = scaling.Chain(BloomOptions(error_rate=0.001, capacity=100))
    added = sum(c.add(str(i)) for i in range(4000))
    assert added == c.size >= 3990 and [x[0][0] for x in c.links] == [100, 200, 400, 800, 1600, 3200][: len(c.links)]
    fixed = scaling.Chain(BloomOptions(capacity=3, nonscaling=True))
    assert [fixed.add(x) for x in "abcabcdd"] == [True] * 3 + [False] * 3 + [None, None]
    assert fixed.memory < scaling.Chain(BloomOptions(capacity=3)).memory + 1


def test_dump_and_load():
    c = scaling.Chain(BloomOptions(error_rate=0.01, capacity=62))
    for i in range(500):
        c.add(str(i))
    chunks = list(c.dump(most=100))
    d = scaling.Chain.load(reversed(chunks))
    assert all(str(i) in d for i in range(500)) and d.size == c.size and d.memory == c.memory
    for bad in (chunks[:-1], chunks[1:], [(0, b"x")], [(0, chunks[0][1] + b"x"), *chunks[1:]], []):
        with pytest.raises(ValueError):
            scaling.Chain.load(bad)


def test_chains_by_key(spark):
    items = spark.range(200).select((F.col("id") % 2).cast("string").alias("key"), F.col("id").alias("seq"), F.col("id").cast("string").alias("item"))
    rows = scaling.links(items, BloomOptions(capacity=10)).groupBy("key").agg(F.sum("size").alias("n"), F.max("link").alias("m")).collect()
    assert len(rows) == 2 and all(r.n >= 98 and r.m == 3 for r in rows)


@pytest.mark.parametrize("o", [BloomOptions(error_rate=0.2, capacity=10), BloomOptions(error_rate=0.01, capacity=30, expansion=1), BloomOptions(error_rate=0.25, capacity=200, nonscaling=True)])
def test_many_added_at_once_as_one_by_one(o):
    rng = np.random.default_rng(7)
    c, d, full = scaling.Chain(o), scaling.Chain(o), False
    for size in (1, 50, 3, 400, 900):
        items = [str(x) for x in rng.integers(0, 1200, size)]
        want = []
        for x in items:
            got = c.add(x)
            if got is None:
                full = True
                break
            want.append(got)
        a, b = (np.array(x, np.uint32) for x in zip(*map(c._hash, items)))
        assert d.add_all(a, b) == (sum(want), len(want))
        assert c.links == d.links
        if full:
            break
    assert full == o.nonscaling


def test_links_follow_seq_then_item(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(s), str(x)) for k in ("a", None, "c") for s, x in zip(rng.integers(0, 300, 900), rng.integers(0, 500, 900))]
    for o in (BloomOptions(error_rate=0.2, capacity=10), BloomOptions(error_rate=0.2, capacity=100, nonscaling=True)):
        got = scaling.links(spark.createDataFrame(rows, "key string, seq long, item string").repartition(5), o).collect()
        for k in ("a", None, "c"):
            c = scaling.Chain(o)
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
                if c.add(r[2]) is None:
                    break
            assert sorted((r.link, r.capacity, r.error, r.bits, r.hashes, r.size) for r in got if r.key == k) == [(i, *x[0], x[2]) for i, x in enumerate(c.links)]


def test_sql_functions_agree_with_the_operators(spark):
    register(spark)
    items = spark.range(300).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("item"), F.lit(1).cast("long").alias("inc"))
    items.createOrReplaceTempView("sketch_items")
    o = CmsOptions(31, 3)
    mine = spark.sql("select key, row, sketch_cell(item, row, 31) as col, count(*) as cnt from sketch_items lateral view explode(sequence(0, 2)) r as row group by 1, 2, 3")
    assert mine.exceptAll(cms.build(items, o)).count() == 0
    fp = cuckoo.placed(items, CuckooOptions()).selectExpr("fp = sketch_fingerprint(item) as same").where("not same").count()
    assert fp == 0
    assert spark.sql("select size(sketch_probes('a', 640, 7)) as n").first().n == 7
