import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchwell.operators import bloom, cms, cuckoo, quantiles, scaling, tdigest, topk
from sketchwell.options import CELL_MAX, BloomOptions, CmsOptions, CuckooOptions, TDigestOptions, TopKOptions
from sketchwell.sources import chunks
from sketchwell.sources.store import SketchStore, read_items

KV = "key string, item string"


def keyed(spark, n, start=0):
    return spark.range(start, start + n).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.col("id").cast("string").alias("item"))


# ---- Bloom

@pytest.mark.parametrize("family", ["md5", "xxhash64"])
@pytest.mark.parametrize("p", [0.1, 0.01])
def test_bloom_false_positives_stay_below_the_rate(spark, p, family):
    items = keyed(spark, 1024)
    h = bloom.reserve(items.select("key").distinct(), BloomOptions(error_rate=p, capacity=1024))
    pages = bloom.build(items, h, family)
    assert bloom.exists(items, h, pages, family).where("not found").count() == 0
    assert bloom.exists(keyed(spark, 10240, 1024), h, pages, family).where("found").count() <= p * 10240


def test_bloom_flags_follow_order_nulls_and_empty(spark):
    rows = [("k", 0, "foo"), ("k", 1, "bar"), ("k", 2, ""), ("k", 3, "foo"), ("k", 4, None), ("k", 5, "new"), ("k", 6, "")]
    items = spark.createDataFrame(rows, "key string, seq long, item string")
    h = bloom.reserve(items.select("key").distinct(), BloomOptions(capacity=1000))
    got = [r.added for r in bloom.add_flags(items, h).orderBy("seq").collect()]
    assert got == [True, True, True, False, None, True, False]
    more = spark.createDataFrame([("k", 9, "bar"), ("k", 10, "other")], items.schema)
    assert [r.added for r in bloom.add_flags(more, h, bloom.build(items, h)).orderBy("seq").collect()] == [False, True]


def test_bloom_that_may_not_grow_refuses(spark):
    items = spark.createDataFrame([("k", i, x) for i, x in enumerate("abcabda")], "key string, seq long, item string")
    h = bloom.reserve(items.select("key").distinct(), BloomOptions(capacity=3, nonscaling=True))
    flags = bloom.nonscaling_flags(bloom.add_flags(items, h), h).orderBy("seq").collect()
    assert [r.added for r in flags] == [True, True, True, False, False, None, None]  # known items are told by a full filter too


def test_bloom_that_may_not_grow_answers_as_a_chain_does(spark):
    rng = np.random.default_rng(4)
    o, rows, want = BloomOptions(error_rate=0.2, capacity=20, nonscaling=True), [], {}
    for key in range(12):
        c, full = scaling.Chain(o), False
        for seq, x in enumerate(rng.integers(0, (15, 30, 60)[key % 3], 60)):
            got = None if full else c.add(str(x))
            full |= got is None
            rows.append((str(key), seq, str(x)))
            want[str(key), seq] = got
    items = spark.createDataFrame(rows, "key string, seq long, item string")
    h = bloom.reserve(items.select("key").distinct(), o)
    assert {(r.key, r.seq): r.added for r in bloom.nonscaling_flags(bloom.add_flags(items, h), h).collect()} == want


def test_bloom_union_dump_and_missing_filter(spark):
    a, b = keyed(spark, 500), keyed(spark, 500, 500)
    h = bloom.reserve(a.select("key").distinct(), BloomOptions(capacity=1000))
    both = bloom.merge(bloom.build(a, h), bloom.build(b, h))
    assert bloom.exists(a.union(b), h, both).where("not found").count() == 0
    h2, p2 = chunks.load_bloom(chunks.dump_bloom(h, both))
    assert p2.exceptAll(both).count() == 0 and both.exceptAll(p2).count() == 0 and h2.first().bits == h.first().bits
    probe = spark.createDataFrame([("none", "1"), ("k", None)], KV)
    assert {r.key: r.found for r in bloom.exists(probe, h, both).collect()} == {"none": False, "k": None}
    est = bloom.estimated_cardinality(h, both).first().estimate
    assert est == pytest.approx(1000, rel=0.05)
    broken = chunks.dump_bloom(h, both).withColumn("data", F.when(F.col("chunk") > 0, F.expr("substring(data, 1, 100)")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="wrong length"):
        chunks.load_bloom(broken)[1].collect()


def test_bloom_without_one_of_its_chunks_fails(spark):
    items = keyed(spark, 1000)
    h = bloom.reserve(items.select("key").distinct(), BloomOptions(capacity=3_000_000))
    pages = bloom.build(items, h)
    dumped = chunks.dump_bloom(h, pages).cache()
    numbers = sorted(r.chunk for r in dumped.select("chunk").collect())
    assert len(numbers) > 3 and chunks.load_bloom(dumped)[1].exceptAll(pages).count() == 0
    for lost in numbers[:4]:
        with pytest.raises(Exception, match="missing|no header"):
            chunks.load_bloom(dumped.where(F.col("chunk") != lost))[1].collect()
    with pytest.raises(Exception, match="twice"):
        chunks.load_bloom(dumped.unionAll(dumped.where("chunk = 1")))[1].collect()
    store = cuckoo.build(items, CuckooOptions(capacity=20_000))
    dumped = chunks.dump_cuckoo(store, CuckooOptions(capacity=20_000).buckets).cache()
    for lost in (1, 2, 3):
        with pytest.raises(Exception, match="missing"):
            chunks.load_cuckoo(dumped.where(F.col("chunk") != lost)).collect()


def test_bloom_with_all_bits_set_has_an_infinite_estimate(spark):
    h = bloom.reserve(keyed(spark, 1).select("key"), BloomOptions(capacity=1, nonscaling=True))
    assert bloom.estimated_cardinality(h, bloom.build(keyed(spark, 1000), h)).first().estimate == math.inf


# ---- cuckoo

def test_cuckoo_counts_and_deletes(spark):
    o = CuckooOptions(capacity=1000)
    items = spark.createDataFrame([("k", 0, "a"), ("k", 1, "a"), ("k", 2, "b")], "key string, seq long, item string")
    s = cuckoo.build(items, o)
    ask = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "zz"), ("none", "a")], KV)
    assert {(r.key, r.item): r.cnt for r in cuckoo.count(ask, s, o).collect()} == {("k", "a"): 2, ("k", "b"): 1, ("k", "zz"): 0, ("none", "a"): 0}
    gone, left = cuckoo.delete(spark.createDataFrame([("k", i, "a") for i in range(3)], items.schema), s, o)
    assert sorted(r.removed for r in gone.collect()) == [0, 1, 1]
    assert cuckoo.compact(left).count() == 1
    assert chunks.load_cuckoo(chunks.dump_cuckoo(s, o.buckets)).exceptAll(s).count() == 0


def test_cuckoo_adds_once(spark):
    o = CuckooOptions(capacity=1000)
    items = spark.createDataFrame([("k", 0, "a"), ("k", 1, "a"), ("k", 2, "c")], "key string, seq long, item string")
    assert [r.added for r in cuckoo.add_new(items, o).orderBy("seq").collect()] == [1, 0, 1]


@pytest.mark.parametrize("share,most", [(1, 0.015), (2, 0.03), (4, 0.06), (8, 0.08)])
def test_packed_cuckoo_collisions(share, most):
    f = cuckoo.Packed(CuckooOptions(capacity=10000 // share, expansion=1, max_iterations=20))
    for i in range(10000):
        assert f.add(str(i))
    assert all(f.count(str(i)) for i in range(0, 10000, 97))
    assert sum(f.count(str(i)) > 1 for i in range(10000)) / 10000 <= most
    assert all(f.delete(str(i)) for i in range(10000)) and f.items == 0


def test_packed_cuckoo_compacts():
    f = cuckoo.Packed(CuckooOptions(capacity=1250))
    assert all(f.add(str(i)) for i in range(8000))
    for i in range(6000):
        assert f.delete(str(i))
    before = len(f.subs)
    assert f.compact() > 0 and len(f.subs) < before and f.items == 2000
    assert all(f.count(str(i)) for i in range(6000, 8000))
    assert all(f.delete(str(i)) for i in range(6000, 8000)) and not any(map(any, f.subs))


def test_cuckoo_insert_refuses_what_has_no_slot(spark):
    o = CuckooOptions(capacity=64, bucket_size=2, expansion=0)
    rows = [("k", i, "same") for i in range(8)] + [("k", 8 + i, str(i)) for i in range(100)]
    items = spark.createDataFrame(rows, "key string, seq long, item string")
    got = {r.seq: r.stored for r in cuckoo.insert(items, o).collect()}
    assert [got[i] for i in range(8)] == [1] * 4 + [-1] * 4  # two buckets of two
    assert sum(v == 1 for v in got.values()) <= 64
    f = {r.seq: r.stored for r in cuckoo.packed_flags(items, o).collect()}
    assert [f[i] for i in range(8)] == [1] * 4 + [-1] * 4 and sum(v == 1 for v in f.values()) <= sum(v == 1 for v in got.values())
    assert {r.b for r in spark.range(1).select(F.explode(F.array(*(cuckoo.buckets_for(F.lit(n), 2) for n in (4, 5, 9, 1000, 1024)))).alias("b")).collect()} == {CuckooOptions(capacity=n).buckets for n in (4, 5, 9, 1000, 1024)}


def test_cuckoo_insert_fills_the_last_slots_among_equal_seq(spark):
    o = CuckooOptions(capacity=64, bucket_size=2, expansion=0)
    rows = [("k", i // 10, str(i)) for i in range(200)] + [("one", 7, str(i)) for i in range(100)] + [("few", i, str(i)) for i in range(5)]
    got = cuckoo.insert(spark.createDataFrame(rows, "key string, seq long, item string"), o).groupBy("key").agg(F.count_if(F.col("stored") == 1).alias("n"), F.count("*").alias("all"), F.max(F.expr("if(stored = 1, seq, null)")).alias("last"))
    assert {r.key: (r.n, r.all, r.last) for r in got.collect()} == {"k": (64, 200, 6), "one": (64, 100, 7), "few": (5, 5, 4)}


@pytest.mark.parametrize("o", [CuckooOptions(capacity=64, expansion=0), CuckooOptions(capacity=32, expansion=2), CuckooOptions(capacity=64, bucket_size=3, expansion=1, max_expansions=99)])
def test_packed_cuckoo_adds_many_as_one_by_one(o):
    rng = np.random.default_rng(5)
    f, g = cuckoo.Packed(o), cuckoo.Packed(o)
    for size in (1, 40, 300, 7, 1500):
        items = [str(x) for x in rng.integers(0, 900, size)]
        fps, hs = (np.array(x) for x in zip(*map(f._hash, items)))
        assert [1 if f.add(x) else -1 for x in items] == g.add_all(fps.astype("u1"), hs.astype("u4")).tolist()
        assert f.subs == g.subs and f.items == g.items


def test_packed_cuckoo_takes_memory_only_where_something_is(monkeypatch):
    def filled():
        f = cuckoo.Packed(CuckooOptions(capacity=32, expansion=2))
        for i in range(3000):
            f.add(str(i % 1700))
        return f, [f.count(str(i)) for i in range(1700)], [f.delete(str(i)) for i in range(0, 1700, 3)], f.compact()

    plain = filled()
    monkeypatch.setattr(cuckoo, "WIDE", 1)
    wide = filled()
    assert type(wide[0].subs[0]) is cuckoo.Wide and plain[1:] == wide[1:] and [bytes(s) for s in plain[0].subs] == [bytes(s) for s in wide[0].subs]


def test_packed_cuckoo_follows_seq_then_item(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(s), str(x)) for k in ("a", None, "c") for s, x in zip(rng.integers(0, 300, 500), rng.integers(0, 400, 500))]
    items = spark.createDataFrame(rows, "key string, seq long, item string").repartition(7)
    for o in (CuckooOptions(capacity=64, expansion=0), CuckooOptions(capacity=64, expansion=2)):
        flags, subs = cuckoo.packed_flags(items, o).collect(), {(r.key, r.filter): r.data for r in cuckoo.packed(items, o).collect()}
        for k in ("a", None, "c"):
            f = cuckoo.Packed(o)
            want = [(s, 1 if f.add(x) else -1) for _, s, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])]
            assert [(r.seq, r.stored) for r in flags if r.key == k] == want
            assert {(r.filter, r.buckets, r.bytes) for r in cuckoo.packed_sizes(items, o).where(F.col("key").eqNullSafe(F.lit(k))).collect()} == {(i, len(s) // 2, len(s)) for i, s in enumerate(f.subs)}
            assert [bytes(subs[k, i]) for i in range(len(f.subs))] == [bytes(s) for s in f.subs]


@pytest.mark.parametrize("expansion", [1, 2])
def test_cuckoo_info_counts_as_many_sub_filters_as_hold_the_items(spark, expansion):
    o = CuckooOptions(capacity=4, expansion=expansion, max_expansions=3)
    i = cuckoo.info(cuckoo.build(keyed(spark, 1001), o), o).first()
    filters = -(-1001 // 4) if expansion == 1 else 8  # 4 + 8 + ... + 512 = 1020
    held = filters * 4 if expansion == 1 else 1020
    assert (i.inserted, i.filters, i.size) == (1001, filters, cuckoo.FILTER_BYTES + filters * cuckoo.SUB_BYTES + held)
    assert f"filters:{filters} " in cuckoo.describe(cuckoo.build(keyed(spark, 1001), o), o).first().line


def test_packed_cuckoo_fills_up_and_expands(spark):
    f = cuckoo.Packed(CuckooOptions(capacity=4, expansion=0))
    assert sum(f.add(str(i)) for i in range(6)) == 4
    sizes = {e: None for e in (1, 2, 4)}
    for e in sizes:
        g = cuckoo.Packed(CuckooOptions(capacity=64, bucket_size=2, expansion=e))
        for i in range(1000):
            g.add(str(i))
        sizes[e] = len(g.subs)
    assert sizes[1] > sizes[2] > sizes[4]
    items = keyed(spark, 200)
    assert cuckoo.packed(items, CuckooOptions(capacity=64)).count() > 1


# ---- count-min

def test_cms_estimates_saturate_and_merge(spark):
    o = CmsOptions(1000, 5)
    items = spark.createDataFrame([("a", "x", 5), ("a", "y", 42), ("b", "x", CELL_MAX), ("b", "x", 10), ("a", None, 7)], "key string, item string, inc long")
    cells = cms.build(items, o)
    got = {(r.key, r.item): (r.estimate, r.saturated) for r in cms.query(items, cells, o).collect()}
    assert got == {("a", "x"): (5, False), ("a", "y"): (42, False), ("b", "x"): (CELL_MAX, True)}
    assert cms.merge([(cells, 1), (cells, -1)]).where("cnt <> 0").count() == 0
    for w in (2, -1):
        with pytest.raises(Exception, match="beyond 32 bits"):
            cms.merge([(cells, w)]).collect()
    with pytest.raises(Exception, match="below zero"):
        cms.build(spark.createDataFrame([("a", "x", -1)], items.schema), o).collect()
    with pytest.raises(ValueError):
        cms.merge([(cells, 1.5)])
    with pytest.raises(ValueError):
        cms.merge([])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(0, 1000)), min_size=1, max_size=30))
def test_cms_never_underestimates(spark, rows):
    o = CmsOptions(7, 3)
    df = spark.createDataFrame([("k", i, n) for i, n in rows], "key string, item string, inc long")
    true = {}
    for i, n in rows:
        true[i] = true.get(i, 0) + n
    assert all(r.estimate >= true[r.item] for r in cms.query(df, cms.build(df, o), o).collect())


# ---- top-k

def test_topk_order_ties_and_zero(spark):
    rows = [("k", "b", 3), ("k", "a", 3), ("k", "c", 9), ("k", "z", 0), ("k", "", 4), ("k", None, 50)]
    c = topk.counts(spark.createDataFrame(rows, "key string, item string, inc int"))
    assert [(r.item, r.cnt) for r in topk.top(c, 3).orderBy("rank").collect()] == [("c", 9), ("", 4), ("a", 3)]
    assert [r.item for r in topk.top(c, 10).orderBy("rank").collect()] == ["c", "", "a", "b"]
    with pytest.raises(Exception, match="between 0 and"):
        topk.counts(spark.createDataFrame([("k", "a", 100001)], "key string, item string, inc int")).collect()


def test_decaying_list_finds_heavy_items(spark):
    s = topk.DecayingTopK(TopKOptions(3, width=50, depth=4, decay=1.0))
    out = [s.add(i, n) for i, n in (("bar", 3), ("baz", 6), ("42", 2), ("42", 8), ("xyzzy", 4))]
    assert out == [None, None, None, None, "bar"]
    assert s.ranking() == [("42", 10), ("baz", 6), ("xyzzy", 4)] and s.count("bar") == 3 and s.count("none") == 0
    rng = np.random.default_rng(0)
    big = topk.DecayingTopK(TopKOptions(50, width=2000, depth=4, decay=0.9))
    for i in rng.permutation([*np.repeat(np.arange(0, 5000, 100), 40), *np.arange(5000)]):
        big.add(str(i))
    assert sum(int(i) % 100 == 0 for i, _ in big.ranking()) > 45
    rows = spark.createDataFrame([("k", i, x, 1) for i, x in enumerate("aababc")], "key string, seq long, item string, inc int")
    assert topk.sequential(rows, TopKOptions(2, 50, 3, 1.0)).orderBy(F.desc("cnt")).first().item == "a"
    assert topk.approximate(rows, 1).first().item == "a"


# ---- quantiles

def repeated(spark):
    return spark.createDataFrame([("k", float(i)) for i in range(1, 6) for _ in range(i)], "key string, v double")


def test_exact_ranks(spark):
    obs = repeated(spark)
    xs = [float(x) for x in range(7)]
    get = lambda df: [r[2] for r in df.orderBy(df.columns[1]).collect()]
    assert get(quantiles.rank(obs, xs)) == [-1, 0, 2, 4, 8, 12, 15]
    assert get(quantiles.rank(obs, xs, reverse=True)) == [15, 14, 13, 10, 7, 2, -1]
    steps = quantiles.stepped(obs)
    data = sorted(r.v for r in obs.collect())
    assert get(quantiles.by_rank(steps, list(range(16)))) == [*data, math.inf]
    assert get(quantiles.by_rank(steps, list(range(16)), reverse=True)) == [*data[::-1], -math.inf]


def test_trimmed_means(spark):
    one = spark.createDataFrame([("k", float(x)) for x in (1,) * 9 + (5,)], "key string, v double")
    mean = lambda df, a, b: quantiles.trimmed_mean(quantiles.stepped(df), a, b).first()["mean"]
    assert mean(one, 0.10, 0.90) == 1.0
    assert mean(one, 0.095, 0.905) == pytest.approx(1.4)
    assert mean(spark.range(20).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("v")), 0.1, 0.9) == pytest.approx(9.5)
    for bad in ((0.5, 0.5), (-0.1, 0.5), (0.1, 1.2)):
        with pytest.raises(ValueError):
            mean(one, *bad)


def test_bad_values(spark):
    obs = spark.createDataFrame([("k", 1.0), ("k", float("nan")), ("k", None), ("n", float("inf"))], "key string, v double")
    got = {r.key: r for r in quantiles.extremes(obs).collect()}
    assert (got["k"].low, got["k"].n) == (1.0, 1) and math.isnan(got["n"].high)
    with pytest.raises(Exception, match="isn't finite"):
        quantiles.finite(obs, strict=True).collect()
    for bad in (lambda: quantiles.rank(obs, [float("nan")]), lambda: quantiles.quantile(obs, [1.1]), lambda: quantiles.by_rank(obs, [-1])):
        with pytest.raises(ValueError):
            bad()


def test_digest_is_exact_when_small_and_close_when_large(spark):
    d = tdigest.Digest.of([5, 1, 3, 2, 4])
    assert [d.quantile(q) for q in (0, 0.5, 1)] == [1, 3, 5] and d.cdf(3) == 0.5 and d.cdf(0) == 0 and d.cdf(9) == 1
    v = np.arange(1, 10000) * 0.01
    big = tdigest.Digest.of(v, 500)
    for q, x in ((0.01, 1), (0.5, 50), (0.95, 95), (0.99, 99)):
        assert big.quantile(q) == pytest.approx(x, abs=0.1)
    assert len(big.mean) < 1100
    assert big.trimmed_mean(0.1, 0.9) == pytest.approx(50, abs=0.1)
    assert big.merge(big).n == 2 * big.n
    empty = tdigest.Digest.of([])
    assert math.isnan(empty.quantile(0.5)) and math.isnan(empty.cdf(1)) and math.isnan(empty.trimmed_mean(0, 1))
    for bad in (lambda: d.quantile(2), lambda: d.trimmed_mean(0.5, 0.5), lambda: tdigest.Digest.of([float("nan")])):
        with pytest.raises(ValueError):
            bad()


def test_digest_answers_ranks_and_resets(spark):
    d = tdigest.Digest.of([float(i) for i in range(1, 6) for _ in range(i)])
    assert [d.rank(float(x)) for x in range(7)] == [-1, 0, 2, 4, 8, 12, 15]
    assert [d.rank(float(x), True) for x in range(7)] == [15, 14, 13, 10, 7, 2, -1]
    data = [float(i) for i in range(1, 6) for _ in range(i)]
    assert [d.by_rank(r) for r in range(16)] == [*data, math.inf] and [d.by_rank(r, True) for r in range(16)] == [*data[::-1], -math.inf]
    empty = tdigest.Digest.of([])
    assert empty.rank(1.0) == -2 and math.isnan(empty.by_rank(0))
    for bad in (lambda: d.rank(float("nan")), lambda: d.by_rank(-1)):
        with pytest.raises(ValueError):
            bad()
    made = tdigest.build(repeated(spark))
    r = tdigest.evaluate(made, xs=[3.0], ranks=[2], trims=[(0.0, 1.0)]).first()
    assert (r.ranks, r.revranks, r.byranks, r.byrevranks) == ([4], [10], [2.0], [5.0]) and r.trimmed_means == pytest.approx([55 / 15])
    gone = tdigest.evaluate(tdigest.reset(made), qs=[0.5], xs=[1.0], ranks=[0]).first()
    assert gone.n == 0 and gone.quantiles == [None] and gone.ranks == [-2]
    i = tdigest.info(made).first()
    assert (i.nodes, i.unmerged_nodes, i.merged_weight, i.observations) == (15, 15, 0, 15)


def test_exact_quantiles_with_outliers_are_spread(spark):
    v = [1e300, -1e300, *np.random.default_rng(3).normal(5, 1e-3, 4000).tolist()]
    obs = spark.createDataFrame([("k", x) for x in v], "key string, v double")
    steps = quantiles.stepped(obs)
    assert [r.before for r in steps.orderBy("v").collect()] == list(range(len(v)))


def test_digest_in_parts(spark):
    obs = spark.range(40000).select((F.col("id") % 3).cast("string").alias("key"), F.col("id").cast("double").alias("v")).repartition(5)
    d = tdigest.build(obs, TDigestOptions(200), flush=3000)
    for r in tdigest.evaluate(d, [0.1, 0.5, 0.99], [20000.0]).collect():
        assert r.n in (13333, 13334)
        assert np.allclose(r.quantiles, [4000, 20000, 39600], atol=300) and abs(r.cdfs[0] - 0.5) < 0.02
    m = tdigest.merge([d, tdigest.build(obs)])
    assert {r.n for r in m.collect()} <= {26666, 26668} and m.first().compression == 200
    i = tdigest.info(m).first()
    assert i.capacity == 1210 and i.nodes <= i.capacity


# ---- store

def test_store(spark, tmp_path):
    st_ = SketchStore(spark, str(tmp_path / "s"))
    items = keyed(spark, 10)
    h = bloom.reserve(items.select("key").distinct(), BloomOptions())
    with pytest.raises(KeyError):
        st_.load("x", "bloom")
    st_.save("x", "bloom", h, bloom.build(items, h))
    head, body = st_.load("x", "bloom")
    assert bloom.exists(items, head, body).where("found").count() == 10
    with pytest.raises(ValueError):
        st_.save("x", "bloom", h)
    with pytest.raises(TypeError):
        st_.load("x", "cms")
    with pytest.raises(ValueError):
        st_.save("y", "what", h)
    st_.save("x", "bloom", h, overwrite=True)
    assert st_.load("x", "bloom")[1] is None
    bodies = {
        "cms": cms.build(items.withColumn("inc", F.lit(2)), CmsOptions(5, 2)),
        "topk": topk.counts(items.withColumn("inc", F.lit(2))),
        "tdigest": tdigest.build(items.select("key", F.col("seq").cast("double").alias("v"))),
        "cuckoo": cuckoo.build(items, CuckooOptions()),
    }
    bad = {"cms": ("cnt", F.lit(-1)), "topk": ("cnt", F.lit(-1)), "tdigest": ("n", F.lit(99)), "cuckoo": ("fp", F.lit(0))}
    for kind, body in bodies.items():
        st_.save(kind, kind, h, body)
        assert st_.load(kind, kind)[1].exceptAll(body).count() == 0
        st_.save(f"{kind}-odd", kind, h, body.withColumn(*bad[kind]))
        with pytest.raises(ValueError, match="no "):
            st_.load(f"{kind}-odd", kind)
        at = tmp_path / "s" / kind / "body" / "version=0"
        body.limit(0).write.mode("overwrite").parquet(str(at))  # rows lost
        with pytest.raises(ValueError, match="what was saved"):
            st_.load(kind, kind)
    items.write.json(str(tmp_path / "j"))
    assert read_items(spark, str(tmp_path / "j"), "json").count() == 10
    with pytest.raises(ValueError):
        read_items(spark, "x", "doc")
