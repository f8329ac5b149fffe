import pytest

from sketchwell.options import BloomOptions, CmsOptions, CuckooOptions, TDigestOptions, TopKOptions, bloom_size, from_conf


@pytest.mark.parametrize("bad", [
    lambda: BloomOptions(error_rate=0), lambda: BloomOptions(error_rate=1.0), lambda: BloomOptions(capacity=0), lambda: BloomOptions(capacity=2**30 + 1),
    lambda: BloomOptions(nonscaling=True, expansion=2), lambda: BloomOptions(expansion=-1), lambda: CuckooOptions(capacity=3), lambda: CuckooOptions(bucket_size=0),
    lambda: CuckooOptions(max_iterations=0), lambda: CuckooOptions(expansion=32769), lambda: CmsOptions(0, 5), lambda: CmsOptions(5, 0), lambda: CmsOptions.by_probability(0.0, 0.1),
    lambda: CmsOptions.by_probability(0.1, 1.0), lambda: TopKOptions(0), lambda: TopKOptions(3, decay=0), lambda: TopKOptions(3, decay=1.1), lambda: TDigestOptions(0), lambda: TDigestOptions(1.5),
])
def test_rejected(bad):
    with pytest.raises(ValueError):
        bad()


def test_dimensions():
    o = CmsOptions.by_probability(0.001, 0.01)
    assert (o.width, o.depth) == (2000, 7)
    assert [CuckooOptions(capacity=c).buckets for c in (10, 1000, 10000)] == [8, 512, 8192]
    bits, _ = bloom_size(300_000_000, 1e-6 / 2)
    assert bits // 8 + 96 == pytest.approx(1_132_420_232, rel=1e-6)
    assert TDigestOptions().capacity == 610


def test_error_rate_is_capped():
    with pytest.warns(UserWarning):
        assert BloomOptions(error_rate=0.5).error_rate == 0.25


def test_scaling_links_grow_and_tighten():
    o = BloomOptions(error_rate=0.01, capacity=100, expansion=4)
    assert [o.link(i)[0] for i in range(3)] == [100, 400, 1600]
    assert [o.link(i)[1] for i in range(3)] == [0.005, 0.0025, 0.00125]


def test_defaults_from_the_session(spark):
    spark.conf.set("spark.sketchwell.bloom.capacity", "500")
    try:
        assert from_conf(BloomOptions, spark).capacity == 500
    finally:
        spark.conf.unset("spark.sketchwell.bloom.capacity")
    assert from_conf(BloomOptions, spark).capacity == 100
