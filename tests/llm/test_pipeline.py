import re

import corpus_pipeline
from sketchwell.llm import decontam, jaccard, toxicity
from sketchwell.llm.common import stored


def test_stages_are_the_wanted_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_output"]


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, data), "t")
        assert kept.columns == corpus_pipeline.COLUMNS
        assert 0 < kept.count() <= docs.count()
        assert kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 or name == "mixing"
        docs = kept
        if name == "ngram_jaccard_join":
            again = jaccard.near_duplicates(kept, num=80, den=100, width=5)
            assert again.where("doc_id <> component_id").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.count() == docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, out.collect()))


def test_filtering_stages_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = jaccard.brute_components(rows, num=80, width=5)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()}
    assert kept == {i for i, (_, c) in groups.items() if i == c} and len(kept) < len(rows)
    short = docs.where("length(text) < 3000")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {d for d, _ in decontam.brute_contaminated([r for r in rows if r[1] and len(r[1]) < 3000], items)}
    kept = {r.doc_id for r in corpus_pipeline.drop_benchmark_passages(spark, short, data).collect()}
    gone = {r.doc_id for r in short.select("doc_id").collect()} - kept
    assert gone <= leaks and len(gone) >= 0.9 * len(leaks) > 0


def test_near_duplicates_leave_one_row_of_each_id(spark, odd, odd_rows):
    got = corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i, (_, c) in jaccard.brute_components([r for r in odd_rows if r[0] is not None], num=80, width=5).items() if i == c}
    assert sum(r.doc_id is None for r in got) == 1
    twice = odd.unionAll(odd)
    assert sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, twice.where("doc_id is not null"), "").collect())) == sorted(str(r) for r in got if r.doc_id is not None)


def test_stages_with_odd_rows(spark, odd, none, data):
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, data), "t")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_the_driver_holds_no_training_texts(spark, data, monkeypatch):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    known = docs.select("doc_id", "text").join(labels.where(~toxicity.held_out()).select("doc_id", "toxic"), "doc_id").collect()
    known.sort(key=lambda r: r.doc_id)
    bad = sum(r.toxic for r in known)
    want = toxicity.CompressionModel.fit([r.text for r in known], [int(r.toxic) for r in known], toxicity.ToxicityOptions(), bad / (len(known) - bad))
    monkeypatch.setattr(toxicity.CompressionModel, "fit", None)  # here, not in workers
    got = toxicity.fit(docs, labels)
    texts = [r.text for r in known[:50]]
    assert got.scores(texts) == want.scores(texts) and any(got.scores(texts))
    assert toxicity.fit(docs.where("doc_id < 0"), labels).scores(texts) == [0.0] * len(texts)


def test_the_driver_gives_back_what_it_has_freed(spark):
    jvm = spark._jvm
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status").read())[1])
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    parts = [unsafe.allocateMemory(100_000) for _ in range(2000)]
    for at in parts:
        unsafe.setMemory(at, 100_000, 1)
    for at in parts[:-1]:  # the last one keeps the allocator from giving back the rest
        unsafe.freeMemory(at)
    before = held()
    stored(spark.range(1), "t")
    unsafe.freeMemory(parts[-1])
    assert held() < before - 100_000  # of 195,000 kB freed
