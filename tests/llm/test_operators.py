import hashlib
import os
import random
import zlib

from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from sketchwell.llm import chat, common, decontam, jaccard, licenses, media, mixing, quality, queries, substrings, tokens, toxicity


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns) or None).to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLES[name], data)


def test_every_number_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


# ---- 1 toxicity

def test_toxicity_separates_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    held = [(got[r["doc_id"]], r["toxic"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 for g, _ in held)
    bad, good = [g for g, y in held if y], [g for g, y in held if not y]
    assert np.mean([g.predicted for g in bad]) > 0.7
    assert np.mean([g.predicted for g in good]) < 0.06
    assert np.mean([x.score > y.score for x in bad for y in good]) > 0.9


def test_toxicity_scores_equal_a_plain_computation(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert len(model.steps) == 5 and list(model.steps) == sorted(set(model.steps))
    plain, both = (toxicity._compressor(x, model.options) for x in (model.ordinary, model.toxic + model.ordinary))
    mean, spread, weights = model.weights
    for r in toxicity.score(docs, model, "s").collect():
        text = " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (r.text or "").translate({65 + k: 97 + k for k in range(26)})).split(" ")) + " "
        words = [w for w in text.encode().split(b" ") if w]
        data_ = b" " + b" ".join(words) + b" "
        gains = [len(plain(data_[i : i + 64])) - len(both(data_[i : i + 64])) for i in range(0, max(1, len(data_) - 12), 52)]
        over = [sum(g >= t for g in gains) for t in model.steps]
        x = [*(np.log(1 + k) for k in over), np.log(len(gains)), max(gains), over[0] / len(gains), over[1] / len(gains), 1.0]
        z = sum(w * (v - m) / d for w, v, m, d in zip(weights, x, [*mean, 0.0], [*spread, 1.0]))
        assert r.s == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, z))))), r.doc_id
    small = toxicity.ToxicityOptions(max_train_docs=20, max_train_bytes=64_000)
    assert toxicity.fit(docs, labels, small).steps == () or toxicity.score(docs, toxicity.fit(docs, labels, small), "s").count() == docs.count()


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (9, 1), (10, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model, "score").count() == odd.count()
    blank = toxicity.CompressionModel(toxicity.ToxicityOptions())
    assert {r.s for r in toxicity.score(odd.select("doc_id", "text"), blank, "s").collect()} == {0.0}
    assert toxicity.score(none, toxicity.fit(none, labels), "s").count() == 0


# ---- 2 similarity join

def check_near(rows, df, **rule):
    want = jaccard.brute_components([r for r in rows if r[0] is not None], **rule)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_near_duplicates_odd_rows(spark, odd, odd_rows, none):
    check_near(odd_rows, jaccard.near_duplicates(odd))
    assert jaccard.near_duplicates(none).count() == 0


def test_near_duplicates_equal_brute_force_on_chains_and_hot_shingles(spark):
    rng = random.Random(2)
    common_line = "this very line is in nearly every text of the lot".split()
    texts = []
    for g in range(12):
        base = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(rng.choice([12, 15, 20, 40, 90]))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(["zip", "zap", "zop"])
            if rng.random() < 0.6:
                k = rng.randrange(len(t))
                t[k:k] = common_line
            texts.append(" ".join(t))
            base = t if rng.random() < 0.3 else base  # chains
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_near(rows, jaccard.near_duplicates(df))
    check_near(rows, jaccard.near_duplicates(df, star=300))  # many blocks
    check_near(rows, jaccard.near_duplicates(df, num=80, den=100, width=5), num=80, den=100, width=5)
    check_near(rows, jaccard.near_duplicates(df, num=50, den=100, width=2, short=1), num=50, den=100, width=2)


@pytest.mark.parametrize("num, width, sizes", [(90, 3, range(1, 22)), (80, 5, range(1, 22)), (50, 2, range(1, 8))])
def test_near_duplicates_link_small_sets_with_one_word_more(spark, num, width, sizes):
    rng = random.Random(num)
    rows = []
    for n in sizes:  # n shingles, and the same with one word before, after, on either side, or another last word
        w = [f"w{rng.random()}" for _ in range(n + width - 1)]
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((w, [*w, "more"], ["well", *w], ["well", *w, "more"], [*w[:-1], "other"]))]
    want = jaccard.brute_components(rows, num=num, width=width)
    assert all(want[5 * k][1] == want[5 * k + 1][1] for k, n in enumerate(sizes) if 100 * n >= num * (n + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_near(rows, jaccard.near_duplicates(df, num=num, width=width), num=num, width=width)


def test_near_duplicates_link_small_sets_of_frequent_shingles(spark):
    w = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([f"a{k}" if k % 3 else "well", *w[:11], f"b{k}"][k % 2 :][: 12 - k % 5 // 4])) for k in range(120)]
    for num, width in ((90, 3), (80, 5), (80, 3)):
        check_near(rows, jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num=num, width=width, short=1), num=num, width=width)


def test_near_duplicates_lists_end_where_sizes_are_too_far_apart(spark):
    def lists(sizes, num):
        rows = [(k, n, [7]) for k, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "id long, n long, prefix array<long>").repartition(3)
        return sorted((r.k, list(r.ids), r.leader) for r in jaccard.inverted(df, {}, num, 100).collect())

    # 10 to 11 and 18 to 20 are 90 % at least; 100 is alone, so are 50 and 40
    assert lists([100, 20, 10, 18, 11, 50, 40], 90) == [(2, [2, 4], 2), (2, [3, 1], 3)]
    assert lists([9, 10, 12], 90) == [(2, [0, 1], 0)]
    assert lists([100, 20], 90) == []
    # lists of several blocks that span batches of rows: what the blocks of one token hold together
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, n, [7]) for k, n in enumerate([100] * 7 + [1000] * 5)]
        blocks = jaccard.inverted(spark.createDataFrame(rows, "id long, n long, prefix array<long>"), {}, 90, 100, block=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(blocks) > 2 and {b.k for b in blocks} == {2}
    held = {t: sorted(i for b in blocks if b.token == t for i in b.ids) for t in {b.token for b in blocks}}
    assert sorted(held.values()) == [list(range(7)), list(range(7, 12))] and {b.leader for b in blocks} == {0, 7}


def test_near_duplicates_move_few_prefixes_and_keep_little(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    hot = [f"{a} is {b}" for a in "abcdef" for b in "uvwxyz"]
    texts = [" ".join(rng.choice(hot) if rng.random() < 0.2 else f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 400))) for _ in range(150)]
    texts += [t for t in texts[:30] for _ in range(3)] + [f"{t} tail" for t in texts[20:60]]
    rows = list(enumerate(texts))
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_near(rows, jaccard.near_duplicates(df))
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "signatures" in left and not left & {"lists", "members", "stars", "sets", "open", "pairs"}
    sigs = spark.createDataFrame([(1, 2, b"k", [5]), (2, 2, b"k", [5]), (2, 3, b"m", [6]), (3, 3, b"m", [6]), (4, 0, None, [])], "id long, n long, key binary, prefix array<long>")
    classes = spark.createDataFrame([(b"k", 1, 2), (b"m", 2, 3)], "key binary, rep long, n long")
    near = sigs.unionAll(spark.createDataFrame([(9, 3, b"z", [5, 6])], sigs.schema))  # a row beside them, so that lists have two classes
    groups = classes.unionAll(spark.createDataFrame([(b"z", 9, 3)], classes.schema))
    for full in (False, True):  # and a filter that holds all
        if full:
            monkeypatch.setattr(jaccard, "in_filter", lambda packed, ids: np.ones(len(ids), bool))
        lists = jaccard.inverted(near, {}, 50, 100, copies=jaccard._copies(near, groups))
        assert sorted(sorted(r.ids) for r in lists.collect()) == [[1, 9], [2, 9]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 14), min_size=10, max_size=14, unique=True), min_size=2, max_size=12))
def test_join_sets_connects_what_links(sets):
    rows = [np.array(sorted(s), np.uint64) for s in sets]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(set(sets[i]) & set(sets[j]))
            if jaccard.linked(c, len(sets[i]), len(sets[j]), 70, 100):
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = {top(i) for i in range(len(rows))}
    mine = list(range(len(rows)))

    def mtop(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for a, b in jaccard.join_sets(list(range(len(rows))), rows, 70, 100):
        assert jaccard.linked(len(set(sets[a]) & set(sets[b])), len(sets[a]), len(sets[b]), 70, 100)
        mine[max(mtop(a), mtop(b))] = min(mtop(a), mtop(b))
    assert {mtop(i) for i in range(len(rows))} == want


def test_merge_counts_both_ways():
    lists = [np.array(x, np.int64) for x in ([1, 2, 5], [2, 5], [5, 9])]
    for more in ([], [np.arange(100, 200)]):
        ids, hits = jaccard.merge_counts(lists + more)
        assert dict(zip(ids[:4].tolist(), hits[:4].tolist())) == {1: 1, 2: 2, 5: 3, 9: 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 200), (200, 100), (7, 7), (300, 301), (301, 302), (302, 300)] + [(400, i) for i in range(401, 450)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 300, 301: 300, 302: 300, **{i: 400 for i in range(400, 450)}}


# ---- 3 decontamination

def one_word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))


def edited_text(text, share, rng):
    """So many edits, as a share of the symbols, at random places: a third each replaced, inserted and removed."""
    at = [i for i, c in enumerate(text) if c != " "]
    out = list(text)
    for i in rng.sample(at, int(share * len(at))):
        out[i] = (rng.choice("qrstuvwxyz"), out[i] + rng.choice("qrstuvwxyz"), "")[rng.randrange(3)]
    return "".join(out)


def test_contamination_reaches_its_recall_by_length_and_edit_rate(spark):
    rng = random.Random(3)
    kinds = ("0", "0.05", "0.1", "0.15", "0.2", "a letter of each word", "every tenth word")
    items, rows, of = [], [], {}
    for n in (4, 6, 8, 10, 15, 25, 40, 60):
        for _ in range(40):
            text = " ".join(one_word(rng) for _ in range(n))
            if len(text.replace(" ", "")) < 16:
                text += " " + "abcdefghijklmnop"
            items.append((len(items), text))
            for kind in kinds:
                if kind == "a letter of each word":
                    copy = " ".join(w[:1] + "z" + w[2:] if len(w) > 5 else w for w in text.split())
                elif kind == "every tenth word":
                    copy = " ".join(one_word(rng) if k % 10 == 5 else w for k, w in enumerate(text.split()))
                else:
                    copy = edited_text(text, float(kind), rng)
                d = len(rows)
                rows.append((d, " ".join([*(one_word(rng) for _ in range(rng.randint(0, 40))), copy, *(one_word(rng) for _ in range(30))])))
                of[d] = n, kind, len(items) - 1
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(docs, bench).collect()}
    text_of, item_of = dict(rows), dict(items)
    recall: dict = {}
    for d, (n, kind, i) in of.items():
        want = decontam.brute_contaminated([(d, text_of[d])], [(i, item_of[i])])
        if want:
            recall.setdefault((n, kind), []).append((d, i) in got)
            assert (d, i) not in got or got[d, i] == want[d, i]
    table = {k: (round(sum(v) / len(v), 2), len(v)) for k, v in sorted(recall.items())}
    print(table)
    assert all(v >= 0.9 for k, (v, n) in table.items() if n >= 20), table
    assert all(v == 1 for (_, kind), (v, _) in table.items() if kind == "0")
    extra = [(d, i) for d, i in got if of[d][2] != i]
    assert all(decontam.brute_contaminated([(d, text_of[d])], [(i, item_of[i])]) == {(d, i): got[d, i]} for d, i in extra)


def test_contamination_equals_brute_force_on_the_sample(spark):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    rows = [(r["doc_id"], r["text"]) for r in table("documents", "doc_id", "text") if r["text"] and len(r["text"]) < 4000]
    capitals = {ord(c): ord(c) - 32 for c in "abcdefghijklmnopqrstuvwxyz"}
    rows += [(10**6 + i, f"So: {t.translate(capitals).replace(' ', '  - ')}!") for i, t in items]  # other case, blanks and punctuation: distance 0
    want = decontam.brute_contaminated(rows, items)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(docs, bench).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert all(got[10**6 + i, i] == 0 for i, _ in items)
    assert {k for k, v in want.items() if v <= 0.1 * len(dict(items)[k[1]])} <= set(got) and len(got) >= 0.9 * len(want)
    parts = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(docs, bench, decontam.CgkOptions(block_symbols=1500)).collect()}
    assert parts == got  # items in many blocks


def test_contamination_finds_exact_copies_of_any_length_at_any_place(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate(range(1, 31))] + [(50, "ab"), (51, "x y"), (52, "Q"), (53, "one-two")]
    rows = [(10 * k + p, " ".join([*(word() for _ in range(12 + p)), t, *(word() for _ in range(20))])) for k, t in items for p in range(6)]
    rows += [(1000, "ab"), (1001, "X y."), (1002, ""), (1003, "abc"), (1004, "onetwo (one) two!")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect() if r.distance == 0}
    assert {(10 * k + p, k) for k, _ in items for p in range(6)} | {(1000, 50), (1001, 51), (1004, 53)} <= got
    assert (1003, 50) not in got  # a short item is a run of whole words
    want = decontam.brute_contaminated(rows, items)
    assert {k for k in got if k[1] >= 50} == {k for k in want if k[1] >= 50}


def test_contamination_odd_rows(spark, odd, none, odd_rows):
    mid = odd_rows[8][1]
    items = spark.createDataFrame([(1, mid), (2, None), (3, ""), (4, " "), (None, mid), (5, "one"), (1, mid), (6, "\u00e9 \u00f1 \u4e2d\u6587")], "item_id long, text string")
    for o in (decontam.CgkOptions(), decontam.CgkOptions(block_symbols=100)):
        rows = decontam.contaminated(odd, items, o).collect()
        got = {(r.doc_id, r.item_id): r.distance for r in rows}
        assert len(got) == len(rows)
        assert {(9, 1), (10, 1), (11, 1), (12, 1), (None, 1), (4, 5), (5, 5), (14, 6)} <= set(got) and got[9, 1] == 0 == got[None, 1] and not {i for _, i in got} & {2, 3, 4, None}
        assert {r.ends_at for r in rows if (r.doc_id, r.item_id) == (9, 1)} == {len(mid)}
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0


def test_contamination_filter_equals_a_plain_count_and_verifies_together(monkeypatch):
    rng = random.Random(12)
    items = [" ".join(one_word(rng) for _ in range(n)) for n in (6, 9, 30, 45, 60)]
    index = decontam.Index(list(range(len(items))), [t.encode() for t in items], decontam.CgkOptions())
    texts = [" ".join([*(one_word(rng) for _ in range(rng.randint(0, 9))), edited_text(t, 0.1, rng), *(one_word(rng) for _ in range(rng.randint(0, 3)))]).encode() for t in items for _ in range(4)]
    ends = np.cumsum([len(t) for t in texts])
    s, place, first = decontam.symbols_of(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, ends[:-1]], ends)
    buckets = decontam.gram_buckets(np.append(s, np.zeros(4, np.uint8)), 4).astype(np.int64)
    item, start = (np.array(x) for x in zip(*sorted((rng.randrange(len(items)), rng.randrange(-300, len(s) + 50)) for _ in range(4000))))
    row = np.searchsorted(first, np.clip(start + index.sizes[item] // 2, 0, len(s) - 1), "right") - 1
    plain = []
    for k, x, r in zip(item.tolist(), start.tolist(), row.tolist()):
        places, held = decontam.asked_grams(int(index.sizes[k]), index.o), np.unpackbits(index.grams[k])
        plain.append(sum(int(held[buckets[x + g]]) for g in places if first[r] <= x + g < first[r + 1] - 1) >= index.shares[k] * len(places))
    assert index.likely(item, start, row, first, buckets).tolist() == plain and 0 < sum(plain) < len(plain)
    calls, fit = [], decontam.fit_many
    monkeypatch.setattr(decontam, "fit_many", lambda *x: calls.append(len(x[0])) or fit(*x))
    held = [(r, k, s[x:z].tobytes()) for r, k, x, z in index.stretches(s, place, first)]
    got = {held[i][:2] for i, _, _ in index.matches([h[1:] for h in held])}
    assert {(r, r // 4) for r in range(len(texts))} <= got
    assert sum(calls) == len(held) and len(calls) <= 8  # many texts go together


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=20))
def test_fit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    assert decontam.fit_distance(item, text)[0] == (min(row) if item else 0)


def test_fit_many_equals_fit_distance():
    rng = random.Random(1)
    some = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    items = [some(rng.choice([1, 5, 63, 64, 65, 128, 129, 200])) for _ in range(60)]
    texts = [some(rng.randint(1, 30)) + (i[: len(i) // 2] + some(rng.randint(0, 2)) + i[len(i) // 2 :] if k % 3 else b"") + some(20) for k, i in enumerate(items)]
    got = decontam.fit_many(items, texts)
    assert [(int(d), int(e)) for d, e in zip(*got)] == [decontam.fit_distance(i, t) for i, t in zip(items, texts)]


# ---- 4 licences

def test_licence_texts_are_found_whatever_their_dress(spark):
    mit = licenses.KNOWN[0][1]
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
    owned = "Copyright Jane Doe 2020\nCopyright 2019 by Someone\n\n" + bsd.replace("\n", "\r\n").replace("copyright holder nor", "Copyright  Holder, nor")
    dressed = mit.upper().replace("LICENSE", "LICENCE").replace("<YEAR> <HOLDERS>", "2001, 2002 Someone & Sons") + "\n\n(c) 1999 Another\n"
    rows = [(1, dressed), (2, mit + " more"), (3, "Text.\n** Released under the MIT Licence! **\nLicensed under CC BY-NC 4.0"), (4, None), (5, ""), (1, dressed), (6, owned), (7, "copyright law is the law of copies\nin 2020 or later")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, "CC-BY-NC-4.0,MIT"), 4: (None, ""), 5: (None, ""), 6: ("BSD-3-Clause", ""), 7: (None, "")}
    assert all(licenses.scan(spark.createDataFrame([(0, t)], "doc_id long, text string")).first().license == n for n, t in licenses.KNOWN[-22:-14])


def test_licence_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 18  # the repeated row is one
    assert licenses.scan(none).count() == 0


# ---- 5 token output

def test_token_output_reads_back(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_vocabulary())
    got = {r.doc_id: r for r in queries.op5_token_output(spark, data).collect()}
    start = 0
    for r in sorted(table("documents", "doc_id", "text"), key=lambda r: r["doc_id"]):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        g = got[r["doc_id"]]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokens.default_vocabulary()), tokens.Encoder(tokens.default_vocabulary())
    texts = ["", "  ", "a\x1cb\xa0c  x's 'S don't ,'s x,'ll İstanbul ΑΣ é ́x 中文字 12ab", "<|endoftext|>foo a<|startoftext|>Bar <|ENDOFTEXT|>", "word,'s (a.b) 3.14 a..b ?!'t", "ﬁ ½² ß ẞ ª b", "A|B a$b c*#d", "naïve naïve"]
    ids, at = enc.encode([t.encode() for t in texts], 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abXYZ  \n\x1c.,;!$'<|s19×÷ªµºßÀÉÿéñöŸıİſ中¼\u0301\u00a0\u0338…€")) | st.characters(max_codepoint=0x250), max_size=24), max_size=6))
def test_encoder_equals_the_tokenizer_on_any_letters(texts):
    tok, enc = _tokenizer(), tokens.encoder(tokens.default_vocabulary())
    texts += ["<|endoftext|>É.é", "<", "|É.é", "ÀB.!"]  # marks of a special token in one text, or over the ends of two
    ids, at = enc.encode([t.encode() for t in texts], 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t


@lru_cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_new_plain_words_go_to_the_model_alone(monkeypatch):
    enc = tokens.Encoder(tokens.default_vocabulary())
    assert enc.model is not None
    full, seen = enc.tok, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return full.encode_batch_fast(texts, **options)

        encode_batch = encode_batch_fast

    enc.tok = Watched()
    text = "Straße naïve ÉTÉ, plain. words again words é! don't 中文"
    ids, _ = enc.encode([text.encode()], None)
    assert ids.tolist() == full.encode(text, add_special_tokens=False).ids
    assert sorted(" ".join(seen).split()) == ["!", ",", ".", "don't", "中文"]


def test_words_of_texts():
    texts = [b"", b" a  b\ta ", b"b", b"\x0b\x0c", b"c\x1cd a\r\nb", b""]
    off = np.cumsum([0, *map(len, texts)])
    words, which, count = common.words_of(np.frombuffer(b"".join(texts), np.uint8), off)
    each = iter([words[k] for k in which])
    assert [[next(each) for _ in range(n)] for n in count] == [t.split() for t in texts] and len(words) == len(set(words))
    assert common.words_of(np.empty(0, np.uint8), np.zeros(1, np.int64))[0] == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400), st.data())
def test_codes_give_random_access(ids, data):
    ids = np.array(ids, np.uint32)
    s = tokens.Shard(tokens.pack(ids, np.array([5]), np.array([0, len(ids)])))
    lo = data.draw(st.integers(0, len(ids)))
    hi = data.draw(st.integers(lo, len(ids)))
    assert (s.tokens(lo, hi) == ids[lo:hi]).all()
    for i in range(lo, min(hi, lo + 20)):
        assert s.token(i) == ids[i]
    with pytest.raises(IndexError):
        s.token(len(ids))


def test_large_shard_ranks():
    ids = np.random.default_rng(0).integers(0, 70000, 5000).astype(np.uint32)
    s = tokens.Shard(tokens.pack(ids, np.array([1]), np.array([0, 5000])))
    assert [s.token(i) for i in range(5000)] == ids.tolist()
    with pytest.raises(ValueError):
        tokens.Shard(b"nope")


def test_token_odd_rows(spark, odd, none):
    got = sorted(tokens.read_documents(tokens.write_shards(odd, tokens.default_vocabulary(), shard_tokens=500)).collect(), key=lambda r: r.start)
    assert len(got) == odd.count() and got[0].doc_id is None
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert tokens.read_documents(tokens.write_shards(none, tokens.default_vocabulary())).count() == 0


# ---- 6 chat

def test_chat_examples(spark):
    rows = [(1, 0, "system", "be\\ <kind>"), (1, 1, "user", "[INST] hi </s>"), (1, 2, "assistant", "a<|/|>b"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, None, None, "x"), (None, 0, "assistant", "y"), (None, 0, "assistant", "y"), (3, 0, "assistant", "<|assistant|>"), (3, 0, "<|x|>", "\\l"), (4, 0, "/", ""), (4, 1, "/|", "/"), (4, 2, "", ""), (4, 3, "a/b\\s", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 9, "f", None) for r in rows], "conv_id long, turn long, role string, text string, head long, formatted string, spans string")
    form = chat.formatted(df)
    ex = {(r.conv_id, r.example): r for r in chat.examples(form).collect()}
    assert sorted(ex, key=str) == [(1, 0), (1, 1), (3, 0), (None, 0), (None, 1)]
    e = ex[1, 0]
    assert e.text.endswith("<|/|>") and "[INST]" not in e.text and "</s>" not in e.text
    assert e.text[e.loss_start : e.loss_end] == "a\\l|/|\\gb"
    assert ex[1, 1].text.startswith(e.text) and ex[1, 1].loss_start == ex[1, 1].loss_end
    read = {r.conv_id: [(x.role, x.text) for x in r.t] for r in form.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert read[1] == [("system", "be\\ <kind>"), ("user", "[INST] hi </s>"), ("assistant", "a<|/|>b"), ("user", ""), ("assistant", "")]
    assert read[4] == [("/", ""), ("/|", "/"), ("", ""), ("a/b\\s", "x" * 300_000)]
    assert read[3] == [("<|x|>", "\\l"), ("assistant", "<|assistant|>")] and read[2] == [("", "x")]
    d = {r.conv_id: r for r in chat.digests(df).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(b"a<|/|>b").hexdigest() and d[2].loss_chars == 0 and d[None].n_turns == 2
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_uses_no_python(spark, data):
    plan = queries.op6_chat_format(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 7 repeated strings

def expected(texts, length):
    out = []
    for t, gone in zip(texts, substrings.brute_removed(texts, length)):
        spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    piece = lambda n, s="abcd": "".join(rng.choice(s) for _ in range(n))
    shared = [piece(n) for n in (399, 400, 401, 650, 2000)]
    texts = [piece(rng.randint(0, 900)) + rng.choice(shared)[: rng.randint(300, 2000)] + piece(rng.randint(0, 300)) for _ in range(60)]
    texts += ["z" * 401, "z" * 900, "ab" * 500, "é" * 450, shared[4] + shared[4], "", "q" * 399, texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(df).collect()}
    for i, e in enumerate(expected([t.encode() for t in texts], 400)):
        assert got[i] == e, i


def test_repeats_in_hot_grams_and_chunks(spark):
    rng = random.Random(6)
    mid = "".join(rng.choice("abcdefgh ") for _ in range(380))
    texts = ["".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) + mid + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    named = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    runs = lambda **k: sorted({(r.uid, p) for r in substrings.repeated_starts(named, **k).collect() for p in range(r.first, r.last + 1)})
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 399):
            seen.setdefault(t[p : p + 400], []).append((i, p))
    want = sorted(x for v in seen.values() if len(v) > 1 for x in v)
    assert runs() == want == runs(most=3) == runs(block=600, meeting=2000)


def test_shared_passages_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    new = lambda n: [word() + str(rng.random()) if rng.random() < 0.2 else word() for _ in range(n)]
    shared = [new(n) for n in (50, 51, 52, 60, 75, 120, 400)]
    texts = [" ".join([*new(rng.randint(0, 80)), *rng.choice(shared)[: rng.randint(40, 400)], *new(rng.randint(0, 80))]) for _ in range(80)]
    texts += [" ".join(["and"] * 200), "z " * 50, "\n".join(shared[1]), " ".join(shared[6] * 2), "", "q" * 900, texts[0], " ".join(new(51)), " ".join(new(600) * 2)]
    named = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(4)
    want = {k for k, on in enumerate(substrings.brute_shared([t.encode() for t in texts])) if on}
    assert 20 < len(want) < len(texts) - 5
    for block in (1 << 20, 300):  # small blocks: chunks of long texts
        assert {r.uid for r in substrings.shared_passages(named, block=block).collect()} == want
    got = substrings.without_repeats(named.withColumnRenamed("uid", "doc_id")).collect()
    assert {r.doc_id for r in got if r.shares_passage == 1} == want and {r.shares_passage for r in got} == {0, 1}
    pieces = substrings.Words().of(" ".join(texts).encode(), piece=100)
    assert (pieces == substrings.Words().of(" ".join(texts).encode())).all()


def test_doubling_equals_a_count_and_sorts_whole_words_once(monkeypatch):
    rng = random.Random(10)
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: k.get("return_inverse") and calls.append(len(x)) or unique(x, *a, **k))
    for length in (8, 9, 50, 400):
        text = b"".join(rng.choice([b"a" * 30, b"ab" * 40, bytes(rng.choices(b"abc", k=rng.randint(1, 700)))]) for _ in range(40)) * 2
        text += bytes(rng.choices(b"abcd", k=900))
        starts = np.array(rng.sample(range(len(text) - length + 1), len(text) // 2))  # in any order
        seen = {}
        for i in starts.tolist():
            seen.setdefault(text[i : i + length], []).append(i)
        calls.clear()
        got = substrings.doubled(np.frombuffer(text, np.uint8), starts, length)
        assert len(calls) <= 1  # ranks of pairs are counted, or sorted with their places
        assert got.tolist() == [len(seen[text[i : i + length]]) > 1 for i in starts.tolist()]
    assert len(substrings.doubled(np.zeros(9, np.uint8), np.empty(0, np.int64), 8)) == 0
    keys = np.array([7, 3, 7, 1 << 40, 0, 3])
    assert [substrings._ranks_of(keys, m).tolist() for m in (1 << 41, 1 << 62)] == [[2, 1, 2, 3, 0, 1]] * 2


def test_word_ranks_of_many_texts():
    import xxhash

    texts = [b"", b" a b\ta", b"b", b"\x0bc\x1cd\r\n", b"a" * 3000]
    rank, count = substrings.Words().of_all(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert rank.tolist() == [xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split()] and count.tolist() == [len(t.split()) for t in texts]


def test_repeats_odd_rows(odd, none, odd_rows):
    got = substrings.without_repeats(odd)
    want = sorted(map(str, [(i, *e) for (i, _), e in zip(odd_rows, expected([(t or "").encode()[:20000] if i in (7, 8) else (t or "").encode() for i, t in odd_rows], 400)) if i not in (7, 8)]))
    assert sorted(str(tuple(r)[:5]) for r in got.collect() if r.doc_id not in (7, 8)) == want
    assert {r.doc_id for r in got.collect() if r.shares_passage} == {7, 8, 9, 10, 11, 12, 13, None}
    assert all(r.n_removed >= r.n_bytes - 5 for r in got.collect() if r.doc_id in (7, 8))
    assert substrings.without_repeats(none).count() == 0


# ---- 8 quality

def test_quality_prefers_the_target(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op8_quality(spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    share = lambda v: np.mean([got[r["doc_id"]].kept for r in labels if r["quality"] == v])
    assert share(1) > 0.7 and share(0) < 0.1, (share(1), share(0))
    assert sum(r.kept for r in got.values()) == len(got) // 2
    cut = sorted((r.key for r in got.values()), reverse=True)[len(got) // 2 - 1]
    assert all(r.kept == (r.key >= cut) for r in got.values())


@pytest.mark.parametrize("length", [None, 64.0])
def test_quality_equals_brute_force(spark, length):
    import xxhash

    rows = [(r["doc_id"], r["text"]) for r in table("documents", "doc_id", "text")][:120] + [(None, "some words of it"), (3, None), (5, "")]
    good = {r["doc_id"] for r in table("labels") if r["quality"] == 1}
    o = quality.ResampleOptions(buckets=512, length=length)
    m = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m
        return h ^ h >> 31

    def grams(t):
        w = [xxhash.xxh3_64_intdigest(x) for x in (t or "").encode().lower().split()]
        return [x % 512 for x in w] + [mixed((a * 0x9E3779B97F4A7C15 + b) & m) % 512 for a, b in zip(w, w[1:])]

    raw, target = [0] * 512, [0] * 512
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    q = [(r + 1) / (sum(raw) + 512) for r in raw]
    p = [(t + 512 * x) / (sum(target) + 512) for t, x in zip(target, q)]
    want = {}
    for i, t in rows:
        r = [np.log(p[g]) - np.log(q[g]) for g in grams(t)]
        w = (sum(r) if length is None else length * sum(r) / len(r)) if r else 0.0
        u = mixed((mixed(((-1 if i is None else i) + 3 * 0x9E3779B97F4A7C15) & m) + (i is None)) & m)
        want.setdefault(i, []).append((w, w - np.log(-np.log(((u >> 11) + 0.5) / (1 << 53)))))
    got = quality.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(i,) for i in good], "doc_id long"), o).collect()
    cut = sorted((k for v in want.values() for _, k in v), reverse=True)[len(rows) // 2 - 1]
    assert len(got) == len(rows)
    for r in got:
        w, k = min(want[r.doc_id], key=lambda x: abs(x[1] - r.key))
        assert (r.log_weight, r.key) == pytest.approx((w, k)) and r.kept == (k >= cut - 1e-9)


def test_quality_odd_rows(spark, odd, none):
    good = spark.createDataFrame([(9,), (None,), (11,)], "doc_id long")
    rows = quality.resample(odd, good).collect()
    assert len(rows) == odd.count() and all(r.log_weight == 0 for r in rows if r.doc_id in (1, 2, 3))
    far = quality.resample(odd, good, quality.ResampleOptions(broadcast_ids=0)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, far))
    assert quality.resample(none, good).count() == 0
    assert {r.log_weight for r in quality.resample(odd, good.limit(0)).collect()} == {0.0}
    assert all(r.kept for r in quality.resample(odd, good, quality.ResampleOptions(keep=1.0)).collect())


def test_top_k_cut(spark):
    v = [float(x) for x in np.random.default_rng(1).integers(0, 50, 400)]
    df = spark.createDataFrame([(x,) for x in v], "key double")
    for k in (1, 17, 200, 399):
        assert quality.top_k_cut(df, k) == sorted(v, reverse=True)[k - 1]


# ---- 9 media

def samples():
    import gzip
    import io
    import struct
    import zipfile

    def png():
        part = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\1")) + part(b"IEND", b"")

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9"
    ogg = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"
    flac = b"fLaC\x80\0\0\x22" + b"\1" * 34 + b"\xff\xf8zz"
    mp4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov"
    return {"audio/wav": media.to_wav(b"\1\2\3\4"), "image/png": png(), "application/gzip": gzip.compress(b"x" * 99), "application/zip": z.getvalue(), "image/gif": gif, "application/pdf": pdf, "image/jpeg": jpeg, "audio/ogg": ogg, "audio/flac": flac, "video/mp4": mp4}


def test_sniffing_corrects_types_and_carves(spark):
    good = samples()
    rows = [(k, "text/plain", v) for k, (_, v) in enumerate(good.items())]
    rows += [(100 + k, "image/png", v[:-3] if n != "audio/flac" else v[:20]) for k, (n, v) in enumerate(good.items())]
    wrapped = b"some text " + good["image/png"] + b" and " + good["audio/wav"]
    rows += [(200, "text/html", wrapped), (201, None, None), (202, "text/plain", b"RIFF GIF89a %PDF-1 PK\x03\x04 OggS fLaC ftyp"), (203, None, media.to_wav(good["image/gif"]))]
    got = {r.id: r for r in media.sniffed(spark.createDataFrame(rows, "id long, declared string, bytes binary")).collect()}
    assert [got[k].type for k in range(len(good))] == list(good)
    assert all(got[100 + k].type == "application/octet-stream" for k in range(len(good)))
    assert [(e.type, wrapped[e.start : e.start + e.length]) for e in got[200].embedded] == [("image/png", good["image/png"]), ("audio/wav", good["audio/wav"])]
    assert got[200].type == "text/html" and got[201].type == "application/x-empty" and (got[202].type, got[202].embedded) == ("text/plain", [])
    assert got[203].type == "audio/wav" and [e.type for e in got[203].embedded] == ["image/gif"]


def test_carving_and_long_hostile_values(spark):
    good = samples()
    wrapped = b"some text " + good["image/png"] + b" and " + good["audio/wav"]
    got = {(r.type, r.start): bytes(r.carved) for r in media.carved(spark.createDataFrame([(1, "text/html", wrapped), (2, None, None)], "id long, declared string, bytes binary")).collect()}
    assert got == {("image/png", 10): good["image/png"], ("audio/wav", 15 + len(good["image/png"])): good["audio/wav"]}
    a = media.automaton()
    assert media.sniff(b"%PDF-1" * 300_000, a) == [] == media.sniff(b"PK\x03\x04" * 300_000, a)  # linear: each mark is sought once
    many = b"%PDF-1startxref%%EOF" * 1000
    assert [x[1] for x in media.sniff(many, a)] == list(range(0, len(many), 20))


def test_media_contract(odd, none, odd_rows):
    got = media.stored_as_media(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(odd_rows)
    for i, t in odd_rows:
        raw = (t or "").encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        for r in by[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
            w = media.to_wav(pay)
            assert (r.media_bytes, r.media_sha256) == (len(w), hashlib.sha256(w).hexdigest()) and r.feature.startswith("audio/wav;")
    assert len({r.feature for r in by[12]} | {r.feature for r in by[9]}) == 1
    assert media.stored_as_media(none).count() == 0


# ---- 10 mixing

def test_budgets_go_to_siblings_first(spark):
    o = mixing.MixOptions(share=500, max_epochs=1, domains={"web": 1, "books": 1}, langs={"en": 1, "de": 1}, sources={})
    rows = [(i, "x" * 400, lang, src) for i, (lang, src) in enumerate([("en", "a0")] * 5 + [("en", "b4")] * 95 + [("de", "a0")] * 100 + [("en", "a1")] * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    given = {(r.mix_domain, r.mix_lang, r.mix_source): (r.size, r.given) for r in mixing.budgets(mixing.labelled(df), o).collect()}
    # 40,000 tokens in all, 20,000 to deal: 10,000 to each domain, of web's 5,000 to each language
    assert given == {("web", "en", "a0"): (500, 500), ("web", "en", "b4"): (9500, 4500), ("web", "de", "a0"): (10000, 5000), ("books", "en", "a1"): (20000, 10000)}
    out = mixing.mixed(df, o)
    assert {r.mix_domain: r.t for r in out.groupBy("mix_domain").agg(F.sum("mix_tokens").alias("t")).collect()} == {"web": 10000, "books": 10000}


def test_mixing_repeats_epochs(spark):
    o = mixing.MixOptions(share=1500, max_epochs=2)
    df = spark.createDataFrame([(i, "y" * 40, "en", "src0") for i in range(40)], "doc_id long, text string, lang string, source string")
    n = mixing.mixed(df, o).groupBy("doc_id").count().groupBy("count").count().collect()
    assert {r["count"] for r in n} == {1, 2}
    assert mixing.mixed(df, o).count() == 60


def brute_mixed(rows, o):
    """Tokens and rows that each leaf gives, from its budget and the seeded order, row by row: for one leaf."""
    size = lambda t: max(1, (len((t or "").encode()) + 3) // 4)
    total = sum(size(t) for _, t in rows)
    budget = min(total * o.share // 1000, total * o.max_epochs)
    whole, rest = divmod(budget, total)
    key = lambda r: hashlib.md5(f"{o.seed}:{whole}:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
    out, used = [(r, e) for r in rows for e in range(whole)], 0
    for r in sorted(rows, key=key):
        used += size(r[1])
        if used > rest:
            break
        out.append((r, whole))
    return sorted(map(str, out))


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "plain", "mixed"])
@pytest.mark.parametrize("share", [60, 600, 1500])
def test_mixing_equals_brute_force_and_keeps_its_budget(spark, kind, share):
    rng = random.Random(kind)
    text = lambda k: "t" * rng.randint(0, 90) if kind != "equal rows" else "x" * 40
    ids = {"null ids": lambda k: None, "one id": lambda k: 7, "equal rows": lambda k: 7, "plain": lambda k: k, "mixed": lambda k: (None, 7, k)[k % 3]}[kind]
    rows = [(ids(k), text(k)) for k in range(100)]
    o = mixing.MixOptions(share=share, max_epochs=2)
    df = spark.createDataFrame([(*r, "en", "src0") for r in rows], "doc_id long, text string, lang string, source string").repartition(3)
    got = mixing.mixed(df, o).collect()
    assert sorted(str(((r.doc_id, r.text), r.mix_epoch)) for r in got) == brute_mixed(rows, o)
    assert sum(r.mix_tokens for r in got) <= sum(max(1, (len(t) + 3) // 4) for _, t in rows) * share // 1000


def test_mixing_odd_rows(odd, odd_rows, none):
    got = mixing.mixed(odd).collect()
    count = {}
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert got and set(count) <= {i for i, _ in odd_rows} and max(count.values()) <= 4  # two rows of one id, two epochs
    total = sum(max(1, (len((t or "").encode()) + 3) // 4) for _, t in odd_rows)
    assert sum(r.mix_tokens for r in got) <= total * 600 // 1000
    assert mixing.mixed(none).count() == 0
    plan = mixing.mixed(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
