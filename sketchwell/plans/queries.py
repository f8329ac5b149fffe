"""A query for each operator over the sample tables, and the same in DuckDB SQL.

Sketch keys are l_returnflag or event types; items are part or user ids as strings. Sketches hash with
md5, so that SQL finds the same bits, cells and fingerprints: false positives and collisions must agree too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchwell.operators import bloom, cms, cuckoo, quantiles, scaling, tdigest, topk
from sketchwell.options import BloomOptions, CmsOptions, CuckooOptions, TDigestOptions, TopKOptions
from sketchwell.sources import chunks
from sketchwell.streaming import sketches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(key, seq, item): part ids of line items by return flag."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").cast("string").alias("item"))


PARTS = "p AS (SELECT l_returnflag AS key, l_orderkey * 10 + l_linenumber AS seq, l_partkey::VARCHAR AS item FROM lineitem)"


def asked(spark: SparkSession, d: str, times: int, *keys: str) -> DataFrame:
    """(key, item): customer ids, times a number, asked of each key."""
    ids = table(spark, d, "customer").select((F.col("c_custkey") * times).cast("string").alias("item"))
    return ids.select(F.explode(F.array(*map(F.lit, keys))).alias("key"), "item")


def probes_of(spark: SparkSession, d: str) -> DataFrame:
    """Ids asked of every return flag, and of a filter that doesn't exist."""
    return asked(spark, d, 3, "A", "N", "R", "none")


PROBES = "q AS (SELECT k.key, (c_custkey * 3)::VARCHAR AS item FROM customer CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'none']) AS key) k)"

# ---- Bloom ---------------------------------------------------------------------------------

BLOOM = BloomOptions(error_rate=0.02, capacity=1500, nonscaling=True)
_, _, BITS, HASHES = BLOOM.link()


def _h(item: str) -> str:
    return f"('0x' || substr(md5({item}), 1, 8))::BIGINT AS a, (('0x' || substr(md5({item}), 9, 8))::BIGINT | 1) AS b"


BLOOM_SQL = f"""{PARTS}, d AS (SELECT DISTINCT key, item FROM p),
pos AS (SELECT key, item, (a + i * b) % {BITS} AS pos FROM (SELECT *, {_h('item')} FROM d) CROSS JOIN range({HASHES}) r(i))"""
FOUND_SQL = f"""{BLOOM_SQL}, bits AS (SELECT DISTINCT key, pos FROM pos), {PROBES},
qp AS (SELECT key, item, (a + i * b) % {BITS} AS pos FROM (SELECT *, {_h('item')} FROM q) CROSS JOIN range({HASHES}) r(i)),
found AS (SELECT key, item, bool_and(bits.pos IS NOT NULL) AS found FROM qp LEFT JOIN bits USING (key, pos) GROUP BY key, item)"""
FLAGS_SQL = f"""{PARTS}, e AS (SELECT key, item, min(seq) AS first FROM p GROUP BY ALL),
pos AS (SELECT key, item, first, (a + i * b) % {BITS} AS pos FROM (SELECT *, {_h('item')} FROM e) CROSS JOIN range({HASHES}) r(i)),
o AS (SELECT key, pos, min(first) AS opened FROM pos GROUP BY ALL),
new AS (SELECT DISTINCT key, item, first FROM pos JOIN o USING (key, pos) WHERE first = opened),
flags AS (SELECT p.key, p.seq, p.item, new.item IS NOT NULL AND p.seq = new.first AS added FROM p LEFT JOIN new USING (key, item))"""


def _filters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = parts(spark, d)
    headers = bloom.reserve(items.select("key").distinct(), BLOOM)
    return items, headers, bloom.build(items, headers)


@query("B1_bloom_reserve", f"""WITH k AS (SELECT l_returnflag AS key, count(DISTINCT l_partkey) AS capacity FROM lineitem GROUP BY 1)
SELECT key, capacity::BIGINT AS capacity, greatest(64, ceil(floor(capacity * (-ln(0.005) / (ln(2) * ln(2)))) / 64) * 64)::BIGINT AS bits, ceil(-ln(0.005) / ln(2))::INTEGER AS hashes FROM k""")
def b1(spark, d):
    cap = parts(spark, d).groupBy("key").agg(F.count_distinct("item").alias("n"))
    return bloom.reserve(cap, BloomOptions(error_rate=0.01, capacity=1), F.col("n")).select("key", "capacity", "bits", "hashes")


@query("B2_bloom_add", f"WITH {BLOOM_SQL} SELECT key, pos // {bloom.PAGE} AS page, count(DISTINCT pos)::BIGINT AS ones FROM pos GROUP BY ALL")
def b2(spark, d):
    return _filters(spark, d)[2].select("key", "page", F.bitmap_count("bitmap").alias("ones"))


@query("B3_bloom_madd", f"WITH {FLAGS_SQL} SELECT key, item, count(*) AS asked, sum(added::INT)::BIGINT AS added FROM flags GROUP BY ALL")
def b3(spark, d):
    items, headers, _ = _filters(spark, d)
    return bloom.add_flags(items, headers).groupBy("key", "item").agg(F.count("*").alias("asked"), F.sum(F.col("added").cast("int")).alias("added"))


@query("B4_bloom_insert", f"""WITH {FLAGS_SQL}, h AS (SELECT *, sum(added::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held FROM flags),
c AS (SELECT key, min(seq) FILTER (added AND held > 500) AS cut FROM h GROUP BY key)
SELECT key, count(*) FILTER (added AND (cut IS NULL OR seq < cut)) AS added, count(*) FILTER (NOT added AND (cut IS NULL OR seq < cut)) AS known, count(*) FILTER (seq >= cut) AS refused FROM h JOIN c USING (key) GROUP BY key""")
def b4(spark, d):
    items, headers, _ = _filters(spark, d)
    small = headers.withColumn("capacity", F.lit(500).cast("long"))  # the same bits, refusing new items beyond 500
    flags = bloom.nonscaling_flags(bloom.add_flags(items, headers), small)
    return flags.groupBy("key").agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("known"), F.count_if(F.col("added").isNull()).alias("refused"))


@query("B5_bloom_exists", f"WITH {FOUND_SQL} SELECT item, found FROM found WHERE key = 'A'")
def b5(spark, d):
    _, headers, pages = _filters(spark, d)
    return bloom.exists(probes_of(spark, d).where("key = 'A'"), headers, pages).select("item", "found")


@query("B6_bloom_mexists", f"WITH {FOUND_SQL} SELECT key, item, found FROM found")
def b6(spark, d):
    _, headers, pages = _filters(spark, d)
    return bloom.exists(probes_of(spark, d), headers, pages)


@query("B7_bloom_info", f"WITH {FLAGS_SQL} SELECT key, {BLOOM.capacity}::BIGINT AS capacity, {96 + BITS // 8}::BIGINT AS size, 1 AS filters, sum(added::INT)::BIGINT AS items, 0 AS expansion FROM flags GROUP BY key")
def b7(spark, d):
    items, headers, _ = _filters(spark, d)
    return bloom.info(headers, bloom.cardinality(bloom.add_flags(items, headers))).fillna(0, ["expansion"])


@query("B8_bloom_card", f"WITH {FLAGS_SQL}, f AS (SELECT key, count(DISTINCT pos) AS ones FROM pos GROUP BY key) SELECT key, sum(added::INT)::BIGINT AS items, round(-{BITS}::DOUBLE / {HASHES} * ln(1 - any_value(ones)::DOUBLE / {BITS}), 6) AS estimate FROM flags JOIN f USING (key) GROUP BY key")
def b8(spark, d):
    items, headers, pages = _filters(spark, d)
    return bloom.cardinality(bloom.add_flags(items, headers)).join(bloom.estimated_cardinality(headers, pages), "key").select("key", "items", F.round("estimate", 6).alias("estimate"))


@query("B9_bloom_debug", f"WITH {FLAGS_SQL}, n AS (SELECT key, sum(added::INT)::BIGINT AS items FROM flags GROUP BY key) SELECT key, 'size:' || items AS line FROM n UNION ALL SELECT key, 'bytes:{BITS // 8} bits:{BITS} hashes:{HASHES} capacity:{BLOOM.capacity} size:' || items FROM n")
def b9(spark, d):
    items, headers, _ = _filters(spark, d)
    return bloom.describe(headers, bloom.cardinality(bloom.add_flags(items, headers)))


@query("B10_bloom_scandump", f"WITH {BLOOM_SQL}, pages AS (SELECT DISTINCT key, pos // {bloom.PAGE} AS page FROM pos) SELECT key, (page // {chunks.PAGES} + 1)::BIGINT AS chunk, (count(*) * {8 + chunks.PAGE_BYTES})::BIGINT AS bytes FROM pages GROUP BY ALL")
def b10(spark, d):
    _, headers, pages = _filters(spark, d)
    return chunks.dump_bloom(headers, pages).where("chunk > 0").select("key", "chunk", F.length("data").cast("long").alias("bytes"))


@query("B11_bloom_loadchunk", f"WITH {FOUND_SQL} SELECT key, count(*) AS asked, count(*) FILTER (found) AS found FROM found GROUP BY key")
def b11(spark, d):
    _, headers, pages = _filters(spark, d)
    h, p = chunks.load_bloom(chunks.dump_bloom(headers, pages))
    return bloom.exists(probes_of(spark, d), h, p).groupBy("key").agg(F.count("*").alias("asked"), F.count_if("found").alias("found"))



# ---- cuckoo --------------------------------------------------------------------------------

CUCKOO = CuckooOptions(capacity=2048)
MASK = CUCKOO.buckets - 1


def _place(item: str) -> str:
    return f"(('0x' || substr(md5({item}), 1, 8))::BIGINT % 255 + 1) AS fp, (('0x' || substr(md5({item}), 9, 8))::BIGINT & {MASK}) AS one"


SLOT = f"least(one, xor(one, (fp * {cuckoo.SPREAD}) & {MASK}))"
CUCKOO_SQL = f"{PARTS}, c AS (SELECT key, seq, item, fp, {SLOT} AS slot FROM (SELECT *, {_place('item')} FROM p)), s AS (SELECT key, fp, slot, count(*) AS cnt FROM c GROUP BY ALL)"
ASK_SQL = f"{CUCKOO_SQL}, {PROBES}, a AS (SELECT q.key, q.item, coalesce(s.cnt, 0)::BIGINT AS cnt FROM (SELECT *, {SLOT} AS slot FROM (SELECT *, {_place('item')} FROM q)) q LEFT JOIN s USING (key, fp, slot))"


@query("C1_cuckoo_reserve", f"SELECT n_nationkey::BIGINT + 4 AS capacity, greatest(1, pow(2, ceil(log2((n_nationkey + 4) // 2))))::BIGINT AS buckets FROM nation")
def c1(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 4).alias("capacity"))
    return n.select("capacity", cuckoo.buckets_for(F.col("capacity"), CuckooOptions().bucket_size).alias("buckets"))


@query("C2_cuckoo_add", f"WITH {CUCKOO_SQL} SELECT key, fp::INTEGER AS fp, slot, cnt FROM s")
def c2(spark, d):
    return cuckoo.build(parts(spark, d), CUCKOO)


ADDNX_SQL = f"{CUCKOO_SQL}, f AS (SELECT key, fp, slot, min(seq) AS seq FROM c GROUP BY ALL)"


@query("C3_cuckoo_addnx", f"WITH {ADDNX_SQL} SELECT c.key, c.seq, (f.seq IS NOT NULL)::INT AS added FROM c LEFT JOIN f USING (key, fp, slot, seq)")
def c3(spark, d):
    return cuckoo.add_new(parts(spark, d), CUCKOO).select("key", "seq", "added")


TIGHT = CuckooOptions(capacity=2048, expansion=0)


@query("C4_cuckoo_insert", f"""WITH {CUCKOO_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY key, fp, slot ORDER BY seq, item) <= {2 * TIGHT.bucket_size} AS fits FROM c),
h AS (SELECT *, sum(fits::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held FROM n)
SELECT key, count(*) FILTER (fits AND held <= {TIGHT.buckets * TIGHT.bucket_size}) AS stored, count(*) FILTER (NOT (fits AND held <= {TIGHT.buckets * TIGHT.bucket_size})) AS refused FROM h GROUP BY key""")
def c4(spark, d):
    return cuckoo.insert(parts(spark, d), TIGHT).groupBy("key").agg(F.count_if(F.col("stored") == 1).alias("stored"), F.count_if(F.col("stored") == -1).alias("refused"))


@query("C5_cuckoo_insertnx", f"WITH {CUCKOO_SQL}, {PROBES}, n AS (SELECT DISTINCT q.key, {SLOT} AS slot, fp FROM (SELECT *, {_place('item')} FROM q) q) SELECT n.key, count(*) AS added FROM n LEFT JOIN s USING (key, fp, slot) WHERE s.cnt IS NULL GROUP BY n.key")
def c5(spark, d):
    more = probes_of(spark, d).withColumn("seq", F.col("item").cast("long"))
    return cuckoo.add_new(more, CUCKOO, cuckoo.build(parts(spark, d), CUCKOO)).where("added = 1").groupBy("key").agg(F.count("*").alias("added"))


@query("C6_cuckoo_exists", f"WITH {ASK_SQL} SELECT item, cnt > 0 AS found FROM a WHERE key = 'R'")
def c6(spark, d):
    return cuckoo.exists(probes_of(spark, d).where("key = 'R'"), cuckoo.build(parts(spark, d), CUCKOO), CUCKOO).select("item", "found")


@query("C7_cuckoo_mexists", f"WITH {ASK_SQL} SELECT key, item, cnt > 0 AS found FROM a")
def c7(spark, d):
    return cuckoo.exists(probes_of(spark, d), cuckoo.build(parts(spark, d), CUCKOO), CUCKOO)


@query("C8_cuckoo_count", f"WITH {ASK_SQL} SELECT key, item, cnt FROM a")
def c8(spark, d):
    return cuckoo.count(probes_of(spark, d), cuckoo.build(parts(spark, d), CUCKOO), CUCKOO)


DELETE_SQL = f"{ASK_SQL}, dq AS (SELECT key, item, fp, {SLOT} AS slot, item::BIGINT AS seq FROM (SELECT *, {_place('item')} FROM q)), r AS (SELECT dq.*, coalesce(s.cnt, 0) AS cnt, row_number() OVER (PARTITION BY dq.key, dq.fp, dq.slot ORDER BY dq.seq) AS nth FROM dq LEFT JOIN s USING (key, fp, slot))"


def _deleted(spark, d):
    gone = probes_of(spark, d).withColumn("seq", F.col("item").cast("long"))
    return cuckoo.delete(gone, cuckoo.build(parts(spark, d), CUCKOO), CUCKOO)


@query("C9_cuckoo_del", f"WITH {DELETE_SQL} SELECT key, item, (nth <= cnt)::INT AS removed FROM r")
def c9(spark, d):
    return _deleted(spark, d)[0].select("key", "item", "removed")


LEFT_SQL = f"{DELETE_SQL}, g AS (SELECT key, fp, slot, sum((nth <= cnt)::INT) AS gone FROM r GROUP BY ALL), l AS (SELECT s.key, s.fp, s.slot, s.cnt - coalesce(g.gone, 0) AS cnt FROM s LEFT JOIN g USING (key, fp, slot))"


@query("C10_cuckoo_compact", f"WITH {LEFT_SQL} SELECT key, count(*) AS entries, sum(cnt)::BIGINT AS items FROM l WHERE cnt > 0 GROUP BY key")
def c10(spark, d):
    return cuckoo.compact(_deleted(spark, d)[1]).groupBy("key").agg(F.count("*").alias("entries"), F.sum("cnt").alias("items"))


@query("C11_cuckoo_scandump", f"WITH {CUCKOO_SQL} SELECT key, (slot // {chunks.ENTRIES} + 1)::BIGINT AS chunk, (count(*) * 17)::BIGINT AS bytes FROM s GROUP BY ALL")
def c11(spark, d):
    return chunks.dump_cuckoo(cuckoo.build(parts(spark, d), CUCKOO), CUCKOO.buckets).where("chunk > 0").select("key", "chunk", F.length("data").cast("long").alias("bytes"))


@query("C12_cuckoo_loadchunk", ORACLES["C2_cuckoo_add"])
def c12(spark, d):
    return chunks.load_cuckoo(chunks.dump_cuckoo(cuckoo.build(parts(spark, d), CUCKOO), CUCKOO.buckets))


_SLOTS = CUCKOO.buckets * CUCKOO.bucket_size
FILTERS_SQL = f"ceil(i::DOUBLE / {_SLOTS})::INTEGER"


@query("C13_cuckoo_info", f"WITH {PARTS}, n AS (SELECT key, count(*) AS i FROM p GROUP BY key) SELECT key, ({cuckoo.FILTER_BYTES} + {FILTERS_SQL} * {cuckoo.SUB_BYTES + _SLOTS})::BIGINT AS size, {CUCKOO.buckets}::BIGINT AS buckets, {FILTERS_SQL} AS filters, i::BIGINT AS inserted, 0::BIGINT AS deleted, {CUCKOO.bucket_size} AS bucket_size, {CUCKOO.expansion} AS expansion, {CUCKOO.max_iterations} AS max_iterations FROM n")
def c13(spark, d):
    return cuckoo.info(cuckoo.build(parts(spark, d), CUCKOO), CUCKOO)


@query("C14_cuckoo_debug", f"WITH {PARTS}, n AS (SELECT key, count(*) AS i FROM p GROUP BY key) SELECT key, 'bktsize:{CUCKOO.bucket_size} buckets:{CUCKOO.buckets} items:' || i || ' deletes:0 filters:' || {FILTERS_SQL} || ' max_iterations:{CUCKOO.max_iterations} expansion:{CUCKOO.expansion}' AS line FROM n")
def c14(spark, d):
    return cuckoo.describe(cuckoo.build(parts(spark, d), CUCKOO), CUCKOO)


# ---- count-min -----------------------------------------------------------------------------

CMS = CmsOptions(400, 4)


def weighted(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("key"), F.col("l_partkey").cast("string").alias("item"), F.col("l_quantity").cast("long").alias("inc"))


CELLS_SQL = f"""w AS (SELECT l_linestatus AS key, l_partkey::VARCHAR AS item, sum(l_quantity::BIGINT) AS inc FROM lineitem GROUP BY ALL),
cells AS (SELECT key, r AS row, ('0x' || substr(md5(r || '|' || item), 1, 8))::BIGINT % {CMS.width} AS col, least(sum(inc), 4294967295)::BIGINT AS cnt FROM w CROSS JOIN range({CMS.depth}) t(r) GROUP BY ALL)"""
ESTIMATE_SQL = f"{CELLS_SQL}, e AS (SELECT i.key, i.item, min(coalesce(cells.cnt, 0))::BIGINT AS estimate FROM (SELECT key, item, r AS row, ('0x' || substr(md5(r || '|' || item), 1, 8))::BIGINT % {CMS.width} AS col FROM ASKED CROSS JOIN range({CMS.depth}) t(r)) i LEFT JOIN cells USING (key, row, col) GROUP BY ALL)"


@query("M1_cms_initbydim", "SELECT n_nationkey::BIGINT + 1 AS width, (n_nationkey % 7 + 1)::BIGINT AS depth, ((n_nationkey + 1) * (n_nationkey % 7 + 1))::BIGINT AS cells FROM nation")
def m1(spark, d):
    n = F.col("n_nationkey").cast("long")
    return cms.shapes(table(spark, d, "nation").select((n + 1).alias("width"), (n % 7 + 1).alias("depth"))).withColumn("cells", F.col("width") * F.col("depth"))


@query("M2_cms_initbyprob", "SELECT n_nationkey::BIGINT AS id, ceil(2 / (0.5 / pow(2, n_nationkey % 9 + 1)))::BIGINT AS width, ceil(log10(1.0 / (n_nationkey + 3)) / log10(0.5))::BIGINT AS depth FROM nation")
def m2(spark, d):
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, d, "nation").select(n.alias("id"), (0.5 / F.pow(F.lit(2.0), n % 9 + 1)).alias("error"), (1.0 / (n + 3)).alias("probability"))
    return cms.shapes_by_probability(rows).select("id", "width", "depth")


@query("M3_cms_incrby", f"WITH {ESTIMATE_SQL.replace('ASKED', '(SELECT DISTINCT key, item FROM w)')} SELECT key, item, estimate, estimate >= 4294967295 AS saturated FROM e")
def m3(spark, d):
    items = weighted(spark, d)
    half = items.where(F.crc32(F.col("item").cast("binary")) % 2 == 0)
    rest = items.where(F.crc32(F.col("item").cast("binary")) % 2 == 1)
    total, _ = cms.increment(rest, cms.build(half, CMS), CMS)
    return cms.query(items, total, CMS)


ASKED_SQL = "(SELECT key, (c_custkey * 3)::VARCHAR AS item FROM customer CROSS JOIN (SELECT unnest(['F', 'O']) AS key) k)"


@query("M4_cms_query", f"WITH {ESTIMATE_SQL.replace('ASKED', ASKED_SQL)} SELECT key, item, estimate FROM e")
def m4(spark, d):
    items = weighted(spark, d)
    return cms.query(asked(spark, d, 3, "F", "O"), cms.build(items, CMS), CMS).select("key", "item", "estimate")


@query("M5_cms_merge", f"WITH {CELLS_SQL} SELECT 'all' AS key, row, col, sum(cnt * CASE key WHEN 'F' THEN 3 ELSE 1 END)::BIGINT AS cnt FROM cells GROUP BY ALL")
def m5(spark, d):
    cells = cms.build(weighted(spark, d), CMS)
    one = cells.where("key = 'F'").withColumn("key", F.lit("all"))
    two = cells.where("key <> 'F'").withColumn("key", F.lit("all"))
    return cms.merge([(one, 2), (two, 1), (one, 1)])


@query("M6_cms_info", f"WITH {CELLS_SQL} SELECT key, {CMS.width}::BIGINT AS width, {CMS.depth}::BIGINT AS depth, sum(inc)::BIGINT AS count, {4 * CMS.width * CMS.depth + 32}::BIGINT AS bytes FROM w GROUP BY key")
def m6(spark, d):
    h = cms.header(weighted(spark, d), CMS)
    return h.join(cms.memory(h), "key")


# ---- top-k ---------------------------------------------------------------------------------

#: The event types of the sample tables.
KINDS = ("click", "error", "purchase", "signup", "view")
TOPK = TopKOptions(k=10, width=2000, depth=4, decay=1.0)


def users(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("item"), F.lit(1).alias("inc"), (F.col("event_id") % 2).alias("batch"))


COUNTS_SQL = "n AS (SELECT event_type AS key, user_id::VARCHAR AS item, count(*) AS cnt FROM events GROUP BY ALL)"
TOP_SQL = f"{COUNTS_SQL}, t AS (SELECT * FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, item)::INTEGER AS rank, item, cnt::BIGINT AS cnt FROM n) WHERE rank <= {TOPK.k})"


@query("T1_topk_reserve", f"SELECT event_type AS key, {TOPK.k} AS k, {TOPK.width} AS width, {TOPK.depth} AS depth, {TOPK.decay}::DOUBLE AS decay FROM events GROUP BY 1")
def t1(spark, d):
    return users(spark, d).select("key").distinct().select("key", F.lit(TOPK.k).alias("k"), F.lit(TOPK.width).alias("width"), F.lit(TOPK.depth).alias("depth"), F.lit(TOPK.decay).alias("decay"))


@query("T2_topk_add", f"""WITH b AS (SELECT event_type AS key, user_id::VARCHAR AS item, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS early FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (early > 0) DESC, early DESC, item) AS a, row_number() OVER (PARTITION BY key ORDER BY n DESC, item) AS z FROM b)
SELECT key, item, early::BIGINT AS before, n::BIGINT AS after FROM r WHERE a <= {TOPK.k} AND early > 0 AND z > {TOPK.k}""")
def t2(spark, d):
    return topk.expelled(users(spark, d), TOPK.k)


@query("T3_topk_incrby", f"WITH n AS (SELECT l_linestatus AS key, l_partkey::VARCHAR AS item, sum(l_quantity::BIGINT)::BIGINT AS cnt FROM lineitem GROUP BY ALL) SELECT * FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, item)::INTEGER AS rank, item, cnt FROM n) WHERE rank <= 25")
def t3(spark, d):
    return topk.top(topk.counts(weighted(spark, d)), 25)


@query("T4_topk_query", f"WITH {TOP_SQL} SELECT n.key, n.item, t.item IS NOT NULL AS listed FROM n LEFT JOIN t USING (key, item)")
def t4(spark, d):
    c = topk.counts(users(spark, d))
    return topk.contains(c.select("key", "item"), topk.top(c, TOPK.k))


@query("T5_topk_count", f"WITH {COUNTS_SQL} SELECT k.key, c_custkey::VARCHAR AS item, coalesce(n.cnt, 0)::BIGINT AS cnt FROM customer CROSS JOIN (SELECT unnest({list(KINDS)}) AS key) k LEFT JOIN n ON n.key = k.key AND n.item = c_custkey::VARCHAR")
def t5(spark, d):
    c = topk.counts(users(spark, d))
    return topk.count_of(asked(spark, d, 1, *KINDS), c)


@query("T6_topk_list", f"WITH {TOP_SQL} SELECT key, rank, item, cnt FROM t")
def t6(spark, d):
    return topk.top(topk.counts(users(spark, d)), TOPK.k)


@query("T7_topk_info", f"WITH {TOP_SQL} SELECT key, {TOPK.k} AS k, {TOPK.width}::BIGINT AS width, {TOPK.depth}::BIGINT AS depth, {TOPK.decay}::DOUBLE AS decay, count(*) AS listed, sum(cnt)::BIGINT AS held, ({16 * TOPK.width * TOPK.depth} + sum(24 + strlen(item)))::BIGINT AS bytes FROM t GROUP BY key")
def t7(spark, d):
    return topk.info(topk.top(topk.counts(users(spark, d)), TOPK.k), TOPK)


# ---- quantiles -----------------------------------------------------------------------------

QS, XS, RANKS = [0.99, 0.0, 0.5, 0.01, 1.0, 0.25], [1.0, 50.0, 77.31, 250.5, -3.0, 1e6], [0, 1, 17, 100, 10**9]


def values(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").alias("v"))


STEPS_SQL = "c AS (SELECT event_type AS key, value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY key ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(n) OVER (PARTITION BY key)::BIGINT AS total FROM c)"
BELOW_SQL = f"b AS (SELECT event_type AS key, x, count(*) FILTER (value < x) AS below, count(*) FILTER (value = x) AS same, count(*) AS total, min(value) AS low, max(value) AS high FROM events CROSS JOIN (SELECT unnest({XS})::DOUBLE AS x) GROUP BY ALL)"
DIGEST_SQL = "SELECT event_type AS key, count(*) AS n, min(value) AS low, max(value) AS high"


def _within(spark, d, digests):
    """Whether each estimated median and upper quantile has a rank within 2 % of what it should."""
    got = tdigest.evaluate(digests, qs=[0.5, 0.95])
    joined = values(spark, d).join(F.broadcast(got), "key")
    rank = joined.groupBy("key", "n", "low", "high").agg(F.avg((F.col("v") <= F.col("quantiles")[0]).cast("int")).alias("r0"), F.avg((F.col("v") <= F.col("quantiles")[1]).cast("int")).alias("r1"))
    return rank.select("key", "n", "low", "high", ((F.abs(F.col("r0") - 0.5) < 0.02) & (F.abs(F.col("r1") - 0.95) < 0.02)).alias("close"))


@query("D1_tdigest_create", "SELECT event_type AS key, 100 AS compression, 610 AS capacity FROM events GROUP BY 1")
def d1(spark, d):
    o = TDigestOptions()
    return values(spark, d).select("key").distinct().select("key", F.lit(o.compression).alias("compression"), F.lit(o.capacity).alias("capacity"))


@query("D2_tdigest_reset", "SELECT event_type AS key, 100 AS compression, 0::BIGINT AS n FROM events GROUP BY 1")
def d2(spark, d):
    return tdigest.reset(tdigest.build(values(spark, d))).select("key", "compression", "n")


@query("D3_tdigest_add", f"{DIGEST_SQL}, true AS close FROM events GROUP BY 1")
def d3(spark, d):
    return _within(spark, d, tdigest.build(values(spark, d)))


@query("D4_tdigest_merge", f"{DIGEST_SQL}, true AS close FROM events GROUP BY 1")
def d4(spark, d):
    v = values(spark, d)
    return _within(spark, d, tdigest.merge([tdigest.build(v.where("v < 60")), tdigest.build(v.where("v >= 60"), TDigestOptions(200))]))


@query("D5_tdigest_min", "SELECT event_type AS key, min(value) AS low FROM events GROUP BY 1")
def d5(spark, d):
    return quantiles.extremes(values(spark, d)).select("key", "low")


@query("D6_tdigest_max", "SELECT event_type AS key, max(value) AS high FROM events GROUP BY 1")
def d6(spark, d):
    return quantiles.extremes(values(spark, d)).select("key", "high")


@query("D7_tdigest_quantile", f"WITH {STEPS_SQL} SELECT key, q, min(v) FILTER (before + n >= greatest(ceil(q * total), 1)) AS v FROM s CROSS JOIN (SELECT unnest({QS})::DOUBLE AS q) GROUP BY key, q")
def d7(spark, d):
    return quantiles.quantile(quantiles.stepped(values(spark, d)), QS)


@query("D8_tdigest_byrank", f"WITH {STEPS_SQL} SELECT key, r, coalesce(max(v) FILTER (r >= before AND r < before + n), 'inf'::DOUBLE) AS v FROM s CROSS JOIN (SELECT unnest({RANKS})::BIGINT AS r) GROUP BY key, r")
def d8(spark, d):
    return quantiles.by_rank(quantiles.stepped(values(spark, d)), RANKS)


@query("D9_tdigest_byrevrank", f"WITH {STEPS_SQL} SELECT key, r, coalesce(max(v) FILTER (total - 1 - r >= before AND total - 1 - r < before + n), '-inf'::DOUBLE) AS v FROM s CROSS JOIN (SELECT unnest({RANKS})::BIGINT AS r) GROUP BY key, r")
def d9(spark, d):
    return quantiles.by_rank(quantiles.stepped(values(spark, d)), RANKS, reverse=True)


@query("D10_tdigest_rank", f"WITH {BELOW_SQL} SELECT key, x, CASE WHEN x < low THEN -1 WHEN x > high THEN total ELSE ceil(below + same / 2.0 - 0.5) END::BIGINT AS rank FROM b")
def d10(spark, d):
    return quantiles.rank(values(spark, d), XS)


@query("D11_tdigest_revrank", f"WITH {BELOW_SQL} SELECT key, x, CASE WHEN x < low THEN total WHEN x > high THEN -1 ELSE total - floor(below + same / 2.0 + 0.5) END::BIGINT AS rank FROM b")
def d11(spark, d):
    return quantiles.rank(values(spark, d), XS, reverse=True)


@query("D12_tdigest_cdf", f"WITH {BELOW_SQL} SELECT key, x, (2 * below + same) / (2 * total)::DOUBLE AS cdf FROM b")
def d12(spark, d):
    return quantiles.cdf(values(spark, d), XS)


@query("D13_tdigest_trimmed_mean", f"WITH o AS (SELECT event_type AS key, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT key, round(avg(v), 6) AS mean FROM o WHERE i >= floor(n * 0.1::DOUBLE) AND i < ceil(n * 0.9::DOUBLE) GROUP BY key")
def d13(spark, d):
    return quantiles.trimmed_mean(quantiles.stepped(values(spark, d)), 0.1, 0.9).select("key", F.round("mean", 6).alias("mean"))


@query("D14_tdigest_info", "SELECT event_type AS key, 100 AS compression, 610 AS capacity, count(*) AS observations, 9840::BIGINT AS bytes, true AS fits, true AS adds_up FROM events GROUP BY 1")
def d14(spark, d):
    i = tdigest.info(tdigest.build(values(spark, d)))
    return i.select("key", "compression", "capacity", "observations", "bytes", (F.col("nodes") <= F.col("capacity")).alias("fits"), (F.col("merged_weight") + F.col("unmerged_weight") == F.col("observations")).alias("adds_up"))


#: What a digest answers, against the exact answers: each within 2 % of the ranks (of the values, for means).
PROBES_Q, PROBES_X, PROBES_R = [0.01, 0.25, 0.5, 0.9, 0.99], [1.0, 50.0, 77.31, 250.5], [0, 17, 100, 10**9]
CLOSE_SQL = "SELECT event_type AS key, p, true AS close FROM events CROSS JOIN (SELECT unnest({})::DOUBLE AS p) GROUP BY ALL"


def _answers(spark, d, asked: list, column: str, **how) -> DataFrame:
    """(key, p, n, got): an answer of the digests for each p."""
    got = tdigest.evaluate(tdigest.build(values(spark, d)), **how)
    pairs = F.arrays_zip(F.array(*(F.lit(float(x)) for x in asked)).alias("p"), F.col(column).cast("array<double>").alias("got"))
    return got.select("key", "n", F.explode(pairs).alias("x")).select("key", F.col("x.p").alias("p"), "n", F.col("x.got").alias("got"))


def _ranked(spark, d, answers: DataFrame, want) -> DataFrame:
    """(key, p, close): whether the share of values up to the answer, or that up to the next, reaches what it should."""
    v = values(spark, d).join(F.broadcast(answers), "key").groupBy("key", "p", "n", "got")
    share = v.agg(F.avg((F.col("v") < F.col("got")).cast("int")).alias("under"), F.avg((F.col("v") <= F.col("got")).cast("int")).alias("upto"))
    return share.select("key", "p", ((F.col("under") <= want + 0.02) & (F.col("upto") >= want - 0.02)).alias("close"))


@query("D7_digest_quantile", CLOSE_SQL.format(PROBES_Q))
def d7_digest(spark, d):
    return _ranked(spark, d, _answers(spark, d, PROBES_Q, "quantiles", qs=PROBES_Q), F.col("p"))


@query("D8_digest_byrank", CLOSE_SQL.format(PROBES_R))
def d8_digest(spark, d):
    return _ranked(spark, d, _answers(spark, d, PROBES_R, "byranks", ranks=PROBES_R), F.least(F.lit(1.0), F.col("p") / F.col("n")))


@query("D9_digest_byrevrank", CLOSE_SQL.format(PROBES_R))
def d9_digest(spark, d):
    return _ranked(spark, d, _answers(spark, d, PROBES_R, "byrevranks", ranks=PROBES_R), F.greatest(F.lit(0.0), 1 - F.col("p") / F.col("n")))


def _near_exact(spark, d, column: str, exact: DataFrame, name: str, size) -> DataFrame:
    got = _answers(spark, d, PROBES_X, column, xs=PROBES_X)
    return got.join(exact.withColumnRenamed("x", "p"), ["key", "p"]).select("key", "p", (F.abs(F.col("got") - F.col(name)) <= 0.02 * size).alias("close"))


@query("D10_digest_rank", CLOSE_SQL.format(PROBES_X))
def d10_digest(spark, d):
    return _near_exact(spark, d, "ranks", quantiles.rank(values(spark, d), PROBES_X), "rank", F.col("n"))


@query("D11_digest_revrank", CLOSE_SQL.format(PROBES_X))
def d11_digest(spark, d):
    return _near_exact(spark, d, "revranks", quantiles.rank(values(spark, d), PROBES_X, reverse=True), "rank", F.col("n"))


@query("D12_digest_cdf", CLOSE_SQL.format(PROBES_X))
def d12_digest(spark, d):
    return _near_exact(spark, d, "cdfs", quantiles.cdf(values(spark, d), PROBES_X), "cdf", F.lit(1.0))


@query("D13_digest_trimmed_mean", "SELECT event_type AS key, true AS close FROM events GROUP BY 1")
def d13_digest(spark, d):
    got = tdigest.evaluate(tdigest.build(values(spark, d)), trims=[(0.1, 0.9)]).select("key", F.col("trimmed_means")[0].alias("got"))
    exact = quantiles.trimmed_mean(quantiles.stepped(values(spark, d)), 0.1, 0.9)
    return got.join(exact, "key").select("key", (F.abs(F.col("got") - F.col("mean")) <= 0.02 * F.col("mean")).alias("close"))


# ---- forms that depend on the order of arrival: a fold of one key by seq, beyond SQL ----------

@query("B2_bloom_chain")
def chain_links(spark, d):
    """Links of growing filters with what each holds."""
    return scaling.links(parts(spark, d), BloomOptions(error_rate=0.01, capacity=100))


@query("B7_bloom_chain_info")
def chain_info(spark, d):
    """Capacity, size in bytes, links and items of growing filters."""
    x = scaling.links(parts(spark, d), BloomOptions(error_rate=0.01, capacity=100))
    size = F.lit(bloom.CHAIN_BYTES) + F.sum(bloom.LINK_BYTES + F.col("bits") / 8)
    return x.groupBy("key").agg(F.sum("capacity").alias("capacity"), size.cast("long").alias("size"), F.count("*").alias("filters"), F.sum("size").alias("items"), F.lit(2).alias("expansion"))


@query("C4_cuckoo_packed_insert")
def packed_insert(spark, d):
    """What a packed filter that may not expand stores and refuses."""
    got = cuckoo.packed_flags(parts(spark, d), TIGHT)
    return got.groupBy("key").agg(F.count_if(F.col("stored") == 1).alias("stored"), F.count_if(F.col("stored") == -1).alias("refused"))


@query("C13_cuckoo_packed_info")
def packed_info(spark, d):
    """Sub-filters of packed filters that expand."""
    return cuckoo.packed_sizes(parts(spark, d), CuckooOptions(capacity=512, expansion=2))


@query("T2_topk_decaying")
def decaying(spark, d):
    """The list that decaying counters keep."""
    return topk.sequential(users(spark, d), TopKOptions(k=10, width=200, depth=5, decay=0.9))


# ---- streams -------------------------------------------------------------------------------

def arriving(spark, d):
    e = sketches.read_stream(spark, f"{d}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("item"), F.lit(1).alias("inc"))


@query("S1_stream_growing_cms", f"SELECT event_type AS key, r AS row, ('0x' || substr(md5(r || '|' || user_id::VARCHAR), 1, 8))::BIGINT % {CMS.width} AS col, count(*) AS cnt FROM events CROSS JOIN range({CMS.depth}) t(r) WHERE user_id IS NOT NULL GROUP BY ALL")
def s1(spark, d):
    at = sketches.scratch(spark, "growing")
    q = sketches.merged_batches(arriving(spark, d), f"{at}/sketch", f"{at}/progress", lambda b: cms.build(b, CMS), lambda old, new: cms.merge([(old, 1), (new, 1)], saturate=True))
    q.awaitTermination()
    return spark.read.parquet(f"{at}/sketch/v{(q.lastProgress or {'batchId': 0})['batchId'] + 1}")


@query("S2_stream_windowed_counts", "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS done FROM events) SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS key, user_id::VARCHAR AS item, count(*) AS cnt FROM events, m WHERE user_id IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= done GROUP BY ALL")
def s2(spark, d):
    at = sketches.scratch(spark, "windows")
    got = sketches.run_to_end(sketches.windowed_counts(arriving(spark, d), late="1 hour"), f"{at}/out", f"{at}/progress")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))
