"""Mixing sources to target weights: budgets down a tree domain - language - source, then token prefixes.

Every leaf can give max_epochs times its tokens; a node can give what its leaves can. From the root
down, a node's budget is dealt to its children by weight; a child that can give less than its share
gives all, and its shortage goes to its siblings by their weights (water filling). As no node is given
more than its leaves hold, a shortage is met by siblings before it reaches an ancestor's siblings.

A leaf with budget b and s tokens yields b div s whole epochs; of the next, a prefix of its seeded
order with at most b mod s tokens. Orders come from md5(seed:epoch:doc_id:md5(text)), so a leaf of any size is
cut by sums over 4096 key ranges and one window over the keys of the range that holds the cut. Rows with one key are
counted before that; where the cut falls among them, as many are taken as fit.

Nulls in text are empty texts of one token; in lang or source a group of their own, "(none)". Repeated and null
ids are rows like others: those of other texts have keys of their own, rows equal in id and text are
interchangeable, and no leaf ever gives more than its budget. Empty input: no rows. Budgets are
floored: at most one token per child is lost. Columns named mix_* are replaced, other extra columns kept as they are.
Only DataFrame functions; no Python on executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchwell.llm.common import stored


@dataclass(frozen=True)
class MixOptions:
    """Integer weights; names that aren't listed have weight 1. share is the budget in parts of 1000 of all tokens."""

    share: int = 600
    max_epochs: int = 2
    seed: int = 11
    domains: dict = field(default_factory=lambda: {"web": 4, "books": 3, "code": 2, "wiki": 1})
    langs: dict = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    sources: dict = field(default_factory=dict)


LEVELS = ("mix_domain", "mix_lang", "mix_source")


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number its name ends in."""
    n = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    names = F.array(*(F.lit(x) for x in ("web", "books", "code", "wiki")))
    return F.when(n != "", F.get(names, F.pmod(n.cast("int"), F.lit(4)))).otherwise("other")


def labelled(docs: DataFrame) -> DataFrame:
    """docs with the three levels and each text's tokens (4 bytes each, one at least)."""
    src = F.coalesce(F.col("source"), F.lit("(none)"))
    return docs.withColumns({
        "mix_domain": domain_of(src), "mix_lang": F.coalesce(F.col("lang"), F.lit("(none)")), "mix_source": src,
        "mix_tokens": F.greatest(F.expr("(coalesce(octet_length(text), 0) + 3) div 4").cast("long"), F.lit(1).cast("long")),
    })


def _weight(name: str, weights: dict) -> Column:
    known = [F.when(F.col(name) == k, F.lit(int(v))) for k, v in sorted(weights.items())]
    return F.coalesce(*known, F.lit(1)).cast("decimal(38,0)")


def deal(children: DataFrame, parents: list[str], child: str, weights: dict) -> DataFrame:
    """children(parents, child, cap, budget of the parent) with the budget each child gets."""
    w = children.withColumn("w", _weight(child, weights)).withColumns({"cap": F.col("cap").cast("decimal(38,0)"), "budget": F.col("budget").cast("decimal(38,0)")})
    key = [F.col("cap").cast("double") / F.col("w").cast("double"), F.col(child)]
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    upto, rest = by.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1), by.orderBy(*key).rowsBetween(0, Window.unboundedFollowing)
    d = "decimal(38,0)"
    w = w.withColumns({"gone": F.coalesce(F.sum("cap").over(upto), F.lit(0)).cast(d), "left": F.sum("w").over(rest).cast(d)})
    w = w.withColumn("full", F.expr("cap * left <= w * (budget - gone)"))
    w = w.withColumns({"taken": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)).cast(d), "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(by).cast(d)})
    got = F.when(F.col("full"), F.col("cap").cast("long")).otherwise(F.expr("(w * (budget - taken)) div open"))
    return w.select(*parents, child, got.cast("long").alias("given"))


def budgets(rows: DataFrame, o: MixOptions) -> DataFrame:
    """(levels, size, given): the tokens of each leaf and its budget. rows: labelled."""
    size = stored(rows.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("size")), "leaves")
    cap = size.withColumn("cap", F.col("size") * o.max_epochs)
    total = cap.agg(F.expr(f"coalesce(sum(cast(size as decimal(38,0))) * {int(o.share)} div 1000, 0)")).first()[0]
    nodes, above = None, []
    for depth, (level, weights) in enumerate(zip(LEVELS, (o.domains, o.langs, o.sources))):
        own = cap.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap"))
        held = own.join(nodes, above) if above else own.withColumn("budget", F.lit(total))
        nodes = deal(held, above, level, weights).withColumnRenamed("given", "budget")
        above = list(LEVELS[: depth + 1])
    return size.join(nodes, list(LEVELS)).withColumnRenamed("budget", "given")


def mixed(docs: DataFrame, o: MixOptions | None = None) -> DataFrame:
    """docs with columns mix_*: a row for each time a document is chosen, mix_epoch counts from 0."""
    o = o or MixOptions()
    rows = labelled(docs)
    leaf = budgets(rows, o).select(*LEVELS, F.expr("given div size").alias("mix_whole"), F.expr("given % size").alias("mix_rest"))
    leaf = stored(leaf, "budgets")
    name = F.concat_ws(":", F.lit(str(o.seed)), F.col("mix_whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    keyed = rows.join(leaf, list(LEVELS)).withColumn("mix_key", F.md5(name.cast("binary"))).withColumn("mix_range", F.substring("mix_key", 1, 3))
    ranges = keyed.groupBy(*LEVELS, "mix_range", "mix_rest").agg(F.sum("mix_tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, 0)  # 4096 rows at most
    ends = ranges.withColumn("upto", F.sum("t").over(run))
    cut = stored(ends.where("upto > mix_rest and upto - t <= mix_rest").select(*LEVELS, "mix_range", (F.col("mix_rest") - (F.col("upto") - F.col("t"))).alias("room")), "cuts")
    inside = keyed.join(F.broadcast(cut) if cut.count() <= 10_000 else cut, [*LEVELS, "mix_range"])
    same = inside.groupBy(*LEVELS, "mix_range", "room", "mix_key").agg(F.first("mix_tokens").alias("t"), F.count("*").alias("n"))  # equal texts, equal tokens
    upto = F.sum(F.col("t") * F.col("n")).over(Window.partitionBy(*LEVELS).orderBy("mix_key").rowsBetween(Window.unboundedPreceding, 0))
    same = same.withColumn("before", upto - F.col("t") * F.col("n")).withColumn("fits", F.least(F.col("n"), F.expr("(room - before) div t")))
    last = same.where("before <= room").groupBy(*LEVELS).agg(F.max(F.struct("mix_key", "fits", "n")).alias("at"))
    last = last.select(*LEVELS, F.col("at.mix_key").alias("mix_last"), F.col("at.fits").alias("mix_fits"), F.col("at.n").alias("mix_n"))
    cut = stored(leaf.join(cut.drop("room"), list(LEVELS), "left").join(last, list(LEVELS), "left").withColumnRenamed("mix_range", "mix_cut"), "cuts")
    chosen = rows.join(cut, list(LEVELS)).withColumn("mix_key", F.md5(name.cast("binary")))
    at = F.substring("mix_key", 1, 3)
    whole = (F.col("mix_key") < F.col("mix_last")) | ((F.col("mix_key") == F.col("mix_last")) & (F.col("mix_fits") == F.col("mix_n")))
    first = F.when(F.col("mix_cut").isNull(), F.lit(False)).otherwise((at < F.col("mix_cut")) | F.coalesce((at == F.col("mix_cut")) & whole, F.lit(False)))
    more = F.when(first & (F.col("mix_rest") > 0), 1).otherwise(0)
    if cut.where("mix_fits > 0 and mix_fits < mix_n").limit(1).count():  # some of equal rows: only these are numbered
        some = F.coalesce((F.col("mix_key") == F.col("mix_last")) & (F.col("mix_fits") > 0) & (F.col("mix_fits") < F.col("mix_n")), F.lit(False))
        nth = F.row_number().over(Window.partitionBy(*LEVELS).orderBy("mix_key"))
        rest = chosen.where(~some).withColumn("mix_more", more)
        chosen = rest.unionByName(chosen.where(some).withColumn("mix_more", F.when(nth <= F.col("mix_fits"), 1).otherwise(0)))
    else:
        chosen = chosen.withColumn("mix_more", more)
    out = chosen.withColumn("mix_times", F.col("mix_whole").cast("int") + F.col("mix_more")).where("mix_times > 0")
    return out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1))).drop("mix_whole", "mix_rest", "mix_cut", "mix_last", "mix_fits", "mix_n", "mix_key", "mix_more", "mix_times")


def oracle(o: MixOptions | None = None) -> str:
    """The same in DuckDB SQL: (doc_id, mix_domain, mix_lang, mix_source, mix_tokens, mix_epoch)."""
    o = o or MixOptions()

    def weight(name: str, weights: dict) -> str:
        return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {int(v)}" for k, v in sorted(weights.items())) + " ELSE 1 END" if weights else "1"

    parts = [f"""r AS (SELECT doc_id, coalesce(source, '(none)') AS mix_source, coalesce(lang, '(none)') AS mix_lang, text,
  CASE WHEN regexp_extract(coalesce(source, '(none)'), '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE ['web', 'books', 'code', 'wiki'][1 + CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4] END AS mix_domain,
  greatest(1, (coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS mix_tokens FROM documents)""",
        f"leaf AS (SELECT mix_domain, mix_lang, mix_source, sum(mix_tokens)::HUGEINT AS size, sum(mix_tokens)::HUGEINT * {o.max_epochs} AS cap FROM r GROUP BY ALL)",
        f"b0 AS (SELECT sum(size)::HUGEINT * {o.share} // 1000 AS budget FROM leaf)"]
    above: list[str] = []
    for depth, (level, weights) in enumerate(zip(LEVELS, (o.domains, o.langs, o.sources))):
        keys = ", ".join(LEVELS[: depth + 1])
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        join = f"JOIN b{depth} USING ({', '.join(above)})" if above else "CROSS JOIN b0"
        parts += [
            f"n{depth} AS (SELECT {keys}, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL)",
            f"w{depth} AS (SELECT *, ({weight(level, weights)})::HUGEINT AS w FROM n{depth} {join})",
            f"o{depth} AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS gone, sum(w) OVER ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS lef FROM w{depth})",
            f"f{depth} AS (SELECT *, cap * lef <= w * (budget - gone) AS full_ FROM o{depth})",
            f"s{depth} AS (SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({part}), 0)::HUGEINT AS taken, sum(CASE WHEN NOT full_ THEN w END) OVER ({part})::HUGEINT AS open_ FROM f{depth})",
            f"b{depth + 1} AS (SELECT {keys}, CASE WHEN full_ THEN cap ELSE (w * (budget - taken)) // open_ END AS budget FROM s{depth})",
        ]
        above = list(LEVELS[: depth + 1])
    keys = ", ".join(LEVELS)
    parts += [
        f"k AS (SELECT r.*, (b3.budget // leaf.size)::BIGINT AS whole_, (b3.budget % leaf.size)::BIGINT AS rest, md5('{o.seed}:' || (b3.budget // leaf.size)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key_ FROM r JOIN leaf USING ({keys}) JOIN b3 USING ({keys}))",
        f"c AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY {keys} ORDER BY key_ ROWS UNBOUNDED PRECEDING) AS upto FROM k)",
        "t AS (SELECT *, whole_ + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM c)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {keys}, mix_tokens, e::INTEGER AS mix_epoch FROM (SELECT *, unnest(range(times)) AS e FROM t)"
