"""Mixing sources to target weights by hierarchical budgets over domain, language and source.

A node's budget is dealt to its children by weight, but no child gets more than its subtree can give
(max_epochs times its tokens); what a child cannot take goes to its siblings by weight, so shortages
are met among siblings first and reach other branches only through the parent, whose own capacity is
the sum of its children's. With r = capacity / weight the level where budgets meet is found from
running sums in order of r: a window over the children of one node.

Each leaf then takes whole seeded epochs of its documents and, of one more, the prefix in seeded order
(md5 of seed, epoch, doc_id and text) that fits its rest: the first documents whose running sum of
tokens stays within it. The order's first two digits give each document one of 256 cells of its leaf;
sums per cell find the one where the prefix ends, the next two digits do so within that cell, and only
the 1 / 65,536 of the leaf that is left is ranked: no task sorts a leaf, whatever its share.

Defined results: null or empty text has no tokens and is taken whenever its place in the order is
within the prefix, and with every whole epoch; a leaf without tokens is taken whole, once. Null languages or
sources are a node of their own ("?"). Rows that repeat are ordered by text, equal rows share one place
and are taken or left together. Other columns are kept, except in the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trowel.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ["domain", "language", "source"]


def source_domain(source: Column, domains: int = 4) -> Column:
    """A stand-in for a table of domains: the sources' names dealt to a few groups."""
    return F.concat(F.lit("domain"), F.conv(F.substring(F.md5(F.coalesce(source, F.lit("?"))), 1, 2), 16, 10).cast("long") % domains)


def water_level(nodes: DataFrame, parents: list[str], budget: str) -> DataFrame:
    """nodes(parents..., weight, capacity, budget of the parent) with share: what each gets of it."""
    ratio = F.col("capacity") / F.col("weight")
    group = Window.partitionBy(*parents)
    order = group.orderBy("ratio", "name")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = nodes.withColumn("ratio", ratio).withColumn("caps", F.sum("capacity").over(run)).withColumn("rest", F.sum("weight").over(ahead))
    # the level if this node and all after it are below their capacity
    level = (F.col(budget) - (F.col("caps") - F.col("capacity"))) / F.col("rest")
    full = F.col("ratio") * F.col("rest") + (F.col("caps") - F.col("capacity")) <= F.col(budget)
    ranked = ranked.withColumn("level", F.max(F.when(~full, level)).over(group))
    return ranked.withColumn("share", F.when(F.col("level").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity").cast("double"), F.col("weight") * F.col("level")))).drop("ratio", "caps", "rest", "level")


def leaf_budgets(leaves: DataFrame, ratio: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves(domain, language, source, tokens) with budget, whole tokens. ratio: of all tokens, how many are wanted.

    weights: for each level, weights of names; 1 for names that are not given.
    """

    def weight(level: str) -> Column:
        given = weights.get(level, {})
        return reduce(lambda c, kv: F.when(F.col("name") == kv[0], F.lit(float(kv[1]))).otherwise(c), given.items(), F.lit(1.0))

    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(ratio)).cast("double").alias("want"))
    above: DataFrame = total
    keys: list[str] = []
    for depth, level in enumerate(LEVELS):
        own = leaves.groupBy(*LEVELS[: depth + 1]).agg((F.sum("tokens") * max_epochs).alias("capacity")).withColumn("name", F.col(level)).withColumn("weight", weight(level)).where("capacity > 0")
        joined = own.join(above, keys) if keys else own.join(F.broadcast(above))  # one row
        above = water_level(joined, keys or ["want"], "want").select(*LEVELS[: depth + 1], F.col("share").alias("want"))
        keys = LEVELS[: depth + 1]
    # rounding before the floor keeps sums that differ in their last digits on one side of a whole number
    return leaves.join(above, LEVELS, "left").select(*LEVELS, "tokens", F.floor(F.round(F.coalesce("want", F.lit(0.0)), 3)).cast("long").alias("budget"))


def _placed(docs: DataFrame, seed: int, domain: Column) -> DataFrame:
    node = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return docs.withColumns({"t_domain": domain, "t_language": node("lang"), "t_source": node("source"), "t_tokens": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long"), "t_order": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.md5(F.coalesce(F.col("text"), F.lit("")))))})


def copies(placed: DataFrame, ratio: float, max_epochs: int, weights: dict) -> DataFrame:
    """(t_order, copies) of placed documents, from their leaf's budget."""
    spark = placed.sparkSession
    leaf = ["t_domain", "t_language", "t_source"]
    slim = stage_table(spark, placed.select(*leaf, "t_tokens", "t_order"), "mix")
    epoch_of = lambda n: F.md5(F.concat_ws(":", n.cast("string"), F.col("t_order")))
    leaves = slim.groupBy(*leaf).agg(F.sum("t_tokens").alias("tokens")).toDF(*LEVELS, "tokens")
    budgets = leaf_budgets(leaves, ratio, max_epochs, weights)
    epochs = F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).cast("long")
    budgets = stage_table(spark, budgets.withColumn("whole", epochs).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "budgets").toDF(*leaf, "tokens", "budget", "whole", "rest")
    # tables of one row a leaf meet the documents where they are, as a leaf may hold a third of all; beyond FEW_LEAVES no leaf does but by skew, which adaptive execution splits
    of_leaf = F.broadcast if budgets.count() <= FEW_LEAVES else lambda t: t
    dealt = slim.join(of_leaf(budgets.select(*leaf, "whole", "rest")), leaf)
    key = epoch_of(F.col("whole"))
    dealt = dealt.withColumn("key", key).withColumn("c1", F.substring("key", 1, 2)).withColumn("c2", F.substring("key", 3, 2))
    ends = stage_table(spark, _prefix_end(dealt.where("rest > 0").select(*leaf, F.col("c1").alias("cell"), "t_tokens", "rest"), leaf), "ends").toDF(*leaf, "end1", "left1")
    inner = dealt.join(of_leaf(ends), leaf).where("c1 = end1").select(*leaf, F.col("c2").alias("cell"), "t_tokens", F.col("left1").alias("rest"))
    ends = stage_table(spark, ends.join(_prefix_end(inner, leaf).toDF(*leaf, "end2", "left2"), leaf), "ends")
    dealt = dealt.join(of_leaf(ends), leaf, "left")
    last = dealt.where("c1 = end1 and c2 = end2")
    run = F.sum("t_tokens").over(Window.partitionBy(*leaf).orderBy("key"))
    last = last.withColumn("run", run).where("run <= left2")
    within = dealt.where("c1 < end1 or (c1 = end1 and c2 < end2)").select("t_order").union(last.select("t_order")).distinct().withColumn("more", F.lit(1))
    return dealt.select("t_order", "whole").distinct().join(within, "t_order", "left").select("t_order", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies"))


def _prefix_end(rows: DataFrame, leaf: list[str]) -> DataFrame:
    """Of each leaf with a rest, the cell that the rest ends in, and what is left of it there."""
    cells = rows.groupBy(*leaf, "cell").agg(F.sum("t_tokens").alias("sum"), F.max("rest").alias("rest"))
    cells = cells.withColumn("upto", F.sum("sum").over(Window.partitionBy(*leaf).orderBy("cell"))).where("upto > rest")
    return cells.groupBy(*leaf).agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("sum")).alias("left"))).alias("e")).select(*leaf, "e.cell", "e.left")


def mix_report(docs: DataFrame, ratio: float = 1.0, max_epochs: int = 3, seed: int = 17, weights: dict | None = None, domain: Column | None = None) -> DataFrame:
    """Per document: doc_id, domain, language, source, n_tokens, copies."""
    placed = _placed(docs.select("doc_id", "text", "lang", "source"), seed, source_domain(F.col("source")) if domain is None else domain).drop("text")
    counted = placed.join(copies(placed, ratio, max_epochs, weights or {}), "t_order", "left")
    return counted.select("doc_id", F.col("t_domain").alias("domain"), F.col("t_language").alias("language"), F.col("t_source").alias("source"), F.col("t_tokens").alias("n_tokens"), "copies")


def mix(docs: DataFrame, ratio: float = 1.0, max_epochs: int = 3, seed: int = 17, weights: dict | None = None, domain: Column | None = None) -> DataFrame:
    """docs, each row as often as it is taken: copies are rows."""
    own = docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("row"))
    placed = _placed(own, seed, source_domain(F.col("source")) if domain is None else domain)
    counted = placed.select("t_order", "row").join(copies(placed, ratio, max_epochs, weights or {}), "t_order").where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: Leaves of which tables of one row each are broadcast: some 20 MB at most.
FEW_LEAVES = 200_000
#: Production parameters of op4: tokens wanted of all, epochs, weights on each level.
RATIO, EPOCHS, SEED = 0.8, 3, 17
WEIGHTS = {
    "domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 1.5},
    "language": {"en": 4.0, "fr": 2.0, "de": 2.0},
    "source": {"src0": 0.5, "src3": 2.0, "src8": 0.25, "src11": 3.0, "src15": 2.0},
}


def _level_sql(depth: int) -> str:
    keys, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
    over = f"PARTITION BY {up}" if up else ""
    weight = "CASE " + " ".join(f"WHEN {LEVELS[depth]} = '{k}' THEN {v}" for k, v in WEIGHTS[LEVELS[depth]].items()) + " ELSE 1.0 END" if LEVELS[depth] in WEIGHTS else "1.0"
    above = f"JOIN share{depth - 1} USING ({up})" if up else "CROSS JOIN wanted"
    return f"""
, node{depth} AS (
  SELECT n.*, {f"share{depth - 1}.want" if up else "wanted.want"} AS budget FROM (
    SELECT {keys}, CAST(sum(tokens) * {EPOCHS} AS DOUBLE) AS capacity, CAST({weight} AS DOUBLE) AS weight
    FROM leaves GROUP BY {keys} HAVING sum(tokens) > 0) n {above}
), run{depth} AS (
  SELECT *, sum(capacity) OVER ({over} ORDER BY capacity / weight, {LEVELS[depth]}) - capacity AS below,
         sum(weight) OVER ({over} ORDER BY capacity / weight, {LEVELS[depth]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM node{depth}
), level{depth} AS (
  SELECT *, max(CASE WHEN capacity / weight * rest + below > budget THEN (budget - below) / rest END) OVER ({over}) AS level FROM run{depth}
), share{depth} AS (
  SELECT {keys}, CASE WHEN level IS NULL THEN capacity ELSE least(capacity, weight * level) END AS want FROM level{depth}
)"""


#: DuckDB SQL for op4's rows over the table documents.
SQL = f"""
WITH placed AS (
  SELECT doc_id, 'domain' || CAST(CAST('0x' || substr(md5(coalesce(source, '?')), 1, 2) AS BIGINT) % 4 AS VARCHAR) AS domain,
         coalesce(lang, '?') AS language, coalesce(source, '?') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
         md5('{SEED}' || ':' || coalesce(CAST(doc_id AS VARCHAR), '?') || ':' || md5(coalesce(text, ''))) AS o
  FROM documents
), leaves AS (
  SELECT domain, language, source, sum(n_tokens) AS tokens FROM placed GROUP BY ALL
), wanted AS (
  SELECT CAST(floor(sum(tokens) * CAST({RATIO} AS DOUBLE)) AS DOUBLE) AS want FROM leaves
){"".join(_level_sql(d) for d in range(3))}
, budgets AS (
  SELECT l.*, CAST(floor(round(coalesce(want, 0.0), 3)) AS BIGINT) AS budget FROM leaves l LEFT JOIN share2 USING (domain, language, source)
), whole AS (
  SELECT *, CAST(CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS BIGINT) AS whole FROM budgets
), keyed AS (
  SELECT p.*, whole, budget - whole * tokens AS rest, md5(CAST(whole AS VARCHAR) || ':' || o) AS key FROM placed p JOIN whole USING (domain, language, source)
)
SELECT doc_id, domain, language, source, n_tokens,
       CAST(whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY key) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM keyed
"""
