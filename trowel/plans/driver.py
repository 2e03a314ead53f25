"""Kernels bound to the driver's tables; trowel.plans.oracle has the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trowel.functions import text as T
from trowel.operators import graph, relations, summaries
from trowel.session import stage_table
from trowel.sources import packaging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Days are counted in UTC from timestamps without zone.
def _seconds(column: str):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


# --- histories and totals


@query
def co_change(spark, sf_dir):
    return relations.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query
def file_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return summaries.history(orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderdate"), "o_orderpriority", "o_orderstatus")


@query
def timeline(spark, sf_dir):
    return summaries.timeline(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"))


@query
def stalled(spark, sf_dir):
    return summaries.stalled(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), max_commits=5, quiet_days=60)


@query
def frontier_score(spark, sf_dir):
    kind = F.col("event_type")
    weight = F.when(kind == "error", 6.0).when(kind == "purchase", 4.0).when(kind == "click", 3.0).when(kind == "signup", 2.0).otherwise(1.0)
    return summaries.weighted_score(table(spark, sf_dir, "events"), "user_id", "event_type", weight, digits=4)


@query
def signal_totals(spark, sf_dir):
    return summaries.totals(table(spark, sf_dir, "events"), "event_type")


SEVERITY = ["error", "purchase", "signup", "click", "view"]


@query
def dominant_state(spark, sf_dir):
    severity = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("event_type"))
    return summaries.mode_by_severity(table(spark, sf_dir, "events"), "user_id", "event_type", severity)


@query
def fan(spark, sf_dir):
    return graph.fan(co_change(spark, sf_dir), "item_a", "item_b").withColumnRenamed("node", "part")


# --- anti-joins


@query
def orphans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    newest = lines.agg(F.max("l_shipdate").alias("newest"))
    recent = lines.join(F.broadcast(newest)).where(F.col("l_shipdate") > F.col("newest") - F.expr("interval 30 days"))  # newest is one row
    return relations.without(table(spark, sf_dir, "part").select("p_partkey", "p_name"), recent.select(F.col("l_partkey").alias("p_partkey")))


@query
def unreferenced(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("l_suppkey"))
    used = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(suppliers, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    caveat = summaries.first_match((F.col("p_size") < 10, "small"), (F.col("p_retailprice") > 1500, "dear"))
    return relations.without(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), used).select("p_partkey", caveat.alias("caveat"))


# --- competing attempts: documents as modules, distinct lines as definitions


def _lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return docs.select("doc_id", F.trim("line").alias("line")).where(F.length("line") >= 4).distinct()


def _digests(spark, sf_dir) -> DataFrame:
    """Distinct lines of documents as digests of 16 bytes, made before anything is shuffled; staged, a document's in one place, so that what is counted by document is counted there."""
    each = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) >= 4), lambda x: F.unhex(F.md5(x))))
    return stage_table(spark, table(spark, sf_dir, "documents").select("doc_id", F.explode(each).alias("line")).repartition("doc_id").distinct(), "lines")


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Line digests of documents, and members (component, doc_id) of overlapping documents."""
    lines = _digests(spark, sf_dir)
    members = graph.components(relations.overlap_links(lines, "doc_id", "line", 3, staged=True)).select("component", F.col("node").alias("doc_id"))
    return lines, stage_table(spark, members, "members")


@query
def overlap_pairs(spark, sf_dir):
    return relations.overlap_pairs(_digests(spark, sf_dir), "doc_id", "line", 3, staged=True)


@query
def attempt_components(spark, sf_dir):
    return graph.components(relations.overlap_links(_digests(spark, sf_dir), "doc_id", "line", 3, staged=True)).select(F.col("node").alias("doc_id"), "component")


@query
def same_file_sets(spark, sf_dir):
    return relations.equal_sets(_lines(spark, sf_dir), "doc_id", "line", min_size=3)


@query
def group_shared(spark, sf_dir):
    lines, members = _facts(spark, sf_dir)
    return summaries.shared_features(members, lines, "component", "doc_id", "line", staged=True)


def _ranked(spark, sf_dir, members: DataFrame) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    scored = members.join(docs, "doc_id").withColumn("quality", F.coalesce("quality", F.lit(0)))
    return summaries.ranked_members(scored, "component", [F.desc("quality"), F.desc("n_chars"), F.asc("doc_id")])


@query
def completeness_rank(spark, sf_dir):
    _, members = _facts(spark, sf_dir)
    return _ranked(spark, sf_dir, members).select("component", "doc_id", "rank")


@query
def lineage(spark, sf_dir):
    lines, members = _facts(spark, sf_dir)
    return summaries.lineage(members, lines, "component", "doc_id", "line", staged=True)


@query
def salvage_counterpart(spark, sf_dir):
    lines = _digests(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    mine = lines.join(labelled, "doc_id", "left_anti").withColumnRenamed("doc_id", "mine")
    live = lines.join(labelled, "doc_id", "left_semi").withColumnRenamed("doc_id", "counterpart")
    # the pairs are those of overlap_pairs: three shared lines at least
    pairs = relations.overlap_pairs(lines, "doc_id", "line", 3, staged=True)
    both = pairs.union(pairs.select("b", "a", "shared")).toDF("mine", "counterpart", "shared")
    wanted = both.join(mine.select("mine").distinct(), "mine", "left_semi").join(live.select("counterpart").distinct(), "counterpart", "left_semi")
    return relations.best_counterpart(wanted, "mine", "counterpart", "shared")


@query
def replaced_methods(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "c_mktsegment")
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
    return relations.divides(bought, "l_partkey", "c_mktsegment", customers.select("c_mktsegment"))


# --- forks, hubs, ribbons, graphs


@query
def forks(spark, sf_dir):
    pairs = relations.later_than(table(spark, sf_dir, "events"), ["user_id"], "event_type", _seconds("ts"))
    days = F.floor((F.col("continued_at") - F.col("stopped_at")) / 86400)
    return pairs.where("continued_at > stopped_at + 5 * 86400").select("user_id", "stopped", "continued", days.alias("days_after"))


@query
def hub_trim(spark, sf_dir):
    edges = stage_table(spark, co_change(spark, sf_dir).select("item_a", "item_b"), "edges")
    return relations.hub_trim(edges, "item_a", "item_b", share=0.001)


@query
def ribbons(spark, sf_dir):
    """Orders as edges from customers to suppliers, regions as their folders."""
    region = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("n_nationkey"))
    sellers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("n_nationkey"))
    folder = buyers.union(sellers).join(region, "n_nationkey").select("node", F.col("r_name").alias("folder"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("src"))
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("dst")).join(orders, "l_orderkey")
    return relations.ribbons(edges, folder)


def _roots(edges: DataFrame) -> DataFrame:
    return edges.groupBy("item_a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_a").limit(5).select("item_a")


@query
def layers(spark, sf_dir):
    edges = stage_table(spark, co_change(spark, sf_dir).select("item_a", "item_b"), "edges")
    return graph.layers(edges, _roots(edges), "item_a", "item_b")


@query
def trace_up_down(spark, sf_dir):
    edges = stage_table(spark, co_change(spark, sf_dir).select("item_a", "item_b"), "edges")
    both = graph.fan(edges, "item_a", "item_b")
    seed = both.orderBy((F.col("fan_in") * F.col("fan_out")).desc(), "node").limit(1).select("node")
    return graph.trace(edges, seed, "item_a", "item_b")


@query
def rename_chain(spark, sf_dir):
    """Each document to the next with its text, followed to the last: chains within blocks of ids, so that no task orders a whole group of copies."""
    from pyspark.sql import Window

    digests = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("d"), F.length("text").alias("n"), F.floor(F.col("doc_id") / 65536).alias("block"))
    within = digests.withColumn("new", F.lead("doc_id").over(Window.partitionBy("d", "n", "block").orderBy("doc_id"))).where("new is not null").select("doc_id", "new")
    ends = digests.groupBy("d", "n", "block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("doc_id"))
    across = ends.withColumn("new", F.lead("low").over(Window.partitionBy("d", "n").orderBy("block"))).where("new is not null").select("doc_id", "new")
    return graph.pointer_chase(within.union(across), "doc_id", "new").select(F.col("node").alias("doc_id"), "canonical")


@query
def rename_history(spark, sf_dir):
    """Lines of orders as renames in their order, a part's name to another's: what each name is called in the end, with names used again and coming back."""
    lines = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    place = F.expr("((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey")  # a number of its own for each different rename
    renames = lines.select(place.alias("ord"), name(F.col("l_partkey")).alias("old"), name((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 5000 + 1).alias("new"))
    return graph.rename_chain(renames).select("node", "canonical")


# --- windows


@query
def islands(spark, sf_dir):
    half = F.expr("interval 30 minutes")
    return summaries.islands(table(spark, sf_dir, "events"), ["user_id"], F.col("ts") - half, F.col("ts") + half)


@query
def topn_more(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return summaries.top_n_more(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey")], 3)


@query
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return summaries.latest(events, ["user_id", "event_type"], ["ts", "event_id"])


@query
def quiet_rank(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return summaries.quiet_rank(last, "o_custkey", "last").where("later >= 3").select("o_custkey", "later")


# --- sources, text, sinks


@query
def stamp_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("backup_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey"), F.lit(".py")).alias("name"))
    return orders.select("o_orderkey", T.stamped_date(F.col("name")).alias("stamped"))


@query
def vocab(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.vocabulary(F.col("text"))).alias("word"))
    return summaries.totals(words, "word")


@query
def size_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.size_share(F.col("n_chars")).alias("share"))


@query
def href_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("html", r"<title>([^< ]*)", 1).alias("slug"), F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1)).alias("hrefs"))
    refs = pages.select("page_id", "host", F.explode(F.array_distinct("hrefs")).alias("href"))
    own = pages.select(F.concat_ws("|", "host", "slug").alias("name"), "page_id")
    index = own.union(pages.select("slug", "page_id")).toDF("name", "target")
    return relations.resolve_by_priority(refs, ["page_id", "href"], F.array(F.concat_ws("|", "host", "href"), F.col("href")), index, "name", "target")


# --- further joins, sets and roll-ups of the survey, over the driver's tables


@query
def range_join(spark, sf_dir):
    """Line in range: shipments within the 60 days after their order, per priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 60 days")).alias("until"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return relations.in_range(lines, orders, ["o_orderkey"], "l_shipdate", "o_orderdate", "until").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query
def representatives(spark, sf_dir):
    """Live pick of each group: the first supplier of a nation that is not in debt, else the first."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") < 0).cast("int").alias("aside"))
    return summaries.ranked_members(suppliers, "s_nationkey", [F.asc("aside"), F.asc("s_suppkey")]).where("rank = 1").select("s_nationkey", "s_suppkey")


@query
def labels_clipped(spark, sf_dir):
    """Labels cut at the end, in the middle and at a word; a card's last line."""
    name, size = F.col("p_name"), F.concat("p_size", F.lit(" lines"))
    meta = T.meta_line(size, F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, "new").otherwise(""), 14)
    return table(spark, sf_dir, "part").select("p_partkey", T.clip_end(name, 12).alias("end"), T.clip_middle(name, 9).alias("middle"), T.clip_words(name, 9).alias("words"), meta.alias("meta"))


@query
def durations(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.duration(F.col("p_size") * 2.5 - 1.9).alias("took"))


@query
def score_bars(spark, sf_dir):
    """Bars in proportion to each type's count."""
    counts = summaries.totals(table(spark, sf_dir, "events"), "event_type")
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most)).select("event_type", T.text_bar(F.col("n"), F.col("most")).alias("bar"))  # most is one row


@query
def escaped_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query
def declared_entries(spark, sf_dir):
    """Entry points that the packaging files of as many projects as there are parts declare; some files are missing, some broken."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("b"))
    toml = F.format_string(
        '[project]\nname = "p%1$d"\n[project.scripts]\nrun = "%2$s.cli:main"\nbroken = "no module!"\n"odd name" = " %2$s.tool : run [extra] "\ncount = %1$d\n'
        '[project.gui-scripts]\nshow = "%2$s.gui"\n[project.entry-points."some.plugins"]\nagain = "%2$s.cli:other"\nplug = "%2$s.plugins.m%1$d:hook"\n', "p_partkey", "b"
    )
    toml = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("[project\n"), toml)).otherwise(toml)
    cfg = F.format_string("[metadata]\nname = p%1$d\n[options.entry_points]\nconsole_scripts =\n    run = %2$s.cli:start\n    work = %2$s.work_%1$d:work\n    a lost line\nother.group =\n    tool = %2$s.tool\n", "p_partkey", "b")
    folder = F.concat(F.lit("projects/p"), "p_partkey")
    files = part.where("p_size % 3 <> 2").select(F.concat(folder, F.lit("/pyproject.toml")).alias("relpath"), toml.alias("content"))
    files = files.union(part.where("p_size % 3 <> 0").select(F.concat(folder, F.lit("/setup.cfg")), cfg))
    return packaging.declared_in(files.withColumn("content", F.encode("content", "UTF-8")))


@query
def module_names(spark, sf_dir):
    """Dotted names of source paths made of part numbers."""
    path = F.concat(F.lit("pkg/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.when(F.col("p_size") % 5 == 0, F.lit("__init__")).otherwise(F.concat(F.lit("m"), F.col("p_partkey"))), F.lit(".py"))
    return table(spark, sf_dir, "part").select("p_partkey", T.module_name(path).alias("dotted"))


