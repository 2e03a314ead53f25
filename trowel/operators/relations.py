"""Joins and set kernels: co-occurrence, overlap, division, anti-joins, priorities, mentions, ribbons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trowel.session import ship_package, shuffle_parts, stage_table, tasks_for


#: Rows whose pairs one task makes, and rows whose counts of pairs one task adds up, about.
PAIRED_EACH, COUNTED_EACH = 100_000, 150_000
#: Slices for each task, so that tasks are of about one size.
SLICES_EACH = 64


def co_occurrence(df: DataFrame, group: str, item: str, low: int = 2, high: int = 25, min_count: int = 2) -> DataFrame:
    """(item_a, item_b, n): unordered pairs of items in groups of low..high distinct items.

    Larger groups are dropped before the self-join, by definition, so a group gives high * (high - 1) / 2
    pairs at most. Groups are dealt to as many tasks as their rows ask for, as pairs are many more than rows: each
    counts the pairs of its slices, and counts are added up by as many tasks again, so no task grows with the input.
    """
    spark, n_rows = df.sparkSession, df.count()
    tasks = tasks_for(spark, n_rows, PAIRED_EACH)
    given = df.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null")
    # what is grouped by slice, and by more, is so where it is
    dealt = given.withColumn("slice", F.pmod(F.xxhash64("g"), F.lit(SLICES_EACH * tasks))).repartition(tasks, "slice")
    sizes = dealt.groupBy("slice", "g").agg(F.sort_array(F.collect_set("i")).alias("items")).where(F.size("items").between(low, high))
    a = sizes.select("slice", "items", F.posexplode("items").alias("p", "item_a"))
    b = a.select("slice", "item_a", F.explode(F.slice("items", F.col("p") + 2, F.size("items"))).alias("item_b"))
    counted = b.groupBy("slice", "item_a", "item_b").agg(F.count("*").alias("n"))
    summed = counted.repartition(tasks_for(spark, n_rows, COUNTED_EACH), "item_a", "item_b").groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= min_count)


def _by_rarity(own: DataFrame, min_shared: int) -> DataFrame:
    """Staged (k, f, n, r): of own(k, f), distinct rows, features that several keys have; n: how many of them the key has, min_shared at least; r: the feature's place among them, rarest first."""
    spark = own.sparkSession
    often = stage_table(spark, own.groupBy("f").agg(F.count("*").alias("df")).where("df > 1"), "often")
    # most features are of one key: they are left where they are
    counted = possible(own, "f", often.select("f"), often.count()).where("may").drop("may").join(often, "f")
    by_key = Window.partitionBy("k")
    ranked = counted.withColumn("n", F.count("*").over(by_key)).withColumn("r", F.row_number().over(by_key.orderBy("df", "f"))).where(F.col("n") >= min_shared)
    return stage_table(spark, ranked.select("k", "f", "n", "r"), "ranked")


def _shared(found: DataFrame, ranked: DataFrame, min_shared: int) -> DataFrame:
    """(a, b, shared) of those pairs of keys in found(a, b), distinct rows, that share min_shared features or more."""
    all_ = ranked.select("k", "f")
    shared = found.join(all_.withColumnRenamed("k", "a"), "a").join(all_.withColumnRenamed("k", "b"), ["b", "f"])
    return shared.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def overlap_pairs(df: DataFrame, key: str, feature: str, min_shared: int = 3, staged: bool = False) -> DataFrame:
    """(a, b, shared), a < b: keys that share min_shared features or more; never a loop over all pairs.

    Prefix filter: with features in order of rarity, such a pair shares one of the first
    size - min_shared + 1 of both, so a key's most frequent features bring no candidates.
    staged: df is a staged table of distinct rows already, which need not be shuffled and written again.
    """
    own = df.select(F.col(key).alias("k"), F.col(feature).alias("f")).where("k is not null and f is not null")
    ranked = _by_rarity(own if staged else stage_table(df.sparkSession, own.distinct(), "features"), min_shared)
    prefix = ranked.where(F.col("r") <= F.col("n") - min_shared + 1)
    left, right = prefix.select("f", F.col("k").alias("a")), prefix.select("f", F.col("k").alias("b"))
    return _shared(left.join(right, "f").where("a < b").select("a", "b").distinct(), ranked, min_shared)


#: Keys with features in common that are paired with each other, at most; also if more, where their features are more yet.
PAIRED_KEYS = 16


def overlap_links(df: DataFrame, key: str, feature: str, min_shared: int = 3, staged: bool = False) -> DataFrame:
    """(a, b): links, staged, that connect whatever overlap_pairs connects, and nothing else; they grow with the rows, not with the square of a group.

    Of keys with equal sets only the smallest meets others. Keys with min_shared features in common that stand together in
    the order of rarity are linked with the smallest of them. What these links leave apart is grouped by its rarest
    feature in common, as in overlap_pairs: few keys are paired and counted, many are grouped further by the next feature
    in common too, and those of a group of min_shared features are linked with its smallest. At each step groups that the
    first links connect are left out. staged: as in overlap_pairs.
    """
    from trowel.operators import graph  # which imports this module

    spark = df.sparkSession
    own = df.select(F.col(key).alias("k"), F.col(feature).alias("f")).where("k is not null and f is not null")
    own = own if staged else stage_table(spark, own.distinct(), "features")
    same = stage_table(spark, equal_sets(own, "k", "f", min_shared, staged=True).select("k", "leader").where("k <> leader"), "same")
    ranked = _by_rarity(own.join(same.select("k"), "k", "left_anti"), min_shared)
    run = F.collect_list("f").over(Window.partitionBy("k").orderBy("r").rowsBetween(0, min_shared - 1))
    runs = ranked.select("k", run.alias("t")).where(F.size("t") == min_shared)
    first = runs.groupBy("t").agg(F.min("k").alias("a"), F.count("*").alias("size")).where("size > 1")
    sure = stage_table(spark, runs.join(first, "t").where("a <> k").select("a", F.col("k").alias("b")).distinct(), "sure")
    home = stage_table(spark, graph.stars(sure).toDF("k", "home"), "home")
    now = ranked.where(F.col("r") <= F.col("n") - min_shared + 1).join(home, "k", "left").select(F.array("f").alias("t"), "k", "n", "r", F.coalesce("home", "k").alias("home"))
    links = [sure, same.select(F.col("leader").alias("a"), F.col("k").alias("b"))]
    pairs = []
    for held in range(1, min_shared + 1):
        groups = now.groupBy("t").agg(F.count("*").alias("size"), F.avg(F.col("n") - F.col("r")).alias("more"), F.min("k").alias("low"), (F.min("home") < F.max("home")).alias("apart"))
        apart = stage_table(spark, now.join(groups.where("apart").drop("apart"), "t"), "apart")
        if held == min_shared:
            links.append(apart.where("low <> k").select(F.col("low").alias("a"), F.col("k").alias("b")))
            break
        few = F.col("size") <= F.greatest(F.lit(PAIRED_KEYS), F.col("more") / 2)
        left, right = (apart.where(few).select("t", F.col("k").alias(c), F.col("home").alias(f"{c}_home")) for c in "ab")
        pairs.append(left.join(right, "t").where("a < b and a_home <> b_home").select("a", "b"))
        then = ranked.select("k", F.col("f").alias("next"), F.col("r").alias("at"))
        next_ = apart.where(~few).join(then, "k").where((F.col("at") > F.col("r")) & (F.col("at") <= F.col("n") - min_shared + held + 1))
        now = next_.select(F.concat("t", F.array("next")).alias("t"), "k", "n", F.col("at").alias("r"), "home")
    if pairs:
        links.append(_shared(reduce(DataFrame.union, pairs).distinct(), ranked, min_shared).select("a", "b"))
    return stage_table(spark, reduce(DataFrame.union, links), "links")


def equal_sets(df: DataFrame, key: str, feature: str, min_size: int = 1, staged: bool = False) -> DataFrame:
    """(key, leader, n): keys whose feature set another key has too; leader is the smallest key of the set. staged: as in overlap_pairs."""
    own = df.select(F.col(key).alias("k"), F.col(feature).alias("f"))
    own = own if staged else own.distinct()
    sets = own.groupBy("k").agg(F.count("*").alias("size"), F.sum(F.xxhash64("f").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(17), "f")).alias("h2"))
    sets = sets.where(F.col("size") >= min_size)
    same = sets.groupBy("size", "h1", "h2").agg(F.min("k").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return sets.join(same, ["size", "h1", "h2"]).select(F.col("k").alias(key), "leader", "n")


def weighted_overlap(left: DataFrame, right: DataFrame, least: int, where: Column | None = None) -> DataFrame:
    """(a, b): keys of left(a, f, n, ..) and right(b, f, n, ..), one row a key and feature, whose least counts add up to least or more; where: a condition on their other columns, which are one value a key.

    Prefix filter: a count of n is n tokens of a feature. With tokens in order of their feature's rarity, such a pair
    shares one that is not among the last least - 1 of either, so a key's most frequent tokens bring no candidates.
    Candidates that do not reach least without these are counted with all of their features.
    """
    spark = left.sparkSession
    often = left.select("f").union(right.select("f")).groupBy("f").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        later = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)
        gone = F.greatest(F.lit(least - 1) - F.coalesce(F.sum("n").over(later), F.lit(0)), F.lit(0))
        return df.join(often, "f").withColumn(f"{key}_n", F.col("n") - gone).where(F.col(f"{key}_n") > 0).drop("n", "df")

    met = prefix(left, "a").join(prefix(right, "b"), "f")
    counted = (met if where is None else met.where(where)).groupBy("a", "b").agg(F.sum(F.least("a_n", "b_n")).alias("n"))
    counted = stage_table(spark, counted, "met")
    common = counted.where(F.col("n") < least).select("a", "b").join(left.select("a", "f", F.col("n").alias("x")), "a").join(right.select("b", "f", F.col("n").alias("y")), ["b", "f"])
    more = common.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("n")).where(F.col("n") >= least)
    return counted.where(F.col("n") >= least).select("a", "b").union(more.select("a", "b"))


def surpassed_by_few(df: DataFrame, group: Sequence[str], at: str, rank: str, n: int) -> DataFrame:
    """Rows of df without most of those that n others of their group surpass, by an at as late and a lesser rank; every row that fewer surpass stays.

    n layers: rows that none surpasses, then those that none of the rest does, and so on; some n * ln(rows) of a
    group in any order. Each group is thinned in blocks first, so a large one is not one task's work.
    """
    parts = shuffle_parts(df.sparkSession)
    for keys in ([*group, "block"], [*group]):
        now = df.withColumn("block", F.pmod(F.xxhash64(at, rank), F.lit(parts))) if "block" in keys else df
        before = Window.partitionBy(*keys).orderBy(F.desc(at), rank).rowsBetween(Window.unboundedPreceding, -1)
        now = now.withColumn("open", F.lit(True))
        for _ in range(n):
            least = F.min(F.when(F.col("open"), F.col(rank))).over(before)
            now = now.withColumn("least", least).withColumn("open", F.col("open") & F.coalesce(F.col(rank) >= F.col("least"), F.lit(False)))
        df = now.where("not open").select(*df.columns)
    return df


def divides(df: DataFrame, key: str, value: str, domain: DataFrame) -> DataFrame:
    """(key, n): keys with every value of domain's first column: relational division by a distinct count."""
    values = domain.select(F.col(domain.columns[0]).alias(value)).distinct()
    total = values.agg(F.count("*").alias("total"))
    have = df.select(key, value).join(values, value, "left_semi").groupBy(key).agg(F.count_distinct(value).alias("n"))
    return have.join(F.broadcast(total)).where("n = total").select(key, "n")  # total is one row


def without(df: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of df whose key occurs in none of others; key: the columns of each other table."""
    for other in others:
        df = df.join(other.distinct(), other.columns, "left_anti")
    return df


def resolve_by_priority(refs: DataFrame, ref_keys: Sequence[str], candidates: Column, index: DataFrame, name: str, target: str) -> DataFrame:
    """(ref_keys..., target, priority): each reference's first candidate, in array order, that the index names.

    candidates: an array of names; index: (name, target), of several targets the smallest.
    """
    exploded = refs.select(*ref_keys, F.posexplode(candidates).alias("priority", "candidate")).where("candidate is not null")
    names = index.groupBy(F.col(name).alias("candidate")).agg(F.min(target).alias("t"))
    best = exploded.join(names, "candidate").groupBy(*ref_keys).agg(F.min(F.struct("priority", "t")).alias("best"))
    return best.select(*ref_keys, F.col("best.t").alias(target), F.col("best.priority").alias("priority"))


def best_counterpart(pairs: DataFrame, mine: str, theirs: str, score: str) -> DataFrame:
    """(mine, theirs, score): the highest score for each, ties to the smallest counterpart."""
    best = pairs.groupBy(mine).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(theirs).alias("t"))).alias("m"))
    return best.select(mine, F.col("m.t").alias(theirs), (-F.col("m.s")).alias(score))


#: A key is hot if its rows are more than this, more than a partition's share, and more than leaves room for MOST_HOT hot keys.
HOT_ROWS, MOST_HOT = 1000, 100_000


def hot_limit(n_rows: int, partitions: int, least: int | None = None) -> int:
    """Rows of a key above which it is hot; of n_rows, MOST_HOT / 2 keys at most can have more.

    A power of two, so that plans over inputs of about one size are the same code, compiled once.
    """
    return 1 << (max(least or HOT_ROWS, n_rows // (2 * partitions), 2 * n_rows // MOST_HOT) - 1).bit_length()


def join_hot(rows: DataFrame, key: str, table: DataFrame, limit: int | None, count: str = "n", small: Column | None = None) -> DataFrame:
    """rows with the columns of table for their key, as an inner join. table: one row a key, with the number of its rows in count.

    Rows of hot keys meet a broadcast table of MOST_HOT rows at most where they are, so a key is never
    one task's work; all others are an equi-join. limit: from hot_limit, or None where no key is hot.
    small: a condition on table's rows that bounds their size, without which they are not broadcast.
    """
    given = [c for c in table.columns if c != key]
    if limit is None:
        return rows.join(table, key).select(*rows.columns, *given)
    is_hot = F.col(count) > limit if small is None else (F.col(count) > limit) & small
    hot = table.where(is_hot)
    marked = rows.join(F.broadcast(hot), key, "left")  # MOST_HOT rows at most
    there = marked.where(F.col(count).isNotNull()).select(*rows.columns, *given)
    rest = marked.where(F.col(count).isNull()).select(*rows.columns)
    return there.union(rest.join(table.where(~is_hot), key).select(*rows.columns, *given))


#: Bits of a filter, at least and at most: 2 ** 17 to 2 ** 21 rows of 64 bits.
FILTER_BITS = (23, 27)


def possible(rows: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """rows with may: false only where key is not in keys (one column of that name).

    By a bitmap of bounded size, so wide rows without a partner need not be shuffled to find that out;
    few are wrong while keys are fewer than an eighth of its bits.
    """
    bits = min(max(FILTER_BITS[0], (8 * n_keys).bit_length()), FILTER_BITS[1])
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    mask = F.expr(f"shiftleft(1L, int(pmod(xxhash64({key}), {1 << bits}L) % 64))")
    words = keys.select(F.shiftright(slot, 6).alias("p_word"), mask.alias("bit")).groupBy("p_word").agg(F.bit_or("bit").alias("p_mask"))
    marked = rows.withColumn("p_word", F.shiftright(slot, 6)).join(F.broadcast(words), "p_word", "left")  # 2 ** (bits - 6) rows at most
    return marked.withColumn("may", F.coalesce(mask.bitwiseAND(F.col("p_mask")) != 0, F.lit(False))).drop("p_word", "p_mask")


#: Signs of a slice of text that is searched, and names that one automaton has.
SLICE, NAMES = 1 << 16, 1 << 16


def mentioned(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of names, one column, that are in one of texts, one column of lower-cased texts, as they are but for case: also within a word.

    Texts are dealt as slices that overlap by the longest name. Names are dealt to blocks of NAMES, about; each block
    is one automaton, which reads a slice once whatever the number of its names.
    """
    spark, name = names.sparkSession, names.columns[0]
    ship_package(spark)
    own = stage_table(spark, names.where(F.length(name) > 0).distinct(), "names")
    known = own.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length(name)), F.lit(0)).alias("most")).first()
    blocks = -(-known["n"] // NAMES)
    text = F.col(texts.columns[0])
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(SLICE))
    slices = texts.where(text.isNotNull()).select(F.explode(starts).alias("at"), text.alias("text")).select(F.expr(f"substring(text, at, {SLICE + known['most']})").alias("text"))
    every = stage_table(spark, slices, "slices")
    out = own.limit(0)
    for block in range(blocks):
        chosen = own.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([r[0] for r in chosen.toLocalIterator()])  # some NAMES names

        def found(batches, shared=shared):
            import ahocorasick

            search = ahocorasick.Automaton()
            for x in shared.value:
                search.add_word(x.lower(), x.lower())
            if not len(search):
                return
            search.make_automaton()
            hits: set[str] = set()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    hits.update(x for _, x in search.iter(t))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(hits), pa.string())], ["low"])

        low = every.mapInArrow(found, "low string").distinct()
        out = out.union(chosen.join(low, F.lower(name) == F.col("low"), "left_semi"))
    return out


def in_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, low: str, high: str) -> DataFrame:
    """points joined with the ranges of the same keys that hold them: an equi-join with a residual."""
    return points.join(ranges, list(keys)).where(F.col(at).between(F.col(low), F.col(high)))


def ribbons(edges: DataFrame, folder_of: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src_folder, dst_folder, n): edges between different folders. folder_of: (node, folder)."""
    node, folder = folder_of.columns
    a = folder_of.select(F.col(node).alias(src), F.col(folder).alias("src_folder"))
    b = folder_of.select(F.col(node).alias(dst), F.col(folder).alias("dst_folder"))
    joined = edges.select(src, dst).join(a, src).join(b, dst).where("src_folder <> dst_folder")
    return joined.groupBy("src_folder", "dst_folder").agg(F.count("*").alias("n"))


def later_than(rows: DataFrame, group: Sequence[str], item: str, at: Column) -> DataFrame:
    """(group..., stopped, continued, stopped_at, continued_at): pairs of a group's items, the second last touched after the first."""
    last = rows.groupBy(*group, item).agg(F.max(at).alias("at"))
    a = last.select(*group, F.col(item).alias("stopped"), F.col("at").alias("stopped_at"))
    b = last.select(*group, F.col(item).alias("continued"), F.col("at").alias("continued_at"))
    return a.join(b, list(group)).where("continued_at > stopped_at")


def hub_trim(edges: DataFrame, src: str, dst: str, share: float = 0.10, floor: int = 2) -> DataFrame:
    """Edges but those to hubs: destinations of more than max(floor, int(share * sources)) edges."""
    n = edges.agg(F.count_distinct(src).alias("sources"))
    hubs = edges.groupBy(dst).agg(F.count("*").alias("into")).join(F.broadcast(n)).where(F.col("into") > F.greatest(F.lit(floor), F.floor(F.col("sources") * share)))
    return edges.join(hubs.select(dst), dst, "left_anti")
