"""Aggregations and windows: scores, histories, modes, islands, lineage, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trowel.session import stage_table


def weighted_score(signals: DataFrame, key: str, kind: str, weight: Column, power: float = 0.6, digits: int = 1) -> DataFrame:
    """(key, score, n_signals): sum over kinds of weight * count ** power. weight: an expression over kind."""
    counts = signals.groupBy(key, kind).agg(F.count("*").alias("n"))
    total = F.sum(weight * F.pow(F.col("n").cast("double"), F.lit(power)))
    return counts.groupBy(key).agg(F.round(total, digits).alias("score"), F.sum("n").alias("n_signals"))


def totals(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def mode_by_severity(df: DataFrame, key: str, state: str, severity: Column) -> DataFrame:
    """(key, state, n): each key's most frequent state, ties to the lowest severity number."""
    counts = df.groupBy(key, state).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-severity).alias("s"), F.col(state).alias("state"))).alias("m"))
    return best.select(key, F.col("m.state").alias(state), F.col("m.n").alias("n"))


def history(log: DataFrame, key: str, order: Sequence[str], at: Column, subject: str, author: str, keep: int = 8) -> DataFrame:
    """Per key: commits, first and last date and subject by log order, distinct authors, the newest keep subjects.

    order: columns that place a row in the log, oldest first. Only keep subjects per key are ever collected.
    """
    place = F.struct(*order)
    day = F.date_format(at, "yyyy-MM-dd")
    agg = log.groupBy(key).agg(
        F.count("*").alias("commits"),
        F.min_by(day, place).alias("first_seen"),
        F.max_by(day, place).alias("last_touched"),
        F.min_by(subject, place).alias("first_subject"),
        F.max_by(subject, place).alias("last_subject"),
        F.array_join(F.sort_array(F.collect_set(author)), ",").alias("authors"),
    )
    newest = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    top = log.select(key, subject, *order).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= keep)
    recent = top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", subject))), lambda x: x[subject]), "|").alias("subjects"))
    return agg.join(recent, key)


def timeline(df: DataFrame, key: str, at: Column, order: Sequence[str] = ()) -> DataFrame:
    """(month, n, first_key): keys by the month they were first seen in: of the row that comes first by order, else of the earliest."""
    begun = F.min_by(at, F.struct(*order)) if order else F.min(at)
    first = df.groupBy(key).agg(F.date_format(begun, "yyyy-MM").alias("month"))
    return first.groupBy("month").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def stalled(df: DataFrame, key: str, at: Column, max_commits: int = 2, quiet_days: int = 60, order: Sequence[str] = ()) -> DataFrame:
    """(key, commits, days_quiet): keys of few commits that were last touched long before the newest: in the row that comes last by order, else in the latest."""
    seconds = at.cast("timestamp").cast("long")
    own = df.groupBy(key).agg(F.count("*").alias("commits"), (F.max_by(seconds, F.struct(*order)) if order else F.max(seconds)).alias("last"))
    newest = own.agg(F.max("last").alias("newest"))
    quiet = own.join(F.broadcast(newest)).withColumn("days_quiet", F.floor((F.col("newest") - F.col("last")) / 86400))  # newest is one row
    return quiet.where((F.col("commits") <= max_commits) & (F.col("days_quiet") >= quiet_days)).select(key, "commits", "days_quiet")


def top_n_more(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with rank and more: how many rows the group has beyond n."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
    sizes = df.groupBy(*group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return ranked.join(sizes, list(group))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins: the row of each key that order puts last; a grouped maximum, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("row"))
    return best.select(*keys, "row.*")


def islands(df: DataFrame, keys: Sequence[str], low: Column, high: Column, gap: Column | None = None) -> DataFrame:
    """(keys..., island_start, island_end, n): ranges merged where one begins no later than the furthest end before it, plus gap."""
    spans = df.select(*keys, low.alias("lo"), high.alias("hi"))
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = before + gap if gap is not None else before
    marked = spans.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "island").agg(F.min("lo").alias("island_start"), F.max("hi").alias("island_end"), F.count("*").alias("n")).drop("island")


def ranked_members(members: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """members with rank within their group; rank 1 is where to resume."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def lineage(members: DataFrame, features: DataFrame, group: str, key: str, feature: str, staged: bool = False) -> DataFrame:
    """(group, key, step, added, carried, dropped) in order of size, then key: against all earlier members together.

    By first appearances: a member adds what first appears in it, carries the rest of its own, and
    drops what appeared before and is not its own. Counts only; no set is collected. Steps are staged, so that
    while they are small features meet them where they are. staged: features are a staged table of distinct rows.
    """
    own = features.select(F.col(key), F.col(feature).alias("f"))
    own = own if staged else own.distinct()
    sized = members.select(group, key).distinct().join(own.groupBy(key).agg(F.count("*").alias("size")), key)
    steps = stage_table(members.sparkSession, sized.withColumn("step", F.row_number().over(Window.partitionBy(group).orderBy("size", key))), "steps")
    placed = own.join(steps, key)
    first = placed.groupBy(group, "f").agg(F.min("step").alias("step"))
    added = first.groupBy(group, "step").agg(F.count("*").alias("added"))
    run = Window.partitionBy(group).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    joined = steps.join(added, [group, "step"], "left").withColumn("added", F.coalesce("added", F.lit(0)))
    joined = joined.withColumn("known", F.coalesce(F.sum("added").over(run), F.lit(0))).withColumn("carried", F.col("size") - F.col("added"))
    return joined.select(group, key, "step", "added", "carried", (F.col("known") - F.col("carried")).alias("dropped"))


def shared_features(members: DataFrame, features: DataFrame, group: str, key: str, feature: str, staged: bool = False) -> DataFrame:
    """(group, n_members, n_shared, n_common): features that two members have, and that all have. staged: features are a staged table of distinct rows."""
    own = members.select(group, key).distinct()
    sizes = own.groupBy(group).agg(F.count("*").alias("n_members"))
    held = own.join(features.select(key, feature) if staged else features.select(key, feature).distinct(), key).groupBy(group, feature).agg(F.count("*").alias("n"))
    flags = held.join(sizes, group).groupBy(group, "n_members").agg(F.sum((F.col("n") > 1).cast("long")).alias("n_shared"), F.sum((F.col("n") == F.col("n_members")).cast("long")).alias("n_common"))
    return flags


def quiet_rank(df: DataFrame, key: str, last: str) -> DataFrame:
    """(key, last, later): how many keys were touched strictly later. last: a time, or seconds.

    Distinct times are counted, then added up within their day and over days, so no task holds more than
    the times of one day or the days themselves.
    """
    day = F.floor(F.col(last).cast("double") / 86400) if dict(df.dtypes)[last] not in ("timestamp", "timestamp_ntz", "date") else F.unix_date(F.col(last).cast("date"))
    times = df.groupBy(last).agg(F.count("*").alias("n")).withColumn("day", day)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = times.groupBy("day").agg(F.sum("n").alias("n")).select("day", before(Window.orderBy(F.desc("day"))).alias("after"))
    later = times.withColumn("within", before(Window.partitionBy("day").orderBy(F.desc(last)))).join(days, "day").select(last, (F.col("after") + F.col("within")).alias("later"))
    return df.select(key, last).join(later, last)


def first_match(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def cap_with_count(df: DataFrame, cap: int) -> DataFrame:
    """(kept, skipped): one row."""
    n = F.count("*")
    return df.agg(F.least(n, F.lit(cap)).alias("kept"), F.greatest(n - cap, F.lit(0)).alias("skipped"))
