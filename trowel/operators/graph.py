"""Graph kernels over edge tables: layers, reachability, components, pointer chains, renames, cycles.

Loops run on the driver, rows do not: each round is a join, staged in the shared folder so that
lineage stays short and a lost executor costs one round. The driver sees counts. A graph of ONE_TASK
edges at most, which is counted first, takes all its rounds in one task instead of a job each; both
ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trowel.operators import relations
from trowel.session import ship_package, shuffle_parts, stage_table


#: Edges of a graph whose rounds are one task's work: a few megabytes, where a staged round costs more than all of them.
ONE_TASK = 20_000


def _few(edges: DataFrame) -> bool:
    return edges.limit(ONE_TASK + 1).count() <= ONE_TASK


def _in_one_task(rows: DataFrame, work: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """work over all rows, whose number has been checked."""
    ship_package(rows.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        given = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        found = list(work(given))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(kind)], kind.names)

    return rows.repartition(1).mapInArrow(run, schema)


def _kind(df: DataFrame) -> str:
    return df.schema[0].dataType.simpleString()


def _layers_here(rows: list[tuple]) -> Iterable[tuple]:
    """rows: (node, next), next null for roots."""
    ahead: dict = {}
    for a, b in rows:
        if b is not None:
            ahead.setdefault(a, []).append(b)
    depth = dict.fromkeys((a for a, b in rows if b is None), 0)
    now, n = list(depth), 0
    while now:
        n += 1
        now = list(dict.fromkeys(b for a in now for b in ahead.get(a, ()) if b not in depth))
        depth.update(dict.fromkeys(now, n))
    return depth.items()


def layers(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth): fewest edges from a root; roots have depth 0. Cycles are harmless.

    Each round joins only the new frontier with the edges and removes what was reached before.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct()
    start = roots.select(F.col(roots.columns[0]).alias("node")).where("node is not null").distinct()
    if _few(edges):
        return _in_one_task(links.union(start.withColumn("next", F.lit(None).cast(links.schema[1].dataType))), _layers_here, f"node {_kind(links)}, depth int")
    links = stage_table(spark, links, "links")  # read in each round
    frontier = stage_table(spark, start.withColumn("depth", F.lit(0)), "layer")
    reached, depth = frontier, 0
    while frontier.take(1):
        depth += 1
        ahead = frontier.select("node").join(links, "node").select(F.col("next").alias("node")).distinct()
        frontier = stage_table(spark, ahead.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "layer")
        reached = reached.union(frontier)
    return reached


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node): the roots and everything that edges lead to from them."""
    return layers(edges, roots, src, dst).select("node")


def trace(edges: DataFrame, seed: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(direction, node, depth): 'uses' downwards and 'used_by' upwards from the seed; the seed itself has depth 0 in both."""
    down = layers(edges, seed, src, dst).select(F.lit("uses").alias("direction"), "node", "depth")
    up = layers(edges, seed, dst, src).select(F.lit("used_by").alias("direction"), "node", "depth")
    return down.union(up)


#: Edges of a node, at least, for which a plan of its own pays: a task sorts fewer of them at once.
HUB_EDGES = 20_000


def _round_by_windows(now: DataFrame) -> DataFrame:
    """One large-star and small-star step where no node is a hub: three shuffles, each of which holds a node's edges in one task."""
    both = now.union(now.select("y", "x")).toDF("u", "v")
    low = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
    large = both.withColumn("m", low).where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    small = large.withColumn("m", F.min("y").over(Window.partitionBy("x")))
    edges = F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))
    return small.select(F.explode(edges).alias("e")).select("e.x", "e.y").where("x <> y").distinct()


def _round_by_joins(now: DataFrame, limit: int) -> DataFrame:
    """The same where some are: minima are combined before the shuffle, and edges of hubs meet them where they are."""
    both = now.union(now.select("y", "x")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    large = relations.join_hot(both.where("v > u"), "u", low, limit).select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
    least = large.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
    small = relations.join_hot(large, "x", least, limit).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return small.union(least.select("x", "m")).distinct()


def _stars_here(rows: list[tuple]) -> Iterable[tuple]:
    top: dict = {}

    def find(x):
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for a, b in rows:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [(x, low) for x in list(top) if (low := find(x)) != x]


def stars(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component) for every node but the smallest of its component.

    Large-star and small-star steps in turn, about log(n) rounds, each staged in the shared folder, until
    every node is the centre of a star or has one edge, to a centre. Loops, nulls and repeated edges are
    ignored. The driver sees three numbers a round.
    """
    spark = edges.sparkSession
    now = stage_table(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "star")
    if _few(now):
        return _in_one_task(now, _stars_here, f"node {_kind(now)}, component {_kind(now)}")
    while True:
        ends = now.select(F.col("x").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("y", F.lit(0), F.lit(1)))
        degrees = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        sign = degrees.agg(F.sum("up").alias("n"), F.max(F.col("up") + F.col("down")).alias("most"), F.count_if(F.expr("up > 1 or (up = 1 and down > 0)")).alias("open")).first()
        if not sign["open"]:
            return now.select(F.col("x").alias("node"), F.col("y").alias("component"))
        limit = relations.hot_limit(2 * sign["n"], shuffle_parts(spark), HUB_EDGES)
        now = stage_table(spark, _round_by_joins(now, limit) if sign["most"] > limit else _round_by_windows(now), "star")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge: component is its smallest node."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    return nodes.join(stars(pairs).withColumnRenamed("component", "low"), "node", "left").select("node", F.coalesce("low", "node").alias("component"))


def _greedy_here(rows: list[tuple]) -> Iterable[tuple]:
    first: dict = {}
    members: dict[tuple, None] = {}
    for a, b in sorted(rows):
        home = min(first.get(a, (a, b)), first.get(b, (a, b)))
        for k in (a, b):
            first[k] = home
            members[(*home, k)] = None
    return members


def greedy_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(first_a, first_b, member): pairs in order join the first group that holds either of theirs, or begin one; groups are never merged. A group is named by the pair that began it.

    A pair's group is the least pair from which a way of ever later pairs, each with an end in common with the next,
    leads to it. Rounds: along each end, in order, the least group so far; then the lesser of a pair's two ends; until
    nothing changes. A hub's pairs are one pass of a window, so it takes as many rounds as ways change ends.
    """
    spark = pairs.sparkSession
    now = stage_table(spark, pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct(), "greedy")
    if _few(now):
        return _in_one_task(now, _greedy_here, f"first_a {_kind(now)}, first_b {_kind(now)}, member {_kind(now)}")
    now = now.withColumn("home", F.struct("a", "b"))
    earlier = Window.partitionBy("end").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        ends = now.select("*", F.explode(F.array("a", "b")).alias("end")).withColumn("low", F.min("home").over(earlier))
        moved = ends.groupBy("a", "b", "home").agg(F.min("low").alias("new"))
        moved = stage_table(spark, moved.select("a", "b", F.col("new").alias("home"), (F.col("new") < F.col("home")).alias("moves")), "greedy")
        now = moved.drop("moves")
        if not moved.where("moves").take(1):
            return now.select(F.col("home.a").alias("first_a"), F.col("home.b").alias("first_b"), F.explode(F.array("a", "b")).alias("member")).distinct()


def _chase_here(rows: list[tuple]) -> Iterable[tuple]:
    to = dict(rows)
    for node in to:
        at, seen = node, set()
        while at in to and at not in seen:
            seen.add(at)
            at = to[at]
        yield node, at


def _jump(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follows step(node, to) until nothing moves, or for more steps than there are rows: where each node is, and those that are on a cycle (node)."""
    spark, longest = step.sparkSession, max(2, step.count())
    for _ in range(longest.bit_length() + 1):
        moved = step.join(step.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moves"))
        moved = stage_table(spark, moved, "chase")
        step = moved.drop("moves")
        if not moved.where("moves").take(1):
            return step, step.select("node").limit(0)
    return step, moved.where("moves").select(F.col("to").alias("node")).distinct()


def pointer_chase(links: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(node, canonical): follows old -> new to the end by doubling; what leads to a cycle ends where it meets it, a node of a cycle at itself.

    Of several rows for one old, the largest new wins.
    """
    step = links.groupBy(F.col(old).alias("node")).agg(F.max(new).alias("to")).where("node is not null and to is not null")
    step = stage_table(links.sparkSession, step, "chase")
    if _few(step):
        return _in_one_task(step, _chase_here, f"node {_kind(step)}, canonical {_kind(step)}")
    ends, ring = _jump(step)
    if not ring.take(1):
        return ends.select("node", F.col("to").alias("canonical"))
    ends, _ = _jump(stage_table(step.sparkSession, step.join(ring, "node", "left_anti"), "chase"))  # without what leaves a cycle's nodes
    return ends.select("node", F.col("to").alias("canonical")).union(ring.select("node", "node"))


def rename_chain(renames: DataFrame, old: str = "old", new: str = "new", ord: str = "ord") -> DataFrame:
    """(node, canonical): what each old name is called after renames in the order of ord, a number of each, oldest first.

    A name is valid from the rename that gave it to the next that takes it away, so each rename leads to the
    first later one of its new name; what a name became is the end of the chain that begins with its last
    rename. Where that end is a name that was renamed itself before, the chain is followed on from there, as
    of pointers; a name that comes back to itself ends there.
    """
    spark = renames.sparkSession
    steps = stage_table(spark, renames.select(F.col(ord).alias("ord"), F.col(old).alias("old"), F.col(new).alias("new")).where("old is not null and new is not null").distinct(), "renames")
    # an as-of join to the next rename of the same name: both kinds of rows in one order a name
    events = steps.select(F.col("old").alias("name"), "ord", F.col("ord").alias("event"), F.lit(False).alias("asks"))
    asked = steps.select(F.col("new").alias("name"), "ord", F.lit(None).cast("long").alias("event"), F.lit(True).alias("asks"))
    # from the last one back, so that a frame only grows: to an end that is ahead, each row would read all that follow it
    following = Window.partitionBy("name").orderBy(F.desc("ord")).rangeBetween(Window.unboundedPreceding, -1)
    nexts = events.union(asked).withColumn("next", F.last("event", ignorenulls=True).over(following)).where("asks and next is not null")
    ends = pointer_chase(nexts.select(F.col("ord").alias("old"), F.col("next").alias("new"))).toDF("ord", "end")
    last = steps.groupBy("old").agg(F.max("ord").alias("ord")).join(ends, "ord", "left").select("old", F.coalesce("end", "ord").alias("ord"))
    return pointer_chase(last.join(steps.select("ord", "new"), "ord").select("old", "new"))


def _core_here(rows: list[tuple]) -> Iterable[tuple]:
    left = set(rows)
    while True:
        sources, targets = {a for a, _ in left}, {b for _, b in left}
        kept = {(a, b) for a, b in left if a in targets and b in sources}
        if len(kept) == len(left):
            return kept
        left = kept


def cyclic_core(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that remain when nodes without way in or out are peeled off again and again: all cycles, and paths between them."""
    spark = edges.sparkSession
    core = stage_table(spark, edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct(), "core")
    if _few(core):
        return stage_table(spark, _in_one_task(core, _core_here, f"src {_kind(core)}, dst {_kind(core)}"), "core")
    left = core.count()
    while left:
        core = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        core = core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        core = stage_table(spark, core, "core")
        now = core.count()
        if now == left:
            break
        if now <= ONE_TASK:
            return stage_table(spark, _in_one_task(core, _core_here, f"src {_kind(core)}, dst {_kind(core)}"), "core")
        left = now
    return core


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of nodes on cycles: component is the greatest node of those that lead to each other.

    Nodes with edges both ways between them are one component's, so they are one node for what follows: where all
    cycles are of this kind, nothing is left when the rest is trimmed.
    """
    spark = edges.sparkSession
    links = stage_table(spark, edges.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).where("src is not null and dst is not null").distinct(), "links")
    both = links.where("src < dst").join(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    held = stage_table(spark, components(both, "src", "dst"), "held")
    of = lambda end: held.toDF(end, f"{end}_held")
    joined = links.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    rest = joined.select(F.coalesce("src_held", "src").alias("src"), F.coalesce("dst_held", "dst").alias("dst")).where("src <> dst").distinct()
    rings = _strong_by_colours(rest).toDF("group", "ring")
    nodes = held.select("node", F.col("component").alias("group"), F.lit(True).alias("sure"))
    loops = links.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("group"), F.lit(True).alias("sure"))
    lone = rings.select(F.col("group").alias("node"), "group", F.lit(False).alias("sure"))
    every = nodes.union(loops.join(held, "node", "left_anti")).union(lone.join(held, "node", "left_anti")).groupBy("node", "group").agg(F.max("sure").alias("sure"))
    placed = stage_table(spark, every.join(rings, "group", "left").where("sure or ring is not null").select("node", F.coalesce("ring", "group").alias("ring")), "strong")
    return placed.join(placed.groupBy("ring").agg(F.max("node").alias("component")), "ring").select("node", "component")


def _strong_by_colours(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of nodes on cycles of several nodes.

    Trimmed first. Then the greatest node that leads to each one colours it, and of a colour's nodes those that
    lead back to the one that gave it are a component; what is left is trimmed and coloured again.
    """
    spark, left, parts = edges.sparkSession, cyclic_core(edges, src, dst), []
    while left.take(1):
        colours = stage_table(spark, left.select("src").union(left.select("dst")).distinct().select(F.col("src").alias("node"), F.col("src").alias("colour")), "colour")
        moved = colours
        while moved.take(1):
            ahead = left.join(moved.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            moved = stage_table(spark, ahead.join(colours, "node").where("new > colour").select("node", F.col("new").alias("colour")), "colour")
            colours = stage_table(spark, colours.join(moved.withColumnRenamed("colour", "new"), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")), "colour")
        inside = left.join(colours.toDF("src", "c"), "src").join(colours.toDF("dst", "d"), "dst").where("c = d").select("src", "dst")
        back = layers(stage_table(spark, inside, "inside"), colours.where("node = colour").select("node"), "dst", "src")
        found = stage_table(spark, back.select("node").join(colours, "node"), "strong")
        parts.append(found)
        rest = relations.without(left, found.select(F.col("node").alias("src")), found.select(F.col("node").alias("dst")))
        left = cyclic_core(rest)
    every = parts[0] if parts else left.select(F.col("src").alias("node"), F.col("src").alias("colour"))
    for part in parts[1:]:
        every = every.union(part)
    sizes = every.groupBy("colour").agg(F.count("*").alias("n"))
    return every.join(sizes.where("n > 1"), "colour", "left_semi").select("node", "colour").toDF("node", "component")


def depth_first(ahead: dict, roots: Iterable, inside: set | None = None) -> tuple[list[list], list]:
    """Cycles and exits in depth-first order, next nodes sorted: of each back edge the stack from its target on, with the target again at the end, each list once; exits are edges to nodes outside."""
    state: dict = {}  # 1 on the stack, 2 done
    found: dict[tuple, None] = {}
    exits = []
    for root in roots:
        if root in state:
            continue
        path, place, pending = [root], {root: 0}, [iter(sorted(ahead.get(root, ())))]
        state[root] = 1
        while path:
            node = next(pending[-1], None)
            if node is None:
                done = path.pop()
                state[done] = 2
                del place[done]
                pending.pop()
            elif inside is not None and node not in inside:
                exits.append(node)
            elif state.get(node) == 1:
                found[(*path[place[node] :], node)] = None
            elif node not in state:
                state[node], place[node] = 1, len(path)
                path.append(node)
                pending.append(iter(sorted(ahead.get(node, ()))))
    return [list(c) for c in found], exits


def _cycles_here(rows: list[tuple]) -> Iterable[tuple]:
    ahead: dict = {}
    for a, b in rows:
        ahead.setdefault(a, []).append(b)
    return [(c,) for c in depth_first(ahead, sorted(ahead))[0]]


def _component_orders(spark_edges: DataFrame, entries: DataFrame, what: str) -> DataFrame:
    """Depth-first order of each component from its entry, a task each. what: cycles (nodes), or exits (component, label, next)."""
    schema = "nodes array<string>" if what == "cycles" else "unit string, label string, next string"

    def order(key, edges: pa.Table, entry: pa.Table) -> pa.Table:
        rows = list(zip(*(edges.column(c).to_pylist() for c in ("src", "dst", "own")), strict=True))
        ahead: dict = {}
        for a, b, _ in rows:
            ahead.setdefault(a, []).append(b)
        cycles, exits = depth_first(ahead, entry.column("entry").to_pylist()[:1], {a for a, _, _ in rows} | {b for _, b, own in rows if own})
        if what == "cycles":
            return pa.table({"nodes": pa.array(cycles, pa.list_(pa.string()))})
        first = dict.fromkeys(exits)
        return pa.table({"unit": pa.array([key[0].as_py()] * len(first), pa.string()), "label": pa.array([f"{n:012d}" for n in range(len(first))], pa.string()), "next": pa.array(list(first), pa.string())})

    return spark_edges.groupBy("unit").cogroup(entries.groupBy("unit")).applyInArrow(order, schema)


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(nodes): cycles as a depth-first walk over all nodes in order meets them, next nodes sorted: for each back edge the stack from its target on, the target again at the end; each list once.

    Beyond ONE_TASK edges: within a strong component the walk depends only on the node at which it enters, as
    whatever else it meets there does not come back. Between components, which have no cycles, a walk comes first
    to where the least way leads: [root, label, label, ..], a label being the place of an edge in the order in
    which its component's walk takes it. Ways and entries are renewed, in rounds, until none changes: as many rounds
    as components lie behind each other. Only what leads to a cycle takes part.
    """
    spark = edges.sparkSession
    links = stage_table(spark, edges.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).where("src is not null and dst is not null").distinct(), "links")
    if _few(links):
        return _in_one_task(links, _cycles_here, "nodes array<string>")
    strong = stage_table(spark, strong_components(links), "strong")
    return _cycles_of(links, strong, strong)


def count_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> int:
    """Rows of cycles. Of a component of two nodes a walk meets one cycle, and one for each edge from a node to itself, wherever it enters; so ways are only asked for to larger ones."""
    spark = edges.sparkSession
    links = stage_table(spark, edges.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).where("src is not null and dst is not null").distinct(), "links")
    if _few(links):
        return cycles(links).count()
    strong = stage_table(spark, strong_components(links), "strong")
    sizes = stage_table(spark, strong.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    small = sizes.where("n <= 2")
    loops = links.where("src = dst").select(F.col("src").alias("node")).join(strong, "node").join(small, "component", "left_semi")
    large = stage_table(spark, strong.join(sizes.where("n > 2"), "component", "left_semi").select("node", "component"), "strong")
    return small.where("n = 2").count() + loops.count() + _cycles_of(links, strong, large).count()


def _cycles_of(links: DataFrame, strong: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nodes): cycles within the wanted of the strong components, all of which are given."""
    spark = links.sparkSession
    if not wanted.take(1):
        return wanted.select(F.array("node").alias("nodes")).limit(0)
    before = layers(links, wanted.select("node"), "dst", "src").select("node")
    units = stage_table(spark, before.join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("unit"), F.col("component").isNotNull().alias("ring")), "units")
    of = lambda end: units.toDF(end, f"{end}_unit", f"{end}_ring")
    known = stage_table(spark, links.join(of("src"), "src").join(of("dst"), "dst"), "known")
    plain = known.where("not src_ring").select(F.col("src_unit").alias("unit"), F.col("dst").alias("label"), F.col("dst").alias("next"), "dst_unit")
    asked = wanted.select(F.col("component").alias("unit")).distinct()
    rings = stage_table(spark, known.where("src_ring").select(F.col("src_unit").alias("unit"), "src", "dst", (F.col("src_unit") == F.col("dst_unit")).alias("own")), "rings")
    own = units.groupBy("unit").agg(F.min("node").alias("entry")).select("unit", F.array("entry").alias("way"), "entry")
    ways = stage_table(spark, own, "ways")
    while True:
        exits = _component_orders(rings, ways.join(rings.select("unit").distinct(), "unit", "left_semi").select("unit", "entry"), "exits")
        steps = plain.union(exits.join(units.toDF("next", "dst_unit", "ring"), "next").select("unit", "label", "next", "dst_unit"))
        led = steps.join(ways, "unit").select(F.col("dst_unit").alias("unit"), F.concat("way", F.array("label")).alias("way"), F.col("next").alias("entry"))
        new = stage_table(spark, own.union(led).groupBy("unit").agg(F.min(F.struct("way", "entry")).alias("m")).select("unit", "m.way", "m.entry"), "ways")
        changed = new.join(ways.toDF("unit", "old", "old_entry"), "unit").where("way <> old or entry <> old_entry")
        ways, done = new, not changed.take(1)
        if done:
            return _component_orders(rings.where("own").join(asked, "unit", "left_semi"), ways.join(asked, "unit", "left_semi").select("unit", "entry"), "cycles").distinct()


def fan(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in, fan_out) in one shuffle: both ends of each edge counted together."""
    out = edges.select(F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = edges.select(F.col(dst).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    return out.union(into).groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
