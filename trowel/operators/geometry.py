"""Geometry of maps as columns: cards on grids, folders as boxes, ribbons between boxes, layers as rows.

What is a formula of a row or of its place in a group is a column. Sweeps go on from one layer to the next: in one task
for few edges, else as a staged round a layer, or for several small ones. Shelves are a loop over the boxes that a map can show.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trowel.operators import graph
from trowel.session import stage_table

#: Sizes of a folder map, in pixels.
CHART_W, BOX_PAD, BOX_LABEL_H, BOX_GAP = 1350, 11, 25, 14
CARD_W, CARD_H, CARD_GAP = 152, 72, 10
LABEL_CHAR_W, LABEL_MORE_W = 7.4, 120
#: Sizes of a layered map, in pixels, and cards in a row of it.
NODE_W, NODE_H, X_GAP, Y_GAP, MARGIN, ROW_MAX = 138, 66, 24, 30, 28, 8
#: Times the edges of graph.ONE_TASK that one task takes in one sweep, which is less work than all rounds of a graph.
SWEPT_AT_ONCE = 10
#: Sweeps over the layers; a ribbon's distance from its boxes, bow and weight.
SWEEPS = 6
RIBBON_OFF, BOW_SHARE, BOW_MOST = 3, 0.16, 64.0
WEIGHT_BASE, WEIGHT_LOG, WEIGHT_MOST = 1.3, 0.9, 6.0


def columns_in(width: Column) -> Column:
    """Cards that fit side by side."""
    return F.greatest(F.lit(1), F.floor((width + CARD_GAP) / (CARD_W + CARD_GAP)).cast("int"))


def boxes(modules: DataFrame, chart_w: int = CHART_W) -> DataFrame:
    """modules(key, relpath, folder, loc) -> (folder, modules, loc, columns, w, h): a box that holds a folder's cards and its label."""
    sizes = modules.groupBy("folder").agg(F.count("*").alias("modules"), F.sum("loc").alias("loc"))
    label = columns_in(F.floor(F.length("folder") * LABEL_CHAR_W + LABEL_MORE_W))
    most = columns_in(F.lit(chart_w - 2 * BOX_PAD))
    columns = F.least(most, F.greatest(F.col("modules").cast("int"), label))
    rows = F.ceil(F.col("modules") / F.col("columns"))
    w = F.col("columns") * (CARD_W + CARD_GAP) - CARD_GAP + 2 * BOX_PAD
    h = rows * (CARD_H + CARD_GAP) - CARD_GAP + BOX_LABEL_H + 2 * BOX_PAD
    return sizes.withColumn("columns", columns).select("folder", "modules", "loc", "columns", w.cast("int").alias("w"), h.cast("int").alias("h"))


def cards(modules: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, folder, x, y): cards in their folder's grid, the largest first. placed: (folder, columns, x, y) of the boxes."""
    order = Window.partitionBy("folder").orderBy(F.desc("loc"), "relpath")
    at = modules.withColumn("i", F.row_number().over(order) - 1).join(placed.select("folder", "columns", F.col("x").alias("box_x"), F.col("y").alias("box_y")), "folder")
    x = F.col("box_x") + BOX_PAD + F.expr("i % columns") * (CARD_W + CARD_GAP)
    y = F.col("box_y") + BOX_LABEL_H + BOX_PAD + F.expr("i div columns") * (CARD_H + CARD_GAP)
    return at.select("key", "folder", x.cast("int").alias("x"), y.cast("int").alias("y"))


def shelve(rows: list[tuple[str, int, int]], chart_w: int = CHART_W) -> list[tuple[str, int, int]]:
    """(folder, x, y) of boxes (folder, w, h) in order, side by side until a shelf is full."""
    out, x, y, tall = [], 0, 0, 0
    for folder, w, h in rows:
        if x and x + w > chart_w:
            x, y, tall = 0, y + tall + BOX_GAP, 0
        out.append((folder, x, y))
        x, tall = x + w + BOX_GAP, max(tall, h)
    return out


def ribbon_paths(ribbons: DataFrame, placed: DataFrame) -> DataFrame:
    """ribbons(src_folder, dst_folder, n) with the curve from border to border of their boxes (sx, sy, mx, my, ex, ey) and its weight.

    placed: (folder, x, y, w, h). A ribbon bows to one side of its direction, so the two of a pair part.
    """
    box = lambda side: placed.select(F.col("folder").alias(f"{side}_folder"), (F.col("x") + F.col("w") / 2).alias(f"{side}_cx"), (F.col("y") + F.col("h") / 2).alias(f"{side}_cy"), F.col("w").alias(f"{side}_w"), F.col("h").alias(f"{side}_h"))
    joined = ribbons.join(box("src"), "src_folder").join(box("dst"), "dst_folder")
    far = F.lit(float("inf"))

    def border(side: str, other: str) -> tuple[Column, Column]:
        dx, dy = F.col(f"{other}_cx") - F.col(f"{side}_cx"), F.col(f"{other}_cy") - F.col(f"{side}_cy")
        reach = lambda d, size: F.when(d != 0, (F.col(f"{side}_{size}") / 2 + RIBBON_OFF) / F.abs(d)).otherwise(far)
        scale = F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.least(reach(dx, "w"), reach(dy, "h")))
        return F.col(f"{side}_cx") + dx * scale, F.col(f"{side}_cy") + dy * scale

    (sx, sy), (ex, ey) = border("src", "dst"), border("dst", "src")
    ends = joined.select("src_folder", "dst_folder", "n", sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"))
    span = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    bowed = ends.withColumn("span", F.when(span == 0, 1.0).otherwise(span)).withColumn("bow", F.least(F.lit(BOW_MOST), F.col("span") * BOW_SHARE))
    mx = (F.col("sx") + F.col("ex")) / 2 - (F.col("ey") - F.col("sy")) / F.col("span") * F.col("bow")
    my = (F.col("sy") + F.col("ey")) / 2 + (F.col("ex") - F.col("sx")) / F.col("span") * F.col("bow")
    weight = F.least(F.lit(WEIGHT_MOST), WEIGHT_BASE + F.log2(F.col("n") + 1) * WEIGHT_LOG)
    return bowed.select("src_folder", "dst_folder", "n", "sx", "sy", mx.alias("mx"), my.alias("my"), "ex", "ey", weight.alias("weight"))


def _sweeps_here(rows: list[tuple]) -> Iterable[tuple]:
    """rows: (node, depth, null) of nodes and (node, null, next) of edges."""
    order: dict[int, list[str]] = defaultdict(list)
    near: dict[bool, dict[str, list[str]]] = {True: defaultdict(list), False: defaultdict(list)}
    for a, depth, b in rows:
        if b is None:
            order[depth].append(a)
        else:
            near[True][b].append(a)
            near[False][a].append(b)
    for names in order.values():
        names.sort()
    depths = sorted(order)
    for sweep in range(SWEEPS):
        down = sweep % 2 == 0
        for d in depths[1:] if down else depths[-2::-1]:
            place = {n: i for i, n in enumerate(order.get(d - 1 if down else d + 1, ()))}
            seen = {n: [place[m] for m in near[down].get(n, ()) if m in place] for n in order[d]}
            if place:
                order[d].sort(key=lambda n: (sum(seen[n]) / len(seen[n]) if seen[n] else float("inf"), n))
    return [(n, d, i) for d, names in order.items() for i, n in enumerate(names)]


def _sweep_here(first: int | None, down: bool) -> Callable[[list[tuple]], Iterable[tuple]]:
    """One sweep over layers that are next to each other; first: the one that is met first, where it has none before it."""

    def sweep(rows: list[tuple]) -> Iterable[tuple]:
        """rows: (node, depth, place, null, null) of nodes, (node, null, null, near, null) of links between these layers, and (node, null, null, null, seen) of links with the layer before them."""
        own: dict[int, list[tuple]] = defaultdict(list)
        near, seen = defaultdict(list), defaultdict(list)
        for node, depth, place, before, at in rows:
            if depth is not None:
                own[depth].append((place, node))
            elif before is not None:
                near[node].append(before)
            else:
                seen[node].append(at)
        for d in sorted(own, reverse=not down):
            names, at = [n for _, n in sorted(own[d])], {}
            if d != first:
                for n in names:
                    at[n] = seen[n] + [places[m] for m in near[n]] if n in near else seen.get(n)  # noqa: F821
                names.sort(key=lambda n: (sum(at[n]) / len(at[n]) if at[n] else float("inf"), n))
            places = {n: i for i, n in enumerate(names)}
            yield from ((n, d, i) for i, n in enumerate(names))

    return sweep


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df of any size with place, the number of each row in order: sorted by ranges, whose numbers of rows are then added up."""
    rows = df.orderBy(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = stage_table(df.sparkSession, rows, "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).select("part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "part").select(*df.columns, (F.col("start") + F.col("at") - F.col("low")).cast("int").alias("place"))


def sweep_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth, place) of nodes(node, depth): each layer in order of the mean place of its neighbours in the layer before (every second sweep: after), then by name; without neighbours last. edges(src, dst)."""
    spark, schema = nodes.sparkSession, "node string, depth int, place int"
    links = stage_table(spark, edges.select("src", "dst").distinct(), "links")
    own = nodes.select("node", F.col("depth").cast("int").alias("depth"))
    if graph._few(links.select("src").union(own.select("node"))):
        rows = own.select("node", "depth", F.lit(None).cast("string").alias("next")).union(links.select("src", F.lit(None).cast("int"), "dst"))
        return graph._in_one_task(rows, _sweeps_here, schema)
    own = stage_table(spark, own, "nodes")
    far = own.select(F.col("node").alias("dst"), F.col("depth").alias("dst_depth"))
    steps = stage_table(spark, links.join(own.withColumnRenamed("node", "src"), "src").join(far, "dst").where("dst_depth = depth + 1").select("src", "dst", "depth"), "steps")
    held = {r.depth: r.n for r in own.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # a row a layer
    linked = {r.depth: r.n for r in steps.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # a row a layer
    # layers next to each other that are one task's work together, else a layer each
    blocks: list[tuple[int, int]] = []
    many, most = 0, SWEPT_AT_ONCE * graph.ONE_TASK
    for d in sorted(held):
        more = held[d] + linked.get(d, 0)
        if blocks and blocks[-1][1] == d - 1 and many + more <= most:
            blocks[-1], many = (blocks[-1][0], d), many + more
        else:
            blocks.append((d, d))
            many = more + linked.get(d - 1, 0)
    small = [sum(held[d] + linked.get(d, 0) for d in range(low, high + 1)) + linked.get(low - 1, 0) <= most for low, high in blocks]
    placed = []
    for low, high in blocks:
        here = own.where(F.col("depth").between(low, high))
        # a layer alone may be of any size; several are few rows
        ranks = ranked(here, [F.asc("node")]) if low == high else here.withColumn("place", F.row_number().over(Window.partitionBy("depth").orderBy("node")) - 1)
        placed.append(stage_table(spark, ranks, "sweep"))
    by_name = list(placed)
    for sweep in range(SWEEPS):
        down = sweep % 2 == 0
        near, far = ("src", "dst") if down else ("dst", "src")
        for k in range(len(blocks)) if down else reversed(range(len(blocks))):
            (low, high), last = blocks[k], k - 1 if down else k + 1
            first, meets = (low, low - 1) if down else (high, high + 1)
            if low == high and meets not in held:
                continue
            if low == high and not linked.get(min(first, meets)):
                placed[k] = by_name[k]
                continue
            seen = None
            if meets in held:
                there = placed[last].where(F.col("depth") == meets).select(F.col("node").alias(near), F.col("place").alias("seen"))
                seen = steps.where(F.col("depth") == min(first, meets)).join(there, near).select(F.col(far).alias("node"), "seen")
            if small[k]:
                null = F.lit(None)
                rows = placed[k].select("node", "depth", "place", null.cast("string").alias("near"), null.cast("int").alias("seen"))
                inner = steps.where(F.col("depth").between(low, high - 1)).select(F.col(far).alias("node"), null.cast("int"), null.cast("int"), F.col(near), null.cast("int"))
                rows = rows.union(inner) if seen is None else rows.union(inner).union(seen.select("node", null.cast("int"), null.cast("int"), null.cast("string"), "seen"))
                moved = graph._in_one_task(rows, _sweep_here(None if seen is not None else first, down), schema)
            else:
                mean = seen.groupBy("node").agg(F.avg("seen").alias("mean"))
                moved = ranked(placed[k].drop("place").join(mean, "node", "left"), [F.asc_nulls_last("mean"), F.asc("node")]).drop("mean")
            placed[k] = stage_table(spark, moved, "sweep")
    return reduce(DataFrame.union, placed)


def layered(nodes: DataFrame, unreached: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (key, x, y, depth, apart) of nodes(node, depth) in rows by layer, the unreached(key) apart below; and elbows (src, dst, back, x1, y1, mid, x2, y2) of edges(src, dst), those against the grain marked back."""
    spark = nodes.sparkSession
    deepest = nodes.agg(F.coalesce(F.max("depth") + 1, F.lit(0)).cast("int").alias("depth"))
    pool = unreached.select(F.col("key").alias("node")).join(F.broadcast(deepest)).withColumn("apart", F.lit(True))  # deepest is one row
    every = stage_table(spark, nodes.select("node", "depth", F.lit(False).alias("apart")).unionByName(pool), "layers")
    placed = sweep_layers(every, edges)
    rows = every.groupBy("depth", "apart").agg(F.count("*").alias("n"))
    before = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)  # a row a layer
    first = F.coalesce(F.sum(F.ceil(F.col("n") / ROW_MAX)).over(before), F.lit(0)) + F.when(F.col("apart") & (F.col("depth") > 0), 1).otherwise(0)
    layer = rows.select("depth", "apart", "n", first.alias("first"), F.least(F.max("n").over(Window.partitionBy()), F.lit(ROW_MAX)).alias("widest"))
    line, column = F.floor(F.col("place") / ROW_MAX), F.col("place") % ROW_MAX
    indent = (F.col("widest") - F.least(F.col("n") - line * ROW_MAX, F.lit(ROW_MAX))) * (NODE_W + X_GAP) / 2
    at = placed.join(F.broadcast(layer), "depth")  # a row a layer
    spots = stage_table(spark, at.select(F.col("node").alias("key"), (MARGIN + indent + column * (NODE_W + X_GAP)).cast("double").alias("x"), (MARGIN + (F.col("first") + line) * (NODE_H + Y_GAP)).cast("double").alias("y"), "depth", "apart"), "spots")
    end = lambda side: spots.select(F.col("key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("x", "y", "depth")))
    ends = edges.select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst").withColumn("back", F.col("dst_depth") <= F.col("src_depth"))
    y1 = F.when(F.col("back"), F.col("src_y")).otherwise(F.col("src_y") + NODE_H)
    y2 = F.when(F.col("back"), F.col("dst_y") + NODE_H).otherwise(F.col("dst_y"))
    return spots, ends.select("src", "dst", "back", (F.col("src_x") + NODE_W / 2).alias("x1"), y1.alias("y1"), ((y1 + y2) / 2).alias("mid"), (F.col("dst_x") + NODE_W / 2).alias("x2"), y2.alias("y2"))
