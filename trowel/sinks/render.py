"""Sinks over small result tables: what is drawn or printed is limited before it reaches the driver."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trowel.functions import text as T
from trowel.operators import geometry, summaries
from trowel.plans.survey import Survey
from trowel.session import ship_package, stage_table
from trowel.sinks.shelf import read_register, record_map, write_shelf
from trowel.sinks.svgmap import COLOURS, html_map

__all__ = ["as_dict", "drawio", "frontier_blocks", "frontier_text", "html_map", "mermaid", "read_register", "record_map", "summary", "unwritable", "window_rows", "write_json", "write_shelf", "write_tables"]

SECTIONS = {
    "modules": lambda s: s.modules.select("key", "relpath", "loc", "blank", "comment_lines", "error", "has_main_guard"),
    "edges": lambda s: s.edges,
    "external": lambda s: s.external,
    "entry_points": lambda s: s.entry_points,
    "loaded_by": lambda s: s.loaded_by,
    "layers": lambda s: s.layers,
    "orphans": lambda s: s.orphans.select("key", "loc"),
    "unreferenced": lambda s: s.unreferenced,
    "cycles": lambda s: s.import_cycles.orderBy("nodes"),
    "cyclic_edges": lambda s: s.cycles,
    "fan": lambda s: s.fan,
    "effects": lambda s: s.effects,
    "frontier": lambda s: s.frontier.orderBy(F.desc("score"), "relpath"),
    "signals": lambda s: s.signals.orderBy("key", "kind", "lineno", "text"),
    "evidence": lambda s: s.evidence.orderBy("src", "dst", "lineno"),
    "totals": lambda s: s.totals.orderBy(F.desc("n"), "kind"),
    "attempts": lambda s: s.attempt_groups.orderBy(F.col("verdict") == "copy", F.desc("at_stake_lines"), F.size("members").desc(), "resume_at"),
    "dead_ends": lambda s: s.dead_ends.orderBy(F.desc("calls"), "key", "lineno"),
    "callers": lambda s: s.callers.orderBy("name", "module", "lineno", "as"),
    "left_behind": lambda s: s.salvage.orderBy(F.desc("loc"), "key"),
    "origins": lambda s: s.origins,
    "origin_totals": lambda s: s.origin_totals.orderBy(F.desc("lines")),
    "salvage_totals": lambda s: s.salvage_totals.orderBy(F.desc("lines")),
    "dead_ends_by_module": lambda s: s.dead_ends_by_module.orderBy("key"),
    "verdicts": lambda s: s.verdicts.orderBy("key"),
    "attempt_sentences": lambda s: s.attempt_sentences,
    "held_back": lambda s: s.held_back.orderBy(F.desc("modules"), "loader"),
    "state_tally": lambda s: s.state_tally,
    "line_marks": lambda s: s.line_marks.orderBy("key", "lineno"),
    "regions": lambda s: s.regions.orderBy("key", "low"),
    "snippets": lambda s: s.snippets.orderBy("key", "low"),
    "scaffolds": lambda s: s.scaffolds.orderBy("key", "lineno"),
    "totals_by_layer": lambda s: s.layers.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth"),
    "clusters": lambda s: s.clusters.orderBy(F.desc("loc")),
    "states": lambda s: s.states,
    "folders": lambda s: s.folders,
    "ribbons": lambda s: s.ribbons.orderBy(F.desc("n"), "src_folder", "dst_folder"),
}
HISTORY = {
    "file_history": lambda s: s.file_history,
    "co_change": lambda s: s.co_change.orderBy(F.desc("n"), "item_a", "item_b").limit(40),
    "timeline": lambda s: s.timeline.orderBy("month"),
    "timeline_files": lambda s: s.timeline_files.orderBy("month", "path"),
    "authors": lambda s: s.authors.orderBy(F.desc("commits"), "author"),
    "stalled": lambda s: s.stalled.orderBy(F.desc("days_quiet"), "path"),
    "forks": lambda s: s.forks.orderBy("stopped", "continued"),
}


#: Sections that are made and read at a time: most of their time is planning and waiting for small jobs.
CONCURRENT = 12


def unwritable(paths: Iterable[str]) -> list[str]:
    """Which of the paths cannot be written; asked before any work is done."""
    out = []
    for path in paths:
        folder = os.path.dirname(os.path.abspath(path))
        if os.path.isdir(path) or not os.path.isdir(folder) or not os.access(path if os.path.exists(path) else folder, os.W_OK):
            out.append(path)
    return out


def _texts(df: DataFrame) -> list[str]:
    """Rows of a result as JSON, encoded by Spark."""
    return [r.j for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(j) for j in _texts(df)]


def _sections(survey: Survey, read: Callable[[DataFrame], list]) -> tuple[dict, dict[str, list]]:
    """The document's head, and its sections as read gives their rows."""
    sections = SECTIONS | (HISTORY if survey.commits is not None else {})
    listing = survey.listing
    heads = {"headline": lambda s: s.headline, "history": lambda s: s.history_state, "opening": lambda s: s.opening}
    asked = {name: (f, _rows) for name, f in heads.items()} | {name: (f, read) for name, f in sections.items()}
    with ThreadPoolExecutor(CONCURRENT) as pool:  # the last sections rest on most others
        waiting = {name: pool.submit(lambda f=f, how=how: how(f(survey))) for name, (f, how) in reversed(asked.items())}
        tables = {name: waiting[name].result() for name in asked}
    head = {"headline": tables.pop("headline")[0], "excluded": dict(listing.excluded) if listing else {}, "skipped": listing.skipped if listing else 0, "history": tables.pop("history")[0], "history_coverage": tables.pop("opening")[0]["coverage"]}
    return head, tables


def section_sizes(survey: Survey) -> list[tuple[str, int]]:
    """(section, rows) of every section; made and counted side by side, a small job each."""
    sections = SECTIONS | HISTORY
    with ThreadPoolExecutor(CONCURRENT) as pool:  # the last sections rest on most others
        waiting = {name: pool.submit(lambda name=name, f=f: survey.cycle_count if name == "cycles" else f(survey).count()) for name, f in reversed(sections.items())}
        return [(name, waiting[name].result()) for name in sections]


def as_dict(survey: Survey) -> dict:
    head, tables = _sections(survey, _rows)
    return head | tables


def write_json(survey: Survey, path: str) -> None:
    """The document as_dict gives, a line a row; rows are written as Spark encodes them, so Python holds no objects of them."""
    head, tables = _sections(survey, _texts)
    parts = [f"{json.dumps(name)}: {json.dumps(value)}" for name, value in head.items()]
    parts += [f"{json.dumps(name)}: [" + ",".join(f"\n  {row}" for row in rows) + "\n]" for name, rows in tables.items()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("{\n" + ",\n".join(parts) + "\n}\n")


def write_tables(survey: Survey, folder: str) -> None:
    """Each section as Parquet, for surveys that no single document should hold."""
    sections = SECTIONS | (HISTORY if survey.commits is not None else {})
    with ThreadPoolExecutor(CONCURRENT) as pool:
        list(pool.map(lambda x: x[1](survey).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{x[0]}"), sections.items()))


def _stuck(survey: Survey) -> DataFrame:
    """(key, stuck): modules that have a dead end."""
    return survey.dead_ends.select("key").distinct().withColumn("stuck", F.lit(True))


def _nodes(survey: Survey, limit: int) -> tuple[list, list, int]:
    """The modules with the highest scores, with state, score, depth (unreached ones below all others) and whether they have a dead end; their edges; and how many modules there are."""
    deepest = survey.layers.agg(F.coalesce(F.max("depth") + 1, F.lit(0)).alias("pool"))
    nodes = survey.modules.select("key").join(survey.states, "key").join(survey.frontier.select("key", "score"), "key", "left").join(survey.layers.withColumnRenamed("node", "key"), "key", "left").join(_stuck(survey), "key", "left").join(F.broadcast(deepest))  # deepest is one row
    nodes = nodes.select("key", "state", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("depth", "pool").alias("depth"), F.coalesce("stuck", F.lit(False)).alias("stuck"))
    total = nodes.count()
    top = stage_table(survey.spark, nodes.orderBy(F.desc("score"), "key").limit(limit), "drawn")
    edges = survey.edges.join(top.select(F.col("key").alias("src")), "src", "left_semi").join(top.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst")
    return sorted(top.collect(), key=lambda n: n["key"]), sorted(map(tuple, edges.collect())), total


def mermaid(survey: Survey, max_nodes: int = 120) -> str:
    """A flowchart of the modules with the highest scores, by depth; ways into dead ends are dashed; says how many it leaves out."""
    nodes, edges, total = _nodes(survey, max_nodes)
    number = {n["key"]: f"n{i}" for i, n in enumerate(nodes)}
    stuck = {n["key"] for n in nodes if n["stuck"]}
    lines = ["flowchart LR"]
    if total > len(nodes):
        lines.append(f"  %% {total - len(nodes)} of {total} modules are not drawn")
    for depth in sorted({n["depth"] for n in nodes}):
        lines += [f'  subgraph d{depth}["{f"depth {depth}" if depth else "entry points"}"]', "    direction TB"]
        lines += [f'    {number[n["key"]]}["{n["key"].rpartition(".")[2]}"]' for n in nodes if n["depth"] == depth]
        lines.append("  end")
    lines += [f"  {number[a]} {'-.->' if b in stuck else '-->'} {number[b]}" for a, b in edges]
    lines += [f"  class {number[n['key']]} {n['state']};" for n in nodes]
    lines += [f"  classDef {s} fill:{c}" for s, c in COLOURS.items()]
    return "\n".join(lines) + "\n"


def cells(survey: Survey) -> tuple[DataFrame, DataFrame]:
    """What is drawn of the graph of all modules, of any size: modules (number, key, value, state), numbered by key, and edges (source, target, dashed) between numbers; ways into dead ends are dashed."""
    counts = survey.signals.groupBy("key").agg(F.count("*").alias("marks"))
    drawn = survey.modules.select("key").join(survey.states, "key").join(counts, "key", "left")
    number = stage_table(survey.spark, geometry.ranked(drawn.select("key").distinct(), [F.asc("key")]).select("key", F.col("place").alias("number")), "numbers")
    label = F.concat("key", F.when(F.col("marks") > 0, F.concat(F.lit(" ("), F.col("marks").cast("string"), F.lit(" signals)"))).otherwise(""))
    ends = number.join(_stuck(survey), "key", "left").select(F.col("key").alias("dst"), F.col("number").alias("target"), F.coalesce("stuck", F.lit(False)).alias("dashed"))
    edges = survey.edges.join(number.toDF("src", "source"), "src").join(ends, "dst").select("source", "target", "dashed")
    return drawn.join(number, "key").select("number", "key", label.alias("value"), "state"), edges


def drawio(survey: Survey, title: str = "survey") -> str:
    """The graph of all modules as draw.io XML, in rows by layer; their number is bounded by the listing's max_files."""
    nodes, edges = cells(survey)
    places = {r.key: (int(r.x), int(r.y)) for r in survey.layered_map[0].toLocalIterator()}
    width, height = (max([*(p[k] for p in places.values()), 0]) + size + geometry.MARGIN for k, size in enumerate((geometry.NODE_W, geometry.NODE_H)))
    file = ET.Element("mxfile")
    model = ET.SubElement(ET.SubElement(file, "diagram", name=title), "mxGraphModel", page="1", pageWidth=str(max(width, 320)), pageHeight=str(max(height, 200)))
    root = ET.SubElement(model, "root")
    ET.SubElement(root, "mxCell", id="0")
    ET.SubElement(root, "mxCell", id="1", parent="0")
    for n in nodes.orderBy("number").toLocalIterator():
        x, y = places.get(n["key"], (0, 0))
        cell = ET.SubElement(root, "mxCell", id=f"n{n['number']}", value=n["value"], style=f"rounded=1;fillColor={COLOURS[n['state']]}", vertex="1", parent="1")
        ET.SubElement(cell, "mxGeometry", {"x": str(x), "y": str(y), "width": str(geometry.NODE_W), "height": str(geometry.NODE_H), "as": "geometry"})
    for i, e in enumerate(edges.orderBy("source", "target").toLocalIterator()):
        cell = ET.SubElement(root, "mxCell", id=f"e{i}", edge="1", parent="1", source=f"n{e['source']}", target=f"n{e['target']}", style="dashed=1" if e["dashed"] else "dashed=0")
        ET.SubElement(cell, "mxGeometry", {"relative": "1", "as": "geometry"})
    return ET.tostring(file, encoding="unicode")


def _and_more(out: list[str], shown: int, total: int) -> None:
    if total > shown:
        out.append(f"  ... and {total - shown} more")


def summary(survey: Survey, limit: int = 12) -> str:
    """The findings in a few lines each; every list says how much it leaves out."""
    h = _rows(survey.headline)[0]
    excluded = dict(survey.listing.excluded.most_common(3)) if survey.listing else {}
    opening = survey.opening.first()
    out = [f"{h['modules']} modules, {h['lines']} lines, {h['errors']} unreadable, {h['excluded']} excluded, {h['skipped']} skipped", f"{h['entries']} entry points, {h['orphans']} orphans, {h['cycles']} import cycles, {h['unreached']} unreached"]
    out += [f"excluded: {', '.join(f'{n} ({c})' for n, c in excluded.items())}"] if excluded else []
    out += [opening.finding or "", opening.coverage or "", "", "where the code is from"]
    out += [f"  {r['origin']}: {r['modules']} modules, {r['lines']} lines" for r in survey.origin_totals.orderBy(F.desc("lines")).collect()]
    out.append("where it starts")
    out += [f"  {r['key']}: {', '.join(r['reasons'])}" for r in survey.entry_points.orderBy("key").limit(limit).collect()]
    _and_more(out, limit, h["entries"])
    out.append("how far from there")
    depths = survey.layers.groupBy("depth").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("node")), 1, 6).alias("nodes")).orderBy("depth").collect()
    out += [f"  {'entry' if not r['depth'] else 'depth ' + str(r['depth'])}: {r['n']}  {', '.join(r['nodes'])}{' ...' if r['n'] > 6 else ''}" for r in depths]
    out.append("most depended upon")
    out += [f"  {r['key']}: used by {r['fan_in']}, uses {r['fan_out']}" for r in survey.fan.where("fan_in > 0").orderBy(F.desc("fan_in"), F.desc("fan_out"), "key").limit(6).collect()]
    if h["cycles"]:
        out.append("import cycles")
        out += [f"  {' -> '.join(r.nodes)}" for r in survey.import_cycles.orderBy("nodes").limit(5).collect()]
        _and_more(out, 5, h["cycles"])
    out.append("nothing imports")
    out += [f"  {r['key']} ({r['loc']} lines)" for r in survey.orphans.orderBy("ord").limit(10).collect()]
    _and_more(out, 10, h["orphans"])
    failed = survey.modules.where("error is not null")
    out += ["cannot be parsed", *(f"  {r['relpath']}: {r['error']}" for r in failed.orderBy("relpath").limit(8).collect())] if h["errors"] else []
    hot = survey.frontier.where("score > 0").join(survey.origins.where("origin = 'vendored'").select("key"), "key", "left_anti")
    out.append("where work stopped")
    top = hot.orderBy(F.desc("score"), "relpath").limit(limit).withColumn("bar", T.text_bar(F.col("score"), F.max("score").over(Window.partitionBy()))).collect()  # limit rows
    out += [f"  {r['bar']} {r['score']:7.1f} {r['relpath']}  " + ", ".join(f"{k} {n}" for k, n in sorted(r["counts"].items(), key=lambda kv: (-kv[1], kv[0]))[:4]) for r in top]
    _and_more(out, limit, hot.count())
    out.append("  in all: " + ", ".join(f"{r['kind']} {r['n']}" for r in survey.totals.orderBy(F.desc("n"), "kind").collect()))
    out.append("competing attempts")
    groups = SECTIONS["attempts"](survey).join(survey.attempt_sentences, ["verdict", "resume_at"])
    for kind, most in (("restart", 3), ("copy", 3)):
        some = groups.where(F.col("verdict") == kind)
        for r in some.orderBy(F.desc("at_stake_lines"), F.size("members").desc(), "resume_at").limit(most).collect():
            out.append(f"  {kind}: {', '.join(m['key'] for m in r['members'])}; resume {r['resume_at']} ({r['resume_percent']} %)")
            out += [f"      {x}" for x in (r["stake"], r["effort"], r["copy"], *r["members"][0]["facts"]) if x]
        _and_more(out, most, some.count())
    if survey.commits is not None:
        state = survey.history_state.first()
        out += [state.note] if state.shallow else []
        out.append("where the effort went instead (by likeness and time, not proven)")
        out += [f"  {r['stopped']} -> {r['continued']} ({', '.join(r['signals'])})" for r in survey.forks.orderBy("stopped", "continued").limit(5).collect()]
        span = survey.timeline.agg(F.min("month").alias("first"), F.max("month").alias("last")).first()
        out.append(f"history: files first seen from {span['first']} to {span['last']}, by {state.authors} authors")
        out += [f"  {r['n']}x {r['item_a']} + {r['item_b']}" for r in survey.co_change.orderBy(F.desc("n"), "item_a", "item_b").limit(5).collect()]
        out.append("started and left alone")
        out += [f"  {r['path']}: {r['commits']} commits, quiet for {r['days_quiet']} days" for r in survey.stalled.orderBy(F.desc("days_quiet"), "path").limit(5).collect()]
    else:
        out.append("no version history")
    return "\n".join(out) + "\n"


def window_rows(survey: Survey) -> dict[str, DataFrame]:
    """What a window shows: the sentence to read first, six restarts, four copies, eight modules where work stopped; each with how many more there are."""
    groups = survey.attempt_groups.select("verdict", "resume_at", "resume_percent", "at_stake_lines", F.size("members").alias("files"))
    order = [F.desc("at_stake_lines"), F.desc("files"), F.asc("resume_at")]
    shown = lambda kind, n: summaries.top_n_more(groups.where(F.col("verdict") == kind), ["verdict"], order, n)
    stopped = summaries.top_n_more(survey.frontier.select(F.lit("frontier").alias("list"), "key", "relpath", "score"), ["list"], [F.desc("score"), F.asc("relpath")], 8)
    return {"opening": survey.opening, "restarts": shown("restart", 6), "copies": shown("copy", 4), "frontier": stopped}


def _block(score: float, relpath: str, loc: int, counts: list[tuple[str, int]], found: list[dict] | None) -> str:
    """A module's part of the printed findings; it ends with an empty line. found: per kind the first hits."""
    out = [f"{score:>6g}  {relpath}  ({loc} lines)"]
    for kind, n in sorted(counts):
        rows = sorted((r for r in found or () if r["kind"] == kind), key=lambda r: r["rank"])
        out.append(f"        {kind} -- {n}")
        out += [f"          {'line ' + str(r['lineno']) if r['lineno'] else 'module'}: {r['text']}" for r in rows]
        if rows and rows[0]["more"]:
            out.append(f"          ... and {rows[0]['more']} more")
    return "\n".join([*out, ""])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        texts = [_block(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("score", "relpath", "loc", "counts", "found")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("score"), batch.column("relpath"), pa.array(texts, pa.string())], ["score", "relpath", "block"])


def frontier_blocks(survey: Survey, hits: int = 5) -> DataFrame:
    """(score, relpath, block): of every module with findings, per kind the first hits with their lines, and how many more; put together where the module is."""
    ship_package(survey.spark)
    first = summaries.top_n_more(survey.signals, ["key", "kind"], [F.asc("lineno"), F.asc("text")], hits)
    found = first.groupBy("key").agg(F.collect_list(F.struct("kind", "rank", "lineno", "text", "more")).alias("found"))  # hits of a kind at most
    rows = survey.frontier.select("key", "relpath", "loc", "score", "counts").join(found, "key", "left")
    return rows.select("score", "relpath", "loc", "counts", "found").mapInArrow(_blocks, "score double, relpath string, block string")


def frontier_text(survey: Survey, hits: int = 5) -> str:
    """Every module with findings, the highest score first."""
    return "\n".join(r["block"] for r in frontier_blocks(survey, hits).orderBy(F.desc("score"), "relpath").toLocalIterator()) + "\n"
