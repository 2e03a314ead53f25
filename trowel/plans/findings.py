"""Queries that run the survey over the code base made of the driver's tables; codebase_oracle says the same in SQL.

Nested results are flattened to plain columns, lists to text, so that rows of both engines compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trowel.plans import codebase
from trowel.plans.survey import LINE_END, Survey
from trowel.sinks import render, svgmap
from trowel.sources import tree

Finding = Callable[[Survey], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def finding(f: Finding) -> Finding:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(codebase.survey(spark, sf_dir))

    QUERIES[f"survey_{f.__name__}"] = run
    return f


def _joined(column: str | Column, by: str = ",") -> Column:
    return F.array_join(column, by)


def _sorted(column: str) -> Column:
    return _joined(F.sort_array(column))


def _error() -> Column:
    return F.when(F.col("error").startswith("syntax error"), "syntax error").when(F.col("error").isNotNull(), F.substring("error", 1, 14))


# --- facts


@finding
def modules(s):
    """Decoding, parsing, counts of lines and comments, guards and docstrings."""
    return s.modules.select("key", "relpath", "loc", "blank", "comment_lines", _error().alias("error"), "error_line", "has_main_guard", F.col("shebang").isNotNull().alias("shebang"), "docstring", F.col("comments_incomplete").isNotNull().alias("cut"))


@finding
def imports(s):
    return s.imports


@finding
def definitions(s):
    text = {c: _joined(c).alias(c) for c in ("args", "decorators", "bases")}
    return s.definitions.select("key", "qualname", "name", "kind", "lineno", "end_lineno", text["args"], "docstring", text["decorators"], "is_async", "parent", "body_kind", "returns", text["bases"], "nested", "promises", "says")


@finding
def calls(s):
    return s.calls


@finding
def names_used(s):
    return s.names_used


@finding
def symbol_strings(s):
    return s.modules.select("key", F.explode("symbol_strings").alias("text"))


@finding
def tags(s):
    return s.modules.select("key", F.explode("todos").alias("t")).select("key", "t.*")


@finding
def disabled_code(s):
    return s.disabled_code


@finding
def waivers(s):
    return s.modules.select("key", F.explode("kept_imports").alias("lineno"))


@finding
def swallowed(s):
    return s.modules.select("key", F.explode("swallowed").alias("lineno"))


@finding
def import_effects(s):
    return s.modules.select("key", F.explode("toplevel_effects").alias("e")).select("key", "e.*")


@finding
def index(s):
    """What is shown before a survey: no parsing."""
    return tree.index(s.files)


@finding
def accounting(s):
    """Every file in one of three kinds; folders that are pruned by name."""
    return tree.account(s.files.select("relpath"), ["vendor", "migrations"], 1500).select("relpath", "pruned", "kind")


@finding
def excluded(s):
    """Pruned folders by name with the files below them, and what is beyond the cap."""
    accounted = tree.account(s.files.select("relpath"), ["vendor", "migrations"], 1500)
    return accounted.groupBy("kind", F.coalesce("pruned", F.lit("")).alias("folder")).agg(F.count("*").alias("n"))


# --- import graph


@finding
def resolved(s):
    return s.resolved.select("key", "lineno", "bound", "target", F.col("full").alias("full_name"), "dst")


@finding
def edges(s):
    return s.edges


@finding
def external(s):
    return s.external


@finding
def evidence(s):
    return s.evidence


@finding
def entry_points(s):
    return s.entry_points.select("key", _joined("reasons", "; ").alias("reasons"))


@finding
def loaded_by(s):
    return s.loaded_by


@finding
def roots(s):
    return s.roots


@finding
def layers(s):
    return s.layers


@finding
def orphans(s):
    return s.orphans.select("key", "relpath", "loc")


@finding
def unreferenced(s):
    return s.unreferenced


@finding
def fan(s):
    return s.fan


@finding
def cycles(s):
    return s.cycles


@finding
def import_cycles(s):
    """Cycles of imports by name, as a walk over all modules meets them."""
    return s.import_cycles.select(_joined("nodes", " -> ").alias("nodes"))


@finding
def trace(s):
    return s.trace("pkg7", 100_000)


@finding
def neighbourhood(s):
    return s.neighbourhood("pkg1")


@finding
def effects(s):
    return s.effects


# --- where work stopped


@finding
def class_links(s):
    return s.class_links


@finding
def replaced_methods(s):
    return s.replaced_methods.select("key", "parent", "name")


@finding
def unused_imports(s):
    return s.unused_imports


@finding
def signals(s):
    failed = F.col("kind").isin("syntax_error", "unreadable")
    return s.signals.select("key", "kind", F.when(failed, "").otherwise(F.col("text")).alias("text"), "lineno")


@finding
def frontier(s):
    counts = F.to_json("counts")
    return s.frontier.select("key", "relpath", "loc", "score", counts.alias("counts"))


@finding
def totals(s):
    return s.totals


@finding
def dead_ends(s):
    return s.dead_ends.select("key", "qualname", "kind", "lineno", "calls", "called_from_elsewhere", "direction")


@finding
def callers(s):
    return s.callers


@finding
def dead_ends_by_module(s):
    return s.dead_ends_by_module.select("key", "n", _joined(F.transform("dead_ends", lambda d: d["qualname"])).alias("names"))


# --- attempts and what is worth keeping


@finding
def attempts(s):
    """Groups: restarts and copies, where to resume, what is at stake, what is shared and missing."""
    lists = [_joined("shared").alias("shared"), _joined("common_gaps").alias("common_gaps"), F.size("members").alias("n_members")]
    return s.attempt_groups.select("verdict", "resume_at", "resume_percent", "resume_lines", "elsewhere_percent", "at_stake_lines", "remaining_lines", "unwritten", "copy_of", *lists)


@finding
def attempt_members(s):
    members = s.attempt_groups.select("verdict", "resume_at", F.explode("members").alias("m"))
    return members.select("verdict", "resume_at", "m.key", "m.rank", "m.percent", "m.lines", "m.tests")


@finding
def attempt_lineage(s):
    steps = s.attempt_groups.select("verdict", "resume_at", F.posexplode("lineage").alias("step", "x"))
    return steps.select("verdict", "resume_at", "step", "x.key", *(_joined(f"x.{c}").alias(c) for c in ("added", "dropped", "carried")))


@finding
def verdicts(s):
    return s.verdicts


@finding
def salvage(s):
    return s.salvage


@finding
def salvage_totals(s):
    return s.salvage_totals


@finding
def clusters(s):
    return s.clusters.select("cluster", "size", "loc", "entries", "untracked", "label", "belongs")


@finding
def set_aside(s):
    """Modules of clusters that nothing enters and no document names."""
    return s.cluster_modules(False)


# --- history


@finding
def file_history(s):
    return s.file_history


@finding
def co_change(s):
    return s.co_change


@finding
def timeline(s):
    return s.timeline


@finding
def timeline_files(s):
    return s.timeline_files


@finding
def stalled(s):
    return s.stalled


@finding
def origins(s):
    return s.origins


@finding
def origin_totals(s):
    return s.origin_totals


@finding
def forks(s):
    return s.forks.select("stopped", "continued", _joined("signals").alias("signals"), "commits")


# --- regions, states, map tables


@finding
def regions(s):
    return s.regions


@finding
def snippets(s):
    return s.snippets.select("key", "low", _joined("lines", "\n").alias("lines"))


@finding
def line_marks(s):
    shown = s.line_marks.join(s.modules.where("error is null").select("key"), "key", "left_semi")
    return shown.select("key", "lineno", _joined("marks", "; ").alias("marks"))


@finding
def tested(s):
    return s.tested


@finding
def states(s):
    return s.states


@finding
def state_tally(s):
    return s.state_tally


@finding
def held_back(s):
    return s.held_back


@finding
def folders(s):
    return s.folders


@finding
def ribbons(s):
    return s.ribbons


@finding
def headline(s):
    return s.headline


# --- words, maps and other sinks


@finding
def scaffolds(s):
    return s.scaffolds


@finding
def attempt_sentences(s):
    return s.attempt_sentences


@finding
def opening(s):
    return s.opening


@finding
def boxes(s):
    return s.boxes


@finding
def cards(s):
    return s.cards


@finding
def ribbon_paths(s):
    at = [F.round(c, 3).alias(c) for c in ("sx", "sy", "mx", "my", "ex", "ey", "weight")]
    return s.ribbon_paths.select("src_folder", "dst_folder", "n", *at)


@finding
def layered(s):
    """Places in the layered chart."""
    return s.layered_map[0].drop("apart")


@finding
def elbows(s):
    """Edges of the layered chart."""
    return s.layered_map[1]


@finding
def mermaid(s):
    return s.spark.createDataFrame([(line,) for line in render.mermaid(s).splitlines()], "line string")


@finding
def drawio(s):
    """Cells of the chart of all modules, and of their edges; layered has their places."""
    nodes, edges = render.cells(s)
    id_ = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    null = F.lit(None).cast("string")
    own = nodes.select(id_("number").alias("id"), "value", null.alias("source"), null.alias("target"), F.lit(False).alias("dashed"))
    return own.union(edges.select(null, null, id_("source"), id_("target"), "dashed"))


@finding
def frontier_lines(s):
    """The printed findings, but for what parsers say of files that they refuse."""
    lines = render.frontier_blocks(s).select(F.explode(F.split("block", LINE_END, -1)).alias("line"))
    return lines.where(~F.col("line").contains("module: syntax error") & ~F.col("line").contains("module: Python refuses"))


@finding
def sections(s):
    """Rows in each section of the JSON document."""
    return s.spark.createDataFrame(render.section_sizes(s), "section string, n long")


@finding
def payload(s):
    """What a click on the map shows, counted by module."""
    lines = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.size(x["lines"]))
    return svgmap.clicks(s).select("key", "state", *(F.size(c).alias(c) for c in ("uses", "used_by", "external")), lines("signals").alias("hits"), lines("links").alias("evidence"))


@finding
def window(s):
    """What a window shows, by list."""
    shown = render.window_rows(s)
    rows = [shown[k].select(F.lit(k).alias("list"), F.col("resume_at").alias("name"), "rank", "more") for k in ("restarts", "copies")]
    return rows[0].union(rows[1]).union(shown["frontier"].select("list", "key", "rank", "more"))
