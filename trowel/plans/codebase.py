"""A code base made of the driver's tables, so that every finding of the survey has rows that SQL can check.

Each part is a module: its source is put together from fixed lines, each of which is there or blank by
a condition on the part's number. Orders are commits, newest first; the parts of an order are the files
of a commit. trowel.plans.codebase_oracle says in SQL, from the same conditions but without any
source, what the survey must find. The conditions and names below are read by both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trowel.plans.survey import Survey
from trowel.session import spread, stage_table
from trowel.sources import tree

#: Modules of the first folders' packages; lines of every source.
FOLDERS, LINES = 20, 53
#: Sources that one task makes and parses, about.
FILES_EACH = 4000
#: What the code base's own documents say.
PROSE = "start with app2 and pkg1, then read vendor."
#: Files that mark folders as packages of their own: (folder, name).
MARKERS = [("pkg7", "LICENSE"), ("pkg8", "notes.txt")]


#: The module that a line of an order changes: some are hardly ever touched, their lines change the module before.
TOUCHES = "CASE WHEN l_partkey % 10 = 7 AND NOT (l_linenumber = 1 AND l_orderkey % 16 = 0) THEN l_partkey - 1 ELSE l_partkey END"
#: Days by which the date of a commit is later than its place in the log, as after a rebase.
REBASED = "CASE WHEN o_orderkey % 97 = 5 THEN 45 ELSE 0 END"


def half(k: str) -> str:
    return f"CAST(floor(({k}) / 2) AS BIGINT)"


def path(k: str) -> str:
    """SQL: the path of module k; both engines join strings and numbers with ||."""
    f = f"('pkg' || (({k}) % {FOLDERS}))"
    two = lambda n: f"right('0' || ({n}), 2)"
    return (
        f"(CASE WHEN ({k}) < {FOLDERS} THEN {f} || '/__init__.py' WHEN ({k}) % 29 = 3 THEN 'tests/test_m' || ({k}) || '.py' "
        f"WHEN ({k}) % 31 = 7 AND ({k}) >= {FOLDERS} + 31 THEN 'backup/pkg' || ((({k}) - 31) % {FOLDERS}) || '/m' || (({k}) - 31) || '.py' "
        f"WHEN ({k}) % 37 = 5 THEN 'vendor/lib' || ({k}) || '/m' || ({k}) || '.py' WHEN ({k}) % 41 = 2 THEN 'app' || ({k}) || '/main.py' "
        f"WHEN ({k}) % 43 = 9 THEN {f} || '/m' || ({k}) || '_2024' || {two(f'1 + ({k}) % 12')} || {two(f'1 + ({k}) % 28')} || '.py' "
        f"WHEN ({k}) % 47 = 11 THEN {f} || '/migrations/m' || ({k}) || '.py' WHEN ({k}) % 53 = 13 THEN {f} || '/plugins/m' || ({k}) || '.py' "
        f"WHEN ({k}) % 59 = 17 THEN 'm' || ({k}) || '.py' ELSE {f} || '/m' || ({k}) || '.py' END)"
    )


def module(k: str) -> str:
    """SQL: the dotted name of module k."""
    return f"replace(replace(replace({path(k)}, '/__init__.py', ''), '.py', ''), '/', '.')"


def family(k: str) -> str:
    """SQL: the number that a module's shared names carry; a module kept aside has its original's."""
    return f"CAST(floor((CASE WHEN ({k}) % 31 = 7 AND ({k}) >= {FOLDERS} + 31 THEN ({k}) - 31 ELSE ({k}) END) / 4) AS BIGINT)"


#: Conditions on a module's number, by what they put into its source.
HAS = {
    "shebang": "k % 17 = 0",
    "docstring": "k % 2 = 0",
    "import": "k >= 2 AND k % 7 <> 6",
    "ahead": "k % 50 = 20",
    "back": "k % 50 = 21",
    "sibling": "k % 11 = 4 AND k % 50 NOT IN (20, 21)",
    "absolute": "k % 11 = 5 AND k % 50 NOT IN (20, 21)",
    "json": "k % 3 <> 2",
    "thing": "k % 4 = 1",
    "exported": "k % 8 = 1",
    "extended": "k % 16 = 5",
    "loading": "k % 19 = 8",
    "shape": "k % 6 = 0",
    "square": "k % 6 = 3",
    "made": "k % 30 = 3",
    "ring": "k % 12 = 10",
    "ring_area": "k % 24 = 10",
    "port": "k % 12 = 4",
    "routed": "k % 12 = 7",
    "documented": "k % 13 = 6",
    "vow": "k % 13 = 7",
    "shared": "k % 4 < 3",
    "settled": "k % 4 < 2",
    "guard": "k % 41 = 2 OR k % 25 = 24",
    "touch": "k % 10 = 3",
    "process": "k % 20 = 3",
    "checks": f"k >= {FOLDERS} AND k % 29 = 3",
    "broken": "k % 97 = 50",
    "foreign": "k % 101 = 60",
}


def _line(condition: str, text: str) -> str:
    return f"CASE WHEN {HAS.get(condition, condition)} THEN {text} ELSE '' END"


#: Columns that lines are made of.
NAMED = {"half": half("k"), "family": family("k"), "m_half": module(half("k")), "m_next": module("k + 1"), "m_before": module("k - 1"), "m_shape3": module("k - 3"), "m_shape4": module("k - 4"), "relpath": path("k")}


def _lines() -> list[str]:
    """SQL of each line of module k's source, over the columns of NAMED."""
    aids = [_line("documented", f"""'def aid_{w}_' || k || '(): "Doc."'""") for w in ("one", "two", "three", "four")]
    return [
        _line("shebang", "'#!/usr/bin/env python3'"),
        _line("docstring", "'\"\"\"Makes parts of ' || p_brand || '.\"\"\"'"),
        _line("import", f"'from ' || m_half || ' import job_' || half"),
        f"CASE WHEN {HAS['ahead']} THEN 'import ' || m_next WHEN {HAS['back']} THEN 'import ' || m_before WHEN {HAS['sibling']} THEN 'from . import m' || (k + {FOLDERS}) WHEN {HAS['absolute']} THEN 'import m' || (k - 1) ELSE '' END",
        _line("json", "'import json' || CASE WHEN k % 5 = 0 THEN '  # noqa: F401' WHEN k % 5 = 1 THEN '  # pylint: disable=unused-import' ELSE '' END"),
        _line("thing", "'from missing' || (k % 6) || '.sub import thing as thing_' || k"),
        f"CASE WHEN {HAS['exported']} THEN '__all__ = [\"thing_' || k || '\"]' WHEN {HAS['extended']} THEN '__all__.extend([\"thing_' || k || '\"])' ELSE '' END",
        "CASE k % 9 WHEN 0 THEN '# TODO: check ' || p_name WHEN 1 THEN '# fixme: ' || p_name WHEN 2 THEN '# a TODO in prose' WHEN 3 THEN '# x = ' || k "
        "WHEN 4 THEN '#    y = 1' WHEN 5 THEN '# 1. HACK it' WHEN 6 THEN '# noqa: E501 XXX: z' WHEN 7 THEN '# type: ignore' ELSE '# ' || p_name END",
        "'LIMIT_' || k || ' = ' || p_size || '  # type: Limit' || (k % 5)",
        _line("loading", "'print(\"loading\")'"),
        f"CASE WHEN {HAS['square']} THEN 'from ' || m_shape3 || ' import Shape_' || (k - 3) WHEN {HAS['ring']} THEN 'from ' || m_shape4 || ' import Shape_' || (k - 4) ELSE '' END",
        f"CASE WHEN {HAS['shape']} THEN 'class Shape_' || k || ':' WHEN {HAS['square']} THEN 'class Square_' || k || '(Shape_' || (k - 3) || '):' "
        f"WHEN {HAS['ring']} THEN 'class Ring_' || k || '(Shape_' || (k - 4) || '):' WHEN {HAS['port']} THEN 'class Port_' || k || '(Protocol):' ELSE '' END",
        f"CASE WHEN {HAS['shape']} OR {HAS['square']} OR {HAS['ring_area']} THEN '    def area(self, unit):' WHEN {HAS['ring']} THEN '    def other(self, unit):' WHEN {HAS['port']} THEN '    def send(self): ...' ELSE '' END",
        f"CASE WHEN {HAS['shape']} THEN '        raise NotImplementedError  # TODO' WHEN {HAS['square']} OR {HAS['ring']} THEN '        return unit' WHEN {HAS['port']} THEN '    def recv(self): ...' ELSE '' END",
        f"CASE WHEN {HAS['shape']} THEN '    def name(self):' WHEN {HAS['square']} THEN '    def extra(self):' ELSE '' END",
        f"CASE WHEN {HAS['shape']} THEN '        return \"' || p_brand || '\"' WHEN {HAS['square']} THEN '        return super().extra()' ELSE '' END",
        f"CASE WHEN {HAS['made']} THEN 'ROOT = Shape_' || (k - 3) || '()' WHEN {HAS['routed']} THEN '@app.route(\"/x\")' ELSE '' END",
        "'def job_' || k || '(row, *rest):'",
        f"CASE WHEN {HAS['documented']} THEN '    \"\"\"Returns a row.\"\"\"; return row' WHEN k % 5 = 0 THEN '    pass  # TODO' WHEN k % 5 = 1 THEN '    pass' WHEN k % 5 = 2 THEN '    ...' "
        f"WHEN k % 5 = 3 THEN '    raise NotImplementedError(\"not implemented yet\")' ELSE '    return job_' || half || '(row)' END",
        _line("shared", f"'def collect_' || family || '(row):'"),
        _line("shared", "'    return row'"),
        _line("shared", f"'def refine_' || family || '(row):'"),
        _line("shared", "CASE WHEN k % 3 = 0 THEN '    pass' ELSE '    return row' END"),
        _line("settled", f"'def settle_' || family || '(row):'"),
        _line("settled", "CASE WHEN k % 2 = 0 THEN '    ...' ELSE '    return row' END"),
        _line("k % 7 < 5", "'try:'"),
        _line("k % 7 < 5", "CASE WHEN k % 7 = 3 THEN '    handle.close()' ELSE '    work_' || k || '()' END"),
        _line("k % 7 < 5 AND k % 7 <> 3", "'    more_' || k || '()'"),
        "CASE k % 7 WHEN 0 THEN 'except Exception:' WHEN 1 THEN 'except ValueError:' WHEN 2 THEN 'except:  # fine' WHEN 3 THEN 'except Exception:' WHEN 4 THEN 'except (KeyError, Exception):' ELSE '' END",
        _line("k % 7 < 5", "'    pass'"),
        f"CASE WHEN {HAS['documented']} THEN 'def long_' || k || '(a):' WHEN {HAS['vow']} THEN 'def vow_' || k || '(a):' ELSE '' END",
        f"CASE WHEN {HAS['documented']} THEN '    a += 1' WHEN {HAS['vow']} THEN '    \"\"\"Returns the sum.\"\"\"' ELSE '' END",
        f"CASE WHEN {HAS['documented']} OR {HAS['vow']} THEN '    a += 1' ELSE '' END",
        *[_line("documented", "'    a += 1'")] * 9,
        *aids,
        _line("guard", "'if __name__ == \"__main__\":'"),
        _line("guard", "'    argparse.ArgumentParser()'"),
        _line("process", "'import subprocess'"),
        _line("touch", "'def touch_' || k || '():'"),
        _line("touch", "'    open(\"x\"); requests.get(\"y\"); run(\"z\")'"),
        _line("broken", "'def (:'"),
        _line("checks", "'CHECKED = m' || (k + 1)"),
    ]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "p_name", "p_brand", "p_size")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(relpath, content, ord); a foreign source has a byte that is not UTF-8. Names are staged, as one expression would be too long to compile.

    A part's row is much smaller than its source, so rows are dealt to tasks by their number before sources are made of them.
    """
    lines = _lines()
    dealt = spread(_parts(spark, sf_dir), "k", FILES_EACH)
    named = stage_table(spark, dealt.selectExpr("*", *(f"{e} AS {c}" for c, e in NAMED.items())), "named")
    halves = [f"concat_ws(char(10), {', '.join(part)}) AS part{i}" for i, part in enumerate((lines[:18], lines[18:]))]
    joined = spread(named, "k", FILES_EACH).selectExpr("k", "relpath", *halves)
    text = "concat(part0, char(10), part1, char(10))"
    content = f"CASE WHEN {HAS['foreign']} THEN X'78203D2022E9220A' ELSE CAST({text} AS BINARY) END"
    return joined.selectExpr("relpath", f"{content} AS content", "k AS ord")


#: Modules that were moved once, and those that were moved there and back, with the days.
MOVED, BACK = "k % 19 = 4", "k % 19 = 5"
MOVES = ["1994-01-01", "1993-06-01", "1996-01-01"]


def _path_then(k: str) -> str:
    """SQL: the path of module k on the day of an order."""
    day = [f"CAST(o_orderdate AS DATE) {{}} DATE '{d}'" for d in MOVES]
    moved = f"({MOVED.replace('k', k)} AND {day[0].format('<')}) OR ({BACK.replace('k', k)} AND {day[1].format('>=')} AND {day[2].format('<')})"
    return f"CASE WHEN {moved} THEN 'was/' || {path(k)} ELSE {path(k)} END"


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """commits, commit_files and renames: orders, the modules of their lines by the names of the day, and moves; ord is smaller for newer orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ord_ = F.expr("1000000000000000 - (CAST(unix_date(CAST(o_orderdate AS DATE)) AS BIGINT) * 1000000000 + o_orderkey)")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") + F.expr(REBASED)
    commits = orders.select(ord_.alias("ord"), F.concat(F.lit("c"), "o_orderkey").alias("sha"), (day * 86400).alias("at"), F.concat(F.lit("cust"), F.col("o_custkey") % 7).alias("author"), F.col("o_orderpriority").alias("subject"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.expr(TOUCHES).alias("k"))
    commit_files = lines.join(orders.select("o_orderkey", "o_orderdate"), "o_orderkey").select(ord_.alias("ord"), F.expr(_path_then("k")).alias("path"))
    moves = [(MOVED, MOVES[0], True), (BACK, MOVES[1], False), (BACK, MOVES[2], True)]
    of = lambda where, when, home: _parts(spark, sf_dir).where(where).selectExpr(f"CAST(unix_date(DATE '{when}') AS BIGINT) * 1000000000 + k AS ord", *[f"{'' if here else "'was/' || "}{path('k')} AS {c}" for c, here in (("old", not home), ("new", home))])
    return commits, commit_files, of(*moves[0]).union(of(*moves[1])).union(of(*moves[2]))


_surveys: dict[tuple[str, str], Survey] = {}


def survey(spark: SparkSession, sf_dir: str) -> Survey:
    """The survey of the code base, kept for the application, as its tables are staged once, and when a finding asks for them. Log and tracked files are read where they are used: each is so once or twice."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _surveys:
        commits, commit_files, renames = history(spark, sf_dir)
        tracked = _parts(spark, sf_dir).where("k % 23 <> 6").selectExpr(f"{path('k')} AS relpath")
        declared = _parts(spark, sf_dir).where("k % 61 = 20").selectExpr(f"{module('k')} AS module", f"{module('k')} || ':main' AS spec", "'scripts' AS by", "'pyproject.toml' AS source", "'tool' || k AS name")
        listing = tree.Listing("", markers=MARKERS)
        _surveys[place] = Survey(spark, files(spark, sf_dir), listing, commits, commit_files, renames, tracked, declared, PROSE)
    return _surveys[place]
