"""What the survey must find in the code base of trowel.plans.codebase, in DuckDB SQL over the driver's tables.

FACTS states each module's facts from the conditions that its source was made by; no source is
read. SQL has a statement for each query of trowel.plans.findings, from the definitions of the findings.
"""

from __future__ import annotations

import re

from trowel.functions.text import STOPWORDS
from trowel.operators import geometry as G
from trowel.plans import attempts, codebase
from trowel.plans.codebase import HAS, family, half, module, path
from trowel.sinks.svgmap import COLOURS
from trowel.plans.survey import COMMON_WORDS, CONVENTIONS, EFFECT_IMPORTS, EFFECTS, MIN_SCORE, SEVERITY, TOP_FOLDER, VENDOR_DIRS, VERDICTS, WEIGHTS

WRITES = {k: f"({v})" for k, v in HAS.items()}
TRIES = "(k % 7 < 5)"
#: body of job: documented, else by k % 5
JOB_KIND = f"CASE WHEN {WRITES['documented']} THEN 'code' WHEN k % 5 IN (0, 1) THEN 'pass' WHEN k % 5 = 2 THEN 'ellipsis' WHEN k % 5 = 3 THEN 'raise' ELSE 'code' END"
CALLS_JOB = f"(NOT {WRITES['documented']} AND k % 5 = 4)"


def texts(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def pairs(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def last(name: str) -> str:
    return f"regexp_extract({name}, '[^.]*$')"


def first(name: str) -> str:
    return f"regexp_extract({name}, '^[^.]*')"


def is_test(key: str) -> str:
    return f"regexp_matches(lower(replace({key}, '-', '_')), '(^|[.])(tests?|conftest|test_[^.]*|[^.]*_test)([.]|$)')"


def _definition(condition: str, name: str, kind: str, low: int, high: int, body: str, parent: str = "NULL", args: str = "''", returns: str = "false", promises: str = "false", says: str = "false", doc: str = "NULL", bases: str = "''", decorators: str = "''") -> str:
    return f"SELECT k, key, {low} AS ord, {name} AS name, '{kind}' AS kind, {parent} AS parent, {low} AS lineno, {high} AS end_lineno, {body} AS body_kind, {args} AS args, {returns} AS returns, {promises} AS promises, {says} AS says, {doc} AS docstring, {bases} AS bases, {decorators} AS decorators FROM good WHERE {condition}"


SHAPE_OF = f"CASE WHEN {WRITES['square']} THEN 'Shape_' || (k - 3) ELSE 'Shape_' || (k - 4) END"
DEFINITIONS = [
    _definition(WRITES["shape"], "'Shape_' || k", "class", 12, 16, "'code'", returns="true"),
    _definition(WRITES["shape"], "'area'", "method", 13, 14, "'raise'", "'Shape_' || k", "'self,unit'", says="true"),
    _definition(WRITES["shape"], "'name'", "method", 15, 16, "'code'", "'Shape_' || k", "'self'", "true"),
    _definition(WRITES["square"], "'Square_' || k", "class", 12, 16, "'code'", returns="true", bases=SHAPE_OF),
    _definition(WRITES["square"], "'area'", "method", 13, 14, "'code'", "'Square_' || k", "'self,unit'", "true", bases=SHAPE_OF),
    _definition(WRITES["square"], "'extra'", "method", 15, 16, "'code'", "'Square_' || k", "'self'", "true", bases=SHAPE_OF),
    _definition(WRITES["ring"], "'Ring_' || k", "class", 12, 14, "'code'", returns="true", bases=SHAPE_OF),
    _definition(WRITES["ring"], f"CASE WHEN {HAS['ring_area']} THEN 'area' ELSE 'other' END", "method", 13, 14, "'code'", "'Ring_' || k", "'self,unit'", "true", bases=SHAPE_OF),
    _definition(WRITES["port"], "'Port_' || k", "class", 12, 14, "'code'", bases="'Protocol'"),
    _definition(WRITES["port"], "'send'", "method", 13, 13, "'ellipsis'", "'Port_' || k", "'self'", bases="'Protocol'"),
    _definition(WRITES["port"], "'recv'", "method", 14, 14, "'ellipsis'", "'Port_' || k", "'self'", bases="'Protocol'"),
    _definition("true", "'job_' || k", "function", 18, 19, JOB_KIND, args="'row,*rest'", returns=f"({WRITES['documented']} OR k % 5 = 4)", promises=WRITES["documented"], says=f"(NOT {WRITES['documented']} AND k % 5 IN (0, 3))", doc=f"CASE WHEN {WRITES['documented']} THEN 'Returns a row.' END", decorators=f"CASE WHEN {WRITES['routed']} THEN 'app.route' ELSE '' END"),
    _definition(WRITES["shared"], "'collect_' || g", "function", 20, 21, "'code'", args="'row'", returns="true"),
    _definition(WRITES["shared"], "'refine_' || g", "function", 22, 23, "CASE WHEN k % 3 = 0 THEN 'pass' ELSE 'code' END", args="'row'", returns="k % 3 <> 0"),
    _definition(WRITES["settled"], "'settle_' || g", "function", 24, 25, "CASE WHEN k % 2 = 0 THEN 'ellipsis' ELSE 'code' END", args="'row'", returns="k % 2 <> 0"),
    _definition(WRITES["documented"], "'long_' || k", "function", 31, 42, "'code'", args="'a'"),
    *[_definition(WRITES["documented"], f"'aid_{w}_' || k", "function", 43 + i, 43 + i, "'pass'", doc="'Doc.'") for i, w in enumerate(["one", "two", "three", "four"])],
    _definition(WRITES["vow"], "'vow_' || k", "function", 31, 33, "'code'", args="'a'", promises="true", doc="'Returns the sum.'"),
    _definition(WRITES["touch"], "'touch_' || k", "function", 50, 51, "'code'"),
]


def _import(condition: str, target: str, bound: str, lineno: int, level: int = 0, imported: str | None = None) -> str:
    return f"SELECT k, key, {target} AS target, {bound} AS bound, {lineno} AS lineno, {level} AS level, {imported or bound} AS imported FROM good WHERE {condition}"


IMPORTS = [
    _import(WRITES["import"], module(half("k")), f"'job_' || {half('k')}", 3),
    _import(WRITES["sibling"], "''", f"'m' || (k + {codebase.FOLDERS})", 4, 1),
    _import(WRITES["absolute"], "'m' || (k - 1)", "'m' || (k - 1)", 4),
    _import(WRITES["ahead"], module("k + 1"), module("k + 1"), 4),
    _import(WRITES["back"], module("k - 1"), module("k - 1"), 4),
    _import(WRITES["json"], "'json'", "'json'", 5),
    _import(WRITES["thing"], "'missing' || (k % 6) || '.sub'", "'thing_' || k", 6, 0, "'thing'"),
    _import(WRITES["square"], module("k - 3"), "'Shape_' || (k - 3)", 11),
    _import(f"{WRITES['ring']} AND NOT {WRITES['square']}", module("k - 4"), "'Shape_' || (k - 4)", 11),
    _import(WRITES["process"], "'subprocess'", "'subprocess'", 49),
]


def _call(condition: str, name: str, lineno: int) -> str:
    return f"SELECT k, key, {name} AS name, {lineno} AS lineno FROM good WHERE {condition}"


CALLS = [
    _call(f"{WRITES['extended']} AND NOT {WRITES['exported']}", "'__all__.extend'", 7),
    _call(WRITES["loading"], "'print'", 10),
    _call(WRITES["square"], "'super.extra'", 16),
    _call(WRITES["square"], "'super'", 16),
    _call(WRITES["made"], "'Shape_' || (k - 3)", 17),
    _call(f"{WRITES['routed']} AND NOT {WRITES['made']}", "'app.route'", 17),
    _call(f"NOT {WRITES['documented']} AND k % 5 = 3", "'NotImplementedError'", 19),
    _call(CALLS_JOB, f"'job_' || {half('k')}", 19),
    _call(f"{TRIES} AND k % 7 <> 3", "'work_' || k", 27),
    _call(f"{TRIES} AND k % 7 <> 3", "'more_' || k", 28),
    _call("k % 7 = 3", "'handle.close'", 27),
    _call(WRITES["guard"], "'argparse.ArgumentParser'", 48),
    *[_call(WRITES["touch"], f"'{n}'", 51) for n in ("open", "requests.get", "run")],
]


def _name(condition: str, *names: str) -> list[str]:
    return [f"SELECT k, key, {n} AS name FROM good WHERE {condition}" for n in names]


NAMES = [
    *_name(f"{WRITES['exported']} OR {WRITES['extended']}", "'__all__'"),
    *_name(f"{WRITES['extended']} AND NOT {WRITES['exported']}", "'extend'"),
    *_name("true", "'LIMIT_' || k"),
    *_name(WRITES["loading"], "'print'"),
    *_name(f"{WRITES['square']} OR {WRITES['ring']}", SHAPE_OF, "'unit'"),
    *_name(WRITES["port"], "'Protocol'"),
    *_name(WRITES["shape"], "'NotImplementedError'"),
    *_name(WRITES["square"], "'super'", "'extra'"),
    *_name(WRITES["made"], "'ROOT'", "'Shape_' || (k - 3)"),
    *_name(f"{WRITES['routed']} AND NOT {WRITES['made']}", "'app'", "'route'"),
    *_name(f"NOT {WRITES['documented']} AND k % 5 = 3", "'NotImplementedError'"),
    *_name(CALLS_JOB, f"'job_' || {half('k')}", "'row'"),
    *_name(f"{WRITES['documented']} OR {WRITES['shared']}", "'row'"),
    *_name(f"{TRIES} AND k % 7 <> 3", "'work_' || k", "'more_' || k"),
    *_name("k % 7 = 3", "'handle'", "'close'"),
    *_name("k % 7 IN (0, 3, 4)", "'Exception'"),
    *_name("k % 7 = 1", "'ValueError'"),
    *_name("k % 7 = 4", "'KeyError'"),
    *_name(f"{WRITES['documented']} OR {WRITES['vow']}", "'a'"),
    *_name(WRITES["guard"], "'__name__'", "'argparse'", "'ArgumentParser'"),
    *_name(WRITES["touch"], "'open'", "'requests'", "'get'", "'run'"),
    *_name(WRITES["checks"], "'CHECKED'", "'m' || (k + 1)"),
]

TODOS = [
    "SELECT k, key, 'TODO' AS tag, 'TODO: check ' || p_name AS text, 8 AS lineno FROM read WHERE k % 9 = 0",
    "SELECT k, key, 'FIXME', 'fixme: ' || p_name, 8 FROM read WHERE k % 9 = 1",
    "SELECT k, key, 'HACK', '1. HACK it', 8 FROM read WHERE k % 9 = 5",
    "SELECT k, key, 'XXX', 'noqa: E501 XXX: z', 8 FROM read WHERE k % 9 = 6",
    f"SELECT k, key, 'TODO', 'TODO', 14 FROM read WHERE {WRITES['shape']}",
    f"SELECT k, key, 'TODO', 'TODO', 19 FROM read WHERE NOT {WRITES['documented']} AND k % 5 = 0",
]

#: Lines of a module that are not blank, each with its condition.
WRITTEN = [
    WRITES["shebang"], WRITES["docstring"], WRITES["import"], f"({HAS['ahead']} OR {HAS['back']} OR {WRITES['sibling']} OR {WRITES['absolute']})", WRITES["json"], WRITES["thing"], f"({HAS['exported']} OR {HAS['extended']})", "true", "true", WRITES["loading"],
    f"({HAS['square']} OR {HAS['ring']})", *[f"({HAS['shape']} OR {HAS['square']} OR {HAS['ring']} OR {HAS['port']})"] * 3, *[f"({HAS['shape']} OR {HAS['square']})"] * 2, f"({HAS['made']} OR {HAS['routed']})", "true", "true",
    *[WRITES["shared"]] * 4, *[WRITES["settled"]] * 2, TRIES, TRIES, f"({TRIES} AND k % 7 <> 3)", TRIES, TRIES, *[f"({HAS['documented']} OR {HAS['vow']})"] * 3, *[WRITES["documented"]] * 13,
    *[WRITES["guard"]] * 2, WRITES["process"], *[WRITES["touch"]] * 2, WRITES["broken"], WRITES["checks"],
]

COMMENTS = ["true", "true", WRITES["shebang"], f"({HAS['json']} AND k % 5 IN (0, 1))", WRITES["shape"], f"(NOT {WRITES['documented']} AND k % 5 = 0)", "(k % 7 = 2)"]


def count_of(conditions: list[str]) -> str:
    return " + ".join(f"CAST({c} AS INTEGER)" for c in conditions)


def line_text(lineno: str) -> str:
    """Text of the lines that may be evidence."""
    return (
        f"CASE {lineno} WHEN 3 THEN 'from ' || {module(half('k'))} || ' import job_' || {half('k')} WHEN 4 THEN CASE WHEN {HAS['ahead']} THEN 'import ' || {module('k + 1')} WHEN {HAS['back']} THEN 'import ' || {module('k - 1')} WHEN {HAS['sibling']} THEN 'from . import m' || (k + {codebase.FOLDERS}) ELSE 'import m' || (k - 1) END "
        f"WHEN 11 THEN CASE WHEN {HAS['square']} THEN 'from ' || {module('k - 3')} || ' import Shape_' || (k - 3) ELSE 'from ' || {module('k - 4')} || ' import Shape_' || (k - 4) END "
        f"WHEN 17 THEN 'ROOT = Shape_' || (k - 3) || '()' WHEN 19 THEN '    return job_' || {half('k')} || '(row)' END"
    )


def _fits(width) -> str:
    """Cards side by side within a width."""
    return f"greatest(1, CAST(floor(({width} + {G.CARD_GAP}) / {G.CARD_W + G.CARD_GAP}) AS INTEGER))"


def _parts_of(key: str) -> str:
    return f"string_split({key}, '.')"


def _gated(category: str) -> str:
    gate = texts(EFFECT_IMPORTS[category])
    return (
        f"CASE WHEN contains(c.name, '.') THEN {first('c.name')} IN (SELECT root FROM roots_of r WHERE r.key = c.key) OR {first('c.name')} IN ('self', 'cls', {gate}) "
        f"ELSE EXISTS (SELECT 1 FROM roots_of r WHERE r.key = c.key AND r.root IN ({gate})) END"
    )


FACTS: dict[str, str] = {
    "read": f"SELECT p_partkey AS k, {path('p_partkey')} AS relpath, {module('p_partkey')} AS key, {family('p_partkey')} AS g, p_name, p_brand, p_size, FALSE AS foreign_ FROM part WHERE NOT ({HAS['foreign'].replace('k ', 'p_partkey ')})",
    "good": f"SELECT * FROM read WHERE NOT {WRITES['broken']}",
    "modules": f"""
      SELECT k, key, relpath, 53 AS loc, 53 - ({count_of(WRITTEN)}) AS blank, {count_of(COMMENTS)} AS comment_lines, CASE WHEN {HAS['broken']} THEN 'syntax error' END AS error, NOT {WRITES['broken']} AND {WRITES['guard']} AS has_main_guard,
             {WRITES['shebang']} AS shebang, CASE WHEN NOT {WRITES['broken']} AND {WRITES['docstring']} THEN 'Makes parts of ' || p_brand || '.' END AS docstring FROM read
      UNION ALL SELECT p_partkey, {module('p_partkey')}, {path('p_partkey')}, 1, 0, 0, 'Python refuses', FALSE, FALSE, NULL FROM part WHERE {HAS['foreign'].replace('k ', 'p_partkey ')}""",
    "definitions": "SELECT *, coalesce(parent || '.', '') || name AS qualname FROM (" + union(DEFINITIONS) + ")",
    "imports": union(IMPORTS),
    "calls": union(CALLS),
    "names_used": "SELECT DISTINCT k, key, name FROM (" + union([*NAMES, "SELECT k, key, 'x' FROM modules WHERE error = 'Python refuses'"]) + ")",
    "todos": union(TODOS),
    "disabled": "SELECT k, key, 8 AS lineno FROM read WHERE k % 9 = 3",
    "kept": f"SELECT k, key, 5 AS lineno FROM read WHERE {WRITES['json']} AND k % 5 IN (0, 1)",
    "symbols": f"SELECT k, key, 'Limit' || (k % 5) AS text FROM read UNION ALL SELECT k, key, 'thing_' || k FROM good WHERE {WRITES['exported']} OR {WRITES['extended']}",
    "swallowed": "SELECT k, key, 29 AS lineno FROM good WHERE k % 7 IN (0, 4)",
    "import_effects": f"SELECT k, key, 'Expr' AS node_type, 7 AS lineno FROM good WHERE {WRITES['extended']} AND NOT {WRITES['exported']} UNION ALL SELECT k, key, 'Expr', 10 FROM good WHERE {WRITES['loading']} UNION ALL SELECT k, key, 'Assign', 17 FROM good WHERE {WRITES['made']} UNION ALL SELECT k, key, 'Try', 26 FROM good WHERE {TRIES}",
    "written": f"""
      SELECT *, CASE WHEN level > 0 THEN array_to_string(list_filter([array_to_string({_parts_of('key')}[1:len({_parts_of('key')}) - level], '.'), target], lambda x: x <> ''), '.') ELSE target END AS full_name FROM imports""",
    "tails": f"SELECT {last('key')} AS tail, arg_min(key, k) AS key FROM modules GROUP BY 1",
    "candidates": f"""
      SELECT k, key, target, bound, lineno, level, imported, full_name, unnest([full_name || '.' || imported, CASE WHEN bound <> imported THEN full_name || '.' || bound END, full_name, regexp_replace(full_name, '\\.?[^.]*$', '')]) AS candidate,
             unnest([0, 1, 2, 3]) AS place FROM written WHERE full_name <> ''""",
    "hits": "SELECT c.key, c.lineno, c.bound, c.target, arg_min(c.candidate, c.place) AS dst FROM candidates c JOIN modules m ON m.key = c.candidate GROUP BY ALL",
    "resolved": f"SELECT w.*, coalesce(h.dst, t.key) AS dst FROM written w LEFT JOIN hits h USING (key, lineno, bound, target) LEFT JOIN tails t ON w.full_name <> '' AND t.tail = {last('w.full_name')}",
    "edges": "SELECT DISTINCT key AS src, dst FROM resolved WHERE dst IS NOT NULL AND dst <> key",
    "bindings": "SELECT DISTINCT k, key AS src, dst, bound FROM resolved WHERE dst IS NOT NULL AND dst <> key",
    "evidence": f"""
      SELECT DISTINCT src, dst, lineno, {line_text('lineno')} AS text FROM (
        SELECT k, key AS src, dst, lineno FROM resolved WHERE dst IS NOT NULL AND dst <> key
        UNION SELECT c.k, b.src, b.dst, c.lineno FROM calls c JOIN bindings b ON b.src = c.key AND (c.name = b.bound OR {first('c.name')} = b.bound))""",
    "entry_points": f"""
      SELECT key, list_filter([CASE WHEN has_main_guard THEN 'has a __main__ guard' END, CASE WHEN shebang THEN 'has a shebang' END,
                               CASE WHEN has_main_guard THEN 'parses arguments' END, CASE WHEN relpath LIKE '%main.py' THEN 'is named like a program' END], lambda x: x IS NOT NULL) AS reasons
      FROM modules WHERE has_main_guard OR shebang OR relpath LIKE '%main.py'""",
    "declared": f"SELECT {module('p_partkey')} AS key, 'declared as ' || {module('p_partkey')} || ':main in scripts' AS why FROM part WHERE p_partkey % 61 = 20",
    "conventional": "SELECT key, CASE " + " ".join(f"WHEN regexp_matches(relpath, '{rule}') THEN ['{name}', '{loader}']" for rule, name, loader in CONVENTIONS) + " END AS c FROM modules",
    "loaded_by": """
      SELECT m.key, CASE WHEN d.key IS NOT NULL THEN 'declared entry' ELSE c.c[1] END AS name, CASE WHEN d.key IS NOT NULL THEN 'pyproject.toml' ELSE c.c[2] END AS loader,
             coalesce(d.why, 'loaded by name by ' || c.c[2]) AS why, d.key IS NOT NULL AS proven
      FROM modules m JOIN conventional c USING (key) LEFT JOIN declared d USING (key) WHERE d.key IS NOT NULL OR c.c IS NOT NULL""",
    "roots": """
      SELECT key, arg_min(place, place) AS place, arg_min(reason, place) AS reason FROM (
        SELECT key, 0 AS place, array_to_string(reasons, '; ') AS reason FROM entry_points UNION ALL SELECT key, 1, why FROM loaded_by) GROUP BY key""",
    "walk": "SELECT key AS node, 0 AS depth FROM roots UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 40",
    "layers": "SELECT node, min(depth) AS depth FROM walk GROUP BY node",
    "orphans": "SELECT key, relpath, loc, k FROM modules WHERE key NOT IN (SELECT dst FROM edges) AND key NOT IN (SELECT key FROM roots)",
    "roots_of": f"SELECT DISTINCT key, root FROM (SELECT key, {first('target')} AS root FROM imports UNION SELECT key, {first('bound')} FROM imports) WHERE root <> ''",
    "effect_words": "SELECT * FROM (VALUES " + pairs((c, w) for c, ws in EFFECTS.items() for w in ws) + ") AS t(category, word)",
    "effects": f"""
      SELECT c.key, e.category, c.name AS call, c.lineno FROM calls c JOIN effect_words e ON e.word = {last('c.name')}
      WHERE CASE e.category {' '.join(f"WHEN '{c}' THEN {_gated(c)}" for c in EFFECT_IMPORTS)} ELSE TRUE END""",
    "subclasses": "SELECT d.key, d.name AS sub, r.dst AS b_key, d.bases AS b_class FROM definitions d JOIN resolved r ON r.key = d.key AND r.bound = d.bases JOIN definitions b ON b.key = r.dst AND b.name = d.bases AND b.kind = 'class' WHERE d.kind = 'class'",
    "links": "SELECT DISTINCT key, b_class AS written, b_key, b_class FROM subclasses UNION SELECT DISTINCT c.key, c.name, r.dst, c.name FROM calls c JOIN resolved r ON r.key = c.key AND r.bound = c.name JOIN definitions b ON b.key = r.dst AND b.name = c.name AND b.kind = 'class'",
    "own_methods": "SELECT key, parent, name FROM definitions WHERE kind = 'method' AND name <> 'extra'",
    "replaced": """
      SELECT s.b_key AS key, s.b_class AS parent, o.name FROM subclasses s JOIN own_methods o ON o.key = s.key AND o.parent = s.sub
      WHERE EXISTS (SELECT 1 FROM definitions d WHERE d.key = s.b_key AND d.parent = s.b_class AND d.name = o.name)
        AND NOT EXISTS (SELECT 1 FROM calls c JOIN links l ON l.key = c.key AND l.written = c.name WHERE l.b_key = s.b_key AND l.b_class = s.b_class)
      GROUP BY s.b_key, s.b_class, o.name HAVING count(DISTINCT s.sub) = any_value((SELECT count(DISTINCT x.sub) FROM subclasses x WHERE x.b_key = s.b_key AND x.b_class = s.b_class))""",
    "shares": "SELECT key, avg(CASE WHEN docstring IS NULL THEN 0.0 ELSE 1.0 END) AS documented FROM definitions WHERE parent IS NULL AND NOT starts_with(name, '_') GROUP BY key",
    "unused": f"""
      SELECT i.k, i.key, i.bound, i.target, i.lineno FROM imports i JOIN good m USING (key)
      WHERE m.relpath NOT LIKE '%/__init__.py' AND {first('i.bound')} NOT IN (SELECT name FROM names_used n WHERE n.key = i.key) AND {first('i.bound')} NOT IN (SELECT text FROM symbols s WHERE s.key = i.key)
        AND i.lineno NOT IN (SELECT lineno FROM kept x WHERE x.key = i.key)""",
    "declared_shapes": "SELECT key, parent, name FROM replaced UNION SELECT key, parent, name FROM definitions WHERE bases = 'Protocol' AND kind = 'method'",
    "signals": """
      SELECT key, CASE WHEN error = 'syntax error' THEN 'syntax_error' ELSE 'unreadable' END AS kind, '' AS text, 0 AS lineno FROM modules WHERE error IS NOT NULL
      UNION ALL SELECT key, 'todo', text, lineno FROM todos WHERE key IN (SELECT key FROM good)
      UNION ALL SELECT key, CASE body_kind WHEN 'pass' THEN 'stub_pass' WHEN 'ellipsis' THEN 'stub_ellipsis' ELSE 'not_implemented' END, qualname, lineno FROM definitions d
        WHERE kind <> 'class' AND body_kind <> 'code' AND (says OR body_kind = 'ellipsis') AND NOT EXISTS (SELECT 1 FROM declared_shapes s WHERE s.key = d.key AND s.parent = d.parent AND s.name = d.name)
      UNION ALL SELECT d.key, 'no_docstring', qualname, lineno FROM definitions d JOIN shares s USING (key) WHERE kind = 'function' AND d.docstring IS NULL AND end_lineno - lineno >= 10 AND s.documented >= 0.8
      UNION ALL SELECT key, 'promised_return', qualname, lineno FROM definitions WHERE promises AND NOT returns AND body_kind = 'code'
      UNION ALL SELECT key, 'unused_import', bound || ' (from ' || CASE WHEN target <> '' THEN target ELSE 'import' END || ')', lineno FROM unused
      UNION ALL SELECT key, 'commented_code', 'commented-out code', lineno FROM disabled WHERE key IN (SELECT key FROM good)
      UNION ALL SELECT key, 'empty_except', 'exception silently ignored', lineno FROM swallowed
      UNION ALL SELECT key, 'orphan', 'nothing imports it', 0 FROM orphans
      UNION ALL SELECT key, 'unreached', 'no entry point leads to it', 0 FROM modules WHERE key NOT IN (SELECT node FROM layers) AND key NOT IN (SELECT key FROM orphans) AND key NOT IN (SELECT key FROM entry_points)""",
    "kinds": "SELECT key, kind, count(*) AS n FROM signals GROUP BY ALL",
    "weights": "SELECT * FROM (VALUES " + pairs(WEIGHTS.items()) + ") AS t(kind, weight)",
    "frontier": "SELECT key, round(sum(coalesce(weight, 1) * pow(n, 0.6)), 1) AS score, CAST(sum(n) AS BIGINT) AS n_signals FROM kinds LEFT JOIN weights USING (kind) GROUP BY key",
    "origins": f"""
      SELECT m.k, m.key, m.relpath, m.loc, CASE WHEN m.k % 23 = 6 THEN 'untracked' WHEN v.dir IS NOT NULL OR starts_with(relpath, 'pkg7/') THEN 'vendored' ELSE 'tracked' END AS origin,
             coalesce(v.dir, CASE WHEN starts_with(relpath, 'pkg7/') THEN 'pkg7/LICENSE' END) AS why
      FROM modules m LEFT JOIN (SELECT * FROM (VALUES {pairs((d,) for d in VENDOR_DIRS)}) AS t(dir)) v ON v.dir = string_split(relpath, '/')[1] AND contains(relpath, '/')""",
    "history": f"""
      SELECT m.key, m.relpath AS path, o.o_orderkey, o.o_orderdate, CAST(o.o_orderdate AS DATE) + {codebase.REBASED} AS day, o.o_orderpriority AS subject, 'cust' || (o.o_custkey % 7) AS author
      FROM (SELECT DISTINCT l_orderkey, {codebase.TOUCHES} AS part FROM lineitem) l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN modules m ON m.k = l.part""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY path ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest, row_number() OVER (PARTITION BY path ORDER BY o_orderdate, o_orderkey) AS oldest FROM history",
    "records": """
      SELECT key, path, count(*) AS commits, max(CASE WHEN newest = 1 THEN day END) AS touched, max(CASE WHEN oldest = 1 THEN strftime(day, '%Y-%m-%d') END) AS first_seen, max(CASE WHEN newest = 1 THEN strftime(day, '%Y-%m-%d') END) AS last_touched,
             max(CASE WHEN oldest = 1 THEN subject END) AS first_subject, max(CASE WHEN newest = 1 THEN subject END) AS last_subject, string_agg(DISTINCT author, ',' ORDER BY author) AS authors,
             string_agg(subject, '|' ORDER BY newest) FILTER (WHERE newest <= 8) AS subjects FROM placed GROUP BY key, path""",
    "changes": """
      SELECT x.path AS item_a, y.path AS item_b, count(*) AS n FROM history x JOIN history y ON x.o_orderkey = y.o_orderkey AND x.path < y.path
      WHERE x.o_orderkey IN (SELECT o_orderkey FROM history GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25) GROUP BY ALL HAVING count(*) >= 2""",
    "specific": f"SELECT DISTINCT key, name FROM definitions WHERE parent IS NULL AND NOT starts_with(name, '_') AND length(name) >= 4 AND name NOT IN ({texts(attempts.GENERIC)})",
    "tops": "SELECT key, count(*) FILTER (WHERE body_kind = 'code') AS filled, count(*) FILTER (WHERE body_kind <> 'code') AS empties, list(name ORDER BY name) FILTER (WHERE body_kind <> 'code') AS gaps FROM definitions WHERE parent IS NULL AND kind <> 'class' GROUP BY key",
    "mentions": f"SELECT {first('n.name')} AS tail, sum(x.tops) AS tests FROM (SELECT DISTINCT key, name FROM names_used WHERE {is_test('key')}) n JOIN (SELECT key, count(*) AS tops FROM definitions WHERE parent IS NULL GROUP BY key) x USING (key) GROUP BY 1",
    "scored": f"""
      SELECT m.k, m.key, m.relpath, m.loc, r.g, t.filled, t.empties, coalesce(t.gaps, []) AS gaps, CAST(coalesce(x.tests, 0) AS INTEGER) AS tests, l.node IS NOT NULL AS reachable, coalesce(d.n, 0) AS todos,
             CASE WHEN filled + empties > 0 THEN 7e-1 * filled / (filled + empties) ELSE 0e0 END AS body FROM modules m JOIN good r USING (key) JOIN tops t USING (key) LEFT JOIN mentions x ON x.tail = {last('m.key')} LEFT JOIN layers l ON l.node = m.key
      LEFT JOIN (SELECT key, count(*) AS n FROM todos GROUP BY key) d USING (key)""",
    "complete": """
      SELECT *, least(1e0, CASE WHEN todos > 0 THEN greatest(body, body + CASE WHEN reachable THEN 2e-1 ELSE 0e0 END + CASE WHEN tests > 0 THEN 1e-1 ELSE 0e0 END - least(3e-2 * todos, 12e-2)) ELSE body + CASE WHEN reachable THEN 2e-1 ELSE 0e0 END + CASE WHEN tests > 0 THEN 1e-1 ELSE 0e0 END END) AS raw FROM scored""",
    "judged": "SELECT *, round(raw, 3) AS score FROM complete",
    "sharing": f"""
      SELECT j.* FROM judged j JOIN origins o USING (key) WHERE (j.k % 4 < 2) AND o.origin <> 'vendored' AND NOT {is_test('j.key')}""",
    "families": "SELECT g, count(*) AS n FROM sharing GROUP BY g HAVING count(*) > 1",
    "in_families": "SELECT s.* FROM sharing s SEMI JOIN families f USING (g)",
    "aside": "SELECT *, starts_with(relpath, 'backup/') AS kept_aside FROM in_families",
    "copies": "SELECT a.g, a.key AS copy, b.key AS original FROM aside a JOIN aside b ON a.g = b.g AND a.kept_aside AND NOT b.kept_aside AND regexp_extract(a.relpath, '[^/]*$') = regexp_extract(b.relpath, '[^/]*$')",
    "groups": """
      SELECT g, 'restart' AS kind, key FROM aside WHERE key NOT IN (SELECT copy FROM copies) AND g IN (SELECT g FROM aside WHERE key NOT IN (SELECT copy FROM copies) GROUP BY g HAVING count(*) > 1)
      UNION ALL SELECT g, 'copy', unnest([copy, original]) FROM copies""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY g, kind ORDER BY score DESC, loc DESC, key) AS rank FROM groups JOIN judged USING (key, g)",
    "n_names": "SELECT key, count(*) AS n_names FROM specific GROUP BY key",
    "gaps_of": "SELECT g, kind, string_agg(name, ',' ORDER BY name) AS common_gaps FROM (SELECT g, kind, name, count(*) AS n FROM (SELECT g, kind, unnest(gaps) AS name FROM ranked) GROUP BY ALL) JOIN (SELECT g, kind, count(*) AS members FROM ranked GROUP BY ALL) USING (g, kind) WHERE n = members GROUP BY g, kind",
    "group_rows": """
      SELECT a.g, a.kind AS verdict, a.key AS resume_at, CAST(round_even(100 * a.score, 0) AS INTEGER) AS resume_percent, a.loc AS resume_lines, CAST(round_even(100 * (3e0 / n.n_names), 0) AS INTEGER) AS elsewhere_percent,
             CAST(round_even(a.loc * (round_even(100 * a.score, 0) / 100) * (1 - 3e0 / n.n_names), 0) AS INTEGER) AS at_stake_lines, CAST(round_even(a.loc * a.empties / (a.filled + a.empties), 0) AS INTEGER) AS remaining_lines,
             a.empties AS unwritten, CASE WHEN a.kind = 'copy' THEN b.relpath END AS copy_of, 'collect_' || a.g || ',refine_' || a.g || ',settle_' || a.g AS shared, coalesce(x.common_gaps, '') AS common_gaps, c.n AS n_members
      FROM ranked a JOIN n_names n USING (key) JOIN (SELECT g, kind, count(*) AS n FROM ranked GROUP BY ALL) c ON c.g = a.g AND c.kind = a.kind LEFT JOIN gaps_of x ON x.g = a.g AND x.kind = a.kind LEFT JOIN ranked b ON b.g = a.g AND b.kind = a.kind AND b.rank = 2 WHERE a.rank = 1""",
    "steps": "SELECT r.*, l.resume_at, row_number() OVER (PARTITION BY r.g, r.kind ORDER BY n_names, score, r.key) - 1 AS step FROM ranked r JOIN n_names n USING (key) JOIN group_rows l ON l.g = r.g AND l.verdict = r.kind",
    "held": "SELECT t.kind, t.resume_at, t.g, t.step, t.key, n.name FROM steps t JOIN specific n USING (key)",
    "known": "SELECT DISTINCT t.kind, t.resume_at, t.g, t.step, t.key, h.name FROM steps t JOIN held h ON h.g = t.g AND h.kind = t.kind AND h.step < t.step",
    "dead": f"""
      SELECT d.* FROM definitions d JOIN origins o USING (key) WHERE d.body_kind <> 'code' AND d.kind <> 'class' AND o.origin <> 'vendored' AND NOT {is_test('d.key')} AND d.bases <> 'Protocol' AND NOT EXISTS (SELECT 1 FROM replaced r WHERE r.key = d.key AND r.parent = d.parent AND r.name = d.name)""",
    "callers": f"SELECT {last('name')} AS name, key AS module, lineno, name AS written FROM calls",
    "tested": f"SELECT DISTINCT dst AS key FROM edges WHERE {is_test('src')}",
    "states": """
      SELECT m.key, CASE WHEN m.key IN (SELECT key FROM dead) THEN 'deadend' WHEN m.key IN (SELECT key FROM signals WHERE kind IN ('orphan', 'unreached')) THEN 'maybe' WHEN m.error IS NOT NULL THEN 'broken'
        WHEN t.key IS NOT NULL AND s.key IS NULL THEN 'confirmed' WHEN t.key IS NOT NULL THEN 'tested' WHEN s.key IS NULL THEN 'live' ELSE 'unfinished' END AS state
      FROM modules m LEFT JOIN tested t USING (key) LEFT JOIN (SELECT DISTINCT key FROM signals WHERE kind NOT IN ('no_docstring', 'unreached')) s USING (key)""",
    "severity": "SELECT * FROM (VALUES " + pairs((s, i) for i, s in enumerate(SEVERITY)) + ") AS t(state, severe)",
    "both_ways": "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges",
    "spread": "SELECT key AS node, key AS seen FROM modules UNION SELECT s.node, e.b FROM spread s JOIN both_ways e ON e.a = s.seen",
    "components": "SELECT node AS key, min(seen) AS cluster FROM spread GROUP BY node",
    "clusters": f"""
      SELECT c.cluster, count(*) AS size, CAST(sum(m.loc) AS BIGINT) AS loc, count(e.key) AS entries, count(*) FILTER (WHERE o.origin = 'untracked') AS untracked, max(m.loc || '|' || m.key) AS top,
             bool_or(e.key IS NOT NULL OR contains('{codebase.PROSE}', lower({first('m.key')}))) AS belongs FROM components c JOIN modules m USING (key) JOIN origins o USING (key) LEFT JOIN entry_points e ON e.key = m.key GROUP BY c.cluster""",
    "onward": "SELECT src AS a, dst AS b FROM edges UNION SELECT o.a, e.dst FROM onward o JOIN edges e ON e.src = o.b",
    "circling": "SELECT DISTINCT a AS node FROM onward WHERE a = b",
    "core": "SELECT node FROM circling UNION (SELECT b FROM onward WHERE a IN (SELECT node FROM circling) INTERSECT SELECT a FROM onward WHERE b IN (SELECT node FROM circling))",
    "live": "SELECT s.* FROM specific s WHERE key NOT IN (SELECT key FROM orphans)",
    "mine": "SELECT s.* FROM specific s WHERE key IN (SELECT key FROM orphans)",
    "counterparts": "SELECT key, arg_min(other, (-n, other)) AS counterpart FROM (SELECT m.key, l.key AS other, count(*) AS n FROM mine m JOIN live l ON l.name = m.name GROUP BY ALL HAVING count(*) >= 3) GROUP BY key",
    "stamps": "SELECT m.k, m.key, r.first_seen, CASE WHEN regexp_matches(relpath, '_2024[0-9]{4}[.]py$') THEN regexp_replace(regexp_extract(relpath, '_(2024[0-9]{4})', 1), '(....)(..)(..)', '\\1-\\2-\\3') END AS stamp FROM modules m LEFT JOIN records r USING (key)",
    "born": "SELECT key, least(first_seen, stamp) AS born, CASE WHEN first_seen <= coalesce(stamp, first_seen) THEN 'git' WHEN stamp IS NOT NULL THEN 'the filename' END AS born_from, first_seen IS NOT NULL AS recorded FROM stamps",
    "salvage": f"""
      SELECT o.key, o.loc, CASE WHEN c.counterpart IS NOT NULL AND a.born IS NOT NULL AND b.born IS NOT NULL THEN CASE WHEN a.born < b.born THEN '{VERDICTS['older']}' ELSE '{VERDICTS['later']}' END
        WHEN NOT a.recorded THEN '{VERDICTS['uncommitted']}' WHEN coalesce(w.n, 0) > 0 AND coalesce(u.n, 0) > 0 THEN '{VERDICTS['both']}' WHEN coalesce(w.n, 0) > 0 THEN '{VERDICTS['wired']}' WHEN coalesce(u.n, 0) > 0 THEN '{VERDICTS['unique']}' ELSE '{VERDICTS['none']}' END AS verdict,
        coalesce(u.n, 0) AS unique_count, coalesce(w.n, 0) AS uses_live_count, c.counterpart, a.born AS mine, a.born_from AS mine_from, b.born AS theirs, b.born_from AS theirs_from
      FROM orphans o JOIN born a USING (key) LEFT JOIN counterparts c USING (key) LEFT JOIN born b ON b.key = c.counterpart
      LEFT JOIN (SELECT key, count(*) AS n FROM mine WHERE name NOT IN (SELECT name FROM live) GROUP BY key) u USING (key)
      LEFT JOIN (SELECT src AS key, count(*) AS n FROM edges WHERE dst NOT IN (SELECT key FROM orphans) GROUP BY src) w USING (key)""",
    "vocabulary": f"""
      SELECT key, w, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[a-z]+')) AS w FROM definitions)
      WHERE length(w) > 2 AND w NOT IN ({texts(COMMON_WORDS)}) AND w NOT IN ({texts(STOPWORDS)}) GROUP BY ALL""",
    "quiet": "SELECT key, touched, (SELECT count(*) FROM records x WHERE x.touched > r.touched) AS later FROM records r",
    "stopped": f"""
      SELECT q.key AS a, q.touched AS a_at FROM quiet q WHERE later >= 3 AND NOT {is_test('q.key')} AND (q.key IN (SELECT key FROM frontier WHERE score >= {MIN_SCORE}) OR q.key IN (SELECT key FROM signals WHERE kind IN ('orphan', 'unreached')))""",
    "takers": "SELECT key AS b, touched AS b_at, commits, path FROM records WHERE NOT (regexp_matches(key, '(^|[.])test_[^.]*$|_test$') OR regexp_matches(path, '(^|/)test/') OR starts_with(path, 'tests/'))",
    "top_changes": "SELECT x.key AS a, y.key AS b FROM (SELECT * FROM changes ORDER BY n DESC, item_a, item_b LIMIT 40) c JOIN modules x ON x.relpath = c.item_a JOIN modules y ON y.relpath = c.item_b",
    "alike": "SELECT s.a, t.b FROM stopped s JOIN vocabulary v ON v.key = s.a JOIN vocabulary w ON w.w = v.w JOIN takers t ON t.b = w.key AND t.b_at > s.a_at AND t.b <> s.a GROUP BY ALL HAVING sum(least(v.n, w.n)) >= 2",
    "together": "SELECT s.a, t.b FROM (SELECT a, b FROM top_changes UNION SELECT b, a FROM top_changes) c JOIN stopped s USING (a) JOIN takers t ON t.b = c.b AND t.b_at > s.a_at",
    "specific_pairs": "SELECT a, b, list_sort(list(signal)) AS kinds FROM (SELECT a, b, 'vocabulary' AS signal FROM alike UNION ALL SELECT a, b, 'co-change' FROM together) GROUP BY a, b",
    "reach": "SELECT key, list(DISTINCT category) AS reach FROM effects GROUP BY key",
    "fork_pairs": """
      SELECT p.a, p.b, t.commits, list_sort(list_concat(p.kinds, list_filter([CASE WHEN contains(p.a, '.') AND regexp_replace(p.a, '[.][^.]*$', '') = regexp_replace(p.b, '[.][^.]*$', '') AND contains(p.b, '.') THEN 'package' END,
             CASE WHEN list_has_any(x.reach, y.reach) THEN 'effects' END], lambda s: s IS NOT NULL))) AS signals
      FROM specific_pairs p JOIN takers t USING (b) LEFT JOIN reach x ON x.key = p.a LEFT JOIN reach y ON y.key = p.b""",
    "kept_forks": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY len(signals) DESC, commits DESC, b) AS r FROM fork_pairs WHERE len(signals) >= 2) WHERE r <= 3",
    "in_folders": f"SELECT key, relpath, coalesce(nullif(regexp_extract(relpath, '^(.*)/[^/]*$', 1), ''), '{TOP_FOLDER}') AS folder, loc FROM modules",
    "sized": f"SELECT folder, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc, least({_fits(G.CHART_W - 2 * G.BOX_PAD)}, greatest(count(*), {_fits(f'floor(length(folder) * {G.LABEL_CHAR_W * 10:g}e-1 + {G.LABEL_MORE_W})')})) AS columns FROM in_folders GROUP BY folder",
    "ordered": f"SELECT *, columns * {G.CARD_W + G.CARD_GAP} - {G.CARD_GAP - 2 * G.BOX_PAD} AS w, CAST(ceil(modules / columns) AS INTEGER) * {G.CARD_H + G.CARD_GAP} - {G.CARD_GAP - G.BOX_LABEL_H - 2 * G.BOX_PAD} AS h, row_number() OVER (ORDER BY loc DESC, folder) AS i FROM sized",
    "shelves": f"""
      SELECT i, w, h, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(h AS BIGINT) AS tall FROM ordered WHERE i = 1
      UNION ALL SELECT o.i, o.w, o.h, CASE WHEN s.x + s.w + {G.BOX_GAP} + o.w > {G.CHART_W} THEN 0 ELSE s.x + s.w + {G.BOX_GAP} END, CASE WHEN s.x + s.w + {G.BOX_GAP} + o.w > {G.CHART_W} THEN s.y + s.tall + {G.BOX_GAP} ELSE s.y END,
             CASE WHEN s.x + s.w + {G.BOX_GAP} + o.w > {G.CHART_W} THEN o.h ELSE greatest(s.tall, o.h) END FROM shelves s JOIN ordered o ON o.i = s.i + 1""",
    "boxes": "SELECT o.folder, o.modules, o.loc, o.columns, o.w, o.h, s.x, s.y, s.x + o.w / 2 AS cx, s.y + o.h / 2 AS cy FROM ordered o JOIN shelves s USING (i)",
    "folder_pairs": "SELECT a.folder AS src_folder, b.folder AS dst_folder, count(*) AS n FROM edges JOIN in_folders a ON a.key = src JOIN in_folders b ON b.key = dst WHERE a.folder <> b.folder GROUP BY ALL",
    "aimed": f"""
      SELECT p.*, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS by_, b.cx - a.cx AS dx, b.cy - a.cy AS dy,
             least(CASE WHEN b.cx <> a.cx THEN (a.w / 2 + {G.RIBBON_OFF}) / abs(b.cx - a.cx) ELSE 1e300 END, CASE WHEN b.cy <> a.cy THEN (a.h / 2 + {G.RIBBON_OFF}) / abs(b.cy - a.cy) ELSE 1e300 END) AS s,
             least(CASE WHEN b.cx <> a.cx THEN (b.w / 2 + {G.RIBBON_OFF}) / abs(b.cx - a.cx) ELSE 1e300 END, CASE WHEN b.cy <> a.cy THEN (b.h / 2 + {G.RIBBON_OFF}) / abs(b.cy - a.cy) ELSE 1e300 END) AS e
      FROM folder_pairs p JOIN boxes a ON a.folder = p.src_folder JOIN boxes b ON b.folder = p.dst_folder""",
    "drawn": "SELECT src_folder, dst_folder, n, ax + dx * s AS sx, ay + dy * s AS sy, bx - dx * e AS ex, by_ - dy * e AS ey FROM aimed",
    "bowed": f"SELECT *, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) AS span, least({G.BOW_MOST}e0, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) * {G.BOW_SHARE * 100:g}e-2) AS bow FROM drawn",
    "depths": "SELECT m.key, coalesce(l.depth, (SELECT max(depth) + 1 FROM layers)) AS depth FROM modules m LEFT JOIN layers l ON l.node = m.key",
    "nodes": """
      SELECT m.key, s.state, coalesce(f.score, 0) AS score, d.depth, m.key IN (SELECT key FROM dead) AS stuck, coalesce(f.n_signals, 0) AS marks, row_number() OVER (ORDER BY coalesce(f.score, 0) DESC, m.key) AS place
      FROM modules m JOIN states s USING (key) JOIN depths d USING (key) LEFT JOIN frontier f USING (key)""",
    "few_nodes": "SELECT *, 'n' || (row_number() OVER (ORDER BY key) - 1) AS id FROM nodes WHERE place <= 120",
    "all_nodes": "SELECT *, 'n' || (row_number() OVER (ORDER BY key) - 1) AS id FROM nodes",
    "shown_hits": "SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY lineno, text) AS r, count(*) OVER (PARTITION BY key, kind) AS n FROM signals",
}


def _needed(sql: str) -> list[str]:
    """Names of FACTS that a statement reads, directly or not, in order of definition."""
    found: set[str] = set()
    pending = [sql]
    while pending:
        for name in set(re.findall(r"[a-z_]+", pending.pop())) & set(FACTS) - found:
            found.add(name)
            pending.append(FACTS[name])
    return [n for n in FACTS if n in found]


def over_facts(sql: str) -> str:
    """A statement behind the facts that it needs; it may begin with further tables, after a comma."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({FACTS[n]})" for n in _needed(sql)) + "\n" + sql


#: The layered chart, as further tables of a statement: a step of the recursion is one layer of one sweep.
LAYERED = f"""
      , chart_pool AS (SELECT max(depth) + 1 AS pool FROM layers),
      chart_nodes AS (SELECT node, depth, FALSE AS apart FROM layers UNION ALL SELECT key, pool, TRUE FROM modules, chart_pool WHERE key NOT IN (SELECT node FROM layers)),
      chart_steps AS (SELECT max(depth) AS deep FROM chart_nodes),
      chart_sweep AS (
        SELECT 0 AS t, node, depth, row_number() OVER (PARTITION BY depth ORDER BY node) - 1 AS place FROM chart_nodes
        UNION ALL
        SELECT t + 1, node, depth, CASE WHEN depth = target THEN row_number() OVER (PARTITION BY depth ORDER BY mean NULLS LAST, node) - 1 ELSE place END FROM (
          SELECT w.t, w.node, w.depth, w.place, w.target, m.mean FROM (SELECT s.*, CASE WHEN (t // deep) % 2 = 0 THEN 1 + t % deep ELSE deep - 1 - t % deep END AS target FROM chart_sweep s, chart_steps WHERE t < {G.SWEEPS} * deep) w
          LEFT JOIN (
            SELECT e.dst AS node, avg(q.place) AS mean FROM chart_sweep q JOIN edges e ON e.src = q.node JOIN chart_nodes d ON d.node = e.dst, chart_steps
            WHERE (q.t // deep) % 2 = 0 AND q.depth = q.t % deep AND d.depth = q.depth + 1 GROUP BY e.dst
            UNION ALL
            SELECT e.src, avg(q.place) FROM chart_sweep q JOIN edges e ON e.dst = q.node JOIN chart_nodes d ON d.node = e.src, chart_steps
            WHERE (q.t // deep) % 2 = 1 AND q.depth = deep - q.t % deep AND d.depth = q.depth - 1 GROUP BY e.src) m ON m.node = w.node AND w.depth = w.target)),
      chart_final AS (SELECT s.node, s.depth, s.place FROM chart_sweep s, chart_steps WHERE t = {G.SWEEPS} * deep),
      chart_sized AS (SELECT depth, apart, count(*) AS n FROM chart_nodes GROUP BY ALL),
      chart_rows AS (SELECT depth, n, coalesce(sum(ceil(n / {G.ROW_MAX})) OVER (ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN apart AND depth > 0 THEN 1 ELSE 0 END AS first, least(max(n) OVER (), {G.ROW_MAX}) AS widest FROM chart_sized),
      spots AS (
        SELECT node AS key, depth, {G.MARGIN} + (widest - least(n - place // {G.ROW_MAX} * {G.ROW_MAX}, {G.ROW_MAX})) * {(G.NODE_W + G.X_GAP) / 2:g} + place % {G.ROW_MAX} * {G.NODE_W + G.X_GAP} AS x, {G.MARGIN} + (first + place // {G.ROW_MAX}) * {G.NODE_H + G.Y_GAP} AS y
        FROM chart_final JOIN chart_rows USING (depth))
      """
#: Regions, as further tables of a statement.
REGIONS = """
      , lines AS (SELECT key, lineno FROM signals WHERE lineno > 0 UNION SELECT key, lineno FROM definitions), few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lineno) AS r FROM lines) WHERE r <= 160),
      spans AS (SELECT key, greatest(lineno - 3, 1) AS lo, least(lineno + 3, loc) AS hi FROM few JOIN modules USING (key)),
      marked AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM spans),
      numbered AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked), merged AS (SELECT key, min(lo) AS low, max(hi) AS high FROM numbered GROUP BY key, island)"""
SNIPPETS = REGIONS + f""", cut AS (SELECT key, low, high FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY low) AS r FROM merged) WHERE r <= 40),
      named AS (SELECT * REPLACE (k AS k), {', '.join(f"{e} AS {c}" for c, e in codebase.NAMED.items())} FROM (SELECT p_partkey AS k, p_name, p_brand, p_size FROM part)),
      texts AS (SELECT relpath, [{', '.join(codebase._lines())}] AS lines FROM named)
      SELECT key, low, array_to_string(lines[low:high], chr(10)) AS lines FROM cut JOIN modules USING (key) JOIN texts USING (relpath) WHERE error IS NULL OR error <> 'Python refuses'
      UNION ALL SELECT key, low, 'x = "' || chr(233) || '"' FROM cut JOIN modules USING (key) WHERE error = 'Python refuses'"""
BODIES: dict[str, str] = {
    "modules": "SELECT key, relpath, loc, blank, comment_lines, error, CASE error WHEN 'syntax error' THEN 52 WHEN 'Python refuses' THEN 1 END AS error_line, has_main_guard, shebang, docstring, coalesce(error = 'syntax error', FALSE) AS cut FROM modules",
    "imports": "SELECT key, target, bound, lineno, level, imported FROM imports",
    "definitions": "SELECT key, qualname, name, kind, lineno, end_lineno, args, docstring, decorators, FALSE AS is_async, parent, body_kind, returns, bases, FALSE AS nested, promises, says FROM definitions",
    "calls": "SELECT key, name, lineno FROM calls",
    "names_used": "SELECT key, name FROM names_used",
    "symbol_strings": "SELECT key, text FROM symbols",
    "tags": "SELECT key, tag, text, lineno FROM todos",
    "disabled_code": "SELECT key, lineno FROM disabled",
    "waivers": "SELECT key, lineno FROM kept",
    "swallowed": "SELECT key, lineno FROM swallowed",
    "import_effects": "SELECT key, node_type, lineno FROM import_effects",
    "index": "SELECT count(*) AS files, CAST(sum(loc) AS BIGINT) AS lines, count(*) FILTER (WHERE relpath LIKE '%/__init__.py') AS packages, CAST(0 AS BIGINT) AS unreadable FROM modules",
    "accounting": """
      SELECT relpath, pruned, CASE WHEN pruned IS NOT NULL THEN 'excluded' WHEN row_number() OVER (PARTITION BY pruned IS NULL ORDER BY replace(folder, '/', chr(1)), relpath) <= 1500 THEN 'file' ELSE 'skipped' END AS kind
      FROM (SELECT relpath, regexp_extract(relpath, '^(.*)/[^/]*$', 1) AS folder, nullif(regexp_extract(relpath, '(^|/)(vendor|migrations)/', 2), '') AS pruned FROM modules)""",
    "excluded": """
      SELECT kind, folder, count(*) AS n FROM (SELECT coalesce(pruned, '') AS folder, CASE WHEN pruned IS NOT NULL THEN 'excluded' WHEN row_number() OVER (PARTITION BY pruned IS NULL ORDER BY k) <= 1500 THEN 'file' ELSE 'skipped' END AS kind
      FROM (SELECT k, nullif(regexp_extract(relpath, '(^|/)(vendor|migrations)/', 2), '') AS pruned FROM modules)) GROUP BY ALL""",
    "resolved": "SELECT key, lineno, bound, target, full_name, dst FROM resolved",
    "edges": "SELECT src, dst FROM edges",
    "external": f"SELECT DISTINCT key AS src, {first('target')} AS root FROM resolved WHERE dst IS NULL AND target <> ''",
    "evidence": "SELECT src, dst, lineno, text FROM evidence",
    "entry_points": "SELECT key, array_to_string(reasons, '; ') AS reasons FROM entry_points",
    "loaded_by": "SELECT key, name, loader, why, proven FROM loaded_by",
    "roots": "SELECT key, place, reason FROM roots",
    "layers": "SELECT node, depth FROM layers",
    "orphans": "SELECT key, relpath, loc FROM orphans",
    "unreferenced": f"""
      SELECT key, qualname, kind, lineno, CASE WHEN decorators = 'app.route' THEN 'a framework may call it' END AS caveat FROM definitions
      WHERE name NOT IN (SELECT name FROM names_used UNION SELECT {last('name')} FROM calls UNION SELECT bound FROM imports)""",
    "fan": "SELECT key, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM modules LEFT JOIN (SELECT dst AS key, count(*) AS n FROM edges GROUP BY 1) i USING (key) LEFT JOIN (SELECT src AS key, count(*) AS n FROM edges GROUP BY 1) o USING (key)",
    "cycles": "SELECT src, dst FROM edges WHERE src IN (SELECT node FROM core) AND dst IN (SELECT node FROM core)",
    "trace": """
      , hidden AS (SELECT key FROM states WHERE state IN ('deadend', 'broken') AND key <> 'pkg7'), clear AS (SELECT * FROM edges WHERE src NOT IN (SELECT key FROM hidden) AND dst NOT IN (SELECT key FROM hidden)),
      downward AS (SELECT 'pkg7' AS node, 0 AS depth UNION SELECT c.dst, w.depth + 1 FROM downward w JOIN clear c ON c.src = w.node WHERE w.depth < 40),
      upward AS (SELECT 'pkg7' AS node, 0 AS depth UNION SELECT c.src, w.depth + 1 FROM upward w JOIN clear c ON c.dst = w.node WHERE w.depth < 40)
      SELECT 'uses' AS direction, node, min(depth) AS depth, (SELECT count(DISTINCT dst) FROM edges WHERE src IN (SELECT node FROM downward) AND dst IN (SELECT key FROM hidden)) AS left_out FROM downward GROUP BY node
      UNION ALL SELECT 'used_by', node, min(depth), (SELECT count(DISTINCT src) FROM edges WHERE dst IN (SELECT node FROM upward) AND src IN (SELECT key FROM hidden)) FROM upward GROUP BY node""",
    "neighbourhood": "SELECT 'pkg1' AS key UNION SELECT dst FROM edges WHERE src = 'pkg1' UNION SELECT src FROM edges WHERE dst = 'pkg1'",
    "effects": "SELECT key, category, call, lineno FROM effects",
    "class_links": "SELECT key, written, b_key, b_class FROM links",
    "replaced_methods": "SELECT key, parent, name FROM replaced",
    "unused_imports": "SELECT key, bound, target, lineno FROM unused",
    "signals": "SELECT key, kind, text, lineno FROM signals",
    "frontier": """
      SELECT m.key, m.relpath, m.loc, f.score, c.counts FROM modules m JOIN frontier f USING (key) JOIN (SELECT key, '{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}' AS counts FROM kinds GROUP BY key) c USING (key)""",
    "totals": "SELECT kind, count(*) AS n FROM signals GROUP BY kind",
    "dead_ends": """
      , sites AS (SELECT name, count(DISTINCT (module, lineno, written)) AS calls, min(module) AS first_module FROM callers GROUP BY name),
      beside AS (SELECT key, coalesce(parent, '') AS p, string_agg(name, ', ' ORDER BY ord) AS beside FROM (SELECT *, row_number() OVER (PARTITION BY key, parent ORDER BY ord) AS r FROM definitions WHERE kind <> 'class' AND body_kind = 'code') WHERE r <= 4 GROUP BY ALL)
      SELECT d.key, d.qualname, d.kind, d.lineno, coalesce(s.calls, 0) AS calls, coalesce(s.first_module <> d.key, FALSE) AS called_from_elsewhere,
             nullif(concat_ws('; ', CASE WHEN trim(replace(d.args, 'self', ''), ',') <> '' THEN 'takes ' || replace(trim(replace(d.args, 'self', ''), ','), ',', ', ') END, CASE WHEN b.beside IS NOT NULL THEN 'sits beside finished ' || b.beside END), '') AS direction
      FROM dead d LEFT JOIN sites s USING (name) LEFT JOIN beside b ON b.key = d.key AND b.p = coalesce(d.parent, '')""",
    "callers": "SELECT DISTINCT name, module, lineno, written AS \"as\" FROM callers WHERE name IN (SELECT name FROM dead)",
    "dead_ends_by_module": "SELECT key, count(*) AS n, string_agg(qualname, ',' ORDER BY lineno, qualname) AS names FROM dead GROUP BY key",
    "attempts": "SELECT verdict, resume_at, resume_percent, resume_lines, elsewhere_percent, at_stake_lines, remaining_lines, unwritten, copy_of, shared, common_gaps, n_members FROM group_rows",
    "attempt_members": "SELECT r.kind AS verdict, l.resume_at, r.key, r.rank, CAST(round_even(100 * r.score, 0) AS INTEGER) AS percent, r.loc AS lines, r.tests FROM ranked r JOIN group_rows l ON l.g = r.g AND l.verdict = r.kind",
    "attempt_lineage": """
      , met AS (SELECT g, kind, name, min(step) AS step FROM held GROUP BY ALL),
      sides AS (SELECT t.kind, t.resume_at, t.step, t.key, m.name, m.step < t.step AS before, h.name IS NOT NULL AS has FROM steps t JOIN met m ON m.g = t.g AND m.kind = t.kind AND m.step <= t.step LEFT JOIN held h ON h.key = t.key AND h.kind = t.kind AND h.g = t.g AND h.name = m.name)
      SELECT kind AS verdict, resume_at, step, key, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE has AND NOT before), '') AS added,
             coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE before AND NOT has), '') AS dropped, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE before AND has), '') AS carried
      FROM sides GROUP BY kind, resume_at, step, key""",
    "verdicts": """
      SELECT key, CASE WHEN kind = 'copy' THEN 'copy' WHEN rank = 1 THEN 'resume' ELSE 'superseded' END AS verdict, resume_at, percent FROM (
        SELECT r.key, r.kind, r.rank, l.resume_at, CAST(round_even(100 * r.score, 0) AS INTEGER) AS percent, row_number() OVER (PARTITION BY r.key ORDER BY r.kind = 'copy') AS place FROM ranked r JOIN group_rows l ON l.g = r.g AND l.verdict = r.kind) WHERE place = 1""",
    "salvage": "SELECT * FROM salvage",
    "salvage_totals": "SELECT verdict, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS lines FROM salvage GROUP BY verdict",
    "clusters": "SELECT cluster, size, loc, entries, untracked, regexp_replace(top, '^[0-9]*[|]', '') AS label, belongs FROM clusters",
    "set_aside": "SELECT key FROM components JOIN clusters USING (cluster) WHERE NOT belongs",
    "file_history": "SELECT path, commits, first_seen, last_touched, first_subject, last_subject, authors, subjects FROM records",
    "co_change": "SELECT item_a, item_b, n FROM changes",
    "timeline": "SELECT first_seen[1:7] AS month, count(*) AS n, min(path) AS first_key FROM records GROUP BY 1",
    "timeline_files": "SELECT first_seen[1:7] AS month, path FROM records",
    "import_cycles": """
      , rings AS (SELECT a.src AS a, a.dst AS b FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst),
      back AS (SELECT a AS ring, a AS entry, [a] AS way FROM rings UNION SELECT a, b, [b] FROM rings UNION ALL SELECT w.ring, w.entry, list_prepend(e.src, w.way) FROM back w JOIN edges e ON e.dst = w.way[1] WHERE NOT list_contains(w.way, e.src)),
      entries AS (SELECT ring, arg_min(entry, way) AS entry FROM (SELECT w.ring, w.entry, w.way FROM back w JOIN rings r ON r.a = w.ring WHERE NOT list_contains(w.way[:-2], r.a) AND NOT list_contains(w.way[:-2], r.b)) GROUP BY ring)
      SELECT entry || ' -> ' || CASE WHEN entry = a THEN b ELSE a END || ' -> ' || entry AS nodes FROM entries JOIN rings ON ring = a""",
    "stalled": "SELECT path, commits, first_seen, last_touched, last_subject, date_diff('day', touched, (SELECT max(touched) FROM records)) AS days_quiet FROM records WHERE commits <= 2 AND date_diff('day', touched, (SELECT max(touched) FROM records)) >= 60",
    "origins": "SELECT key, loc, origin, why FROM origins",
    "origin_totals": "SELECT origin, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS lines FROM origins GROUP BY origin",
    "forks": """
      SELECT a AS stopped, b AS continued, array_to_string(signals, ',') AS signals, commits FROM kept_forks
      WHERE b NOT IN (SELECT b FROM kept_forks GROUP BY b HAVING count(*) > greatest(2, floor((SELECT count(DISTINCT a) FROM kept_forks) * 0.10)))""",
    "regions": REGIONS + """
      SELECT key, low, high FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY low) AS r FROM merged) WHERE r <= 40""",
    "snippets": SNIPPETS,
    "line_marks": "SELECT key, lineno, string_agg(kind || ': ' || text, '; ' ORDER BY kind || ': ' || text) AS marks FROM signals WHERE lineno > 0 AND key IN (SELECT key FROM good) GROUP BY key, lineno",
    "tested": "SELECT key FROM tested",
    "states": "SELECT key, state FROM states",
    "state_tally": "SELECT state, count(*) AS modules FROM states GROUP BY state",
    "held_back": "SELECT loader, count(*) AS modules, count(*) FILTER (WHERE proven) AS proven FROM loaded_by GROUP BY loader",
    "folders": """
      , below AS (SELECT regexp_extract(relpath, '^(.*)/[^/]*$', 1) AS folder, loc, state FROM modules JOIN states USING (key)),
      modes AS (SELECT folder, state, row_number() OVER (PARTITION BY folder ORDER BY n DESC, severe) AS r FROM (SELECT folder, state, count(*) AS n FROM below GROUP BY ALL) JOIN severity USING (state))
      SELECT p.folder, count(*) AS modules, CAST(sum(p.loc) AS BIGINT) AS loc, any_value(m.state) AS state FROM below p JOIN modes m ON m.folder = p.folder AND m.r = 1 GROUP BY p.folder""",
    "ribbons": """
      , places AS (SELECT key, regexp_extract(relpath, '^(.*)/[^/]*$', 1) AS folder FROM modules)
      SELECT a.folder AS src_folder, b.folder AS dst_folder, count(*) AS n FROM edges JOIN places a ON a.key = src JOIN places b ON b.key = dst WHERE a.folder <> b.folder GROUP BY ALL""",
    "headline": """
      SELECT count(*) AS modules, CAST(sum(loc) AS BIGINT) AS lines, count(error) AS errors, 0 AS excluded, 0 AS skipped, (SELECT count(*) FROM entry_points) AS entries, (SELECT count(*) FROM orphans) AS orphans,
             (SELECT count(DISTINCT key) FROM signals WHERE kind = 'unreached') AS unreached, (SELECT count(*) FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS cycles FROM modules""",
    "scaffolds": """
      , used AS (SELECT d.key, d.qualname, d.lineno, list_sort(list(DISTINCT c.name)) AS names FROM definitions d JOIN calls c ON c.key = d.key AND c.lineno BETWEEN d.lineno AND d.end_lineno GROUP BY ALL),
      touched AS (SELECT d.key, d.qualname, d.lineno, string_agg(DISTINCT e.category, ', ' ORDER BY e.category) AS names FROM definitions d JOIN effects e ON e.key = d.key AND e.lineno BETWEEN d.lineno AND d.end_lineno GROUP BY ALL),
      users AS (SELECT dst AS key, list_sort(list(src)) AS names FROM edges GROUP BY dst)
      SELECT * FROM (SELECT d.key, d.qualname, d.lineno, concat_ws(chr(10), CASE WHEN d.args <> '' THEN 'takes: ' || replace(d.args, ',', ', ') END, 'calls: ' || array_to_string(u.names[1:10], ', ') || CASE WHEN len(u.names) > 10 THEN ' ...' ELSE '' END,
             'touches: ' || t.names, 'its module is used by: ' || array_to_string(x.names[1:6], ', ') || CASE WHEN len(x.names) > 6 THEN ' ...' ELSE '' END, CASE WHEN d.returns THEN 'returns a value' WHEN d.body_kind = 'code' THEN 'returns nothing' END) AS text
      FROM definitions d LEFT JOIN used u USING (key, qualname, lineno) LEFT JOIN touched t USING (key, qualname, lineno) LEFT JOIN users x ON x.key = d.key) WHERE text <> ''""",
    "attempt_sentences": """
      SELECT verdict, resume_at, at_stake_lines || CASE WHEN at_stake_lines = 1 THEN ' line' ELSE ' lines' END || ' at stake: the furthest attempt has ' || resume_lines || ', is ' || resume_percent || ' % written, and ' || elsewhere_percent || ' % of its names exist elsewhere' AS stake,
             CASE WHEN remaining_lines > 0 THEN 'about ' || remaining_lines || CASE WHEN remaining_lines = 1 THEN ' line' ELSE ' lines' END || ' to write, in ' || unwritten || CASE WHEN unwritten = 1 THEN ' definition' ELSE ' definitions' END || ' without a body' END AS effort,
             'no restart: the same file is also at ' || copy_of AS copy FROM group_rows""",
    "opening": """
      SELECT (SELECT format('{:,}', CAST(sum(n_members) AS BIGINT)) || ' files hold ' || format('{:,}', count(*)) || ' jobs that were started over' FROM group_rows WHERE verdict = 'restart') AS finding,
             (SELECT 'version history covers ' || format('{:,}', count(*) FILTER (WHERE origin <> 'untracked')) || ' of ' || format('{:,}', count(*)) || ' modules; ' || format('{:,}', count(*) FILTER (WHERE origin = 'untracked')) || ' were never committed' FROM origins) AS coverage""",
    "boxes": "SELECT folder, modules, loc, columns, w, h, x, y FROM boxes",
    "cards": f"""
      SELECT key, folder, x + {G.BOX_PAD} + (i % columns) * {G.CARD_W + G.CARD_GAP} AS x, y + {G.BOX_LABEL_H + G.BOX_PAD} + (i // columns) * {G.CARD_H + G.CARD_GAP} AS y
      FROM (SELECT f.key, b.folder, b.x, b.y, b.columns, row_number() OVER (PARTITION BY b.folder ORDER BY f.loc DESC, f.relpath) - 1 AS i FROM in_folders f JOIN boxes b USING (folder))""",
    "ribbon_paths": f"""
      SELECT src_folder, dst_folder, n, round(sx, 3) AS sx, round(sy, 3) AS sy, round((sx + ex) / 2 - (ey - sy) / span * bow, 3) AS mx, round((sy + ey) / 2 + (ex - sx) / span * bow, 3) AS my, round(ex, 3) AS ex, round(ey, 3) AS ey,
             round(least({G.WEIGHT_MOST}e0, {G.WEIGHT_BASE * 10:g}e-1 + log2(n + 1) * {G.WEIGHT_LOG * 10:g}e-1), 3) AS weight FROM bowed""",
    "layered": LAYERED + "SELECT key, x, y, depth FROM spots",
    "elbows": LAYERED + f"""
      SELECT src, dst, back, x1, y1, (y1 + y2) / 2 AS mid, x2, y2 FROM (
        SELECT src, dst, b.depth <= a.depth AS back, a.x + {G.NODE_W / 2:g} AS x1, a.y + CASE WHEN b.depth <= a.depth THEN 0 ELSE {G.NODE_H} END AS y1, b.x + {G.NODE_W / 2:g} AS x2, b.y + CASE WHEN b.depth <= a.depth THEN {G.NODE_H} ELSE 0 END AS y2
        FROM edges JOIN spots a ON a.key = src JOIN spots b ON b.key = dst)""",
    "mermaid": f"""
      SELECT unnest(['flowchart LR', {texts(f"  classDef {s} fill:{c}" for s, c in COLOURS.items())}]) AS line
      UNION ALL SELECT '  %% ' || (count(*) - 120) || ' of ' || count(*) || ' modules are not drawn' FROM nodes HAVING count(*) > 120
      UNION ALL SELECT unnest(['  subgraph d' || depth || '["' || CASE WHEN depth = 0 THEN 'entry points' ELSE 'depth ' || depth END || '"]', '    direction TB', '  end']) FROM (SELECT DISTINCT depth FROM few_nodes)
      UNION ALL SELECT unnest(['    ' || id || '["' || {last('key')} || '"]', '  class ' || id || ' ' || state || ';']) FROM few_nodes
      UNION ALL SELECT '  ' || a.id || CASE WHEN b.stuck THEN ' -.-> ' ELSE ' --> ' END || b.id FROM edges JOIN few_nodes a ON a.key = src JOIN few_nodes b ON b.key = dst""",
    "drawio": """
      SELECT id, key || CASE WHEN marks > 0 THEN ' (' || marks || ' signals)' ELSE '' END AS value, NULL AS source, NULL AS target, FALSE AS dashed FROM all_nodes
      UNION ALL SELECT NULL, NULL, a.id, b.id, b.stuck FROM edges JOIN all_nodes a ON a.key = src JOIN all_nodes b ON b.key = dst""",
    "frontier_lines": """
      SELECT unnest([format('{:>6g}', f.score) || '  ' || m.relpath || '  (' || m.loc || ' lines)', '']) AS line FROM frontier f JOIN modules m USING (key)
      UNION ALL SELECT '        ' || kind || ' -- ' || n FROM kinds
      UNION ALL SELECT '          ' || CASE WHEN lineno > 0 THEN 'line ' || lineno ELSE 'module' END || ': ' || text FROM shown_hits WHERE r <= 5 AND kind NOT IN ('syntax_error', 'unreadable')
      UNION ALL SELECT '          ... and ' || (n - 5) || ' more' FROM kinds WHERE n > 5""",
    "payload": """
      SELECT key, state, coalesce(u.n, 0) AS uses, coalesce(b.n, 0) AS used_by, coalesce(x.n, 0) AS external, coalesce(h.n, 0) AS hits, coalesce(e.n, 0) AS evidence FROM states
      LEFT JOIN (SELECT src AS key, count(*) AS n FROM edges GROUP BY 1) u USING (key) LEFT JOIN (SELECT dst AS key, count(*) AS n FROM edges GROUP BY 1) b USING (key)
      LEFT JOIN (SELECT key, least(count(DISTINCT split_part(target, '.', 1)), 12) AS n FROM resolved WHERE dst IS NULL AND target <> '' GROUP BY 1) x USING (key)
      LEFT JOIN (SELECT key, sum(least(n, 6)) AS n FROM kinds GROUP BY 1) h USING (key) LEFT JOIN (SELECT src AS key, sum(least(n, 8)) AS n FROM (SELECT src, dst, count(*) AS n FROM evidence GROUP BY ALL) GROUP BY 1) e USING (key)""",
    "window": """
      SELECT CASE verdict WHEN 'restart' THEN 'restarts' ELSE 'copies' END AS list, resume_at AS name, rank, more FROM (SELECT verdict, resume_at, row_number() OVER (PARTITION BY verdict ORDER BY at_stake_lines DESC, n_members DESC, resume_at) AS rank, greatest(count(*) OVER (PARTITION BY verdict) - CASE verdict WHEN 'restart' THEN 6 ELSE 4 END, 0) AS more FROM group_rows)
      WHERE rank <= CASE verdict WHEN 'restart' THEN 6 ELSE 4 END
      UNION ALL SELECT 'frontier', key, rank, more FROM (SELECT f.key, row_number() OVER (ORDER BY f.score DESC, m.relpath) AS rank, greatest(count(*) OVER () - 8, 0) AS more FROM frontier f JOIN modules m USING (key)) WHERE rank <= 8""",
}

#: Tables that further sections need, and what each section of the JSON document has a row for.
_AHEAD = {name: BODIES[name].rsplit("\n      SELECT ", 1) for name in ("regions", "scaffolds")}
SECTIONS = {
    "modules": "FROM modules", "edges": "FROM edges", "external": f"SELECT DISTINCT key, {first('target')} FROM resolved WHERE dst IS NULL AND target <> ''", "entry_points": "FROM entry_points", "loaded_by": "FROM loaded_by", "layers": "FROM layers",
    "orphans": "FROM orphans", "unreferenced": f"SELECT key FROM definitions WHERE name NOT IN (SELECT name FROM names_used UNION SELECT {last('name')} FROM calls UNION SELECT bound FROM imports)",
    "cycles": "SELECT a.src FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst", "cyclic_edges": "SELECT src FROM edges WHERE src IN (SELECT node FROM core) AND dst IN (SELECT node FROM core)", "fan": "FROM modules", "effects": "FROM effects", "frontier": "FROM frontier", "signals": "FROM signals", "evidence": "FROM evidence", "totals": "SELECT DISTINCT kind FROM signals",
    "attempts": "FROM group_rows", "dead_ends": "FROM dead", "left_behind": "FROM salvage", "origins": "FROM modules", "origin_totals": "SELECT DISTINCT origin FROM origins", "salvage_totals": "SELECT DISTINCT verdict FROM salvage", "dead_ends_by_module": "SELECT DISTINCT key FROM dead",
    "verdicts": "SELECT DISTINCT key FROM ranked", "attempt_sentences": "FROM group_rows", "held_back": "SELECT DISTINCT loader FROM loaded_by", "state_tally": "SELECT DISTINCT state FROM states", "line_marks": "SELECT DISTINCT key, lineno FROM signals WHERE lineno > 0",
    "totals_by_layer": "SELECT DISTINCT depth FROM layers", "clusters": "FROM clusters", "states": "FROM states", "folders": "SELECT DISTINCT folder FROM in_folders", "ribbons": "FROM folder_pairs", "file_history": "FROM records", "co_change": "SELECT item_a FROM changes LIMIT 40",
    "timeline_files": "FROM records", "authors": "SELECT DISTINCT author FROM history", "timeline": "SELECT DISTINCT first_seen[1:7] FROM records", "stalled": "SELECT path FROM records WHERE commits <= 2 AND date_diff('day', touched, (SELECT max(touched) FROM records)) >= 60",

    "forks": BODIES["forks"],
    "callers": BODIES["callers"],
    "snippets": "SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY low) AS r FROM merged) WHERE r <= 40",
    **{name: "SELECT " + rest for name, (_, rest) in _AHEAD.items()},
}
BODIES["sections"] = "".join(tables for tables, _ in _AHEAD.values()) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS section, count(*) AS n FROM ({rows})" for name, rows in SECTIONS.items()) + ")"
SQL: dict[str, str] = {"survey_" + name: over_facts(sql) for name, sql in BODIES.items()}
