"""The survey: questions about an inherited code base as DataFrame queries over its fact tables.

Each property is one finding, computed when asked for, by as many threads as ask. Tables that several findings
use are staged once. Every finding keeps its evidence, and says whether it is proven or inferred.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from threading import Lock, RLock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trowel.functions import text as T
from trowel.operators import geometry, graph, relations, summaries
from trowel.plans import attempts as A
from trowel.sources import facts, gitlog, packaging, tree
from trowel.session import stage_table

#: Weight of each signal; 1 for any other.
WEIGHTS = {"todo": 3, "stub_pass": 4, "stub_ellipsis": 4, "not_implemented": 4, "unused_import": 4, "commented_code": 3, "empty_except": 3, "no_docstring": 0, "promised_return": 3, "syntax_error": 6, "unreadable": 6, "orphan": 4, "unreached": 2}

#: Call names by what they reach, and imports that qualify an unqualified call.
EFFECTS = {
    "filesystem": ["open", "read_text", "write_text", "read_bytes", "write_bytes", "remove", "unlink", "rename", "replace", "mkdir", "makedirs", "rmtree", "copy", "copy2", "move", "glob", "walk", "listdir", "chmod", "chown", "symlink", "touch"],
    "network": ["urlopen", "request", "get", "post", "put", "delete", "head", "connect", "socket", "create_connection", "sendall", "recv", "urlretrieve", "Session"],
    "subprocess": ["run", "Popen", "call", "check_call", "check_output", "system", "spawn", "execv", "execve", "fork"],
    "database": ["execute", "executemany", "cursor", "commit", "rollback", "connect_db", "query", "fetchall", "fetchone"],
    "serialization": ["loads", "load", "dumps", "dump", "unpickle", "pickle"],
    "dynamic": ["eval", "exec", "compile", "__import__", "getattr", "setattr", "globals", "locals", "importlib"],
}
EFFECT_IMPORTS = {
    "network": ["requests", "urllib", "http", "socket", "httpx", "aiohttp", "ftplib", "smtplib", "paramiko", "websockets"],
    "subprocess": ["subprocess", "os", "pty", "commands", "sh"],
    "database": ["sqlite3", "psycopg2", "pymysql", "sqlalchemy", "pymongo", "redis", "asyncpg", "MySQLdb"],
    "filesystem": ["os", "shutil", "pathlib", "glob", "tempfile", "zipfile"],
}

#: Decorators and bases that make an empty body a declaration.
DECLARING = ["overload", "abstractmethod", "abstractproperty", "abstractclassmethod", "abstractstaticmethod"]
EMPTY_KINDS = ["pass", "ellipsis", "raise"]
#: For dead ends, name endings, bases and parts of decorators that make emptiness usual.
USUAL_ENDINGS = ["Error", "Exception", "Warning", "Base", "Abstract", "Protocol", "Interface", "Mixin", "Meta"]
USUAL_BASES = ["Protocol", "Interface", "TypedDict", "NamedTuple"]
USUAL_DECORATORS = ["abstract", "abc.", "overload", "singledispatch", "property"]
#: Parts of decorators by which something else calls a definition.
LIVE_DECORATORS = ["route", "app.", "task", "fixture", "command", "click.", "celery", "receiver", "register", "hook", "event", "property", "setter", "validator", "cached", "api."]
#: File names that start programs, and calls that parse their arguments.
ENTRY_FILES = ["__main__.py", "main.py", "cli.py", "run.py", "app.py", "manage.py", "wsgi.py", "asgi.py"]
ENTRY_CALLS = ["argparse.", "ArgumentParser", "click.", "typer."]
#: Folders of other people's code, and files that mark a package of its own.
VENDOR_DIRS = ["vendor", "vendored", "_vendor", "third_party", "thirdparty", "3rdparty", "extern", "external", "deps", "contrib", "site-packages", "node_modules"]
PACKAGE_MARKERS = ["setup.py", "setup.cfg", "pyproject.toml", "PKG-INFO", "LICENSE", "LICENSE.txt", "LICENCE", "COPYING"]
#: Words of file names that say nothing about a shared purpose.
COMMON_WORDS = ["get", "set", "run", "init", "main", "new", "make", "create", "build", "add", "remove", "delete", "update", "list", "load", "save", "read", "write", "open", "close", "start", "stop", "check", "test", "handle", "process", "parse", "format", "to", "from", "is", "has", "do", "call", "value", "name", "data", "item", "result", "self", "cls", "args", "kwargs", "file", "path", "line", "text", "str", "dict", "type", "key", "id"]
#: File name or folder, what it is, and what loads it; the first that fits counts.
CONVENTIONS = [
    (r"(^|/)conftest\.py$", "conftest", "pytest"),
    (r"(^|/)test_[^/]*\.py$", "test module", "a test runner"),
    (r"(^|/)[^/]*_test\.py$", "test module", "a test runner"),
    (r"(^|/)__init__\.py$", "package marker", "the import system"),
    (r"(^|/)__main__\.py$", "module entry", "python -m"),
    (r"(^|/)setup\.py$", "build script", "pip / setuptools"),
    (r"(^|/)manage\.py$", "management CLI", "Django"),
    (r"(^|/)wsgi\.py$", "server entry", "a WSGI server"),
    (r"(^|/)asgi\.py$", "server entry", "an ASGI server"),
    (r"(^|/)noxfile\.py$", "task file", "nox"),
    (r"(^|/)tasks\.py$", "task file", "invoke"),
    (r"(^|/)fabfile\.py$", "task file", "fabric"),
    (r"(^|/)dodo\.py$", "task file", "doit"),
    (r"(^|/)sitecustomize\.py$", "interpreter hook", "CPython"),
    (r"(^|/)usercustomize\.py$", "interpreter hook", "CPython"),
    (r"(^|/)migrations/", "migration", "a migration runner"),
    (r"(^|/)plugins/", "plugin", "a plugin loader"),
]

QUIET_DAYS, FEW_COMMITS, TOP_PAIRS = 60, 2, 40
#: Words, with their repeats, that two files share at least to be alike.
LIKE_WORDS = 2
#: Later files that are named for a stopped one.
FORKS = 3
MIN_SIGNALS, QUIET_FILES, MIN_SCORE, MIN_FILES = 2, 3, 4, 4
#: Commits of a log, the newest, among which changes made together are counted.
CO_CHANGE_COMMITS = 2000
#: What is said with every date of a shallow clone.
SHALLOW_NOTE = "This is a shallow clone, which has the newest commits only: all dates and 'first seen' tell what was fetched, not what happened. `git fetch --unshallow` gets the rest."
#: Modules that a trace shows in each direction, and the states that it leaves out.
TRACE_MOST = 260
TRACE_HIDES = ["deadend", "broken"]
#: What a map calls the folder of files without one.
TOP_FOLDER = "the project root"
#: What an unreached module holds.
VERDICTS = {
    "older": "original direction",
    "later": "a later attempt that stopped",
    "uncommitted": "never committed",
    "both": "built on the live code, and holds work found nowhere else",
    "wired": "built on the live code",
    "unique": "holds work found nowhere else",
    "none": "isolated",
}
#: States of a module, the most certain to be wrong first.
SEVERITY = ["broken", "deadend", "unfinished", "maybe", "tested", "live", "confirmed"]
#: Where a text's lines end for Python.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


_locks = Lock()


class once:
    """A property that is computed once, also if several threads ask: the others wait. Findings depend on each other without cycles, so no two wait for each other."""

    def __init__(self, f: Callable) -> None:
        self.f, self.name, self.__doc__ = f, f.__name__, f.__doc__

    def __get__(self, obj, owner=None):
        if obj is None:
            return self
        with _locks:
            lock = obj.__dict__.setdefault(f"_lock_{self.name}", RLock())
        with lock:
            if self.name not in obj.__dict__:
                obj.__dict__[self.name] = self.f(obj)
            return obj.__dict__[self.name]


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _first(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def is_test(key: Column) -> Column:
    """Is a module a test, by any part of its dotted name?"""
    part = lambda p: p.isin("tests", "test", "conftest") | p.startswith("test_") | p.endswith("_test")
    return F.exists(F.split(F.replace(F.lower(key), F.lit("-"), F.lit("_")), "[.]"), part)


def follows_tests(key: Column, relpath: Column) -> Column:
    """Is a module one that changes with what it tests: by its own name, or by its folder?"""
    own = _last(key)
    return own.startswith("test_") | own.endswith("_test") | relpath.rlike(r"(^|/)test/") | relpath.startswith("tests/")


def keyed(raw: DataFrame) -> DataFrame:
    """facts with dotted, and key: the dotted name, or the path of a file without one."""
    dotted = T.module_name(F.col("relpath"))
    return raw.withColumn("dotted", dotted).withColumn("key", F.when(dotted != "", dotted).otherwise(F.col("relpath")))


class Survey:
    """Findings over files(relpath, content, ord); the other tables are optional."""

    def __init__(self, spark: SparkSession, files: DataFrame, listing: tree.Listing | None = None, commits: DataFrame | None = None, commit_files: DataFrame | None = None, renames: DataFrame | None = None, tracked: DataFrame | None = None, declared: DataFrame | None = None, prose: str = "", shallow: bool = False, paired: int | None = None, raw: DataFrame | None = None) -> None:
        """paired: commits from the newest on, numbered by ord, that count for co_change; None: all. raw: the facts of files, where they are keyed and staged already."""
        self.spark, self.listing, self.prose, self.shallow, self.paired = spark, listing, prose, shallow, paired
        self.commits, self.commit_files, self.renames, self.tracked = commits, commit_files, renames, tracked
        self.declared = declared if declared is not None else spark.createDataFrame([], packaging.SCHEMA)
        self.files, self.raw = files, raw

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, with_history: bool = True, max_files: int = 5000) -> Survey:
        listing = tree.list_tree(root, max_files=max_files)
        history = with_history and gitlog.is_repo(root)
        files = tree.read_files(spark, listing)
        with ThreadPoolExecutor(3) as pool:  # three jobs that need nothing of each other
            raw = pool.submit(lambda: stage_table(spark, keyed(facts.extract(files)), "modules"))
            log, tracked = (pool.submit(lambda: stage_table(spark, gitlog.log(spark, root), "log")), pool.submit(lambda: stage_table(spark, gitlog.tracked(spark, root), "tracked"))) if history else (None, None)
        commits, commit_files, renames = gitlog.split_log(log.result()) if history else (None, None, None)
        return cls(spark, files, listing, commits, commit_files, renames, tracked.result() if history else None, packaging.declared(spark, root), tree.read_prose(listing), history and gitlog.is_shallow(root), CO_CHANGE_COMMITS, raw.result())

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return stage_table(self.spark, df, name)

    # --- fact tables

    @once
    def modules(self) -> DataFrame:
        """The facts of each file, with its dotted name and key; parsed and staged once, when a finding asks."""
        return self.raw if self.raw is not None else self._stage(keyed(facts.extract(self.files)), "modules")

    @once
    def named(self) -> DataFrame:
        """(relpath, ord, dotted, key) of each file, from its path alone: for what needs no facts, so that nothing is parsed for it."""
        return (self.raw if self.raw is not None else keyed(self.files.select("relpath", "ord"))).select("relpath", "ord", "dotted", "key")

    @property
    def _parsed(self) -> bool:
        return self.raw is not None or "modules" in self.__dict__

    def _of_worth(self, worth: Callable[[str], bool], name: str, *columns: str) -> DataFrame:
        """key and columns of modules, for a finding that only files whose text is of some worth can have: no others are parsed for it, unless all are so already."""
        return self.modules.select("key", *columns) if self._parsed else self._stage(keyed(facts.extract(self.files, worth)).select("key", *columns), name)

    @once
    def sized(self) -> DataFrame:
        """(key, relpath, loc) of each file; nothing is parsed for it."""
        return (self.modules if self._parsed else self._stage(keyed(facts.sizes(self.files)), "sized")).select("key", "relpath", "loc")

    @once
    def disabled_code(self) -> DataFrame:
        """(key, lineno): comments that are code which was switched off."""
        return self._of_worth(facts.may_hold_disabled_code, "disabled", "commented_code").select("key", F.explode("commented_code").alias("lineno"))

    def _exploded(self, column: str) -> DataFrame:
        return self.modules.select("key", F.explode(column).alias("x")).select("key", "x.*")

    @once
    def imports(self) -> DataFrame:
        return self._exploded("imports")

    @once
    def definitions(self) -> DataFrame:
        return self._stage(self._exploded("definitions").withColumn("qualname", T.qualified(F.col("parent"), F.col("name"))), "definitions")

    @once
    def calls(self) -> DataFrame:
        return self._exploded("calls")

    @once
    def names_used(self) -> DataFrame:
        return self.modules.select("key", F.explode("names_used").alias("name"))

    # --- import graph

    @once
    def resolved(self) -> DataFrame:
        """imports with dst: the module each names, or null. Candidates in order, then any module of that last name."""
        parts = F.split(F.col("key"), "[.]")
        base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
        written = F.when(F.col("level") > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif("target", F.lit("")))).otherwise(F.col("target"))
        imports = self.imports.join(self.modules.select("key", "dotted"), "key").withColumn("key", F.col("dotted")).drop("dotted").withColumn("full", written)
        under = lambda c: F.when(F.col(c) != "", F.concat_ws(".", "full", c))
        parent = F.regexp_replace("full", r"\.?[^.]*$", "")
        candidates = F.when(F.col("full") != "", F.array(under("imported"), F.when(F.col("bound") != F.col("imported"), under("bound")), F.col("full"), F.nullif(parent, F.lit(""))))
        keys = ["key", "target", "bound", "lineno", "level", "imported", "full"]
        index = self.modules.where("dotted <> ''").select("dotted", F.col("dotted").alias("dst"))
        hit = relations.resolve_by_priority(imports, keys, candidates, index, "dotted", "dst").drop("priority")
        tails = self.modules.where("dotted <> ''").groupBy(_last(F.col("dotted")).alias("tail")).agg(F.min_by("dotted", "ord").alias("by_tail"))
        joined = imports.distinct().join(hit, keys, "left").withColumn("tail", F.when(F.col("full") != "", _last(F.col("full")))).join(tails, "tail", "left")
        return self._stage(joined.select(*keys, F.coalesce("dst", "by_tail").alias("dst")), "resolved")

    @once
    def edges(self) -> DataFrame:
        return self._stage(self.resolved.where("dst is not null and dst <> key").select(F.col("key").alias("src"), "dst").distinct(), "edges")

    @once
    def external(self) -> DataFrame:
        return self.resolved.where("dst is null and target <> ''").select(F.col("key").alias("src"), _first(F.col("target")).alias("root")).distinct()

    @once
    def evidence(self) -> DataFrame:
        """(src, dst, lineno, text): import lines that resolve to dst, and calls of names they bound; all of them."""
        lines = self.resolved.where("dst is not null and dst <> key").select(F.col("key").alias("src"), "dst", "lineno", "bound")
        bound = lines.select("src", "dst", "bound").distinct()
        calls = self.calls.select(F.col("key").alias("src"), "name", F.col("lineno").alias("at"))
        whole = calls.withColumnRenamed("name", "bound").join(bound, ["src", "bound"]).select("src", "dst", "at")
        head = calls.withColumn("bound", _first(F.col("name"))).join(bound, ["src", "bound"]).select("src", "dst", "at")
        shown = lines.select("src", "dst", "lineno").union(whole).union(head).distinct()
        # a module's text is read once for all of its lines
        wanted = shown.groupBy("src").agg(F.collect_list(F.struct("dst", "lineno")).alias("x"))
        text = self.modules.select(F.col("key").alias("src"), F.split("source", LINE_END, -1).alias("lines")).join(wanted, "src")
        shown = text.select("src", F.explode(F.transform("x", lambda x: F.struct(x["dst"].alias("dst"), x["lineno"].alias("lineno"), F.rtrim(F.get("lines", x["lineno"] - 1)).alias("text")))).alias("x"))
        return shown.select("src", "x.*").where("text is not null")

    @once
    def entry_points(self) -> DataFrame:
        calling = self.calls.where(_any([F.col("name").startswith(c) for c in ENTRY_CALLS])).select("key").distinct().withColumn("parses", F.lit("parses arguments"))
        named = _any([F.col("relpath").endswith(f) for f in ENTRY_FILES])
        reasons = F.array_compact(F.array(F.when(F.col("has_main_guard"), F.lit("has a __main__ guard")), F.when(F.col("shebang").isNotNull(), F.lit("has a shebang")), F.col("parses"), F.when(named, F.lit("is named like a program"))))
        return self.modules.join(calling, "key", "left").select("key", reasons.alias("reasons")).where(F.size("reasons") > 0)

    @once
    def loaded_by(self) -> DataFrame:
        """What loads a module without an import: declared (proven) before conventional (inferred)."""
        said = self.declared.select(F.col("module").alias("dotted"), F.lit("declared entry").alias("d_name"), F.col("source").alias("d_loader"), F.concat(F.lit("declared as "), "spec", F.lit(" in "), "by").alias("d_why"))
        rule = lambda k: summaries.first_match(*((F.col("relpath").rlike(c[0]), c[k]) for c in CONVENTIONS))
        joined = self.named.join(said, "dotted", "left").withColumns({"c_name": rule(1), "c_loader": rule(2)})
        why = F.coalesce("d_why", F.concat(F.lit("loaded by name by "), "c_loader"))
        return joined.select("key", F.coalesce("d_name", "c_name").alias("name"), F.coalesce("d_loader", "c_loader").alias("loader"), why.alias("why"), F.col("d_name").isNotNull().alias("proven")).where("name is not null")

    @once
    def roots(self) -> DataFrame:
        """(key, place, reason): entry points, place 0, then what else is loaded by name, place 1; each module once, in order of place and ord."""
        entries = self.entry_points.select("key", F.lit(0).alias("place"), F.array_join("reasons", "; ").alias("reason"))
        loaded = self.loaded_by.select("key", F.lit(1).alias("place"), F.col("why").alias("reason"))
        first = entries.union(loaded).groupBy("key").agg(F.min(F.struct("place", "reason")).alias("f"))
        return self._stage(first.select("key", "f.place", "f.reason"), "roots")

    @once
    def layers(self) -> DataFrame:
        """(node, depth): fewest imports from an entry point or a convention-loaded module."""
        return self._stage(graph.layers(self.edges, self.roots.select("key")), "layers")

    @once
    def orphans(self) -> DataFrame:
        imported = self.edges.select(F.col("dst").alias("key"))
        return self._stage(relations.without(self.modules.select("key", "relpath", "loc", "ord"), imported, self.roots.select("key")), "orphans")

    @once
    def unreached(self) -> DataFrame:
        """(key): what is neither an orphan nor an entry point, and nothing that is loaded leads to it."""
        return relations.without(self.modules.select("key"), self.layers.select(F.col("node").alias("key")), self.orphans.select("key"), self.entry_points.select("key"))

    @once
    def unreferenced(self) -> DataFrame:
        """Definitions whose bare name nothing in the project uses, calls or imports."""
        used = self.names_used.select("name").union(self.calls.select(_last(F.col("name")))).union(self.imports.select("bound"))
        caveat = summaries.first_match(
            (F.exists("decorators", lambda d: _any([d.contains(x) for x in LIVE_DECORATORS])), "a framework may call it"), (F.col("name").startswith("test_"), "a test runner may call it"), (F.col("name").startswith("_"), "private")
        )
        return relations.without(self.definitions.where(~F.col("name").startswith("__")), used).select("key", "qualname", "kind", "lineno", caveat.alias("caveat"))

    @once
    def fan(self) -> DataFrame:
        counted = graph.fan(self.edges).withColumnRenamed("node", "key")
        return self.modules.select("key").join(counted, "key", "left").select("key", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))

    @once
    def cycles(self) -> DataFrame:
        """Edges on or between cycles; import_cycles names them."""
        return graph.cyclic_core(self.edges)

    @once
    def import_cycles(self) -> DataFrame:
        """(nodes): import cycles by name, the first module again at the end."""
        return self._stage(graph.cycles(self.edges), "cycles")

    @once
    def cycle_count(self) -> int:
        """Rows of import_cycles; they are not made for it."""
        return self.import_cycles.count() if "import_cycles" in self.__dict__ else graph.count_cycles(self.edges)

    @once
    def effects(self) -> DataFrame:
        """(key, category, call, lineno), an unqualified or foreign call only where an import backs it."""
        words = self.spark.createDataFrame([(c, w) for c, ws in EFFECTS.items() for w in ws], "category string, last string")
        own = self._of_worth(partial(facts.may_use, frozenset(w for ws in EFFECTS.values() for w in ws)), "reaching", "imports", "calls")
        imports, calls = (own.select("key", F.explode(c).alias("x")).select("key", "x.*") for c in ("imports", "calls"))
        roots = imports.select("key", F.explode(F.array(_first(F.col("target")), _first(F.col("bound")))).alias("root")).where("root <> ''").groupBy("key").agg(F.collect_set("root").alias("roots"))
        hits = calls.withColumn("last", _last(F.col("name"))).join(F.broadcast(words), "last").join(roots, "key", "left")  # words: a fixed list
        known = F.coalesce("roots", F.array().cast("array<string>"))
        root, qualified = _first(F.col("name")), F.col("name").contains(".")
        ok = F.lit(True)
        for category, names in EFFECT_IMPORTS.items():
            gate = F.array(*map(F.lit, names))
            backed = F.when(qualified, F.array_contains(known, root) | root.isin("self", "cls") | F.array_contains(gate, root)).otherwise(F.arrays_overlap(known, gate))
            ok = F.when(F.col("category") == category, backed).otherwise(ok)
        return hits.where(ok).select("key", "category", F.col("name").alias("call"), "lineno")

    # --- where work stopped

    @once
    def class_links(self) -> DataFrame:
        """(key, written, b_key, b_class): what names written in a module refer to among the project's top-level classes."""
        classes = self.definitions.where("kind = 'class' and parent is null").select("key", F.col("name").alias("cls")).distinct()
        based = self.definitions.where("kind = 'class' and parent is null").select("key", F.explode("bases").alias("written"))
        called = self.calls.select("key", "name").union(self.calls.select("key", F.regexp_replace("name", r"\.?[^.]*$", "")))
        written = based.union(called).toDF("key", "written").where("written <> ''").distinct()
        own = written.where(~F.col("written").contains(".")).join(classes.withColumnRenamed("cls", "written"), ["key", "written"]).select("key", "written", F.col("key").alias("b_key"), F.col("written").alias("b_class"))
        via = self.resolved.where("dst is not null").select("key", "bound", "imported", "dst")
        split = written.select("key", "written", F.regexp_extract("written", r"^(.*)\.[^.]*$", 1).alias("prefix"), _last(F.col("written")).alias("tail"))
        direct = split.where("prefix = ''").join(via, "key").where("bound = written").select("key", "written", F.col("dst").alias("b_key"), F.col("imported").alias("b_class"))
        member = split.where("prefix <> ''").join(via, "key").where("bound = prefix").select("key", "written", F.col("dst").alias("b_key"), F.col("tail").alias("b_class"))
        target = classes.select(F.col("key").alias("b_key"), F.col("cls").alias("b_class"))
        return self._stage(own.union(direct.union(member).join(target, ["b_key", "b_class"], "left_semi").select("key", "written", "b_key", "b_class")).distinct(), "classes")

    @once
    def replaced_methods(self) -> DataFrame:
        """(key, parent, name): methods that every subclass replaces, of bases that nothing calls: relational division."""
        subs = self.definitions.where("kind = 'class' and parent is null").select("key", F.col("name").alias("sub"), F.explode("bases").alias("written"))
        subs = subs.join(self.class_links, ["key", "written"]).select("b_key", "b_class", F.col("key").alias("s_key"), "sub").distinct()
        sizes = subs.groupBy("b_key", "b_class").agg(F.count("*").alias("subs"))
        methods = self.definitions.where("kind = 'method'").select("key", "parent", "name", "lineno", "end_lineno")
        sups = self.calls.where(F.col("name").startswith("super.")).select("key", F.substring("name", 7, 1_000_000).alias("name"), F.col("lineno").alias("at"))
        upward = relations.in_range(sups, methods, ["key", "name"], "at", "lineno", "end_lineno").select("key", "parent", "name")
        methods = relations.without(methods.select("key", "parent", "name").distinct(), upward)
        held = subs.join(methods.select(F.col("key").alias("s_key"), F.col("parent").alias("sub"), "name"), ["s_key", "sub"]).groupBy("b_key", "b_class", "name").agg(F.count("*").alias("n"))
        names = self.calls.select("key", F.col("name").alias("written")).union(self.calls.select("key", F.regexp_replace("name", r"\.?[^.]*$", "")))
        called = names.join(self.class_links, ["key", "written"]).select("b_key", "b_class")
        every = relations.without(held.join(sizes, ["b_key", "b_class"]).where("n = subs"), called)
        found = every.select(F.col("b_key").alias("key"), F.col("b_class").alias("parent"), "name")
        return self._stage(found.join(methods, ["key", "parent", "name"], "left_semi").withColumn("replaced", F.lit(True)), "replaced")

    @once
    def judged(self) -> DataFrame:
        """definitions with declaring, shape and the documented share of their module."""
        declaring = F.exists("decorators", lambda d: _last(d).isin(*DECLARING))
        protocol = F.exists("bases", lambda b: _last(b) == "Protocol")
        siblings = Window.partitionBy("key", "parent")
        plain = (F.col("kind") == "method") & ~F.col("nested")
        empties = F.sum(F.when(plain & F.col("body_kind").isin(*EMPTY_KINDS), 1).otherwise(0)).over(siblings)
        count = F.sum(F.when(plain, 1).otherwise(0)).over(siblings)
        public = ~F.col("name").startswith("_") & F.col("parent").isNull() & ~F.col("nested")
        share = F.avg(F.when(public, F.col("docstring").isNotNull().cast("int"))).over(Window.partitionBy("key"))
        ranked = self.definitions.withColumns({"declaring": declaring, "interface": (F.col("kind") == "method") & (count >= 2) & (empties == count), "documented": F.coalesce(share, F.lit(0.0)), "protocol": protocol})
        joined = ranked.join(self.replaced_methods, ["key", "parent", "name"], "left").join(self.modules.select("key", "relpath", "error"), "key")
        shape = F.col("declaring") | ((F.col("kind") == "method") & (F.col("protocol") | F.col("interface") | F.coalesce("replaced", F.lit(False))))
        return self._stage(joined.withColumn("shape", shape).drop("protocol"), "judged")

    @once
    def unused_imports(self) -> DataFrame:
        real = self.imports.join(self.modules.select("key", "relpath", "error", "kept_imports", "names_used", "symbol_strings"), "key").where("error is null")
        real = real.where(~F.col("relpath").rlike(r"(^|/)__init__\.py$") & (F.col("bound") != "*") & (F.col("target") != "__future__")).withColumn("head", _first(F.col("bound")))
        named = F.exists("symbol_strings", lambda s: F.array_contains(F.regexp_extract_all(s, F.lit(r"(?U)\b[^\W\d]\w*"), F.lit(0)), F.col("head")))
        unused = ~F.array_contains("names_used", F.col("head")) & ~named & ~F.array_contains("kept_imports", F.col("lineno"))
        return real.where(unused).select("key", "bound", "target", "lineno")

    @once
    def signals(self) -> DataFrame:
        """(key, kind, text, lineno): evidence that work stopped here."""
        ok = self.modules.where("error is null")
        rows = lambda df, kind, text, line: df.select("key", F.lit(kind).alias("kind"), text.cast("string").alias("text"), line.cast("int").alias("lineno"))
        q, at = F.col("qualname"), F.col("lineno")
        defs = self.judged.where("error is null and kind <> 'class'")
        stub = defs.where("body_kind = 'code' or not shape")
        todos = ok.select("key", F.explode("todos").alias("t"))
        lines = lambda c: ok.select("key", F.explode(c).alias("lineno"))
        failed = self.modules.where("error is not null")
        parts = [
            failed.select("key", F.when(F.col("error").startswith("syntax error"), "syntax_error").otherwise("unreadable").alias("kind"), F.col("error").alias("text"), F.lit(0).alias("lineno")),
            rows(todos, "todo", F.col("t.text"), F.col("t.lineno")),
            rows(stub.where("body_kind = 'pass' and says"), "stub_pass", q, at),
            rows(stub.where("body_kind = 'ellipsis'"), "stub_ellipsis", q, at),
            rows(stub.where("body_kind = 'raise' and says"), "not_implemented", q, at),
            rows(defs.where("docstring is null and not startswith(name, '_') and kind <> 'method' and not nested and not declaring and end_lineno - lineno >= 10 and documented >= 0.8"), "no_docstring", q, at),
            rows(defs.where("promises and not returns and body_kind = 'code'"), "promised_return", q, at),
            rows(self.unused_imports, "unused_import", F.concat("bound", F.lit(" (from "), F.when(F.col("target") != "", F.col("target")).otherwise("import"), F.lit(")")), at),
            rows(lines("commented_code"), "commented_code", F.lit("commented-out code"), at),
            rows(lines("swallowed"), "empty_except", F.lit("exception silently ignored"), at),
            rows(self.orphans, "orphan", F.lit("nothing imports it"), F.lit(0)),
            rows(self.unreached, "unreached", F.lit("no entry point leads to it"), F.lit(0)),
        ]
        return self._stage(reduce(DataFrame.union, parts), "signals")

    @once
    def frontier(self) -> DataFrame:
        """Modules by how much unfinished work they show: (key, relpath, loc, score, counts)."""
        weight = reduce(lambda c, kv: F.when(F.col("kind") == kv[0], F.lit(float(kv[1]))).otherwise(c), WEIGHTS.items(), F.lit(1.0))
        score = summaries.weighted_score(self.signals, "key", "kind", weight, digits=1)
        counts = self.signals.groupBy("key", "kind").agg(F.count("*").cast("int").alias("n")).groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("counts"))
        return self._stage(self.modules.select("key", "relpath", "loc").join(score, "key").join(counts, "key").select("key", "relpath", "loc", "score", "counts"), "frontier")

    @once
    def totals(self) -> DataFrame:
        return summaries.totals(self.signals, "kind")

    @once
    def stubs(self) -> DataFrame:
        """Empty definitions that nothing makes usual."""
        usual = (F.col("kind") == "class") | _any([F.col("name").endswith(s) for s in USUAL_ENDINGS]) | _any([F.coalesce(F.col("parent"), F.lit("")).endswith(s) for s in USUAL_ENDINGS])
        usual |= ((F.col("name") == "__init__") & (F.col("body_kind") == "pass")) | F.exists("bases", lambda b: _last(b).isin(*USUAL_BASES)) | F.coalesce("replaced", F.lit(False))
        usual |= F.exists("decorators", lambda d: _any([d.contains(x) for x in USUAL_DECORATORS]))
        stubs = self.judged.where(F.col("body_kind").isin(*EMPTY_KINDS) & ~usual & ~is_test(F.col("key")))
        return self._stage(relations.without(stubs, self.origins.where("origin = 'vendored'").select("key")).select("key", "name", "qualname", "kind", "lineno", "parent", "args"), "stubs")

    @once
    def dead_ends(self) -> DataFrame:
        """Empty definitions that nothing makes usual, with the number of calls of their name, which callers lists once: name matches, not proof."""
        stubs = self.stubs
        sites = self.call_sites.join(stubs.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("calls"), F.min("module").alias("first_module"))
        finished = self.definitions.where("kind <> 'class' and body_kind = 'code'").groupBy("key", F.coalesce("parent", F.lit("")).alias("p")).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), 1, 4).alias("beside"))
        joined = stubs.withColumn("p", F.coalesce("parent", F.lit(""))).join(sites, "name", "left").join(finished, ["key", "p"], "left")
        takes = F.slice(F.filter("args", lambda a: ~a.isin("self", "cls")), 1, 4)
        direction = F.nullif(F.concat_ws("; ", F.when(F.size(takes) > 0, F.concat(F.lit("takes "), F.array_join(takes, ", "))), F.when(F.size("beside") > 0, F.concat(F.lit("sits beside finished "), F.array_join("beside", ", ")))), F.lit(""))
        return self._stage(joined.select("key", "name", "qualname", "kind", "lineno", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce(F.col("first_module") != F.col("key"), F.lit(False)).alias("called_from_elsewhere"), direction.alias("direction"), F.lit("callers are matched by name alone").alias("caveat")), "deadends")

    @once
    def call_sites(self) -> DataFrame:
        """(name, module, lineno, as): calls by the last part of what is called, each once."""
        return self.calls.select(_last(F.col("name")).alias("name"), F.col("key").alias("module"), "lineno", F.col("name").alias("as")).distinct()

    @once
    def callers(self) -> DataFrame:
        """(name, module, lineno, as): every call of a dead end's name, once for all dead ends of that name."""
        return self.call_sites.join(self.dead_ends.select("name").distinct(), "name", "left_semi")

    @once
    def dead_ends_by_module(self) -> DataFrame:
        """(key, n, dead_ends): each module's dead ends in order of line."""
        own = F.struct("lineno", "qualname", "calls")
        return self.dead_ends.groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(own)).alias("dead_ends"))

    # --- competing attempts and what is worth keeping

    @once
    def specific_names(self) -> DataFrame:
        """(key, name): top-level definitions whose names mean something."""
        top = self.definitions.where("parent is null and not startswith(name, '_') and length(name) >= 4").select("key", "name")
        return self._stage(top.where(~F.col("name").isin(*A.GENERIC)).distinct(), "specific")

    @once
    def attempt_groups(self) -> DataFrame:
        """Groups of modules that share specific names: restarts of one job, and copies. See trowel.plans.attempts."""
        out = relations.without(self.specific_names.where(~is_test(F.col("key"))), self.origins.where("origin = 'vendored'").select("key"))
        pairs = relations.overlap_pairs(out, "key", "name", A.MIN_SHARED)
        pairs = self._stage(pairs, "sharing")
        group = graph.greedy_groups(pairs).select(F.struct("first_a", "first_b").alias("group"), F.col("member").alias("key"))
        tests = self.modules.where(is_test(F.col("key"))).select("key", F.transform("names_used", lambda n: _first(n)).alias("names"), F.size(F.filter("definitions", lambda d: d["parent"].isNull())).alias("n"))
        mentions = tests.select(F.explode(F.array_distinct("names")).alias("tail"), "n").groupBy("tail").agg(F.sum("n").alias("tests"))
        tops = lambda cond: F.transform(F.filter("definitions", cond), lambda d: d["name"])
        free = lambda d: d["parent"].isNull() & (d["kind"] != "class")
        names = self.specific_names.groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("defines"))
        reached = self.layers.select(F.col("node").alias("key"), F.lit(True).alias("reachable"))
        rows = self.modules.join(group, "key").join(names, "key").join(reached, "key", "left").withColumn("tail", _last(F.col("key"))).join(mentions, "tail", "left")
        rows = rows.select("group", "key", "relpath", "loc", "defines", F.coalesce("reachable", F.lit(False)).alias("reachable"), F.coalesce("tests", F.lit(0)).alias("tests"), F.size("todos").alias("todos"), tops(lambda d: free(d) & (d["body_kind"] == "code")).alias("filled"), tops(lambda d: free(d) & (d["body_kind"] != "code")).alias("empty"))
        described = rows.groupBy("group").applyInArrow(A.describer(to_arrow_schema(StructType.fromDDL(A.SCHEMA))), A.SCHEMA)
        return self._stage(described, "attempts")

    @once
    def verdicts(self) -> DataFrame:
        """(key, verdict, resume_at, percent): for each module the first group that it is in; restarts before copies, then the most at stake."""
        kind = F.when(F.col("verdict") == "copy", "copy").when(F.col("m.key") == F.col("resume_at"), "resume").otherwise("superseded")
        order = F.struct((F.col("verdict") == "copy").alias("c"), (-F.col("at_stake_lines")).alias("s"), (-F.size("members")).alias("n"), "resume_at")
        members = self.attempt_groups.withColumn("order", order).select("*", F.explode("members").alias("m"))
        first = members.groupBy(F.col("m.key").alias("key")).agg(F.min(F.struct("order", kind.alias("verdict"), "resume_at", F.col("m.percent").alias("percent"))).alias("f"))
        return first.select("key", "f.verdict", "f.resume_at", "f.percent")

    @once
    def salvage(self) -> DataFrame:
        """What each orphan holds: (key, loc, verdict, unique_count, uses_live_count, counterpart, mine, mine_from, theirs, theirs_from)."""
        orphan = self.orphans.select("key")
        live = relations.without(self.specific_names, orphan)
        mine = self.specific_names.join(orphan, "key", "left_semi")
        unique = relations.without(mine, live.select("name")).groupBy("key").agg(F.count("*").alias("unique_count"))
        wired = self.edges.select(F.col("src").alias("key"), F.col("dst")).join(orphan, "key", "left_semi").join(orphan.withColumnRenamed("key", "dst"), "dst", "left_anti").groupBy("key").agg(F.count("*").alias("uses_live_count"))
        shared = mine.join(live.withColumnRenamed("key", "counterpart"), "name").groupBy("key", "counterpart").agg(F.count("*").alias("n")).where(F.col("n") >= A.MIN_SHARED)
        best = relations.best_counterpart(shared, "key", "counterpart", "n").drop("n")
        seen = self.begun.select(F.col("path").alias("relpath"), "first_seen") if self.commits is not None else self.spark.createDataFrame([], "relpath string, first_seen string")
        stamp = T.stamped_date(F.substring_index("relpath", "/", -1))
        dated = self.modules.join(seen, "relpath", "left").withColumn("stamp", stamp)
        source = F.when(F.col("first_seen") <= F.coalesce("stamp", "first_seen"), "git").when(F.col("stamp").isNotNull(), "the filename")
        dates = dated.select("key", F.least("first_seen", "stamp").alias("born"), source.alias("born_from"), F.col("first_seen").isNotNull().alias("recorded"))
        joined = self.orphans.join(unique, "key", "left").join(wired, "key", "left").join(best, "key", "left").join(dates.withColumnsRenamed({"born": "mine", "born_from": "mine_from"}), "key")
        joined = joined.join(dates.select(F.col("key").alias("counterpart"), F.col("born").alias("theirs"), F.col("born_from").alias("theirs_from")), "counterpart", "left")
        n, w = F.coalesce("unique_count", F.lit(0)), F.coalesce("uses_live_count", F.lit(0))
        datable = F.col("counterpart").isNotNull() & F.col("mine").isNotNull() & F.col("theirs").isNotNull()
        verdict = summaries.first_match(
            (datable & (F.col("mine") < F.col("theirs")), VERDICTS["older"]), (datable, VERDICTS["later"]), (F.lit(self.commits is not None) & ~F.col("recorded"), VERDICTS["uncommitted"]),
            ((w > 0) & (n > 0), VERDICTS["both"]), (w > 0, VERDICTS["wired"]), (n > 0, VERDICTS["unique"]), default=VERDICTS["none"],
        )
        return joined.select("key", "loc", verdict.alias("verdict"), n.alias("unique_count"), w.alias("uses_live_count"), "counterpart", "mine", "mine_from", "theirs", "theirs_from")

    @once
    def salvage_totals(self) -> DataFrame:
        return self.salvage.groupBy("verdict").agg(F.count("*").alias("modules"), F.sum("loc").alias("lines"))

    @once
    def clusters(self) -> DataFrame:
        """(cluster, size, loc, entries, untracked, label, belongs, modules): undirected components; they belong if entered, or named in the project's prose."""
        comps = graph.components(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "key")
        names = self.modules.select(_first(F.col("key")).alias("root")).distinct()
        named = relations.mentioned(names, self.prose_texts).select("root", F.lit(True).alias("named"))
        joined = self.modules.withColumn("root", _first(F.col("key"))).join(comps, "key", "left").withColumn("cluster", F.coalesce("component", "key"))
        joined = joined.join(self.entry_points.select("key", F.lit(1).alias("entry")), "key", "left").join(named, "root", "left").join(self.origins.select("key", "origin"), "key", "left")
        belongs = F.max(F.col("entry").isNotNull() | F.coalesce("named", F.lit(False)))
        return joined.groupBy("cluster").agg(
            F.count("*").alias("size"), F.sum("loc").alias("loc"), F.count("entry").alias("entries"), F.count_if(F.col("origin") == "untracked").alias("untracked"),
            F.max_by("key", F.struct("loc", "key")).alias("label"), belongs.alias("belongs"), F.sort_array(F.collect_list("key")).alias("modules"),
        )

    @once
    def prose_texts(self) -> DataFrame:
        """(text): what the project says of itself, lower-cased, a row a document or slice."""
        if isinstance(self.prose, DataFrame):
            return self.prose
        return self.spark.createDataFrame([(self.prose[i : i + tree.PROSE_EACH],) for i in range(0, len(self.prose), tree.PROSE_EACH)], "text string")

    def cluster_modules(self, belongs: bool) -> DataFrame:
        """(key): modules of the clusters that belong to the project, or of those set aside."""
        return self.clusters.where(F.col("belongs") == belongs).select(F.explode("modules").alias("key"))

    def neighbourhood(self, key: str) -> DataFrame:
        """(key): a module and what one edge joins it with."""
        near = self.edges.where((F.col("src") == key) | (F.col("dst") == key))
        return near.select(F.explode(F.array("src", "dst")).alias("key")).union(self.modules.where(F.col("key") == key).select("key")).distinct()

    def trace(self, key: str, most: int = TRACE_MOST) -> DataFrame:
        """(direction, node, depth, left_out) from a module, the nearest of each direction; dead ends and broken modules are left out, and counted for their direction."""
        seed = self.spark.createDataFrame([(key,)], "node string")
        hidden = self._stage(self.hopeless.where(F.col("key") != key), "hidden")
        clear = self._stage(self.edges.join(hidden.toDF("src"), "src", "left_anti").join(hidden.toDF("dst"), "dst", "left_anti"), "clear")
        found = self._stage(summaries.top_n_more(graph.trace(clear, seed), ["direction"], [F.asc("depth"), F.asc("node")], most + 1).drop("rank", "more"), "trace")
        met = [
            self.edges.join(found.where(F.col("direction") == way).select(F.col("node").alias(near)), near, "left_semi").join(hidden.toDF(far), far, "left_semi").agg(F.count_distinct(far).alias("left_out")).withColumn("direction", F.lit(way))
            for way, near, far in (("uses", "src", "dst"), ("used_by", "dst", "src"))
        ]
        return found.join(met[0].unionByName(met[1]), "direction").select("direction", "node", "depth", "left_out")

    # --- history

    @once
    def names_now(self) -> DataFrame:
        """(path, canonical): what files that were renamed are called now."""
        if self.renames is None or not self.renames.take(1):
            return self.spark.createDataFrame([], "path string, canonical string")
        return self._stage(graph.rename_chain(self.renames).toDF("path", "canonical"), "names")

    @once
    def begun(self) -> DataFrame:
        """(path, first_seen): the day of each surveyed file's first commit in the log, as in its history; of each name only the first commit is renamed and dated. Both tables are of one log, so commits has every ord."""
        if "file_history" in self.__dict__:
            return self.file_history.select("path", "first_seen")
        names = self.commit_files.groupBy("path").agg(F.max("ord").alias("ord"))
        first = names.join(self.names_now, "path", "left").groupBy(F.coalesce("canonical", "path").alias("path")).agg(F.max("ord").alias("ord"))
        own = first.join(self.named.select(F.col("relpath").alias("path")), "path", "left_semi").join(self.commits.select("ord", "at"), "ord")
        return self._stage(own.select("path", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd").alias("first_seen")), "begun")

    @once
    def touched(self) -> DataFrame:
        """(ord, path): commits of surveyed files, by the names that the files have now."""
        now = self.commit_files.join(self.names_now, "path", "left").select("ord", F.coalesce("canonical", "path").alias("path")).distinct()
        return self._stage(now.join(self.named.select(F.col("relpath").alias("path")), "path", "left_semi"), "touched")

    @once
    def file_history(self) -> DataFrame:
        log = self.touched.join(self.commits, "ord").withColumn("place", -F.col("ord"))
        return self._stage(summaries.history(log, "path", ["place"], F.timestamp_seconds("at"), "subject", "author"), "history")

    @once
    def co_change(self) -> DataFrame:
        """(item_a, item_b, n): files that changed together, within the newest commits of the log."""
        recent = self.touched if self.paired is None else self.touched.where(F.col("ord") < self.paired)
        return relations.co_occurrence(recent, "ord", "path")

    @once
    def timeline(self) -> DataFrame:
        """(month, n, first_key): files by the month of their first commit in the log."""
        return self.timeline_files.groupBy("month").agg(F.count("*").alias("n"), F.min("path").alias("first_key"))

    @once
    def timeline_files(self) -> DataFrame:
        """(month, path): every file below the month of its first commit."""
        return self.begun.select(F.substring("first_seen", 1, 7).alias("month"), "path")

    @once
    def stalled(self) -> DataFrame:
        """Files of few commits whose last one in the log is long before the newest file's."""
        log = self.touched.join(self.commits, "ord").withColumn("place", -F.col("ord"))
        own = summaries.stalled(log, "path", F.timestamp_seconds("at"), FEW_COMMITS, QUIET_DAYS, order=["place"])
        return own.join(self.file_history.select("path", "first_seen", "last_touched", "last_subject"), "path").select("path", "commits", "first_seen", "last_touched", "last_subject", "days_quiet")

    @once
    def authors(self) -> DataFrame:
        """(author, files, commits): who wrote the surveyed files."""
        return self.touched.join(self.commits, "ord").groupBy("author").agg(F.count_distinct("path").alias("files"), F.count_distinct("ord").alias("commits"))

    @once
    def history_state(self) -> DataFrame:
        """(available, reason, shallow, authors, note): one row on what the history can say."""
        seen = self.file_history.agg(F.count("*").alias("n")) if self.commits is not None else self.spark.range(1).select(F.lit(0).alias("n"))
        who = self.authors.agg(F.count("*").alias("authors")) if self.commits is not None else self.spark.range(1).select(F.lit(0).alias("authors"))
        reason = F.when(F.lit(self.commits is None), "not a git repository, or history was not asked for").when(F.col("n") == 0, "no commit covers these files")
        both = seen.join(F.broadcast(who))  # one row each
        return both.select((F.col("n") > 0).alias("available"), reason.alias("reason"), F.lit(self.shallow).alias("shallow"), "authors", F.when(F.lit(self.shallow), SHALLOW_NOTE).alias("note"))

    @once
    def origins(self) -> DataFrame:
        """(key, origin, why): unknown without a repository, untracked, vendored, else tracked."""
        dirs = F.slice(F.split("relpath", "/"), 1, F.greatest(F.size(F.split("relpath", "/")) - 1, F.lit(0)))
        vendor = F.get(F.filter(dirs, lambda d: d.isin(*VENDOR_DIRS)), F.lit(0))
        marks = self.spark.createDataFrame([(d, n) for d, n in (self.listing.markers if self.listing else []) if d and n in PACKAGE_MARKERS], "folder string, marker string")
        above = self.modules.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(dirs), F.lit(1))), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))).alias("folder"))
        nearest = above.join(marks, "folder").groupBy("key").agg(F.max_by(F.concat_ws("/", "folder", "marker"), F.length("folder")).alias("package"))
        known = self.modules.select("key", "relpath", "loc", vendor.alias("vendor")).join(nearest, "key", "left")
        if self.tracked is None:
            return known.select("key", "loc", F.lit("unknown").alias("origin"), F.lit("no repository").alias("why"))
        known = known.join(self.tracked.distinct().withColumn("is_tracked", F.lit(True)), "relpath", "left")
        origin = summaries.first_match((F.col("is_tracked").isNull(), "untracked"), (F.col("vendor").isNotNull() | F.col("package").isNotNull(), "vendored"), default="tracked")
        return self._stage(known.select("key", "loc", origin.alias("origin"), F.coalesce("vendor", "package").alias("why")), "origins")

    @once
    def origin_totals(self) -> DataFrame:
        return self.origins.groupBy("origin").agg(F.count("*").alias("modules"), F.sum("loc").alias("lines"))

    @once
    def forks(self) -> DataFrame:
        """(stopped, continued, signals, commits): unfinished files gone quiet, and later files that took up their subject.

        What is specific to two files, words of their names or changes made together, makes candidates, of
        stopped and later files only; folder and effects are then looked up for each.
        """
        at = self.touched.groupBy("path").agg(F.min("ord").alias("newest")).join(self.commits.select(F.col("ord").alias("newest"), "at"), "newest")
        last = self._stage(at.join(self.file_history.select("path", "commits"), "path").join(self.modules.select(F.col("relpath").alias("path"), "key", "ord"), "path").select("key", "ord", "path", "at", "commits"), "last")
        later = self._stage(last.where(~follows_tests(F.col("key"), F.col("path"))).select(F.col("ord").alias("b"), F.col("at").alias("b_at"), "commits"), "later")
        # modules by number; a count above what makes two alike says nothing more
        count = F.least(F.count("*"), F.lit(LIKE_WORDS)).alias("n")
        words = self.definitions.select("key", F.explode(T.vocabulary(F.col("name"))).alias("word")).where(~F.col("word").isin(*COMMON_WORDS)).groupBy("key", F.xxhash64("word").alias("f")).agg(count).join(last.select("key", "ord"), "key")
        words = self._stage(words.select("ord", "f", "n"), "words")
        kinds = words.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("f", "n"))).alias("words"))
        bit = reduce(lambda c, kv: F.when(F.col("category") == kv[1], F.lit(1 << kv[0])).otherwise(c), enumerate(EFFECTS), F.lit(0))
        reach = self.effects.groupBy("key").agg(F.bit_or(bit).alias("reach"))
        place = F.nullif(F.regexp_extract("key", r"^(.*)\.[^.]*$", 1), F.lit(""))
        profile = self._stage(self.modules.select("key", "ord", place.alias("folder")).join(reach, "key", "left"), "profile")
        # what rests on signals comes last: they are made meanwhile
        enough = last.agg((F.count("*") >= MIN_FILES).alias("enough"))
        ranked = summaries.quiet_rank(last, "key", "at").where((F.col("later") >= QUIET_FILES) & ~is_test(F.col("key"))).join(last.select("key", "ord"), "key")
        unfinished = self.frontier.where(F.col("score") >= MIN_SCORE).select("key").union(self.orphans.select("key")).union(self.signals.where("kind = 'unreached'").select("key")).distinct()
        stopped = self._stage(ranked.join(unfinished, "key", "left_semi").join(F.broadcast(enough)).where("enough").select(F.col("ord").alias("a"), F.col("at").alias("a_at")), "stopped")  # enough is one row
        alike = self._alike(stopped, later, profile, kinds)
        top = self.co_change.orderBy(F.desc("n"), "item_a", "item_b").limit(TOP_PAIRS)
        key_of = self.modules.select(F.col("relpath").alias("path"), "ord")
        top = top.join(key_of.toDF("item_a", "a"), "item_a").join(key_of.toDF("item_b", "b"), "item_b").select("a", "b")
        together = top.union(top.select("b", "a")).toDF("a", "b").join(stopped, "a").join(later, "b").where("b_at > a_at").select("a", "b")
        together = self._stage(together, "together")  # twice TOP_PAIRS at most
        both = together.join(words.toDF("a", "f", "x"), "a").join(words.toDF("b", "f", "y"), ["b", "f"]).groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("n")).where(F.col("n") >= LIKE_WORDS)
        alike = alike.union(both.select("a", "b")).distinct().withColumn("signal", F.lit("vocabulary"))
        specific = alike.union(together.withColumn("signal", F.lit("co-change"))).groupBy("a", "b").agg(F.collect_set("signal").alias("specific"))
        of = lambda side: profile.select(F.col("ord").alias(side), F.col("key").alias(f"{side}_key"), F.col("folder").alias(f"{side}_folder"), F.col("reach").alias(f"{side}_reach"))
        joined = specific.join(of("a"), "a").join(of("b"), "b").join(later.select("b", "commits"), "b")
        folder = F.when(F.col("a_folder") == F.col("b_folder"), F.lit("package"))
        effects = F.when(F.col("a_reach").bitwiseAND(F.col("b_reach")) != 0, F.lit("effects"))
        several = joined.where(F.size("specific") + F.when(folder.isNotNull(), 1).otherwise(0) + F.when(effects.isNotNull(), 1).otherwise(0) >= MIN_SIGNALS)
        found = several.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), "commits", F.sort_array(F.concat("specific", F.array_compact(F.array(folder, effects)))).alias("signals"))
        kept = summaries.top_n_more(found, ["a"], [F.size("signals").desc(), F.desc("commits"), F.asc("b")], FORKS)
        return relations.hub_trim(kept, "a", "b").select(F.col("a").alias("stopped"), F.col("b").alias("continued"), "signals", "commits")

    def _alike(self, stopped: DataFrame, later: DataFrame, profile: DataFrame, kinds: DataFrame) -> DataFrame:
        """(a, b): of the files that share words with a stopped one, and its folder or an effect, all that can be among its FORKS best.

        Files of one folder, reach and counts of words differ only in date, commits and name, and are compared as one kind.
        Of a kind, and then of all that a kind of stopped files meets, only files stay that few others surpass; so
        rows grow with the kinds of files, not with the pairs of files.
        """
        sets = self._stage(kinds.groupBy("words").agg(F.min("ord").alias("w")), "sets")
        own = self._stage(profile.join(kinds, "ord").join(sets, "words").select("ord", "key", "folder", F.coalesce("reach", F.lit(0)).alias("reach"), "w"), "kinds")
        side = lambda df, s: df.join(own.select(F.col("ord").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("key", "folder", "reach", "w"))), s)
        ours = self._stage(side(stopped, "a").drop("a_key"), "ours")
        theirs = self._stage(side(later, "b").withColumn("rank", F.struct((-F.col("commits")).alias("c"), F.col("b_key").alias("k"))).drop("commits", "b_key"), "theirs")
        tokens = sets.select("w", F.explode("words").alias("x")).select("w", "x.f", "x.n")
        left = tokens.join(ours.groupBy(F.col("a_w").alias("w")).agg(F.min("a_at").alias("a_at")), "w").withColumnRenamed("w", "a")
        right = tokens.join(theirs.groupBy(F.col("b_w").alias("w")).agg(F.max("b_at").alias("b_at")), "w").withColumnRenamed("w", "b")
        like = self._stage(relations.weighted_overlap(left, right, LIKE_WORDS, F.expr("b_at > a_at")).toDF("a_w", "b_w"), "like")
        shares = F.col("a_reach").bitwiseAND(F.col("b_reach")) != 0

        def best(folder: bool) -> DataFrame:
            """By folder, where an effect in common counts more; or by effects, whatever the folder: so a file of another folder is surpassed by none that has less in common."""
            cols = ["folder", "reach", "w"] if folder else ["reach", "w"]
            a_kind, b_kind = [f"a_{c}" for c in cols], [f"b_{c}" for c in cols]
            few = relations.surpassed_by_few(theirs.select("b", "b_at", "rank", *b_kind), b_kind, "b_at", "rank", FORKS)
            firsts = ours.groupBy(*a_kind).agg(F.min("a_at").alias("first")).join(like, "a_w")
            met = firsts.withColumn("b_folder", F.col("a_folder")).join(few, ["b_folder", "b_w"]) if folder else firsts.join(few, "b_w").where(shares)
            more = F.when(shares, -1).otherwise(0) if folder else F.lit(0)
            met = met.where("b_at > first").select(*a_kind, "b", "b_at", F.struct(more.alias("m"), "rank").alias("rank"))
            kept = self._stage(relations.surpassed_by_few(met, a_kind, "b_at", "rank", FORKS), "kept")
            own = ours.where("a_folder is not null") if folder else ours
            pairs = own.join(kept, a_kind).where("b_at > a_at")
            return pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("rank"))).where(F.col("r") <= FORKS).select("a", "b")

        return best(True).union(best(False))

    # --- regions, states, map tables

    @once
    def regions(self) -> DataFrame:
        """(key, low, high): lines around signals and definitions, merged where they touch; 40 a module."""
        lines = self.signals.where("lineno > 0").select("key", "lineno").union(self.definitions.select("key", "lineno")).distinct()
        first = summaries.top_n_more(lines.join(self.modules.select("key", "loc"), "key"), ["key"], [F.asc("lineno")], 160)
        merged = summaries.islands(first, ["key"], F.greatest(F.col("lineno") - 3, F.lit(1)), F.least(F.col("lineno") + 3, F.col("loc")), F.lit(1))
        few = summaries.top_n_more(merged, ["key"], [F.asc("island_start")], 40)
        return self._stage(few.select("key", F.col("island_start").alias("low"), F.col("island_end").alias("high")), "regions")

    @once
    def snippets(self) -> DataFrame:
        """(key, low, lines): the source lines of each region; a module's text is cut into lines once."""
        own = self.regions.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))  # 40 a module
        text = self.modules.select("key", F.split("source", LINE_END, -1).alias("all")).join(own, "key")
        cut = F.transform("spans", lambda x: F.struct(x["low"].alias("low"), F.slice("all", x["low"], x["high"] - x["low"] + 1).alias("lines")))
        return text.where(F.col("all").isNotNull()).select("key", F.explode(cut).alias("x")).select("key", "x.low", "x.lines")

    @once
    def line_marks(self) -> DataFrame:
        """(key, lineno, marks): what points at each line."""
        return self.signals.where("lineno > 0").groupBy("key", "lineno").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "kind", "text"))).alias("marks"))

    @once
    def tested(self) -> DataFrame:
        """(key): what a test module imports."""
        return self.edges.where(is_test(F.col("src"))).select(F.col("dst").alias("key")).distinct()

    @once
    def states(self) -> DataFrame:
        """(key, state): what is known of a module, the most certain first."""
        tested = self.tested.withColumn("tested", F.lit(True))
        dead = self.dead_ends.select("key", F.lit(True).alias("dead")).distinct()
        joined = self.modules.select("key", "error").join(self.frontier.select("key", "counts"), "key", "left").join(tested, "key", "left").join(dead, "key", "left")
        has = lambda k: F.coalesce(F.map_contains_key("counts", k), F.lit(False))
        real = F.size(F.filter(F.coalesce(F.map_keys("counts"), F.array().cast("array<string>")), lambda k: ~k.isin("no_docstring", "unreached"))) > 0
        ok = F.coalesce("tested", F.lit(False))
        state = summaries.first_match((F.coalesce("dead", F.lit(False)), "deadend"), (has("orphan") | has("unreached"), "maybe"), (has("syntax_error") | has("unreadable"), "broken"), (ok & ~real, "confirmed"), (ok, "tested"), (~real, "live"), default="unfinished")
        return self._stage(joined.select("key", state.alias("state")), "states")

    @once
    def hopeless(self) -> DataFrame:
        """(key): modules in the states of TRACE_HIDES, by what tells these from others; no signals are gathered for it.

        A module is orphaned or unreached just when it is in no layer, so a broken one, which comes after those, is one with an error in a layer.
        """
        reached = self.layers.select(F.col("node").alias("key"))
        broken = self.modules.where("error is not null").select("key").join(reached, "key", "left_semi")
        return self.stubs.select("key").union(broken).distinct()

    @once
    def state_tally(self) -> DataFrame:
        return self.states.groupBy("state").agg(F.count("*").alias("modules"))

    @once
    def scaffolds(self) -> DataFrame:
        """(key, qualname, lineno, text): what the syntax says of each definition: what it takes, calls, touches and returns, and who uses its module."""
        own = self.definitions.select("key", "qualname", "lineno", "end_lineno", "args", "returns", "body_kind")
        ranges = own.select("key", "qualname", F.col("lineno").alias("low"), F.col("end_lineno").alias("high"))
        first = lambda names, n: F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(F.size(names) > n, " ...").otherwise(""))

        def within(points: DataFrame, name: str, to: str) -> DataFrame:
            held = relations.in_range(points, ranges, ["key"], "lineno", "low", "high")
            return held.groupBy("key", "qualname", F.col("low").alias("lineno")).agg(F.sort_array(F.collect_set(name)).alias(to))

        calls, touches = within(self.calls, "name", "calls"), within(self.effects, "category", "touches")
        users = self.edges.groupBy(F.col("dst").alias("key")).agg(F.sort_array(F.collect_set("src")).alias("users"))
        place = ["key", "qualname", "lineno"]
        joined = own.join(calls, place, "left").join(touches, place, "left").join(users, "key", "left")
        lines = [
            F.when(F.size("args") > 0, F.concat(F.lit("takes: "), F.array_join("args", ", "))), F.when(F.size("calls") > 0, F.concat(F.lit("calls: "), first(F.col("calls"), 10))),
            F.when(F.size("touches") > 0, F.concat(F.lit("touches: "), F.array_join("touches", ", "))), F.when(F.size("users") > 0, F.concat(F.lit("its module is used by: "), first(F.col("users"), 6))),
            F.when(F.col("returns"), "returns a value").when(F.col("body_kind") == "code", "returns nothing"),
        ]
        return joined.select(*place, F.concat_ws("\n", *lines).alias("text")).where("text <> ''")

    @once
    def attempt_sentences(self) -> DataFrame:
        """(verdict, resume_at, stake, effort, copy): each group in words."""
        stake = T.stake_sentence(F.col("at_stake_lines"), F.col("resume_lines"), F.col("resume_percent").cast("string"), F.col("elsewhere_percent").cast("string"))
        return self.attempt_groups.select("verdict", "resume_at", stake.alias("stake"), T.effort_sentence(F.col("remaining_lines"), F.col("unwritten")).alias("effort"), T.copy_sentence(F.col("copy_of")).alias("copy"))

    @once
    def opening(self) -> DataFrame:
        """(finding, coverage): the sentence worth reading first, and what the history covers; one row."""
        groups = self.attempt_groups.groupBy().agg(
            F.count_if(F.col("verdict") == "restart").alias("jobs"), F.sum(F.when(F.col("verdict") == "restart", F.size("members"))).alias("job_files"), F.count_if(F.col("verdict") == "copy").alias("twins"), F.sum(F.when(F.col("verdict") == "copy", F.size("members"))).alias("twin_files")
        )
        modules, open_ = self.modules.agg(F.count("*").alias("modules")), self.frontier.agg(F.count("*").alias("open"))
        origins = self.origins.agg(F.count("*").alias("total"), F.count_if(F.col("origin").isin("tracked", "vendored")).alias("known"), F.count_if(F.col("origin") == "untracked").alias("untracked"))
        finding = (
            F.when(F.col("jobs") > 0, F.concat(T.counted(F.col("job_files"), "file"), F.lit(" hold "), T.counted(F.col("jobs"), "job"), F.lit(" that were started over")))
            .when(F.col("twins") > 0, F.concat(T.counted(F.col("twin_files"), "file"), F.lit(" are "), T.counted(F.col("twins"), "file"), F.lit(" in several places")))
            .when(F.col("open") > 0, F.concat(T.counted(F.col("open"), "module"), F.lit(" with signs of unfinished work")))
            .otherwise(F.concat(T.counted(F.col("modules"), "module"), F.lit(", nothing plainly unfinished")))
        )
        coverage = T.coverage_sentence(F.col("total"), F.col("known"), F.col("untracked"), F.lit(self.commits is not None))
        one = groups.join(F.broadcast(modules)).join(F.broadcast(open_)).join(F.broadcast(origins))  # each is one row
        return one.select(finding.alias("finding"), coverage.alias("coverage"))

    # --- maps

    @once
    def in_folders(self) -> DataFrame:
        """(key, relpath, folder, loc) with a name for the top folder."""
        folder = F.regexp_extract("relpath", "^(.*)/[^/]*$", 1)
        return self.sized.select("key", "relpath", F.when(folder == "", TOP_FOLDER).otherwise(folder).alias("folder"), "loc")

    @once
    def boxes(self) -> DataFrame:
        """(folder, modules, loc, columns, w, h, x, y): folders on shelves, the longest code first."""
        own = self._stage(geometry.boxes(self.in_folders), "boxes")
        rows = [(r.folder, r.w, r.h) for r in own.select("folder", "w", "h", "loc").orderBy(F.desc("loc"), "folder").toLocalIterator()]
        placed = self.spark.createDataFrame(geometry.shelve(rows), "folder string, x int, y int")
        return self._stage(own.join(placed, "folder"), "placed")

    @once
    def cards(self) -> DataFrame:
        """(key, folder, x, y): modules on the map."""
        return geometry.cards(self.in_folders, self.boxes)

    @once
    def ribbon_paths(self) -> DataFrame:
        folder = self.in_folders.select("key", "folder")
        return geometry.ribbon_paths(relations.ribbons(self.edges, folder), self.boxes)

    @once
    def layered_map(self) -> tuple[DataFrame, DataFrame]:
        """Places and elbows of a layered chart of all modules; see trowel.operators.geometry.layered."""
        return geometry.layered(self.layers, relations.without(self.modules.select("key"), self.layers.select(F.col("node").alias("key"))), self.edges)

    @once
    def held_back(self) -> DataFrame:
        """(loader, modules, proven): what loads modules by name, so that they do not count as unused."""
        return self.loaded_by.groupBy("loader").agg(F.count("*").alias("modules"), F.count_if("proven").alias("proven"))

    @once
    def folders(self) -> DataFrame:
        """(folder, modules, loc, state): roll-up with the most frequent state, ties to the most severe."""
        folder = F.regexp_extract("relpath", "^(.*)/[^/]*$", 1)
        severity = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("state"))
        placed = self.modules.select("key", "loc", folder.alias("folder")).join(self.states, "key")
        mode = summaries.mode_by_severity(placed, "folder", "state", severity).select("folder", "state")
        return placed.groupBy("folder").agg(F.count("*").alias("modules"), F.sum("loc").alias("loc")).join(mode, "folder")

    @once
    def ribbons(self) -> DataFrame:
        folder = self.modules.select("key", F.regexp_extract("relpath", "^(.*)/[^/]*$", 1).alias("folder"))
        return relations.ribbons(self.edges, folder)

    @once
    def headline(self) -> DataFrame:
        """One row of counts; files on disk = modules + excluded + skipped."""
        excluded = sum(self.listing.excluded.values()) if self.listing else 0
        asked = {"entries": lambda: self.entry_points.count(), "orphans": lambda: self.orphans.count(), "cycles": lambda: self.cycle_count, "unreached": lambda: self.unreached.distinct().count()}
        with ThreadPoolExecutor(len(asked)) as pool:  # rounds of small jobs, side by side
            findings = dict(zip(asked, pool.map(lambda f: f(), asked.values()), strict=True))
        return self.modules.agg(F.count("*").alias("modules"), F.sum("loc").alias("lines"), F.count("error").alias("errors")).select("*", F.lit(excluded).alias("excluded"), F.lit(self.listing.skipped if self.listing else 0).alias("skipped"), *(F.lit(n).alias(k) for k, n in findings.items()))
