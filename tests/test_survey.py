"""The survey on small trees of known content."""

import json
import os
import subprocess
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from trowel.plans import survey as plans
from trowel.plans.survey import Survey
from trowel.session import spread
from trowel.sinks import render
from trowel.sources import facts, tree

TREE = {
    "README.md": "See app/ and helpers/.",
    ".venv/lib/site.py": "x = 1\n",
    "node_modules/pkg/thing.py": "x = 1\n",
    "app/__init__.py": "",
    "helpers/__init__.py": "",
    "vendor/__init__.py": "",
    "app/ingest.py": "def parse_record(row):\n    return row.split(',')\n\n\ndef validate_record(row):\n    pass\n\n\ndef store_record(row):\n    pass\n",
    "app/ingest_v2.py": "def parse_record(row):\n    return row\n\n\ndef validate_record(row):\n    return bool(row)\n\n\ndef enrich_record(row):\n    return row\n\n\ndef store_record(row):\n    pass\n",
    "app/main.py": "import argparse\nfrom .svc import report\nfrom helpers.util import tidy\n\nif __name__ == '__main__':\n    argparse.ArgumentParser()\n    report(tidy(1))\n",
    "app/svc.py": 'import json\n\n# TODO: the first thing\n# TODO: the second thing\n\n\ndef remediate(finding):\n    """Not yet implemented."""\n    pass\n\n\ndef report(x):\n    try:\n        x.go()\n        x.stay()\n    except Exception:\n        pass\n    return x\n\n\ndef caller(x):\n    return remediate(x)\n',
    "helpers/util.py": '"""Helpers."""\n\n\ndef tidy(x):\n    """Tidies."""\n    return x\n',
    "orphan.py": "def alone_here(x):\n    return x\n",
    "vendor/lib.py": "def lib_function():\n    return 1\n",
    "vendor/LICENSE": "MIT",
    "broken.py": "def (:\n",
}


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def git(root, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=root, check=True, capture_output=True)


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("known")
    write(root, TREE)
    git(root, "init", "-q")
    git(root, "add", "-A", "-f")
    git(root, "commit", "-qm", "first")
    write(root, {"app/svc.py": TREE["app/svc.py"] + "# more\n", "helpers/util.py": TREE["helpers/util.py"] + "# more\n"})
    git(root, "commit", "-qam", "second")
    git(root, "mv", "orphan.py", "lonely.py")
    git(root, "commit", "-qam", "third")
    write(root, {"late.py": "def late_function():\n    return 1\n"})
    return Survey.of_tree(spark, str(root))


def column(df, name="key"):
    return {r[name] for r in df.select(name).collect()}


def test_every_file_is_accounted_for(survey):
    h = survey.headline.first()
    assert (h.modules, h.excluded, h.skipped) == (12, 2, 0) and dict(survey.listing.excluded) == {".venv": 1, "node_modules": 1}


def test_edges_and_roots(survey):
    assert {tuple(r) for r in survey.edges.collect()} == {("app.main", "app.svc"), ("app.main", "helpers.util")}
    assert column(survey.entry_points) == {"app.main"}
    assert column(survey.loaded_by) == {"app", "helpers", "vendor"}
    assert {"broken", "lonely", "late", "app.ingest", "app.ingest_v2", "vendor.lib"} == column(survey.orphans)


def test_signals_of_the_service(survey):
    row = survey.frontier.where("key = 'app.svc'").first()
    assert row.counts == {"todo": 2, "empty_except": 1, "unused_import": 1, "stub_pass": 1} and row.score == 15.5
    assert "helpers.util" not in column(survey.frontier)
    assert not survey.signals.where("key = 'app.ingest' and kind = 'stub_pass'").take(1)


def test_dead_end(survey):
    row = survey.dead_ends.where("name = 'remediate'").first()
    assert row.calls == 1 and not row.called_from_elsewhere and [(c.name, c.module) for c in survey.callers.where("name = 'remediate'").collect()] == [("remediate", "app.svc")] and "finding" in row.direction and "report" in row.direction


def test_restart_group(survey):
    (row,) = survey.attempt_groups.collect()
    assert row.verdict == "restart" and row.resume_at == "app.ingest_v2" and [m.percent for m in row.members] == [52, 23]
    assert row.common_gaps == ["store_record"] and [s.added for s in row.lineage][1] == ["enrich_record"]


def test_origins_and_history(survey):
    got = {r.key: r.origin for r in survey.origins.collect()}
    assert got["vendor.lib"] == "vendored" and got["late"] == "untracked" and got["app.svc"] == "tracked"
    lonely = survey.file_history.where("path = 'lonely.py'").first()
    assert lonely.commits == 2 and lonely.first_subject == "first" and lonely.last_subject == "third"
    assert [tuple(r) for r in survey.co_change.collect()] == [("app/svc.py", "helpers/util.py", 2)]
    assert survey.salvage.where("key = 'late'").first().verdict == "never committed"


def test_clusters(survey):
    got = {r.label: r.belongs for r in survey.clusters.collect()}
    assert got["app.svc"] and not got["vendor.lib"]


def test_sinks(survey, tmp_path):
    render.write_json(survey, str(tmp_path / "s.json"))
    written, rows = json.loads((tmp_path / "s.json").read_text()), lambda v: sorted(json.dumps(x, sort_keys=True) for x in v) if isinstance(v, list) else v
    assert written["headline"]["modules"] == 12
    found = render.as_dict(survey)
    assert list(written) == list(found) and all(rows(written[k]) == rows(found[k]) for k in found)
    assert "not drawn" in render.mermaid(survey, 3)
    assert ET.fromstring(render.drawio(survey)).tag == "mxfile"
    page = render.html_map(survey, "a < b")
    assert "a &lt; b" in page and all(k in page for k in ("app.svc", "lonely.py"))
    assert render.unwritable([str(tmp_path / "no" / "x"), str(tmp_path / "y")]) == [str(tmp_path / "no" / "x")]
    registry, a = str(tmp_path / "r.json"), str(tmp_path / "s.json")
    render.record_map(registry, "p", a, 1, "f")
    assert len(render.record_map(registry, "p", a, 2, "f")) == 1


def test_evidence_reaches_the_sinks(survey):
    h = survey.headline.first()
    assert (h.entries, h.orphans, h.cycles, h.unreached) == (1, survey.orphans.count(), 0, survey.signals.where("kind = 'unreached'").select("key").distinct().count())
    assert "1 entry points" in render.summary(survey)
    found = render.as_dict(survey)
    assert {"key": "app.svc", "kind": "todo", "lineno": 3} in [{k: r[k] for k in ("key", "kind", "lineno")} for r in found["signals"]]
    assert {(r["src"], r["dst"], r["lineno"]) for r in found["evidence"]} >= {("app.main", "app.svc", 2), ("app.main", "helpers.util", 3)}
    text = render.frontier_text(survey, 1)
    assert "app/svc.py" in text and "          line 3: " in text and "          ... and 1 more" in text
    assert sorted(map(tuple, survey.trace("app.main").collect())) == [("used_by", "app.main", 0, 0), ("uses", "app.main", 0, 1), ("uses", "helpers.util", 1, 1)]


def test_headline_asks_for_counts_only(spark, tmp_path):
    write(tmp_path, {"main.py": "import a\nif __name__ == '__main__':\n    pass\n", "a.py": "import b\n", "b.py": "import a\n", "c.py": "import d\n", "d.py": "import c\n"})
    s = Survey.of_tree(spark, str(tmp_path), with_history=False)
    h = s.headline.first()
    assert (h.modules, h.entries, h.orphans, h.cycles, h.unreached) == (5, 1, 0, 2, 2)
    assert not {"signals", "judged", "import_cycles"} & set(s.__dict__)


def test_sections_count_cycles_without_listing_them(spark, tmp_path, monkeypatch):
    write(tmp_path, {"a.py": "import b\n", "b.py": "import a\n", "c.py": "import d\n", "d.py": "import c\n"})
    monkeypatch.setattr(render, "SECTIONS", {k: render.SECTIONS[k] for k in ("edges", "cycles")})
    monkeypatch.setattr(render, "HISTORY", {})
    s = Survey.of_tree(spark, str(tmp_path), with_history=False)
    assert render.section_sizes(s) == [("edges", 4), ("cycles", 2)] and "import_cycles" not in s.__dict__


def test_drawio_draws_every_module(spark, tmp_path):
    write(tmp_path, {f"m{i}.py": f"import m{i + 1}\n" if i < 2050 else "" for i in range(2051)})
    s = Survey.of_tree(spark, str(tmp_path), with_history=False)
    s.__dict__["states"] = s.modules.select("key", F.lit("live").alias("state"))
    s.__dict__["frontier"] = spark.createDataFrame([], "key string, score double")
    s.__dict__["layers"] = spark.createDataFrame([], "node string, depth int")
    cells = list(ET.fromstring(render.drawio(s)).iter("mxCell"))
    assert sum(c.get("vertex") == "1" for c in cells) == 2051 and sum(c.get("edge") == "1" for c in cells) == 2050


def test_relative_import_shapes(spark, tmp_path):
    write(tmp_path, {"pkg/__init__.py": "", "pkg/main.py": "from . import helper as h\nimport pkg.other\n", "pkg/helper.py": "from pkg.fmt import rtf\n", "pkg/other.py": "import json\n", "pkg/fmt/__init__.py": "", "pkg/fmt/rtf.py": ""})
    s = Survey.of_tree(spark, str(tmp_path), with_history=False)
    assert {tuple(r) for r in s.edges.collect()} == {("pkg.main", "pkg.helper"), ("pkg.main", "pkg.other"), ("pkg.helper", "pkg.fmt.rtf")}
    assert {tuple(r) for r in s.external.collect()} == {("pkg.other", "json")}
    assert s.origins.first().origin == "unknown"


def test_declarations_are_not_stubs(spark, tmp_path):
    code = "from typing import Protocol\n\n\nclass P(Protocol):\n    def dumps(self): ...\n\n\nclass Shape:\n    def area(self):\n        raise NotImplementedError  # TODO\n\n    def name(self):\n        return 1\n\n\nclass Square(Shape):\n    def area(self):\n        return 1\n\n\nclass Store:\n    def save(self): ...\n\n    def load(self):\n        return 1\n"
    write(tmp_path, {"lib.py": code})
    s = Survey.of_tree(spark, str(tmp_path), with_history=False)
    assert {(r.parent, r.name) for r in s.replaced_methods.collect()} == {("Shape", "area")}
    assert column(s.signals.where("kind like 'stub%' or kind = 'not_implemented'"), "text") == {"Store.save"}


def test_unreadable_files_are_rows(spark, tmp_path):
    write(tmp_path, {"a.py": b"\xff\xfe\x00", "b.py": b"x = '\xe9'\n", "c.py": "x = 1\n", "d.py": b"\0"})
    s = Survey.of_tree(spark, str(tmp_path), with_history=False)
    errors = {r.key: r.error for r in s.modules.collect()}
    assert errors["c"] is None and all(errors[k] for k in "abd")


def test_cap_counts_what_it_skips(tmp_path):
    write(tmp_path, {f"m{i}.py": "" for i in range(5)})
    listing = tree.list_tree(str(tmp_path), max_files=3)
    assert (len(listing.files), listing.skipped) == (3, 2)


@pytest.mark.parametrize(("text", "tag"), [("# TODO: x", "TODO"), ("# FIXME(me) y", "FIXME"), ("#: todo: z", "TODO"), ("# 1. HACK it", "HACK"), ("# x -- TODO: y", "TODO"), ("# attempted", None), ("# debug", None), ("# a TODO in prose", None), ("# temp file", None),
    ("# todo: lower case, with a label", "TODO"), ("#TEMP: no space", "TEMP"), ("# hack(bob): shim", "HACK"), ("# -- TODO: wire it", "TODO"), ("# noqa: E501  TODO: drop it", "TODO"), ("# type: ignore[attr-defined]  FIXME(ann): stubs", "FIXME"), ("# (TODO) remove", "TODO"), ("# 1) WIP", "WIP"),
    ("# NOQA TODO: x", None), ("# a--TODO: x", None), ("# foo noqa: E501,abc1 TODO: z", None), ("# WARNING: TODO: counted", None), ("# see FIX-XXX: ticket 301", None), ("# KNOWN_BUGS.md", None), ("# contemporary", None), ("# forty TODOs", None), ("# the todo: list", None), ("# NOTE: a decision", None)])
def test_tags(text, tag):
    assert facts.tag_of(text) == tag


@pytest.mark.parametrize(("text", "code"), [("# x = 1", True), ("# return total", True), ("# import os", True), ("# do_it(1)", True), ("#     x = 1", False), ("# noqa: F401", False), ("# some prose here", False), ("# word", False), ("# type: ignore", False)])
def test_disabled_code(text, code):
    assert facts.is_disabled_code(text) is code


@pytest.mark.parametrize(("text", "keeps"), [("# noqa", True), ("# noqa: F401", True), ("# noqa: E501,F401", True), ("# noqa: E501", False), ("# pylint: disable=unused-import", True), ("# pylint: enable=unused-import", False), ("# not a noqa thing", False)])
def test_waivers(text, keeps):
    assert facts.keeps_import(text) is keeps


@pytest.mark.parametrize(("text", "promises"), [("Returns the sum.", True), ("Sum.\n\nReturns:\n  x", True), ("Sum.\n\n:return: x", True), ("The stub returns nothing.", False), (None, False)])
def test_promises(text, promises):
    assert facts.promises_value(text) is promises


@pytest.mark.parametrize(("lines", "says"), [(["def f(): pass  # TODO"], True), (["def todo(row):", "    pass"], False), (["def f():", "    pass  # not implemented yet"], True), (["def f():", "    # not (yet) implemented"], True), (["def f():", "    # Not yet", "    # implemented"], False), (["def f():", "    # not yet  implemented"], True), (["def f():", "    # Not implemented. Yet another note"], False), (["def f():", "    todos()"], False), ([], False)])
def test_unfinished_wordings(lines, says):
    assert facts.says_unfinished(lines) is says


def test_swallowed_exceptions():
    import ast

    def lines(code, commented=()):
        return facts.swallowed(ast.parse(code), set(commented))

    work = "try:\n    a()\n    b()\nexcept Exception:\n    pass\n"
    assert lines(work) == [4] and lines(work, [4]) == []
    assert lines("try:\n    x.close()\nexcept Exception:\n    pass\n") == []
    assert lines("try:\n    import q\nexcept Exception:\n    pass\n") == []
    assert lines("try:\n    a()\n    b()\nexcept ValueError:\n    pass\n") == []
    assert lines("try:\n    w()\n    v()\nfinally:\n    try:\n        a()\n        b()\n    except:\n        pass\n") == []


def test_hostile_repository_settings_run_nothing(spark, tmp_path):
    write(tmp_path, {"m.py": "x = 1\n"})
    git(tmp_path, "init", "-q")
    mark = tmp_path / "ran"
    git(tmp_path, "config", "core.fsmonitor", f"touch {mark}")
    Survey.of_tree(spark, str(tmp_path)).origins.count()
    assert not mark.exists()


def test_strings_given_to_all():
    found = facts.file_facts("m.py", b"__all__ = ['a']\n__all__ += ['b']\n__all__.extend(['c', 'd'])\n__all__.append('e')\nother.extend(['f'])\n")
    assert found["symbol_strings"] == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize(("body", "says"), [("def f(): pass  # TODO", True), ("def f():\n    pass  # not yet implemented", True), ("def f():\n    raise NotImplementedError('not implemented yet')", True), ("def todo():\n    pass", False), ("def f():\n    pass  # not implemented", False)])
def test_bodies_that_say_they_are_unfinished(body, says):
    (found,) = facts.file_facts("m.py", body.encode())["definitions"]
    assert found["says"] is says


def test_bytes_that_python_refuses():
    row = facts.file_facts("m.py", b"a = 1\nb = '\xe9'\n")
    assert row["error"].startswith("Python refuses") and row["error_line"] == 2 and row["names_used"] == ["a", "b"]
    assert facts.file_facts("m.py", "# coding: latin-1\nb = '\u00e9'\n".encode("latin-1"))["error"] is None
    assert facts.file_facts("m.py", b"# coding: nonsense\n")["error"]


def test_packaging(spark, tmp_path):
    from trowel.sources import packaging

    (tmp_path / "pyproject.toml").write_text('[project.scripts]\nrun = "pkg.cli:main"\n[project.entry-points.plug]\nx = "pkg.plug [extra]"\nbad = "not a spec!"\n')
    (tmp_path / "setup.cfg").write_text("[options.entry_points]\nconsole_scripts =\n    run2 = pkg.cli:other\n    old = pkg.old:main\n")
    got = {r.module: (r.spec, r.by, r.source, r.name) for r in packaging.declared(spark, str(tmp_path)).collect()}
    assert got == {"pkg.cli": ("pkg.cli:main", "scripts", "pyproject.toml", "run"), "pkg.plug": ("pkg.plug [extra]", "plug", "pyproject.toml", "x"), "pkg.old": ("pkg.old:main", "console_scripts", "setup.cfg", "old")}
    (tmp_path / "setup.cfg").write_text("[broken")
    (tmp_path / "pyproject.toml").write_text("= broken")
    assert packaging.declared(spark, str(tmp_path)).count() == 0


def test_packaging_of_many_projects(spark, tmp_path):
    from trowel.sources import packaging

    files = {
        "a/pyproject.toml": b'[project.scripts]\nrun = "m.cli:main"\n', "a/setup.cfg": b"[options.entry_points]\r\nconsole_scripts =\r\n    old = m.cli:old\r\n    x = m.x\r\n",
        "b/pyproject.toml": b"project = 3\n", "c/pyproject.toml": b'[project]\nscripts = "no table"\nentry-points = ["none"]\n', "d/setup.cfg": b"\xff[", "e/pyproject.toml": b"", "e/setup.cfg": None, "f/notes.txt": b'[project.scripts]\nrun = "n.cli"\n',
        "pyproject.toml": '[project.scripts]\n"\u00fc" = "top"\n'.encode(),
    }
    table = spark.createDataFrame([(p, c, 1) for p, c in [*files.items(), ("a/setup.cfg", files["a/setup.cfg"])]], "relpath string, content binary, rank int")
    got = sorted(tuple(r) for r in packaging.declared_in(table).collect())
    assert got == [("", "top", "top", "scripts", "pyproject.toml", "\u00fc"), ("a", "m.cli", "m.cli:main", "scripts", "pyproject.toml", "run"), ("a", "m.x", "m.x", "console_scripts", "setup.cfg", "x")]
    assert packaging.declared_in(table.limit(0)).count() == 0
    for name in ("a", "b", "c", "d", "e"):  # one project by the same rule
        (tmp_path / name).mkdir()
        for path, content in files.items():
            if path.startswith(f"{name}/") and content is not None:
                (tmp_path / path).write_bytes(content)
        assert sorted(r.module for r in packaging.declared(spark, str(tmp_path / name)).collect()) == sorted(m for project, m, *_ in got if project == name)


def test_dropped_paths(tmp_path):
    write(tmp_path, {"a/m.py": "", "b/n.py": ""})
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert tree.folders_from_drop([a, f"{a}/m.py", f"file://{b}/n.py", " "]) == [a, b]
    for payload in ([], [str(tmp_path / "gone")]):
        with pytest.raises(ValueError):
            tree.folders_from_drop(payload)


def test_listing_as_tables_equals_the_walk(spark, tmp_path):
    files = {f"{d}m{i}.py": "x = 1\ny = 2" for d in ("", "a/", "a/b/", "a-b/", "venv/x/", ".h/") for i in range(3)}
    write(tmp_path, files | {"a/__init__.py": "", "notes.md": ""})
    walked = tree.list_tree(str(tmp_path), max_files=8)
    paths = [(str(p.relative_to(tmp_path)),) for p in tmp_path.rglob("*") if p.is_file()]
    rows = tree.account(spark.createDataFrame(paths, "relpath string"), max_files=8).collect()
    assert [r.relpath for r in sorted((r for r in rows if r.kind == "file"), key=lambda r: r.ord)] == walked.files
    assert sum(r.kind == "skipped" for r in rows) == walked.skipped == 5 and {r.pruned: sum(x.pruned == r.pruned for x in rows) for r in rows if r.pruned} == dict(walked.excluded)
    assert tuple(tree.index(tree.read_files(spark, tree.list_tree(str(tmp_path)))).first()) == (13, 24, 1, 0)


def test_shelf(tmp_path, monkeypatch):
    from trowel.sinks import shelf

    project = tmp_path / "a project"
    project.mkdir()
    first = shelf.map_destination(f"{project}/", "s")
    assert first == str(tmp_path / "a project-map-s.html")
    open(first, "w").close()
    second = shelf.map_destination(str(project), "s")
    assert second.endswith("-map-s-2.html")
    open(second, "w").close()
    registry = str(tmp_path / "r.json")
    assert shelf.read_register(registry) == [] and "No map" in shelf.shelf_page(registry)
    shelf.record_map(registry, "one", first, 3, "/f/one")
    shelf.record_map(registry, "<two>", second, 4, "/f/two")
    shelf.record_map(registry, "one", first, 5, "/f/one")
    assert [(r["project"], r["modules"]) for r in shelf.read_register(registry)] == [("one", 5), ("<two>", 4)]
    page = open(shelf.write_shelf(registry, str(tmp_path / "deep" / "shelf.html"))).read()
    assert "&lt;two&gt;" in page and "a%20project-map-s.html" in page
    os.remove(first)
    assert [r["project"] for r in shelf.read_register(registry)] == ["<two>"]
    for broken in ("{", '{"a": 1}', "[1, 2]"):
        (tmp_path / "r.json").write_text(broken)
        assert shelf.read_register(registry) == []
    monkeypatch.setenv(shelf.HOME_VARIABLE, str(tmp_path))
    assert shelf.shelf_home() == str(tmp_path) and shelf.shelf_note(f"{tmp_path}/shelf.html") and not shelf.shelf_note(os.path.expanduser(f"{shelf.HOME}/shelf.html"))


def test_map_shows_every_module_and_cannot_be_broken_out_of(survey):
    page = render.html_map(survey, "t")
    assert page.count('class="node"') == 12 and page.count("</script>") == 2
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    svc = data["modules"]["app.svc"]
    assert svc["used_by"] == ["app.main"] and svc["signals"]["todo"]["lines"][0][0] == 3
    assert data["modules"]["app.main"]["links"]["app.svc"]["lines"] == [[2, "from .svc import report"], [7, "    report(tidy(1))"]]


def test_no_folder_is_trusted_for_git():
    from trowel.sources import gitlog

    assert not any("safe.directory" in a for a in gitlog.HARDENED)


def git(root, *args):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@a", *args], cwd=root, check=True, capture_output=True)


def committed(root, *steps):
    """Commits of steps: (files to write, moves)."""
    git(root, "init", "-q")
    for n, (files, moves) in enumerate(steps):
        write(root, files)
        for old, new in moves:
            git(root, "mv", old, new)
        git(root, "add", "-A")
        git(root, "commit", "-qm", f"step {n}", "--date", f"2024-01-{n + 1:02d}T12:00:00")


def test_log_by_ranges_of_commits(spark, tmp_path, monkeypatch):
    from trowel.sources import gitlog

    body = "\n".join(f"x{i} = {i}" for i in range(20)) + "\n"
    committed(tmp_path, ({"a.py": body}, []), ({"b.py": "y = 1\n"}, []), ({}, [("a.py", "z.py")]), ({"é b.py": "w = 2\n"}, []), ({}, [("z.py", "a.py")]))
    reader = gitlog.LogReader(str(tmp_path), 4000)
    whole = list(reader.read(gitlog.CommitRange(0, 5)))
    assert [r[:1] + r[3:] for r in whole] == [(0, "a", "step 4", ["a.py"], [{"old": "z.py", "new": "a.py"}]), (1, "a", "step 3", ["é b.py"], []), (2, "a", "step 2", ["z.py"], [{"old": "a.py", "new": "z.py"}]), (3, "a", "step 1", ["b.py"], []), (4, "a", "step 0", ["a.py"], [])]
    monkeypatch.setattr(gitlog, "RANGE", 2)
    parts = reader.partitions()
    assert [p.value for p in parts] == [(0, 2), (2, 2), (4, 1)] and [r for p in parts for r in reader.read(p)] == whole
    assert [p.value for p in gitlog.LogReader(str(tmp_path), 3).partitions()] == [(0, 2), (2, 1)]
    commits, files, renames = gitlog.split_log(gitlog.log(spark, str(tmp_path)))
    assert commits.count() == 5 and files.count() == 5
    assert [(r.old, r.new) for r in renames.orderBy("ord").collect()] == [("a.py", "z.py"), ("z.py", "a.py")]
    assert sorted(r.relpath for r in gitlog.tracked(spark, str(tmp_path)).collect()) == ["a.py", "b.py", "é b.py"]


def test_history_of_a_file_that_was_moved_there_and_back(spark, tmp_path):
    body = "\n".join(f"x{i} = {i}" for i in range(20)) + "\n"
    committed(tmp_path, ({"a.py": body}, []), ({}, [("a.py", "z.py")]), ({"z.py": body + "more = 1\n"}, []), ({}, [("z.py", "a.py")]), ({"b.py": "import a\n"}, []))
    s = Survey.of_tree(spark, str(tmp_path))
    got = {r.path: (r.commits, r.first_seen, r.last_touched) for r in s.file_history.collect()}
    assert got == {"a.py": (4, "2024-01-01", "2024-01-04"), "b.py": (1, "2024-01-05", "2024-01-05")}
    assert [(r.month, r.path) for r in s.timeline_files.orderBy("path").collect()] == [("2024-01", "a.py"), ("2024-01", "b.py")]
    assert [tuple(r) for r in s.authors.collect()] == [("a", 2, 5)]
    state = s.history_state.first()
    assert state.available and not state.shallow and state.authors == 1 and state.note is None


def test_a_shallow_clone_says_so(spark, tmp_path):
    (tmp_path / "full").mkdir()
    committed(tmp_path / "full", ({"a.py": "x = 1\n"}, []), ({"a.py": "x = 2\n"}, []), ({"b.py": "y = 1\n"}, []))
    git(tmp_path, "clone", "-q", "--depth", "1", f"file://{tmp_path}/full", "part")
    s = Survey.of_tree(spark, str(tmp_path / "part"))
    assert s.shallow and s.history_state.first().note.startswith("This is a shallow clone")
    assert "shallow clone" in render.summary(s)
    no = Survey.of_tree(spark, str(tmp_path / "part"), with_history=False).history_state.first()
    assert not no.available and no.reason and not no.shallow


def test_prose_of_dot_folders_counts_and_the_document_at_the_limit_is_read(tmp_path, monkeypatch):
    write(tmp_path, {".github/workflows/ci.yml": "run Tool", "a.md": "one", "node_modules/x.md": "no", ".venv/y.txt": "no", "sub/build/z.md": "no", "b.txt": "two"})
    assert sorted(tree.list_tree(str(tmp_path)).prose) == [".github/workflows/ci.yml", "a.md", "b.txt"]
    assert "run tool" in tree.read_prose(tree.list_tree(str(tmp_path)))
    monkeypatch.setattr(tree, "PROSE_ALL", 4)
    assert tree.read_prose(tree.list_tree(str(tmp_path))) == "one\ntwo"


def test_snippets_are_slices_of_the_source(survey):
    source = {r.key: r.source.split("\n") for r in survey.modules.collect()}
    found = survey.snippets.join(survey.regions, ["key", "low"]).collect()
    assert len(found) == survey.regions.count() and all(r.lines == source[r.key][r.low - 1 : r.high] for r in found)


def test_map_has_a_chip_for_each_state_and_room_for_a_trace(survey):
    page = render.html_map(survey, "t")
    tally = {r.state: r.modules for r in survey.state_tally.collect()}
    for state, n in tally.items():
        assert page.count(f'data-state="{state}" aria-pressed="false"') == 1 and f">{state} {n}</button>" in page
    assert 'id="trace"' in page and "e.key === ' '" in page and "'Escape'" in page
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert data["card"] == [152, 72, 10] and data["width"] == 1350 and data["hides"] == ["deadend", "broken"]


def test_rows_are_dealt_to_all_cores_and_then_to_more_tasks_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(1000).coalesce(1), spark.range(100_000).coalesce(1)
    assert spread(few, "id", 4000).rdd.getNumPartitions() == 2
    assert spread(few, "id", 1000).rdd.getNumPartitions() == min(cores, 8)
    assert spread(many, "id", 1000).rdd.getNumPartitions() == 100
    assert spread(many, "id", 1000).count() == 100_000


def test_a_survey_parses_only_when_a_finding_needs_facts(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", b"def f():\n    return 1\n", 0)], "relpath string, content binary, ord long")
    staged = []
    monkeypatch.setattr(plans, "stage_table", lambda s, df, name: staged.append(name) or df)
    found = Survey(spark, files)
    assert staged == [] and found.files.count() == 1
    assert [r.key for r in found.modules.select("key").collect()] == ["a"] and staged == ["modules"]


def test_what_is_returned_within_a_definition_counts_for_all_around_it():
    text = "class A:\n    def f(self):\n        def g():\n            return 1\n    def h(self):\n        return\nasync def k(): pass\n"
    assert [(d["name"], d["returns"]) for d in facts.file_facts("a.py", text.encode())["definitions"]] == [("A", True), ("f", True), ("g", True), ("h", False), ("k", False)]


def test_files_are_handed_over_in_batches(spark):
    rows = [(f"m{i}.py", f"x{i} = 1\n".encode(), i) for i in range(600)]
    found = facts.extract(spark.createDataFrame(rows, "relpath string, content binary, ord long").coalesce(1)).select("relpath", "ord", "loc")
    assert sorted(map(tuple, found.collect())) == sorted((r, o, 1) for r, _, o in rows)


def test_what_needs_paths_alone_parses_nothing(spark, monkeypatch):
    def refuse(files):
        raise AssertionError("parsed")

    monkeypatch.setattr(facts, "extract", refuse)
    files = spark.createDataFrame([("a/__init__.py", b"", 0), ("a/test_b.py", b"x = 1", 1), ("a/c.py", b"def (", 2)], "relpath string, content binary, ord long")
    commits = spark.createDataFrame([(1, "c1", 0, "n", "first")], "ord long, sha string, at long, author string, subject string")
    touched = spark.createDataFrame([(1, "a/c.py"), (1, "gone.py")], "ord long, path string")
    own = Survey(spark, files, commits=commits, commit_files=touched)
    assert {(r.loader, r.modules, r.proven) for r in own.held_back.collect()} == {("the import system", 1, 0), ("a test runner", 1, 0)}
    assert column(own.file_history, "path") == {"a/c.py"}


def test_comments_are_found_without_a_tokenizer_where_strings_hold_no_code(monkeypatch):
    plain = ["", "x = 1", "# a", "  # a\nx = '#'  # b\n", 'x = """\n# no\n\\"""#"""  # yes', "x = '\\'#' # c", "g'#'#d", 'r"\\#" # e', "'' # f\n\"\" # g", "x = (\n    1,  # h\n    # i\n)", "\u00e9 = '''#''\\'#'''\n# j"]
    hard = ['f"{x}" # a', "rF'#{1}' # b", "x = 1 + \\\n1 # c\n", "x = 1 # d\r\ny = 2 # e\r\n"]
    assert [facts.comments_in(x) for x in plain] == [facts.comments_of(x)[0] for x in plain] and all(facts.comments_in(x) is None for x in hard)
    sound = ["# a\nx = '#'  # b\n", 'x = """\n# no\n"""  # TODO: c\n']
    wanted = [facts.file_facts("a.py", x.encode()) for x in sound]

    def refuse(readline):
        raise AssertionError("tokenized")

    monkeypatch.setattr(facts.tokenize, "generate_tokens", refuse)
    assert [facts.file_facts("a.py", x.encode()) for x in sound] == wanted


def test_sections_are_made_side_by_side(monkeypatch):
    from threading import Barrier

    together = Barrier(2, timeout=20)

    class Rows:
        def count(self):
            return 3

    def made(s):
        together.wait()  # breaks where one is made after the other
        return Rows()

    monkeypatch.setattr(render, "SECTIONS", {"a": made})
    monkeypatch.setattr(render, "HISTORY", {"b": made})
    assert render.section_sizes(None) == [("a", 3), ("b", 3)]


FEW = {
    "a.py": b"import requests\n\n\ndef f():\n    requests.get('x')\n    # x = 1\n    open('y')\n",
    "b.py": b"x = '# y = 2'\n# prose (only\n",
    "c.py": "import os\n\uff4fpen('x')  # caf\u00e9\n".encode(),
    "d.py": b"def (:\n# z = 3\n",
    "e.py": b"x = 1 + \\\n    2\n",
    "f.py": b"# TODO: x = 4\n# gave = up(\r\n",
    "g.py": b"a = 1\x0cb = 2\r\rc = '\xe9'\n",
}


def few_files(spark):
    rows = [(p, b, i) for i, (p, b) in enumerate(FEW.items())] + [("gone.py", None, 9)]
    return spark.createDataFrame(rows, "relpath string, content binary, ord long")


@pytest.mark.parametrize("finding, stage", [("disabled_code", "disabled"), ("effects", "reaching"), ("in_folders", "sized")])
def test_findings_of_few_files_parse_no_others_and_are_as_of_all(spark, monkeypatch, finding, stage):
    staged = []
    monkeypatch.setattr(plans, "stage_table", lambda s, df, name: staged.append(name) or df)
    files = few_files(spark)
    few, every = Survey(spark, files), Survey(spark, files)
    got = sorted(map(tuple, getattr(few, finding).collect()))
    assert staged == [stage]
    assert every.modules.count() == 8 and sorted(map(tuple, getattr(every, finding).collect())) == got
    assert {"disabled_code": [("a", 6), ("d", 2)], "effects": 2, "in_folders": 8}[finding] in (got, len(got))


def test_what_may_hold_disabled_code_and_names():
    assert [facts.may_hold_disabled_code(x) for x in ("x = 1", "# prose", "# x = 1", "'\n# f(x)\n'", "# a # y = 2", "#\r")] == [False, False, True, True, True, True]
    names = frozenset(["open"])
    assert [facts.may_use(names, x) for x in ("x = 1", "reopen()", "a.open ()", "f'{open}'", "\uff4fpen()")] == [False, False, True, True, True]


def test_a_trace_leaves_out_what_states_calls_dead_ends_and_broken(survey):
    wanted = {r.key for r in survey.states.where(F.col("state").isin(*plans.TRACE_HIDES)).collect()}
    assert {r.key for r in survey.hopeless.collect()} == wanted and wanted


def test_a_trace_gathers_no_signals(spark):
    files = spark.createDataFrame([("main.py", b"import a\n", 0), ("a.py", b"import b\ndef (:\n", 1), ("b.py", b"def g():\n    pass\n", 2)], "relpath string, content binary, ord long")
    found = Survey(spark, files)
    assert [tuple(r) for r in found.trace("main").where("direction = 'uses' and depth > 0").collect()] == []
    assert not {"signals", "frontier", "states"} & set(found.__dict__)


def test_first_commits_are_those_of_the_history(survey):
    assert "file_history" in survey.__dict__ or survey.file_history is not None
    wanted = sorted(map(tuple, survey.file_history.select("path", "first_seen").collect()))
    own = Survey(survey.spark, survey.files, survey.listing, survey.commits, survey.commit_files, survey.renames, survey.tracked, raw=survey.raw)
    assert sorted(map(tuple, own.begun.collect())) == wanted and "file_history" not in own.__dict__ and len(wanted) > 5


def test_arrow_columns_of_nested_facts_are_as_given(spark):
    found = [facts.file_facts(p, b, i) for i, (p, b) in enumerate(FEW.items())]
    kinds = facts.to_arrow_schema(facts.StructType.fromDDL(facts.SCHEMA))
    assert all(facts.column([x[f.name] for x in found], f.type).to_pylist() == [x[f.name] for x in found] for f in kinds)
