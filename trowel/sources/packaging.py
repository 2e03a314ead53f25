"""Modules that packaging metadata declares as entry points: of one project, or of a table of projects."""

from __future__ import annotations

import configparser
import io
import os
import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trowel.session import ship_package

_SPEC = re.compile(r"^\s*([A-Za-z_][\w.]*)\s*(?::\s*[\w.]+)?\s*(?:\[[^\]]*\])?\s*$")
SCHEMA = "module string, spec string, by string, source string, name string"
#: The tables of a project that name programs, besides its entry points.
SCRIPT_TABLES = ["scripts", "gui-scripts"]


def _entries(pairs, group: str, source: str):
    """(module, spec, group, source, name) of (name, spec) pairs whose spec names a module."""
    for name, spec in pairs:
        found = _SPEC.match(spec) if isinstance(spec, str) else None
        if found:
            yield found[1], spec.strip(), group, source, name.strip()


def _from_pyproject(raw: bytes) -> list[tuple]:
    try:
        project = tomllib.loads(raw.decode("utf-8")).get("project", {})
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        return []
    if not isinstance(project, dict):
        return []
    named = project.get("entry-points")
    groups = [(t, project.get(t)) for t in SCRIPT_TABLES] + list(named.items() if isinstance(named, dict) else [])
    return [e for group, table in groups if isinstance(table, dict) for e in _entries(table.items(), group, "pyproject.toml")]


def _from_setup_cfg(raw: bytes) -> list[tuple]:
    parser = configparser.ConfigParser(interpolation=None)
    try:
        parser.read_file(io.TextIOWrapper(io.BytesIO(raw), "utf-8"))
        section = dict(parser["options.entry_points"]) if parser.has_section("options.entry_points") else {}
    except (configparser.Error, UnicodeDecodeError):
        return []
    lines = lambda text: [line.split("=", 1) for line in (text or "").splitlines() if "=" in line]
    return [e for group, text in section.items() for e in _entries(lines(text), group, "setup.cfg")]


#: Who reads which file, the first that counts first.
READERS = {"pyproject.toml": _from_pyproject, "setup.cfg": _from_setup_cfg}


def declared_in(files: DataFrame) -> DataFrame:
    """files(relpath, content) of any number of projects -> (project, module, spec, by, source, name); a project is the folder of its files.

    A project's module counts once, by its first entry; pyproject.toml wins over setup.cfg. Files of other names, null or
    broken contents and specs that name no module give nothing; of files with one path, one counts.
    """
    file, folder = F.substring_index("relpath", "/", -1), F.regexp_extract("relpath", "^(.*)/[^/]*$", 1)
    own = files.where(file.isin(*READERS) & F.col("content").isNotNull()).groupBy(folder.alias("project"), file.alias("file")).agg(F.min("content").alias("content"))

    def read(batches):
        for batch in batches:
            rows = [(project, rank, place, *entry) for project, name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) for rank, at in enumerate(READERS) if at == name for place, entry in enumerate(READERS[name](raw))]
            yield pa.RecordBatch.from_pylist([dict(zip(columns.names, r, strict=True)) for r in rows], columns)

    shape = f"project string, rank int, place int, {SCHEMA}"
    columns = to_arrow_schema(StructType.fromDDL(shape))
    ship_package(files.sparkSession)
    entries = own.mapInArrow(read, shape)
    first = entries.groupBy("project", "module").agg(F.min(F.struct("rank", "place", "spec", "by", "source", "name")).alias("e"))
    return first.select("project", "module", "e.spec", "e.by", "e.source", "e.name")


def declared(spark: SparkSession, root: str) -> DataFrame:
    """declared(module, spec, by, source, name) of one project, by the rule of declared_in; its two files are read here."""
    found: dict[str, tuple] = {}
    for name, read in READERS.items():
        try:
            with open(os.path.join(root, name), "rb") as f:
                raw = f.read()
        except OSError:
            continue
        for entry in read(raw):
            found.setdefault(entry[0], entry)
    return spark.createDataFrame([found[m] for m in sorted(found)], SCHEMA)
