"""Session helpers: building a session, shipping the package, shared staging tables."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = Path(__file__).resolve().parent

_shipped: set[str] = set()
_shipping = Lock()
_local_stage: list[str] = []


def build_session(app: str = "trowel", cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings the library expects; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable by Python workers that do not have it on their path; once, also if several threads ask."""
    parent = str(PACKAGE_ROOT.parent)
    if parent in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    with _shipping:
        if app in _shipped:
            return
        target = Path(tempfile.mkdtemp(prefix="trowel-ship-")) / "trowel_pkg.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(PACKAGE_ROOT.rglob("*.py")):
                z.write(p, str(p.relative_to(PACKAGE_ROOT.parent)))
        spark.sparkContext.addPyFile(str(target))
        if parent not in sys.path:
            sys.path.insert(0, parent)
        _shipped.add(app)


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir, or a temporary one for a local master that has none."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    with _shipping:
        if not _local_stage:
            _local_stage.append("file://" + tempfile.mkdtemp(prefix="trowel-stage-"))
    return _local_stage[0]


def stage_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors, is computed once.

    The files go when the driver's JVM ends.
    """
    path = f"{stage_root(spark)}/trowel/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, n: int, each: int) -> int:
    """Tasks of some each rows for n rows: all cores while rows are few, then more tasks, not larger ones."""
    return max(-(-n // each), min(spark.sparkContext.defaultParallelism, -(-8 * n // each)), 1)


def spread(df: DataFrame, key: str, each: int) -> DataFrame:
    """df dealt by key to tasks of some each rows, for work that Spark can't tell from the size of its input."""
    return df.repartition(tasks_for(df.sparkSession, df.count(), each), key)


def input_bytes(df: DataFrame) -> int:
    """What Catalyst's statistics say about the size of df's inputs, without a job; where they know nothing, half its values' bytes, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 53:
        return max(1, size)
    width = lambda c, kind: F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8)
    total = df.agg(*(F.sum(width(c, kind)).alias(f"c{i}") for i, (c, kind) in enumerate(df.dtypes))).first()
    return max(1, sum(x or 0 for x in total) // 2)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
