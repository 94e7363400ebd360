"""Session settings and the shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Setting of a session: the name of the database of its scratch tables, which no other session has.
SCRATCH = "marginalia.scratch"


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    folder = tempfile.mkdtemp(prefix="marginalia-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marginalia")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.executorEnv.PYTHONPATH", ROOT)  # Python workers find the library from any folder
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on one machine
    gets a temporary folder; a cluster has none that all would see, so it must be set there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
            root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The database of this session's scratch tables, in the shared folder."""
    name = spark.conf.get(SCRATCH, None)
    if not name:
        name = f"marginalia_{uuid.uuid4().hex}"
        spark.conf.set(SCRATCH, name)
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{scratch_root(spark)}/{name}'")
    return name


def materialize(df: DataFrame, label: str, buckets: tuple[int, str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    It is a managed Parquet table of a database in that folder, so later readers still prune columns and push filters
    down, and ``release`` deletes its files. ``buckets``: their number and the column by which rows are dealt to them.
    """
    spark = df.sparkSession
    name = f"{scratch(spark)}.{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").options(**options)
    if buckets:
        writer = writer.bucketBy(*buckets)
    writer.saveAsTable(name)
    stored = spark.table(name)
    stored.scratch_name = name
    return stored


def release(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for frame in frames:
        frame.sparkSession.sql(f"DROP TABLE IF EXISTS {frame.scratch_name}")


def release_all(spark: SparkSession) -> None:
    """Delete all materialised tables of this session; results that were not read yet can't be read afterwards."""
    name = spark.conf.get(SCRATCH, None)
    if name:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def spread(spark: SparkSession, units: int, per_task: int) -> int:
    """Partitions for work that AQE can't split: ``per_task`` units each, and as many as the session asks for at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // per_task))


def dealt(rows: DataFrame, *keys: str, per_task: int = 20_000) -> DataFrame:
    """``rows`` (of a table, so that counting them reads its footers only) dealt to tasks by ``keys``, for work that is much
    larger than the rows. A small file is read by one task, and AQE would put small partitions together again; it leaves a
    given number of them alone."""
    return rows.repartition(spread(rows.sparkSession, rows.count(), per_task), *keys)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never sent to the driver. A plan's sizes are guessed from compressed files and
    don't see what functions and explodes add, so that a broadcast by them can be of any size."""
    return rows.hint("merge")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
