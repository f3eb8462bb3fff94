"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

Library operators never create a session; they take DataFrames. These helpers are
for entry points (tests, bench, the driver contract).
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  app: str = "rentlens") -> SparkSession:
    """A local[N] session with AQE on, the UI off and UTC time."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.maxResultSize", "4g")
        # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; a fused
        # stage larger than that would run interpreted, so let Spark split it.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # local runs only: keep catalog tables out of the working directory
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="rentlens-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The setting is read from the session. Only in a local session (tests, bench), where executors and driver
    are one process, is a scratch folder made when it is unset; on a cluster that is an error, as each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="rentlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Shuffle files of the queries run inside go when their query has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, how: str = "table") -> DataFrame:
    """Compute a frame once for plans that read it several times.

    ``table`` (default) writes it as parquet under the shared checkpoint folder
    and reads it back: the lineage is cut (a lost executor rereads files instead
    of replaying joins) and later reads stay columnar, so column pruning and
    filter pushdown still apply. ``checkpoint`` uses ``DataFrame.checkpoint``
    (row files, read whole). ``persist`` keeps it in executor memory/disk (lost
    blocks are recomputed from lineage)."""
    if how == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        return cut_lineage(df)
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known, so no job reads the files for it


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rentlens`` importable in Python workers (pandas UDF paths) by adding
    a zip of the package with ``SparkContext.addPyFile`` — Spark distributes it to
    every executor. Done once per application."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="rentlens-py-"), "rentlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int,
               partition_mb: int = 200) -> dict[str, str]:
    """Session settings for a cluster run over ``input_bytes`` of scanned data.

    Shuffle partitions target ~``partition_mb`` per partition (at least two
    waves of tasks); AQE coalesces small ones and splits skewed ones at runtime;
    file splits of 256 MB keep scan tasks large; a fused stage above HotSpot's JIT
    limit is split; Arrow batches bound the memory of the pandas paths."""
    slots = executors * cores_per_executor
    parts = max(2 * slots, -(-input_bytes // (partition_mb * 1024 * 1024)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_mb * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
