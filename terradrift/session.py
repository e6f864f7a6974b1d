"""Session settings and the shared work folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_saved: dict[str, list[str]] = {}


def build_session(app: str = "terradrift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tuned for; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A shuffle on (scene, tile) also serves a join on (scene, tile, row, col).
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster the
    setting is required because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def save_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the work folder and return a scan of the written table.

    This cuts lineage, lets later steps prune columns, and gives the planner the
    real size: a small table is broadcast because its files are known to be small,
    a large one is shuffled.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _saved.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has saved; call it when results that read them are stored.

    Returns the number of tables. Nothing else in the work folder is touched.
    """
    paths = _saved.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors, for clusters where it is not installed on every node. Returns the archive's path."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "terradrift.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    return archive
