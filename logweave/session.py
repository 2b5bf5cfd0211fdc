"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_SESSION_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def get_session(
    app_name: str = "logweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster leave ``master`` unset so spark-submit decides; size
    ``shuffle_partitions`` to the data (AQE coalesces small partitions).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_utc(spark)
    ship_package(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Log timestamps are wall-clock (timestamp_ntz); keep zone-aware steps in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_small_batches(spark: SparkSession) -> None:
    """Arrow batches of up to 8 MB: long texts and blocks go to Python workers a few at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != _SESSION_CONF[key]:
        spark.conf.set(key, _SESSION_CONF[key])


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Without that setting a private folder is made and registered, but only on
    a local master; on a cluster a folder of the driver is out of reach of the
    executors, so there the missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="logweave-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique table location in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/logweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> bool:
    """Deletes all tables that this application has written by ``scratch_path``: call it at the end, when
    no DataFrame over them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/logweave/{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable (reliable, shared storage)."""
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(base, "rdd"))
    return base


def written(df, name: str, compression: str | None = None, **options: str):
    """``df`` as a Parquet table in the shared folder, read again: cuts the
    lineage, survives lost executors, and later scans prune and push down."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logweave`` importable in every Python worker (pandas UDFs,
    ``mapInPandas``, ``applyInPandas`` pickle functions by module reference).

    The runtime equivalent of ``spark-submit --py-files``: the package is
    zipped once per application on the driver and registered with
    ``addPyFile``; Spark's file server hands it to every executor.
    """
    import zipfile

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - no JVM context: ship with --py-files instead
        return
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="logweave-pyfiles-"), "logweave.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
