"""Spark session helpers.

Settings are the ones a batch job at scale needs: AQE (coalesce, skew join),
a bounded broadcast threshold, Arrow for the few pandas-backed operators and
UTC session time.  On a cluster the session already exists and these
defaults are only filled in where the cluster left them unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Broadcast only sides Catalyst knows to be small; 64 MiB keeps every
# executor's copy bounded no matter how large the probe side grows.
BROADCAST_LIMIT = str(64 * 1024 * 1024)

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": BROADCAST_LIMIT,
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_KEPT: list = []


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "typeahead") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:  # a session that exists keeps its settings
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TYPEAHEAD_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this to shared storage; only a local session that has neither
    the setting nor a checkpoint folder gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="typeahead-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def reuse(df):
    """Keep a DataFrame that several later stages read (memory, spilling to disk).

    A lost executor only recomputes its own partitions from lineage.
    """
    from pyspark import StorageLevel
    _KEPT.append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release() -> None:
    """Unpersist what ``reuse`` has kept so far; other cached tables stay."""
    while _KEPT:
        df = _KEPT.pop()
        if df.sparkSession.sparkContext._jsc is not None:  # its session still runs
            df.unpersist()


def cut(df):
    """Write a stage result as Parquet under the shared checkpoint folder and continue from
    it: later stages (and recovery after a lost executor) read the written table instead of
    replaying the lineage, columns not needed are not read, and joins are planned by its size.
    The folder goes when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"stage-{uuid.uuid4().hex}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHARED: dict = {}


def _state(spark, path: str) -> tuple:
    """Names, sizes and change times of the files of an input table."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def shared(spark, name: str, inputs: list[str], build):
    """What ``build`` returns, made once per application, name and state of the input files.

    For written stage tables (see ``cut``) that several queries read."""
    key = (spark.sparkContext.applicationId, name, tuple(_state(spark, p) for p in inputs))
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]
