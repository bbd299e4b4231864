"""Session construction and shared scratch locations."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings every sightline job relies on. Time zone is pinned so that date
# truncation and text-to-timestamp parsing do not depend on the machine.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "sightline",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with sightline's defaults.

    Settings the cluster already gives (spark-submit, spark-defaults) win
    over sightline's defaults; explicit arguments win over both. On a
    cluster leave ``master`` unset and size ``shuffle_partitions`` to the data
    (roughly shuffled bytes / 128 MiB, AQE coalesces); locally use the cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = SparkConf()
    conf = {k: v for k, v in DEFAULT_CONF.items() if not given.contains(k)}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a private folder (registered,
    so that later jobs agree on it). On a cluster every executor would write
    to a folder of its own, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="sightline-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders through the file system that holds them."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


_owned: set[str] = set()


def _application_scratch(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/sightline/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Called when the
    process ends; frames that read scratch tables are unusable afterwards."""
    delete_path(spark, _application_scratch(spark))


def _drop_at_exit(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        drop_scratch(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path in this application's part of the shared
    checkpoint folder (removed when the process ends, or by its owner)."""
    root = _application_scratch(spark)
    if root not in _owned:
        _owned.add(root)
        atexit.register(_drop_at_exit, spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now: they
    are freed when the driver's references to them are collected."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Owner of written intermediates: deletes them when it is closed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` once and return it re-read."""
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        delete_path(self.spark, *self.paths)
        self.paths.clear()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def broadcast_rows(spark: SparkSession, row_bytes: int, share: float = 0.05) -> int:
    """How many rows of ``row_bytes`` (as a hash relation) fit into ``share``
    of an executor's heap: the measured bound under which a side may be
    broadcast."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    text = (conf.get("spark.driver.memory" if local and "local-cluster" not in spark.sparkContext.master
                     else "spark.executor.memory", "1g")).lower()
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", text).groups()
    heap = int(number) * _UNITS.get(unit, 1 << 20)
    return max(1, int(heap * share / row_bytes))
