"""Intermediate tables written once to shared storage.

A pinned table cuts lineage, is read back after an executor is lost, and tells the planner its
true size, so Spark itself decides whether a join against it may broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
# Folders of bucketed tables, and the names by which the catalog knows them.
_bucketed: dict[str, str] = {}
_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_folder(spark: SparkSession) -> str:
    """Folder for pinned tables: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to storage that every executor can reach")
        app = spark.conf.get("spark.app.id")
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="panelweave-")
            atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
        folder = _local_folders[app]
    return f"{folder.rstrip('/')}/panelweave-{spark.conf.get('spark.app.id')}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables pinned inside, and no others, at the end. Store or count results before that."""
    name = f"scope-{uuid.uuid4().hex}"
    outer = _scope.set(f"{_scope.get()}/{name}")
    try:
        yield
    finally:
        folder = shared_folder(spark) + _scope.get()
        _scope.reset(outer)
        _delete(spark, folder)


def pin(df: DataFrame, label: str = "t", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table. Partition only by columns with few values."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}{_scope.get()}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin_bucketed(
    df: DataFrame, by: Sequence[str], order: Sequence[str] = (), buckets: int | None = None, label: str = "panel"
) -> DataFrame:
    """Like :func:`pin`, in ``buckets`` by the hash of ``by``, each file sorted by ``by`` and ``order``.

    The catalog keeps the layout: windows over ``by``, groups by ``by`` or more, and joins on exactly ``by`` need no
    exchange of the rows. Rows that are not partitioned by the same hash and number beforehand make one file for each
    task and bucket. ``buckets`` defaults to ``spark.sql.shuffle.partitions``; joins without an exchange need the same
    number on both sides.
    """
    spark = df.sparkSession
    buckets = buckets or default_buckets(spark)
    unique = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}{_scope.get()}/{unique}"
    writer = df.write.format("parquet").bucketBy(buckets, *by).sortBy(*by, *order)
    writer.option("path", path).saveAsTable(f"panelweave_{unique}")
    _bucketed[path] = f"panelweave_{unique}"
    return spark.table(_bucketed[path])


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, name: str | None = None, persist: bool = False) -> DataFrame:
    """Snapshot ``df`` for later statements, optionally as the temporary view ``name``.

    ``persist=True`` keeps the rows in executor storage; otherwise they are written to the shared
    folder, which also survives the loss of executors.
    """
    snapshot = df.persist() if persist else pin(df, name or "snapshot")
    if name:
        snapshot.createOrReplaceTempView(name)
    return snapshot


def drop_materialized(spark: SparkSession, *names: str) -> None:
    """Drop temporary views, ignoring those that do not exist; persisted rows are freed."""
    for name in names:
        if spark.catalog.tableExists(name):
            spark.table(name).unpersist()
        spark.catalog.dropTempView(name)


def release(spark: SparkSession) -> None:
    """Delete every table this application pinned. Call only when no result needs them any more."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    for path in [path for path in _bucketed if path.startswith(f"{folder}/")]:
        spark.sql(f"DROP TABLE IF EXISTS {_bucketed.pop(path)}")
    # Spark's Python side has no call to delete files on the cluster's storage.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
