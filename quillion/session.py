"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders of applications with a local master and no setting.
_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    out = Path(os.path.realpath(tempfile.mkdtemp())) / f"{top.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over the cores, whatever its rows hold, if it comes from fewer files than there are cores.

    A file may be one row group, which one task reads whole; work of
    milliseconds a row is worth the exchange then. Tables of many files stay
    where they lie. Rows go round-robin after a sort within their task, so a
    task that runs again deals them out the same way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df._jdf.inputFiles()) < cores else df


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, whose executors live in the driver, may do without
    that setting; it gets a folder of its own, one for an application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir, before the session starts, to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = Path(tempfile.mkdtemp(prefix="quillion-")).as_uri()
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quillion/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = 1 << 23) -> Iterator[None]:
    """Jobs inside hand rows to Python in batches of about ``most`` bytes; the session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, name: str, paths: list[str] | None = None, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs nothing that was written. Returns the new frame and
    its path, which the caller may delete once nothing reads it any more;
    ``paths``, if given, has it from before the first row is written.
    ``compression`` is the session's unless given.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path
