"""Tables in the folder that driver and executors share: they cut the lineage
and survive lost executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; chosen here only where it is unset
    and the session runs on one machine (a cluster must name a shared folder)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file:///tmp/checkpoints/treelens-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet and read back."""
    spark = df.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/g-{uuid.uuid4().hex}"
        _written.append((spark, path))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Delete what is under path when the process ends."""
    _written.append((spark, path))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the session sees them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str, done: bool = False) -> list[str]:
    """Names of the folders in a folder; done: of completely written ones."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [f.getName() for f in found if not done or fs.exists(child(f, "_SUCCESS"))]


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def drop_materialized() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended
            pass


atexit.register(drop_materialized)
