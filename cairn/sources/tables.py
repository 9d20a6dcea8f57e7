"""Table access, the shared folder for written intermediates, and the few session settings the operators depend on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (one file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which every executor can reach.

    Only on one machine (master ``local``) a local one is set where the session names none; on a cluster that is an error,
    as each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one, in the folder of this application."""
    return f"{shared_base(spark)}/cairn-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the shared file system, if it is there."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes all intermediates that this application wrote. Results that were not read yet are lost."""
    delete(spark, f"{shared_base(spark)}/cairn-{spark.sparkContext.applicationId}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small ASCII file under a fresh name in the same folder and then renames it, so that it is there whole or not at all."""
    fs, p = _file_system(spark, path)
    _, part = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.writeBytes(text)
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, or None where there is none."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def epoch_us(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (read as UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))
