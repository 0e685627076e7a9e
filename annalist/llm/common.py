"""Shared by the operators: input tables, and tables written in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the columns of row_key.
KEYS = ["_annalist_k1", "_annalist_k2"]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: Arrow batches of at most so many rows keep Python workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, that the driver and all executors share.

    Where the setting is absent (local mode, tests), a folder is made once per session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths made while a settled() table or a stage is built.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/annalist/{tag}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def swept(spark: SparkSession):
    """Removes every path that was made inside; for work whose result has been written elsewhere by the end."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
    for path in made:
        remove(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What build() returns, materialized; the tables made on the way are removed."""
    path = scratch(spark, tag)
    with swept(spark):
        df = build()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back: lineage ends here."""
    path = scratch(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ours in the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or local path."""
    from pyarrow import fs

    if not path.startswith("file:///") and path.startswith("file:/"):
        path = "file://" + path.removeprefix("file:").replace("//", "/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def row_key(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two columns that tell different rows apart (128 bits of a hash of all columns, or of those named).

    They depend on a row's content alone, so a lost task finds them again whatever order its input comes in.
    """
    kept = [f for f in df.schema if columns is None or f.name in columns]
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in kept]
    nulls = F.concat(F.lit(""), *(F.when(v.isNull(), "0").otherwise("1") for v in values))
    return [F.xxhash64(nulls, *values).alias(KEYS[0]), F.xxhash64(*reversed(values), F.lit("annalist"), nulls).alias(KEYS[1])]
