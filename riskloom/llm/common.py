"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own only where none is set and all
    work is done on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Statements in here give back the disk of their shuffles as soon as they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage, and
    a lost executor costs no recomputation."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._riskloom_path = path
    return out


def saved_apart(df: DataFrame, label: str, kind: Column, kinds: list[str]) -> dict[str, DataFrame]:
    """saved(), with a table for each kind, which can be dropped alone. kind is one of kinds."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.withColumn("_kind", kind).write.partitionBy("_kind").parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    found = {f.getPath().getName() for f in files.listStatus(at)}
    out = {}
    for k in kinds:
        own = f"{path}/_kind={k}"
        out[k] = df.sparkSession.read.schema(df.schema).parquet(own) if f"_kind={k}" in found else df.sparkSession.createDataFrame([], df.schema)
        out[k]._riskloom_path = own
    return out


def tidy() -> None:
    """At the end of a task: give free memory of a Python worker back, since the worker stays
    for the stages after this one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def dropped(df: DataFrame) -> None:
    """Delete a table made by saved() that no later plan reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._riskloom_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body, which may read it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def whole(text: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def where_last(df: DataFrame, kept: Column) -> DataFrame:
    """A filter that stays above what computes its columns. The optimizer would move a plain
    one below and work out those columns twice; it moves none past a rand() column."""
    return df.withColumn("_r", F.rand()).where(kept & (F.col("_r") < 2)).drop("_r")


def boxed(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns, and the whole row as _row: so no name of docs can clash with one of ours."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def unboxed(df: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of like out of _row, but for the new ones, in the types of like."""
    kinds = {f.name: f.dataType for f in like.schema}
    return df.select(*((new[c].cast(kinds[c]) if c in new else F.col("_row").getField(c)).alias(c) for c in like.columns))
