"""Readers and writers, and the shared folder for tables between the steps of a job."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_card_csv(spark: SparkSession, transactions: str, identity: str, tx_schema: T.StructType, id_schema: T.StructType, key: str = "TransactionID") -> DataFrame:
    """Two CSV scans with given schemas, joined on the key; empty fields are NULL."""
    read = lambda path, schema: spark.read.schema(schema).csv(path, header=True, nanValue="", mode="PERMISSIVE")
    return read(transactions, tx_schema).join(read(identity, id_schema), key, "left")


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def append_labels(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_importances(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A folder of our own only where it is unset and all work is done on
    this machine, as in tests."""
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


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: no lineage, one computation, and the disk of
    its shuffles is free again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._riskloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._riskloom_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bucketed(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """df as stored(), in as many buckets of keys as a shuffle has partitions, one file each: a
    join or grouping on keys reads it without an exchange, however often."""
    spark = df.sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}".replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{name}"
    with shuffles_freed(spark):
        df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalogue forgets it; the files stay, as those of stored()
    return out
