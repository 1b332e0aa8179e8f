"""Tables in a folder that change in steps: a manifest names the files of the current state.

A change writes new files beside the old ones, then a manifest with the next number; readers take
the highest. A job that ends before its manifest leaves the old state, and what it wrote is never
read. Two writers of the same number: the second fails at its manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def manifest(spark: SparkSession, root: str) -> dict:
    """What the current manifest says, with its number; number 0: there is none."""
    files, at = _folder(spark, root)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    last = max((n for n in names if n.startswith("manifest-")), default=None)
    if last is None:
        return {"number": 0}
    return json.loads(spark.read.text(f"{root}/{last}", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, before: dict, **said) -> None:
    """The next manifest: written aside, then named; it never replaces one."""
    number = before["number"] + 1
    files, aside = _folder(spark, f"{root}/aside-{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(said | {"number": number}).encode()))
    out.close()
    named = _folder(spark, f"{root}/manifest-{number:012d}.json")[1]
    if files.exists(named) or not files.rename(aside, named):
        files.delete(aside, False)
        raise RuntimeError(f"state {number} of {root} was written by another job")


# A table in hash buckets: a change rewrites the buckets that it touches.
def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _write_buckets(df: DataFrame, root: str, key: str, n: int) -> tuple[str, list[int]]:
    folder = f"data-{uuid.uuid4().hex}"
    rows = df.withColumn("_bucket", _bucket(key, n))
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    files, at = _folder(df.sparkSession, f"{root}/{folder}")
    return folder, [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at) if "=" in f.getPath().getName()]


def create(df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> None:
    folder, held = _write_buckets(df, root, key, buckets)
    publish(df.sparkSession, root, {"number": 0}, key=key, buckets=buckets, schema=df.schema.json(), paths={str(b): folder for b in held})


def _read_buckets(spark: SparkSession, root: str, state: dict, wanted: set[int] | None = None) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType.fromJson(json.loads(state["schema"]))
    paths = [f"{root}/{folder}/_bucket={b}" for b, folder in state["paths"].items() if wanted is None or int(b) in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    return _read_buckets(spark, root, manifest(spark, root))


def upsert(incoming: DataFrame, root: str, merge: Callable[[DataFrame, DataFrame, str], DataFrame]) -> list[int]:
    """Rewrite the buckets that hold keys of incoming as merge(current, incoming, key) and return
    their numbers; the files of all other buckets stay as they are."""
    spark = incoming.sparkSession
    state = manifest(spark, root)
    key, n = state["key"], state["buckets"]
    touched = {r[0] for r in incoming.select(_bucket(key, n)).distinct().collect()}  # n at most
    merged = merge(_read_buckets(spark, root, state, touched), incoming, key)
    folder, held = _write_buckets(merged, root, key, n)
    paths = {b: f for b, f in state["paths"].items() if int(b) not in touched} | {str(b): folder for b in held}
    publish(spark, root, state, key=key, buckets=n, schema=state["schema"], paths=paths)
    return sorted(touched)


# Deltas of a stream by batch id, folded into a snapshot now and then.
def add_delta(df: DataFrame, root: str, batch: int) -> None:
    """The delta of a batch. A batch that is run again replaces its own; one that the snapshot
    holds already is left alone."""
    if batch > manifest(df.sparkSession, root).get("upto", -1):
        df.write.mode("overwrite").parquet(f"{root}/deltas/batch={batch}")


def read_folded(spark: SparkSession, root: str, schema: str, fold: Callable[[DataFrame], DataFrame], upto: int | None = None) -> DataFrame:
    """The snapshot and the deltas after it (up to batch upto), folded. fold: associative; it
    takes and gives columns of schema."""
    state = manifest(spark, root)
    files, at = _folder(spark, f"{root}/deltas")
    ids = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at)] if files.exists(at) else []
    new = [f"{root}/deltas/batch={b}" for b in ids if b > state.get("upto", -1) and (upto is None or b <= upto)]
    paths = ([f"{root}/{state['snapshot']}"] if "snapshot" in state else []) + new
    return fold(spark.read.schema(schema).parquet(*paths)) if paths else spark.createDataFrame([], schema)


def fold_deltas(spark: SparkSession, root: str, schema: str, fold: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """A new snapshot that holds all batches up to upto; their deltas are deleted after its manifest."""
    state = manifest(spark, root)
    if upto <= state.get("upto", -1):
        return
    folder = f"snapshot-{uuid.uuid4().hex}"
    read_folded(spark, root, schema, fold, upto).write.parquet(f"{root}/{folder}")
    publish(spark, root, state, snapshot=folder, upto=upto)
    files, at = _folder(spark, f"{root}/deltas")
    for f in files.listStatus(at) if files.exists(at) else []:
        if int(f.getPath().getName().split("=")[1]) <= upto:
            files.delete(f.getPath(), True)
