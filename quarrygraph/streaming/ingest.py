"""Incremental ingest: batches of new rows merged into a table by key, the newest row of a key kept.

Rows lie in buckets by the hash of their key. A batch reads and writes again only the buckets it touches, into a new
folder, and then adds a manifest that names the folder of every bucket. A manifest is written beside its place and
renamed into it, which is one step, so a reader finds either the table before the batch or the one after it, also when
the writer dies in between. A batch that is run again leaves the same table, as merging is idempotent; of two writers at
once the second fails. Folders and manifests that nothing names any more are left to ``vacuum``."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT
from pyspark.sql.streaming import StreamingQuery

from ..operators.codegraph import newest

BUCKETS = 64
_BUCKET = "bucket__"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the last manifest; (0, {}) before the first batch."""
    folder, fs = _fs(spark, f"{path}/_manifests")
    if not fs.exists(folder):
        return 0, {}
    numbers = [int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    last = max(numbers)
    text = "".join(r[0] for r in spark.read.text(f"{path}/_manifests/{last:012d}").collect())
    return last, json.loads(text)


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    part, fs = _fs(spark, f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    goal, _ = _fs(spark, f"{path}/_manifests/{number:012d}")
    if fs.exists(goal) or not fs.rename(part, goal):
        fs.delete(part, False)
        raise RuntimeError(f"another writer has published batch {number} of {path}")


def read_merged(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The table as of the last whole batch, or some of its buckets; None before the first batch."""
    _, content = _manifest(spark, path)
    named = [f"{path}/{folder}/{_BUCKET}={b}" for b, folder in content.get("folders", {}).items() if buckets is None or int(b) in buckets]
    if not content:
        return None
    schema = TT.StructType.fromJson(content["schema"])
    return spark.read.schema(schema).parquet(*named) if named else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Merges one batch; rows of the same key are decided by the order columns, later wins."""
    spark = batch.sparkSession
    number, content = _manifest(spark, path)
    n = content.get("buckets", buckets)
    tag = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    touched = [r[0] for r in batch.select(tag.alias("b")).distinct().collect()]  # at most n
    if not touched and content:
        return
    old = read_merged(spark, path, touched)
    both = batch if old is None else old.unionByName(batch)
    folder = f"data-{number + 1:012d}-{uuid.uuid4().hex}"
    newest(both, keys, order).withColumn(_BUCKET, tag).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    folders = content.get("folders", {}) | {str(b): folder for b in touched}
    _publish(spark, path, number + 1, {"batch": batch_id, "buckets": n, "folders": folders, "schema": both.schema.jsonValue()})


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes the folders and manifests that the last manifest does not need; for when nobody reads an older one."""
    last, content = _manifest(spark, path)
    keep = set(content.get("folders", {}).values())
    root, fs = _fs(spark, path)
    for x in fs.listStatus(root) if last else []:
        if x.getPath().getName().startswith("data-") and x.getPath().getName() not in keep:
            fs.delete(x.getPath(), True)
    for x in fs.listStatus(_fs(spark, f"{path}/_manifests")[0]) if last else []:
        if x.getPath().getName() != f"{last:012d}":
            fs.delete(x.getPath(), True)


def ingest_stream(spark: SparkSession, source: str, schema: TT.StructType, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Reads Parquet files as they appear below ``source`` and merges each micro-batch into the table at ``path``; ends when
    all present files are in."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
