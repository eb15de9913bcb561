"""Helpers of iterative plans: each round ends in a reliable checkpoint, so that lineage stays short and a lost
executor costs no more than the round."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as a compressed table in the shared checkpoint folder. For results too large for
    ``cut``, whose files are not compressed. The table stays until the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


CHUNK = 500_000  # edges joined at once within a task


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v) edges from each node to the smallest node of its part, over CHUNK edges at a time."""

    def flush(up: dict) -> pd.DataFrame:
        rows = []
        for x in up:
            r = x
            while up[r] != r:
                r = up[r]
            if r != x:
                rows.append((x, r))
        return pd.DataFrame(rows, columns=["u", "v"])

    up: dict = {}
    n = 0
    for f in frames:
        for a, b in zip(f["u"].tolist(), f["v"].tolist()):
            while (x := up.setdefault(a, a)) != a:
                up[a] = up[x]
                a = x
            while (x := up.setdefault(b, b)) != b:
                up[b] = up[x]
                b = x
            if a != b:
                up[max(a, b)] = min(a, b)
        n += len(f)
        if n >= CHUNK:
            yield flush(up)
            up, n = {}, 0
    yield flush(up)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the undirected edges; component is the smallest node of its part.

    The edges of a task are joined within it first, by bounded chunks, which leaves at most an edge a node. Then
    alternating large-star and small-star rounds (Kiveris et al. 2014) until nothing changes: the number of edges never
    grows and the number of rounds is logarithmic in the longest path, also for one part that holds most nodes. Nulls
    and loops are no edges. An empty table gives an empty result."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    kind = dict(e.dtypes)["u"]
    e = cut(e)
    e = e.repartition(max(1, -(-e.count() // CHUNK)))  # whole chunks, so that few edges meet in one task
    e = cut(e.mapInPandas(_stars, f"u {kind}, v {kind}").distinct())
    before = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while before[0]:
        # large star: larger neighbours go to the smallest neighbour, itself included
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node go to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(small)
        # the sum of hashes changes with the edges; a round that keeps it has changed nothing
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
