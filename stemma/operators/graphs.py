"""Connected components as DataFrames, and the checkpoints that iteration needs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of keys are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of our own where it is unset in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="stemma-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written as columns in the shared folder and read from there: for many rows of which each reader needs few columns."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if a count proves that it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """node, component of each node of the edges (a, b), which are strings; component is the smallest node reachable.

    Every round a node takes of its neighbours and itself the one that comes first by a hash, and
    then, twice, what that one took. Hashes leave no long falling chains, so most of those taken
    are alike; edges go on between them, once each, and a round costs a part of the one before.
    """
    left = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    taken = []
    while True:
        order = lambda x: F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("x"))
        near = left.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.first(order("a")))["x"].alias("label"))
        near = checkpoint(near)
        above = lambda frame: frame.join(near.toDF("label", "above"), "label").select("node", F.col("above").alias("label"))
        jumped = checkpoint(above(above(near)))
        taken.append(jumped)
        at = lambda end: jumped.toDF(end, f"_{end}")
        left = checkpoint(left.join(at("a"), "a").join(at("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        if left.isEmpty():
            break
    found = taken[0]
    for more in taken[1:]:
        found = found.join(more.toDF("label", "_on"), "label", "left").select("node", F.coalesce("_on", "label").alias("label"))
    found = checkpoint(found)
    name = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(name, "label").select("node", "component")
