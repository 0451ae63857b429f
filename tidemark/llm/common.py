"""Helpers shared by the corpus operators: shared storage, lineage cuts, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that separate words, for regular expressions of Java and Python alike.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach: spark.checkpoint.dir.

    Only where the session has none and driver and executors are one process (a local master, as in tests) a
    temporary folder is set; on a cluster without that setting an error says so.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder from now on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder in the shared folder that nobody else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _with_least(edges: DataFrame, salts: int) -> DataFrame:
    """edges (a, b) with the smallest b of each a as m.

    The neighbours of one node may be a third of all rows, so they are dealt by a salt of b: each (a, salt) gives its
    own minimum, those of a node meet in a window of at most `salts` rows, and the edges fetch theirs by (a, salt).
    """
    salted = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(salts)))
    heads = salted.groupBy("a", "s").agg(F.min("b").alias("m")).withColumn("m", F.min("m").over(W.partitionBy("a")))
    return salted.join(heads, ["a", "s"]).select("a", "b", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: columns a and b of one orderable type. Returns (node, component), the component being
    the smallest node, for every node that has an edge to another node. Loops, repeated edges and
    nulls are ignored; without edges the result is empty. Every round reads and writes the edge
    list a few times by key; nothing is collected but a count and a checksum. A node's edges are dealt by about the square
    root of all edges, so no task holds those of a hub. The number of rounds grows
    with the logarithm of the longest path.
    """
    e = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    seen, n = None, e.count()
    for _ in range(max_rounds):
        salts = math.isqrt(n) + 1
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, salts).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large, salts)
        e = cut(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    labels = e.groupBy("a").agg(F.min("b").alias("component"))
    return labels.select(F.col("a").alias("node"), "component").union(labels.select("component", F.col("component").alias("c")).distinct())
