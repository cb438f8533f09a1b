"""Reachability over small edge frames: impact, role closure, upstream dependencies."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def impact(edge: DataFrame, table: str, column: str | None = None, max_depth: int = 3) -> DataFrame:
    """Tables that depend on one, found by reversed edges breadth first: table_name, hop,
    confidence (the least along the path found first), via, bucket."""
    back = edge.select(F.col("dst_table").alias("at"), F.col("src_table").alias("dependent"), F.concat(F.col("src_table"), F.lit("."), F.col("src_column")).alias("link"), F.coalesce("confidence", F.lit(1.0)).alias("w"), "src_column")
    now = back.where(F.col("at") == table)
    if column is not None:
        now = now.where(F.col("src_column") == column)
    now = now.select(F.col("dependent").alias("table_name"), F.lit(1).alias("hop"), F.col("w").alias("confidence"), F.col("link").alias("via"))

    def first(x: DataFrame) -> DataFrame:
        order = Window.partitionBy("table_name").orderBy("hop", "via")
        return x.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

    found = [first(now)]
    for depth in range(2, max_depth + 1):
        seen = reduce(DataFrame.unionByName, found)
        last = found[-1]
        step = last.join(back, last["table_name"] == back["at"]).select(F.col("dependent").alias("table_name"), F.lit(depth).alias("hop"), F.least("confidence", "w").alias("confidence"), F.concat("via", F.lit(" > "), "link").alias("via"))
        found.append(first(step.join(seen.select("table_name"), "table_name", "left_anti")))
    every = reduce(DataFrame.unionByName, found)
    bucket = F.when(F.col("confidence") < 0.5, "low_confidence").when(F.col("hop") == 1, "direct").when(F.col("hop") == 2, "two_hop").when(F.col("hop") == 3, "three_hop")
    return every.select("table_name", "hop", "confidence", "via", bucket.alias("bucket"))


def reached(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """seed, node: each seed of seeds(seed) with itself and all that pairs (child, parent) lead
    to from it, however far. A frontier goes on only by what it had not reached, so a cycle
    ends and a lattice costs each pair once."""
    step = pairs.select(F.col("child").alias("node"), F.col("parent").alias("next")).where("child <> parent").distinct()
    every = seeds.select("seed", F.col("seed").alias("node")).distinct()
    front = every
    while True:
        front = front.join(step, "node").select("seed", F.col("next").alias("node")).distinct().join(every, ["seed", "node"], "left_anti")
        front = checkpointed(front)
        if not front.take(1):
            return every
        every = checkpointed(every.unionByName(front))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets its own; on a cluster
    that is an error, as executors would not see it."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written, not when the driver
    next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written out, with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written out as Parquet, which takes a fraction of a checkpoint's bytes; its lineage is cut
    and its shuffle files go."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/rows-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(pairs: DataFrame) -> DataFrame:
    """child, ancestor: the transitive closure of pairs (child, parent).

    Lengths double: what lies farther than 2^i steps and no farther than 2^(i+1) is reached from
    what lies at 2^i exactly by what lies at 2^i or less. So there are as many rounds as the
    longest way has binary digits, and each round's new pairs are written once."""
    step = pairs.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).where("child <> ancestor").distinct()
    parts, at = [checkpointed(step)], 1
    while True:
        every = reduce(DataFrame.unionByName, parts)
        far = parts[-1].where(F.col("steps") == at).select("child", F.col("ancestor").alias("by"))
        on = every.select(F.col("child").alias("by"), "ancestor", (F.col("steps") + at).alias("steps"))
        new = far.join(on, "by").where("child <> ancestor").groupBy("child", "ancestor").agg(F.min("steps").alias("steps"))
        new = checkpointed(new.join(every, ["child", "ancestor"], "left_anti"))
        if not new.take(1):
            return every.select("child", "ancestor")
        parts.append(new)
        at *= 2


def grants_of_roles(grants: DataFrame, memberships: DataFrame) -> DataFrame:
    """grantee, table_name: SELECT grants with those of all roles that a role belongs to;
    memberships(child, parent); PUBLIC is no grantee."""
    select = grants.where(F.upper("privilege") == "SELECT").select("grantee", "table_name")
    up = closure(memberships)
    inherited = up.join(select, up["ancestor"] == select["grantee"]).select(F.col("child").alias("grantee"), "table_name")
    return select.unionByName(inherited).where(F.upper("grantee") != "PUBLIC").distinct()


def allowed_patterns(grants: DataFrame) -> DataFrame:
    """grantee, patterns: the sorted table names of each grantee."""
    return grants.groupBy("grantee").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("patterns"))
