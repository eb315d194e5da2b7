"""Tables in the shared folder, and consecutive numbers over a sorted table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir.

    The setting is read from the session.  Only a local session without one gets a temporary folder (tests);
    a cluster without a shared folder is refused, as executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), *, group_mb: int | None = None) -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends here, and lost executors don't cost the work again.

    group_mb bounds row groups, and so the batches of Spark's reader, which otherwise have 4,096 rows however long these are.
    """
    writer = df.write.mode("overwrite")
    if group_mb:
        writer = writer.option("parquet.block.size", group_mb << 20)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files make fewer than two tasks for each; larger tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < 2 * n else df


def consecutive_ids(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """df with 0, 1, 2, ... in the given order, by a range sort and one offset for each partition; no task gets all rows."""
    spark = df.sparkSession
    rows = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), workspace(spark, "ids"))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    table = F.broadcast(spark.createDataFrame(offsets, "_p long, _offset long"))  # a row per partition
    joined = rows.join(table, part == F.col("_p"))
    return joined.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_offset")
