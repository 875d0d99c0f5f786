"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local folder will do only if all runs in one process; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> None:
    """Have what lies at path deleted when the application ends: frames that read it may be used until then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def dealt_over(spark: SparkSession) -> int:
    """Into how many parts rows are dealt whose work is out of proportion to their size, as which adaptive execution would join them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table read back: its lineage ends here and a lost executor does not repeat it. It is gone when the application ends, or by discard()."""
    path = f"{shared_dir(df.sparkSession)}/pathloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that a join may send to all executors, where the size of its files does not tell what they come to.
SENT = 50_000


def unsent(df: DataFrame) -> DataFrame:
    """df, which no join sends whole to the driver and all executors if it has more than SENT rows. For tables of values that repeat: Spark goes by the
    size of the files, and these may hold a hundred times as much."""
    return df.hint("merge") if df.limit(SENT + 1).count() > SENT else df


def values_at(rows: DataFrame, column: str, ranks: list[int]) -> list:
    """The values of column at these ranks, from 0, in ascending order, nulls first. Different values are counted and dealt by ranges, so that no task holds all."""
    counted = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).repartitionByRange(dealt_over(rows.sparkSession), "v")
    at = written(counted.withColumn("part", F.spark_partition_id()), "ranked")
    sizes, found = sorted((r.part, r.n) for r in at.groupBy("part").agg(F.sum("n").alias("n")).collect()), []
    for rank in ranks:
        for part, n in sizes:
            if rank < n:
                break
            rank -= n
        upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # one range
        found.append(at.where(F.col("part") == part).select("v", upto.alias("upto")).where(F.col("upto") > rank).orderBy("upto").first()["v"])
    discard(at)
    return found


class Parts:
    """A table that grows by parts of one schema, each written once, and is read as one scan over all of them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.schema = spark, f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}", None
        self.paths: list[str] = []

    def add(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, object]]:
        """Write df as the next part: (the part read back, aggregates over it, taken while it is written)."""
        path = f"{self.base}/{len(self.paths)}"
        seen = Observation()
        (df.observe(seen, *[m.alias(n) for n, m in measures.items()]) if measures else df).write.parquet(path)
        until_exit(self.spark, path)
        self.schema = self.schema or df.schema
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path), seen.get if measures else {}

    def read(self) -> DataFrame:
        """All parts; at least one must have been added."""
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by written()."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver does. Where executors do not share that folder,
    submit the package with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root
