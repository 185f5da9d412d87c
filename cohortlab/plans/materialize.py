"""Write an intermediate result once and read it back.

Cuts lineage with a written Parquet table in the shared scratch folder
(``spark.checkpoint.dir``): later stages read it instead of re-running the
claim scans, and a lost executor costs a re-read, not a re-computation.
Partitioned on request, so a reader that wants one partition prunes the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from .session import scratch_path


class RunScratch:
    """The folder of one run under the scratch root; ``close`` deletes it.

    Close it when the run's results have been read or written elsewhere: the
    results are lazy and read the folder.
    """

    def __init__(self, spark: SparkSession, name: str = "run") -> None:
        self.spark, self.path, self.closed = spark, scratch_path(spark, name), False
        self.tables: list[str] = []

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"

    def close(self) -> None:
        if not self.closed:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete_folder(self.spark, self.path)
            self.closed = True

    def __enter__(self) -> RunScratch:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library in any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with named aggregates that the next write of it computes on the way."""
    obs = Observation(f"{name}_metrics_{uuid.uuid4().hex[:8]}")
    return df.observe(obs, *[e.alias(k) for k, e in metrics.items()]), obs


def materialize(
    df: DataFrame,
    name: str,
    partition_by: list[str] | None = None,
    observe: dict[str, Column] | None = None,
    scratch: RunScratch | None = None,
) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` once under the scratch folder (``scratch``: the run's own)
    and return it read back.

    ``observe``: named aggregate expressions computed by the same write job;
    when given, returns ``(df, metrics)``.
    """
    spark = df.sparkSession
    path = scratch.folder(name) if scratch else scratch_path(spark, name)
    obs = None
    if observe:
        df, obs = observed(df, name, observe)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # keep the producer's column order and types
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    return back if obs is None else (back, obs.get)


def materialize_bucketed(
    df: DataFrame,
    name: str,
    bucket_by: str,
    scratch: RunScratch,
    partition_by: list[str] | None = None,
    observe: dict[str, Column] | None = None,
) -> DataFrame | tuple[DataFrame, dict]:
    """Like ``materialize``, dealt by the hash of ``bucket_by`` into as many buckets as a
    shuffle has partitions: grouping and joining on it then needs no shuffle.

    Buckets are known to the catalog only, so this is a table of the run: external, in the
    scratch folder, dropped with it. One shuffle before the write gives each bucket one file.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns, obs = df.columns, None
    if observe:
        df, obs = observed(df, name, observe)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, bucket_by).write.format("parquet").option("path", scratch.folder(name))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    scratch.tables.append(table)
    writer.bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(table)
    back = spark.table(table).select(*columns)
    return back if obs is None else (back, obs.get)
