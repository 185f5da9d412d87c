"""One catalog table at a time: create, append, replace one scenario; audit, preview.

Tables are partitioned by ``scenario``: reading one scenario prunes the rest, and
``replace`` overwrites exactly the named partition. Appends go by column *name*
with names and types checked first, where the reference inserted by position. A
created table takes its name when its data is complete. A run's tables
together are published by ``operators.result_store``.

A partition value can't be the empty string (it reads back as NULL), so a row that
has one ends the write.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import delete_folder


class SchemaMismatch(ValueError):
    pass


def ensure_database(spark: SparkSession, database: str, location: str | None = None, use: bool = True) -> None:
    """CREATE DATABASE IF NOT EXISTS, then (by default) make it current."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{loc}")
    if use:
        spark.catalog.setCurrentDatabase(database)


def table_exists(spark: SparkSession, table: str) -> bool:
    """Catalog lookup; errors propagate (an error is not "missing")."""
    return spark.catalog.tableExists(table)


def check_schema(df: DataFrame, target: T.StructType, table: str) -> DataFrame:
    """``df`` in the table's column order; names and types must be the table's."""
    names = [f.name for f in target.fields]
    missing = [n for n in names if n not in df.columns]
    extra = [c for c in df.columns if c not in names]
    other = [
        f"{f.name}: {df.schema[f.name].dataType.simpleString()} for {f.dataType.simpleString()}"
        for f in target.fields
        if f.name in df.columns and df.schema[f.name].dataType != f.dataType
    ]
    if missing or extra or other:
        raise SchemaMismatch(f"{table}: missing {missing}, unexpected {extra}, other types {other}")
    return df.select(*names)


def _check_schema(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    return check_schema(df, spark.table(table).schema, table)


def _named(df: DataFrame, partition_by: tuple[str, ...] | list[str]) -> DataFrame:
    """``df`` that fails on an empty string in a partition column."""
    for c in partition_by:
        if c in df.columns and df.schema[c].dataType == T.StringType():
            empty = F.raise_error(F.lit(f"{c} is the empty string, which can't name a partition")).cast("string")
            df = df.withColumn(c, F.when(F.col(c) == "", empty).otherwise(F.col(c)))
    return df


def _staged_name(table: str) -> str:
    return f"{table}__next"


def _former_name(table: str) -> str:
    return f"{table}__former"


def recover(spark: SparkSession, table: str) -> None:
    """Finish or undo a ``create`` that died between its steps. A staged table is in
    the catalog only when its data is complete."""
    staged, former = _staged_name(table), _former_name(table)
    if not table_exists(spark, table):
        if table_exists(spark, staged):
            spark.sql(f"ALTER TABLE {_quoted(staged)} RENAME TO {_quoted(table)}")
        elif table_exists(spark, former):
            spark.sql(f"ALTER TABLE {_quoted(former)} RENAME TO {_quoted(table)}")
    for left in (staged, former):
        _drop(spark, left)


def _drop(spark: SparkSession, table: str) -> None:
    """Drop a table, and its folder if ``_create`` made it (the catalog leaves those)."""
    if not table_exists(spark, table):
        return
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(table)}").collect()}
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(table)}")
    folder = facts.get("Location", "")
    if facts.get("Type") == "EXTERNAL" and re.fullmatch(r".*-data-[0-9a-f]{12}", folder):
        delete_folder(spark, folder)


def _new_folder(spark: SparkSession, table: str, path: str | None) -> str:
    """A folder of its own for a table's data: renaming the table then moves nothing, and
    partitions keep their places."""
    *database, name = table.split(".")
    if not path:
        path = spark.catalog.getDatabase(database[-1] if database else spark.catalog.currentDatabase()).locationUri
    return f"{path.rstrip('/')}/{name}-data-{uuid.uuid4().hex[:12]}"


def _quoted(table: str) -> str:
    return ".".join(f"`{x}`" for x in table.split("."))


def _create(df: DataFrame, table: str, partition_by: tuple[str, ...], path: str | None) -> None:
    """Write the successor under another name and folder, then swap the names: the
    table is dropped only after its successor is complete."""
    spark = df.sparkSession
    recover(spark, table)
    staged, former = _staged_name(table), _former_name(table)
    w = _named(df, partition_by).write.format("parquet").partitionBy(*partition_by)
    w.option("path", _new_folder(spark, table, path)).saveAsTable(staged)
    if table_exists(spark, table):
        spark.sql(f"ALTER TABLE {_quoted(table)} RENAME TO {_quoted(former)}")
    spark.sql(f"ALTER TABLE {_quoted(staged)} RENAME TO {_quoted(table)}")
    _drop(spark, former)


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_result(
    df: DataFrame,
    table: str,
    mode: str = "create",
    partition_by: tuple[str, ...] = ("scenario",),
    path: str | None = None,
    partition: dict[str, str] | None = None,
) -> None:
    """``create``: create or replace the table; ``append``: add rows by name;
    ``replace``: overwrite one ``partition`` of the table, named by values of
    its first partition columns (e.g. ``{"scenario": "S"}``), with the rows of
    ``df``, all of which must belong to it. An empty ``df`` empties it.

    A created table is external, with its data in a folder of its own below ``path`` (a
    shared folder), or below the database's location.
    """
    spark = df.sparkSession
    if mode in ("append", "replace"):
        recover(spark, table)
    if mode == "create":
        _create(df, table, partition_by, path)
    elif mode == "append":
        # aligned by name first, so the positional insert is safe
        _named(_check_schema(spark, df, table), partition_by).write.insertInto(table, overwrite=False)
    elif mode == "replace":
        if not partition:
            raise ValueError("replace needs the partition to overwrite")
        if "" in partition.values():
            raise ValueError("the empty string can't name a partition")
        if not table_exists(spark, table):
            return write_result(df, table, "create", partition_by, path)
        aligned = _check_schema(spark, df, table)
        values = ", ".join(f"`{k}` = {_literal(v)}" for k, v in partition.items())
        name = "_" + uuid.uuid4().hex
        aligned.drop(*partition).createOrReplaceTempView(name)
        try:
            # static for the named columns: the partition is emptied also when no row comes in
            spark.sql(f"INSERT OVERWRITE TABLE {_quoted(table)} PARTITION ({values}) SELECT * FROM {name}")
        finally:
            spark.catalog.dropTempView(name)
    else:
        raise ValueError(f"unknown write mode {mode!r}")


def create_or_append(df: DataFrame, table: str, path: str | None = None) -> str:
    """Append when the table exists, else create it. Returns the mode used."""
    recover(df.sparkSession, table)
    mode = "append" if table_exists(df.sparkSession, table) else "create"
    write_result(df, table, mode, path=path)
    return mode


def audit_counts(spark: SparkSession, tables: list[str] | dict[str, DataFrame]) -> DataFrame:
    """Row count per result table, as one small DataFrame."""
    frames = tables if isinstance(tables, dict) else {t: spark.table(t) for t in tables}
    parts = [
        df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        for name, df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def preview_frame(df: DataFrame, n: int = 1) -> DataFrame:
    """First ``n`` rows in a total order (all columns), so it is repeatable."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in df.columns]).limit(n)


def preview(df: DataFrame, n: int = 1) -> list[dict]:
    """The preview as records (column name to value)."""
    return [r.asDict() for r in preview_frame(df, n).collect()]
