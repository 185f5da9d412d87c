"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize

# A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in these bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under spark.checkpoint.dir and read back."""
    return materialize(df, name)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Words of a text as a long; a null text has none."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def unit_draw(seed: int, *columns: str) -> Column:
    """A double in (0, 1) that depends on the seed and the columns' values only."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def unit_draw_sql(seed: int, *columns: str) -> str:
    """The same draw in DuckDB."""
    key = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns]])
    return f"((CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / {float(2**52)!r})"


def ordered(df: DataFrame, keys: list[Column], name: str, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows dealt by range over ``keys``, sorted, written, with columns ``part``
    and ``row`` (place in its part), and the number of rows before each part.

    Only one number per part reaches the driver (``parts`` is set by the caller).
    """
    placed = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    )
    placed = written(placed, name)
    before, total = {}, 0
    for r in sorted(placed.groupBy("part").count().collect()):
        before[r["part"]] = total
        total += r["count"]
    return placed, before


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """A written table, marked for broadcast only if it has ``most_rows`` rows
    at most; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Few rows in each batch that goes to Python: rows can be long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

