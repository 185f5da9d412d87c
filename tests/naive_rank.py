"""Ranking of all submissions: the test oracle for ``latest_scenario``, which is
a top-1 and ranks nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_scenarios(config: DataFrame) -> DataFrame:
    """Dense rank of the submission times, newest = 1, per config row.

    An undated scenario sorts last. The ranking window runs over the
    *distinct* submission times only (one row per submission), and the rank
    is joined back on the time; ``latest_scenario`` needs no ranking at all.
    """
    w = Window.orderBy(F.col("_t").desc_nulls_last())
    ranks = (
        config.select(F.col("submitted_at").alias("_t")).distinct()
        .select("_t", F.dense_rank().over(w).alias("rnk"))
    )
    return (
        config.select("scenario", "submitted_at")
        .join(ranks, F.col("submitted_at").eqNullSafe(F.col("_t")))
        .select("scenario", "submitted_at", "rnk")
    )
