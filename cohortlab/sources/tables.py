"""Scans: claim channels, patients, scenario config, stored results.

A source is either a catalog table name or a Parquet path. Every scan selects
only the logical columns and casts them once, so Catalyst prunes the read
schema and pushes later filters into the Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SOURCE_TAGS, ScenarioConfigError
from .schemas import CHANNEL_SCHEMA, OPAQUE, PATIENT_SCHEMA, config_schema


def _load(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if "/" in source or source.endswith(".parquet"):
        return spark.read.parquet(source)
    return spark.table(source)


def conform(df: DataFrame, schema: T.StructType, rename: dict[str, str] | None = None) -> DataFrame:
    """Select ``schema``'s columns, cast to its types; ids keep their own type.

    ``rename``: logical column -> stored column, where the names differ.
    """
    rename = rename or {}
    cols = []
    for f in schema.fields:
        stored = F.col(rename.get(f.name, f.name))
        cols.append((stored if f.name in OPAQUE else stored.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def read_channel(spark: SparkSession, source: str | DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """One claim channel as ``(patient_id, service_date, claim_id, code)``.

    ``service_date`` is cast to DATE here, so an inclusive window keeps the
    whole last day even when the stored column is a timestamp.
    """
    return conform(_load(spark, source), CHANNEL_SCHEMA, rename)


def read_patients(spark: SparkSession, source: str | DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Patient reference ``(patient_id, gender, state, birth_year)``.

    Rows that repeat a patient exactly are collapsed by the criterion.
    """
    return conform(_load(spark, source), PATIENT_SCHEMA, rename)


def criteria_in(columns: list[str]) -> int:
    """Number of criteria of a wide config table, from its columns."""
    nums = sorted(int(m.group(1)) for c in columns if (m := re.fullmatch(r"c(\d+)_code", c)))
    if nums != list(range(1, len(nums) + 1)):
        raise ScenarioConfigError(f"criteria must be numbered 1 to N; the config has code columns for {nums}")
    return len(nums)


def read_config(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Scenario config, wide form (one row per code tuple), any number of criteria.

    A criterion or pair column that no criterion would read is an error: it
    is a setting that would be ignored.
    """
    df = _load(spark, source)
    schema = config_schema(criteria_in(df.columns))
    unread = [c for c in df.columns if re.match(r"c\d", c) and c not in schema.fieldNames()]
    missing = [c for c in schema.fieldNames() if c not in df.columns]
    if unread or missing:
        raise ScenarioConfigError(f"config columns not understood: {unread}; missing: {missing}")
    return conform(df, schema)


def read_result(spark: SparkSession, table: str, scenario: str | None = None) -> DataFrame:
    """A stored result table, pruned to one scenario partition."""
    df = _load(spark, table)
    return df if scenario is None else df.where(F.col("scenario") == F.lit(scenario))


@dataclass(frozen=True)
class ClaimInputs:
    """The four base relations, already in the logical schema."""

    dx: DataFrame
    px: DataFrame
    rx: DataFrame
    patients: DataFrame

    def channels(self) -> dict[str, DataFrame]:
        return {"dx": self.dx, "px": self.px, "rx": self.rx}

    def tagged_events(self) -> DataFrame:
        """All channels as one relation with a ``source`` tag (UNION ALL).

        Ids of different types in different channels meet as strings.
        """
        out = None
        channels = self.channels().values()
        kinds = {c: {df.schema[c].dataType for df in channels} for c in OPAQUE}
        cols = [
            F.col(c).cast("string").alias(c) if len(kinds.get(c, ())) > 1 else F.col(c)
            for c in CHANNEL_SCHEMA.fieldNames()
        ]
        for name, df in self.channels().items():
            tagged = df.select(*cols, F.lit(SOURCE_TAGS[name]).alias("source"))
            out = tagged if out is None else out.unionByName(tagged)
        return out
