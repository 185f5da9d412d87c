"""Test inputs: the logical tables mapped onto ``/root/testdata/sf*``.

The driver's test data is a TPC-H-like star schema plus an ``events`` table.
The mapping below (see FIXTURES.md) turns it into three claim channels and a
patient reference, over the *whole* tables. Each mapping is given twice, as a
DataFrame and as DuckDB SQL for the oracle, and the two must stay in step.

Scenario fixtures are the user-submitted scenario config: small by nature
(one row per code of the longest list) and built here from literals.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import config_schema, pair_keys
from .tables import ClaimInputs, read_channel, read_patients

# ---------------------------------------------------------------------------
# Fixed values of the test-data mapping (FIXTURES.md section 2).
# ---------------------------------------------------------------------------
# Every RX_STRAY-th event belongs to a patient id that no customer has, so some
# claims have no patient (left-join misses, ledger S9). All rows are kept.
RX_STRAY_MODULUS = 23
RX_STRAY_SHIFT = 1_000_000_000
# Birth year is missing for keys that are multiples of 17, else 1935 + key % 75.
BIRTH_YEAR_NULL_MODULUS = 17
BIRTH_YEAR_BASE = 1935
BIRTH_YEAR_SPAN = 75
# Event timestamps (January 2024) are moved back to January 1998.
RX_SHIFT_DAYS = 9496
# ---------------------------------------------------------------------------


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wall_date(df: DataFrame, col: str) -> F.Column:
    """Calendar date of a stored wall-clock timestamp, whatever the session
    time zone. The test files hold timestamps without a zone: Spark reads
    them as TIMESTAMP_NTZ (a plain cast is zone-free); a session that reads
    them as zoned timestamps gets the stored microseconds' UTC day instead
    of a cast through its own zone."""
    if isinstance(df.schema[col].dataType, T.TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_micros(F.col(col)) / F.lit(86_400_000_000)).cast("int"))
    return F.col(col).cast("date")


def fixture_inputs(spark: SparkSession, sf_dir: str) -> ClaimInputs:
    """Claim channels and patients derived from the test tables."""
    customer = _t(spark, sf_dir, "customer")
    nation = _t(spark, sf_dir, "nation")
    orders = _t(spark, sf_dir, "orders")
    lineitem = _t(spark, sf_dir, "lineitem")
    part = _t(spark, sf_dir, "part")
    events = _t(spark, sf_dir, "events")

    key = F.col("c_custkey")
    patients = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            key.alias("patient_id"),
            F.when(key % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
            F.col("n_name").alias("state"),
            F.when(key % BIRTH_YEAR_NULL_MODULUS == 0, F.lit(None))
            .otherwise(F.lit(BIRTH_YEAR_BASE) + key % BIRTH_YEAR_SPAN)
            .alias("birth_year"),
        )
    )
    # part first: a code filter on p_brand then shrinks lineitem before the
    # larger join with orders (same rows either way)
    dx = (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .select(
            F.col("o_custkey").alias("patient_id"),
            _wall_date(lineitem, "l_shipdate").alias("service_date"),
            F.col("l_orderkey").alias("claim_id"),
            F.col("p_brand").alias("code"),
        )
    )
    px = orders.select(
        F.col("o_custkey").alias("patient_id"),
        _wall_date(orders, "o_orderdate").alias("service_date"),
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_orderpriority").alias("code"),
    )
    rx = events.select(
        F.when(F.col("event_id") % RX_STRAY_MODULUS == 0, F.col("user_id") + RX_STRAY_SHIFT)
        .otherwise(F.col("user_id")).alias("patient_id"),
        F.date_sub(_wall_date(events, "ts"), RX_SHIFT_DAYS).alias("service_date"),
        F.col("event_id").alias("claim_id"),
        F.col("event_type").alias("code"),
    )
    return ClaimInputs(
        dx=read_channel(spark, dx),
        px=read_channel(spark, px),
        rx=read_channel(spark, rx),
        patients=read_patients(spark, patients),
    )


# The same mapping as DuckDB SQL (views over the pre-registered test tables).
SQL_INPUT_VIEWS = {
    "patients": f"""
        SELECT c.c_custkey AS patient_id,
               CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               n.n_name AS state,
               CASE WHEN c.c_custkey % {BIRTH_YEAR_NULL_MODULUS} = 0 THEN NULL
                    ELSE CAST({BIRTH_YEAR_BASE} + c.c_custkey % {BIRTH_YEAR_SPAN} AS INTEGER) END AS birth_year
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "dx_events": """
        SELECT o.o_custkey AS patient_id, CAST(l.l_shipdate AS DATE) AS service_date,
               l.l_orderkey AS claim_id, p.p_brand AS code
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON l.l_partkey = p.p_partkey""",
    "px_events": """
        SELECT o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS service_date,
               o_orderkey AS claim_id, o_orderpriority AS code
        FROM orders""",
    "rx_events": f"""
        SELECT CASE WHEN event_id % {RX_STRAY_MODULUS} = 0 THEN user_id + {RX_STRAY_SHIFT} ELSE user_id END AS patient_id,
               CAST(CAST(ts AS DATE) - {RX_SHIFT_DAYS} AS DATE) AS service_date,
               event_id AS claim_id, event_type AS code
        FROM events""",
}


# ---------------------------------------------------------------------------
# Scenario fixtures (FIXTURES.md section 3). Fixed values.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class CriterionFixture:
    codes: tuple[tuple[str, str | None], ...]
    logic: str | None
    start: dt.date | None
    end: dt.date | None
    birth_op: str | None
    birth_year: int | None
    min_claims: int | None


@dataclass(frozen=True)
class ScenarioFixture:
    name: str
    submitted_at: dt.datetime | None
    criteria: tuple[CriterionFixture, ...]
    # (logic, gap operator, gap days) per pair key "12", "123"
    pairs: tuple[tuple[str | None, str | None, int | None], ...]
    # (submission time, codes of the first criterion) of an older submission
    earlier: tuple | None = None


def _brands(lo: int, hi: int, group: str | None) -> tuple[tuple[str, str | None], ...]:
    return tuple((f"Brand#{i}", group) for i in range(lo, hi + 1))


C1 = CriterionFixture(
    codes=_brands(1, 5, "G1") + _brands(6, 8, "G2") + (("Brand#1", "G2"),),
    logic="AND",
    start=dt.date(1995, 1, 1),
    end=dt.date(1999, 12, 31),
    birth_op="<=",
    birth_year=1990,
    min_claims=2,
)
C1_NULL_GROUP = CriterionFixture(
    codes=C1.codes + (("Brand#10", None),),
    logic=C1.logic,
    start=C1.start,
    end=C1.end,
    birth_op=C1.birth_op,
    birth_year=C1.birth_year,
    min_claims=C1.min_claims,
)
C2 = CriterionFixture(
    codes=(("1-URGENT", "P1"), ("2-HIGH", "P1"), ("Brand#9", "P2")),
    logic="OR",
    start=dt.date(1996, 1, 1),
    end=dt.date(2001, 12, 31),
    birth_op=">=",
    birth_year=1940,
    min_claims=3,
)
# codes on all three channels; groups and claims are pooled over them
C_MIXED = CriterionFixture(
    codes=(("Brand#2", "M1"), ("Brand#3", "M1"), ("1-URGENT", "M2"), ("5-LOW", "M2"), ("purchase", "M3"), ("view", "M3")),
    logic="AND",
    start=dt.date(1996, 1, 1),
    end=dt.date(1999, 12, 31),
    birth_op="<=",
    birth_year=2005,
    min_claims=4,
)
C3 = CriterionFixture(
    codes=(("purchase", "R1"), ("signup", "R1"), ("error", "R2")),
    logic="OR",
    start=dt.date(1998, 1, 1),
    end=dt.date(1998, 12, 31),
    birth_op="<=",
    birth_year=2010,
    min_claims=1,
)


def _at(day: int) -> dt.datetime:
    return dt.datetime(2026, 1, day, 9, 0, 0)


# name: (criteria, pair 12, pair 123). S_SEQ is submitted last (the latest).
_SCENARIOS = {
    "S_ALL": ((C1, C2, C3), ("AND", None, None), ("AND", "<=", 365)),
    "S_ANY": ((C1, C2, C3), ("OR", ">=", 60), ("OR", "<", 0)),
    "S_LT": ((C1, C2, C3), ("OR", "<", 0), ("AND", ">", 0)),
    "S_LE": ((C1, C2, C3), ("AND", "<=", -30), ("OR", "<=", 90)),
    "S_GE": ((C1, C2, C3), ("AND", ">=", 0), ("AND", ">=", 0)),
    "S_NULLGRP": ((C1_NULL_GROUP, C2, C3), ("AND", ">", 30), ("OR", ">=", 0)),
    # Extra operator coverage beyond FIXTURES.md's table.
    "S_AND_LT": ((C1, C2, C3), ("AND", "<", 10), ("AND", None, None)),
    "S_BLANK": ((C1, C2, C3), ("AND", "", 5), ("OR", ">", 30)),
    # an unknown gap operator empties pair 12; under OR the cohort is then criterion 3's
    "S_UNKNOWN_OP": ((C1, C2, C3), ("AND", "=", 0), ("OR", None, None)),
    # here it empties the cohort, with a live pair before it
    "S_UNKNOWN_LAST": ((C1, C2, C3), ("AND", None, None), ("OR", "=", 0)),
    "S_MIXED": ((C_MIXED, C2, C3), ("AND", None, None), ("AND", None, None)),
    "S_OR_NOGAP": ((C1, C2, C3), ("OR", None, None), ("OR", ">=", 30)),
    "S_OR_GT": ((C1, C2, C3), ("OR", ">", 30), ("AND", "<", 100)),
    "S_OR_LE": ((C1, C2, C3), ("OR", "<=", 90), ("OR", "<=", -10)),
    "S_GATE_NONE": ((C1, C2, C3), ("XOR", None, None), ("OR", None, None)),
    "S_BIRTH_EQ": (
        (
            CriterionFixture(C1.codes, C1.logic, C1.start, C1.end, "=", 1990, C1.min_claims),
            C2,
            C3,
        ),
        ("OR", None, None),
        ("OR", None, None),
    ),
    # submitted twice: the older submission's codes count too
    "S_TWICE": ((C1, C2, C3), ("AND", None, None), ("AND", None, None)),
    "S_OR_OR": ((C1, C2, C3), ("OR", "<=", 30), ("OR", None, None)),
    "S_SEQ": ((C1, C2, C3), ("AND", ">", 30), ("OR", None, None)),
}
LATEST_SCENARIO = "S_SEQ"
# ---------------------------------------------------------------------------

SCENARIOS: dict[str, ScenarioFixture] = {
    name: ScenarioFixture(name=name, submitted_at=_at(i + 1), criteria=crit, pairs=(p12, p123))
    for i, (name, (crit, p12, p123)) in enumerate(_SCENARIOS.items())
}

SCENARIOS["S_TWICE"] = replace(
    SCENARIOS["S_TWICE"], earlier=(dt.datetime(2025, 6, 1), (("Brand#11", "G1"), ("Brand#12", "G2"), ("Brand#1", "G1")))
)


def config_rows(fx: ScenarioFixture) -> list[tuple]:
    """Wide config rows of one scenario: code lists zipped side by side,
    shorter lists padded with NULL, scalars repeated on every row."""
    n_rows = max(len(c.codes) for c in fx.criteria)
    rows = []
    for i in range(n_rows):
        row: list = [fx.name, fx.submitted_at]
        for c in fx.criteria:
            code, group = c.codes[i] if i < len(c.codes) else (None, None)
            row += [code, group, c.start, c.end, c.birth_op, c.birth_year, c.logic, c.min_claims]
        for logic, op, days in fx.pairs:
            row += [logic, op, days]
        rows.append(tuple(row))
    if fx.earlier:
        at, codes = fx.earlier
        first = replace(fx.criteria[0], codes=codes)
        older = replace(fx, submitted_at=at, criteria=(first, *fx.criteria[1:]), earlier=None)
        rows += config_rows(older)
    return rows


def _spark_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(int(v))


def scenario_config(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Config table holding the given fixture scenarios (default: all).

    Built as a SQL ``VALUES`` relation, so it is a local relation on the JVM
    side (no Python rows to ship for every small config query).
    """
    names = list(SCENARIOS) if names is None else names
    rows = [r for n in names for r in config_rows(SCENARIOS[n])]
    schema = config_schema(3)
    values = ",\n".join("(" + ", ".join(_spark_literal(v) for v in r) + ")" for r in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema.fieldNames())})")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


__all__ = [
    "SCENARIOS",
    "LATEST_SCENARIO",
    "SQL_INPUT_VIEWS",
    "config_rows",
    "pair_keys",
    "scenario_config",
    "fixture_inputs",
]
