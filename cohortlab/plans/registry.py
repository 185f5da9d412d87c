"""Registered queries: one per operator of the inventory, over whole tables.

Each entry is ``key -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL)``.
Every query reads the test tables (through the fixture mapping) plus a
scenario config; none runs on made-up input alone. Config-only operators
(ranking, strict reads, unpivot) run inside every criterion query and are
unit-tested on their own in ``tests/``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.combine import combine
from ..operators.criterion import (
    birth_filter,
    criterion_events,
    distinct_claim_rows,
    enriched_events,
    match_events,
    patient_counts,
    patients_qualified,
    with_age,
)
from ..operators.scenario import load_scenario
from ..operators.sinks import audit_counts, create_or_append, ensure_database, preview_frame, write_result
from ..sources.fixtures import LATEST_SCENARIO, scenario_config, fixture_inputs
from ..sources.schemas import COHORT_COLUMNS, CRITERION_COLUMNS, PAIR_COLUMNS
from ..sources.tables import ClaimInputs, read_config, read_result
from ..spec import SOURCE_TAGS
from . import oracle as O
from .materialize import RunScratch
from .scenario_run import ResultTables, run_scenario, write_scenario
from .session import apply_engine_conf, scratch_path

AS_OF_YEAR = O.AS_OF_YEAR
RESULT_DB = "cohortlab_results"
QueryFn = Callable[[SparkSession, str], DataFrame]


def _setup(spark: SparkSession, sf_dir: str, scenario: str | None):
    apply_engine_conf(spark)
    inputs = fixture_inputs(spark, sf_dir)
    spec, rows, codes = load_scenario(scenario_config(spark), scenario)
    return inputs, spec, codes


# What a key's last call stored; the next call of the key drops it. (Its result
# is lazy, so it can't be dropped before.)
_LEFT: dict[tuple[str, str], list[Callable[[], None]]] = {}


def _fresh(spark: SparkSession, key: str) -> list[Callable[[], None]]:
    mine = (spark.sparkContext.applicationId, key)
    for drop in _LEFT.pop(mine, []):
        drop()
    _LEFT[mine] = []
    return _LEFT[mine]


# -- scans ---------------------------------------------------------------------
def _scan(channel: str) -> QueryFn:
    def run(spark, sf_dir):
        inputs = fixture_inputs(spark, sf_dir)
        return getattr(inputs, channel)

    return run


def q_channel_tags(spark, sf_dir):
    return fixture_inputs(spark, sf_dir).tagged_events()


def _tagged(inputs: ClaimInputs, channel: str) -> DataFrame:
    return inputs.channels()[channel].withColumn("source", F.lit(SOURCE_TAGS[channel]))


# -- criterion steps -------------------------------------------------------------
def _match_channel(channel: str, n: int, birth: bool = True) -> QueryFn:
    def run(spark, sf_dir):
        inputs, spec, codes = _setup(spark, sf_dir, None)
        m = match_events(_tagged(inputs, channel), codes, spec, [n])
        return enriched_events(m, inputs.patients, spec, AS_OF_YEAR, birth_test=birth)

    return run


def _matched_all(n: int, scenario: str | None = None) -> QueryFn:
    def run(spark, sf_dir):
        inputs, spec, codes = _setup(spark, sf_dir, scenario)
        m = match_events(inputs.tagged_events(), codes, spec, [n])
        return enriched_events(m, inputs.patients, spec, AS_OF_YEAR)

    return run


def q_date_window(spark, sf_dir):
    inputs, spec, codes = _setup(spark, sf_dir, None)
    return match_events(inputs.tagged_events(), codes, spec, [1]).drop("group_idx")


def _birth_passing(inputs, spec, n):
    per, any_ = birth_filter(spec, [n])
    return inputs.patients.where(any_).withColumn("criterion", F.lit(n)).where(per).select("criterion", "patient_id")


def _counts(n: int) -> Callable:
    def counts(spark, sf_dir):
        inputs, spec, codes = _setup(spark, sf_dir, None)
        base = distinct_claim_rows(match_events(inputs.tagged_events(), codes, spec, [n]))
        c = patient_counts(base).join(_birth_passing(inputs, spec, n), ["criterion", "patient_id"], "left_semi")
        return c, spec

    return counts


def _group_count(n):
    def run(spark, sf_dir):
        c, _ = _counts(n)(spark, sf_dir)
        return c.select("patient_id", F.col("n_groups").cast("long").alias("n_groups"))

    return run


def _claim_count(n):
    def run(spark, sf_dir):
        c, _ = _counts(n)(spark, sf_dir)
        return c.select("patient_id", F.col("n_claims").cast("long").alias("n_claims"))

    return run


def _qualified(n: int, groups: bool = False, claims: bool = False) -> QueryFn:
    def run(spark, sf_dir):
        inputs, spec, codes = _setup(spark, sf_dir, None)
        base = distinct_claim_rows(match_events(inputs.tagged_events(), codes, spec, [n]))
        found = patients_qualified(base, spec, groups, claims)
        return found.join(_birth_passing(inputs, spec, n), ["criterion", "patient_id"], "left_semi").select("patient_id")

    return run


def _age(with_band: bool) -> QueryFn:
    def run(spark, sf_dir):
        p = with_age(fixture_inputs(spark, sf_dir).patients, AS_OF_YEAR)
        cols = ["patient_id", "birth_year", "age"] + (["age_group"] if with_band else [])
        return p.select(*cols)

    return run


def _criterion(n: int, scenario: str | None = None) -> QueryFn:
    def run(spark, sf_dir):
        inputs, spec, codes = _setup(spark, sf_dir, scenario)
        scratch = RunScratch(spark)
        _fresh(spark, f"criterion {n} {scenario}").append(scratch.close)
        return criterion_events(inputs, codes, spec, AS_OF_YEAR, criteria=[n], scratch=scratch)

    return run


# -- combines ----------------------------------------------------------------------
def _run(spark, sf_dir, scenario: str | None, key: str, pairs: int | None = None):
    res = run_scenario(spark, fixture_inputs(spark, sf_dir), scenario_config(spark), scenario, AS_OF_YEAR, pairs=pairs)
    _fresh(spark, key).append(res.close)
    return res


def _pair(scenario: str | None) -> QueryFn:
    return lambda spark, sf_dir: _run(spark, sf_dir, scenario, f"pair {scenario}", pairs=1).pairs["12"]


def _cohort(scenario: str | None) -> QueryFn:
    return lambda spark, sf_dir: _run(spark, sf_dir, scenario, f"cohort {scenario}").cohort


def _counts_of(scenario: str) -> QueryFn:
    """Rows of every result of a scenario: an empty one stands beside live ones."""

    def run(spark, sf_dir):
        res = _run(spark, sf_dir, scenario, f"counts {scenario}")
        frames = {f"criterion_{n}": res.criterion(n) for n in (1, 2, 3)}
        return audit_counts(spark, frames | {"pair_12": res.pairs["12"], "cohort": res.cohort})

    return run


def q_scenario_filter(spark, sf_dir):
    """Criterion inputs holding two scenarios; combine one of them."""
    a = _run(spark, sf_dir, "S_GE", "filter a", pairs=1)
    b = _run(spark, sf_dir, "S_SEQ", "filter b", pairs=1)
    both = a.criteria.unionByName(b.criteria)
    left = both.where(F.col("criterion") == 1).select(*PAIR_COLUMNS)
    right = both.where(F.col("criterion") == 2).select(*PAIR_COLUMNS)
    return combine(left, right, a.spec.pair("12"), keep_date=True, scenario="S_GE")


# -- sinks -------------------------------------------------------------------------
class _Tables:
    """New external tables of a key, with their data in a folder of the shared scratch."""

    def __init__(self, spark, key: str) -> None:
        self.spark, self.scratch, self.left = spark, RunScratch(spark, "tables"), _fresh(spark, key)
        self.left.append(self.scratch.close)

    def name(self, label: str) -> str:
        table = f"{label}_{uuid.uuid4().hex[:12]}"
        self.left.insert(0, lambda: self.spark.sql(f"DROP TABLE IF EXISTS {table}"))
        return table

    def results(self, database: str = "") -> ResultTables:
        names = [f"{database}{t}_{uuid.uuid4().hex[:12]}" for t in ("criterion_events", "pair_events", "cohort")]
        for view in names:
            self.left.insert(0, lambda view=view: self.spark.sql(f"DROP VIEW IF EXISTS {view}"))
        return ResultTables(*names)

    def write(self, df: DataFrame, table: str, mode: str, scenario: str | None = None) -> None:
        write_result(df, table, mode, path=f"{self.scratch.path}/{table}", partition=scenario and {"scenario": scenario})


def _crit_long(spark, sf_dir, tables: _Tables, scenario=None):
    inputs, spec, codes = _setup(spark, sf_dir, scenario)
    return criterion_events(inputs, codes, spec, AS_OF_YEAR, scratch=tables.scratch)


def _read(spark, table, scenario: str | None = None):
    return read_result(spark, table, scenario).select(*CRITERION_COLUMNS)


def q_sink_create(spark, sf_dir):
    s = _Tables(spark, "sink_create")
    t = s.name("crit_create")
    s.write(_crit_long(spark, sf_dir, s), t, "create")
    return _read(spark, t)


def q_sink_append(spark, sf_dir):
    s = _Tables(spark, "sink_append")
    t = s.name("crit_append")
    df = _crit_long(spark, sf_dir, s)
    s.write(df, t, "create")
    s.write(df, t, "append")
    return _read(spark, t)


def q_sink_create_or_append(spark, sf_dir):
    s = _Tables(spark, "sink_create_or_append")
    t = s.name("crit_auto")
    df = _crit_long(spark, sf_dir, s)
    path = f"{s.scratch.path}/{t}"
    assert create_or_append(df, t, path) == "create"
    assert create_or_append(df, t, path) == "append"
    return _read(spark, t)


def q_sink_replace(spark, sf_dir):
    s = _Tables(spark, "sink_replace")
    t = s.name("crit_replace")
    df = _crit_long(spark, sf_dir, s)
    s.write(df, t, "create")
    s.write(df, t, "append")
    s.write(df, t, "replace", LATEST_SCENARIO)
    return _read(spark, t)


def q_sink_replace_empty(spark, sf_dir):
    """Two scenarios stored, one rerun to nothing: the other's rows remain."""
    s = _Tables(spark, "sink_replace_empty")
    t = s.name("crit_replace_empty")
    df = _crit_long(spark, sf_dir, s)
    s.write(df, t, "create")
    s.write(_crit_long(spark, sf_dir, s, "S_ALL"), t, "append")
    s.write(df.where(F.col("service_date") < F.lit("1900-01-01").cast("date")), t, "replace", LATEST_SCENARIO)
    return _read(spark, t)


def q_scan_results(spark, sf_dir):
    """Stored results of two scenarios, read back pruned to one."""
    s = _Tables(spark, "scan_results")
    t = s.name("crit_two")
    s.write(_crit_long(spark, sf_dir, s, "S_ALL"), t, "create")
    s.write(_crit_long(spark, sf_dir, s, LATEST_SCENARIO), t, "append")
    return _read(spark, t, "S_ALL")


def _stored(spark, sf_dir, key: str, database: str = "", scenarios: tuple = (None,), mode: str = "auto"):
    s = _Tables(spark, key)
    tables, stored = s.results(database), f"{s.scratch.path}/config.parquet"
    scenario_config(spark).write.parquet(stored)
    config = read_config(spark, stored)
    for name in scenarios:
        done = write_scenario(spark, fixture_inputs(spark, sf_dir), config, tables, mode, name, AS_OF_YEAR, root=s.scratch.path)
    return tables, done


def q_audit_counts(spark, sf_dir):
    return _stored(spark, sf_dir, "audit_counts")[1].counts


def q_publish_append(spark, sf_dir):
    """Two scenarios published in turn, the first one again: the store's cohort of the first, pruned to its parts."""
    tables, done = _stored(spark, sf_dir, "publish_append", scenarios=("S_ALL", LATEST_SCENARIO, "S_ALL"))
    return done.store.read(tables.cohort, "S_ALL").select(*COHORT_COLUMNS)


def q_publish_replace(spark, sf_dir):
    """A scenario published twice beside another one, by ``replace``: the pairs of both."""
    tables, done = _stored(spark, sf_dir, "publish_replace", scenarios=("S_ALL", LATEST_SCENARIO, "S_ALL"), mode="replace")
    return done.store.read(tables.pairs).select(*PAIR_COLUMNS)


def q_stored_cohort(spark, sf_dir):
    """The cohort as written by a full run into its own namespace (created
    if missing), tables created and read back."""
    apply_engine_conf(spark)
    ensure_database(spark, RESULT_DB, scratch_path(spark, RESULT_DB), use=False)
    tables, _ = _stored(spark, sf_dir, "stored_cohort", f"{RESULT_DB}.")
    return spark.table(tables.cohort).select(*COHORT_COLUMNS)


def q_preview_cohort(spark, sf_dir):
    return preview_frame(_cohort(None)(spark, sf_dir), 1)


# -- the table -----------------------------------------------------------------------
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {
    # sources
    "scan_dx": (_scan("dx"), O.scan_sql("dx_events")),
    "scan_px": (_scan("px"), O.scan_sql("px_events")),
    "scan_rx": (_scan("rx"), O.scan_sql("rx_events")),
    "scan_patients": (_scan("patients"), O.scan_sql("patients")),
    "scan_results": (q_scan_results, O.criteria_sql("S_ALL")),
    "channel_tags": (q_channel_tags, O.scan_sql("claims")),
    # criterion steps (latest scenario = S_SEQ)
    "match_dx": (_match_channel("dx", 1), O.matched_sql(1, tag="Dx")),
    "match_px": (_match_channel("px", 2), O.matched_sql(2, tag="Px")),
    "match_rx": (_match_channel("rx", 3), O.matched_sql(3, tag="Rx")),
    "patient_enrich": (_match_channel("rx", 3, birth=False), O.matched_sql(3, tag="Rx", born=False)),
    "date_window": (q_date_window, O.hits_sql(1)),
    "birth_year_le": (_matched_all(1), O.matched_sql(1)),
    "birth_year_ge": (_matched_all(2), O.matched_sql(2)),
    "birth_year_none": (_counts_of("S_BIRTH_EQ"), O.counts_sql("S_BIRTH_EQ")),
    "age": (_age(False), O.age_sql(False)),
    "age_band": (_age(True), O.age_sql(True)),
    "channel_union": (_criterion(1, "S_MIXED"), O.criterion_sql(1, "S_MIXED")),
    "group_count": (_group_count(1), O.per_patient_sql(1, "count(DISTINCT code_group) AS n_groups")),
    "group_qualify_and": (_qualified(1, groups=True), O.qualified_sql(1, groups=True)),
    "group_qualify_or": (_qualified(2, groups=True), O.qualified_sql(2, groups=True)),
    "claim_count": (_claim_count(2), O.per_patient_sql(2, "count(DISTINCT claim_id) AS n_claims")),
    "claim_qualify": (_qualified(2, claims=True), O.qualified_sql(2, claims=True)),
    "criterion_1": (_criterion(1), O.criterion_sql(1)),
    "criterion_2": (_criterion(2), O.criterion_sql(2)),
    "criterion_3": (_criterion(3), O.criterion_sql(3)),
    "submitted_twice": (_criterion(1, "S_TWICE"), O.criterion_sql(1, "S_TWICE")),
    "criterion_null_group": (_criterion(1, "S_NULLGRP"), O.criterion_sql(1, "S_NULLGRP")),
    # first combine (criterion 1 with 2)
    "combine_and_nogap": (_pair("S_ALL"), O.pair_sql("S_ALL")),
    "gap_gt": (_pair(LATEST_SCENARIO), O.pair_sql(LATEST_SCENARIO)),
    "gap_lt": (_pair("S_AND_LT"), O.pair_sql("S_AND_LT")),
    "gap_ge": (_pair("S_GE"), O.pair_sql("S_GE")),
    "gap_le": (_pair("S_LE"), O.pair_sql("S_LE")),
    "gap_blank": (_pair("S_BLANK"), O.pair_sql("S_BLANK")),
    "gap_unknown": (_cohort("S_UNKNOWN_OP"), O.cohort_sql("S_UNKNOWN_OP")),
    "combine_or_nogap": (_pair("S_OR_NOGAP"), O.pair_sql("S_OR_NOGAP")),
    "combine_or_gap_gt": (_pair("S_OR_GT"), O.pair_sql("S_OR_GT")),
    "combine_or_gap_lt": (_pair("S_LT"), O.pair_sql("S_LT")),
    "combine_or_gap_ge": (_pair("S_ANY"), O.pair_sql("S_ANY")),
    "combine_or_gap_le": (_pair("S_OR_LE"), O.pair_sql("S_OR_LE")),
    "combine_gate_none": (_counts_of("S_GATE_NONE"), O.counts_sql("S_GATE_NONE")),
    "combine_null_group": (_pair("S_NULLGRP"), O.pair_sql("S_NULLGRP")),
    "scenario_filter": (q_scenario_filter, O.pair_sql("S_GE")),
    # second combine (pair with criterion 3): the cohort
    "cohort_seq": (_cohort(None), O.cohort_sql(None)),
    "cohort_and_nogap": (_cohort("S_AND_LT"), O.cohort_sql("S_AND_LT")),
    "cohort_and_gap": (_cohort("S_ALL"), O.cohort_sql("S_ALL")),
    "cohort_and_gt": (_cohort("S_LT"), O.cohort_sql("S_LT")),
    "cohort_and_ge": (_cohort("S_GE"), O.cohort_sql("S_GE")),
    "cohort_and_lt": (_cohort("S_OR_GT"), O.cohort_sql("S_OR_GT")),
    "cohort_or_nogap": (_cohort("S_OR_OR"), O.cohort_sql("S_OR_OR")),
    "cohort_or_gap": (_cohort("S_ANY"), O.cohort_sql("S_ANY")),
    "cohort_or_le": (_cohort("S_LE"), O.cohort_sql("S_LE")),
    "cohort_or_ge": (_cohort("S_OR_NOGAP"), O.cohort_sql("S_OR_NOGAP")),
    "cohort_or_gt": (_cohort("S_BLANK"), O.cohort_sql("S_BLANK")),
    "cohort_or_le_neg": (_cohort("S_OR_LE"), O.cohort_sql("S_OR_LE")),
    "cohort_or_empty_pair": (_cohort("S_GATE_NONE"), O.cohort_sql("S_GATE_NONE")),
    "cohort_unknown_op": (_counts_of("S_UNKNOWN_LAST"), O.counts_sql("S_UNKNOWN_LAST")),
    "cohort_null_group": (_cohort("S_NULLGRP"), O.cohort_sql("S_NULLGRP")),
    # sinks and audit
    "sink_create": (q_sink_create, O.criteria_sql(None)),
    "sink_append": (q_sink_append, O.criteria_sql(None, copies=2)),
    "sink_create_or_append": (q_sink_create_or_append, O.criteria_sql(None, copies=2)),
    "sink_replace": (q_sink_replace, O.criteria_sql(None)),
    "sink_replace_empty": (q_sink_replace_empty, O.criteria_sql("S_ALL")),
    "stored_cohort": (q_stored_cohort, O.cohort_sql(None)),
    "audit_counts": (q_audit_counts, O.counts_sql(None)),
    "publish_append": (q_publish_append, O.cohort_sql("S_ALL", copies=2)),
    "publish_replace": (q_publish_replace, O.pairs_sql("S_ALL", LATEST_SCENARIO)),
    "preview_cohort": (q_preview_cohort, O.preview_sql(None)),
}


def queries() -> dict[str, QueryFn]:
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}
