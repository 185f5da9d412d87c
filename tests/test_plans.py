"""Plan shape: what the optimizer must keep doing at scale."""

from __future__ import annotations

import re

from cohortlab.operators.combine import combine
from cohortlab.operators.criterion import criterion_events, distinct_claim_rows, match_events
from cohortlab.operators.scenario import load_scenario
from cohortlab.plans.materialize import materialize
from cohortlab.sources.fixtures import scenario_config, fixture_inputs
from cohortlab.sources.tables import ClaimInputs, read_channel, read_patients
from conftest import SF_SMALL


def final_plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def written_inputs(spark, tmp_path) -> ClaimInputs:
    """The sf0.001 inputs stored as plain Parquet tables (one per relation)."""
    src = fixture_inputs(spark, SF_SMALL)
    paths = {}
    for name in ("dx", "px", "rx", "patients"):
        paths[name] = str(tmp_path / name)
        getattr(src, name).write.parquet(paths[name])
    return ClaimInputs(
        dx=read_channel(spark, paths["dx"]),
        px=read_channel(spark, paths["px"]),
        rx=read_channel(spark, paths["rx"]),
        patients=read_patients(spark, paths["patients"]),
    )


def test_match_plan(spark, tmp_path):
    inputs = written_inputs(spark, tmp_path)
    spec, _, codes = load_scenario(scenario_config(spark))
    plan = final_plan(distinct_claim_rows(match_events(inputs.tagged_events(), codes, spec)))
    for name in ("dx", "px", "rx"):
        scans = re.findall(rf"FileScan parquet \[[^\]]*\] .*?Location: InMemoryFileIndex[^\n]*/{name}\]", plan)
        assert len(scans) == 1, (name, len(scans))
    # the code list is broadcast; code and date filters reach the scan
    assert "BroadcastHashJoin" in plan
    pushed = " ".join(re.findall(r"PushedFilters: \[.*", plan))
    assert "In(code" in pushed and "GreaterThanOrEqual(service_date" in pushed


def test_criterion_plan(spark, tmp_path):
    inputs = written_inputs(spark, tmp_path)
    spec, _, codes = load_scenario(scenario_config(spark))
    df = criterion_events(inputs, codes, spec, 2025)
    plan = final_plan(df)
    # claims come from the stored matched rows (written by one scan of each
    # claim table, see test_match_plan); the patient table is scanned once
    assert "matched_claims" in plan
    for name in ("dx", "px", "rx"):
        assert not re.search(rf"Location: InMemoryFileIndex[^\n]*/{name}\]", plan)
    assert len(re.findall(r"Location: InMemoryFileIndex[^\n]*/patients\]", plan)) == 1
    # one distinct aggregate: no Expand
    assert "Expand" not in plan
    # the birth-year test is pushed into the patient scan
    assert "birth_year" in " ".join(re.findall(r"PushedFilters: \[.*", plan))
    # no cartesian product anywhere
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert df.count() == sum(criterion_events(inputs, codes, spec, 2025, criteria=[n]).count() for n in (1, 2, 3)) > 0


def test_reduced_combine_plan_has_no_event_pairs(spark, tmp_path):
    inputs = written_inputs(spark, tmp_path)
    spec, _, codes = load_scenario(scenario_config(spark))
    crit = materialize(criterion_events(inputs, codes, spec, 2025), "criteria", ["criterion"])
    left = crit.where("criterion = 1").drop("criterion")
    right = crit.where("criterion = 2").drop("criterion")
    plan = final_plan(combine(left, right, spec.pair("12"), True, spec.name))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # every join is an equi-join on the patient (of one scenario, which is no key)
    joins = list(re.finditer(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\], \[([^\]]*)\]", plan))
    assert joins
    for m in joins:
        assert re.fullmatch(r"patient_id#\d+L", m.group(2)), m.group(0)
