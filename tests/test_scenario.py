"""Config operators: latest scenario, strict/lenient reads, code list (S1-S7)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from naive_rank import rank_scenarios

from cohortlab.operators.scenario import (
    code_stats_frame,
    config_codes,
    latest_scenario_name,
    load_scenario,
    scenario_rows,
)
from cohortlab.spec import ScenarioConfigError
from conftest import criterion_cfg, make_config


def test_latest_by_time_and_all_rows_of_that_name(spark):
    a = make_config(spark, "A", "2026-01-01 00:00:00", [criterion_cfg([("x", "g")])])
    b = make_config(spark, "B", "2026-01-03 00:00:00", [criterion_cfg([("x", "g"), ("y", "g")])])
    a_again = make_config(spark, "A", "2025-12-01 00:00:00", [criterion_cfg([("z", "g")])])
    cfg = a.unionByName(b).unionByName(a_again)
    assert latest_scenario_name(cfg) == "B"
    ranks = {(r.scenario, r.rnk) for r in rank_scenarios(cfg).collect()}
    assert ("B", 1) in ranks and ("A", 2) in ranks
    # S1: every row with the name, including an older submission
    assert scenario_rows(cfg.unionByName(make_config(spark, "B", "2020-01-01 00:00:00",
                                                     [criterion_cfg([("q", "g")])])), "B").count() == 3


def test_tie_broken_by_name_and_null_time_last(spark):
    a = make_config(spark, "Z", "2026-01-01 00:00:00", [criterion_cfg([("x", "g")])])
    b = make_config(spark, "M", "2026-01-01 00:00:00", [criterion_cfg([("x", "g")])])
    undated = make_config(spark, "A", None, [criterion_cfg([("x", "g")])])
    assert latest_scenario_name(a.unionByName(b).unionByName(undated)) == "M"  # S2, S3
    assert latest_scenario_name(undated) == "A"


def test_null_name_gives_empty_scenario(spark):
    cfg = make_config(spark, None, "2026-01-01 00:00:00", [criterion_cfg([("x", "g")])])
    spec, rows, codes = load_scenario(cfg)  # S4
    assert spec.name is None and rows.count() == 0 and codes.count() == 0
    assert all(not c.live for c in spec.criteria)


def test_strict_read_rejects_two_values_and_null_mix(spark):
    one = make_config(spark, "A", "2026-01-01 00:00:00", [criterion_cfg([("x", "g")], birth_year=1990)])
    two = make_config(spark, "A", "2026-01-01 00:00:00", [criterion_cfg([("y", "g")], birth_year=1991)])
    with pytest.raises(ScenarioConfigError):
        load_scenario(one.unionByName(two))  # S1 with unequal scalars
    nul = make_config(spark, "A", "2026-01-01 00:00:00", [criterion_cfg([("y", "g")], birth_op=None)])
    with pytest.raises(ScenarioConfigError):
        load_scenario(one.unionByName(nul))  # S7: {<=, NULL} fails the strict read


def test_lenient_gap_defaults(spark):
    cfg = make_config(spark, "A", "2026-01-01 00:00:00", [criterion_cfg([("x", "g")])],
                      pairs=(("AND", None, None), ("OR", ">", None)))
    spec, _, _ = load_scenario(cfg)
    assert spec.pair("12").gap_op == "" and spec.pair("12").gap_days == 0
    assert spec.pair("123").gap_op == ">" and spec.pair("123").gap_days == 0


def test_code_list_unpivot_distinct_and_group_total(spark):
    cfg = make_config(
        spark, "A", "2026-01-01 00:00:00",
        [criterion_cfg([("x", "g1"), ("x", "g2"), ("x", "g1"), ("y", None)]),
         criterion_cfg([("x", "h")])],
    )
    codes = {tuple(r) for r in config_codes(cfg).collect()}
    # S5: repeated (code, group) kept once; a code in two groups stays twice
    assert codes == {(1, "x", "g1"), (1, "x", "g2"), (1, "y", None), (2, "x", "h")}
    stats = {r.criterion: r for r in code_stats_frame(cfg).collect()}
    assert (stats[1].groups, stats[1].codes, stats[1].code_rows) == (2, 2, 3)
    assert (stats[2].groups, stats[2].codes, stats[2].code_rows) == (1, 1, 1)
    assert config_codes(cfg).where(F.col("code").isNull()).count() == 0


def test_read_config_from_parquet(spark, tmp_path):
    from cohortlab.sources.fixtures import scenario_config
    from cohortlab.sources.tables import read_config

    path = str(tmp_path / "config")
    scenario_config(spark).write.parquet(path)
    a, _, codes_a = load_scenario(read_config(spark, path))
    b, _, codes_b = load_scenario(scenario_config(spark))
    assert a == b and a.name == "S_SEQ" and a.criteria[0].groups == ("G1", "G2")
    assert sorted(map(tuple, codes_a.collect())) == sorted(map(tuple, codes_b.collect()))


def test_read_config_takes_every_criterion_or_raises(spark):
    from cohortlab.sources.schemas import config_schema, pair_keys
    from cohortlab.sources.tables import criteria_in, read_config

    for n in (1, 2, 4, 12):
        stored = spark.createDataFrame([], config_schema(n))
        got = read_config(spark, stored)
        assert criteria_in(got.columns) == n and got.columns == stored.columns
        assert len(set(got.columns)) == len(got.columns)  # pair and criterion columns never share a name
    assert pair_keys(12)[0] == "1to2" and pair_keys(9)[-1] == "123456789"
    four = spark.createDataFrame([], config_schema(4))
    with pytest.raises(ScenarioConfigError):
        read_config(spark, four.drop("c4_code"))  # the other columns of criterion 4 would be ignored
    with pytest.raises(ScenarioConfigError):
        read_config(spark, four.drop("c2_code"))
    with pytest.raises(ScenarioConfigError):
        read_config(spark, four.drop("c4_logic"))


def test_settings_and_codes_come_from_one_scenario(spark, tmp_path):
    from cohortlab.sources.tables import read_config

    path = str(tmp_path / "cfg")
    make_config(spark, "T", "2026-01-01 00:00:00", [criterion_cfg([("x", "g")])]).write.partitionBy("scenario").parquet(path)
    spec, rows, codes = load_scenario(read_config(spark, path))
    later = make_config(spark, "U", "2026-02-01 00:00:00", [criterion_cfg([("y", "g")])])
    later.write.mode("append").partitionBy("scenario").parquet(path)
    spark.catalog.refreshByPath(path)
    _, rows, codes = spec, rows, codes
    assert spec.name == "T" and spec.criteria[0].codes == ("x",)
    assert [r.code for r in codes.collect()] == ["x"] and {r.scenario for r in rows.select("scenario").collect()} == {"T"}


def test_large_code_list_has_no_buffer_of_all_codes(spark):
    from pyspark.sql import functions as F

    from cohortlab.operators.scenario import SCAN_CODE_FILTER_MAX, _code_rows

    one = make_config(spark, "T", "2026-01-01 00:00:00", [criterion_cfg([("x", "g")])])
    big = spark.range(300_000).crossJoin(one.limit(1)).select(
        *[F.concat(F.lit("code"), F.col("id")).alias(c) if c == "c1_code" else
          F.concat(F.lit("g"), F.col("id") % 70).alias(c) if c == "c1_group" else F.col(c) for c in one.columns])
    plan = code_stats_frame(big)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan and "Window" not in plan
    spec, _, codes = load_scenario(big)
    c = spec.criteria[0]
    assert (c.group_total, c.code_rows) == (70, 300_000) and c.codes is None and c.code_rows > SCAN_CODE_FILTER_MAX
    assert c.code_bytes == _code_rows(big).where("code is not null").selectExpr(
        "sum(octet_length(code) + octet_length(code_group) + 16) AS n").first().n
