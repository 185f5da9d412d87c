"""Sinks: create, append (twice = rows twice), replace one scenario, errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlab.operators.sinks import (
    SchemaMismatch,
    create_or_append,
    ensure_database,
    preview,
    table_exists,
    write_result,
)
from cohortlab.plans.scenario_run import ResultTables, run_scenario, write_scenario
from cohortlab.sources.fixtures import scenario_config, fixture_inputs
from conftest import SF_SMALL, criterion_cfg, make_config, make_inputs


def rows(spark, scenario, n):
    return spark.createDataFrame([(i, scenario) for i in range(n)], "patient_id long, scenario string")


def test_create_append_replace(spark):
    ensure_database(spark, "sink_test")
    t = "sink_test.results"
    assert create_or_append(rows(spark, "A", 3), t) == "create"
    assert create_or_append(rows(spark, "A", 3), t) == "append"  # S25: duplicates
    write_result(rows(spark, "B", 2), t, "append")
    assert spark.table(t).count() == 8
    write_result(rows(spark, "A", 1), t, "replace", partition={"scenario": "A"})  # only partition A
    got = {r.scenario: r.n for r in spark.table(t).groupBy("scenario").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 1, "B": 2}
    spark.catalog.setCurrentDatabase("default")


def test_append_by_name_with_schema_check(spark):
    t = "sink_by_name"
    write_result(rows(spark, "A", 2), t, "create")
    swapped = rows(spark, "B", 2).select("scenario", "patient_id")
    write_result(swapped, t, "append")  # S23: by name, not by position
    assert spark.table(t).where("scenario = 'B'").count() == 2
    with pytest.raises(SchemaMismatch):
        write_result(swapped.withColumn("x", F.lit(1)), t, "append")
    with pytest.raises(SchemaMismatch):  # no silent cast
        write_result(swapped.withColumn("patient_id", F.col("patient_id").cast("string")), t, "append")


def test_existence_errors_propagate(spark):
    assert not table_exists(spark, "no_such_table_xyz")
    with pytest.raises(Exception):
        table_exists(spark, "bad..name")  # S22: an error is not "missing"


def test_write_scenario_auto_twice(spark, tmp_path):
    tables, root = ResultTables("t_crit", "t_pair", "t_cohort"), str(tmp_path)
    inputs, cfg = fixture_inputs(spark, SF_SMALL), scenario_config(spark)
    first = {r.table_name: r.n_rows for r in
             write_scenario(spark, inputs, cfg, tables, as_of_year=2025, root=root).counts.collect()}
    direct = run_scenario(spark, inputs, cfg, as_of_year=2025)
    assert first == {f"criterion_{n}": direct.criterion(n).count() for n in (1, 2, 3)} | {
        "pair_12": direct.pairs["12"].count(), "cohort": direct.cohort.count()}
    assert all(first.values())
    second = {r.table_name: r.n_rows for r in
              write_scenario(spark, inputs, cfg, tables, as_of_year=2025, root=root).counts.collect()}
    assert second == {k: 2 * v for k, v in first.items()}  # append mode repeats rows
    assert spark.table("t_cohort").count() == second["cohort"]  # the catalog's view
    done = write_scenario(spark, inputs, cfg, tables, mode="replace", as_of_year=2025, preview_rows=2, root=root)
    assert {r.table_name: r.n_rows for r in done.counts.collect()} == first
    assert len(done.preview) == 2 and done.preview == preview(spark.table("t_cohort"), 2)
    rec = preview(spark.table("t_cohort"), 1)
    assert len(rec) == 1 and set(rec[0]) >= {"patient_id", "scenario", "age_group"}


def test_created_table_keeps_its_rows_until_the_successor_is_complete(spark, tmp_path, monkeypatch):
    from cohortlab.operators import sinks

    t = "swap_table"
    write_result(rows(spark, "A", 3), t, "create", path=str(tmp_path / t))
    bad = rows(spark, "B", 2).withColumn("patient_id", F.expr("raise_error('dies while it writes')").cast("long"))
    with pytest.raises(Exception):
        write_result(bad, t, "create", path=str(tmp_path / t))
    assert spark.table(t).count() == 3
    real = type(spark).sql
    for step, rows_left in (("RENAME TO `swap_table__former`", 3), ("RENAME TO `swap_table`", 2), ("DROP TABLE IF EXISTS `swap_table__former`", 2)):
        write_result(rows(spark, "A", 3), t, "create", path=str(tmp_path / t))
        seen = []

        def dying(self, query, *a, **k):
            # the clean-up before the staged write also drops; only steps after it die
            if step in query and spark.catalog.tableExists(f"{t}__next") or (step.startswith("DROP") and step in query and seen):
                raise RuntimeError("killed")
            if "RENAME" in query:
                seen.append(query)
            return real(self, query, *a, **k)

        with monkeypatch.context() as m:
            m.setattr(type(spark), "sql", dying)
            with pytest.raises(RuntimeError):
                write_result(rows(spark, "B", 2), t, "create", path=str(tmp_path / t))
        sinks.recover(spark, t)
        assert spark.table(t).count() == rows_left, step
        assert not spark.catalog.tableExists(f"{t}__next") and not spark.catalog.tableExists(f"{t}__former")
    assert create_or_append(rows(spark, "B", 1), t) == "append"


def test_empty_string_is_no_partition(spark):
    t = "no_name"
    with pytest.raises(Exception, match="empty string"):
        write_result(rows(spark, "", 2), t, "create")
    assert not spark.catalog.tableExists(t)
    write_result(rows(spark, "A", 2), t, "create")
    with pytest.raises(Exception, match="empty string"):
        write_result(rows(spark, "", 2), t, "append")
    with pytest.raises(ValueError):
        write_result(rows(spark, "", 2), t, "replace", partition={"scenario": ""})
    assert spark.table(t).count() == 2


def test_replace_empties_a_scenario_and_leaves_the_others(spark, tmp_path):
    def inputs(code):
        return make_inputs(spark, dx=[(1, "2020-01-01", 1, code), (1, "2020-02-01", 2, "B"), (1, "2020-03-01", 3, "C")],
                           patients=[(1, "F", "CA", 1980)])

    crits = [criterion_cfg([(c, "G")]) for c in "ABC"]
    pairs = (("AND", None, None), ("AND", None, None))
    tables = ResultTables("e_crit", "e_pair", "e_cohort")
    root = str(tmp_path)
    for name in ("T", "U"):
        cfg = make_config(spark, name, "2026-01-01 00:00:00", crits, pairs)
        done = write_scenario(spark, inputs("A"), cfg, tables, mode="replace", as_of_year=2025, root=root)
    assert done.store.read("e_cohort").count() == 2
    cfg = make_config(spark, "T", "2026-01-01 00:00:00", crits, pairs)
    done = write_scenario(spark, inputs("none"), cfg, tables, mode="replace", as_of_year=2025, root=root)
    for t, left in (("e_crit", 5), ("e_pair", 1), ("e_cohort", 1)):  # T keeps criteria 2 and 3 only
        assert done.store.read(t).count() == spark.table(t).count() == left, t
        if t != "e_crit":
            assert {r.scenario for r in spark.table(t).collect()} == {"U"}


def test_run_scratch_is_deleted(spark):
    import os

    cfg = make_config(spark, "T", "2026-01-01 00:00:00", [criterion_cfg([("A", "G")])])
    res = run_scenario(spark, make_inputs(spark, dx=[(1, "2020-01-01", 1, "A")], patients=[(1, "F", "CA", 1980)]), cfg)
    assert res.criteria.count() == 1
    folder = res.scratch.path.removeprefix("file:")
    assert os.path.isdir(folder)
    res.close()
    assert not os.path.exists(folder)
