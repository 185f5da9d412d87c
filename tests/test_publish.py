"""Result tables appear together, whatever step a run dies at."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import result_store as R
from cohortlab.operators.sinks import SchemaMismatch
from cohortlab.plans.scenario_run import ResultTables, ScenarioWriteError, run_scenario, write_scenario
from conftest import criterion_cfg, make_config, make_inputs

TABLES = ResultTables("p_crit", "p_pair", "p_cohort")
CRITS = [criterion_cfg([(c, "G")]) for c in "ABC"]
PAIRS = (("AND", None, None), ("AND", None, None))


def inputs(spark, patients=(1,), code="A"):
    return make_inputs(
        spark, dx=[(p, f"2020-0{i + 1}-01", 10 * p + i, c) for p in patients for i, c in enumerate((code, "B", "C"))],
        patients=[(p, "F", "CA", 1980) for p in patients])


def config(spark, name="T"):
    return make_config(spark, name, "2026-01-01 00:00:00", CRITS, PAIRS)


def write(spark, root, patients=(1,), name="T", mode="auto", **kw):
    return write_scenario(spark, inputs(spark, patients), config(spark, name), TABLES, mode, as_of_year=2025, root=str(root), views=False, **kw)


def contents(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in (TABLES.criteria, TABLES.pairs, TABLES.cohort)}


def folders(root):
    """Runs that have a folder or a marker."""
    tables = [f.removeprefix("run=").rsplit("-", 1)[0] for t in os.listdir(root / "tables") for f in os.listdir(root / "tables" / t)]
    return sorted({*tables, *(f for f in os.listdir(root / "staged") if not f.startswith("."))})


@pytest.mark.parametrize("mode", ["append", "replace", "create"])
def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch, mode):
    store = write(spark, tmp_path).store
    before, kept, version = contents(store), folders(tmp_path), store.versions()
    real = R.StagedRun.write
    for step in range(4):  # at each of the three tables, and at the commit
        done = []

        def dying(self, df, table, *a, **k):
            if len(done) == step:
                raise RuntimeError("killed")
            done.append(table)
            return real(self, df, table, *a, **k)

        with monkeypatch.context() as m:
            if step < 3:
                m.setattr(R.StagedRun, "write", dying)
            else:
                m.setattr(R.ResultStore, "_publish", lambda self, version, tables: 1 / 0)
            m.setattr(R.StagedRun, "abandon", lambda self: None)  # a killed driver clears nothing
            with pytest.raises(ScenarioWriteError) as err:
                write(spark, tmp_path, (1, 2), mode=mode)
        assert err.value.table == (TABLES.criteria, TABLES.pairs, TABLES.cohort, "the manifest")[step], str(err.value.__cause__)[:800]
        assert contents(store) == before and store.versions() == version, step
        assert len(folders(tmp_path)) == len(kept) + 1  # what this one staged; the one before is cleared
    other = write(spark, tmp_path, (5,), name="U", mode="append").store  # another scenario leaves it
    assert len(folders(tmp_path)) == len(kept) + 2
    after = contents(write(spark, tmp_path, (1, 2), mode=mode).store)
    n = {"append": 1 + 2 + 1, "replace": 2 + 1, "create": 2}[mode]
    assert len(after[TABLES.cohort]) == n and len(folders(tmp_path)) == len(kept) + 2
    other.vacuum()
    assert contents(store) == after


def test_a_reader_of_the_former_version_is_not_disturbed(spark, tmp_path):
    store = write(spark, tmp_path).store
    old = store.read(TABLES.cohort)
    write(spark, tmp_path, (1, 2, 3), mode="replace")
    assert old.count() == 1 and store.read(TABLES.cohort).count() == 3
    assert [len(t.parts) for t in store.tables().values()] == [1, 1, 1]


def test_stored_equals_direct_for_any_name(spark, tmp_path):
    for name in ("", "a/b='c' %2F ü", "T"):
        store = write(spark, tmp_path, (1, 2), name=name).store
        direct = run_scenario(spark, inputs(spark, (1, 2)), config(spark, name), name=name, as_of_year=2025)
        for table, rows in ((TABLES.pairs, direct.pairs["12"]), (TABLES.cohort, direct.cohort)):
            got = store.read(table, name).select(rows.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())) and got.count() == 2
    assert store.read(TABLES.cohort).count() == 6
    with pytest.raises(KeyError):
        store.read("no_such_table")


def test_commits_at_the_same_time(spark, tmp_path):
    store = R.ResultStore(spark, str(tmp_path))
    rows = lambda s: spark.createDataFrame([(1, s)], "x long, scenario string")
    a, b = store.begin("A"), store.begin("B")
    a.write(rows("A"), "t")
    b.write(rows("B"), "t")
    assert store.tables() == {}
    real, taken = R.ResultStore._publish, []

    def slow(self, version, tables):
        if not taken:  # another run takes the version first
            taken.append(version)
            assert a.commit() == 1
        return real(self, version, tables)

    R.ResultStore._publish = slow
    try:
        assert b.commit() == 2
    finally:
        R.ResultStore._publish = real
    assert {r.scenario for r in store.read("t").collect()} == {"A", "B"}
    assert not real(store, 2, {})  # a taken version stays
    late, again = store.begin("A"), store.begin("A")
    with pytest.raises(R.CommitConflict):  # cleared by the scenario's next run
        late.commit()
    with pytest.raises(SchemaMismatch):
        again.write(rows("A").withColumn("y", F.lit(1)), "t")
    with pytest.raises(Exception, match="another scenario"):
        again.write(rows("B"), "t")
    again.abandon()
    assert store.read("t").count() == 2


def test_counts_scan_each_table_once(spark, tmp_path):
    done = write(spark, tmp_path, (1, 2))
    assert {r.table_name: r.n_rows for r in done.counts.collect()} == {
        "criterion_1": 2, "criterion_2": 2, "criterion_3": 2, "pair_12": 2, "cohort": 2}
    plan = done.counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3, plan
