"""Any number of criteria: a four-criterion scenario folds 1x2, x3, x4; twelve fold as well."""

from __future__ import annotations

import datetime as dt

import pytest

from naive_combine import combine_naive
from cohortlab.operators.scenario import load_scenario
from cohortlab.plans.scenario_run import ResultTables, run_scenario, write_scenario
from cohortlab.sources.schemas import config_schema, pair_keys
from cohortlab.sources.tables import read_config
from conftest import make_inputs


def test_four_criteria(spark):
    d = dt.date.fromisoformat
    crit = [
        ("A", "GA", d("2020-01-01"), d("2020-12-31"), "<=", 2000, "OR", 1),
        ("B", "GB", d("2020-01-01"), d("2020-12-31"), "<=", 2000, "OR", 1),
        ("C", "GC", d("2020-01-01"), d("2020-12-31"), "<=", 2000, "OR", 1),
        ("D", "GD", d("2020-01-01"), d("2020-12-31"), ">=", 1900, "OR", 1),
    ]
    pairs = [("AND", ">", 0), ("OR", None, None), ("AND", "<=", 400)]
    row = ["Q", dt.datetime(2026, 1, 1)]
    for c in crit:
        row += list(c)
    for p in pairs:
        row += list(p)
    schema = config_schema(4)
    assert pair_keys(4) == ["12", "123", "1234"]
    cfg = spark.createDataFrame([tuple(row)], schema)
    inputs = make_inputs(
        spark,
        dx=[(1, "2020-01-01", 1, "A"), (1, "2020-02-01", 2, "B"), (2, "2020-03-01", 3, "A"),
            (2, "2020-01-01", 4, "B"), (3, "2020-05-01", 5, "C"), (1, "2020-06-01", 6, "D"),
            (3, "2020-06-01", 7, "D")],
        patients=[(1, "F", "CA", 1980), (2, "M", "NY", 1990), (3, "F", "TX", 1970)],
    )
    spec, _, _ = load_scenario(cfg)
    assert len(spec.criteria) == 4 and [p.key for p in spec.pairs] == ["12", "123", "1234"]
    fast = run_scenario(spark, inputs, cfg, as_of_year=2025)
    slow = run_scenario(spark, inputs, cfg, as_of_year=2025, combine_fn=combine_naive)
    for key in ("12", "123", "1234"):
        a = sorted(map(str, fast.pairs[key].collect()))
        b = sorted(map(str, slow.pairs[key].collect()))
        assert a == b, key
    # 12: patient 1 (B after A); 123: OR with C adds patient 3; 1234: AND with D within 400 days
    assert {r.patient_id for r in fast.pairs["12"].collect()} == {1}
    assert {r.patient_id for r in fast.pairs["123"].collect()} == {1, 3}
    assert {r.patient_id for r in fast.cohort.collect()} == {1, 3}
    assert "service_date" not in fast.cohort.columns


@pytest.mark.parametrize("n", [4, 12])
def test_stored_config_and_tables_equal_the_direct_run(spark, tmp_path, n):
    """A stored config of ``n`` criteria, written in every mode."""
    d = dt.date.fromisoformat
    row = ["Q", dt.datetime(2026, 1, 1)]
    for i in range(n):
        row += [f"K{i}", "G", d("2020-01-01"), d("2020-12-31"), "<=", 2000, "OR", 1]
    for i in range(n - 1):
        row += [("OR", "AND")[i % 2], (">", None, "<=")[i % 3], (0, None, 400)[i % 3]]
    path = str(tmp_path / "config")
    spark.createDataFrame([tuple(row)], config_schema(n)).write.parquet(path)
    cfg = read_config(spark, path)
    claims = [(p, f"2020-{1 + (p * 5 + i * 7) % 12:02d}-{1 + (p + i) % 28:02d}", 100 * p + i, f"K{i}")
              for p in range(1, 9) for i in range(n) if (p * 3 + i) % 4]
    inputs = make_inputs(spark, dx=claims, patients=[(p, "F", "CA", 1950 + p) for p in range(1, 8)])
    slow = run_scenario(spark, inputs, cfg, as_of_year=2025, combine_fn=combine_naive)
    keys = pair_keys(n)
    want = {k: sorted(map(str, slow.pairs[k].select(sorted(slow.pairs[k].columns)).collect())) for k in keys}
    assert len(want[keys[-1]]) > 0 and list(slow.pairs) == keys
    tables = ResultTables(f"n{n}_crit", f"n{n}_pair", f"n{n}_cohort")
    for mode in ("create", "replace", "create", "auto"):
        done = write_scenario(spark, inputs, cfg, tables, mode=mode, as_of_year=2025, root=str(tmp_path / "t"))
        copies = 2 if mode == "auto" else 1
        pairs = spark.table(tables.pairs)
        for k in keys[:-1]:
            got = pairs.where(pairs.pair == k).drop("pair")
            assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(want[k] * copies), (mode, k)
        got = spark.table(tables.cohort)
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(want[keys[-1]] * copies), mode
        assert done.counts.count() == 2 * n - 1
