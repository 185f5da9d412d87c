"""Criterion operator on hand-made rows (ledger S6, S8, S9, S11-S15, bands)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions.predicates import age, age_band
from cohortlab.operators.criterion import criterion_events
from cohortlab.operators.scenario import load_scenario
from conftest import criterion_cfg, make_config, make_inputs

PATIENTS = [
    (1, "F", "CA", 1980),
    (2, "M", "NY", 1990),
    (3, "F", "TX", None),  # no birth year
    (5, "M", "WA", 2010),
]


def run(spark, inputs, *crits, as_of=2025):
    cfg = make_config(spark, "T", "2026-01-01 00:00:00", list(crits))
    spec, _, codes = load_scenario(cfg)
    return criterion_events(inputs, codes, spec, as_of)


def rows_of(df, n=1):
    return sorted(
        (r.patient_id, str(r.service_date), r.source, r.code_group)
        for r in df.where(F.col("criterion") == n).collect()
    )


def test_window_inclusive_and_code_on_every_channel(spark):
    inputs = make_inputs(
        spark,
        dx=[(1, "2020-01-01", 10, "A"), (1, "2020-12-31", 11, "A"), (1, "2021-01-01", 12, "A"),
            (1, "2019-12-31", 13, "A"), (1, None, 14, "A")],
        px=[(1, "2020-06-01", 20, "A")],
        rx=[(1, "2020-06-02", 30, "A")],
        patients=PATIENTS,
    )
    out = rows_of(run(spark, inputs, criterion_cfg([("A", "G")])))
    # S11: both bounds kept, outside and NULL dates dropped; S6: all channels
    assert out == [
        (1, "2020-01-01", "Dx", "G"), (1, "2020-06-01", "Px", "G"),
        (1, "2020-06-02", "Rx", "G"), (1, "2020-12-31", "Dx", "G"),
    ]


def test_missing_patient_and_null_birth_year_never_survive(spark):
    inputs = make_inputs(
        spark,
        dx=[(1, "2020-01-01", 1, "A"), (3, "2020-01-01", 2, "A"), (4, "2020-01-01", 3, "A")],
        patients=PATIENTS,
    )
    out = run(spark, inputs, criterion_cfg([("A", "G")], birth_year=2020))
    assert [r.patient_id for r in out.collect()] == [1]  # S9


def test_birth_operator_switch(spark):
    inputs = make_inputs(spark, dx=[(p, "2020-01-01", p, "A") for p in (1, 2, 5)], patients=PATIENTS)
    le = run(spark, inputs, criterion_cfg([("A", "G")], birth_op="<=", birth_year=1990))
    ge = run(spark, inputs, criterion_cfg([("A", "G")], birth_op=">=", birth_year=1990))
    assert sorted(r.patient_id for r in le.collect()) == [1, 2]
    assert sorted(r.patient_id for r in ge.collect()) == [2, 5]
    for op in ("=", "", None):  # S8: anything else keeps nothing
        assert run(spark, inputs, criterion_cfg([("A", "G")], birth_op=op)).count() == 0


def test_group_logic(spark):
    inputs = make_inputs(
        spark,
        dx=[(1, "2020-01-01", 1, "A"), (1, "2020-01-02", 2, "B"), (2, "2020-01-01", 3, "A")],
        patients=PATIENTS,
    )
    codes = [("A", "G1"), ("B", "G2")]
    both = run(spark, inputs, criterion_cfg(codes, logic="AND"))
    assert {r.patient_id for r in both.collect()} == {1}
    for logic in ("OR", "and", None):  # S12: anything but 'AND' needs one group
        assert {r.patient_id for r in run(spark, inputs, criterion_cfg(codes, logic=logic)).collect()} == {1, 2}


def test_all_groups_null(spark):
    inputs = make_inputs(spark, dx=[(1, "2020-01-01", 1, "A")], patients=PATIENTS)
    codes = [("A", None)]
    # S12: AND needs 0 groups, so everyone passes; otherwise 1 group, no one
    assert run(spark, inputs, criterion_cfg(codes, logic="AND")).count() == 1
    assert run(spark, inputs, criterion_cfg(codes, logic="OR")).count() == 0


def test_claim_count_pools_channels_ignores_null_ids(spark):
    inputs = make_inputs(
        spark,
        dx=[(1, "2020-01-01", 7, "A"), (2, "2020-01-01", 8, "A"), (2, "2020-01-05", None, "A")],
        px=[(1, "2020-01-02", 7, "A"), (2, "2020-01-02", 9, "A")],
        patients=PATIENTS,
    )
    out = run(spark, inputs, criterion_cfg([("A", "G")], min_claims=2))
    # S13: patient 1 has claim 7 in two channels = one claim
    assert {r.patient_id for r in out.collect()} == {2}
    assert run(spark, inputs, criterion_cfg([("A", "G")], min_claims=None)).count() == 0


def test_distinct_without_claim_id(spark):
    inputs = make_inputs(
        spark, dx=[(1, "2020-01-01", 1, "A"), (1, "2020-01-01", 2, "A")], patients=PATIENTS
    )
    out = run(spark, inputs, criterion_cfg([("A", "G")], min_claims=2))
    assert out.count() == 1  # S15


def test_code_in_two_groups_and_several_criteria(spark):
    inputs = make_inputs(spark, dx=[(1, "2020-01-01", 1, "A")], patients=PATIENTS)
    out = run(
        spark, inputs,
        criterion_cfg([("A", "G1"), ("A", "G2")], logic="AND"),
        criterion_cfg([("A", "H")], start="2021-01-01", end="2021-12-31"),
        criterion_cfg([("A", "K")]),
    )
    assert rows_of(out, 1) == [(1, "2020-01-01", "Dx", "G1"), (1, "2020-01-01", "Dx", "G2")]
    assert rows_of(out, 2) == []
    assert rows_of(out, 3) == [(1, "2020-01-01", "Dx", "K")]


def test_age_bands(spark):
    years = [2025 - a for a in (0, 18, 19, 30, 31, 50, 51, 60, 61, 90)] + [None]
    df = spark.createDataFrame([(y,) for y in years], "birth_year int")
    out = df.select(age_band(age("birth_year", 2025), F.col("birth_year")).alias("b")).collect()
    assert [r.b for r in out] == [
        "0-18", "0-18", "19-30", "19-30", "31-50", "31-50", "51-60", "51-60", "60+", "60+", "NA",
    ]


def test_repeated_patient_rows_count_once(spark):
    inputs = make_inputs(spark, dx=[(1, "2020-01-01", 1, "A")], patients=[(1, "F", "CA", 1980), (1, "F", "CA", 1980)])
    assert run(spark, inputs, criterion_cfg([("A", "G")])).count() == 1


def test_opaque_ids_and_rename(spark):
    """Ids keep their type: strings here; stored columns have names of their own."""
    from cohortlab.plans.scenario_run import run_scenario
    from cohortlab.sources.tables import ClaimInputs, read_channel, read_patients

    rename = {"patient_id": "member", "service_date": "day", "claim_id": "number", "code": "diagnosis_code"}
    stored = spark.createDataFrame(
        [("P-1", "2020-01-01", "CLM-9A", "A"), ("P-1", "2020-02-01", "CLM-9B", "A"), ("P-2", "2020-01-01", "CLM-9A", "A")],
        "member string, day string, number string, diagnosis_code string")
    dx = read_channel(spark, stored, rename)
    none = spark.createDataFrame([], "patient_id string, service_date date, claim_id long, code string")
    patients = spark.createDataFrame([("P-1", "F", "CA", 1980), ("P-2", "M", "NY", 1990)],
                                     "patient_id string, gender string, state string, birth_year int")
    inputs = ClaimInputs(dx, read_channel(spark, none), read_channel(spark, none), read_patients(spark, patients))
    cfg = make_config(spark, "T", "2026-01-01 00:00:00", [criterion_cfg([("A", "G")], min_claims=2), criterion_cfg([("A", "G")])])
    res = run_scenario(spark, inputs, cfg, as_of_year=2025)
    assert {r.patient_id for r in res.criterion(1).collect()} == {"P-1"}
    assert {r.patient_id for r in res.criterion(2).collect()} == {"P-1", "P-2"}
    assert {r.patient_id for r in res.pairs["12"].collect()} == {"P-1"}


def test_either_side_of_every_size_switch_gives_the_same_rows(spark, monkeypatch):
    from cohortlab.operators import criterion, scenario

    codes = [(f"K{i}", f"G{i % 3}") for i in range(12)] + [("K1", None)]
    inputs = make_inputs(
        spark, dx=[(p, f"2020-01-{1 + i:02d}", 100 * p + i, f"K{(p + i) % 14}") for p in (1, 2, 5) for i in range(9)], patients=PATIENTS)
    crits = [criterion_cfg(codes, logic="AND", birth_year=2020), criterion_cfg(codes[:5], birth_op=">=", birth_year=1900)]

    def result():
        out = run(spark, inputs, *crits)
        return sorted(map(str, out.select(sorted(out.columns)).collect()))

    want = result()
    assert len(want) > 5
    from cohortlab.operators import code_join

    for module, name, value in ((scenario, "SCAN_CODE_FILTER_MAX", 0), (criterion, "SCAN_FILTER_CODES", 0), (criterion, "MASK_BITS", 1),
                                (criterion, "BROADCAST_CODES_BYTES", 0), (code_join, "HOT_SHARE", 3), (code_join, "HOT_ROWS", 0)):
        with monkeypatch.context() as m:
            if module is code_join:
                m.setattr(criterion, "BROADCAST_CODES_BYTES", 0)
                m.setattr(code_join, "HOT_SHARE", 5)
            m.setattr(module, name, value)
            assert result() == want, name
