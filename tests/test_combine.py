"""Combine: ledger cases S16-S20 and the reduced form against the naive one."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators.combine import combine
from naive_combine import combine_naive
from cohortlab.sources.schemas import PAIR_COLUMNS, result_schema
from cohortlab.spec import PairSpec

SCHEMA = result_schema(PAIR_COLUMNS)


def ev(pid, date, group="g", scen="T", gender="F", source="Dx"):
    d = None if date is None else dt.date.fromisoformat(date)
    return (pid, d, 1980, gender, "CA", 45, group, source, "31-50", scen)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def both(left, right, pair, keep_date=True, scenario=None):
    a = combine(left, right, pair, keep_date, scenario)
    b = combine_naive(left, right, pair, keep_date, scenario)
    return a, b


def _key(row):
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def same(a, b) -> bool:
    """Equal as multisets (results here are small enough to collect)."""
    return sorted(map(_key, a.collect())) == sorted(map(_key, b.collect()))


def test_gate_exact_logic(spark):
    l = frame(spark, [ev(1, "2020-01-01")])
    r = frame(spark, [ev(1, "2020-02-01")])
    for logic in ("and", None, "XOR"):  # S16: unknown logic gives no rows
        a, b = both(l, r, PairSpec("12", logic))
        assert a.count() == 0 and b.count() == 0
    assert combine(l, r, PairSpec("12", "AND")).count() == 1


def test_gap_signs_and_operators(spark):
    l = frame(spark, [ev(1, "2020-01-10")])
    r = frame(spark, [ev(1, "2020-01-01"), ev(1, "2020-01-20")])
    expect = {(">", 9): 1, (">", 10): 0, (">=", 10): 1, ("<", -9): 0, ("<", -8): 1,
              ("<=", -9): 1, ("", 0): 1, ("=", 0): 0}
    for (op, days), n in expect.items():  # S17: gap = right - left, signed days
        a, b = both(l, r, PairSpec("12", "AND", op, days))
        assert a.count() == n == b.count(), (op, days)


def test_or_sentinel_for_one_sided_patients(spark):
    l = frame(spark, [ev(1, "2020-01-10"), ev(2, "2020-01-10")])
    r = frame(spark, [ev(1, "2020-01-20"), ev(3, "2020-03-01")])
    # S18: left-only 2 sees right date 1900-01-01 (huge negative gap),
    # right-only 3 sees left date 1900-01-01 (huge positive gap)
    got = {op: sorted(x.patient_id for x in combine(l, r, PairSpec("12", "OR", op, 5)).collect())
           for op in (">", "<")}
    assert got == {">": [1, 3], "<": [2]}
    for op in (">", "<", ">=", "<=", ""):
        assert same(*both(l, r, PairSpec("12", "OR", op, 5)))


def test_left_row_wins_and_null_group_is_filled(spark):
    l = frame(spark, [ev(1, "2020-01-10", group=None)])
    r = frame(spark, [ev(1, "2020-01-20", group="a", source="Px"), ev(1, "2020-01-21", group="b"),
                      ev(1, "2020-01-01", group="c")])
    a, b = both(l, r, PairSpec("12", "AND", ">", 0))
    # S19: one output row per passing right group; date and source from left
    assert sorted((x.code_group, x.source, str(x.service_date)) for x in a.collect()) == [
        ("a", "Dx", "2020-01-10"), ("b", "Dx", "2020-01-10")]
    assert same(a, b)


def test_scenario_is_a_join_key(spark):
    l = frame(spark, [ev(1, "2020-01-10", scen="A"), ev(1, "2020-01-10", scen="B", group="x")])
    r = frame(spark, [ev(1, "2020-01-20", scen="B")])
    a, b = both(l, r, PairSpec("12", "OR"), scenario="A")
    assert [x.scenario for x in a.collect()] == ["A"] and same(a, b)
    a, b = both(l, r, PairSpec("12", "AND"), scenario="B")
    assert [x.code_group for x in a.collect()] == ["x"] and same(a, b)


def test_cohort_drops_date_but_gaps_use_it(spark):
    l = frame(spark, [ev(1, "2020-01-01"), ev(1, "2020-06-01")])
    r = frame(spark, [ev(1, "2020-03-01")])
    a, b = both(l, r, PairSpec("123", "AND", "<", 0), keep_date=False)
    assert a.count() == 1 and "service_date" not in a.columns and same(a, b)


def _random_events(rng, n_cases):
    left, right = [], []
    groups, genders, sources = ["g1", "g2", None], ["F", None], ["Dx", "Px"]
    for case in range(n_cases):
        scen = f"s{case}"
        for pid in range(rng.randint(0, 3)):
            for side, n in ((left, rng.randint(0, 4)), (right, rng.randint(0, 4))):
                for _ in range(n):
                    date = None if rng.random() < 0.1 else (
                        dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(-40, 40))).isoformat()
                    side.append(ev(pid, date, rng.choice(groups), scen, rng.choice(genders),
                                   rng.choice(sources)))
    return left, right


@pytest.mark.parametrize("logic", ["AND", "OR"])
@pytest.mark.parametrize("keep_date", [True, False])
def test_reduced_equals_naive_random(spark, logic, keep_date):
    rng = random.Random(7 + (logic == "OR") + 2 * keep_date)
    left, right = _random_events(rng, 120)
    l, r = frame(spark, left).cache(), frame(spark, right).cache()
    for op, days in ((">", 10), ("<", -5), (">=", 0), ("<=", 3), ("", 0), ("=", 0), (">", -40000),
                     ("<", 40000)):
        a, b = both(l, r, PairSpec("x", logic, op, days), keep_date)
        assert same(a, b), (logic, op, days, keep_date)


def test_empty_sides(spark):
    l = frame(spark, [ev(1, "2020-01-01")])
    e = frame(spark, [])
    for logic in ("AND", "OR"):
        for x, y in ((l, e), (e, l), (e, e)):
            assert same(*both(x, y, PairSpec("12", logic, ">", 0)))
    assert combine(l, e, PairSpec("12", "OR", "<", 0)).count() == 1
    assert combine(e, l, PairSpec("12", "OR", ">", 0)).count() == 1
    assert F is not None


def test_fast_path_on_complete_input(spark):
    rng = random.Random(11)
    left, right = _random_events(rng, 80)
    left = [row for row in left if None not in row]  # no NULL attribute or date
    l, r = frame(spark, left).cache(), frame(spark, right).cache()
    for logic in ("AND", "OR"):
        for op, days in ((">", 5), ("<=", 0), ("", 0)):
            pair = PairSpec("x", logic, op, days)
            for keep in (True, False):
                a = combine(l, r, pair, keep, left_complete=True, left_dated=True)
                assert same(a, combine_naive(l, r, pair, keep)), (logic, op, keep)
