"""A hot patient holding most of the rows: results stay exact, nothing pairs.

The criterion is checked against the DuckDB oracle SQL run on the same
hand-made tables; the combine against a direct pandas evaluation of the
rule, on a size where the event-by-event form would build 400 million pairs.
"""

from __future__ import annotations

import datetime as dt
import random
import time

import duckdb
import pandas as pd

from cohortlab.operators.combine import combine
from cohortlab.operators.criterion import criterion_events
from cohortlab.operators.scenario import load_scenario
from cohortlab.plans.oracle import Answer
from cohortlab.sources.fixtures import scenario_config
from cohortlab.sources.schemas import CRITERION_COLUMNS, PAIR_COLUMNS, result_schema
from cohortlab.spec import PairSpec
from conftest import make_inputs

HOT = 7


def _claims(rng: random.Random):
    rows = []
    start = dt.date(1995, 1, 1)
    for i in range(30_000):  # the hot patient: most of all claims
        d = start + dt.timedelta(days=rng.randint(0, 1800))
        rows.append((HOT, d.isoformat(), 1_000_000 + i // 3, f"Brand#{rng.randint(1, 12)}"))
    for p in range(1, 60):
        for i in range(rng.randint(1, 20)):
            d = start + dt.timedelta(days=rng.randint(-100, 2000))
            rows.append((p, d.isoformat(), p * 1000 + i // 2, f"Brand#{rng.randint(1, 12)}"))
    return rows


def test_hot_patient_criterion_matches_oracle(spark):
    rng = random.Random(3)
    dx = _claims(rng)
    patients = [(p, "F" if p % 2 else "M", "CA", 1950 + p % 50) for p in range(1, 60)]
    inputs = make_inputs(spark, dx=dx, patients=patients)
    spec, _, codes = load_scenario(scenario_config(spark))
    got = criterion_events(inputs, codes, spec, 2025, criteria=[1]).toPandas()

    con = duckdb.connect()
    con.register("dx_df", pd.DataFrame(dx, columns=["patient_id", "service_date", "claim_id", "code"]))
    con.execute("CREATE VIEW dx_events AS SELECT patient_id, CAST(service_date AS DATE) AS service_date, "
                "claim_id, code FROM dx_df")
    for v in ("px_events", "rx_events"):
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM dx_events WHERE false")
    con.register("p_df", pd.DataFrame(patients, columns=["patient_id", "gender", "state", "birth_year"]))
    con.execute("CREATE VIEW patients AS SELECT patient_id, gender, state, "
                "CAST(birth_year AS INTEGER) AS birth_year FROM p_df")
    a = Answer(inputs={})
    sql = a.sql(f"SELECT {', '.join(CRITERION_COLUMNS)} FROM ({a.rows(a.criterion(1))})")
    want = con.execute(sql).df()

    key = lambda df: sorted(map(tuple, df[list(CRITERION_COLUMNS)].astype(str).values.tolist()))
    assert len(got) > 0 and (got.patient_id == HOT).any()
    assert key(got) == key(want)


def test_hot_patient_combine_has_no_pair_blowup(spark):
    rng = random.Random(5)
    base = dt.date(2000, 1, 1)

    def ev(pid, d, g):
        return (pid, d, 1980, "F", "CA", 45, g, "Dx", "31-50", "T")

    left = [ev(HOT, base + dt.timedelta(days=rng.randint(0, 3000)), rng.choice(["a", "b"])) for _ in range(20_000)]
    right = [ev(HOT, base + dt.timedelta(days=rng.randint(0, 3000)), "c") for _ in range(20_000)]
    for p in range(1, 40):
        left += [ev(p, base + dt.timedelta(days=rng.randint(0, 300)), "a") for _ in range(5)]
        right += [ev(p, base + dt.timedelta(days=rng.randint(0, 300)), "c") for _ in range(5)]
    schema = result_schema(PAIR_COLUMNS)
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)

    t0 = time.perf_counter()
    got = combine(l, r, PairSpec("12", "AND", ">", 30), keep_date=True).toPandas()
    elapsed = time.perf_counter() - t0

    lp = pd.DataFrame(left, columns=list(PAIR_COLUMNS)).drop_duplicates()
    rmax = pd.DataFrame(right, columns=list(PAIR_COLUMNS)).groupby("patient_id").service_date.max()
    lp = lp[lp.patient_id.isin(rmax.index)]
    ok = lp.apply(lambda x: (rmax[x.patient_id] - x.service_date).days > 30, axis=1)
    want = lp[ok]
    key = lambda df: sorted(map(tuple, df[list(PAIR_COLUMNS)].astype(str).values.tolist()))
    assert key(got) == key(want)
    assert elapsed < 120, elapsed
