from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlab.plans.session import local_session  # noqa: E402
from cohortlab.sources.schemas import CHANNEL_SCHEMA, PATIENT_SCHEMA, config_schema  # noqa: E402
from cohortlab.sources.tables import ClaimInputs  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, shuffle_partitions=8, app="cohortlab-tests")
    yield s
    s.stop()


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def make_inputs(spark, dx=(), px=(), rx=(), patients=()) -> ClaimInputs:
    """Hand-made claim channels: rows are (patient_id, date str, claim_id, code)."""

    def ch(rows):
        return spark.createDataFrame(
            [(p, None if d is None else D(d), c, k) for p, d, c, k in rows], CHANNEL_SCHEMA
        )

    return ClaimInputs(
        dx=ch(dx), px=ch(px), rx=ch(rx), patients=spark.createDataFrame(list(patients), PATIENT_SCHEMA)
    )


def criterion_cfg(codes, start="2020-01-01", end="2020-12-31", birth_op="<=", birth_year=2000,
                  logic="OR", min_claims=1):
    return dict(codes=codes, start=start, end=end, birth_op=birth_op, birth_year=birth_year,
                logic=logic, min_claims=min_claims)


def make_config(spark, scenario="T", at="2026-01-01 00:00:00", criteria=(), pairs=(("AND", None, None), ("OR", None, None))):
    """Wide config rows from up to three criterion dicts (see ``criterion_cfg``)."""
    crits = list(criteria) + [criterion_cfg([])] * (3 - len(criteria))
    n_rows = max(1, max(len(c["codes"]) for c in crits))
    rows = []
    for i in range(n_rows):
        row = [scenario, None if at is None else dt.datetime.fromisoformat(at)]
        for c in crits:
            code, group = c["codes"][i] if i < len(c["codes"]) else (None, None)
            row += [
                code, group,
                None if c["start"] is None else D(c["start"]),
                None if c["end"] is None else D(c["end"]),
                c["birth_op"], c["birth_year"], c["logic"], c["min_claims"],
            ]
        for logic, op, days in pairs:
            row += [logic, op, days]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, config_schema(3))
