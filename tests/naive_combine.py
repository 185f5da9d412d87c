"""Event-by-event combine: the test oracle for ``cohortlab.operators.combine``.

Pairs every left event with every right event of the patient (inner join for
AND, full outer join for OR), tests the gap, coalesces, takes DISTINCT, as
the direct SQL form does. Its cost grows with left x right events per
patient, so it lives here, for tests and measurements only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.predicates import _COMPARE, day_gap, sentinel_date
from cohortlab.operators.combine import _empty, _prepare, output_columns
from cohortlab.spec import GAP_OPS, LOGIC_AND, PairSpec


def gap_test(start: Column, end: Column, op: str, days: int) -> Column:
    """Pairwise test ``day_gap(start, end) <op> days``.

    A blank operator means no test (true); an unknown one keeps nothing.
    """
    if op == "":
        return F.lit(True)
    if op not in GAP_OPS:
        return F.lit(False)
    return _COMPARE[op](day_gap(start, end), F.lit(int(days)))


def combine_naive(
    left: DataFrame, right: DataFrame, pair: PairSpec, keep_date: bool = True, scenario: str | None = None
) -> DataFrame:
    """Pair every left event with every right event of the patient, test,
    coalesce, distinct."""
    left, right, dead = _prepare(left, right, pair, keep_date, scenario)
    if dead:
        return _empty(left, keep_date)
    l, r = left.alias("l"), right.alias("r")
    how = "inner" if pair.logic == LOGIC_AND else "full"
    cond = (F.col("l.patient_id") == F.col("r.patient_id")) & (F.col("l.scenario") == F.col("r.scenario"))
    test = gap_test(
        sentinel_date(F.col("l.service_date")), sentinel_date(F.col("r.service_date")), pair.gap_op, pair.gap_days
    )
    cols = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in output_columns(keep_date)]
    return l.join(r, cond, how).where(test).select(*cols).distinct()
