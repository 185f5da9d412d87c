"""Column expressions: age, age band, birth-year test, day gap.

All are built-in ``pyspark.sql.functions`` expressions, so they compile into
whole-stage codegen. Operators arrive as Python strings from the scenario and
are turned into Column operators here, on the driver, so Catalyst sees
literals (and can push them into Parquet scans).
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import (
    AGE_BAND_UNKNOWN,
    AGE_BANDS,
    BIRTH_OP_GE,
    BIRTH_OP_LE,
    GAP_OPS,
    SENTINEL_DATE,
)

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age(birth_year: Column | str, as_of_year: int | None = None) -> Column:
    """Whole years between the birth year and ``as_of_year`` (default: now).

    The reference uses the run date; pin ``as_of_year`` for repeatable runs.
    """
    year = F.year(F.current_date()) if as_of_year is None else F.lit(int(as_of_year))
    return (year - _col(birth_year)).cast("int")


def age_band(age_col: Column | str, birth_year: Column | str) -> Column:
    """Band label; ``NA`` for a missing birth year or an age no band covers."""
    a = _col(age_col)
    expr = F.when(_col(birth_year).isNull(), F.lit(AGE_BAND_UNKNOWN))
    for label, lo, hi in AGE_BANDS:
        if lo is None:
            cond = a <= hi
        elif hi is None:
            cond = a >= lo
        else:
            cond = a.between(lo, hi)
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(AGE_BAND_UNKNOWN))


def birth_year_test(birth_year: Column | str, op: str | None, bound: int | None) -> Column:
    """``birth_year <= bound`` or ``>= bound``; any other operator: no rows."""
    by = _col(birth_year)
    if bound is None:
        return F.lit(False)
    if op == BIRTH_OP_LE:
        return by <= F.lit(int(bound))
    if op == BIRTH_OP_GE:
        return by >= F.lit(int(bound))
    return F.lit(False)


def sentinel_date(d: Column | str) -> Column:
    """Event date, or 1900-01-01 where it is missing (typed literal)."""
    return F.coalesce(_col(d), F.lit(SENTINEL_DATE))


def day_gap(start: Column | str, end: Column | str) -> Column:
    """Signed calendar days ``end - start`` (two-argument ``datediff``)."""
    return F.datediff(_col(end), _col(start))


def gap_exists(
    lmin: Column, lmax: Column, rmin: Column, rmax: Column, op: str, days: int
) -> Column:
    """Is there a left date in [lmin, lmax] and a right date in [rmin, rmax]
    (both sets, given by their extremes) whose gap passes ``op days``?

    ``right - left`` is largest at (lmin, rmax) and smallest at (lmax, rmin),
    so ``>``/``>=`` need only the first pair and ``<``/``<=`` the second.
    """
    if op == "":
        return F.lit(True)
    if op not in GAP_OPS:
        return F.lit(False)
    if op in (">", ">="):
        return _COMPARE[op](day_gap(lmin, rmax), F.lit(int(days)))
    return _COMPARE[op](day_gap(lmax, rmin), F.lit(int(days)))


def all_not_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))


def case_by(key: Column | str, values: dict[int, Column], default: Column) -> Column:
    """``CASE key WHEN k THEN v ... ELSE default`` over a small literal map."""
    k = _col(key)
    expr = None
    for kv, v in values.items():
        expr = F.when(k == F.lit(kv), v) if expr is None else expr.when(k == F.lit(kv), v)
    return default if expr is None else expr.otherwise(default)
