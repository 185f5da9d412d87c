"""Pairwise combine of two event sets: AND / OR with a signed day-gap test.

Semantics (per scenario, per patient): the AND form inner-joins left and
right events on patient; the OR form full-outer-joins them. A row survives
if ``datediff(right_date, left_date) <op> days`` holds, with a missing date
read as 1900-01-01 (so left-only rows of the OR form test against that date
on the right, right-only rows against it on the left). Each output column is
``coalesce(left, right)``; the result is distinct. A blank operator means no
test, an unknown operator or logic gives no rows.

The direct SQL form joins every left event with every right event of the
patient (the test oracle in ``tests/naive_combine.py`` does exactly that).
``combine`` gives the same rows without pairing events:

* the right side only answers "is there a right date that passes?", and
  that needs only the patient's earliest and latest right date;
* left rows are first grouped by their output columns (earliest and latest
  left date per group), which is also what makes the result distinct;
* a left row with a NULL output column is filled from each passing right
  row, so those rows (rare: only NULL groups or NULL patient attributes)
  join the right side grouped by the fill columns instead, which has a few
  rows per patient (sources x groups), never one per event.

Every join has at most a handful of right rows per key, so a patient with a
third of all events does not multiply anything; left rows are aggregated
before they are shuffled to the join.

With one scenario (``scenario`` given) everything is keyed by the patient alone, so
events stored bucketed by patient are grouped and joined as they are stored, and so is a
running result made from them: a fold of many criteria shuffles no stored event.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import all_not_null, gap_exists, sentinel_date
from ..sources.schemas import ATTRIBUTE_COLUMNS, COHORT_COLUMNS, PAIR_COLUMNS
from ..spec import LOGIC_AND, LOGIC_OR, PairSpec

KEYS = ["scenario", "patient_id"]


def output_columns(keep_date: bool) -> tuple[str, ...]:
    return PAIR_COLUMNS if keep_date else COHORT_COLUMNS


def _empty(left: DataFrame, keep_date: bool) -> DataFrame:
    return left.select(*output_columns(keep_date)).where(F.lit(False))


def _for_scenario(df: DataFrame, scenario: str | None) -> DataFrame:
    return df if scenario is None else df.where(F.col("scenario") == F.lit(scenario))


def _prepare(left, right, pair: PairSpec, keep_date: bool, scenario: str | None):
    """Common gate: the scenario filter goes below the join (it is a join key,
    so filtering both inputs first is the same as filtering the output)."""
    left = _for_scenario(left, scenario)
    right = _for_scenario(right, scenario)
    dead = not pair.live
    return left, right, dead


def combine(
    left: DataFrame,
    right: DataFrame,
    pair: PairSpec,
    keep_date: bool = True,
    scenario: str | None = None,
    left_complete: bool | None = None,
    left_dated: bool | None = None,
    left_distinct: bool = False,
) -> DataFrame:
    """Same rows as the event-by-event form, without pairing events.

    ``left_complete=True`` promises no NULL attribute on the left and
    ``left_dated=True`` no NULL date; the fill paths (each an extra pass
    over the right side) are then left out. ``None`` (default) keeps them.
    ``left_distinct`` promises that no left row repeats another in the columns
    of a pair: with the date kept, grouping them would change nothing.
    """
    left, right, dead = _prepare(left, right, pair, keep_date, scenario)
    if dead:
        return _empty(left, keep_date)
    out = list(output_columns(keep_date))
    keys = KEYS
    if scenario is not None:  # one value: no key
        keys = [k for k in KEYS if k != "scenario"]
        out.remove("scenario")
    attrs = list(ATTRIBUTE_COLUMNS)
    group_cols = (["service_date"] if keep_date else []) + attrs
    how = "inner" if pair.logic == LOGIC_AND else "left"
    d = sentinel_date("service_date")
    sentinel = sentinel_date(F.lit(None).cast("date"))

    def passes(lmin="_lmin", lmax="_lmax") -> F.Column:
        # a missing right side (OR form, left-only patient) reads as 1900-01-01
        return gap_exists(
            F.col(lmin) if isinstance(lmin, str) else lmin,
            F.col(lmax) if isinstance(lmax, str) else lmax,
            F.coalesce(F.col("_rmin"), sentinel),
            F.coalesce(F.col("_rmax"), sentinel),
            pair.gap_op,
            pair.gap_days,
        )

    # Left side grouped by its output columns: earliest/latest (sentinel) date.
    if keep_date and left_distinct:
        grouped = left.select(*keys, *group_cols, d.alias("_lmin"), d.alias("_lmax"))
    else:
        grouped = left.groupBy(*keys, *group_cols).agg(F.min(d).alias("_lmin"), F.max(d).alias("_lmax"))
    complete = all_not_null(group_cols)
    fill_attrs = not left_complete
    fill_dates = keep_date and not left_dated

    # Right side: one pass over the raw rows. When more than the per-patient
    # summary is needed, group by the output columns first and derive the
    # coarser summaries from that (much smaller) result.
    if pair.logic == LOGIC_OR or fill_attrs or fill_dates:
        right_rows = right.groupBy(*keys, *group_cols).agg(F.min(d).alias("_rmin"), F.max(d).alias("_rmax"))
        per_patient = right_rows.groupBy(*keys).agg(F.min("_rmin").alias("_rmin"), F.max("_rmax").alias("_rmax"))
    else:
        right_rows = None
        per_patient = right.groupBy(*keys).agg(F.min(d).alias("_rmin"), F.max(d).alias("_rmax"))

    def prefixed(df: DataFrame, by: list[str]) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias("_r_" + c) for c in by], "_rmin", "_rmax")

    # 1. complete left rows: output is the left row itself.
    parts = [grouped.where(complete).join(per_patient, keys, how).where(passes()).select(*out)]

    # 2. left rows with a NULL attribute (date present or not output): fill
    #    from each passing right (attribute combination).
    incomplete = grouped.where(~complete)
    fill = [F.coalesce(F.col(c), F.col("_r_" + c)).alias(c) for c in attrs]
    if fill_attrs:
        dated = incomplete.where(F.col("service_date").isNotNull()) if keep_date else incomplete
        by_attr = right_rows if not keep_date else right_rows.groupBy(*keys, *attrs).agg(
            F.min("_rmin").alias("_rmin"), F.max("_rmax").alias("_rmax")
        )
        parts.append(
            dated.join(prefixed(by_attr, attrs), keys, how)
            .where(passes())
            .select(*keys, *(["service_date"] if keep_date else []), *fill)
            .select(*out)
        )

    # 3. left rows without a date whose date is output: the date comes from
    #    each passing right row too.
    if fill_dates:
        undated = incomplete.where(F.col("service_date").isNull())
        parts.append(
            undated.join(prefixed(right_rows, ["service_date"] + attrs), keys, how)
            .where(passes())
            .select(
                *keys,
                F.coalesce(F.col("service_date"), F.col("_r_service_date")).alias("service_date"),
                *fill,
            )
            .select(*out)
        )

    # 4. OR form: right-only patients, tested against 1900-01-01 on the left.
    if pair.logic == LOGIC_OR:
        left_keys = grouped.select(*keys).distinct()
        parts.append(
            right_rows.join(left_keys, keys, "left_anti")
            .where(
                gap_exists(sentinel, sentinel, F.col("_rmin"), F.col("_rmax"), pair.gap_op, pair.gap_days)
            )
            .select(*out)
        )

    if scenario is not None and len(parts) > 1:
        # Spark keeps a union's partitioning if the parts' keys are equal expressions; a key of the
        # union's own (an alias that differs by its metadata only, so it isn't dropped) makes them so
        own = {"union": uuid.uuid4().hex}
        parts = [p.withColumn("patient_id", F.col("patient_id").alias("patient_id", metadata=own)) for p in parts]
    result = reduce(lambda a, b: a.unionByName(b), parts)
    # Parts 1 and 4 are distinct by construction (grouped by the output
    # columns, one summary row per key) and disjoint (4 holds right-only
    # patients); only the fill paths can repeat a row.
    filled = len(parts) > (2 if pair.logic == LOGIC_OR else 1)
    result = result.distinct() if filled else result
    if scenario is not None:
        result = result.withColumn("scenario", F.lit(scenario)).select(*output_columns(keep_date))
    return result


__all__ = ["combine", "output_columns", "LOGIC_AND", "LOGIC_OR"]
