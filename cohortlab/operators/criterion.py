"""Criterion operator: match claims to code lists, qualify patients, emit events.

Long form: all criteria of a scenario run in one pass. The three channels are
scanned once (UNION ALL), joined to one code list that carries a
``criterion`` column, and every later step groups by ``criterion`` too, so
the work does not grow with the number of criteria.

Plan shape, chosen for skew and scale:

1. ``matched``  claims x code list (broadcast, size-checked; a larger list goes
   through ``operators.code_join``), date window per criterion. What the scan can
   drop by itself reaches it: the criteria's windows as disjoint intervals, each
   with the codes of the criteria that are open in it.
2. ``base``     distinct (criterion, patient, date, source, group, claim),
   written once to the shared scratch folder (see ``criterion_events``), so
   each claim table is read once. Partial aggregation collapses repeated
   lines before the shuffle.
3. ``qualified`` per (criterion, patient): distinct groups, counted as bits of mask
   words, and distinct claims, of which only as many as the threshold needs are
   shuffled.
4. ``eligible``  qualified patients x patient reference, birth-year test,
   age and band. The birth-year test depends on the patient only, so it can
   run after the counts without changing them; the patient join then sees
   one row per qualified patient instead of one per claim.
5. result       distinct event rows (no claim id) x eligible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import Interval, disjoint
from ..functions.predicates import age, age_band, birth_year_test, case_by
from ..plans.materialize import RunScratch, materialize
from ..sources.schemas import CRITERION_COLUMNS
from ..sources.tables import ClaimInputs
from ..spec import CriterionSpec, ScenarioSpec
from .code_join import join_codes
from .scenario import SCAN_CODE_FILTER_MAX, number_groups

# Code lists up to this many bytes are broadcast to the claim scan; the list's
# size is counted with the scenario's settings, before planning. A million
# codes take about 30 MB. A larger list is joined by ``operators.code_join``.
BROADCAST_CODES_BYTES = 64 << 20
# At most so many codes stand in one scan filter, over all its intervals.
SCAN_FILTER_CODES = 2 * SCAN_CODE_FILTER_MAX

EVENT_KEY = ["criterion", "patient_id"]


def _empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def _live(spec: ScenarioSpec, criteria: list[int] | None) -> list[CriterionSpec]:
    return [c for c in spec.criteria if c.live and (criteria is None or c.number in criteria)]


def code_list(codes: DataFrame, spec: ScenarioSpec, criteria: list[int] | None = None) -> tuple[DataFrame, bool]:
    """The code list restricted to live criteria; is it small enough to broadcast?

    ``group_idx`` numbers a criterion's distinct groups from 0 (``number_groups``).
    """
    crits = _live(spec, criteria)
    if "group_idx" not in codes.columns:
        codes = number_groups(codes)
    wanted = [c.number for c in crits]
    live = codes.where(F.col("criterion").isin(wanted)) if wanted else _empty_like(codes)
    return live, sum(c.code_bytes for c in crits) <= BROADCAST_CODES_BYTES


def scan_intervals(spec: ScenarioSpec, criteria: list[int] | None = None) -> list[Interval]:
    """The live criteria's windows as disjoint date intervals with the codes that
    count in each (None: not known on the driver, or too many for a filter)."""
    crits = _live(spec, criteria)
    windows = [(c.start, c.end, None if c.codes is None else frozenset(c.codes)) for c in crits]
    found = disjoint(windows)
    if sum(len(i.codes) for i in found if i.codes is not None) > SCAN_FILTER_CODES:
        found = disjoint([(start, end, None) for start, end, _ in windows])
    return found


def scan_filter(events: DataFrame, spec: ScenarioSpec, criteria: list[int] | None = None) -> DataFrame:
    """Claims that can match: in one of the intervals, with a code that counts in it.

    The dates stand in a filter of their own as well, so that partitions by date
    are pruned by it whatever the codes.
    """
    found = scan_intervals(spec, criteria)
    if not found:
        return _empty_like(events)
    d = F.col("service_date")
    inside = [d.between(F.lit(i.start), F.lit(i.end)) for i in found]
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    events = events.where(either(inside))
    if all(i.codes is None for i in found):
        return events
    if len({i.codes for i in found}) == 1:
        return events.where(F.col("code").isin(sorted(found[0].codes)))
    return events.where(either([t if i.codes is None else t & F.col("code").isin(sorted(i.codes)) for t, i in zip(inside, found)]))


def window_filter(spec: ScenarioSpec, date_col: str = "service_date") -> F.Column:
    d = F.col(date_col)
    return case_by(
        "criterion",
        {c.number: d.between(F.lit(c.start), F.lit(c.end)) for c in spec.criteria if c.live},
        F.lit(False),
    )


def match_events(
    events: DataFrame,
    codes: DataFrame,
    spec: ScenarioSpec,
    criteria: list[int] | None = None,
    scratch: RunScratch | None = None,
) -> DataFrame:
    """Claims on a criterion's code list, inside its date window.

    ``events`` is ``ClaimInputs.tagged_events()`` (or one tagged channel).
    Output: criterion, patient_id, service_date, claim_id, code_group, source.
    A code is tried on every channel (codes carry no coding system). ``scratch``:
    where a list too large to broadcast stores what its join needs twice.
    """
    live, broadcastable = code_list(codes, spec, criteria)
    crits = _live(spec, criteria)
    if not crits:
        return _empty_like(
            events.select(
                F.lit(0).alias("criterion"), "patient_id", "service_date", "claim_id",
                F.lit(None).cast("string").alias("code_group"), "source",
                F.lit(None).cast("int").alias("group_idx"),
            )
        )
    scan = scan_filter(events, spec, criteria)
    if broadcastable:
        joined = scan.join(F.broadcast(live), "code")
    else:
        joined = join_codes(scan, live, sum(c.code_rows for c in crits), scratch)
    return joined.where(window_filter(spec)).select(
        "criterion", "patient_id", "service_date", "claim_id", "code_group", "source", "group_idx"
    )


def distinct_claim_rows(matched: DataFrame) -> DataFrame:
    """One row per (criterion, patient, date, source, group, claim)."""
    return matched.select(
        "criterion", "patient_id", "service_date", "source", "code_group", "group_idx", "claim_id"
    ).distinct()


# Bits of a mask word.
MASK_BITS = 63


def group_counts(base: DataFrame) -> DataFrame:
    """Per (criterion, patient): distinct non-NULL groups, for any number of groups.

    A group is a bit of one of its criterion's mask words. The first aggregate
    ORs the bits by (criterion, patient, word): code-generated, combined before
    the shuffle, and a hot patient's rows are dealt by word. The second
    adds the words' bit counts. Every patient of ``base`` has a row.
    """
    word = (F.col("group_idx") / F.lit(MASK_BITS)).cast("int")
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), group_idx % {MASK_BITS})")
    words = base.groupBy(*EVENT_KEY, word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    return words.groupBy(*EVENT_KEY).agg(F.sum(F.coalesce(F.bit_count("mask"), F.lit(0))).cast("int").alias("n_groups"))


def claim_counts(base: DataFrame) -> DataFrame:
    """Per (criterion, patient): all distinct non-NULL claims."""
    claims = base.where(F.col("claim_id").isNotNull()).select(*EVENT_KEY, "claim_id").distinct()
    return claims.groupBy(*EVENT_KEY).agg(F.count("*").alias("n_claims"))


def claims_up_to(base: DataFrame, most: int) -> DataFrame:
    """Per (criterion, patient): distinct non-NULL claims, counted up to ``most``.

    The rank is limited in the tasks that read ``base``, before the shuffle: a
    patient sends ``most`` distinct claims a task, however many there are.
    """
    each = Window.partitionBy(*EVENT_KEY).orderBy("claim_id")
    ranked = base.where(F.col("claim_id").isNotNull()).select(*EVENT_KEY, "claim_id").withColumn("n", F.dense_rank().over(each))
    return ranked.where(F.col("n") <= F.lit(most)).groupBy(*EVENT_KEY).agg(F.max("n").cast("long").alias("n_claims"))


def _with_claims(groups: DataFrame, claims: DataFrame) -> DataFrame:
    """Patients without a claim id have none."""
    return groups.join(claims, EVENT_KEY, "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0).cast("long")))


def patient_counts(base: DataFrame) -> DataFrame:
    """Per (criterion, patient): distinct non-NULL groups and claims, both exact."""
    return _with_claims(group_counts(base), claim_counts(base))


def patients_qualified(base: DataFrame, spec: ScenarioSpec, groups: bool = True, claims: bool = True) -> DataFrame:
    """(criterion, patient) rows of ``base`` that meet the group rule and/or the claim
    threshold; claims are counted only as far as some threshold needs."""
    counts = group_counts(base)
    if not groups:
        counts = counts.withColumn("n_groups", F.lit(0))
    most = max([c.min_claims for c in spec.criteria if c.live], default=0)
    if claims:
        if most > 0:
            counts = _with_claims(counts, claims_up_to(base, most))
        else:
            counts = counts.withColumn("n_claims", F.lit(0).cast("long"))
    return qualify_patients(counts, spec, groups, claims).select(*EVENT_KEY)


def group_threshold(spec: ScenarioSpec) -> F.Column:
    return case_by("criterion", {c.number: F.lit(c.groups_needed) for c in spec.criteria}, F.lit(None))


def claim_threshold(spec: ScenarioSpec) -> F.Column:
    return case_by(
        "criterion",
        {c.number: F.lit(c.min_claims) for c in spec.criteria if c.min_claims is not None},
        F.lit(None),
    )


def qualify_patients(counts: DataFrame, spec: ScenarioSpec, groups: bool = True, claims: bool = True) -> DataFrame:
    """Patients meeting the group rule and/or the distinct-claim threshold."""
    cond = F.lit(True)
    if groups:
        cond = cond & (F.col("n_groups") >= group_threshold(spec))
    if claims:
        cond = cond & (F.col("n_claims") >= claim_threshold(spec))
    return counts.where(cond)


def birth_filter(spec: ScenarioSpec, criteria: list[int] | None = None) -> tuple[F.Column, F.Column]:
    """(per-criterion test, criterion-free test for the patient scan)."""
    crits = [c for c in spec.criteria if c.live and (criteria is None or c.number in criteria)]
    per = case_by(
        "criterion",
        {c.number: birth_year_test("birth_year", c.birth_op, c.birth_year) for c in crits},
        F.lit(False),
    )
    any_ = reduce(
        lambda a, b: a | b,
        [birth_year_test("birth_year", c.birth_op, c.birth_year) for c in crits],
        F.lit(False),
    )
    return per, any_


def with_age(df: DataFrame, as_of_year: int | None) -> DataFrame:
    a = age("birth_year", as_of_year)
    return df.withColumn("age", a).withColumn("age_group", age_band(F.col("age"), F.col("birth_year")))


def eligible_patients(
    qualified: DataFrame, patients: DataFrame, spec: ScenarioSpec, as_of_year: int | None
) -> DataFrame:
    """Qualified (criterion, patient) rows that pass the birth-year test,
    with the patient's attributes, age and age band. A patient row that is
    in the reference several times counts once; different rows of a patient
    (they should not exist) each stay.

    A patient missing from the reference, or with no birth year, fails the
    test, so the reference's LEFT JOIN is an inner join here.
    """
    per, any_ = birth_filter(spec)
    pts = patients.where(any_)
    return with_age(
        qualified.select(*EVENT_KEY).join(pts, "patient_id").where(per),
        as_of_year,
    ).select(*EVENT_KEY, "gender", "state", "birth_year", "age", "age_group").distinct()


def criterion_events(
    inputs: ClaimInputs,
    codes: DataFrame,
    spec: ScenarioSpec,
    as_of_year: int | None = None,
    criteria: list[int] | None = None,
    store: bool = True,
    scratch: RunScratch | None = None,
) -> DataFrame:
    """Events of every qualified patient, all criteria in one long table.

    Columns: ``CRITERION_COLUMNS``; rows are distinct (claim id dropped).

    ``base`` feeds three consumers (groups, claims and the event rows). Catalyst
    cannot share it between them: some only use duplicate-insensitive
    aggregates, so it drops ``base``'s distinct in that branch and the claim
    tables would be scanned again. With ``store`` (the default) ``base`` is
    written once to the shared scratch folder and all consumers read that;
    matched claims are a small part of the claim tables.
    """
    matched = match_events(inputs.tagged_events(), codes, spec, criteria, scratch)
    base = distinct_claim_rows(matched)
    if store:
        base = materialize(base, "matched_claims", scratch=scratch)
    qualified = patients_qualified(base, spec)
    eligible = eligible_patients(qualified, inputs.patients, spec, as_of_year)
    # Distinct event rows before the join: a hot patient's rows shrink to
    # (date, source, group) combinations before they are shuffled to it.
    rows = base.select(*EVENT_KEY, "service_date", "source", "code_group").distinct()
    return rows.join(eligible, EVENT_KEY).select(
        *[
            F.lit(spec.name).cast("string").alias(c) if c == "scenario" else F.col(c)
            for c in CRITERION_COLUMNS
        ]
    )


def enriched_events(
    matched: DataFrame,
    patients: DataFrame,
    spec: ScenarioSpec,
    as_of_year: int | None = None,
    birth_test: bool = True,
) -> DataFrame:
    """Per-channel view in the reference's shape: matched claims LEFT JOIN
    patients, birth-year test, age, band, tags; DISTINCT, claim id kept.

    Used to expose the intermediate operators; ``criterion_events`` does the
    same work in a cheaper order.
    """
    per, _ = birth_filter(spec)
    j = matched.join(patients, "patient_id", "left")
    if birth_test:
        j = j.where(per)
    return (
        with_age(j, as_of_year)
        .select(
            "patient_id", "service_date", "claim_id", "code_group", "gender", "state", "birth_year",
            "age", "source", "criterion", "age_group", F.lit(spec.name).cast("string").alias("scenario"),
        )
        .distinct()
    )
