"""Scenario settings as plain Python values.

These are the only values that reach the driver: one row of scalars per
scenario, read by ``operators.scenario.scenario_params``. Event, patient and
result data always stay in DataFrames.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. They must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# Birth-year operators understood by a criterion; anything else keeps no rows.
BIRTH_OP_LE = "<="
BIRTH_OP_GE = ">="
# Group logic / pair logic flags (exact, case-sensitive strings).
LOGIC_AND = "AND"
LOGIC_OR = "OR"
# Day-gap operators; a blank operator means "no gap test".
GAP_OPS = (">", "<", ">=", "<=")
# Source tags of the three claim channels, in channel order.
SOURCE_TAGS = {"dx": "Dx", "px": "Px", "rx": "Rx"}
# Date that stands in for a missing event date in the day-gap test.
SENTINEL_DATE = dt.date(1900, 1, 1)
# Age bands: (label, lowest age, highest age); None = open end.
AGE_BANDS = (
    ("0-18", None, 18),
    ("19-30", 19, 30),
    ("31-50", 31, 50),
    ("51-60", 51, 60),
    ("60+", 61, None),
)
AGE_BAND_UNKNOWN = "NA"
# ---------------------------------------------------------------------------


class ScenarioConfigError(ValueError):
    """A strict config read found more than one value (NULL counts as one)."""


@dataclass(frozen=True)
class CriterionSpec:
    """Scalar settings of one criterion (1-based ``number``)."""

    number: int
    start: dt.date | None
    end: dt.date | None
    birth_op: str | None
    birth_year: int | None
    logic: str | None
    min_claims: int | None
    group_total: int
    # distinct codes of the list when few enough to filter the scan, else None
    codes: tuple[str, ...] | None = None
    # distinct (code, group) rows of the list
    code_rows: int = 0
    # bytes of these rows
    code_bytes: int = 0
    # distinct groups of the list, sorted, when the list is short
    groups: tuple[str, ...] | None = None

    @property
    def groups_needed(self) -> int:
        """AND needs every distinct group of the list; anything else one."""
        return self.group_total if self.logic == LOGIC_AND else 1

    @property
    def live(self) -> bool:
        """False when the settings make the criterion empty by definition.

        A NULL window bound, birth-year bound or claim threshold compares to
        NULL and keeps no row; a birth operator other than ``<=``/``>=``
        cannot be satisfied.
        """
        return (
            self.start is not None
            and self.end is not None
            and self.birth_year is not None
            and self.min_claims is not None
            and self.birth_op in (BIRTH_OP_LE, BIRTH_OP_GE)
        )


@dataclass(frozen=True)
class PairSpec:
    """How the running result is combined with the next criterion.

    ``key`` is the criteria it covers, e.g. ``"12"`` then ``"123"``.
    ``gap_op`` is already defaulted to ``""`` and ``gap_days`` to ``0``.
    """

    key: str
    logic: str | None
    gap_op: str = ""
    gap_days: int = 0

    @property
    def live(self) -> bool:
        return self.logic in (LOGIC_AND, LOGIC_OR) and (
            self.gap_op == "" or self.gap_op in GAP_OPS
        )


@dataclass(frozen=True)
class ScenarioSpec:
    name: str | None
    criteria: tuple[CriterionSpec, ...]
    pairs: tuple[PairSpec, ...] = field(default_factory=tuple)

    def criterion(self, number: int) -> CriterionSpec:
        return self.criteria[number - 1]

    def pair(self, key: str) -> PairSpec:
        for p in self.pairs:
            if p.key == key:
                return p
        raise KeyError(key)
