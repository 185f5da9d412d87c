"""DuckDB SQL that must return the rows of the registered queries.

Written from the rules, not from the engine: a scenario's settings stand in
the text as literals, claims of all channels are one relation, a criterion is
one HAVING over its hits, and a combine pairs events and tests each pair. None
of the engine's shortcuts (many criteria in one pass, counts before the
patient join, earliest and latest dates instead of pairs) is used, and no
constant is imported from it.
"""

from __future__ import annotations

import datetime as dt

from ..sources.fixtures import SCENARIOS, SQL_INPUT_VIEWS, CriterionFixture

AS_OF_YEAR = 2025
TAGS = {"dx_events": "Dx", "px_events": "Px", "rx_events": "Rx"}
PERSON = "birth_year, gender, state, age"
AGE = f"CAST({AS_OF_YEAR} - birth_year AS INTEGER)"
BAND = f"""CASE WHEN birth_year IS NULL THEN 'NA' WHEN {AGE} < 19 THEN '0-18' WHEN {AGE} < 31 THEN '19-30'
    WHEN {AGE} < 51 THEN '31-50' WHEN {AGE} < 61 THEN '51-60' ELSE '60+' END"""
EVENT = ("patient_id", "service_date", "birth_year", "gender", "state", "age", "code_group", "source", "age_group")
PATIENT = tuple(c for c in EVENT if c != "service_date")


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, dt.date):
        return f"DATE '{v}'"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def latest() -> str:
    newest = max(s.submitted_at for s in SCENARIOS.values())
    return min(s.name for s in SCENARIOS.values() if s.submitted_at == newest)


class Answer:
    """SQL for one scenario (the latest if none is named)."""

    def __init__(self, scenario: str | None = None, inputs: dict[str, str] = SQL_INPUT_VIEWS) -> None:
        self.fixture = SCENARIOS[scenario or latest()]
        self.name = self.fixture.name
        self.parts = [f"{view} AS ({body})" for view, body in inputs.items()]
        self.parts.append(
            "claims AS (" + " UNION ALL ".join(
                f"SELECT patient_id, service_date, claim_id, code, '{tag}' AS source FROM {view}" for view, tag in TAGS.items()) + ")"
        )
        self.parts.append(f"people AS (SELECT *, {AGE} AS age, {BAND} AS age_group FROM patients)")

    def sql(self, last: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + last

    def define(self, name: str, body: str) -> str:
        if not any(p.startswith(f"{name} AS ") for p in self.parts):
            self.parts.append(f"{name} AS ({body})")
        return name

    def criterion_fixture(self, n: int) -> CriterionFixture:
        return self.fixture.criteria[n - 1]

    def listed(self, n: int) -> list[tuple[str, str | None]]:
        """Codes and groups of all submissions under the name."""
        own = list(self.criterion_fixture(n).codes)
        return own + (list(self.fixture.earlier[1]) if self.fixture.earlier and n == 1 else [])

    def born(self, n: int, column: str = "birth_year") -> str:
        c = self.criterion_fixture(n)
        return f"{column} {c.birth_op} {lit(c.birth_year)}" if c.birth_op in ("<=", ">=") else "FALSE"

    def hits(self, n: int) -> str:
        c = self.criterion_fixture(n)
        rows = ", ".join(f"({lit(k)}, {lit(g)})" for k, g in sorted(set(self.listed(n)), key=str))
        return self.define(f"hits_{n}", f"""
            SELECT patient_id, service_date, claim_id, source, CAST(code_group AS VARCHAR) AS code_group
            FROM claims JOIN (VALUES {rows}) AS listed(code, code_group) USING (code)
            WHERE service_date BETWEEN {lit(c.start)} AND {lit(c.end)}""")

    def having(self, n: int, groups: bool = True, claims: bool = True) -> str:
        c = self.criterion_fixture(n)
        least = len({g for _, g in self.listed(n) if g is not None}) if c.logic == "AND" else 1
        tests = [f"count(DISTINCT code_group) >= {least}"] * groups + [f"count(DISTINCT claim_id) >= {c.min_claims}"] * claims
        return " AND ".join(tests)

    def criterion(self, n: int) -> str:
        hits = self.hits(n)
        return self.define(f"criterion_{n}", f"""
            SELECT DISTINCT patient_id, service_date, {PERSON}, code_group, source, age_group, CAST({n} AS INTEGER) AS criterion
            FROM {hits} JOIN people USING (patient_id)
            WHERE {self.born(n)} AND patient_id IN (SELECT patient_id FROM {hits} GROUP BY patient_id HAVING {self.having(n)})""")

    def joined(self, name: str, left: str, right: str, pair: int, columns: tuple[str, ...]) -> str:
        """``left`` and ``right`` combined by the scenario's pair number ``pair``."""
        logic, op, days = self.fixture.pairs[pair]
        kind = {"AND": "INNER", "OR": "FULL"}.get(logic)
        day = lambda side: f"coalesce({side}.service_date, DATE '1900-01-01')"
        test = "TRUE" if not op else f"{day('r')} - {day('l')} {op} {days or 0}" if op in (">", "<", ">=", "<=") else "FALSE"
        values = ", ".join(f"coalesce(l.{c}, r.{c}) AS {c}" for c in columns)
        return self.define(name, f"""SELECT DISTINCT {values} FROM {left} l {kind or 'INNER'} JOIN {right} r ON l.patient_id = r.patient_id
            WHERE {test if kind else 'FALSE'}""")

    def pair(self) -> str:
        return self.joined("pair_12", self.criterion(1), self.criterion(2), 0, EVENT)

    def cohort(self) -> str:
        return self.joined("cohort", self.pair(), self.criterion(3), 1, PATIENT)

    def rows(self, of: str) -> str:
        return f"SELECT *, {lit(self.name)} AS scenario FROM {of}"


def criterion_sql(n: int, scenario: str | None = None) -> str:
    a = Answer(scenario)
    return a.sql(a.rows(a.criterion(n)))


def criteria_sql(scenario: str | None = None, copies: int = 1) -> str:
    a = Answer(scenario)
    return a.sql(" UNION ALL ".join(a.rows(a.criterion(n)) for _ in range(copies) for n in (1, 2, 3)))


def pair_sql(scenario: str | None = None) -> str:
    a = Answer(scenario)
    return a.sql(a.rows(a.pair()))


def pairs_sql(*scenarios: str) -> str:
    """The pairs of several scenarios."""
    return " UNION ALL ".join(f"({pair_sql(s)})" for s in scenarios)


def cohort_sql(scenario: str | None = None, copies: int = 1) -> str:
    a = Answer(scenario)
    rows = a.rows(a.cohort())
    return a.sql(" UNION ALL ".join([rows] * copies))


def counts_sql(scenario: str | None = None) -> str:
    """Rows of every result; those of an empty one are 0."""
    a = Answer(scenario)
    a.cohort()
    names = {"criterion_1": "criterion_1", "criterion_2": "criterion_2", "criterion_3": "criterion_3", "pair_12": "pair_12", "cohort": "cohort"}
    return a.sql(" UNION ALL ".join(f"SELECT '{k}' AS table_name, count(*) AS n_rows FROM {v}" for k, v in names.items()))


def preview_sql(scenario: str | None = None) -> str:
    a = Answer(scenario)
    order = ", ".join(f"{c} NULLS FIRST" for c in PATIENT)
    return a.sql(f"{a.rows(a.cohort())} ORDER BY {order} LIMIT 1")


def hits_sql(n: int) -> str:
    a = Answer()
    return a.sql(f"SELECT *, CAST({n} AS INTEGER) AS criterion FROM {a.hits(n)}")


def matched_sql(n: int, scenario: str | None = None, tag: str | None = None, born: bool = True) -> str:
    """Hits with what is known of the patient, claim ids kept; without the
    birth-year test also those of patients that aren't known."""
    a = Answer(scenario)
    tests = [f"source = '{tag}'"] * bool(tag) + [a.born(n)] * born
    return a.sql(f"""SELECT DISTINCT patient_id, service_date, claim_id, code_group, source, {PERSON},
        coalesce(age_group, 'NA') AS age_group, CAST({n} AS INTEGER) AS criterion, {lit(a.name)} AS scenario
        FROM {a.hits(n)} LEFT JOIN people USING (patient_id) WHERE {' AND '.join(tests) or 'TRUE'}""")


def per_patient_sql(n: int, value: str) -> str:
    """``value``: an aggregate over a patient's hits; patients that pass the birth-year test."""
    a = Answer()
    return a.sql(f"SELECT patient_id, {value} FROM {a.hits(n)} JOIN people USING (patient_id) WHERE {a.born(n)} GROUP BY patient_id")


def qualified_sql(n: int, groups: bool = False, claims: bool = False) -> str:
    a = Answer()
    return a.sql(f"""SELECT patient_id FROM {a.hits(n)} JOIN people USING (patient_id) WHERE {a.born(n)}
        GROUP BY patient_id HAVING {a.having(n, groups, claims)}""")


def scan_sql(view: str) -> str:
    return Answer().sql(f"SELECT * FROM {view}")


def age_sql(band: bool) -> str:
    return Answer().sql(f"SELECT patient_id, birth_year, age{', age_group' if band else ''} FROM people")
