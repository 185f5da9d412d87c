"""End to end: scenario config -> criterion events -> pairs -> cohort -> tables.

The criterion events of all criteria are computed in one pass and written
once (the run's scratch folder, or the result table), so the claim tables are
scanned once per run however many criteria and combines follow. Combines are
lazy DataFrames over that stored table; a written pair is read back for the
next combine instead of being recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.combine import combine
from ..operators.criterion import criterion_events
from ..operators.scenario import load_scenario
from ..operators.result_store import ResultStore, grouped_counts, union
from ..operators.sinks import audit_counts, preview
from ..sources.schemas import ATTRIBUTE_COLUMNS, COHORT_COLUMNS, CRITERION_COLUMNS, PAIR_COLUMNS, pair_keys
from ..sources.tables import ClaimInputs
from ..spec import ScenarioSpec
from .materialize import RunScratch, materialize_bucketed, observed
from .session import apply_engine_conf


@dataclass
class ScenarioResult:
    spec: ScenarioSpec
    criteria: DataFrame  # long form, column ``criterion``
    pairs: dict[str, DataFrame]  # by pair key; the last one is the cohort
    scratch: RunScratch | None = None

    def close(self) -> None:
        """Delete what the run stored; its results can't be read after that."""
        if self.scratch:
            self.scratch.close()

    def criterion(self, number: int) -> DataFrame:
        return self.criteria.where(F.col("criterion") == F.lit(number))

    @property
    def cohort(self) -> DataFrame:
        return self.pairs[self.spec.pairs[-1].key]


def null_flags(spec: ScenarioSpec) -> dict[str, Column]:
    """Per criterion: does an event have a NULL attribute? Observed by the write
    of the events, so it costs no pass of its own."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ATTRIBUTE_COLUMNS])
    return {
        f"null_{c.number}": F.max(F.when((F.col("criterion") == c.number) & any_null, 1).otherwise(0))
        for c in spec.criteria
    }


def null_criteria(spec: ScenarioSpec, metrics: dict) -> set[int]:
    return {c.number for c in spec.criteria if metrics.get(f"null_{c.number}")}


def fold(
    running: DataFrame, right: DataFrame, spec: ScenarioSpec, i: int, null_attrs: set[int] | None, distinct: bool = True
) -> DataFrame:
    """The running result combined with criterion ``i + 2`` by pair ``i``.

    Criterion events always have a date (the window test drops NULL dates) and
    are distinct, so every running result that keeps its date is both;
    ``distinct=False`` for tables that also hold rows of an earlier run.
    ``null_attrs`` (criteria with a NULL attribute, if known) lets the combine
    skip its fill paths while no criterion folded so far has one.
    """
    complete = None if null_attrs is None else not any(n in null_attrs for n in range(1, i + 2))
    return combine(
        running, right, spec.pairs[i], keep_date=(i < len(spec.pairs) - 1), scenario=spec.name,
        left_complete=complete, left_dated=True, left_distinct=distinct,
    )


def combine_chain(
    criteria: DataFrame,
    spec: ScenarioSpec,
    null_attrs: set[int] | None = None,
    combine_fn=None,
    pairs: int | None = None,
) -> dict[str, DataFrame]:
    """Fold the criteria left to right: (1 x 2) x 3 ... The last combine
    drops the event date; the ones before keep it (its gap is measured from
    the running result's date). ``pairs``: only the first so many.

    ``combine_fn`` replaces the combine (tests and measurements pass the
    event-by-event oracle).
    """
    by_number = lambda n: criteria.where(F.col("criterion") == F.lit(n)).select(*PAIR_COLUMNS)
    running = by_number(1)
    out: dict[str, DataFrame] = {}
    last = len(spec.pairs) - 1
    for i, pair in enumerate(spec.pairs[:pairs]):
        if combine_fn is None:
            running = fold(running, by_number(i + 2), spec, i, null_attrs)
        else:
            running = combine_fn(running, by_number(i + 2), pair, keep_date=(i < last), scenario=spec.name)
        out[pair.key] = running
    return out


def run_scenario(
    spark: SparkSession,
    inputs: ClaimInputs,
    config: DataFrame,
    name: str | None = None,
    as_of_year: int | None = None,
    store_criteria: bool = True,
    combine_fn=None,
    pairs: int | None = None,
) -> ScenarioResult:
    """Results of one scenario (the latest one unless ``name`` is given).

    The config is read and, with ``store_criteria``, the criterion events are
    computed and written when this is called; the combines are lazy.
    ``pairs``: fold only the first so many pairs and compute only the criteria
    they need. ``close()`` the result when it has been read.
    """
    apply_engine_conf(spark)
    scratch = RunScratch(spark)
    spec, _rows, codes = load_scenario(config, name, scratch=scratch)
    wanted = None if pairs is None else list(range(1, pairs + 2))
    crit = criterion_events(inputs, codes, spec, as_of_year, criteria=wanted, scratch=scratch)
    null_attrs = None
    if store_criteria:
        crit, metrics = materialize_bucketed(crit, "criteria", "patient_id", scratch, ["criterion"], null_flags(spec))
        null_attrs = null_criteria(spec, metrics)
    folded = combine_chain(crit, spec, null_attrs, combine_fn, pairs)
    return ScenarioResult(spec=spec, criteria=crit, pairs=folded, scratch=scratch)


class ScenarioWriteError(RuntimeError):
    """A run failed while it wrote ``table``; nothing of it was published."""

    def __init__(self, table: str):
        super().__init__(f"writing {table!r} failed; no table was changed")
        self.table = table


@dataclass(frozen=True)
class ResultTables:
    criteria: str = "criterion_events"
    pairs: str = "pair_events"
    cohort: str = "cohort"


@dataclass(frozen=True)
class ScenarioWrite:
    """What a run reports: rows of each result, and the first cohort rows."""

    spec: ScenarioSpec
    counts: DataFrame  # (table_name, n_rows)
    preview: list[dict]
    store: ResultStore
    version: int


def default_root(spark: SparkSession) -> str:
    """Where results are stored unless a run names a folder: in the catalog's warehouse."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scenario_results"


def write_scenario(
    spark: SparkSession,
    inputs: ClaimInputs,
    config: DataFrame,
    tables: ResultTables = ResultTables(),
    mode: str = "auto",
    name: str | None = None,
    as_of_year: int | None = None,
    root: str | None = None,
    preview_rows: int = 1,
    views: bool = True,
) -> ScenarioWrite:
    """Run a scenario and publish all its tables, or none if any step fails.

    The tables are staged in dependency order in the result store at ``root`` (default: a
    folder of the warehouse) and published by one commit. ``mode``: ``auto`` or
    ``append`` (rows are added, tables made if missing; the reference's behaviour),
    ``replace`` (this scenario's rows give way) or ``create`` (all rows of the
    tables give way). ``views``: also give the catalog a view of each table.
    Returns the audit counts, the preview and the published version.
    """
    apply_engine_conf(spark)
    store = ResultStore(spark, root or default_root(spark))
    step = tables.criteria
    with RunScratch(spark) as scratch:
        spec, _rows, codes = load_scenario(config, name, scratch=scratch)
        run = store.begin(spec.name, "append" if mode == "auto" else mode)
        try:
            # do the tables hold rows of this run only?
            fresh = not any(p.scenario == spec.name for p in run.former(tables.criteria))
            events = criterion_events(inputs, codes, spec, as_of_year, scratch=scratch)
            events, flags = observed(events.select(*CRITERION_COLUMNS), "criteria", null_flags(spec))
            run.write(events, tables.criteria, ("criterion",))
            crit = run.read(tables.criteria)
            null_attrs = null_criteria(spec, flags.get) if fresh else None
            running = crit.where(F.col("criterion") == 1).select(*PAIR_COLUMNS)
            for i, pair in enumerate(spec.pairs):
                last = i == len(spec.pairs) - 1
                step = tables.cohort if last else tables.pairs
                right = crit.where(F.col("criterion") == F.lit(i + 2)).select(*PAIR_COLUMNS)
                df = fold(running, right, spec, i, null_attrs, fresh)
                if last:
                    run.write(df.select(*COHORT_COLUMNS), step)
                else:
                    run.write(df.select(*PAIR_COLUMNS), step, pair=pair.key)
                    running = run.read(step, pair=pair.key).drop("pair")
            step = "the manifest"
            version = run.commit()
        except Exception as e:
            run.abandon()
            raise ScenarioWriteError(step) from e
    if views:
        store.publish_views([t for t in dict.fromkeys((tables.criteria, tables.pairs, tables.cohort)) if t in run.staged])
    counts = scenario_counts(store, tables, len(spec.criteria))
    return ScenarioWrite(spec, counts, preview(store.read(tables.cohort, spec.name), preview_rows), store, version)


def scenario_counts(store: ResultStore, tables: ResultTables, n_criteria: int) -> DataFrame:
    """Rows of each result: a row a criterion, a row a pair before the last, and the
    cohort; one scan of each table."""
    frames = [grouped_counts(store.read(tables.criteria), "criterion", {str(n): f"criterion_{n}" for n in range(1, n_criteria + 1)})]
    keys = pair_keys(n_criteria)[:-1]
    if keys:
        frames.append(grouped_counts(store.read(tables.pairs), "pair", {k: f"pair_{k}" for k in keys}))
    return union([*frames, audit_counts(store.spark, {"cohort": store.read(tables.cohort)})])
