"""Scenario config: pick the scenario, read its scalars, unpivot its codes.

The config is a user-submitted table (one row per code tuple) that others may be
writing to. A run reads the scenario's rows from it once (``snapshot``) and takes
settings and codes from that copy. What reaches the driver: the rows of a short
scenario; of a long one, one row of scalar settings, one row of counts a criterion and
the distinct code values when those are few. Long code lists stay a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import RunScratch, materialize
from ..sources.schemas import pair_keys
from ..sources.tables import criteria_in
from ..spec import CriterionSpec, PairSpec, ScenarioConfigError, ScenarioSpec

# Code lists up to this many distinct codes per criterion are read to the
# driver and applied as an IN filter on the claim scan. Up to
# spark.sql.parquet.pushdown.inFilterThreshold values Parquet gets the list
# itself, beyond that their range; either way other rows are dropped unjoined.
SCAN_CODE_FILTER_MAX = 2000


def rank_scenarios(config: DataFrame, parts: int | None = None, scratch: RunScratch | None = None) -> DataFrame:
    """(scenario, submitted_at, rank) of every config row: the dense rank of its
    submission time, newest first, undated last.

    No task holds all times: the distinct ones are dealt by range over ``parts``
    partitions and stored; a time's rank is the number of times in the partitions before its own
    (one number a partition reaches the driver) and its place in its partition.
    """
    spark = config.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    newest = F.col("_time").desc_nulls_last()
    times = config.select(F.col("submitted_at").alias("_time")).distinct().repartitionByRange(parts, newest)
    times = materialize(times.withColumn("_part", F.spark_partition_id()), "submissions", scratch=scratch)
    before, total = {}, 0
    for r in sorted(times.groupBy("_part").count().collect()):
        before[r["_part"]] = total
        total += r["count"]
    if not before:
        return config.select("scenario", "submitted_at", F.lit(None).cast("long").alias("rank"))
    ahead = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("_part"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(newest))
    ranks = times.select("_time", (ahead + place).cast("long").alias("rank"))
    return config.select("scenario", "submitted_at").join(ranks, F.col("submitted_at").eqNullSafe(F.col("_time"))).drop("_time")


def latest_scenario(config: DataFrame) -> DataFrame:
    """One row: the scenario at rank 1; ties broken by name (ascending).

    A distributed top-1: group by submission time keeping the smallest name
    (NULL names sort last), then the newest time (NULL time last).
    """
    return (
        config.groupBy("submitted_at")
        .agg(F.min("scenario").alias("scenario"))
        .orderBy(F.col("submitted_at").desc_nulls_last())
        .limit(1)
        .select("scenario")
    )


def latest_scenario_name(config: DataFrame) -> str | None:
    row = latest_scenario(config).first()
    return None if row is None else row["scenario"]


def scenario_rows(config: DataFrame, name: str | None) -> DataFrame:
    """Every config row with that scenario *name* (older submissions too).

    A NULL name matches nothing: the scenario is empty.
    """
    if name is None:
        return config.where(F.lit(False))
    return config.where(F.col("scenario") == F.lit(name))


def _strict_columns(n: int) -> list[str]:
    cols = []
    for i in range(1, n + 1):
        cols += [f"c{i}_start", f"c{i}_end", f"c{i}_birth_op", f"c{i}_birth_year", f"c{i}_logic", f"c{i}_min_claims"]
    cols += [f"c{p}_logic" for p in pair_keys(n)]
    return cols


def _lenient_columns(n: int) -> list[str]:
    cols = []
    for p in pair_keys(n):
        cols += [f"c{p}_gap_op", f"c{p}_gap_days"]
    return cols


def _code_rows(rows: DataFrame) -> DataFrame:
    """The config unpivoted: (criterion, code, code_group), one row a cell."""
    n = criteria_in(rows.columns)
    parts = ", ".join(f"{i}, c{i}_code, c{i}_group" for i in range(1, n + 1))
    return rows.selectExpr(f"stack({n}, {parts}) AS (criterion, code, code_group)").select(
        F.col("criterion").cast("int").alias("criterion"), "code", "code_group"
    )


def scenario_params_frame(rows: DataFrame) -> DataFrame:
    """One-row aggregate over the scenario rows holding every scalar read.

    Strict read (the only value of the column, NULL counting as one): the
    least and the greatest value and the number of values, plain aggregates
    whatever the column holds. Lenient read: ``MAX``.
    """
    n = criteria_in(rows.columns)
    aggs = []
    for c in _strict_columns(n):
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"), F.count(c).alias(f"{c}__n")]
    aggs += [F.max(c).alias(c) for c in _lenient_columns(n)]
    aggs.append(F.count("*").alias("n_rows"))
    aggs.append(F.max("scenario").alias("__name"))
    return rows.agg(*aggs)


def code_stats_frame(rows: DataFrame) -> DataFrame:
    """Per criterion: distinct groups (all rows), distinct codes, and the rows
    and bytes of the code list. Distinct counts over the unpivoted list, so no
    task holds a list whole."""
    cells = _code_rows(rows)
    size = F.coalesce(F.octet_length("code"), F.lit(0)) + F.coalesce(F.octet_length("code_group"), F.lit(0)) + 16
    listed = cells.groupBy("criterion", "code", "code_group").agg(F.count("*"))
    has_code = F.col("code").isNotNull()
    return listed.groupBy("criterion").agg(
        F.count_distinct("code_group").alias("groups"),
        F.count_distinct("code").alias("codes"),
        F.count(F.when(has_code, 1)).alias("code_rows"),
        F.coalesce(F.sum(F.when(has_code, size)), F.lit(0)).alias("code_bytes"),
    )


def _strict(row, col: str):
    n, total = row[f"{col}__n"], row["n_rows"]
    low, high = row[f"{col}__min"], row[f"{col}__max"]
    if low != high or 0 < n < total:
        raise ScenarioConfigError(
            f"config column {col!r} holds more than one value (NULL counts) "
            "for one scenario; a scalar setting must be the same on every row"
        )
    return low


_UNKNOWN = object()


def scenario_params(rows: DataFrame, name=_UNKNOWN) -> ScenarioSpec:
    """Read the scenario's scalars into a ScenarioSpec: one row of scalars, one
    row of counts a criterion, and the code values when they are few.

    Without ``name``, the name is read from the rows.
    """
    n = criteria_in(rows.columns)
    row = scenario_params_frame(rows).first()
    if name is _UNKNOWN:
        name = row["__name"]
    return _spec(rows, row, name, n)


def _counted(cells: list[tuple]) -> tuple[dict, dict, dict]:
    """The counts of ``code_stats_frame``, the codes and the groups, from a short list's cells."""
    stats, values, groups = {}, {}, {}
    for i in {c[0] for c in cells}:
        own = {(code, group) for n, code, group in cells if n == i}
        listed = [(code, group) for code, group in own if code is not None]
        groups[i] = tuple(sorted({group for _, group in own if group is not None}))
        values[i] = list({code for code, _ in listed})
        stats[i] = {
            "groups": len(groups[i]), "codes": len(values[i]), "code_rows": len(listed),
            "code_bytes": sum(len((code + (group or "")).encode()) + 16 for code, group in listed),
        }
    return stats, values, groups


def _spec(rows: DataFrame, row, name, n: int) -> ScenarioSpec:
    groups: dict[int, tuple[str, ...]] = {}
    if row["n_rows"] <= SCAN_CODE_FILTER_MAX:  # few rows: read them, count here
        stats, values, groups = _counted([tuple(r) for r in _code_rows(rows).collect()])
    else:
        stats = {r["criterion"]: r for r in code_stats_frame(rows).collect()}
        few = [i for i, r in stats.items() if r["codes"] <= SCAN_CODE_FILTER_MAX]
        values = {i: [] for i in few}
        if few:  # at most SCAN_CODE_FILTER_MAX values a criterion
            listed = _code_rows(rows).where(F.col("code").isNotNull() & F.col("criterion").isin(few))
            for r in listed.select("criterion", "code").distinct().collect():
                values[r["criterion"]].append(r["code"])
    crits = []
    for i in range(1, n + 1):
        s = stats.get(i)
        crits.append(
            CriterionSpec(
                number=i,
                start=_strict(row, f"c{i}_start"),
                end=_strict(row, f"c{i}_end"),
                birth_op=_strict(row, f"c{i}_birth_op"),
                birth_year=_strict(row, f"c{i}_birth_year"),
                logic=_strict(row, f"c{i}_logic"),
                min_claims=_strict(row, f"c{i}_min_claims"),
                group_total=int(s["groups"]) if s else 0,
                codes=tuple(sorted(values.get(i, []))) if s is None or i in values else None,
                code_rows=int(s["code_rows"]) if s else 0,
                code_bytes=int(s["code_bytes"]) if s else 0,
                groups=groups.get(i),
            )
        )
    pairs = []
    for p in pair_keys(n):
        op = row[f"c{p}_gap_op"]
        days = row[f"c{p}_gap_days"]
        pairs.append(
            PairSpec(
                key=p,
                logic=_strict(row, f"c{p}_logic"),
                gap_op="" if op is None else op,
                gap_days=0 if days is None else int(days),
            )
        )
    return ScenarioSpec(name=name, criteria=tuple(crits), pairs=tuple(pairs))


def config_codes(rows: DataFrame) -> DataFrame:
    """Long code list ``(criterion, code, code_group)``, NULL codes dropped.

    The wide config can repeat a (code, group) pair; ``distinct`` keeps one.
    A code listed under two groups stays twice, as it should.
    """
    return _code_rows(rows).where(F.col("code").isNotNull()).distinct()


def number_groups(codes: DataFrame) -> DataFrame:
    """``codes`` with ``group_idx``: a criterion's distinct groups numbered from 0, NULL for none.

    The window holds a criterion's distinct groups, never its codes."""
    groups = codes.where(F.col("code_group").isNotNull()).select("criterion", "code_group").distinct()
    order = Window.partitionBy("criterion").orderBy("code_group")
    groups = groups.withColumn("group_idx", (F.row_number().over(order) - 1).cast("int"))
    return codes.join(groups, ["criterion", "code_group"], "left").select("criterion", "code", "code_group", "group_idx")


def snapshot(rows: DataFrame, scratch: RunScratch | None = None) -> tuple[DataFrame, bool]:
    """A copy of a scenario's rows that later submissions don't change, made by one
    read; is it short? A short one (at most SCAN_CODE_FILTER_MAX rows) is held by the
    driver, a longer one is stored in the scratch folder."""
    first = rows.limit(SCAN_CODE_FILTER_MAX + 1).toArrow()
    if first.num_rows <= SCAN_CODE_FILTER_MAX:
        return rows.sparkSession.createDataFrame(first, rows.schema), True
    return materialize(rows, "scenario", scratch=scratch), False


def load_scenario(config: DataFrame, name: str | None = None, pick_latest: bool = True, scratch: RunScratch | None = None):
    """Scenario rows, settings and code list (with ``group_idx``), all of one snapshot.

    ``name=None`` picks the latest submitted scenario (the reference's only
    mode); a name selects that scenario directly.
    """
    if name is None and pick_latest:
        # a semi join with the one-row top-1 (its size is bounded by the limit)
        rows = config.join(F.broadcast(latest_scenario(config)), "scenario", "left_semi").select(config.columns)
    else:
        rows = scenario_rows(config, name)
    rows, short = snapshot(rows, scratch)
    spec = scenario_params(rows) if name is None and pick_latest else scenario_params(rows, name)
    codes = number_groups(config_codes(rows))
    return spec, rows, codes if short else materialize(codes, "code_list", scratch=scratch)
