"""The mechanisms that only a large input needs, on small ones."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.intervals import Interval, disjoint
from cohortlab.operators import code_join, criterion, scenario
from cohortlab.operators.criterion import claims_up_to, group_counts, match_events, patient_counts, patients_qualified, scan_filter
from cohortlab.operators.scenario import load_scenario, rank_scenarios
from cohortlab.plans.materialize import RunScratch, materialize_bucketed
from cohortlab.plans.scenario_run import combine_chain
from cohortlab.sources.schemas import CHANNEL_SCHEMA, CRITERION_COLUMNS, result_schema
from cohortlab.sources.tables import ClaimInputs, read_channel, read_config
from cohortlab.spec import CriterionSpec, PairSpec, ScenarioSpec
from conftest import D, criterion_cfg, make_config, make_inputs
from naive_combine import combine_naive
from naive_rank import rank_scenarios as naive_rank

PATIENTS = [(p, "F", "CA", 1980) for p in range(1, 30)]


@pytest.fixture
def conf(spark):
    """Settings for one test."""
    old = {}

    def put(**settings):
        for k, v in settings.items():
            k = "spark.sql." + k.replace("__", ".")
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# -- one config snapshot a run


@pytest.mark.parametrize("short", [True, False])
def test_rows_submitted_during_a_run_change_nothing(spark, tmp_path, monkeypatch, short):
    if not short:
        monkeypatch.setattr(scenario, "SCAN_CODE_FILTER_MAX", 1)
    path = str(tmp_path / "config.parquet")
    make_config(spark, "T", "2026-01-01 00:00:00", [criterion_cfg([("A", "G"), ("B", "H"), ("C", None)])]).write.parquet(path)
    with RunScratch(spark) as scratch:
        spec, rows, codes = load_scenario(read_config(spark, path), scratch=scratch)
        before = spec, sorted(map(str, rows.collect())), sorted(map(str, codes.collect()))
        late = make_config(spark, "T", "2026-02-01 00:00:00", [criterion_cfg([("Z", "Y")], min_claims=9)])
        late.write.mode("append").parquet(path)
        spark.catalog.refreshByPath(path)
        assert read_config(spark, path).count() == 4
        assert (spec, sorted(map(str, rows.collect())), sorted(map(str, codes.collect()))) == before
        assert spec.criterion(1).group_total == 2 and codes.where("criterion = 1").count() == 3
        assert {r.code: r.group_idx for r in codes.collect()} == {"A": 0, "B": 1, "C": None}


# -- ranking


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_rank_without_a_window_over_all(spark, parts):
    rng = random.Random(3)
    config = None
    for i in range(40):
        at = None if i % 13 == 0 else f"2026-01-{rng.randint(1, 20):02d} 0{rng.randint(0, 2)}:00:00"
        one = make_config(spark, None if i % 9 == 4 else f"S{rng.randint(0, 12)}", at, [criterion_cfg([("A", "G")] * rng.randint(1, 3))])
        config = one if config is None else config.unionByName(one)
    config = spark.createDataFrame(config.collect(), config.schema)
    with RunScratch(spark) as scratch:
        got = rank_scenarios(config, parts, scratch)
        want = naive_rank(config).withColumnRenamed("rnk", "rank")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.withColumn("rank", F.col("rank").cast("long")).collect()))
        logical = got._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*", logical)
        assert windows and all("_part" in w.split("],")[1] for w in windows)  # each is per partition
        assert rank_scenarios(config.where("false"), parts, scratch).count() == 0


# -- interval sets in the scan


def test_disjoint_intervals():
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    assert disjoint([]) == [] and disjoint([(day(3), day(2), None)]) == []
    a, b = frozenset("a"), frozenset("b")
    assert disjoint([(day(0), day(1), a), (day(2), day(3), a)]) == [Interval(day(0), day(3), a)]
    assert disjoint([(day(0), day(5), a), (day(2), day(3), b)]) == [
        Interval(day(0), day(1), a), Interval(day(2), day(3), a | b), Interval(day(4), day(5), a)]
    assert disjoint([(day(0), day(0), a), (day(0), dt.date.max - dt.timedelta(1), None)])[0].codes is None
    rng = random.Random(1)
    for _ in range(200):
        windows = [(day(rng.randint(0, 20)), day(rng.randint(0, 20)), rng.choice([None, a, b, a | b])) for _ in range(rng.randint(0, 5))]
        found = disjoint(windows)
        for n in range(-1, 22):
            open_ = [c for s, e, c in windows if s <= day(n) <= e]
            here = [i for i in found if i.start <= day(n) <= i.end]
            assert len(here) == bool(open_)
            if here:
                assert here[0].codes == (None if None in open_ else frozenset().union(*open_))


def test_scan_reads_only_the_windows(spark, tmp_path, conf):
    path = str(tmp_path / "claims")
    rows = [(p, D(f"{y}-06-0{1 + p % 9}"), 100 * y + p, c) for y in range(1980, 2000) for p in range(5) for c in "ABC"]
    spark.createDataFrame(rows, CHANNEL_SCHEMA).write.partitionBy("service_date").parquet(path)
    events = read_channel(spark, spark.read.schema(CHANNEL_SCHEMA).parquet(path)).withColumn("source", F.lit("Dx"))
    crits = [criterion_cfg([("A", "G")], start="1980-01-01", end="1980-12-31"), criterion_cfg([("B", "G")], start="1998-01-01", end="1998-12-31")]
    spec, _, codes = load_scenario(make_config(spark, "T", "2026-01-01 00:00:00", crits))
    conf(adaptive__enabled="false", maxMetadataStringLength="100000")
    found = scan_filter(events, spec, [1, 2])
    got = {(r.service_date.year, r.code) for r in found.collect()}
    assert got == {(1980, "A"), (1998, "B")}
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    found.count()
    files = scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters())
    read = [str(files.apply(i).values().toString()) for i in range(files.size())]
    assert len(read) == 10  # five days of each of the two years: the years between are pruned
    # stored by other columns, the same tests are pushed into the files
    spark.createDataFrame(rows, CHANNEL_SCHEMA).write.parquet(path + "-plain")
    plain = read_channel(spark, path + "-plain").withColumn("source", F.lit("Dx"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(scan_filter(plain, spec, [1, 2]))).group(1)
    assert "Or(And(GreaterThanOrEqual(service_date,1980-01-01),LessThanOrEqual(service_date,1980-12-31))" in pushed
    assert "EqualTo(code,A)" in pushed and "EqualTo(code,B)" in pushed
    matched = match_events(plain, codes, spec, [1, 2])
    assert {(r.criterion, r.service_date.year) for r in matched.collect()} == {(1, 1980), (2, 1998)}


# -- a code list too large to broadcast


def claims_of(spark, n=6000):
    """A third of all claims has one code."""
    code = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), (F.col("id") % 997).cast("string")))
    return spark.range(0, n, 1, 12).select(
        (F.col("id") % 50).alias("patient_id"), F.lit(D("2020-01-01")).alias("service_date"), F.col("id").alias("claim_id"), code.alias("code"), F.lit("Dx").alias("source"))


def test_large_code_list(spark, conf):
    conf(adaptive__enabled="false", adaptive__skewJoin__enabled="false", autoBroadcastJoinThreshold="-1", shuffle__partitions="12")
    listed = [(1, "HOT", "G1", 0), (2, "HOT", "G2", 0), (1, "HOT", None, None)] + [(1, f"K{i}", "G1", 0) for i in range(0, 997, 2)] + [(2, None, "G", 0)]
    codes = spark.createDataFrame(listed, "criterion int, code string, code_group string, group_idx int")
    claims = claims_of(spark)
    want = sorted(map(str, claims.join(codes, "code").select("patient_id", "claim_id", "code", "criterion", "code_group").collect()))
    for rows in (200_000, 0):  # hot codes by broadcast, and dealt over salts
        with pytest.MonkeyPatch.context() as m, RunScratch(spark) as scratch:
            m.setattr(code_join, "HOT_ROWS", rows)
            joined = code_join.join_codes(claims, codes, len(listed), scratch, share=20)
            got = joined.select("patient_id", "claim_id", "code", "criterion", "code_group")
            assert sorted(map(str, got.collect())) == want
            tasks = joined.where("code = 'HOT'").groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(tasks) >= 5 and max(r["count"] for r in tasks) < 2.5 * 6000 / len(tasks)


def test_code_filter_lets_listed_codes_through(spark):
    codes = spark.range(0, 4000).select(F.concat(F.lit("C"), "id").alias("code"))
    bits = code_join.filter_bits(4000)
    words = code_join.bloom_words(codes, bits)
    through = lambda df: df.where(code_join.may_be_listed(F.col("code"), words.scalar(), bits)).count()
    assert through(codes) == 4000
    assert through(spark.range(0, 20_000).select(F.concat(F.lit("D"), "id").alias("code"))) < 20_000 * 0.1


# -- counts per patient


def base_of(spark, groups: int):
    rng = random.Random(groups)
    rows = [(n, p, f"G{rng.randint(0, groups - 1):05d}", rng.randint(1, 30)) for n in (1, 2) for p in range(8) for _ in range(rng.randint(1, 200))]
    rows += [(1, 99, None, None), (1, 98, "G00000", None), (2, 97, None, 5), (2, 97, None, 5)]
    idx = {g: i for i, g in enumerate(sorted({r[2] for r in rows if r[2]} | {f"G{i:05d}" for i in range(groups)}))}
    return spark.createDataFrame([(*r, idx.get(r[2])) for r in rows], "criterion int, patient_id long, code_group string, claim_id long, group_idx int"), rows


def test_group_counts_have_one_plan_for_any_number(spark, conf):
    conf(adaptive__enabled="false")
    plans = set()
    for groups in (1, 62, 63, 5000):
        base, rows = base_of(spark, groups)
        got = {(r.criterion, r.patient_id): (r.n_groups, r.n_claims) for r in patient_counts(base).collect()}
        keys = {(n, p) for n, p, _, _ in rows}
        of = lambda k, i: {r[i] for r in rows if (r[0], r[1]) == k and r[i] is not None}
        assert got == {k: (len(of(k, 2)), len(of(k, 3))) for k in keys}
        plan = plan_of(group_counts(base))
        assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
        plans.add(re.sub(r"#\d+L?|plan_id=\d+|\[id=.*?\]", "", plan))
    assert len(plans) == 1


def test_claims_are_limited_before_the_shuffle(spark, conf):
    conf(adaptive__enabled="false", shuffle__partitions="8")
    claims = spark.range(0, 40_000, 1, 4).select(F.lit(1).alias("criterion"), F.lit(7).cast("long").alias("patient_id"), (F.col("id") % 15_000).alias("claim_id"), F.lit(0).alias("group_idx"))
    limited = claims_up_to(claims, 3)
    assert [r.n_claims for r in limited.collect()] == [3]
    assert patient_counts(claims).first().n_claims == 15_000  # shown counts stay exact
    plan = plan_of(limited)
    before = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before  # below the exchange
    exchange = limited._jdf.queryExecution().executedPlan()
    limited.collect()
    text = exchange.toString()
    assert text.count("Exchange") == 1

    def written(node):
        if "ShuffleExchangeExec" in node.getClass().getName():
            return node.metrics().apply("shuffleRecordsWritten").value()
        kids = node.children()
        return sum(written(kids.apply(i)) for i in range(kids.size()))

    fresh = claims_up_to(claims, 3)
    run = fresh._jdf.queryExecution()
    run.executedPlan().executeCollect()
    # dense ranks: each of 4 tasks sends the rows of its 3 least claims, repeats included
    assert written(run.executedPlan()) <= 4 * 3 * 3


def test_qualified_equals_exact_counts(spark):
    base, rows = base_of(spark, 9)
    crit = lambda n, k, logic: CriterionSpec(n, D("2020-01-01"), D("2020-12-31"), "<=", 2000, logic, k, 9)
    for k1, k2 in ((0, 0), (1, 25), (-3, 4), (30, 1), (31, 2)):
        spec = ScenarioSpec("T", (crit(1, k1, "AND"), crit(2, k2, "OR")))
        counts = {(r.criterion, r.patient_id): (r.n_groups, r.n_claims) for r in patient_counts(base).collect()}
        need = {1: (9, k1), 2: (1, k2)}
        for groups, claims in ((True, True), (True, False), (False, True)):
            got = {(r.criterion, r.patient_id) for r in patients_qualified(base, spec, groups, claims).collect()}
            assert got == {k for k, (g, c) in counts.items() if (not groups or g >= need[k[0]][0]) and (not claims or c >= need[k[0]][1])}


# -- a fold over stored events


def test_fold_of_twelve_criteria_shuffles_no_stored_event(spark, conf):
    conf(adaptive__enabled="false", autoBroadcastJoinThreshold="-1", shuffle__partitions="4")
    rng = random.Random(12)
    value = {"gender": "F", "state": "CA", "birth_year": 1980, "source": "Dx", "age": 45, "age_group": "31-50", "scenario": "T"}
    rows = [
        tuple({**value, "patient_id": rng.randint(1, 12), "service_date": D(f"2020-{rng.randint(1, 12):02d}-01"), "code_group": f"G{rng.randint(1, 3)}", "criterion": n}[c] for c in CRITERION_COLUMNS)
        for n in range(1, 13) for _ in range(40)
    ]
    df = spark.createDataFrame(sorted(set(rows), key=str), result_schema(CRITERION_COLUMNS))
    ops = [("AND", "", 0), ("AND", ">=", -200), ("OR", "", 0), ("AND", "<", 300), ("OR", ">=", -400)]
    pairs = tuple(PairSpec(f"1to{k}", *ops[k % 5]) for k in range(2, 13))
    crits = tuple(CriterionSpec(n, D("2020-01-01"), D("2020-12-31"), "<=", 2000, "OR", 1, 1) for n in range(1, 13))
    spec = ScenarioSpec("T", crits, pairs)
    with RunScratch(spark) as scratch:
        stored = materialize_bucketed(df, "criteria", "patient_id", scratch, ["criterion"])
        cohort = combine_chain(stored, spec, set())["1to12"]
        plan = plan_of(cohort)
        assert plan.count("Bucketed: true") >= 12 and "Exchange" not in plan
        want = combine_chain(df, spec, None, combine_naive)["1to12"]
        assert sorted(map(str, cohort.collect())) == sorted(map(str, want.select(cohort.columns).collect())) and cohort.count() > 5
        name = scratch.tables[0]
    assert not spark.catalog.tableExists(name)
