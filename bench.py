"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3). Each query is timed end to end (planning, the
scenario's driver-side reads, execution) with a ``noop`` write, so nothing
is collected; the reported time is the median of the repeats after one
warm-up run of the flagship at the same scale.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlab.plans import registry  # noqa: E402
from cohortlab.plans.materialize import delete_folder  # noqa: E402
from cohortlab.plans.scenario_run import ResultTables, write_scenario  # noqa: E402
from cohortlab.plans.session import local_session, scratch_path  # noqa: E402
from cohortlab.sources.fixtures import scenario_config, fixture_inputs  # noqa: E402

HEADLINE = [
    "criterion_1",
    "criterion_2",
    "criterion_3",
    "gap_gt",
    "combine_or_gap_ge",
    "combine_null_group",
    "cohort_seq",
    "cohort_or_gap",
]
VARIANTS: list[str] = []  # timed but not in the total (none this round)


def run_once(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def full_run(spark, sf_dir) -> float:
    """All result tables of the latest scenario, as the reference's run does."""
    t0 = time.perf_counter()
    tag = uuid.uuid4().hex[:8]
    tables = ResultTables(f"b_crit_{tag}", f"b_pair_{tag}", f"b_cohort_{tag}")
    root = scratch_path(spark, "bench")
    write_scenario(
        spark, fixture_inputs(spark, sf_dir), scenario_config(spark), tables, "auto", None, 2025, root=root,
    ).counts.collect()
    took = time.perf_counter() - t0
    for table in (tables.criteria, tables.pairs, tables.cohort):
        spark.sql(f"DROP VIEW IF EXISTS {table}")
    delete_folder(spark, root)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16))
    qs = registry.queries()
    run_once(spark, qs["cohort_seq"], sf_dir)  # warm-up (JIT, file listing)
    times: dict[str, float] = {}
    for key in HEADLINE + VARIANTS:
        times[key] = round(statistics.median(run_once(spark, qs[key], sf_dir) for _ in range(repeat)), 3)
    times["scenario_tables"] = round(statistics.median(full_run(spark, sf_dir) for _ in range(repeat)), 3)
    total = round(sum(v for k, v in times.items() if k not in VARIANTS), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else None,
                "cpus": cpus,
                "repeat": repeat,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
