"""

Usage: python tools/measure_variants.py [sf_dir] [repeat]

Each timing covers planning, the scenario reads and execution (``noop``
write); the same Spark session runs all variants, warm.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))  # the event-by-event oracle

from pyspark.sql import functions as F  # noqa: E402

from cohortlab.operators import criterion as C  # noqa: E402
from cohortlab.operators.scenario import load_scenario  # noqa: E402
from cohortlab.plans.registry import queries  # noqa: E402
from cohortlab.plans.scenario_run import run_scenario  # noqa: E402
from naive_combine import combine_naive  # noqa: E402
from cohortlab.plans.session import local_session  # noqa: E402
from cohortlab.sources.fixtures import fixture_inputs, scenario_config  # noqa: E402


def timed(fn, repeat: int) -> float:
    out = []
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - t0)
    return round(statistics.median(out), 3)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    repeat = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    spark = local_session(8, shuffle_partitions=16)
    qs = queries()
    inputs = fixture_inputs(spark, sf_dir)
    spec, _, codes = load_scenario(scenario_config(spark))
    timed(lambda: qs["cohort_seq"](spark, sf_dir), 1)  # warm-up

    res = {}
    cfg = scenario_config(spark)
    res["cohort_seq_naive_combine"] = timed(
        lambda: run_scenario(spark, inputs, cfg, None, 2025, combine_fn=combine_naive).cohort, repeat
    )
    res["cohort_seq_reduced_combine"] = timed(lambda: qs["cohort_seq"](spark, sf_dir), repeat)

    def per_criterion():
        parts = [C.criterion_events(inputs, codes, spec, 2025, criteria=[n]) for n in (1, 2, 3)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    res["criteria_one_pass_each"] = timed(per_criterion, repeat)
    res["criteria_long_form"] = timed(lambda: C.criterion_events(inputs, codes, spec, 2025), repeat)

    base = C.distinct_claim_rows(C.match_events(inputs.tagged_events(), codes, spec)).cache()
    base.count()
    res["qualify_two_count_distinct"] = timed(
        lambda: base.groupBy(*C.EVENT_KEY).agg(
            F.count_distinct("code_group").alias("n_groups"), F.count_distinct("claim_id").alias("n_claims")
        ),
        repeat,
    )
    res["qualify_exact_counts"] = timed(lambda: C.qualify_patients(C.patient_counts(base), spec), repeat)
    res["qualify_bounded_counts"] = timed(lambda: C.patients_qualified(base, spec), repeat)
    base.unpersist()
    print(json.dumps({"sf_dir": sf_dir, "repeat": repeat, "sec": res}))
    spark.stop()


if __name__ == "__main__":
    main()
