"""Logical schemas of inputs and results.

Inputs are normalised to these names and types at the scan (``tables.py``);
results are written with exactly these columns (``operators.sinks``). Patient
and claim ids are only compared and counted, so they keep the type they have
in the source (``OPAQUE``); the types given here are those of the test data.
"""

from __future__ import annotations

from pyspark.sql import types as T

OPAQUE = ("patient_id", "claim_id")

CHANNEL_SCHEMA = T.StructType(
    [
        T.StructField("patient_id", T.LongType(), False),
        T.StructField("service_date", T.DateType(), True),
        T.StructField("claim_id", T.LongType(), True),
        T.StructField("code", T.StringType(), True),
    ]
)

PATIENT_SCHEMA = T.StructType(
    [
        T.StructField("patient_id", T.LongType(), False),
        T.StructField("gender", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("birth_year", T.IntegerType(), True),
    ]
)

# Per-criterion config columns; ``{n}`` is the criterion number.
CRITERION_CONFIG_COLUMNS = (
    ("c{n}_code", T.StringType()),
    ("c{n}_group", T.StringType()),
    ("c{n}_start", T.DateType()),
    ("c{n}_end", T.DateType()),
    ("c{n}_birth_op", T.StringType()),
    ("c{n}_birth_year", T.IntegerType()),
    ("c{n}_logic", T.StringType()),
    ("c{n}_min_claims", T.IntegerType()),
)
# Per-pair config columns; ``{p}`` is the pair key (``pair_keys``).
PAIR_CONFIG_COLUMNS = (
    ("c{p}_logic", T.StringType()),
    ("c{p}_gap_op", T.StringType()),
    ("c{p}_gap_days", T.IntegerType()),
)


def pair_keys(n_criteria: int) -> list[str]:
    """Keys of the running results, combined left to right: ``12``, ``123``, ...

    From ten criteria on that would be ambiguous (``c12_logic`` would belong to
    pair 12 and to criterion 12), so the keys are then ``1to2``, ``1to3``, ...
    """
    if n_criteria < 10:
        return ["".join(str(i) for i in range(1, k + 1)) for k in range(2, n_criteria + 1)]
    return [f"1to{k}" for k in range(2, n_criteria + 1)]


def config_schema(n_criteria: int = 3) -> T.StructType:
    fields = [
        T.StructField("scenario", T.StringType(), True),
        T.StructField("submitted_at", T.TimestampNTZType(), True),
    ]
    for n in range(1, n_criteria + 1):
        fields += [T.StructField(c.format(n=n), t, True) for c, t in CRITERION_CONFIG_COLUMNS]
    for p in pair_keys(n_criteria):
        fields += [T.StructField(c.format(p=p), t, True) for c, t in PAIR_CONFIG_COLUMNS]
    return T.StructType(fields)


# Result tables; column order is the table order.
CRITERION_COLUMNS = (
    "patient_id",
    "service_date",
    "gender",
    "state",
    "birth_year",
    "source",
    "age",
    "code_group",
    "criterion",
    "age_group",
    "scenario",
)
# Columns a combine carries from either side (besides the keys).
ATTRIBUTE_COLUMNS = (
    "birth_year",
    "gender",
    "state",
    "age",
    "code_group",
    "source",
    "age_group",
)
PAIR_COLUMNS = ("patient_id", "service_date") + ATTRIBUTE_COLUMNS + ("scenario",)
COHORT_COLUMNS = ("patient_id",) + ATTRIBUTE_COLUMNS + ("scenario",)

RESULT_TYPES = {
    "patient_id": T.LongType(),
    "service_date": T.DateType(),
    "gender": T.StringType(),
    "state": T.StringType(),
    "birth_year": T.IntegerType(),
    "source": T.StringType(),
    "age": T.IntegerType(),
    "code_group": T.StringType(),
    "criterion": T.IntegerType(),
    "age_group": T.StringType(),
    "scenario": T.StringType(),
}


def result_schema(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, RESULT_TYPES[c], True) for c in columns])
