"""cohortlab: cohort qualification as Spark DataFrame jobs.

Scenario config -> criterion events (code lists, date windows, birth-year
rule, group and claim thresholds) -> pairwise AND/OR combines with a signed
day-gap rule -> result tables. See README.md for the plan choices.
"""
