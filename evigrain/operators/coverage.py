"""Search plans against what was executed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import coverage_status

KEY = ["source_id", "query_id"]


def reconcile(plan: DataFrame, executed: DataFrame) -> DataFrame:
    """A row per planned query with its last execution; one that never ran is NOT_SEARCHED, with no hits known.

    ``executed`` has ``ordinal``, execution_status, reported_hits, retrieved and
    pagination. Executions outside the plan are dropped.
    """
    fields = ["execution_status", "reported_hits", "retrieved", "pagination"]
    last = executed.groupBy(*KEY).agg(F.max_by(F.struct(*fields), "ordinal").alias("__x"))
    out = plan.select(*KEY).distinct().join(last, KEY, "left").select(*KEY, *(F.col(f"__x.{f}").alias(f) for f in fields))
    out = out.withColumns({"execution_status": F.coalesce("execution_status", F.lit("NOT_SEARCHED")), "retrieved": F.coalesce("retrieved", F.lit(0)).cast("long")})
    return out.withColumn("coverage", coverage_status(F.col("execution_status"), F.col("reported_hits"), F.col("retrieved"), F.col("pagination")))


def gaps(plan: DataFrame, executed: DataFrame) -> DataFrame:
    """Planned queries that were never executed."""
    return plan.select(*KEY).distinct().join(executed.select(*KEY).distinct(), KEY, "left_anti")


def by_source(ledger: DataFrame) -> DataFrame:
    """Per source: queries, hits, rows, and COMPLETE if all are, UNKNOWN if one is, else PARTIAL."""
    state = F.when(F.bool_and(F.col("coverage") == "COMPLETE"), "COMPLETE").when(F.bool_or(F.col("coverage") == "UNKNOWN"), "UNKNOWN").otherwise("PARTIAL")
    return ledger.groupBy("source_id").agg(
        F.count("*").alias("queries"),
        F.sum("reported_hits").alias("reported_hits"),
        F.sum("retrieved").alias("retrieved"),
        F.round(F.count_if(F.col("execution_status") != "NOT_SEARCHED") / F.count("*"), 4).alias("execution_rate"),
        state.alias("coverage"),
    )


#: Executions that found no access, executions that claim an attempt, and databases by name.
ACCESS_FAILURES = ["AUTH_REQUIRED", "BOT_BLOCKED", "RATE_LIMITED", "TEMPORARILY_UNAVAILABLE", "NOT_SEARCHED", "USER_ASSISTED_REQUIRED", "JS_BROWSER_REQUIRED"]
ATTEMPTED = ["SEARCHED_COMPLETE", "SEARCHED_WITH_ERRORS"]
DATABASES = ["cnki", "wanfang", "vip", "web of science", "scopus", "openalex"]


def gate(ledger: DataFrame, *, frozen: bool, planned: DataFrame | None = None) -> DataFrame:
    """One row: six checks of a search ledger, each PASS, FAIL or UNKNOWN, and the verdict.

    ``ledger`` has source_id (a name), execution_status, reported_hits,
    retrieved, pagination and notes; ``planned`` has the source_id that were to
    be searched, if that was declared. A failure rejects; what can't be decided
    bars an unqualified pass.
    """
    status, hits, got = F.col("execution_status"), F.col("reported_hits"), F.col("retrieved")
    source, notes = F.lower(F.coalesce(F.col("source_id").cast("string"), F.lit(""))), F.lower(F.coalesce("notes", F.lit("")))
    no_attempt = status.isin(ATTEMPTED) & got.isNull() & hits.isNull()
    borrowed = functools.reduce(lambda x, y: x | y, (~source.contains(d) & notes.contains(d) for d in DATABASES)) & (status == "SEARCHED_COMPLETE")
    faults = {
        "access_failure_as_zero": status.isin(ACCESS_FAILURES) & (hits == 0),
        "substituted": no_attempt | borrowed,
        "no_pagination": F.coalesce(F.col("pagination"), F.lit("")) == "",
        "over_hits": hits.isNotNull() & (got.isNull() | (got > hits)),
    }
    counts = ledger.agg(F.count(hits).alias("__with_hits"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in faults.items()))
    if planned is None:
        missing = counts.select(F.lit(None).cast("long").alias("missing"))
    else:
        done = ledger.select(source.alias("__s")).distinct()
        missing = planned.select(F.lower(F.col("source_id").cast("string")).alias("__s")).distinct().join(done, "__s", "left_anti").agg(F.count("*").alias("missing"))

    def told(bad: Column, unknown: Column = F.lit(False)) -> Column:
        return F.when(unknown, "UNKNOWN").when(bad, "FAIL").otherwise("PASS")

    checks = {
        "no_access_failure_as_zero": told(F.col("access_failure_as_zero") > 0),
        "no_cross_source_substitution": told(F.col("substituted") > 0),
        "pagination_recorded": told(F.col("no_pagination") > 0),
        "hit_reconciliation_valid": told(F.col("over_hits") > 0, F.col("__with_hits") == 0),
        "planned_sources_accounted": told(F.col("missing") > 0, F.col("missing").isNull()),
        "corpus_frozen": told(F.lit(not frozen)),
    }
    # both sides have one row
    row = counts.join(F.broadcast(missing), F.lit(True)).select(*(c.alias(n) for n, c in checks.items()))
    states = F.array(*checks)
    return row.withColumn("verdict", F.when(F.array_contains(states, "FAIL"), "REJECT").when(F.array_contains(states, "UNKNOWN"), "PASS_WITH_UNKNOWNS").otherwise("PASS"))
