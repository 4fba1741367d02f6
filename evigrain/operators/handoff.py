"""Whether what one step hands on fits what the next one has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.handoff import NOT_OBTAINED, OBTAINED, STANCE_OF, challenge_fault, gate_failed


def independence(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: whether two reviewers' decisions (id, ``fields``, task_id) may be of one source.

    They are if both hold the same decisions, field by field, or share a task
    that isn't blank. A full outer join on the id tells, nothing is gathered.
    """
    x, y = (df.select("id", F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in [*fields, "task_id"])).alias(n)) for df, n in ((a, "x"), (b, "y")))
    met = x.join(y, "id", "full").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))
    tasks = [df.select("task_id").where("trim(task_id) <> ''").distinct() for df in (a, b)]
    shared = tasks[0].join(tasks[1], "task_id").agg(F.count("*").alias("shared_tasks"))
    # both sides have one row
    same = (F.col("common") > 0) & ((F.col("differing") == 0) | (F.col("shared_tasks") > 0))
    return met.join(F.broadcast(shared), F.lit(True)).withColumn("verdict", F.when(same, "IDENTICAL_SOURCES").otherwise("INDEPENDENT"))


def challenge_audit(challenges: DataFrame) -> DataFrame:
    """How many challenges each fault keeps from counting, and how many count; (challenge_status, challenge_scope, verification)."""
    fault = challenge_fault(F.col("challenge_status"), F.col("challenge_scope"), F.col("verification"))
    return challenges.groupBy(F.coalesce(fault, F.when(F.upper("challenge_status") == "VERIFIED_CHALLENGE", "COUNTS"), F.lit("NOT_VERIFIED")).alias("outcome")).agg(F.count("*").alias("challenges"))


def coherence(spans: DataFrame, by: Sequence[str], order: str, most: int = 1500) -> DataFrame:
    """The first fault between neighbouring spans (page, start, end, section) of each key, null if they are coherent.

    Neighbours may be a page and ``most`` characters apart, and not lead from
    an introduction to results.
    """
    w = W.partitionBy(*by).orderBy(order)
    back = {c: F.lag(c).over(w) for c in ("page", "end", "section")}
    fault = (
        F.when(F.abs(F.col("page") - back["page"]) > 1, "PAGES_APART")
        .when(F.abs(F.col("start") - back["end"]) > most, "TOO_FAR")
        .when(F.lower(back["section"]).contains("intro") & F.lower("section").contains("result"), "SECTIONS")
    )
    faults = spans.withColumn("__fault", fault)
    return faults.groupBy(*by).agg(F.count("*").alias("spans"), F.min_by("__fault", F.when(F.col("__fault").isNotNull(), F.col(order))).alias("fault"))


def evidence_chain(records: DataFrame, verdicts: DataFrame, single: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """One row: records, those no verdict names in any of its single or listed ids, and the share that is covered."""
    ids = records.select("id").where("id is not null")
    named = verdicts.select(F.explode(F.concat(F.array(*(F.col(c) for c in single)), *(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in listed))).alias("id")).where("id is not null").distinct()
    out = ids.join(named.withColumn("__known", F.lit(1)), "id", "left").agg(F.count("*").alias("records"), F.count_if(F.col("__known").isNull()).alias("orphans"))
    return out.withColumn("covered", F.round(1 - F.col("orphans") / F.greatest("records", F.lit(1)), 4))


def eligibility(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, issues: what bars each claim (evidence_ids) from a consensus, by its evidence (evidence_id, context, status, support, strength)."""
    named = claims.select("claim_id", F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id"))
    met = named.join(evidence.withColumn("__there", F.lit(True)), "evidence_id", "left")
    known = F.col("__there").isNotNull()
    rules = {
        "NO_EVIDENCE_IDS": F.col("evidence_id").isNull(),
        "EVIDENCE_NOT_FOUND": F.col("evidence_id").isNotNull() & ~known,
        "CONTEXT_INSUFFICIENT": known & (F.col("context") == "INSUFFICIENT"),
        "CONTEXT_PARTIAL": known & (F.col("context") == "PARTIALLY_SUFFICIENT"),
        "STATUS_WITHOUT_EVIDENCE": known & ~F.coalesce(F.col("status").isin(list(STANCE_OF)), F.lit(False)),
        "SUPPORT_NOT_REPORTED": known & F.col("support").isin("NOT_REPORTED", "NR"),
        "STRENGTH_UNKNOWN": known & (F.coalesce("strength", F.lit("UNKNOWN")).isin("UNKNOWN", "")),
    }
    # a flag for each rule, so that an issue counts once and nothing of a claim is gathered
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    return met.groupBy("claim_id").agg(*flags).select("claim_id", F.concat_ws(",", *(F.when(F.col(n), n) for n in rules)).alias("issues"))


def acquisition(ledger: DataFrame, *, candidates: DataFrame, frozen: int, retrieval_gaps: bool) -> DataFrame:
    """One row: what of the selected works was obtained, whether all candidates are still there, and the overall state."""
    got = ledger.agg(F.count("*").alias("selected"), F.count_if(F.col("status").isin(OBTAINED)).alias("obtained"), F.count_if(F.col("status").isin(NOT_OBTAINED)).alias("gaps"))
    row = got.join(F.broadcast(candidates.agg(F.count("*").alias("candidates"))), F.lit(True))
    lost, gap = F.lit(retrieval_gaps), F.col("gaps") > 0
    overall = (
        F.when((F.col("candidates") == 0) & lost, "FAILED")
        .when(lost & gap, "SUCCESS_WITH_RETRIEVAL_AND_ACQUISITION_GAPS")
        .when(lost, "SUCCESS_WITH_RETRIEVAL_GAPS")
        .when(gap, "SUCCESS_WITH_ACQUISITION_GAPS")
        .otherwise("SUCCESS")
    )
    rate = F.when(F.col("selected") > 0, F.round(F.col("obtained") / F.col("selected"), 4)).otherwise(1.0)
    return row.select("selected", "obtained", "gaps", "candidates", rate.alias("rate"), (F.col("candidates") >= frozen).alias("survived"), overall.alias("status"))


def outcome_counts(entries: DataFrame, by: Sequence[str], outcome: str, names: Sequence[str]) -> DataFrame:
    """Per key one counter a name, and whether the counters fail the quote gate."""
    counts = entries.groupBy(*by).agg(*(F.count_if(F.col(outcome) == n).cast("long").alias(n) for n in names))
    return counts.withColumn("failed", gate_failed(names))


def first_seen(rows: DataFrame, by: Sequence[str], item: str, order: str) -> DataFrame:
    """Each key's distinct items with their place by first sight: an ordered union."""
    once = rows.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.min(order).alias("__first"))
    return once.select(*by, item, F.row_number().over(W.partitionBy(*by).orderBy("__first", item)).alias("place"))


def ledger(events: DataFrame, by: Sequence[str], order: str, cap: int) -> DataFrame:
    """Reserve, settle and release (kind, amount, settled) under a cap: used and open amounts after each event, and a latch once a reserve went over.

    Amounts count as asked: a reserve over the cap latches and all after it see
    the latch.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    opened = F.when(F.col("kind") == "reserve", F.col("amount")).otherwise(-F.col("amount"))
    used = F.when(F.col("kind") == "settle", F.col("settled")).otherwise(0)
    out = events.withColumns({"open": F.sum(opened).over(w), "used": F.sum(used).over(w)})
    over = ((F.col("kind") == "reserve") & (F.col("open") + F.col("used") > cap)).cast("int")
    return out.withColumn("exhausted", F.max(over).over(w) == 1)


def accuracy(cases: DataFrame, by: Sequence[str], expected: Column, found: Column, least: float) -> DataFrame:
    """Per benchmark: cases, right ones, their share, and whether it reaches ``least``."""
    out = cases.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(expected.eqNullSafe(found)).alias("right"))
    share = F.round(F.col("right") / F.col("cases"), 4)
    return out.withColumns({"share": share, "status": F.when(share >= least, "PASS").otherwise("FAIL")})
