"""Weighted consensus of claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPIRICAL = ("DIRECT_EMPIRICAL", "MODELED_EMPIRICAL")
STANCES = ("SUPPORT", "REFUTE", "CONDITIONAL")


def classification(total: Column, claims: Column, groups: Column, support: Column, refute: Column, conditional: Column, verified: Column, empirical: Column) -> Column:
    """The first of six rules that holds."""
    return (
        F.when((total < 1.0) | (claims < 2) | (groups < 2), "INSUFFICIENT_EVIDENCE")
        .when(((support >= 0.40) & (refute >= 0.40)) | (support.between(0.30, 0.70) & refute.between(0.30, 0.70)), "ACTIVE_CONTROVERSY")
        .when(conditional >= 0.45, "CONDITIONAL_CONSENSUS")
        .when((support >= 0.80) & (verified >= 2) & empirical, "STRONG_CONSENSUS")
        .when(support >= 0.65, "MODERATE_CONSENSUS")
        .otherwise("CONDITIONAL_CONSENSUS")
    )


def exact_sum(value: Column) -> Column:
    """A sum of doubles that is the same in any order: of 15 decimals each, rounded to 12."""
    return F.sum(value.cast("decimal(28,15)")).cast("decimal(38,12)").cast("double")


def topic_consensus(claims: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """One row per topic: weights of the stances, their shares, and the consensus class.

    ``claims`` has the columns of ``by``, ``group_id``, ``stance``, ``strength``,
    ``weight`` and ``verified``. Rows of no weight or neutral stance are left
    out. The claims of one independence group weigh 1 in all at most. Sums are
    exact and shares of 12 decimals, so one on a rule's edge is on it whatever
    the partitions. Two
    aggregations on nested keys; both combine before their shuffle.
    """
    keys = list(by)
    eligible = claims.where((F.col("weight") > 0) & F.col("stance").isin(*STANCES))
    sums = [exact_sum(F.when(F.col("stance") == s, F.col("weight")).otherwise(0.0)).alias(s.lower()) for s in STANCES]
    supports = F.col("stance") == "SUPPORT"
    group = eligible.groupBy(*keys, "group_id").agg(
        *sums,
        F.count("*").alias("claims"),
        F.max((supports & F.col("verified")).cast("int")).alias("verified"),
        F.max((supports & F.col("strength").isin(*EMPIRICAL)).cast("int")).alias("empirical"),
    )
    mass = F.col("support") + F.col("refute") + F.col("conditional")
    scale = F.when(mass > 1.0, 1.0 / mass).otherwise(1.0)
    topic = group.groupBy(*keys).agg(
        *(exact_sum(F.col(s.lower()) * scale).alias(s.lower()) for s in STANCES),
        F.sum("claims").alias("claims"),
        F.count("*").alias("groups"),
        F.sum("verified").alias("verified"),
        F.max("empirical").alias("empirical"),
    )
    total = F.round(F.col("support") + F.col("refute") + F.col("conditional"), 12)
    shares = topic.withColumn("total_weight", total).withColumns({f"{s.lower()}_ratio": F.round(F.col(s.lower()) / F.col("total_weight"), 12) for s in STANCES})
    label = classification(F.col("total_weight"), F.col("claims"), F.col("groups"), F.col("support_ratio"), F.col("refute_ratio"), F.col("conditional_ratio"), F.col("verified"), F.col("empirical") == 1)
    return shares.select(*keys, "claims", "groups", *(F.round(c, 4).alias(c) for c in ("total_weight", "support_ratio", "refute_ratio", "conditional_ratio")), label.alias("consensus"))


def stratified_consensus(claims: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Consensus of each topic as a whole (``overall``, stratum null) and of each of its strata, in one pass over the claims.

    Claims without a stratum are a stratum of their own, null but not overall.
    """
    sets = F.array(F.struct(F.col(stratum).cast("string").alias("s"), F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("s"), F.lit(True).alias("all")))
    both = claims.withColumn("__set", F.explode(sets)).withColumns({"__s": F.col("__set.s"), "overall": F.col("__set.all")}).drop("__set")
    return topic_consensus(both, ("topic", "__s", "overall")).withColumnRenamed("__s", "stratum")


def exclusions(claims: DataFrame) -> DataFrame:
    """How many claims each reason keeps out of a consensus; a claim may count for several."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("stance").isNull(), "INVALID_STANCE"),
            F.when(F.col("stance") == "NEUTRAL", "NEUTRAL_STANCE"),
            F.when(F.coalesce(F.col("weight"), F.lit(0.0)) <= 0, "ZERO_WEIGHT"),
            F.when(F.col("group_id").isNull(), "NO_GROUP"),
        )
    )
    return claims.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("claims"))


#: What a challenge takes off, and the most that one group may.
PENALTIES = {"WEAKENS": 0.25, "REFUTES": 0.5}
GROUP_CAP = 0.5


def challenged_weights(claims: DataFrame, challenges: DataFrame) -> DataFrame:
    """claim_id, weight, penalty, adjusted: challenges add up within a group up to a cap, then over groups."""
    amount = F.sum(F.when(F.col("challenge") == "REFUTES", PENALTIES["REFUTES"]).when(F.col("challenge") == "WEAKENS", PENALTIES["WEAKENS"]).otherwise(0.0))
    group = challenges.groupBy("claim_id", "group_id").agg(F.least(amount, F.lit(GROUP_CAP)).alias("amount"))
    target = group.groupBy("claim_id").agg(F.sum("amount").alias("penalty"))
    out = claims.join(target, "claim_id", "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    return out.withColumn("adjusted", F.round(F.greatest(F.lit(0.0), F.col("weight") - F.col("penalty")), 4))


def diagnosis(claims: DataFrame) -> DataFrame:
    """Per topic: whether it has both sides, disjoint methods, and a metric over twice the other's."""
    topic = claims.groupBy("topic").agg(
        F.max((F.col("stance") == "SUPPORT").cast("int")).alias("has_support"),
        F.max((F.col("stance") == "REFUTE").cast("int")).alias("has_refute"),
        F.collect_set(F.when(F.col("stance") == "SUPPORT", F.col("method"))).alias("__s"),
        F.collect_set(F.when(F.col("stance") == "REFUTE", F.col("method"))).alias("__r"),
        F.avg(F.when(F.col("stance") == "SUPPORT", F.col("metric"))).alias("__a"),
        F.avg(F.when(F.col("stance") == "REFUTE", F.col("metric"))).alias("__b"),
    )
    ratio = F.greatest("__a", "__b") / F.nullif(F.least("__a", "__b"), F.lit(0.0))
    kind = (
        F.when((F.col("has_support") == 0) | (F.col("has_refute") == 0), "NO_CONTROVERSY")
        .when(~F.arrays_overlap("__s", "__r"), "METHOD")
        .when(ratio > 2, "MAGNITUDE")
        .otherwise("UNRESOLVED")
    )
    return topic.select("topic", "has_support", "has_refute", kind.alias("controversy"))
