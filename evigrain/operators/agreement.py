"""Agreement and coverage of two reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("Include", "Exclude", "Uncertain")
LEAST_SAMPLE = 5


def cohens_kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sample, observed and expected agreement, kappa with its 95 % interval, binary kappa, a label.

    ``a`` and ``b`` have ``id`` and ``status``. The join and the count of
    status pairs are distributed; what follows works on nine rows.
    """
    pairs = a.select("id", F.col("status").alias("sa")).join(b.select("id", F.col("status").alias("sb")), "id").groupBy("sa", "sb").agg(F.count("*").alias("n"))

    def count(condition) -> F.Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("double")

    sums = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_size"),
        count(F.col("sa") == F.col("sb")).alias("agreed"),
        *(count(F.col("sa") == c).alias(f"a{i}") for i, c in enumerate(CATEGORIES)),
        *(count(F.col("sb") == c).alias(f"b{i}") for i, c in enumerate(CATEGORIES)),
        count((F.col("sa") == "Include") == (F.col("sb") == "Include")).alias("binary_agreed"),
    )
    n = F.col("sample_size")
    chance = sums.select(
        "sample_size",
        (F.col("agreed") / n).alias("po"),
        (sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(3)), F.lit(0.0)) / (n * n)).alias("pe"),
        (F.col("binary_agreed") / n).alias("bpo"),
        ((F.col("a0") * F.col("b0") + (n - F.col("a0")) * (n - F.col("b0"))) / (n * n)).alias("bpe"),
    )

    def kappa(po: str, pe: str) -> F.Column:
        return F.when(F.col(pe) == 1, F.when(F.col(po) == 1, 1.0).otherwise(0.0)).otherwise((F.col(po) - F.col(pe)) / (1 - F.col(pe)))

    scored = chance.withColumn("kappa", kappa("po", "pe")).withColumn("bkappa", kappa("bpo", "bpe"))
    error = F.when((F.col("po") > 0) & (F.col("po") < 1) & (F.col("pe") < 1), F.sqrt(F.col("po") * (1 - F.col("po")) / (n * F.pow(1 - F.col("pe"), 2)))).otherwise(0.0)
    label = F.when(F.col("kappa") >= 0.81, "Almost Perfect").when(F.col("kappa") >= 0.61, "Substantial").when(F.col("kappa") >= 0.41, "Moderate").when(F.col("kappa") >= 0.21, "Fair").otherwise("Slight / Poor")
    return scored.select(
        "sample_size",
        F.when(n >= LEAST_SAMPLE, "PASS").otherwise("UNDERPOWERED").alias("sample_status"),
        F.round("po", 4).alias("observed_agreement"),
        F.round("pe", 4).alias("expected_agreement"),
        F.round("kappa", 4).alias("cohens_kappa"),
        F.round(F.greatest(F.lit(-1.0), F.col("kappa") - 1.96 * error), 4).alias("ci_lower"),
        F.round(F.least(F.lit(1.0), F.col("kappa") + 1.96 * error), 4).alias("ci_upper"),
        F.round("bkappa", 4).alias("binary_kappa"),
        label.alias("interpretation"),
    )


def reviewer_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids that only one reviewer has, both have, and all."""
    both = a.select("id").distinct().withColumn("__a", F.lit(1)).join(b.select("id").distinct().withColumn("__b", F.lit(1)), "id", "full")
    has_a, has_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(F.count_if(has_a & ~has_b).alias("only_a"), F.count_if(~has_a & has_b).alias("only_b"), F.count_if(has_a & has_b).alias("common"), F.count("*").alias("all_ids"))


def decision_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per id with both verdicts, and whether somebody must decide between them."""
    joined = a.select("id", F.col("status").alias("status_a")).join(b.select("id", F.col("status").alias("status_b")), "id", "full")
    outcome = F.when(F.col("status_a").isNull() | F.col("status_b").isNull(), "SINGLE_REVIEW").when(F.col("status_a") == F.col("status_b"), "AGREED").otherwise("ARBITRATION")
    return joined.withColumn("outcome", outcome)


def last_decisions(decisions: DataFrame, order: str = "ordinal") -> DataFrame:
    """The last row of each id, in the order given."""
    others = [c for c in decisions.columns if c != "id"]
    last = decisions.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("__last"))
    return last.select("id", *(F.col(f"__last.{c}").alias(c) for c in others))
