"""Evidence weights, stances and coverage states, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each evidence strength.
STRENGTH_WEIGHTS = {
    "DIRECT_EMPIRICAL": 1.0,
    "MODELED_EMPIRICAL": 0.8,
    "AUTHOR_INTERPRETATION": 0.4,
    "SECONDARY_EVIDENCE": 0.2,
    "EXPERT_OPINION": 0.1,
    "NOT_REPORTED": 0.0,
    "AMBIGUOUS_LEGACY_TIER": 0.0,
    "UNKNOWN": 0.3,
}
#: Strength of each legacy tier.
LEGACY_TIERS = {
    "E1": "DIRECT_EMPIRICAL",
    "E1_EXPLICIT": "DIRECT_EMPIRICAL",
    "E2": "MODELED_EMPIRICAL",
    "E2_DERIVED": "MODELED_EMPIRICAL",
    "E3": "AUTHOR_INTERPRETATION",
    "E3_REFERENCED": "SECONDARY_EVIDENCE",
    "E4": "AMBIGUOUS_LEGACY_TIER",
    "E4_NR": "NOT_REPORTED",
    "NOT_REPORTED": "NOT_REPORTED",
    "NR": "NOT_REPORTED",
}
#: Other spellings of appraisal levels.
LEVEL_ALIASES = {
    "directness": {"VERY_LOW": "LOW", "VERY_HIGH": "HIGH"},
    "independence": {"VERY_LOW": "LOW", "VERY_HIGH": "HIGH"},
    "risk_of_bias": {"HIGH_RISK": "HIGH", "VERY_HIGH": "HIGH", "SERIOUS": "HIGH", "SOME_CONCERNS": "MEDIUM", "VERY_LOW": "LOW"},
    "replication": {"VERY_LOW": "LOW", "VERY_HIGH": "HIGH"},
}
#: What each appraisal level multiplies a weight by.
LEVEL_FACTORS = {
    "directness": {"LOW": 0.6, "MEDIUM": 0.85},
    "independence": {"LOW": 0.6, "MEDIUM": 0.85},
    "risk_of_bias": {"HIGH": 0.6, "MEDIUM": 0.85},
    "replication": {"HIGH": 1.1, "LOW": 0.9},
}
#: Source layers from the weakest to the strongest.
LAYERS = ["default", "inferred", "project_search", "upstream_outputs", "current_attachments", "conversation", "current_user"]


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def token(text: Column) -> Column:
    return F.upper(F.trim(text))


def strength(raw: Column) -> Column:
    """A strength by its name or legacy tier; anything else is UNKNOWN."""
    t = token(F.coalesce(raw, F.lit("UNKNOWN")))
    return F.coalesce(F.when(t.isin(*STRENGTH_WEIGHTS), t), lookup(LEGACY_TIERS, t), F.lit("UNKNOWN"))


def weight(raw_strength: Column, **appraisal: Column) -> Column:
    """The base weight times the factors of the appraisal levels given, to three places."""
    total = lookup(STRENGTH_WEIGHTS, strength(raw_strength))
    for dimension, level in appraisal.items():
        t = token(level)
        canonical = F.coalesce(lookup(LEVEL_ALIASES[dimension], t), t)
        total = total * F.coalesce(lookup(LEVEL_FACTORS[dimension], canonical), F.lit(1.0))
    return F.round(total, 3)


def stance(raw: Column) -> Column:
    """SUPPORT, REFUTE, CONDITIONAL or NEUTRAL; null if it is none of the known words."""
    t = token(raw)
    return F.when(t == "OPPOSE", "REFUTE").when(t.isin("NULL", "MIXED", "NOT_TESTED"), "NEUTRAL").when(t.isin("SUPPORT", "REFUTE", "CONDITIONAL", "NEUTRAL"), t)


def coverage_status(execution: Column, reported: Column, retrieved: Column, pagination: Column) -> Column:
    """COMPLETE, PARTIAL or UNKNOWN. Hits that weren't reported (null) are not zero hits."""
    searched = execution.isin("SEARCHED_COMPLETE", "SEARCHED_VIA_USER_EXPORT")
    return (
        F.when(execution == "SEARCHED_PARTIAL", "PARTIAL")
        .when(~F.coalesce(searched, F.lit(False)), "UNKNOWN")
        .when((reported == 0) & (retrieved == 0), "COMPLETE")
        .when(pagination.isin("TRUNCATED_BY_LIMIT", "PARTIAL", "FAILED_MIDWAY"), "PARTIAL")
        .when(reported > 0, F.when(retrieved < reported, "PARTIAL").otherwise("COMPLETE"))
        .when(pagination == "COMPLETE", "COMPLETE")
        .when(retrieved == 0, "UNKNOWN")
        .otherwise("PARTIAL")
    )


def screening_status(raw: Column) -> Column:
    """Include, Exclude or Uncertain; null if unreadable, which is never Uncertain."""
    t = F.lower(F.trim(raw))
    return F.when(t.isin("include", "included", "yes", "1"), "Include").when(t.isin("exclude", "excluded", "no", "0"), "Exclude").when(t.isin("uncertain", "maybe", "unclear"), "Uncertain")
