"""Which way a statement points: negations, reversals and opposites, clause by clause, as column expressions.

All of it stays in the JVM: patterns count, higher-order functions fold clauses.
Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

#: What negates a clause.
NEGATIONS = (
    r"(?iU)\b(?:not|no|never|neither|nor|none|without|lack|lacks|lacking|absence|absent|rarely|seldom|failed? to|failing to|no evidence|declined? to|refused? to|cannot|can\s+not"
    r"|(?:do|does|did|can|could|wo|would|should|is|are|was|were|has|have|had)n't)\b"
    r"|不(?![同断过仅少久错论时拘朽])|未|无(?![疑论碍恙])|没有|并未|并非|并不|缺乏|缺少|极少|很少|未见|未发现|未支持|不能|无法|无显著|排除"
)
#: A negation of a negation; each of them counts once more.
DOUBLE_NEGATIONS = [
    r"(?iU)\bnot\s+(?:unknown|unlikely|impossible|negligible|absent|insignificant|uncommon|unexpected|unreported|uncertain|unavailable)\b",
    r"(?iU)\bcannot\s+but\b",
    r"(?iU)\b(?:cannot|can\s*not|can't|could\s+not|couldn't|did\s+not|didn't|does\s+not|doesn't|do\s+not|don't)\s+(?:be\s+)?"
    r"(?:excluded|denied|ruled\s+out|refuted|rejected|dismissed|overlooked|exclude|deny|rule\s+out|refute|reject|dismiss)\b",
    r"(?iU)\b(?:no|without)\s+doubt\b",
    r"(?:不|不能|并未|未)排除|并非没有|不无",
]
#: Verbs that turn a direction round.
REVERSALS = r"(?iU)\b(?:abolish\w*|revers\w*|eliminat\w*|overturn\w*|abrogat\w*|nullif\w*)\b|抵消|逆转|扭转|消除|推翻|废除"
#: A clause ends before one of these words and at these marks.
CONTRASTS = r"\b(?:while|whereas|but|however|unlike|although|though|yet|in\s+contrast|by\s+contrast|conversely|on\s+the\s+contrary)\b|然而|但是|不过|相反|尽管|虽然|相比之下|反观|而(?!且)"
MARKS = r"[，,；;。！!？?\n]+"
#: Stems of opposites, (one side, the other), by what they compare.
OPPOSITES = {
    "degree": ("most|highest|greatest|dominant|predominant|maximum|maximal|最高|主要|主导", "least|lowest|smallest|minor|negligible|minimum|minimal|最低|次要|可忽略"),
    "direction": (
        "increas|elevat|enhanc|promot|upregul|higher|greater|positive|上升|增加|升高|高于|促进|增强|提升|提高|上调|正相关",
        "decreas|declin|reduc|suppress|inhibit|impair|diminish|weaken|downregul|lower|negative|下降|减少|降低|低于|抑制|减弱|削弱|下调|负相关",
    ),
    "amount": ("more|更多|大于", "less|fewer|更少|小于"),
}


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def net_negations(text: Column) -> Column:
    """Negations, with one more for each double negation: an odd number negates."""
    return sum((F.regexp_count(_text(text), F.lit(p)) for p in DOUBLE_NEGATIONS), F.regexp_count(_text(text), F.lit(NEGATIONS))).cast("long")


def negation_words(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(NEGATIONS), F.lit(0))


def clauses(text: Column) -> Column:
    """Trimmed clauses. A word of contrast opens the clause that follows it."""
    parts = F.split(_text(text), rf"(?iU){MARKS}|(?={CONTRASTS})")
    return F.filter(F.transform(parts, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), lambda c: c != "")


def _side(clause: Column, turned: Column, pair: tuple[str, str]) -> Column:
    found = F.struct(*(clause.rlike(f"(?iU)(?:{p})").alias(n) for n, p in zip(("one", "two"), pair, strict=True)))
    return bound(found, lambda f: F.when(f["one"] & f["two"], "BOTH").when(f["one"] | f["two"], F.when(f["one"] == turned, "NEG").otherwise("POS")))


def clause_polarity(clause: Column) -> Column:
    """negated, reversed, and for each kind of opposite POS, NEG, BOTH or null."""
    state = F.struct((net_negations(clause) % 2 == 1).alias("negated"), clause.rlike(REVERSALS).alias("reversed"))
    return bound(state, lambda s: F.struct(s["negated"].alias("negated"), s["reversed"].alias("reversed"), *(_side(clause, s["negated"] | s["reversed"], pair).alias(name) for name, pair in OPPOSITES.items())))


def _parts(text: Column) -> Column:
    return F.transform(clauses(text), lambda c: clause_polarity(c))


def _merged(parts: Column, name: str) -> Column:
    seen = F.array_distinct(F.filter(F.transform(parts, lambda p: p[name]), lambda s: s.isNotNull()))
    return bound(seen, lambda s: F.when(F.size(s) > 1, "BOTH").when(F.size(s) == 1, F.get(s, F.lit(0))))


def signature(text: Column) -> Column:
    """The polarity of a whole text: that of its clauses, merged; ``negated`` is its own parity."""
    return bound(
        _parts(text),
        lambda parts: F.struct(
            (net_negations(text) % 2 == 1).alias("negated"),
            F.exists(parts, lambda p: p["reversed"]).alias("reversed"),
            *(_merged(parts, name).alias(name) for name in OPPOSITES),
            F.size(F.filter(parts, lambda p: p["negated"])).alias("negated_clauses"),
            F.size(parts).alias("total_clauses"),
        ),
    )


def check(claim: Column, evidence: Column) -> Column:
    """CONTRADICTORY, UNRESOLVED, or null where evidence and claim point the same way or either is blank.

    Opposites decide, kind by kind in their order; only a claim without any is
    compared by its negations, which all clauses of the evidence must share.
    """
    blank = F.trim(_text(claim)) == ""
    return bound(F.struct(signature(claim).alias("said"), _evidence(evidence).alias("there")), lambda x: F.when(~blank & (x["there"]["clauses"] > 0), _verdict(x["said"], x["there"])))


def _evidence(text: Column) -> Column:
    return bound(
        _parts(text),
        lambda parts: F.struct(
            F.size(parts).alias("clauses"),
            F.exists(parts, lambda p: p["reversed"]).alias("reversed"),
            F.exists(parts, lambda p: F.coalesce(*(p[name] for name in OPPOSITES)).isNotNull()).alias("directed"),
            F.array_distinct(F.transform(parts, lambda p: p["negated"])).alias("negated"),
            *(_merged(parts, name).alias(name) for name in OPPOSITES),
        ),
    )


def _verdict(said: Column, there: Column) -> Column:
    verdicts = []
    for name in OPPOSITES:
        one, two = said[name], there[name]
        verdict = F.when((one == "BOTH") | F.coalesce(two == "BOTH", F.lit(False)), "UNRESOLVED").when(two.isNull(), F.when(there["reversed"] | there["directed"], "UNRESOLVED")).when(two != one, "CONTRADICTORY")
        verdicts.append(F.when(one.isNotNull(), verdict))
    opposed = F.coalesce(*(said[name] for name in OPPOSITES)).isNotNull()
    negated = there["negated"]
    by_negation = F.when(F.size(negated) > 1, "UNRESOLVED").when(said["negated"] != F.get(negated, F.lit(0)), "CONTRADICTORY").when(there["reversed"] & ~there["directed"], "UNRESOLVED")
    return F.when(opposed, F.coalesce(*verdicts)).otherwise(by_negation)
