"""Small gates on records and sentences, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import lookup

#: What marks a thesis.
THESIS_TYPES = ["dissertation", "thesis"]
THESIS_TITLES = r"(?i)\bdoctoral thesis\b|\bphd thesis\b|\bmaster'?s thesis\b|\bdoctoral dissertation\b|\bmaster dissertation\b"
#: States that aren't evidence, by token.
NON_EVIDENCE = {
    "NOT_REPORTED": "NOT_REPORTED",
    "NOTREPORTED": "NOT_REPORTED",
    "NR": "NOT_REPORTED",
    "N_R": "NOT_REPORTED",
    "N_A": "NOT_REPORTED",
    "NA": "NOT_REPORTED",
    "NONE": "NOT_REPORTED",
    "NULL": "NOT_REPORTED",
    "NOT_AVAILABLE": "NOT_REPORTED",
    "UNCHECKED": "UNCHECKED",
    "NOT_CHECKED": "UNCHECKED",
    "UN_CHECKED": "UNCHECKED",
    "INACCESSIBLE": "INACCESSIBLE",
    "NOT_ACCESSIBLE": "INACCESSIBLE",
    "CITED_ONLY": "CITED_ONLY",
    "CITEDONLY": "CITED_ONLY",
    "REFERENCED_ONLY": "CITED_ONLY",
    "REFERENCEDONLY": "CITED_ONLY",
}
#: A candidate's states in their order.
LIFECYCLE = ["LOCATED", "CONTEXT_EXPANDING", "SEMANTICALLY_CLASSIFIED", "ALIGNED", "EXTRACTED", "VERIFIED", "AUDITED"]
#: Words that soften a claim, bound it, or point back to the sentence before.
MODALITY = r"(?i)\b(?:may|might|could|suggest|suggests|suggested|suggesting|possibly|possible|likely|hypothesized|speculate|speculated|preliminary|unconfirmed|putative)\b|可能|提示|推测|或许|假定|潜在"
QUANTIFIERS = r"(?i)\b(?:some|most|all|subset|only|primarily|partially|occasionally|predominantly|minority|majority)\b"
ANAPHORA = r"(?i)^(?:this|these|those|they|it|such|the authors|furthermore|moreover|however|in contrast|consequently|therefore|the former|the latter|case\s+\d+|step\s+\d+)\b|^[该此其这些那些]"
#: References to claims, and cues that a paragraph states a fact.
CLAIM_REFERENCE = r"(?i)\bCLM-(?:\d{3,}|[A-Za-z_][A-Za-z0-9_.:-]*)\b"
FACTUAL_CUE = r"(?i)研究表明|结果显示|研究发现|据报道|有研究报道|证据表明|demonstrat\w+|reported|showed that|found that|indicated that|suggest\w* that|\d+(?:\.\d+)?\s*%"
#: Words that don't tell propositions apart, and verbs that mean the same.
FILLERS = ["the", "a", "an", "in", "of", "to", "under", "soil", "significantly", "rates", "by"]
SYNONYMS = [["increases", "stimulates", "increased", "stimulated", "stimulate", "increase"], ["decreases", "reduces", "decreased", "reduced", "decrease", "reduce"]]


def is_thesis(kind: Column, title: Column) -> Column:
    return F.coalesce(F.lower(F.trim(kind)).isin(THESIS_TYPES), F.lit(False)) | F.coalesce(title.rlike(THESIS_TITLES), F.lit(False))


def state_token(value: Column) -> Column:
    """Upper case; whatever is no letter or digit is one underscore, none at the ends."""
    return F.upper(F.regexp_replace(F.regexp_replace(value, "[^0-9A-Za-z一-龥]+", "_"), "^_+|_+$", ""))


def non_evidence_class(*states: Column, nullable: Sequence[int] = ()) -> Column:
    """The class of the first state that says no evidence; null if none does.

    A blank state is UNPARSEABLE, and so is a null one unless its place is in
    ``nullable``. Leave out states that the source doesn't have.
    """
    found = []
    for i, s in enumerate(states):
        told = F.when(state_token(s) == "", "UNPARSEABLE").otherwise(lookup(NON_EVIDENCE, state_token(s)))
        found.append(F.when(s.isNotNull(), told) if i in nullable else F.when(s.isNull(), "UNPARSEABLE").otherwise(told))
    return F.coalesce(*found)


def lifecycle_step(now: Column, then: Column) -> Column:
    """OK for one step on; BACKWARDS, SKIPPED or UNKNOWN_STATE otherwise."""
    order = F.array(*(F.lit(s) for s in LIFECYCLE))
    a, b = F.coalesce(F.array_position(order, now), F.lit(0)), F.coalesce(F.array_position(order, then), F.lit(0))
    return F.when((a == 0) | (b == 0), "UNKNOWN_STATE").when(b == a + 1, "OK").when(b <= a, "BACKWARDS").otherwise("SKIPPED")


def is_whole_pdf(content: Column, least_bytes: int = 10_240) -> Column:
    return F.coalesce((F.octet_length(content) >= least_bytes) & (F.substring(content, 1, 5) == F.lit(b"%PDF-")), F.lit(False))


def outbound_query(query: Column, private: Sequence[str] = ()) -> Column:
    """A query without file paths and without private words, white space made single."""
    out = F.regexp_replace(F.regexp_replace(query, r"file:///\S+", ""), r"[A-Za-z]:\\\S+", "")
    for word in private:
        out = F.regexp_replace(out, F.concat(F.lit(r"(?iu)\Q"), F.lit(word), F.lit(r"\E")), F.lit(""))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "^ | $", "")


def sentence_marks(sentence: Column) -> Column:
    """How far a sentence is softened, bounded, and leans on the one before."""
    count = lambda p: F.coalesce(F.regexp_count(sentence, F.lit(p)), F.lit(0)).cast("long")
    return F.struct(count(MODALITY).alias("modality"), count(QUANTIFIERS).alias("quantifiers"), F.coalesce(F.trim(sentence).rlike(ANAPHORA), F.lit(False)).alias("leans"))


def claim_references(text: Column) -> Column:
    """Claim ids in the order of their first mention, in capitals."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLAIM_REFERENCE), F.lit(0)), F.upper))


def is_prose(paragraph: Column) -> Column:
    """Whether any line that isn't blank is no heading, table row, quote or list item."""
    return F.coalesce(F.exists(F.split(paragraph, r"\r?\n"), lambda s: s.rlike(r"\S") & ~s.rlike(r"^\s*(?:[#|>\-*+]|\d+[.)]\s)")), F.lit(False))


def unsupported_paragraphs(text: Column) -> Column:
    """Prose paragraphs that state a fact without naming a claim."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: is_prose(p) & p.rlike(FACTUAL_CUE) & ~p.rlike(CLAIM_REFERENCE))


def proposition(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9一-龥]+", " "))


def same_proposition(one: Column, two: Column) -> Column:
    """SAME, DIFFERENT, or UNRESOLVED: a side is missing, or has the same words in another order."""
    a, b = proposition(one), proposition(two)
    words = lambda x: F.filter(F.array_distinct(F.split(x, " ")), lambda w: w != "")
    own, others = (F.array_except(F.array_except(words(x), words(y)), F.array(*map(F.lit, FILLERS))) for x, y in ((a, b), (b, a)))
    swapped = (F.size(F.array_except(words(a), words(b))) == 0) & (F.size(F.array_except(words(b), words(a))) == 0) & (a != "")
    synonyms = F.lit(False)
    for group in SYNONYMS:
        synonyms |= F.size(F.array_except(F.concat(own, others), F.array(*map(F.lit, group)))) == 0
    missing = (F.coalesce(one, F.lit("")) == "") | (F.coalesce(two, F.lit("")) == "")
    return F.when(missing, "UNRESOLVED").when(a == b, "SAME").when(swapped, "UNRESOLVED").when((F.size(own) > 0) & (F.size(others) > 0) & ~synonyms, "DIFFERENT").otherwise("SAME")


def quote_support(quote: Column, reference: Column, *, fragment: float = 0.5, overlap: float = 0.85) -> Column:
    """Struct of supported, how (EXACT, FRAGMENT, OVERLAP, KEYWORD_ONLY, EMPTY) and ratio.

    Texts are compared in lower case with single blanks and rejoined hyphens.
    The ratio is the share of the reference that the quote covers: of its
    length for a fragment, else of its Latin words and pairs of characters.
    """
    from .textual import join_hyphens, ngrams

    flat = lambda t: F.trim(F.lower(F.regexp_replace(join_hyphens(F.coalesce(t, F.lit(""))), r"\s+", " ")))
    q, p = flat(quote), flat(reference)
    short = lambda t: F.when(F.char_length(F.replace(t, F.lit(" "), F.lit(""))) == 1, F.array(t)).otherwise(ngrams(t, 2))
    units = lambda t: F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), short(t)))
    share = F.size(F.array_intersect(units(p), units(q))) / F.size(units(p))
    part = F.char_length(q) / F.char_length(p)
    how = F.when((q == "") | (p == ""), "EMPTY").when(F.contains(q, p), "EXACT").when(F.contains(p, q), "FRAGMENT").when(share >= overlap, "OVERLAP").otherwise("KEYWORD_ONLY")
    ratio = F.when(how == "EMPTY", 0.0).when(how == "EXACT", 1.0).when(how == "FRAGMENT", part).otherwise(share)
    supported = how.isin("EXACT", "OVERLAP") | ((how == "FRAGMENT") & (part >= fragment))
    return F.struct(supported.alias("supported"), how.alias("how"), ratio.alias("ratio"))
