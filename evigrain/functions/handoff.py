"""Rules on single records that pass from one step to the next, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Challenge states and scopes, and verification states that contradict a verified challenge.
CHALLENGE_STATES = ["VERIFIED_CHALLENGE", "PENDING_HUMAN_CONFIRMATION", "UNRESOLVED"]
CHALLENGE_SCOPES = ["MECHANISM", "PREMISE", "SCOPE", "MAGNITUDE"]
CONTRADICTING = ["UNVERIFIED", "REJECTED", "PENDING", "PENDING_HUMAN_CONFIRMATION"]
#: Claim states that bear evidence, and the stance of each.
STANCE_OF = {"CONTRADICTORY": "REFUTE", "SUPPORTED": "SUPPORT", "PARTIALLY_SUPPORTED": "CONDITIONAL"}
#: Access colours of open works, ledger states with and without a full text.
OPEN_ACCESS = ["gold", "hybrid", "bronze", "diamond", "green"]
OBTAINED = ["OA_DOWNLOADED", "PREPRINT_AVAILABLE", "BROWSER_DOWNLOADED", "USER_PROVIDED"]
NOT_OBTAINED = ["PAYWALLED", "AUTH_REQUIRED", "DOWNLOAD_FAILED", "OA_BOT_BLOCKED", "CAJ_ONLY"]


def _token(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def given(c: Column) -> Column:
    """Whether a value is there and not blank."""
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""


def first_given(*columns: Column) -> Column:
    """The first value that isn't blank, as it is; null if all are."""
    return F.coalesce(*(F.when(given(c), c.cast("string")) for c in columns))


def is_challenge(relation: Column, state: Column) -> Column:
    return (_token(relation) == "CHALLENGE") | _token(state).isin(CHALLENGE_STATES)


def challenge_fault(state: Column, scope: Column, verification: Column) -> Column:
    """Why a verified challenge takes nothing off: its own verification contradicts it, or its scope is unknown; null if neither."""
    verified = _token(state) == "VERIFIED_CHALLENGE"
    odd_scope = (_token(scope) != "") & ~_token(scope).isin(CHALLENGE_SCOPES)
    return F.when(verified & _token(verification).isin(CONTRADICTING), "VERIFICATION_CONFLICT").when(verified & odd_scope, "SCOPE_REJECTED")


def support_type(derived: Column, role: Column, not_reported: Column, quote: Column) -> Column:
    """Where a value comes from: computed, cited, absent, or in the text."""
    return (
        F.when(F.coalesce(derived, F.lit(False)), "DERIVED")
        .when(role == "REFERENCED_WORK", "REFERENCED")
        .when(F.coalesce(not_reported, F.lit(False)) | ~given(quote), "NOT_REPORTED")
        .otherwise("EXPLICIT")
    )


def mapped_stance(stated: Column, source: Column, target: Column, agreement: Column, state: Column) -> Column:
    """Struct (stance, mapping): a stated stance wins; else the claim's state tells, unless known propositions aren't verified as one.

    ``agreement`` is the verdict on the two propositions.
    """
    from_state = F.lit("NEUTRAL")
    for k, v in STANCE_OF.items():
        from_state = F.when(state == k, v).otherwise(from_state)
    both = given(source) & given(target)
    stance = F.when(given(stated), F.upper(stated)).when(both & (F.coalesce(agreement, F.lit("")) != "VERIFIED_SAME_PROPOSITION"), "NEUTRAL").otherwise(from_state)
    mapping = F.when(given(stated), "AGENT_MAPPED").when(both, agreement).otherwise("UNRESOLVED")
    return F.struct(stance.alias("stance"), mapping.alias("mapping"))


def acquisition_state(link: Column, access: Column, downloaded: Column) -> Column:
    """What the download of a work came to; a failed look-up says nothing of a paywall."""
    tone = F.lower(F.coalesce(access, F.lit("")))
    return (
        F.when(given(link) & downloaded, F.when(tone == "green", "PREPRINT_AVAILABLE").otherwise("OA_DOWNLOADED"))
        .when(given(link), F.when(tone.isin(OPEN_ACCESS), "OA_BOT_BLOCKED").otherwise("DOWNLOAD_FAILED"))
        .when(F.coalesce(access, F.lit("")).startswith("OPENALEX_"), "DOWNLOAD_FAILED")
        .otherwise("PAYWALLED")
    )


def file_name(title: Column, author: Column, year: Column, kind: Column, degree: Column) -> Column:
    """year_[degree_]author_up to six words of the title.pdf, with letters, digits and underscores only."""
    own = F.regexp_replace(F.coalesce(F.element_at(F.split(F.trim(author), "[, ]+"), 1), F.lit("Unknown")), r"[^a-zA-Z0-9_\u4e00-\u9fa5]", "")
    level = F.lower(F.coalesce(degree, F.lit("")))
    prefix = (
        F.when(~F.coalesce(F.lower(kind).contains("thesis"), F.lit(False)), "")
        .when(level.rlike("phd|doctor|博士"), "PhD_")
        .when(level.rlike("master|硕士"), "Master_")
        .otherwise("Thesis_")
    )
    words = F.filter(F.split(F.regexp_replace(F.coalesce(title, F.lit("paper")), r"[^a-zA-Z0-9_\u4e00-\u9fa5\s]", ""), r"\s+"), lambda w: F.length(w) > 1)
    slug = F.when(F.size(words) > 0, F.left(F.array_join(F.slice(words, 1, 6), "_"), F.lit(50))).otherwise("document")
    return F.concat(F.coalesce(F.when(given(year), F.trim(year.cast("string"))), F.lit("UnknownYear")), F.lit("_"), prefix, own, F.lit("_"), slug, F.lit(".pdf"))


def abstract_of(index: Column, most: int = 500) -> Column:
    """A text from its inverted index, a map of words to places, cut at ``most`` characters with an ellipsis."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")
    whole = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return F.when(F.size(F.coalesce(F.map_keys(index), F.array())) > 0, whole).otherwise("Not available")


def moment(value: Column) -> Column:
    """An ISO-8601 time as a timestamp, taken as UTC where it names no zone; null if it is none."""
    text = F.regexp_replace(F.trim(value), "[Zz]$", "+00:00")
    zoned = F.when(text.rlike(r"[+-]\d{2}:\d{2}$"), text).when(text.rlike(r"\d{2}:\d{2}"), F.concat(text, F.lit("+00:00"))).otherwise(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"), zoned).try_cast("timestamp")


def has_replacement(*columns: Column) -> Column:
    """Whether a text, or a text in an array, holds U+FFFD: its encoding was lost."""
    return F.coalesce(F.concat_ws(" ", *columns).contains("\ufffd"), F.lit(False))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines or form feeds, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n|\f"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def sentence_with(text: Column, needle: Column) -> Column:
    """The first sentence that holds the needle, in any case; null if none does."""
    return F.get(F.filter(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: F.lower(s).contains(F.lower(needle))), 0)


def fingerprint(prefix: str, *fields: Column, length: int = 16) -> Column:
    """Prefix and start of a digest over fields with white space collapsed and case folded: layout doesn't change it."""
    plain = [F.lower(F.trim(F.regexp_replace(F.coalesce(f.cast("string"), F.lit("")), r"\s+", " "))) for f in fields]
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\x1f", *plain).cast("binary"), 256), F.lit(length)))


def numbered(prefix: str, place: Column, width: int = 3) -> Column:
    """A sequential id such as REC001; wider numbers keep all digits."""
    return F.concat(F.lit(prefix), F.when(F.length(place.cast("string")) >= width, place.cast("string")).otherwise(F.lpad(place.cast("string"), width, "0")))


def occurs(phrase: Column, source: Column) -> Column:
    """Whether a phrase stands in a source as whole words, whatever case, dashes and white space."""

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[\u2010-\u2015\u2212]", "-"), r"\s+", " "))

    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), plain(phrase), F.lit(r"\E(?![a-z0-9])"))
    return (plain(phrase) != "") & F.regexp_like(plain(source), quoted)


def source_risk(raw: Column, before: Column) -> Column:
    """What makes a paragraph doubtful: digits at a word's end, a word broken by a hyphen, a start in the middle of a sentence."""
    cut = raw.rlike("^[a-z]") & given(before) & ~before.rlike(r"""[.!?。！？:;][\s\)\]”’"']*$""")
    found = {"word-number": raw.rlike(r"[A-Za-z]{2,}\d"), "broken-word": raw.rlike(r"[A-Za-z]{2,}-\s+[A-Za-z]{2,}"), "paragraph-boundary": F.coalesce(cut, F.lit(False))}
    return F.array_compact(F.array(*(F.when(c, n) for n, c in found.items())))


#: The outcomes of a quote audit that fail it.
FAILING = [
    "not_found", "value_not_found_in_source", "value_not_in_quote_context", "value_unit_mismatch", "value_unknown_unit", "quote_too_long",
    "value_unparsable", "value_not_verifiable", "value_fuzzy_not_anchored", "value_ambiguous_sign",
]


def gate_failed(counts: Sequence[str], *, strict: bool = False, unverified_fails: bool = True) -> Column:
    """Whether an audit's counters, columns of the names in ``counts``, fail its gate."""
    fatal = [*FAILING, *(["fuzzy_match"] if strict else []), *(["unverified"] if unverified_fails else [])]
    return F.greatest(F.lit(0), F.lit(0), *(F.coalesce(F.col(c), F.lit(0)) for c in fatal if c in counts)) > 0
