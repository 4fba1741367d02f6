"""Identity keys of bibliographic records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a title key keeps besides ASCII letters and digits.
CJK = "一-龥"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def doi_key(raw: Column) -> Column:
    """The DOI as an identity key, or null for placeholders and what has no DOI's shape.

    Lower case, without URL or scheme prefix, percent-decoded, without trailing
    ``.``, ``,`` and ``;``. A plus sign isn't a space here.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"^(?:https?://)?(?:dx\.)?doi\.org/", ""), r"^(?:info:)?doi:\s*", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S"), F.regexp_replace(F.trim(decoded), r"[.,;]+$", ""))


def title_key(title: Column) -> Column:
    """Lower case, letters, digits and CJK ideographs only; null if nothing is left."""
    key = F.regexp_replace(F.lower(title), f"[^a-z0-9{CJK}]", "")
    return F.when(F.length(key) > 0, key)


def record_id(doi: Column, title: Column, year: Column, first_author: Column, openalex: Column | None = None) -> Column:
    """``REC-`` and 12 hex digits of the best key there is: DOI, catalogue id, or title, year and author."""
    work = F.nullif(F.trim(openalex), F.lit("")) if openalex is not None else F.lit(None).cast("string")
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"(?U)[^\w\s]", "")
    fallback = F.concat(
        F.lit("title:"), bare, F.lit("|year:"), F.coalesce(year.cast("string"), F.lit("NR")), F.lit("|author:"), F.coalesce(F.lower(F.trim(first_author)), F.lit("unknown"))
    )
    key = F.coalesce(F.concat(F.lit("doi:"), doi_key(doi)), F.concat(F.lit("openalex:"), F.lower(work)), fallback)
    return F.concat(F.lit("REC-"), F.left(F.sha2(key, 256), F.lit(12)))


def year_of(text: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"\b(19\d\d|20\d\d)\b", 1), F.lit("")), F.lit("9999")).cast("int")


def items(text: Column, marks: str = "[;,/]") -> Column:
    """Parts between marks, cleaned, without empty ones and repeats, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, marks), clean), lambda x: F.length(x) > 0))


def url_key(url: Column) -> Column:
    """A page's address without scheme, ``www.``, query, fragment and final slash, in lower case."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def metadata_level(title: Column, abstract: Column, authors: Column, year: Column) -> Column:
    """How much of a record's metadata there is."""

    def there(c: Column) -> Column:
        return F.length(F.trim(F.coalesce(c.cast("string"), F.lit("")))) > 0

    return (
        F.when(there(title) & there(abstract) & there(authors) & year.isNotNull(), "FULL_METADATA")
        .when(there(title) & there(abstract), "TITLE_ABSTRACT")
        .when(there(title) & there(authors), "TITLE_AUTHOR")
        .otherwise("TITLE_ONLY")
    )
