"""Where a quote stands in its source, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound
from .textual import join_hyphens

#: Characters that stand for plainer ones.
CONFUSABLE = {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", "μ": "µ", "％": "%", "（": "(", "）": ")", "：": ":", "；": ";"}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Fixed value: windows are looked at from this many first tokens.
MOST_STARTS = 400
#: Fixed value: the share of a quote's tokens that a window holds at least.
LEAST_RATIO = 0.95


def plain(text: Column) -> Column:
    """Lower case, single blanks, confusable characters made plain. Canonical composition isn't done."""
    out = F.translate(F.coalesce(text, F.lit("")), "".join(CONFUSABLE), "".join(CONFUSABLE.values()))
    for mark, letters in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return F.trim(F.regexp_replace(F.lower(out), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def best_window(needle: Column, haystack: Column) -> Column:
    """Struct of ratio and start: the first window of as many tokens as the needle has distinct ones that holds most of them.

    ``needle`` and ``haystack`` are arrays of tokens; start counts tokens from
    0 and is null where nothing is found.
    """

    def search(x: Column) -> Column:
        need, hay = x["need"], x["hay"]
        m = F.size(need)
        last = F.least(F.greatest(F.size(hay) - m, F.lit(0)), F.lit(MOST_STARTS - 1))
        held = F.transform(F.sequence(F.lit(0), last), lambda i: F.size(F.array_intersect(need, F.slice(hay, i + 1, m))))
        best = bound(held, lambda h: F.struct((F.array_max(h) / m).alias("ratio"), F.when(F.array_max(h) > 0, F.array_position(h, F.array_max(h)).cast("int") - 1).alias("start")))
        return F.when((m > 0) & (F.size(hay) > 0), best).otherwise(F.struct(F.lit(0.0).alias("ratio"), F.lit(None).cast("int").alias("start")))

    return bound(F.struct(F.array_distinct(needle).alias("need"), haystack.alias("hay")), search)


def locate(quote: Column, source: Column, threshold: float = LEAST_RATIO) -> Column:
    """Struct of how (EXACT, HYPHEN_JOIN, WHITESPACE_RELAXED, FUZZY, NOT_FOUND, EMPTY) and ratio.

    White space inside a quote is ignored for Chinese text alone. A null or
    blank quote is EMPTY, and nothing is found in a null source.
    """

    def judge(x: Column) -> Column:
        q, s = x["quote"], x["source"]
        bare = lambda t: F.replace(t, F.lit(" "), F.lit(""))
        how = (
            F.when(q == "", "EMPTY")
            .when(F.contains(s, q), "EXACT")
            .when(F.contains(join_hyphens(s), join_hyphens(q)), "HYPHEN_JOIN")
            .when(q.rlike("[一-鿿]") & F.contains(bare(s), bare(q)), "WHITESPACE_RELAXED")
        )
        fuzzy = bound(best_window(tokens(q), tokens(s))["ratio"], lambda r: F.struct(F.when(r >= threshold, "FUZZY").otherwise("NOT_FOUND").alias("how"), r.alias("ratio")))
        return bound(how, lambda h: F.when(h.isNotNull(), F.struct(h.alias("how"), F.when(h == "EMPTY", 0.0).otherwise(1.0).alias("ratio"))).otherwise(fuzzy))

    return bound(F.struct(plain(quote).alias("quote"), plain(source).alias("source")), judge)
