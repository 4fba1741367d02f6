"""Search and containment of texts in texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(parts: Column, size: int, most: int) -> Column:
    """Where a word stands: after all parts before it and the words between them."""

    def place(i: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.char_length(x))
        return before + (i - 1) * size + 1

    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most))), place)


def keyword_hits(docs: DataFrame, words: Sequence[str], key: str = "doc_id", text: str = "text", most: int = 10, window: int = 150) -> DataFrame:
    """The first ``most`` places of each word in each text, with the text around them.

    Words are a fixed list, so every text is read once and nothing is joined;
    places come from one split a word.
    """
    low = F.lower(F.col(text))
    found = []
    for w in words:
        parts = F.split(low, F.lit("\\Q" + w + "\\E"), -1)
        places = _places(parts, len(w), most)
        found.append(F.struct(F.lit(w).alias("word"), F.when(F.size(parts) > 1, places).otherwise(F.array().cast("array<int>")).alias("places")))
    hits = docs.select(key, text, F.explode(F.array(*found)).alias("__h")).select(key, text, "__h.word", F.posexplode("__h.places").alias("nth", "place"))
    around = F.substring(F.col(text), F.greatest(F.lit(1), F.col("place") - window), F.lit(window) + F.char_length("word") + F.least(F.lit(window), F.col("place") - 1))
    return hits.select(key, "word", (F.col("nth") + 1).alias("nth"), "place", around.alias("context"))


def quotes_in(quotes: DataFrame, sources: DataFrame, quote_key: str, quote: str, source_key: str, source: str, gram: int = 6) -> DataFrame:
    """(quote, source) pairs where the source holds the quote as it is, white space aside.

    A source can only hold a quote if it has the quote's first ``gram`` words in
    a row, or all words of a shorter quote, so both sides meet on a hash of
    those; only then are texts compared. Runs of a shorter length are made only
    if a quote has just that many words. Blank quotes are in no source.
    """

    def words(c):
        return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")

    def runs(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("__w") - size + 1), lambda i: F.xxhash64(F.array_join(F.slice("__w", i, F.lit(size)), " ")))

    q = quotes.select(quote_key, words(F.col(quote)).alias("__w")).where("__w[0] <> ''").withColumn("__n", F.least(F.size("__w"), F.lit(gram)))
    # as many rows as there are lengths up to ``gram``
    sizes = sorted(r[0] for r in q.select("__n").distinct().collect())
    q = q.select(quote_key, F.array_join("__w", " ").alias("__q"), F.xxhash64(F.array_join(F.slice("__w", F.lit(1), F.col("__n")), " ")).alias("__h"))
    s = sources.select(source_key, words(F.col(source)).alias("__w"))
    grams = [F.when(F.size("__w") >= n, runs(n)).otherwise(F.array().cast("array<bigint>")) for n in sizes] or [F.array().cast("array<bigint>")]
    s = s.select(source_key, F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")).alias("__s"), F.concat(*grams).alias("__g"))
    starts = s.select(source_key, F.explode(F.array_distinct("__g")).alias("__h")).join(q, "__h").select(source_key, quote_key, "__q")
    return starts.join(s.select(source_key, "__s"), source_key).where(F.contains(F.col("__s"), F.concat(F.lit(" "), F.col("__q"), F.lit(" ")))).select(quote_key, source_key).distinct()
