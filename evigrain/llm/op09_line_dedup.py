"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Texts are split at line breaks. Equal lines are one class, folded first. Two
lines of ``min_chars`` characters or more are linked if ``max_edits`` insertions,
deletions and substitutions turn one into the other.

* A line is cut into ``max_edits`` + 1 even segments. Of two lines within the
  threshold, one segment of the shorter is untouched in the longer, and lies
  there at one of few places; which ones follows from the two lengths and from
  the edits that can be to its left and right. So a line is indexed by (its
  length, segment number, segment) and probes, for each length down to its own
  less ``max_edits``, with its substrings at those places.
* Keys are counted first. Those of one class, nearly all, go no further, so what
  is shuffled of a line is its keys and not its rows. Of the classes left, lines
  are fetched and letters counted. An edit changes the counts of letters by two
  at most, so a pair whose counts of :data:`COUNTED` letters differ by more than
  twice the threshold isn't joined. A key with many lines is dealt over blocks:
  each line goes to one, its probes to all. The other pairs are decided by the
  bit-parallel recurrence over a band of diagonals, one machine word a
  character, that does no more once the whole band is over the threshold
  (:func:`banded_distance`).

Result: one row per line: ``key``, line_no (from 0), class_doc_id (the least id
of a document with that very line), n_copies, n_links (different lines within
the threshold), and repeated (whether an earlier document, or an earlier place
in this one, has the line).

Defined cases: a null text is one empty line, as an empty one is; short lines
have copies but no links; lines of any length are compared whole; rows with the
same id count as further documents; an empty table gives an empty result; other
input columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, text_or_empty, written

CLASS = ["__h1", "__h2"]
#: Letters that are common in most languages of the Latin script.
COUNTED = "etaoinrshdlu"
#: Lines of a key that meet in one block.
BLOCK = 500


def places(max_edits: int) -> list[tuple[int, int, int]]:
    """(Edits by which an indexed line is shorter, segment, shift) of each key; the first ones, a segment each, are the index keys."""
    index, probes = [], []
    for shorter in range(max_edits + 1):
        for i in range(max_edits + 1):
            low = max(-i, shorter - (max_edits - i))
            high = min(i, shorter + (max_edits - i))
            for shift in range(low, high + 1):
                (index if shorter == 0 and shift == 0 else probes).append((shorter, i, shift))
    return index + probes


def keys_of(line: Column, length: Column, max_edits: int) -> Column:
    """A line's keys, each once, index keys first; these are probes as well."""
    parts = max_edits + 1
    at = F.array(*(F.struct(F.lit(n).alias("shorter"), F.lit(i).alias("i"), F.lit(d).alias("shift")) for n, i, d in places(max_edits)))

    def one(x: Column) -> Column:
        # even segments, the last ones are the longer
        own = length - x["shorter"]
        short = (own / parts).cast("int")
        first_long = F.lit(parts) - own % parts
        start = x["i"] * short + F.greatest(F.lit(0), x["i"] - first_long) + 1
        return F.xxhash64(own, x["i"], F.substring(line, start + x["shift"], short + (x["i"] >= first_long).cast("int")))

    return F.array_distinct(F.transform(at, one))


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings, or ``most`` + 1 if it is larger.

    One word holds the vertical differences of 2 * most + 1 cells around the
    diagonal; a character of ``b`` moves the band down by one. The value at the
    band's lower edge is followed down to the last row, then along that row.
    Neighbouring cells differ by one at most, so once that value is over
    3 * most every cell is over ``most``, and the other characters are skipped.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.char_length(a), F.char_length(b)

    def flip(v: Column) -> Column:
        return v.bitwiseXOR(F.lit(full))

    def step(state: Column, i: Column, x: Column, y: Column, edge: Column) -> Column:
        vp, vn, dist = state["vp"], state["vn"], state["dist"]
        c = F.get(y, i)
        match = F.lit(0).cast("long")
        for k in range(width):
            at = i - most + k
            match = match + F.when((at >= 0) & (F.get(x, at) == c), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

        def rest(e: Column) -> Column:
            d0 = ((e.bitwiseAND(vp) + vp).bitwiseAND(full).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn)

            def after(d: Column) -> Column:
                hp, hn = vn.bitwiseOR(flip(d.bitwiseOR(vp))), d.bitwiseAND(vp)
                down = F.shiftright(d, 1)
                bit = F.lit(width - 2) - (i - edge)
                at_row = F.when(_bit(hp, bit), 1).otherwise(0) - F.when(_bit(hn, bit), 1).otherwise(0)
                moved = F.when(i < edge, F.when(d.bitwiseAND(F.lit(top)) != 0, 0).otherwise(1)).otherwise(at_row)
                return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (dist + moved).cast("int").alias("dist"))

            return _let(d0, after)

        return _let(match, rest)

    start = F.struct(F.lit(full ^ ((1 << most) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(most).alias("dist"))
    walk = _let(
        F.struct(x.alias("x"), y.alias("y"), (n - most).alias("edge")),
        lambda s: F.aggregate(F.sequence(F.lit(0), F.size(s["y"]) - 1), start, lambda acc, i: F.when((acc["dist"] > 3 * most) & (i < s["edge"]), acc).otherwise(step(acc, i, s["x"], s["y"], s["edge"])), lambda acc: F.least(acc["dist"], F.lit(most + 1))),
    )
    return F.when(F.abs(n - m) > most, F.lit(most + 1)).when(a == b, F.lit(0)).when(F.least(n, m) <= most, F.least(F.levenshtein(a, b), F.lit(most + 1))).otherwise(walk)


def counted(line: Column) -> list[Column]:
    """How often each of :data:`COUNTED` occurs, modulo 128, packed in two integers."""
    half = len(COUNTED) // 2
    counts = [F.pmod(F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit(""))), F.lit(128)).cast("long") for c in COUNTED]
    return [sum((n * (1 << 7 * i) for i, n in enumerate(part)), F.lit(0).cast("long")) for part in (counts[:half], counts[half:])]


def apart(a: Column, b: Column) -> Column:
    """A lower bound of how far two packed integers' counts are apart in all."""
    total = F.lit(0)
    for i in range(len(COUNTED) // 2):
        d = F.pmod(F.shiftright(a, 7 * i).bitwiseAND(F.lit(127)) - F.shiftright(b, 7 * i).bitwiseAND(F.lit(127)), F.lit(128))
        total = total + F.least(d, 128 - d)
    return total


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftright", word, F.greatest(at, F.lit(0)).cast("int")).bitwiseAND(F.lit(1)) != 0


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """__id, line_no, __line and the digests that stand for a line."""
    cut = docs.select(F.col(key).alias("__id"), F.posexplode(F.split(text_or_empty(F.col(text)), "\n", -1)).alias("line_no", "__line"))
    return cut.select("__id", "line_no", "__line", F.xxhash64("__line").alias("__h1"), F.hash("__line").alias("__h2"))


def line_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", max_edits: int = 2, min_chars: int = 20) -> DataFrame:
    """One row per line; see the module's text."""
    if min_chars <= 2 * max_edits:
        raise ValueError("min_chars must be over twice max_edits")
    lines = _lines(docs, text, key)
    length = F.col("__length")
    wide = lines.withColumn("__length", F.char_length("__line")).select("__id", "line_no", *CLASS, F.when(length >= min_chars, keys_of(F.col("__line"), length, max_edits)).alias("__keys"))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "line_no")).alias("__first")
    classes = wide.groupBy(*CLASS).agg(first, F.count("*").alias("n_copies"), F.first("__keys").alias("__keys"))
    classes = written(classes.select(*CLASS, F.col("__first.__id").alias("class_doc_id"), F.col("__first.line_no").alias("__first_line"), "n_copies", "__keys"), "classes")
    keyed = classes.where("__keys is not null").select(*CLASS, "class_doc_id", F.posexplode("__keys").alias("__i", "__key"))
    # few keys are shared; only their rows go on, with their classes' ids and letter counts
    indexed = F.col("__i") <= max_edits
    shared = written(keyed.select("__key", indexed.alias("__indexed")).groupBy("__key").agg(F.count("*").alias("__n"), F.max("__indexed").alias("__indexed")).where("__n > 1 and __indexed").select("__key", "__n"), "keys")
    live = written(salted_join(keyed, shared, ["__key"], "__n", F.col("__h1"), shuffled=True).select("__key", indexed.alias("__indexed"), *CLASS, "class_doc_id", F.col("__n").alias("__lines")), "live")
    ends = written(live.groupBy(*CLASS).agg(F.first("class_doc_id").alias("__doc"), F.count("*").alias("__n")), "ends")
    ids = written(ends.select("__doc").distinct(), "ids")
    holders = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(ids, F.col("__id").eqNullSafe(F.col("__doc")), "left_semi")
    held = _lines(holders, "__text", "__id").withColumnsRenamed({"__h1": "__l1", "__h2": "__l2"})
    held = held.join(ends, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__l1") == F.col("__h1")) & (F.col("__l2") == F.col("__h2")))
    texts = held.groupBy(*CLASS).agg(F.min("__line").alias("__line"), F.first("__n").alias("__n"))
    letters = counted(F.col("__line"))
    texts = written(texts.withColumns({"__c": letters[0], "__d": letters[1]}), "lines")
    marked = written(salted_join(live.drop("class_doc_id"), texts.drop("__line"), CLASS, "__n", F.col("__key")), "marked")
    sides = {s: marked.select("__key", "__indexed", "__lines", *(F.col(c).alias(f"{s}{n}") for c, n in (("__h1", "1"), ("__h2", "2"), ("__c", "_c"), ("__d", "_d")))) for s in "ab"}
    # a key's index rows are dealt over blocks, its probes go to each
    blocks = F.ceil(F.col("__lines") / BLOCK).cast("int")
    left = sides["a"].where("__indexed").withColumn("__block", F.pmod(F.xxhash64("a1"), blocks).cast("int")).drop("__indexed", "__lines")
    right = sides["b"].withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumnRenamed("__indexed", "b_indexed").drop("__lines")
    differ = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    swap = (F.col("a1") > F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") > F.col("b2")))
    # two index rows of a key meet in both orders, of which one will do
    once = ~F.col("b_indexed") | ~swap
    met = left.join(right, ["__key", "__block"]).where(differ & once & (apart(F.col("a_c"), F.col("b_c")) + apart(F.col("a_d"), F.col("b_d")) <= 2 * max_edits))
    ordered = [F.when(swap, F.col(f"{o}{n}")).otherwise(F.col(f"{s}{n}")).alias(f"{s}{n}") for s, o in ("ab", "ba") for n in "12"]
    judged = pairs = written(met.select(*ordered).dropDuplicates(), "pairs")
    for s in "ab":
        count = pairs.groupBy(f"{s}1", f"{s}2").agg(F.count("*").alias("__n"))
        own = texts.select(F.col("__h1").alias(f"{s}1"), F.col("__h2").alias(f"{s}2"), F.col("__line").alias(f"{s}_line")).join(count, [f"{s}1", f"{s}2"])
        judged = salted_join(judged, own, [f"{s}1", f"{s}2"], "__n", F.struct("a1", "b1")).drop("__n")
    near = written(judged.where(banded_distance(F.col("a_line"), F.col("b_line"), max_edits) <= max_edits).select("a1", "a2", "b1", "b2"), "near")
    links = near.select(F.explode(F.array(*(F.struct(F.col(f"{s}1").alias("__h1"), F.col(f"{s}2").alias("__h2")) for s in "ab"))).alias("e")).select("e.*").groupBy(*CLASS).agg(F.count("*").alias("n_links"))
    links = written(links, "links")
    special = written(classes.drop("__keys").join(links, CLASS, "left").where("n_copies > 1 or n_links is not null"), "special")
    out = salted_join(lines.select("__id", "line_no", *CLASS), special, CLASS, "n_copies", F.struct("__id", "line_no"), how="left")
    alone = F.col("n_copies").isNull()
    at_first = F.col("__id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("__first_line"))
    return out.select(
        F.col("__id").alias(key),
        "line_no",
        F.when(alone, F.col("__id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (~alone & ~at_first).alias("repeated"),
    )
