"""Numbers with units, as column expressions: found by pattern, converted by an exact decimal factor."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound
from .evidence import lookup

#: Dimension, factor to its base unit, and the unit's spellings (case counts: mL isn't ML).
UNITS = [
    ("volume", "1", "l L liter liters litre litres 升"),
    ("volume", "0.001", "ml mL milliliter milliliters millilitre millilitres 毫升"),
    ("volume", "0.000001", "µl µL μl μL uL ul microliter microliters microlitre microlitres 微升"),
    ("volume", "0.000000001", "nl nL nanoliter nanoliters 纳升"),
    ("volume", "0.000000000001", "pl pL picoliter picoliters 皮升"),
    ("length", "1", "m meter meters metre metres 米"),
    ("length", "0.01", "cm centimeter centimeters 厘米"),
    ("length", "0.001", "mm millimeter millimeters millimetre millimetres 毫米"),
    ("length", "0.000001", "µm μm um micrometer micrometers 微米"),
    ("length", "0.000000001", "nm nanometer nanometers 纳米"),
    ("length", "1000", "km kilometer kilometers 千米 公里"),
    ("mass", "1", "g gram grams 克"),
    ("mass", "0.001", "mg milligram milligrams 毫克"),
    ("mass", "0.000001", "µg μg ug microgram micrograms 微克"),
    ("mass", "0.000000001", "ng nanogram nanograms 纳克"),
    ("mass", "1000", "kg kilogram kilograms 千克 公斤"),
    ("percent", "0.01", "% percent percents 百分比 百分数"),
    ("permille", "0.001", "‰"),
    ("temperature", "1", "°c °C ℃ celsius 摄氏度"),
    ("time", "1", "s sec second seconds 秒"),
    ("time", "60", "min minute minutes 分钟"),
    ("time", "3600", "h hr hour hours 小时"),
    ("count_sample", "1", "sample samples 样本 份"),
    ("count_individual", "1", "individual individuals 只 头 尾"),
    ("count_species", "1", "species 种"),
    ("count_site", "1", "site sites plot plots 样地 样方"),
    ("count_read", "1", "read reads"),
    ("count_base", "1", "bp"),
    ("count_base", "1000", "kb"),
    ("mass_volume", "1", "g/l g/L"),
    ("mass_volume", "0.001", "mg/l mg/L"),
    ("mass_volume", "0.000001", "µg/l µg/L μg/l μg/L ug/l ug/L"),
    ("mass_volume", "0.000000001", "ng/l ng/L"),
    ("mass_volume", "1000", "kg/l kg/L"),
    ("count_per_volume", "1", "ind/l ind/L individuals/l individuals/L cells/l cells/L"),
    ("count_per_volume", "1000", "ind/ml ind/mL cell/ml cell/mL cells/ml cells/mL"),
    ("concentration", "1", "ppm ppmv"),
    ("concentration", "0.001", "ppb ppbv"),
]
#: Signs before a number that belong to it.
COMPARATORS = {"<=": "<=", "≤": "<=", ">=": ">=", "≥": ">=", "<": "<", ">": ">", "=": "=", "±": "approx", "+/-": "approx", "~": "approx", "≈": "approx"}

DIMENSION = {u: d for d, _, units in UNITS for u in units.split()}
FACTOR = {u: f for _, f, units in UNITS for u in units.split()}
#: Units that are words may be written in any case.
WORDS = {u.lower(): u for u in DIMENSION if u.isalpha() and len(u) >= 4}

_BLANK = r"[ \t ]"
_LONGEST = sorted(DIMENSION, key=len, reverse=True)
_LETTERED = "|".join(f"(?i:{re.escape(u)})" if u in WORDS else re.escape(u) for u in _LONGEST if u[-1].isalpha())
_SPELLED = rf"(?:{_LETTERED})(?!\p{{L}})|[%‰]"
_NUMBER = r"(?<![\d.,])(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?!\d)"
_POWER = r"(?:[eE][+-]?\d+)?(?!\d)"
_DASH = "[-−–—]"
# a dash after a digit is a range; after a blank or an opening mark it's a sign; after a letter nobody knows
_SIGN = rf"(?:[A-Za-z一-龥]{_DASH}|(?<!\d{_BLANK}{{0,9}})(?<=^|[\s(=\[,;:（【「『±<>≤≥~≈]){_DASH})?"
_COMPOUND = r"[/·*^×⋅\d]"
PATTERN = (
    rf"((?:{'|'.join(re.escape(c) for c in COMPARATORS)})?){_BLANK}*({_SIGN})({_NUMBER})({_POWER})"
    rf"((?:{_BLANK}*(?:(?:{_SPELLED})|[A-Za-zµμ°一-龥]+)(?:{_COMPOUND}\S*)?)?)"
)


def _parsed(number: Column) -> Column:
    """A decimal of either custom: the last separator is the decimal one, unless it groups thousands."""
    last_comma = number.rlike(r",\d*$") & number.contains(".")
    grouped = number.rlike(r"^\d{1,3}(,\d{3})+$") | number.rlike(r"^\d{1,3}(\.\d{3}){2,}$")
    plain = (
        F.when(last_comma, F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(grouped, F.regexp_replace(number, "[.,]", ""))
        .when(number.contains(",") & number.contains("."), F.replace(number, F.lit(","), F.lit("")))
        .otherwise(F.replace(number, F.lit(","), F.lit(".")))
    )
    return plain.try_cast("decimal(22,10)")


def quantities(text: Column, *, strict: bool = False) -> Column:
    """Array of (raw, value, comparator, unit, dimension, base, doubtful) in text order.

    ``dimension`` is null without a unit and ``unknown`` for a unit that the
    table doesn't have or a compound one; ``base`` is the value in the
    dimension's base unit. Without a table unit, a word is a unit only if it
    touches the number or looks like a symbol (two characters with a capital
    among them, or capitals); any word is one where ``strict``. ``doubtful`` is
    a minus that touches a letter. Values have ten decimal places at most, 12
    digits before the point.
    """
    text = F.coalesce(text, F.lit(""))

    def split(m: Column) -> Column:
        names = ("comparator", "sign", "number", "power", "unit")
        return F.struct(*(F.regexp_extract(m, PATTERN, i).alias(n) for i, n in enumerate(names, 1)))

    def named(p: Column) -> Column:
        word = F.regexp_replace(p["unit"], f"^{_BLANK}+", "")
        return bound(word, lambda w: F.struct(w.alias("word"), F.coalesce(F.when(w.isin(*DIMENSION), w), lookup(WORDS, F.lower(w))).alias("spelled")))

    def valued(p: Column, n: Column) -> Column:
        w, spelled = n["word"], n["spelled"]
        symbol = F.lit(strict) | (p["unit"] == w) | w.rlike(_COMPOUND) | (w.rlike(r"^\S{1,2}$") & w.rlike(r"[^a-z]")) | w.rlike(r"^[^a-z]{3,}$")
        power = F.when(p["power"] != "", F.pow(F.lit(10.0), F.regexp_replace(p["power"], "^[eE]", "").cast("int")).cast("decimal(22,10)")).otherwise(F.lit(1).cast("decimal(22,10)"))
        value = F.when(p["sign"] != "", -_parsed(p["number"])).otherwise(_parsed(p["number"])) * power
        return F.struct(value.cast("decimal(22,10)").alias("value"), F.coalesce(spelled, F.when((w != "") & symbol, w)).alias("unit"), lookup(DIMENSION, spelled).alias("dimension"), lookup(FACTOR, spelled).cast("decimal(16,12)").alias("factor"))

    def told(p: Column, v: Column) -> Column:
        return F.struct(
            F.concat(p["sign"], p["number"], p["power"], F.when(v["unit"].isNotNull(), p["unit"]).otherwise("")).alias("raw"),
            v["value"].alias("value"),
            F.when(p["comparator"] != "", lookup(COMPARATORS, p["comparator"])).alias("comparator"),
            v["unit"].alias("unit"),
            F.coalesce(v["dimension"], F.when(v["unit"].isNotNull(), "unknown")).alias("dimension"),
            F.coalesce((v["value"] * v["factor"]).cast("decimal(38,21)"), v["value"].cast("decimal(38,21)")).alias("base"),
            (F.char_length(p["sign"]) > 1).alias("doubtful"),
        )

    def one(m: Column) -> Column:
        return bound(split(m), lambda p: bound(named(p), lambda n: bound(valued(p, n), lambda v: told(p, v))))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: one(m)), lambda q: q["value"].isNotNull())


def same_quantity(a: Column, b: Column, *, ratio: bool = False, dimensionless: bool = False) -> Column:
    """Whether two quantities (of :func:`quantities`) agree exactly.

    Comparators count where both have one, and a mark of uncertainty always;
    an unknown unit must be the same; a bare ``a`` may meet a counted ``b``;
    ``ratio`` lets shares with and without a sign meet, ``dimensionless`` a
    bare ``a`` and any unit.
    """
    approx = lambda q: F.coalesce(q["comparator"] == "approx", F.lit(False))
    compared = F.coalesce(a["comparator"] == b["comparator"], F.lit(True)) & (approx(a) == approx(b))
    share = lambda q: F.coalesce(q["dimension"].isin("percent", "permille"), F.lit(False))
    same = a["dimension"].eqNullSafe(b["dimension"]) & (F.coalesce(a["dimension"] != "unknown", F.lit(True)) | a["unit"].eqNullSafe(b["unit"]))
    bare = a["dimension"].isNull() & (F.coalesce(b["dimension"].startswith("count_") & ~b["dimension"].startswith("count_per"), F.lit(False)) | (F.lit(dimensionless) & b["dimension"].isNotNull()))
    shares = F.lit(ratio) & (share(a) | share(b)) & (share(a) | a["dimension"].isNull()) & (share(b) | b["dimension"].isNull())
    return ~a["doubtful"] & ~b["doubtful"] & compared & F.when(same | shares, a["base"] == b["base"]).when(bare, a["value"] == b["value"]).otherwise(F.lit(False))


def value_found(value: Column, source: Column, **declared: bool) -> Column:
    """ALIGNED if every quantity of ``value`` is in ``source``.

    Else COMPARATOR_MISMATCH (they are there with another comparator or mark),
    UNIT_MISMATCH (their numbers are), VALUE_MISMATCH, or NO_QUANTITY.
    """
    pair = F.struct(quantities(value, strict=True).alias("wanted"), quantities(source).alias("there"))
    every = lambda p, meets: F.forall(p["wanted"], lambda a: F.exists(p["there"], lambda b: meets(a, b)))

    def amount(a: Column, b: Column) -> Column:
        known = F.coalesce(a["dimension"] != "unknown", F.lit(True)) | (a["unit"] == b["unit"])
        return (a["base"] == b["base"]) & a["dimension"].eqNullSafe(b["dimension"]) & known

    return bound(
        pair,
        lambda p: F.when(F.size(p["wanted"]) == 0, "NO_QUANTITY")
        .when(every(p, lambda a, b: same_quantity(a, b, **declared)), "ALIGNED")
        .when(every(p, amount), "COMPARATOR_MISMATCH")
        .when(every(p, lambda a, b: a["value"] == b["value"]), "UNIT_MISMATCH")
        .otherwise("VALUE_MISMATCH"),
    )
