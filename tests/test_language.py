import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evigrain.functions import gates, polarity, quantity, quotes


def column(spark, values, build):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} string" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    args = [F.col(c) for c in rows.columns[1:]]
    return [r[0] for r in rows.orderBy("i").select(build(*args).alias("x")).collect()]


def test_negations(spark):
    said = [
        ("The drug did not work", 1),
        ("It cannot be excluded", 2),
        ("not unknown", 2),
        ("不同样地间显著增加", 0),
        ("并非没有效果", 3),
        ("", 0),
        (None, 0),
    ]
    got = column(spark, [s for s, _ in said], polarity.net_negations)
    assert [n % 2 for n in got] == [n % 2 for _, n in said]


def test_clauses(spark):
    got = column(spark, ["A rises, B falls but C stays; end.", "甲增加，但是乙减少", None], polarity.clauses)
    assert got == [["A rises", "B falls", "but C stays", "end."], ["甲增加", "但是乙减少"], []]


def test_polarity(spark):
    cases = [
        ("X increases growth", "X decreased growth in all plots", "CONTRADICTORY"),
        ("X increases growth", "X enhanced growth", None),
        ("X increases growth", "X did not increase growth", "CONTRADICTORY"),
        ("X increases growth", "Y abolished the increase", "CONTRADICTORY"),
        ("X increases growth", "X increased, and Y reduced it", "UNRESOLVED"),
        ("X increases growth", "X was the highest", "UNRESOLVED"),
        ("X affects growth", "X does not affect growth", "CONTRADICTORY"),
        ("X affects growth", "X affects growth, but Y has no role", "UNRESOLVED"),
        ("X affects growth", "The effect was reversed", "UNRESOLVED"),
        ("", "X", None),
        ("X", None, None),
    ]
    assert column(spark, [c[:2] for c in cases], polarity.check) == [c[2] for c in cases]


QUANTITIES = {
    "took 25 mg/L": [("25", "mg/L", "mass_volume", "0.025")],
    "83 −85% of": [("83", None, None, "83"), ("85", "%", "percent", "0.85")],
    "was -5 Gy": [("-5", "Gy", "unknown", "-5")],
    "1,234.56 g and 1.234,56 kg": [("1234.56", "g", "mass", "1234.56"), ("1234.56", "kg", "mass", "1234560")],
    "1,000 samples; 2,5 mL": [("1000", "samples", "count_sample", "1000"), ("2.5", "mL", "volume", "0.0025")],
    "1.5e3 nL": [("1500", "nL", "volume", "0.0000015")],
    "2 m/s over 5 dogs": [("2", "m/s", "unknown", "2"), ("5", None, None, "5")],
    "90 Minutes": [("90", "minutes", "time", "5400")],
    "": [],
    None: [],
}


def test_quantities(spark):
    got = column(spark, list(QUANTITIES), quantity.quantities)
    assert [[(q["value"], q["unit"], q["dimension"], q["base"]) for q in row] for row in got] == [[(Decimal(v), u, d, Decimal(b)) for v, u, d, b in row] for row in QUANTITIES.values()]


def test_doubtful_and_comparators(spark):
    (row, other) = column(spark, ["at-20.5 and p < 0.05", "±0.3"], quantity.quantities)
    assert [(q["value"], q["comparator"], q["doubtful"]) for q in row] == [(Decimal("-20.5"), None, True), (Decimal("0.05"), "<", False)]
    assert other[0]["comparator"] == "approx"


@pytest.mark.parametrize(
    ("value", "source", "declared", "verdict"),
    [
        ("25 mg/L", "we used 0.025 g/L here", {}, "ALIGNED"),
        ("999 mg/L", "we used 25 mg/L", {}, "VALUE_MISMATCH"),
        ("5 Sv", "at 5 Gy", {}, "UNIT_MISMATCH"),
        ("20", "20 samples were", {}, "ALIGNED"),
        ("5%", "a share of 0.05", {}, "VALUE_MISMATCH"),
        ("5%", "a share of 0.05", {"ratio": True}, "ALIGNED"),
        ("0.3", "±0.3", {}, "COMPARATOR_MISMATCH"),
        ("p < 0.05", "p > 0.05", {}, "COMPARATOR_MISMATCH"),
        ("1 nL", "2 nL", {}, "VALUE_MISMATCH"),
        ("none", "20", {}, "NO_QUANTITY"),
    ],
)
def test_value_found(spark, value, source, declared, verdict):
    assert column(spark, [(value, source)], lambda a, b: quantity.value_found(a, b, **declared)) == [verdict]


def test_states(spark):
    got = column(spark, [("N/R", "x"), ("fine", "un-checked"), ("...", "x"), (None, "x"), ("fine", None)], lambda a, b: gates.non_evidence_class(a, b, nullable=[1]))
    assert got == ["NOT_REPORTED", "UNCHECKED", "UNPARSEABLE", "UNPARSEABLE", None]


def test_propositions(spark):
    pairs = [("A increases B", "a increases b."), ("A increases B", "B increases A"), ("A increases B", "A stimulates B"), ("A increases B", "A decreases B"), ("A in the soil", "A"), ("", "A"), (None, "A")]
    assert column(spark, pairs, gates.same_proposition) == ["SAME", "UNRESOLVED", "SAME", "DIFFERENT", "SAME", "UNRESOLVED", "UNRESOLVED"]


def test_quote_support(spark):
    pairs = [("so the cat sat down", "The cat sat"), ("cat", "the cat sat on the mat"), ("the black cat sat there", "a dog"), ("", "x")]
    assert [(r["supported"], r["how"]) for r in column(spark, pairs, gates.quote_support)] == [(True, "EXACT"), (False, "FRAGMENT"), (False, "KEYWORD_ONLY"), (False, "EMPTY")]


def test_narrative(spark):
    text = "# Heading 5%\n\nWe found that it works.\n\nIt was reported (CLM-001, clm-001, CLM-ab)."
    assert column(spark, [text, None], gates.claim_references) == [["CLM-001", "CLM-AB"], []]
    assert column(spark, [text, None], gates.unsupported_paragraphs) == [["We found that it works."], []]


def test_outbound_query(spark):
    assert column(spark, [r"find  C:\me\x.txt Secret thing file:///a/b "], lambda q: gates.outbound_query(q, ["secret"])) == ["find thing"]


def test_locate(spark):
    pairs = [("The  Cat—sat", "so the cat-sat."), ("effi- cient", "an efficient way"), ("双因 素", "采用双因素法"), ("alpha beta gamma", "nothing here"), ("", "x"), (None, "x"), ("x", None)]
    assert [r["how"] for r in column(spark, pairs, quotes.locate)] == ["EXACT", "HYPHEN_JOIN", "WHITESPACE_RELAXED", "NOT_FOUND", "EMPTY", "EMPTY", "NOT_FOUND"]


def test_best_window(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices("abcdefg", k=rng.randint(0, 6))), " ".join(rng.choices("abcdefghij", k=rng.choice([0, 3, 40, 500])))) for _ in range(60)]
    got = column(spark, pairs, lambda a, b: quotes.best_window(quotes.tokens(a), quotes.tokens(b)))
    for (needle, hay), found in zip(pairs, got, strict=True):
        need, words = set(needle.split()), hay.split()
        shares = [len(need & set(words[i : i + len(need)])) for i in range(min(400, max(1, len(words) - len(need) + 1)))] if need and words else [0]
        want = max(shares)
        assert found["ratio"] == pytest.approx(want / len(need) if need else 0)
        assert found["start"] == (shares.index(want) if want else None)
