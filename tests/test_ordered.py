"""Slices of a key give what its whole window gives."""

import random

import pytest
from pyspark.sql import functions as F

from evigrain.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        data.append((key, i, rng.choice(["x", "y", None]), rng.randrange(9), float(rng.randrange(300))))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, at long, v string, n int, x double").cache()


OPERATORS = {
    "quota": lambda d, s: ordered.quota(d, ["k"], ["at"], "n", 60, slice_rows=s),
    "streaks": lambda d, s: ordered.streaks(d, ["k"], ["at"], "v", 2, slice_rows=s),
    "neighbours": lambda d, s: ordered.neighbours(d, ["k"], ["at"], "v", slice_rows=s),
    "last_before": lambda d, s: ordered.last_before(d, ["k"], ["at"], F.col("n") > 6, "v", "last", slice_rows=s),
    "tolerance_clusters": lambda d, s: ordered.tolerance_clusters(d, ["k"], "x", 4.0, slice_rows=s),
}


def told(df):
    return df.columns, sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("slice_rows", [3, 40])
def test_slices_change_nothing(rows, name, slice_rows):
    assert told(OPERATORS[name](rows, slice_rows)) == told(OPERATORS[name](rows, 10**9))


def test_whole_windows_by_hand(rows):
    by_key = {}
    for r in sorted(rows.collect(), key=lambda r: r.at):
        by_key.setdefault(r.k, []).append(r)
    granted = {}
    for requests in by_key.values():
        used = 0
        for r in requests:
            granted[r.at] = min(r.n, max(0, 60 - used))
            used += r.n
    assert {r.at: r.granted for r in OPERATORS["quota"](rows, 7).collect()} == granted


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(rows, name):
    assert OPERATORS[name](rows.where("at < 0"), 3).count() == 0


def test_slices_are_even(rows):
    sizes = [r["count"] for r in ordered.sliced(rows, "at", 5).groupBy("__slice").count().collect()]
    assert len(sizes) > 60 and max(sizes) <= 15


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "decimal(12,2)", "string"])
def test_kinds_of_order(rows, kind):
    place = F.timestamp_seconds(F.col("at") * 86_400).cast(kind) if kind.startswith(("time", "date")) else F.col("at").cast(kind)
    d = rows.withColumn("at", place)
    assert told(ordered.quota(d, ["k"], ["at"], "n", 60, slice_rows=9)) == told(ordered.quota(d, ["k"], ["at"], "n", 60, slice_rows=10**9))
    assert (ordered.sliced(d, "at", 9).agg(F.max("__slice")).first()[0] > 0) == (kind != "string")
