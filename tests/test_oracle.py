"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from evigrain.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    text = df.map(lambda v: "" if v is None or v is pd.NaT or v != v else f"{v:.6g}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    got = got.astype({c: want[c].dtype for c in got.columns if want[c].dtype.kind == "f"})
    want = want.astype({c: "float64" for c in want.columns if got[c].dtype.kind == "f"})
    assert rows(got) == rows(want)


def test_negation_parity_of_odd_texts(spark, tmp_path):
    """Words end at letters that aren't ASCII, whatever the Java version; a null text has no count."""
    said = ["a no\u00f1 b", "ni\u00f1os", ".\nNo\u00f1a not", "NE\u0130THER", "n't\u00e9 can't", "no_ no1 cannot", "", None]
    pd.DataFrame({"conv_id": range(len(said)), "turn": 0, "text": said}).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    want = con.execute(ORACLE["negation_parity"]).fetchall()
    assert sorted(map(tuple, QUERIES["negation_parity"](spark, str(tmp_path)).collect())) == sorted(want)


def test_consensus_on_a_rules_edge(spark):
    """2.4 of 3.0 is 0.8, whatever doubles it is added up from."""
    from evigrain.operators import consensus

    parts = [[0.6] * 4, [0.8] * 3, [0.1, 0.7, 0.2, 0.6, 0.4, 0.4], [0.4, 0.4, 0.6, 0.2, 0.7, 0.1]]
    rows = [(k, i, stance, "DIRECT_EMPIRICAL", w, True) for k, x in enumerate(parts) for i, (stance, w) in enumerate([*(("SUPPORT", w) for w in x), ("REFUTE", 0.4), ("CONDITIONAL", 0.2)])]
    claims = spark.createDataFrame(rows, "topic long, group_id long, stance string, strength string, weight double, verified boolean")
    assert {(r.total_weight, r.support_ratio, r.consensus) for r in consensus.topic_consensus(claims).collect()} == {(3.0, 0.8, "STRONG_CONSENSUS")}
