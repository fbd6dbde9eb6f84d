"""Registered queries of the subpackage against their oracle SQL."""

import os

import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["op3_warc_fixity", "op6_exact_dedup", "op9_url_filter", "op11_jaccard", "op12_spelling", "op13_divergence"])
def test_oracle(spark, name, d="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    df = __spark_entry__.queries()[name](spark, d)
    got = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    rows = df.collect()
    assert sorted(str([r[c] for c in names]) for r in rows) == sorted(str(list(r)) for r in got.fetchall()) and rows


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in __spark_entry__.queries()
