"""Every registered query against its SQL, and the driver's contract."""

import re
import math

import duckdb
import pytest

import __spark_entry__ as entry
from kinweave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rel = duck.sql(registry.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert ours and ours == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    stages = {r.stufe: r["count"] for r in entry.entry(spark).groupBy("stufe").count().collect()}
    assert stages == {"neu": 140, "sicher": 18, "unsicher": 13, "wahrscheinlich": 29}
    assert len([q for q in registry.QUERIES if re.fullmatch(r"rule_\d{3}", q)]) == 64
