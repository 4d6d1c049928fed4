"""Evaluation over all rows of the given tables."""

import random

from kinweave.operators import evaluate as E
from kinweave.plans import registry

DATA = "/root/testdata/sf0.001"


def test_members_of_all_references(spark):
    links = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 8), (3, 9), (4, None), (5, None), (None, 8), (6, 10)], "ref long, ident long")
    got = {tuple(r) for r in E.several_members(links).collect()}
    assert got == {("mixed", 7, 1), ("mixed", 7, 2), ("mixed", None, 4), ("mixed", None, 5), ("splintered", 3, 8), ("splintered", 3, 9)}
    refs = {r.member for r in registry.QUERIES["mixed_splintered_members"](spark, DATA).where("kind = 'mixed'").collect()}
    assert any(x % 50 for x in refs)
    plan = E.several_members(links)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan


def test_nearest_of_all_entries(spark):
    rng = random.Random(4)
    families = [(i, i % 2, 1700 + i % 3, 1702 + i % 5) for i in range(40)]
    entries = [(i, rng.randint(0, 1), rng.randint(1698, 1708)) for i in range(400)]
    f = spark.createDataFrame(families, "family_id long, key long, from_year int, to_year int")
    e = spark.createDataFrame(entries, "entry_id long, key long, year int")
    assert max(r["count"] for r in E.first_of_year(e, 4).groupBy("key", "year").count().collect()) == 4
    want = set()
    for fid, key, a, b in families:
        near = sorted((abs(2 * y - a - b), i) for i, k, y in entries if k == key and a <= y <= b)[:4]
        want |= {(fid, i, nr + 1) for nr, (_, i) in enumerate(near)}
    assert {tuple(r) for r in E.nearest_candidates(f, e).collect()} == want
    assert any(r.entry_id % 7 for r in registry.QUERIES["sample_top4_all_entries"](spark, DATA).collect())
