"""Projects in versions: whole or not there, decisions kept over rebuilds."""

import pytest
from pyspark.sql import functions as F
from test_project import MAPPING, cells

from kinweave import project
from kinweave.sources import store, tables

c = F.col


def rows(df):
    return sorted(map(repr, df.collect()))


def test_versions(spark, tmp_path):
    at = str(tmp_path / "s")
    assert store.versions(spark, at) == []
    with pytest.raises(FileNotFoundError):
        store.load(spark, at)
    one = spark.createDataFrame([(1, {2: 3}, [4])], "a int, m map<int,int>, l array<int>")
    assert store.save({"t": one, "empty": one.where("false")}, at) == 1
    assert store.save({"t": store.load(spark, at)["t"].withColumn("a", c("a") + 1)}, at) == 2
    assert [store.load(spark, at, n)["t"].first().a for n in (1, 2)] == [1, 2] and store.load(spark, at)["t"].first().a == 2
    assert store.load(spark, at, 1)["empty"].schema == one.schema and set(store.load(spark, at)) == {"t"}


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    at = str(tmp_path / "s")
    one = spark.range(3)
    store.save({"t": one}, at)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.save({"a": one, "t": one.select((1 / c("id")).alias("x")), "z": one}, at)
    assert store.versions(spark, at) == [1] and store.load(spark, at)["t"].count() == 3
    with pytest.raises(FileNotFoundError):
        store.load(spark, at, 2)
    assert store.save({"t": one.where("id > 0")}, at) == 3 and store.load(spark, at)["t"].count() == 2
    (tmp_path / "s" / "v4").mkdir()  # another writer has begun, and has the next number
    (tmp_path / "s" / "v4" / store.CLAIM).touch()
    assert store.save({"t": one}, at) == 5
    assert store.prune(spark, at, keep=2) == [1, 2] and store.versions(spark, at) == [3, 5] and (tmp_path / "s" / "v4").exists()
    assert store.prune(spark, at, keep=1) == [3, 4] and store.load(spark, at)["t"].count() == 3


def test_a_project_survives_its_rebuild(spark, tmp_path):
    at, sheets = str(tmp_path / "p"), tables.load_mapping(MAPPING)
    p = project.rebuild(at, cells(spark), sheets)
    assert store.versions(spark, at) == [1] and project.load(spark, at)[1] is None
    again, _ = project.load(spark, at)
    assert rows(again.links.select("id", "identity", "stage")) == rows(p.links.select("id", "identity", "stage")) and project.status(again).first().identities == 4
    # The dead man is decided to be nobody else; that holds when a row has been added.
    said = p.mentions.where("path = 'verstorbener'").select(c("stable_key").alias("key"), F.lit("neu").alias("kind"), F.lit(None).cast("string").alias("target"))
    assert project.save(again, at, said) == 2
    more = cells(spark).union(spark.createDataFrame([("f.xlsx", "Taufen", 5, 0, "1755-01-01"), ("f.xlsx", "Taufen", 5, 1, "Kurz"), ("f.xlsx", "Taufen", 5, 2, "Paul")], "file string, sheet string, row int, col int, value string"))
    p = project.rebuild(at, more, sheets)
    assert store.versions(spark, at) == [1, 2, 3]
    # Groom, bride, two children, Paul, the dead man, and the Georg baptised in 1725, whom only the burial's age had made the groom.
    assert project.status(p).first().identities == 7
    dead = p.mentions.where("path = 'verstorbener'").join(p.links, "id").select("identity")
    assert p.links.join(dead, "identity").count() == 1
    assert rows(project.load(spark, at)[1]) == rows(said) and project.load(spark, at, 1)[0].mentions.count() == 11
