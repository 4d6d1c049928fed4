"""A reconstitution against a reference tree."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_project import MAPPING, cells

from kinweave import project
from kinweave.operators import comparison as C
from kinweave.sources import gedcom, tables

c = F.col

TREE = """0 HEAD
0 @I1@ INDI
1 NAME Georg /Haag/
1 BIRT
2 DATE 1 JAN 1725
1 BURI
2 DATE 5 APR 1790
2 SOUR @S1@
3 PAGE Begr 1790/03
0 @I2@ INDI
1 NAME Maria /Eberle/
0 @I3@ INDI
1 NAME Anna /Haag/
1 CHR
2 DATE 1 MAR 1750
2 SOUR @S1@
3 PAGE Taufe 1750/1
1 FAMC @F1@
0 @I4@ INDI
1 NAME Jacob /Hag/
1 BIRT
2 DATE 2 MAY 1752
1 FAMC @F1@
0 @I5@ INDI
1 NAME Jacob /Schmid/
1 DEAT
2 DATE ABT 1800
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
1 CHIL @I4@
"""


def lines(spark, text):
    return gedcom.parse_records(spark.createDataFrame([("0 " + r if i else r,) for i, r in enumerate(text.split("\n0 "))], "text string"))


@pytest.fixture(scope="module")
def linked(spark):
    return project.link(project.build(cells(spark), tables.load_mapping(MAPPING)))


def test_reference_keys(spark):
    persons, keys, parents = C.reference(lines(spark, TREE))
    assert {r.ref: (r.given, r.surname, r.birth, r.death) for r in persons.collect()}["@I1@"] == ("Georg", "Haag", 1725, 1790)
    assert {(r.key, r.ref, r.kind) for r in keys.collect()} == {("Beg 1790/3", "@I1@", "Beg"), ("Tau 1750/1", "@I3@", "Tau")}
    assert {tuple(r) for r in parents.collect()} == {("@I3@", "@I1@", "@I2@"), ("@I4@", "@I1@", "@I2@")}
    content = {(r.ref, r.kind) for r in C.reference(lines(spark, TREE), "content")[1].collect()}
    assert content == {("@I1@", "Tau"), ("@I1@", "Beg"), ("@I3@", "Tau"), ("@I4@", "Tau"), ("@I5@", "Beg")}
    namesake = TREE.replace("Georg /Haag/", "Anna /Hag/").replace("1 JAN 1725", "1750")
    assert ("@I3@", "Tau") not in {(r.ref, r.kind) for r in C.reference(lines(spark, namesake), "content")[1].collect()}


def test_a_project_against_a_tree(spark, linked):
    p = linked
    out = project.compare(p, lines(spark, TREE), "content")
    r = out.report.first()
    assert (r.entries, r.should, r.found, r.hits, r.precision, r.recall) == (4, 1, 1, 1, 1.0, 1.0)
    assert out.deviations.isEmpty() and {x["class"]: x.n for x in out.parents.collect()} == {"gleich": 2, "ohne Eltern": 1}
    assert [(x.n, x.n_right) for x in out.stages.collect()] == [(1, 1)]
    # The reference has another dead man: what is one person here are two there.
    other = TREE.replace("1 BURI\n2 DATE 5 APR 1790\n2 SOUR @S1@\n3 PAGE Begr 1790/03\n", "") + "0 @I6@ INDI\n1 NAME Georg /Haag/\n1 BURI\n2 DATE 1790\n"
    out = project.compare(p, lines(spark, other), "content")
    (d,) = out.deviations.collect()
    assert (d.ART, d.BEGRAEBNIS, d.TAUFE, d.PAARE) == (C.EXTRA, "Beg 1790 04 georg", "Tau 1725 04 georg", 1)
    assert d.NENNUNG == "Haag, Georg" and d["REFERENZ BEGRAEBNIS"] == "Haag, Georg *? †1790" and d["REFERENZ TAUFE"] == "Haag, Georg *1725 †?" and d.STUFE and d.BEGRUENDUNG
    assert tuple(out.deviations.columns) == C.DEVIATIONS
    # By citation only the burial has a page that both know.
    assert project.compare(p, lines(spark, TREE)).report.first().entries == 1
    assert project.compare(p, lines(spark, TREE), "content", since=1752).report.first().entries == 2
    wife = TREE.replace("1 WIFE @I2@", "1 WIFE @I5@")
    assert {x["class"]: x.n for x in project.compare(p, lines(spark, wife), "content").parents.collect()} == {"andere Mutter": 2, "ohne Eltern": 1}
    alone = TREE.replace("1 FAMC @F1@\n", "")
    assert {x["class"]: x.n for x in project.compare(p, lines(spark, alone), "content").parents.collect()} == {"nur eigene Eltern": 2, "ohne Eltern": 1}


def test_an_own_tree_is_no_deviation(spark, linked, tmp_path):
    p = linked
    project.write_gedcom(p, str(tmp_path / "out"))
    (tmp_path / "t.ged").write_text("\n".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*"))))
    out = project.compare(p, gedcom.read_lines(spark, str(tmp_path / "t.ged")))
    assert out.report.first().entries == 4 and out.report.first().precision == 1.0 and out.deviations.isEmpty()
    assert {x["class"]: x.n for x in out.parents.collect()} == {"gleich": 2, "ohne Eltern": 1}


def test_pairs_that_differ_are_all_counted(spark):
    """Deviations are a row for each entry that stands apart; their pairs are those that brute force finds."""
    rng = random.Random(4)
    rows = [(f"{rng.choice(['Tau', 'Beg'])} {i}", rng.randrange(12), f"@{rng.randrange(9)}@") for i in range(150)]
    both = spark.createDataFrame([(k, k[:3], i, r, "sicher", "x", k) for k, i, r in rows], "key string, kind string, ident long, ref string, stage string, reason string, text string")
    none = spark.createDataFrame([], "ident long, ref string, who string")
    out = C.deviations(both, none, none).collect()
    pairs = list(itertools.combinations(rows, 2))
    for kind, apart in ((C.EXTRA, [1 for a, b in pairs if a[1] == b[1] and a[2] != b[2]]), (C.MISSED, [1 for a, b in pairs if a[1] != b[1] and a[2] == b[2]])):
        of = [d for d in out if d.ART == kind]
        assert sum(d.PAARE for d in of) == len(apart) and len(of) <= len(rows)
    own = {k: (i, r) for k, i, r in rows}
    for d in out:
        (i, r), (j, s) = own[d.BEGRAEBNIS], own[d.TAUFE]
        assert (i == j and r != s) if d.ART == C.EXTRA else (i != j and r == s)
    r = C.report(both).first()
    assert (r.extra, r.missed) == tuple(sum(d.PAARE for d in out if d.ART == kind) for kind in (C.EXTRA, C.MISSED))
    empty = both.where("false")
    assert C.deviations(empty, none, none).isEmpty() and C.report(empty).first().precision == 1.0
