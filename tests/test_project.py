"""A project end to end: cells of sheets, mentions, links, GEDCOM, verification."""

from pyspark.sql import functions as F

from kinweave import project
from kinweave.operators.rules import CATALOGUE, Model
from kinweave.sources import gedcom, tables

c = F.col

MAPPING = """
[taufe]
blatt = "Taufen"
A = "geburt_datum"
B = "kind_name"
C = "kind_vorname"
D = "vater"
E = "mutter"

[ehe]
blatt = "Ehen"
A = "trauung_datum"
B = "braeutigam"
C = "braut"

[tod]
blatt = "Tote"
A = "sterbe_datum"
B = "verstorbener"
C = "verstorbener_alter"
D = "verstorbener_ehepartner"
E = "zitat"
"""

SHEETS = {
    "Taufen": [["Tag", "Name", "Vorname", "Vater", "Mutter"], ["1750-03-01", "Haag", "Anna", "Haag, Georg, Weber", "Eberle, Maria"], ["1752-05-02", "Haag", "Jacob", "Haag, Georg", "Eberle, Maria"], ["1725-01-01", "Haag", "Georg", None, None]],
    "Ehen": [["Tag", "Bräutigam", "Braut"], ["1749-02-03", "Haag, Georg", "Eberle, Maria"]],
    "Tote": [["Tag", "Name", "Alter", "Gatte", "Zitat"], ["1790-04-05", "Haag, Georg", "65 J", "Eberle, Maria", "Tod 1790/3"], [None, None, None, None, None]],
}


def cells(spark):
    rows = [("f.xlsx", sheet, i + 1, j, v) for sheet, table in SHEETS.items() for i, line in enumerate(table) for j, v in enumerate(line) if v]
    return spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string")


def test_from_sheets_to_a_checked_tree(spark, tmp_path):
    p = project.build(cells(spark), tables.load_mapping(MAPPING))
    assert p.mentions.count() == 3 + 4 + 2 + 2 and p.sources.count() == 3
    p = project.link(p)
    s = project.status(p).first()
    assert (s.entries, s.mentions, s.families, s.wedded, s.children) == (5, 11, 1, 1, 2)
    assert s.identities == 4  # Georg by baptism, wedding, fatherhood and burial is one person
    project.write_gedcom(p, str(tmp_path / "out"))
    text = "\n".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "t.ged").write_text(text)
    lines = gedcom.read_lines(spark, str(tmp_path / "t.ged"))
    assert project.verify(p, lines).isEmpty()
    assert "2 DATE 1 JAN 1725" in text and "1 OCCU Weber" in text and "3 PAGE Tod 1790/3" in text and "3 PAGE f.xlsx, Taufen (taufe), Zeile 2" in text
    cut = lines.where("NOT (tag = 'PAGE' AND value = 'Tod 1790/3')").where("record <> '@F" + str(p.families.first().family) + "@'")
    assert {r.kind for r in project.verify(p, cut).collect()} == {"uncited", "dangling"}
    model = Model(*gedcom.read_model(lines))
    assert CATALOGUE["010"].run(model, None).isEmpty() and CATALOGUE["115"].run(model, None).count() == 0
    hits = model.p.select(F.when(c("sex") == "m", "010").otherwise("011").alias("rule"), "person_id")
    project.write_hits(hits, str(tmp_path / "hits"))
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 4
    for run in (1, 2):
        project.append_run(spark.createDataFrame([(run, "p", "families", 1)], "run int, project string, metric string, value int"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_empty_project(spark):
    p = project.link(project.build(cells(spark).where("row > 99"), tables.load_mapping(MAPPING)))
    assert p.mentions.count() == 0 and project.status(p).first().identities == 0


WEDDINGS = [("1758-05-10", "Kiefer", "Friedrich", "Burckhardt", "Catharina"), ("1767-02-03", "Kiefer", "Friedrich", "Haas", "Catharina")]
TWICE = """
[ehe]
blatt = "Ehen"
A = "trauung_datum"
B = "braeutigam_name"
C = "braeutigam_vorname"
D = "braut_name"
E = "braut_vorname"

[taufe]
blatt = "Taufen"
A = "tauf_datum"
B = "kind_name"
C = "kind_vorname"
D = "vater"
E = "mutter"

[tod]
blatt = "Tote"
A = "sterbe_datum"
B = "verstorbener_name"
C = "verstorbener_vorname"
D = "verstorbener_ehepartner"
"""


def twice(spark, dead=()):
    sheets = {"Ehen": WEDDINGS, "Taufen": [("1770-03-01", "Kiefer", "Johann", "Kiefer, Friedrich", "N., Catharina")], "Tote": dead}
    rows = [("r.xlsx", sheet, i + 2, j, v) for sheet, table in sheets.items() for i, line in enumerate(table) for j, v in enumerate(line) if v]
    return project.build(spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string"), tables.load_mapping(TWICE))


def wedding_of_the_child(p):
    kid = p.mentions.where("path = 'kind'").join(p.links.select("id", "identity"), "id").first().identity
    return p.families.where(F.array_contains("children", kid)).first().wedding


def test_a_tie_is_left_open_reviewed_and_decided(spark):
    p = project.link(twice(spark))
    assert wedding_of_the_child(p) is None  # of neither marriage
    mother = p.mentions.where("path = 'mutter'").join(p.links, "id").first()
    assert mother.stage == "neu" and "offen" in mother.reason and len(mother.alternatives) == 2
    names = p.mentions.join(p.links, "id").where(c("identity").isin([a.identity for a in mother.alternatives])).select("name").distinct().collect()
    assert {r.name for r in names} == {"Burckhardt", "Haas"}
    listed = project.review(p)
    assert listed.columns == list(project.REVIEW)
    row = listed.where("ROLLE = 'mutter'").first()
    assert row.STUFE == "neu" and row.WAHL == "eigene Person (unentschieden)" and row.SCHLUESSEL == "r.xlsx|Taufen|2|mutter" and row.JAHR == 1770
    first = next(line for line in row.KANDIDATEN.split("\n") if "Burckhardt, Catharina" in line)
    number = first[1 : first.index("]")]
    sheet = listed.withColumn("URTEIL", F.when(c("ROLLE") == "mutter", number).otherwise(""))
    decisions = project.decide(p, sheet)
    assert [tuple(r) for r in decisions.collect()] == [("r.xlsx|Taufen|2|mutter", "gleich", "r.xlsx|Ehen|2|braut")]
    again = project.link(twice(spark), decisions)  # a rebuild: keys stay
    assert wedding_of_the_child(again).y == 1758 and again.families.where("husband IS NOT NULL").count() == 2
    told = again.mentions.where("path = 'mutter'").join(again.links, "id").first()
    assert (told.stage, told.points, told.reason) == ("sicher", 999, "von Hand bestaetigt")
    assert project.review(again, decisions).where("ROLLE = 'mutter'").first().BISHER == "gleich r.xlsx|Ehen|2|braut"


def test_the_first_wifes_death_decides(spark):
    p = project.link(twice(spark, [("1766-08-20", "Burckhardt", "Catharina", "Kiefer, Friedrich")]))
    assert wedding_of_the_child(p).y == 1767
