"""Sheets, mappings, GEDCOM and the streaming ingest on small files."""

import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators import matching
from kinweave.plans import registers
from kinweave.sources import gedcom, tables
from kinweave.streaming.ingest import stream_entries


def test_csv_is_sniffed(spark, tmp_path):
    for name, text, encoding in (("a", "Name;Vorname\nMüller;Anna\nHaag;\n", "utf-8-sig"), ("b", "Name,Vorname\nMüller,Anna\nHaag,\n", "cp1252"), ("c", "Name\tVorname\nMüller\tAnna\nHaag\t\n", "utf-8")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        rows = tables.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert rows.columns == ["Name", "Vorname"] and [tuple(r) for r in rows.collect()] == [("Müller", "Anna"), ("Haag", None)]


def test_xlsx_cells(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "k.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Taufen" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Mül</t></r><r><t>ler</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="AB3"><v>12</v></c><c r="C3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    cells = tables.read_xlsx(spark, str(tmp_path / "k.xlsx")).select("sheet", "row", "col", "value").collect()
    assert sorted(map(tuple, cells)) == [("Taufen", 1, 0, "Name"), ("Taufen", 3, 0, "Müller"), ("Taufen", 3, 2, "x"), ("Taufen", 3, 27, "12")]


def test_mapping_round_trip():
    text = 'leer = ["k.A."]\n[taufe]\nblatt = "Taufen"\nA = "kind_name"\nS-U = "paten"\nK = ""\nM = "kind_geschlecht=m"\n[taufe_2]\nB = "jahr"\n'
    sheets = tables.load_mapping(text)
    assert sheets[0] == {"name": "Taufen", "register": "taufe", "blanks": ["k.A."], "fields": [("kind_name", [0], None), ("paten", [18, 19, 20], None), ("kind_geschlecht", [12], "m")]}
    assert sheets[1]["register"] == "taufe" and sheets[1]["fields"] == [("jahr", [1], None)]
    again = tables.load_mapping(tables.dump_mapping(sheets))
    assert [s["fields"] for s in again] == [s["fields"] for s in sheets]


TREE = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Johann /Haag/
1 NAME Hans /Hag/
1 SEX M
1 BIRT
2 DATE 31 AUG 1778
2 PLAC Urach
1 FAMS @F1@
0 @I2@ INDI
1 NAME Anna /Müller/
1 SEX F
1 DEAT
2 DATE ABT 1830
1 FAMS @F1@
0 @I3@ INDI
1 NAME Jacob /Haag/
1 FAMC @F1@
0 @F1@ FAM
1 HUSB @I1@
1 MARR
2 DATE 1800
1 CHIL @I9@
0 TRLR
"""


def test_gedcom_reader(spark, tmp_path):
    (tmp_path / "tree.ged").write_bytes(("﻿" + TREE).encode())
    lines = gedcom.read_lines(spark, str(tmp_path / "tree.ged"))
    assert lines.where("level = 0").count() == 6
    persons, families, children = gedcom.persons_and_families(lines)
    p = {r.xref: r for r in persons.collect()}
    assert (p["@I1@"].given, p["@I1@"].surname, tuple(p["@I1@"].birth)) == ("Johann", "Haag", (1778, 8, 31))
    assert tuple(p["@I2@"].death) == (1830, None, None)
    f = families.first()
    assert (f.husband, f.wife, f.wedding.y) == ("@I1@", "@I2@", 1800)  # the wife is known from her own record only
    assert {r.child for r in children.collect()} == {"@I3@", "@I9@"}
    assert [tuple(r) for r in gedcom.dangling(lines).collect()] == [("@F1@", "CHIL", "@I9@")]


def test_gedcom_writer(spark, tmp_path):
    people = spark.createDataFrame([(1, "Johann", "Haag", "m", (1778, 8, 31), None, "Weber"), (2, "Anna", "", "u", None, (1830, None, None), "")], "person_id long, given string, surname string, sex string, birth struct<y:int,m:int,d:int>, death struct<y:int,m:int,d:int>, occupation string")
    gedcom.write(gedcom.individual_lines(people), str(tmp_path / "out"))
    lines = gedcom.read_lines(spark, str(tmp_path / "out"))
    persons, _, _ = gedcom.persons_and_families(lines)
    p = {r.xref: r for r in persons.collect()}
    assert (p["@I1@"].given, p["@I1@"].surname, p["@I1@"].sex, tuple(p["@I1@"].birth)) == ("Johann", "Haag", "M", (1778, 8, 31))
    assert p["@I2@"].sex is None and p["@I2@"].death.y == 1830


def test_headings_by_hand(spark):
    rows = [(i, r, h, k) for i, (r, h, k, _, _) in enumerate(registers.HEADINGS)]
    out = matching.guess_fields(spark.createDataFrame(rows, "id long, register string, heading string, context string"), matching.catalogue(spark)).collect()
    assert {r.id: (r.field, r.points) for r in out} == {i: (f, p) for i, (_, _, _, f, p) in enumerate(registers.HEADINGS)}


def test_streaming_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    schema = T.StructType([T.StructField(x, T.StringType()) for x in ("datum", "name")])
    mapping = [("sterbe_datum", ["datum"], None), ("verstorbener_name", ["name"], None)]

    def run(checkpoint):
        stream_entries(spark, str(source), schema, mapping, "tod", str(target), str(tmp_path / checkpoint), ("k.A.",)).awaitTermination(120)
        return sorted((r.file, r.date.y, r.n) for r in spark.read.parquet(str(target)).select("file", "date", F.col("fields")["verstorbener_name"]["value"].alias("n")).collect())

    (source / "a.csv").write_text("datum,name\n1778-08-31,Haag\n1780-01-01,k.A.\n")
    first = run("one")
    assert first == [("a.csv", 1778, "Haag"), ("a.csv", 1780, None)] or {x[:2] for x in first} == {("a.csv", 1778), ("a.csv", 1780)}
    (source / "b.csv").write_text("datum,name\n1790,Eberle\n")
    assert len(run("one")) == 3
    assert len(run("two")) == 3  # everything once more, from the start


def test_csv_files_of_several_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name;Jahr\nMüller;1750\nHaag;\n".encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes("Name,Jahr\nGröße–Mayer,1751\n\"a,b\",1752\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("Jahr;Ort\n1760;Urach\n".encode())
    (tmp_path / "d.csv").write_bytes(("Name;Jahr\n" + "".join(f"n{i};{i}\n" for i in range(500))).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = tables.read_csv(spark, str(tmp_path), numbered=True)
        got = {(r.file.rsplit("/", 1)[1], r.row): (r.Name, r.Jahr, r.Ort) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["a.csv", 2] == ("Müller", "1750", None) and got["a.csv", 3] == ("Haag", None, None)
    assert got["b.csv", 2] == ("Größe–Mayer", "1751", None) and got["b.csv", 3] == ("a,b", "1752", None)
    assert got["c.csv", 2] == (None, "1760", "Urach")
    assert all(got["d.csv", i + 2] == (f"n{i}", str(i), None) for i in range(500)) and len(got) == 505
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "f.csv").write_text('a;b\n"x\ny";1\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "e"), multiline=True).collect()] == [("x\ny", "1")]


def test_xlsx_dates_and_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Tote" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;dm&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        cells = '<c r="A2" s="1"><v>18264</v></c><c r="B2" s="2"><v>18264.5</v></c><c r="C2" s="3"><v>3.0</v></c><c r="D2"><v>18264</v></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Tag</t></is></c></row><row r="2">{cells}</row><row r="4"><c r="A4"><v>5</v></c></row></sheetData></worksheet>')
    cells = tables.read_xlsx(spark, str(tmp_path / "d.xlsx"))
    assert {r.col: r.value for r in cells.where("row = 2").collect()} == {0: "1950-01-01", 1: "1950-01-01T12:00:00", 2: "3", 3: "18264"}
    sheet = tables.list_sheets(cells).first()
    assert (sheet.sheet, sheet.n_rows, [tuple(h) for h in sheet.headings]) == ("Tote", 2, [(0, "Tag")])
    assert {r.row: r["values"] for r in tables.sheet_rows(cells).collect()}[4] == {0: "5"}


def test_mapping_with_remarks():
    text = tables.dump_mapping([{"name": "B", "register": "tod", "fields": [("verstorbener_name", [0], None)], "notes": {"A": "sicher: Haag, Beck"}, "open": [(3, "Pest")]}])
    assert 'A = "verstorbener_name"  # sicher: Haag, Beck' in text and '# D = "???"  # Pest' in text
    assert tables.load_mapping(text)[0]["fields"] == [("verstorbener_name", [0], None)]
