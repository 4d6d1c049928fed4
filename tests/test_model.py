"""One family book as GEDCOM, as SQLite file and as tables: the same model, the same hits."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from kinweave.operators.rules import run_rules
from kinweave.sources import model

c = F.col

PERSONS = [
    (1, "Georg", "Haag", "m", "1 JAN 1725", "5 APR 1720"), (2, "Maria", "Eberle", "w", "1730", None), (3, "Anna", "Haag", "w", "1 MAR 1720", None), (4, "Jacob", "Haag", "m", "2 MAY 1752", "31 FEB 1760"),
]
RULES = ["010", "011", "013", "014", "018", "117"]


def gedcom_text():
    out = ["0 HEAD"]
    for n, given, surname, sex, born, died in PERSONS:
        out += [f"0 @I{n}@ INDI", f"1 NAME {given} /{surname}/", f"1 SEX {'M' if sex == 'm' else 'F'}", "1 BIRT", f"2 DATE {born}"] + (["1 DEAT", f"2 DATE {died}"] if died else [])
    return "\n".join([*out, "0 @F1@ FAM", "1 HUSB @I1@", "1 WIFE @I2@", "1 CHIL @I3@", "1 CHIL @I4@", "1 MARR", "2 DATE 3 FEB 1719", "0 TRLR"]) + "\n"


def write_sqlite(path, more=()):
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode = WAL")
    con.execute("CREATE TABLE ofb_individuum (id INTEGER PRIMARY KEY, vn_kanonisch TEXT, fn_kanonisch TEXT, geschlecht TEXT, geburt_iso TEXT, tod_iso TEXT, beruf TEXT, notiz TEXT)")
    con.executemany("INSERT INTO ofb_individuum (id, vn_kanonisch, fn_kanonisch, geschlecht, geburt_iso, tod_iso) VALUES (?, ?, ?, ?, ?, ?)", PERSONS)
    con.execute("CREATE TABLE ofb_familie (id INTEGER PRIMARY KEY, vater_id INTEGER, mutter_id INTEGER, heirat_iso TEXT, notiz TEXT)")
    con.execute("INSERT INTO ofb_familie VALUES (1, 1, 2, '3 FEB 1719', NULL)")
    con.execute("CREATE TABLE ofb_familie_kind (familie_id INTEGER, individuum_id INTEGER, geburtsreihe INTEGER)")
    con.execute("INSERT INTO ofb_familie_kind VALUES (1, 4, NULL), (1, 3, 1)")
    for sql in more:
        con.execute(sql)
    con.commit()
    con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    con.close()


def test_three_forms_of_a_book(spark, tmp_path):
    (tmp_path / "b.ged").write_text(gedcom_text())
    write_sqlite(tmp_path / "b.db")
    a, b = (model.open_model(spark, str(tmp_path / x)) for x in ("b.ged", "b.db"))
    for name in model.TABLES:
        if name in model.NEEDED:
            model.read_sqlite(spark, str(tmp_path / "b.db"), name, model.TABLES[name]).write.parquet(str(tmp_path / "tables" / name))
    t = model.open_model(spark, str(tmp_path / "tables"))
    rows = [sorted(map(tuple, m.p.drop("xref").select(*b.p.columns).collect())) for m in (a, b, t)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 4
    assert [sorted(map(tuple, m.fc.select("family_id", "child", "pos").collect())) for m in (a, b, t)] == [[(1, 3, 1), (1, 4, 2)]] * 3
    hits = [sorted(map(tuple, run_rules(m, RULES).collect())) for m in (a, b)]
    assert hits[0] == hits[1] and {h[0] for h in hits[0]} >= {"010", "011", "018"}
    assert t.merged is None and b.merged.isEmpty() and b.alias.isEmpty()


def test_optional_tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    people = [(1, 7, "kopf", "Georg ", "1787-05-15", None), (2, 7, "kind", "Jacob", "1790", 8), (3, 8, "kopf", "Jacob", "1791", None), (4, 8, "kind", None, None, None)]
    book = {
        "ofb_individuum": make(people, "id int, artikel_id int, rolle string, vn_kanonisch string, tod_iso string, eigenes_artikel_id int"),
        "ofb_familie": make([(1, 1, "x")], "id int, vater_id int, mutter_id string"), "ofb_familie_kind": make([(1, 2), (9, 3)], "familie_id int, individuum_id int"),
        "ofb_person_kanon": make([(3, 2, "karte")], "id int, kanon_id int, quelle string"), "blank_artikel": make([(7, "+ 1787-05-15 (81 J 6 M)")], "id int, roh_text string"),
    }
    m = model.from_tables(book)
    p = {r.person_id: r for r in m.p.collect()}
    assert set(p) == {1, 2, 4} and p[1].given == "Georg" and p[1].surname == "" and p[1].sex == "u" and p[1].text_age == 81.5 and p[2].text_age is None and p[4].given == ""
    assert [tuple(r) for r in m.merged.collect()] == [(2, "1790", "1791")] and m.alias.isEmpty()
    del book["ofb_person_kanon"]
    m = model.from_tables(book)
    assert [tuple(r) for r in m.alias.collect()] == [(2, 3)] and m.p.count() == 4 and m.f.first().wife is None and m.merged is None
    assert {(r.family_id, r.child, r.pos) for r in m.fc.collect()} == {(1, 2, 1), (9, 3, 1)}
    assert run_rules(m, ["410"]).count() == 0
    with pytest.raises(ValueError, match="ofb_familie_kind"):
        model.from_tables({k: v for k, v in book.items() if k != "ofb_familie_kind"})
