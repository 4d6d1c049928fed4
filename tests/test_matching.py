"""Fields that headings are taken for."""

from kinweave import project
from kinweave.operators import matching
from kinweave.sources import tables


def test_partners_and_former_marriages_have_their_own_fields(spark):
    names = {r: [f[0] for f in matching.fields_of(r)] for r in matching.MAIN_ROLES}
    assert "verstorbener_ehepartner_geschlecht" in names["tod"] and "verstorbener_ehepartner_stand" not in names["tod"]
    assert "braut_vorehe_herkunft" in names["ehe"] and "braut_vorehe_stand" not in names["ehe"]
    assert names["taufe"].index("geburt_datum") < names["taufe"].index("ort")  # its own first, then those of all
    rows = [(1, "tod", "Ehefrau Geschlecht", None), (2, "ehe", "Braut Vormann Status", None), (3, "tod", "Ehefrau Beruf", None)]
    heads = spark.createDataFrame(rows, "id long, register string, heading string, context string")
    found = {r["id"]: r["field"] for r in matching.guess_fields(heads, matching.catalogue(spark)).select("id", "field").collect()}
    assert found[1] == "verstorbener_ehepartner_geschlecht" and found[3] == "verstorbener_ehepartner_beruf"
    assert found[2] != "braut_vorehe_stand"


#: Sheets by hand: heading, cells, and the field, first to last column and confidence that it must get; a heading of a run but the first gets none of its own.
SHEETS = {
    ("b/kirche.xlsx", "Taufen"): ("taufe", [
        ("lfd. Nr.", ["4711", "4712"], "lfd_nr_gesamt", "sicher"), ("Ort", ["Mühlenstadt"], "ort", "sicher"), ("lfd. Nr.", ["1", "2"], "lfd_nr", "sicher"), ("Taufdatum", ["1750-02-03"], "tauf_datum", "sicher"),
        ("Name", ["Haag"], "kind_name", "sicher"), ("Vater", ["Haag, Georg"], "vater", "sicher"), ("Beruf", ["Weber"], "vater_beruf", "wahrscheinlich"), ("Mutter", [], "mutter", "sicher"),
        ("Taufpate 1", ["k.A."], "paten", "sicher"), ("Taufpate 2", [], None, None), ("Taufpate 3", ["NN"], None, None), ("Bemerkung", ["NN"], "bemerkung", "sicher"),
    ]),
    ("b/technisch.xlsx", "Blatt 1"): ("ehe", [
        ("dat_trauung", ["bald"], "trauung_datum", "unsicher"), ("vn_braeu_kb", ["Hans"], "braeutigam_vorname_kb", "sicher"), ("fn_vater_braeu", ["Haag"], "braeutigam_vater_name", "sicher"),
        ("vn_braut", ["Anna"], "braut_vorname", "sicher"), ("Vater", ["Eberle, Jacob"], "braut_vater", "sicher"), ("Beruf Vater", [], "braut_vater_beruf", "sicher"), ("Xyzzy 1", ["?"], None, None), ("Xyzzy 2", [], None, None),
    ]),
}


def sheets(spark):
    rows = [(*at, 1, i, h) for at, (_, cols) in SHEETS.items() for i, (h, *_) in enumerate(cols)]
    rows += [(*at, k + 2, i, v) for at, (_, cols) in SHEETS.items() for i, (_, vs, *_) in enumerate(cols) for k, v in enumerate(vs)]
    return spark.createDataFrame([*rows, ("b/x.xlsx", "leer", 1, 0, "qqq"), ("b/x.xlsx", "leer", 2, 0, "1")], "file string, sheet string, row int, col int, value string")


def test_a_mapping_is_proposed_for_all_sheets_at_once(spark):
    got = {(r.file, r.sheet, r.first): (r.register, r.last, r.field, r.confidence, r.samples, r.filled) for r in matching.propose(sheets(spark)).collect()}
    want = {}
    for at, (register, cols) in SHEETS.items():
        for i, (heading, values, field, sure) in enumerate(cols):
            if heading.startswith("Taufpate") and i > 8:
                continue
            want[*at, i] = (register, 10 if heading == "Taufpate 1" else i, field, sure, values, len(values))
    assert got == want


def test_a_proposal_is_a_mapping_file(spark):
    text = project.propose(sheets(spark))
    read = tables.load_mapping(text)
    assert [(s["file"], s["name"], s["register"]) for s in read] == [("kirche.xlsx", "Taufen", "taufe"), ("technisch.xlsx", "Blatt 1", "ehe")]
    assert ("paten", [8, 9, 10], None) in read[0]["fields"] and read[0]["blanks"] == ["?", "NN", "k.A."]
    assert '# G = "???"  # unbekannt: Xyzzy 1: ?' in text and '# H = "???"  # leer: Xyzzy 2' in text and 'A = "trauung_datum"  # unsicher: dat_trauung: bald' in text
    built = project.build(sheets(spark), read)
    assert {r.path for r in built.mentions.select("path").distinct().collect()} >= {"kind", "vater", "braeutigam", "braut"}


def test_no_sheets_no_proposal(spark):
    nothing = sheets(spark).where("row < 0")
    assert matching.propose(nothing).isEmpty() and tables.load_mapping(project.propose(nothing)) == []


def test_sections_within_register(spark):
    text = '[allgemein]\nleer = ["NN"]\n[register.taufe]\nblatt = "B"\ndatei = "a.xlsx"\n[register.taufe.spalten]\nA = "kind_name"\n"C-D" = "paten"\n[register.taufe_2]\nregister = "taufe"\nblatt = "C"\n[register.taufe_2.spalten]\nB = ""\n'
    read = tables.load_mapping(text)
    assert read[0] == {"file": "a.xlsx", "name": "B", "register": "taufe", "blanks": ["NN"], "fields": [("kind_name", [0], None), ("paten", [2, 3], None)]}
    assert read[1] == {"name": "C", "register": "taufe", "blanks": ["NN"], "fields": []}
