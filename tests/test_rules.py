"""Rules on persons and families made for them: a hit and a near miss each."""

import pytest

from kinweave.operators import rules as R
from kinweave.operators.graph import ancestors, components, own_ancestors

DATE = "struct<y:int,m:int,d:int>"
P = f"person_id long, given string, surname string, sex string, birth {DATE}, death {DATE}, baptism {DATE}, burial {DATE}, occupation string, note string, place string, role string, article long, text_age double"
FAM = f"family_id long, husband long, wife long, wedding {DATE}, note string"


def person(i, birth=None, death=None, given="Anna", surname="Haag", sex="w", baptism=None, burial=None, occupation="", note="", place="", role="", article=None, text_age=None):
    date = lambda d: None if d is None else tuple(map(int, d.split("-"))) + (None,) * (2 - d.count("-"))
    return (i, given, surname, sex, date(birth), date(death), date(baptism), date(burial), occupation, note, place, role, article, text_age)


def model(spark, people, families=(), children=(), **more):
    date = lambda d: None if d is None else tuple(map(int, d.split("-"))) + (None,) * (2 - d.count("-"))
    fams = [(i, h, w, date(d), note) for i, h, w, d, note in families]
    return R.Model(spark.createDataFrame(people, P), spark.createDataFrame(fams, FAM), spark.createDataFrame(list(children), "family_id long, child long, pos int"), **more)


def ids(m, rule, limit=None, what="person_id"):
    r = R.CATALOGUE[rule]
    return sorted(x[what] for x in r.run(m, r.limit if limit is None else limit).collect())


MAN = dict(sex="m", given="Johann")
CASES = [
    ("010", [person(1, "1800", "1799"), person(2, "1800-05-05", "1800-05-05")], [], [], [1]),
    ("011", [person(1, "1800"), person(2, "1790", **MAN)], [(1, 2, 1, "1799", "")], [], [1]),
    ("012", [person(1, None, "1800"), person(2, None, "1801", **MAN)], [(1, 2, 1, "1801", "")], [], [1]),
    ("013", [person(1, "1800"), person(2, "1799"), person(3, "1801")], [(1, None, 1, None, "")], [(1, 2, 1), (1, 3, 2)], [2]),
    ("014", [person(1, "1800", **MAN), person(2, "1799")], [(1, 1, None, None, "")], [(1, 2, 1)], [2]),
    ("015", [person(1, None, "1800-01-01"), person(2, "1800-01-02"), person(3, "1801"), person(4, "1802")], [(1, None, 1, None, "")], [(1, 2, 1), (1, 3, 2), (1, 4, 3)], [2, 4]),
    ("016", [person(1, None, "1800-01-01", **MAN), person(2, "1800-10-01"), person(3, "1800-10-30")], [(1, 1, None, None, "")], [(1, 2, 1), (1, 3, 2)], [3]),
    ("017", [person(1), person(2, **MAN), person(3, "1798"), person(4, "1799")], [(1, 2, 1, "1800", "")], [(1, 3, 1), (1, 4, 2)], [3]),
    ("018", [person(1, "1900-02-29"), person(2, "1904-02-29"), person(3, None, "1800-04-31")], [], [], [1, 3]),
    ("019", [person(1, "2027"), person(2, "2026")], [], [], [1]),
    ("020", [person(1, "1800-02-02", baptism="1800-02-01"), person(2, "1800-02-02", baptism="1800")], [], [], [1]),
    ("021", [person(1, None, "1800-02-02", burial="1799"), person(2, None, "1800-02-02", burial="1800-02-03")], [], [], [1]),
    ("022", [person(1, "1800-02-02"), person(2, "1800-02", **MAN)], [(1, 2, 1, "1800-02-02", "")], [], [1]),
    ("023", [person(1, "1802-01-01"), person(2, "1801-01-01"), person(3, "1800-01-01")], [(1, None, None, None, "")], [(1, 1, 1), (1, 2, 2), (1, 3, 3)], [2]),
    ("110", [person(1, "1700", "1811"), person(2, "1700", "1810")], [], [], [1]),
    ("111", [person(1, "1800"), person(2, "1813"), person(3, "1814")], [(1, None, 1, None, "")], [(1, 2, 1), (1, 3, 2)], [2]),
    ("115", [person(1, "1800"), person(2, "1785", **MAN)], [(1, 2, 1, "1814", "")], [], [1]),
    ("117", [person(1, "1800"), person(2, "1759", **MAN)], [(1, 2, 1, None, "")], [], [2]),
    ("118", [person(1, "1800-01-01"), person(2, "1800-08-01"), person(3, "1800-08-01")], [(1, None, None, None, "")], [(1, 1, 1), (1, 2, 2), (1, 3, 3)], [1, 1]),
    ("125", [person(1, None, "1800-01-01"), person(2, **MAN)], [(1, 2, 1, "1800-01-02", "")], [], [1]),
    ("210", [person(1, given="", surname="NN"), person(2, given="", surname="NN", note="x")], [], [], [1]),
    ("211", [person(1), person(2), person(3)], [(1, 2, None, None, "")], [(1, 3, 1)], [1]),
    ("213", [person(1), person(2)], [(1, None, None, None, ""), (2, None, None, None, "")], [(1, 1, 1), (2, 1, 1), (1, 2, 2)], [1]),
    ("214", [person(1), person(2)], [(1, 1, None, None, "")], [(1, 1, 1), (1, 2, 2)], [1]),
    ("215", [person(1), person(2), person(3, **MAN)], [(1, 2, 1, None, ""), (2, 3, 1, None, "")], [], [2]),
    ("216", [person(1), person(2, **MAN)], [(1, 1, 2, None, "")], [], [1, 2]),
    ("219", [person(1, "1800-01-01"), person(2, "1800-01-01"), person(3, "1800-01")], [], [], [1]),
    ("220", [person(1), person(2, **MAN), person(3)], [(1, 2, 1, None, ""), (2, 2, 3, None, ""), (3, None, None, None, "")], [(3, 1, 1), (3, 2, 2)], [2]),
    ("221", [person(1), person(2, **MAN)], [(1, 2, 1, None, ""), (2, 2, None, None, "")], [(2, 1, 1)], [2]),
    ("222", [person(1, None, "1810", **MAN), person(2), person(3, **MAN)], [(1, 1, 2, "1800", ""), (2, 3, 2, "1805", "")], [], [2]),
    ("122", [person(1, None, "1805-01-01", **MAN), person(2), person(3, **MAN)], [(1, 1, 2, "1800", ""), (2, 3, 2, "1805-02-01", "")], [], [2]),
    ("223", [person(1), person(2, **MAN)], [(1, 2, 1, None, "")], [], [2]),
    ("224", [person(1, "1800"), person(2, "1802"), person(3, "1804", given="Eva")], [(1, None, None, None, "")], [(1, 1, 1), (1, 2, 2), (1, 3, 3)], [2]),
    ("225", [person(1), person(2), person(3)], [(1, 1, None, None, ""), (2, 2, None, None, "")], [(1, 2, 1), (2, 1, 1), (2, 3, 2)], [1, 2]),
    ("227", [person(1, note="wohnte am Marktplatz; kurz", article=5), person(2, note="ja, wohnte am Marktplatz", article=5), person(3, note="wohnte am Marktplatz", article=6)], [], [], [1]),
    ("310", [person(1, surname="Maria"), person(2)], [], [], [1]),
    ("311", [person(1, given="Sohn"), person(2, surname="ohne Namen"), person(3, given="Sohnlein")], [], [], [1, 2]),
    ("312", [person(1, given="Anna aus Urach"), person(2, given="Anna von H")], [], [], [1]),
    ("313", [person(1, given="HansPeter"), person(2, given="McA")], [], [], [1]),
    ("314", [person(1, surname="Haag Kurz"), person(2, surname="von Haag"), person(3, surname="Haag und Kurz")], [], [], [1]),
    ("315", [person(1, given="Anna 1750"), person(2, surname="Haag 3.4."), person(3, given="Anna 12")], [], [], [1, 2]),
    ("316", [person(1, occupation="Johann Bauer"), person(2, occupation="Bauer")], [], [], [1]),
    ("317", [person(1, note="automatisch"), person(2, note="Automaten")], [], [], [1]),
    ("318", [person(1, surname="aus Urach"), person(2, surname="Haus")], [], [], [1]),
    ("319", [person(1, sex="u"), person(2, sex="u"), person(3, **MAN)], [(1, 3, 1, None, "")], [], [1]),
    ("410", [person(1, "1800", "1850", text_age=48.0), person(2, "1800", "1850", text_age=49.0)], [], [], [1]),
]


@pytest.mark.parametrize(("rule", "people", "families", "children", "expected"), CASES, ids=[c[0] for c in CASES])
def test_rule(spark, rule, people, families, children, expected):
    assert ids(model(spark, people, families, children), rule) == expected


def test_family_rules(spark):
    people = [person(i, f"{1800 + 14 * i}-01-01") for i in range(1, 5)]
    m = model(spark, people, [(1, 1, 2, None, ""), (2, 1, 2, None, ""), (3, None, None, None, "Parser"), (4, 99, None, None, "")], [(1, i, i) for i in range(1, 5)])
    assert ids(m, "119", what="family_id") == [1] and ids(m, "120", 3, "family_id") == [1] and ids(m, "124") == [2, 3, 4]
    assert ids(m, "217", what="family_id") == [3] and ids(m, "218", what="family_id") == [4] and ids(m, "226", what="family_id") == [2]
    assert ids(m, "121", 1) == [1, 2] and ids(m, "123", 3) == [2] and ids(m, "317", what="family_id") == [3]


def test_aliases_and_lists(spark):
    pair = spark.createDataFrame([(2, 1)], "a long, b long")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    people = [person(1, "1800-01-01", given="Hans (Maria)", surname="Urach"), person(2, "1800-01-01", given="Hans (Maria)", surname="Urach"), person(3, given="Eva (ledig", surname="Hag", role="kopf")]
    merged = spark.createDataFrame([(1, "1.2.1800", "2.2.1800"), (2, "1.2.1800", " 1.2. 1800"), (3, "1800", "2.2.1800")], "person_id long, death_a string, death_b string")
    m = model(spark, people, alias=pair, rejected_given=words("Hans"), confirmed_given=words("Maria"), rejected_surname=words("Hag"), places=words("Urach", "Hag"), merged=merged)
    assert ids(m, "219") == [] and ids(m, "320") == [1, 2] and ids(m, "321") == [3] and ids(m, "322") == [1, 2] and ids(m, "323") == [3] and ids(m, "411") == [1]
    assert {r.rule for r in R.run_rules(m, ["320", "323"]).collect()} == {"320", "323"}


def test_catalogue():
    assert len(R.CATALOGUE) == 64 and sum(r.severity == "error" for r in R.CATALOGUE.values()) == 40


def test_graph_walks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "child long, parent long")
    assert {r.person_id for r in own_ancestors(edges).collect()} == {1, 2, 3}
    assert sorted(map(tuple, ancestors(edges).where("person_id = 4").collect())) == [(4, 1), (4, 2), (4, 3)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a long, b long")
    roots = {r.id: r.root for r in components(chain).collect()}
    assert set(roots.values()) == {1, 100} and roots[30] == 1
