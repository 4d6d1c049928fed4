"""Names, dates and ages against values worked out by hand."""

import datetime

import pytest
from hypothesis import given as some
from hypothesis import HealthCheck, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import dates as D
from kinweave.functions import names as N
from kinweave.functions import stats
from kinweave.functions.phonetic import koelner


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


KEYS = {"Haag": "04", "Hag": "04", "Eberle": "0175", "Eberlin": "01756", "Kriehmann": "4766", "Kriemann": "4766", "Müller": "657", "Miller": "657", "Schmid": "862", "Schmidt": "862", "Schmitz": "868", "bolt": "152", "plate": "152", "anvil": "0635", "c": "4", "": "", "123": ""}


def test_koelner(spark):
    assert run(spark, koelner, [*KEYS, None]) == [*KEYS.values(), ""]


def plain_koelner(name):
    """The key by a loop over the letters, as a second opinion."""
    s = "".join(x for x in name.lower().translate(str.maketrans("äöü", "aou")).replace("ß", "ss").replace("ph", "f") if "a" <= x <= "z")
    digits = ""
    for i, x in enumerate(s):
        a, b = s[i - 1 : i] if i else "", s[i + 1 : i + 2]
        if x == "c":
            digits += ("4" if not b or b in "ahkloqrux" else "8") if not a else "8" if a in "sz" else "4" if not b or b in "ahkoqux" else "8"
        elif x in "dt":
            digits += "8" if b and b in "csz" else "2"
        elif x == "x":
            digits += "8" if a and a in "ckq" else "48"
        else:
            digits += {**dict.fromkeys("aeijouy", "0"), "h": "", **dict.fromkeys("bp", "1"), **dict.fromkeys("fvw", "3"), **dict.fromkeys("gkq", "4"), "l": "5", **dict.fromkeys("mn", "6"), "r": "7"}.get(x, "8")
    once = "".join(x for i, x in enumerate(digits) if not i or digits[i - 1] != x)
    return once[:1] + once[1:].replace("0", "")


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@some(st.lists(st.text("abcdefghijklmnopqrstuvwxyzäöüßCPH -", max_size=14), min_size=60, max_size=60))
def test_koelner_property(spark, names):
    assert run(spark, koelner, names) == [plain_koelner(n) for n in names]


def test_given_names(spark):
    values = {"Johann": "johan", "Johannes": "johan", "Hans": "johan", "Anna": "ane", "Catharina": "katarine", "Jacob": "jakob", "Jakobus": "jakob", "Georgius": "georg", "Nicolaus": "nikolaus", "Friderica": "friderike", "Friedrika": "friderike", "Paulus": "paul", "Johann Georg": "johan georg", "Maria": "maria", "": ""}
    assert run(spark, N.given_canon, [*values, None]) == [*values.values(), ""]
    pairs = [("johan", "johan", 100), ("jakob", "jakob fridrich", 90), ("jakob", "johan jakob", 80), ("johan", "johan jakob", 60), ("ane", "maria ane", 40), ("georg", "johan jakob", 0), ("johan georg", "kristof georg", 0), ("johan georg", "georg johan", 70), ("", "johan", None), (None, "johan", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(N.given_points(F.col("a"), F.col("b")), "i").orderBy("i").collect()] == [p for *_, p in pairs]


def test_similar_names(spark):
    pairs = [("Haag", "Hag", True), ("Aberle", "Aberlin", True), ("Weber", "Wegmer", False), ("Maier", "Meyer", True), ("", "Haag", False), (None, "Haag", False), ("HAAG", "haag", True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(N.names_similar(F.col("a"), F.col("b")), "i").orderBy("i").collect()] == [p for *_, p in pairs]


def test_parse_person(spark):
    rows = run(spark, N.parse_person, ["Haag, Nicolaus, weyl., gewesener adelicher Kutscher", "Rosenfeld von, Anna Maria (Witwe)", "Mädchen - totgeboren", "Müller(in), Anna geb. Schmid", "N., Catharina", "Rebenfels, Maria Magdalena von", None, ""])
    assert (rows[0].name, rows[0].given, rows[0].occupation, rows[0].deceased) == ("Haag", "Nicolaus", "gewesener adelicher Kutscher", True)
    assert (rows[1].name, rows[1].widowed) == ("von Rosenfeld", True)
    assert rows[2].stillborn and rows[2].sex == "F" and rows[2].name is None
    assert (rows[3].name, rows[3].birth_name, rows[3].sex) == ("Müller", "Schmid", "F")
    assert rows[4].unknown and rows[4].given == "Catharina"
    assert (rows[5].name, rows[5].given) == ("von Rebenfels", "Maria Magdalena")
    assert rows[6].name is None and not rows[7].unknown


def test_marital_and_sex(spark):
    assert run(spark, N.marital_kind, ["Witwe", "verheiratet", "ledig", "Knabe", "", None]) == ["ehe", "ehe", "ledig", "kind", None, None]
    assert run(spark, lambda c: N.sex_of_given(c, ["johann", "georg"], ["anna"]), ["Johann Georg", "Xaver Anna", "Xaver", None]) == ["M", "F", None, None]


def test_dates(spark):
    dates = {"1778-08-31": (1778, 8, 31), "1699-08-00": (1699, 8, None), "12.03.1778": (1778, 3, 12), "1750": (1750, None, None), "um 1750": (1750, None, None), "1793-93-04": (1793, None, None), "1793-02-31": (1793, 2, 31)}
    assert [tuple(r) for r in run(spark, D.partial_date, list(dates))] == list(dates.values())
    assert run(spark, D.partial_date, [None, "", "nie"]) == [None, None, None]
    assert run(spark, D.date_prefix, ["um 1750", "vor 1800", "nach 1", "err. 1", "gesch. 1", "1750", None]) == ["ABT", "BEF", "AFT", "CAL", "EST", None, None]
    ages = {"59 J 10 M 4 T": 21839, "3 J., 7 M., 14 T": 1319, "24 Wochen": 168, "1 Monat": 30, "0": 0, "½ Jahr": 182, "5 jährig": 1825, "12": 12, "alt": None}
    assert run(spark, D.age_days, list(ages)) == list(ages.values())
    assert run(spark, lambda c: D.age_days(c, "years"), ["12"]) == [4380]
    rule = {"31.2.1793": (1793, 2, 31), "1793-02-31": (1793, 2, 31), "3.1793": (1793, 3, None), "31 AUG 1778": (1778, 8, 31), "ABT 1750": (1750, None, None)}
    assert [tuple(r) for r in run(spark, D.rule_date, list(rule))] == list(rule.values())


def test_counting_days(spark):
    born = run(spark, lambda c: D.minus_days(D.partial_date(c), F.lit(21839)), ["1798-11-24"])[0]
    assert tuple(born) == (1739, 2, 8)
    days = run(spark, lambda c: D.ordinal(D.partial_date(c)), ["1793-02-31", "1750", "1750-03", "1778-08-31"])
    assert days == [datetime.date(1793, 2, 1).toordinal(), datetime.date(1750, 6, 15).toordinal(), datetime.date(1750, 3, 15).toordinal(), datetime.date(1778, 8, 31).toordinal()]
    assert run(spark, lambda c: D.impossible(D.rule_date(c)), ["29.2.1900", "29.2.2000", "31.4.1800", "1.13.1800", "1800", None]) == [True, False, True, True, False, False]
    assert run(spark, lambda c: D.gedcom_date(D.partial_date(c)), ["1778-08-31", "1778-08", "1778"]) == ["31 AUG 1778", "AUG 1778", "1778"]


@pytest.mark.parametrize(("k", "n"), [(0, 0), (0, 10), (7, 10), (10, 10), (492, 500)])
def test_wilson(spark, k, n):
    low, high = stats.wilson(F.lit(k), F.lit(n))
    got = spark.range(1).select(low.cast("double"), high.cast("double")).first()
    if not n:
        assert tuple(got) == (0, 0)
    else:
        p, z = k / n, 1.96
        mid, half, scale = p + z * z / (2 * n), z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5, 1 + z * z / n
        assert got[0] == pytest.approx(max(0, (mid - half) / scale)) and got[1] == pytest.approx(min(1, (mid + half) / scale))
