"""A register's persons and families, derived from the given tables.

An order is a family: its customer the husband, the first supplier of its lines the wife, its date the
wedding; its lines are the children, born when shipped. What the tables lack is derived from keys. The
text of these views runs in Spark and in DuckDB alike, so that both see the same persons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_struct
from ..operators.rules import Model
from ..sources.shared import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: str, values: list[str]) -> str:
    """One of several texts by a key."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST(({key}) % {len(values)} AS INT) {arms} END"


GIVEN = ["Johann", "Anna Maria", "Catharina", "Johann Georg", "Hans (Maria)", "unbekannt", "Jacob aus Winterbach", "HansPeter", "Georg 12.3.1750", "Nicolaus", "Barbara (verw)", ""]
SURNAME = ["Haag", "Hag", "NN", "Müller", "Anna", "Schmid Kurz", "von Rosenfeld", "aus Urach", "Eberle", "Eberlin", "Winterbach", "Kriemann", "ohne namen", "KurzMann", "Haag 1750"]
OCCUPATION = ["Bauer", "", "Johann der Schmied", "Weber", "Weingärtner"]
NOTE = ["", "wohnte am Markt; zahlte den Zehnten", "automatisch gelesen", "zahlte den Zehnten; starb jung", "kurz"]

#: Lines as children: one for each number in an order, as numbers are not unique.
CHILD = "SELECT l_orderkey AS family_id, l_linenumber AS pos, min(l_shipdate) AS born, min(l_partkey) AS part, min(l_suppkey) AS supp FROM {lineitem} GROUP BY l_orderkey, l_linenumber"

PERSONS = f"""
SELECT CAST(c_custkey AS BIGINT) AS person_id, {pick('c_custkey * 7', GIVEN)} AS given, {pick('c_custkey * 11', SURNAME)} AS surname,
  {pick('c_custkey', ['m', 'm', 'm', 'w', 'u'])} AS sex,
  CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 1900 + c_custkey * 13 % 90 END AS INT) AS birth_y,
  CAST(CASE WHEN c_custkey % 11 = 0 OR c_custkey % 14 = 0 THEN NULL ELSE c_custkey % 14 END AS INT) AS birth_m,
  CAST(CASE WHEN c_custkey % 11 = 0 OR c_custkey % 14 = 0 OR c_custkey % 33 = 0 THEN NULL ELSE c_custkey % 33 END AS INT) AS birth_d,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1900 + c_custkey * 13 % 90 + c_custkey * 17 % 130 - 3 END AS INT) AS death_y,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 + c_custkey % 12 END AS INT) AS death_m,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 + c_custkey % 28 END AS INT) AS death_d,
  CAST(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 1900 + c_custkey * 13 % 90 + c_custkey % 3 - 1 END AS INT) AS baptism_y,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1900 + c_custkey * 13 % 90 + c_custkey * 17 % 130 - 4 + c_custkey % 2 END AS INT) AS burial_y,
  {pick('c_custkey', OCCUPATION)} AS occupation, {pick('c_custkey * 3', NOTE)} AS note, {pick('c_custkey', ['', 'Urach'])} AS place,
  {pick('c_custkey', ['kopf', 'kind', ''])} AS role, CAST(c_nationkey AS BIGINT) AS article, CAST(c_custkey * 17 % 130 AS DOUBLE) AS text_age
FROM {{customer}}
UNION ALL
SELECT CAST(1000000 + s_suppkey AS BIGINT), {pick('s_suppkey * 5', GIVEN)}, {pick('s_suppkey * 2', SURNAME)}, {pick('s_suppkey', ['w', 'w', 'm'])},
  CAST(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1930 + s_suppkey * 7 % 60 END AS INT), CAST(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1 + s_suppkey % 12 END AS INT), CAST(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1 + s_suppkey % 28 END AS INT),
  CAST(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1990 + s_suppkey % 20 END AS INT), CAST(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1 + s_suppkey % 12 END AS INT), CAST(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1 + s_suppkey % 28 END AS INT),
  CAST(NULL AS INT), CAST(NULL AS INT), CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE {pick('s_suppkey', OCCUPATION)} END, '', '', '', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
FROM {{supplier}}
UNION ALL
SELECT CAST(10000000 + family_id * 10 + pos AS BIGINT), {pick('part', GIVEN)}, {pick('family_id', SURNAME)}, {pick('part', ['m', 'w'])},
  CAST(year(born) AS INT), CAST(month(born) AS INT), CAST(day(born) AS INT),
  CAST(CASE WHEN part % 4 = 0 THEN year(born) + part % 90 END AS INT), CAST(CASE WHEN part % 4 = 0 THEN month(born) END AS INT), CAST(CASE WHEN part % 4 = 0 THEN day(born) END AS INT),
  CAST(NULL AS INT), CAST(NULL AS INT), '', '', '', 'kind', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
FROM ({CHILD}) k
UNION ALL
SELECT CAST(2000000 + n_nationkey AS BIGINT), '', 'NN', 'u', CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT),
  CAST(NULL AS INT), CAST(NULL AS INT), '', '', '', '', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
FROM {{nation}}
"""

FAMILIES = f"""
SELECT CAST(o_orderkey AS BIGINT) AS family_id, CAST(CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS BIGINT) AS husband,
  CAST(CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 1000000 + w.supp END AS BIGINT) AS wife,
  CAST(CASE WHEN o_orderkey % 40 = 1 THEN NULL ELSE year(o_orderdate) END AS INT) AS wedding_y,
  CAST(CASE WHEN o_orderkey % 40 = 1 THEN NULL ELSE month(o_orderdate) END AS INT) AS wedding_m,
  CAST(CASE WHEN o_orderkey % 40 = 1 THEN NULL WHEN o_orderkey % 97 = 0 THEN 31 ELSE day(o_orderdate) END AS INT) AS wedding_d,
  CASE WHEN o_orderkey % 60 = 0 THEN 'vom Parser' ELSE '' END AS note
FROM {{orders}} LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM {{lineitem}} GROUP BY l_orderkey) w ON w.l_orderkey = o_orderkey
UNION ALL
SELECT CAST(20000000 + n_nationkey AS BIGINT), CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2000000 + n_nationkey END AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), ''
FROM {{nation}} WHERE n_nationkey % 3 < 2
UNION ALL
SELECT CAST(60000000 + family_id AS BIGINT), CAST(10000000 + family_id * 10 + pos AS BIGINT), CAST(NULL AS BIGINT), CAST(year(born) - family_id % 400 % 2 + CASE WHEN family_id % 400 = 5 THEN 0 ELSE 1 END AS INT), CAST(month(born) AS INT), CAST(day(born) AS INT), ''
FROM ({CHILD}) k WHERE family_id % 200 = 5 AND pos = 1
"""

#: Every 500th family also lists a child of another one, so that some children have two; every 700th lists its own husband; some lists name nobody.
CHILDREN = f"""
SELECT family_id, CAST(10000000 + family_id * 10 + pos AS BIGINT) AS child, CAST(pos AS INT) AS pos FROM ({CHILD}) k
UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(10000000 + (o_orderkey - 1) * 10 + 1 AS BIGINT), 90 FROM {{orders}} WHERE o_orderkey % 500 = 7
UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT), 91 FROM {{orders}} WHERE o_orderkey % 700 = 3
UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(o_custkey % 97 + 1 AS BIGINT), 92 FROM {{orders}} WHERE o_orderkey % 90 = 11
UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(1000000 + o_custkey % 10 + 1 AS BIGINT), 93 FROM {{orders}} WHERE o_orderkey % 90 = 12
UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(1000000 + w.supp AS BIGINT), 94 FROM {{orders}} JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM {{lineitem}} GROUP BY l_orderkey) w ON w.l_orderkey = o_orderkey WHERE o_orderkey % 110 = 13
UNION ALL SELECT CAST(40000000 + o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT), 1 FROM {{orders}} WHERE o_orderkey % 150 = 1
UNION ALL SELECT CAST(40000000 + o_orderkey AS BIGINT), CAST(1000000 + w.supp AS BIGINT), 2 FROM {{orders}} JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM {{lineitem}} GROUP BY l_orderkey) w ON w.l_orderkey = o_orderkey WHERE o_orderkey % 150 = 1
"""

#: Pairs known to be one person.
ALIAS = "SELECT CAST(c_custkey AS BIGINT) AS a, CAST(c_custkey + 1 AS BIGINT) AS b FROM {customer} WHERE c_custkey % 10 = 0"

#: Word lists, as rows.
REJECTED_GIVEN, CONFIRMED_GIVEN, REJECTED_SURNAME, PLACE_WORDS = ["Hans", "HansPeter"], ["Maria", "Anna"], ["Hag"], ["Winterbach", "Eberle", "Kriemann"]


def _date(prefix: str, parts: bool = True) -> Column:
    y = F.col(f"{prefix}_y")
    return F.when(y.isNotNull(), date_struct(y, F.col(f"{prefix}_m"), F.col(f"{prefix}_d")) if parts else date_struct(y))


_written: dict = {}


class Register(Model):
    """The register as the rules' model. Persons, families and children are written when they are first asked for, once in a session."""

    def __init__(self, key: tuple, views: dict[str, DataFrame], **small: DataFrame):
        self._key, self._views = key, views
        for name, df in small.items():
            setattr(self, name, df)

    def _table(self, name: str) -> DataFrame:
        if (*self._key, name) not in _written:
            _written[*self._key, name] = materialise(self._views[name], f"register-{name}")
        return _written[*self._key, name]

    p = property(lambda self: self._table("p"))
    f = property(lambda self: self._table("f"))
    fc = property(lambda self: self._table("fc"))


def register(spark: SparkSession, sf_dir: str) -> Register:
    """The register that is derived from the tables of ``sf_dir``."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "supplier", "lineitem", "orders", "nation")}

    def view(text: str) -> DataFrame:
        return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})

    words = lambda ws: reduce(DataFrame.union, [spark.range(1).select(F.lit(w).alias("word")) for w in ws])
    p, f = view(PERSONS), view(FAMILIES)
    p = p.select(
        "person_id", "given", "surname", "sex", _date("birth").alias("birth"), _date("death").alias("death"), _date("baptism", False).alias("baptism"),
        _date("burial", False).alias("burial"), "occupation", "note", "place", "role", "article", "text_age",
    )
    f = f.select("family_id", "husband", "wife", _date("wedding").alias("wedding"), "note")
    merged = p.where("birth.d IS NOT NULL").select("person_id", F.concat_ws(".", "birth.d", "birth.m", F.col("birth.y") - 200).alias("death_a"), F.concat_ws(".", F.col("birth.d") - F.col("person_id") % 2, "birth.m", F.col("birth.y") - 200).alias("death_b"))
    return Register(
        (spark.sparkContext.applicationId, sf_dir), {"p": p, "f": f, "fc": view(CHILDREN)}, alias=view(ALIAS), rejected_given=words(REJECTED_GIVEN), confirmed_given=words(CONFIRMED_GIVEN),
        rejected_surname=words(REJECTED_SURNAME), places=words(PLACE_WORDS), merged=merged,
    )


def duck(text: str) -> str:
    """A view's text over DuckDB's tables of the same names."""
    return text.format(customer="customer", supplier="supplier", lineitem="lineitem", orders="orders", nation="nation")
