"""Queries that read a stored family book, whose tables are derived from the customers, into the rules' model, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import model
from .frames import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col

#: Three customers are an article, the first its head; every tenth is merged into the one before; others have an article of their own. The view lacks the columns beruf, notiz and ort.
_BOOK = """SELECT c_custkey AS id, c_custkey // 3 AS artikel_id, CASE WHEN c_custkey % 3 = 0 THEN 'kopf' ELSE 'kind' END AS rolle, c_name AS vn_kanonisch, c_mktsegment AS fn_kanonisch,
  CASE WHEN c_custkey % 4 < 2 THEN 'm' WHEN c_custkey % 4 = 2 THEN 'w' ELSE 'x' END AS geschlecht, (1700 + c_custkey % 90)::VARCHAR AS geburt_iso,
  CASE WHEN c_custkey % 5 > 0 THEN (1760 + c_custkey // 3 % 40) || '-0' || (1 + c_custkey // 3 % 9) || '-11' END AS tod_iso, CASE WHEN c_custkey % 3 > 0 THEN c_custkey // 2 END AS eigenes_artikel_id FROM customer"""
_PARTS = f"""book AS ({_BOOK}), kanon AS (SELECT c_custkey AS id, c_custkey - 1 AS kanon_id FROM customer WHERE c_custkey % 10 = 9),
artikel AS (SELECT DISTINCT c_custkey // 3 AS id, '+ ' || (1760 + c_custkey // 3 % 40) || '-0' || (1 + c_custkey // 3 % 9) || '-11 (' || (c_custkey // 3 % 90) || ' J 6 M)' AS roh_text FROM customer),
own AS (SELECT * FROM book WHERE id NOT IN (SELECT id FROM kanon))"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"WITH {_PARTS} {sql}"
        return f

    return add


def _model(spark, sf_dir):
    k = table(spark, sf_dir, "customer")
    article, n = F.expr("c_custkey div 3"), c("c_custkey")
    death = F.concat((article % 40 + 1760).cast("string"), F.lit("-0"), (article % 9 + 1).cast("string"), F.lit("-11"))
    book = k.select(
        n.alias("id"), article.alias("artikel_id"), F.when(n % 3 == 0, "kopf").otherwise("kind").alias("rolle"), c("c_name").alias("vn_kanonisch"), c("c_mktsegment").alias("fn_kanonisch"),
        F.when(n % 4 < 2, "m").when(n % 4 == 2, "w").otherwise("x").alias("geschlecht"), (n % 90 + 1700).cast("string").alias("geburt_iso"), F.when(n % 5 > 0, death).alias("tod_iso"), F.when(n % 3 > 0, F.expr("c_custkey div 2")).alias("eigenes_artikel_id"),
    )
    texts = k.select(article.alias("id"), F.concat(F.lit("+ "), death, F.lit(" ("), (article % 90).cast("string"), F.lit(" J 6 M)")).alias("roh_text")).distinct()
    o = table(spark, sf_dir, "orders")
    return model.from_tables({
        "ofb_individuum": book, "ofb_person_kanon": k.where(n % 10 == 9).select(n.alias("id"), (n - 1).alias("kanon_id")), "blank_artikel": texts,
        "ofb_familie": o.select(c("o_orderkey").alias("id"), c("o_custkey").alias("vater_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("heirat_iso")),
        "ofb_familie_kind": table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("familie_id"), c("l_partkey").alias("individuum_id"), F.when(c("l_linenumber") < 3, c("l_linenumber")).alias("geburtsreihe")).distinct(),
    })


@query("""SELECT o.id AS person_id, vn_kanonisch AS given, fn_kanonisch AS surname, CASE WHEN geschlecht = 'x' THEN 'u' ELSE geschlecht END AS sex, geburt_iso::INT AS birth_y, split_part(tod_iso, '-', 2)::INT AS death_m, rolle AS role,
'' AS note, CASE WHEN tod_iso IS NOT NULL THEN artikel_id % 90 + 0.5::DOUBLE END AS text_age FROM own o JOIN artikel a ON a.id = artikel_id""")
def stored_model_persons(spark, sf_dir):
    return _model(spark, sf_dir).p.select("person_id", "given", "surname", "sex", c("birth.y").alias("birth_y"), c("death.m").alias("death_m"), "role", "note", "text_age")


@query("SELECT a.id AS a, b.id AS b FROM own a JOIN own b ON b.artikel_id = a.eigenes_artikel_id AND b.rolle = 'kopf'")
def stored_model_aliases(spark, sf_dir):
    return _model(spark, sf_dir).alias


@query("SELECT kanon_id AS person_id, a.tod_iso AS death_a, b.tod_iso AS death_b FROM kanon k JOIN book a ON a.id = k.kanon_id JOIN book b ON b.id = k.id")
def stored_model_merged(spark, sf_dir):
    return _model(spark, sf_dir).merged


@query("""SELECT family_id, child, row_number() OVER (PARTITION BY family_id ORDER BY coalesce(nr, 9999), child, nr)::INT AS pos
FROM (SELECT DISTINCT l_orderkey AS family_id, l_partkey AS child, CASE WHEN l_linenumber < 3 THEN l_linenumber END AS nr FROM lineitem)""")
def stored_model_children(spark, sf_dir):
    return _model(spark, sf_dir).fc
