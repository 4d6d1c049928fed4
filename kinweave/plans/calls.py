"""Queries that call the library's functions by their SQL names, against the SQL of the queries that use the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from .frames import register, table
from .linkage import ORACLE as _LINKAGE
from .linkage import _word_pairs, dated, tokens
from .registers import ORACLE as _REGISTERS
from .reports import ORACLE as _REPORTS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


def _ask(spark, text: str, **tables):
    sql.register(spark)
    return spark.sql(text, **tables)


@query(_LINKAGE["koelner_tokens"])
def sql_koelner(spark, sf_dir):
    return _ask(spark, "SELECT name, koelner(name) AS key FROM {t}", t=tokens(spark, sf_dir))


@query(_LINKAGE["given_canon_tokens"])
def sql_given_canon(spark, sf_dir):
    return _ask(spark, "SELECT name, given_canon(name) AS canon FROM {t}", t=tokens(spark, sf_dir))


@query(f"SELECT a, b, s.similar FROM ({_LINKAGE['names_similar_pairs']}) s")
def sql_names_similar(spark, sf_dir):
    return _ask(spark, "SELECT a, b, names_similar(a, b) AS similar FROM {t}", t=_word_pairs(spark, sf_dir))


@query(f"SELECT a, b, points FROM ({_LINKAGE['given_points_pairs']}) s")
def sql_given_points(spark, sf_dir):
    """The given names of each order's customer and of another one, each pair once."""
    g = register(spark, sf_dir).p.where("person_id < 1000000").select("person_id", "given")
    text = """WITH p AS (SELECT DISTINCT x.given AS a, y.given AS b FROM {o} JOIN {g} x ON x.person_id = o_custkey JOIN {g} y ON y.person_id = o_orderkey % 97 + 1)
    SELECT a, b, given_points(given_canon(a), given_canon(b)) AS points FROM p WHERE given_canon(a) <> '' AND given_canon(b) <> ''"""
    return _ask(spark, text, o=table(spark, sf_dir, "orders"), g=g)


@query(f"SELECT o_orderkey, y, m, d FROM ({_LINKAGE['partial_date_parse']}) s")
def sql_partial_date(spark, sf_dir):
    return _ask(spark, "SELECT o_orderkey, at.y, at.m, at.d FROM (SELECT o_orderkey, parse_partial_date(text) AS at FROM {t})", t=dated(spark, sf_dir))


@query("SELECT o_orderkey, (year(o_orderdate) % 90 * 365 + month(o_orderdate) * 30 + day(o_orderdate))::INT AS days FROM orders")
def sql_age_days(spark, sf_dir):
    text = "SELECT o_orderkey, parse_age_days(concat(year(o_orderdate) % 90, ' J ', month(o_orderdate), ' M, ', day(o_orderdate), ' Tage')) AS days FROM {t}"
    return _ask(spark, text, t=table(spark, sf_dir, "orders"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS name, split_part(p_name, ' ', 2) AS given, p_type AS occupation, p_partkey % 3 = 0 AS deceased FROM part")
def sql_parse_person(spark, sf_dir):
    text = """SELECT p_partkey, w.name, w.given, w.occupation, w.deceased FROM (
    SELECT p_partkey, parse_person(concat(split_part(p_name, ' ', 1), ', ', if(p_partkey % 3 = 0, 'weil. ', ''), split_part(p_name, ' ', 2), ', ', p_type)) AS w FROM {t})"""
    return _ask(spark, text, t=table(spark, sf_dir, "part"))


@query(_REGISTERS["split_participants"])
def sql_participants(spark, sf_dir):
    """A lateral join with the table function: a row for each godparent of a cell."""
    cells = """SELECT o_orderkey AS entry, concat_ws(' | ', if(o_orderkey % 2 = 0, 'Haag; Anna', NULL), concat('Pate ', o_orderkey % 9), if(o_orderkey % 3 = 0, 'Eberle; Hans', NULL)) AS cell FROM {t}"""
    return _ask(spark, f"SELECT entry, participant FROM ({cells}) e, LATERAL split_participants(e.cell)", t=table(spark, sf_dir, "orders"))


@query(_REPORTS["wilson_interval"])
def sql_wilson(spark, sf_dir):
    text = """SELECT source, n, k, round(wilson_low(k, n), 6) AS low, round(wilson_high(k, n), 6) AS high FROM (
    SELECT source, count(*) AS n, sum(toxic) AS k FROM {d} JOIN {l} USING (doc_id) GROUP BY source)"""
    return _ask(spark, text, d=table(spark, sf_dir, "documents"), l=table(spark, sf_dir, "labels"))


@query("SELECT l_partkey, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM lineitem GROUP BY l_partkey")
def sql_pair_count(spark, sf_dir):
    return _ask(spark, "SELECT l_partkey, pair_count(count(*)) AS pairs FROM {t} GROUP BY l_partkey", t=table(spark, sf_dir, "lineitem"))
