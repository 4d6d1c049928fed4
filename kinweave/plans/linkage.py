"""Queries of the linkage operators and scalar functions over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import names as N
from ..functions.phonetic import koelner
from ..operators import graph
from ..operators import linkage as L
from ..operators import evaluate, families
from ..operators import verdicts as V
from ..sources import export
from ..sources.shared import materialise
from .frames import PERSONS, duck, register, table
from .village import people, village_mentions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def koelner_sql(names: str) -> str:
    """CTEs that end in ``keys(name, key)`` for a query of distinct names."""
    return f"""nm AS ({names}),
ks AS (SELECT name, regexp_replace(replace(replace(translate(lower(name), 'äöü', 'aou'), 'ß', 'ss'), 'ph', 'f'), '[^a-z]', '', 'g') AS s FROM nm),
kl AS (SELECT name, s, i, s[i] AS ch, CASE WHEN i > 1 THEN s[i - 1] ELSE '' END AS pv, substr(s, i + 1, 1) AS nx FROM ks, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i)),
kc AS (
  SELECT name, i, CASE
    WHEN ch IN ('a','e','i','j','o','u','y') THEN '0' WHEN ch = 'h' THEN '' WHEN ch IN ('b','p') THEN '1'
    WHEN ch IN ('d','t') THEN CASE WHEN nx IN ('c','s','z') THEN '8' ELSE '2' END
    WHEN ch IN ('f','v','w') THEN '3' WHEN ch IN ('g','k','q') THEN '4'
    WHEN ch = 'c' AND pv = '' THEN CASE WHEN nx = '' OR contains('ahkloqrux', nx) THEN '4' ELSE '8' END
    WHEN ch = 'c' THEN CASE WHEN pv IN ('s','z') THEN '8' WHEN nx = '' OR contains('ahkoqux', nx) THEN '4' ELSE '8' END
    WHEN ch = 'x' THEN CASE WHEN pv IN ('c','k','q') THEN '8' ELSE '48' END
    WHEN ch = 'l' THEN '5' WHEN ch IN ('m','n') THEN '6' WHEN ch = 'r' THEN '7' ELSE '8' END AS d
  FROM kl),
kr AS (SELECT name, string_agg(d, '' ORDER BY i) AS raw FROM kc GROUP BY name),
kx AS (SELECT name, unnest(range(1, length(raw) + 1)) AS i, raw FROM kr),
kf AS (SELECT name, string_agg(raw[i], '' ORDER BY i) AS f FROM kx WHERE i = 1 OR raw[i] <> raw[i - 1] GROUP BY name),
keys AS MATERIALIZED (SELECT nm.name, coalesce(f[1] || replace(substr(f, 2), '0', ''), '') AS key FROM nm LEFT JOIN kf USING (name))"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mentions: id, given, surname, year."""
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("given"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("surname"), c("p_size").alias("year"))


_PARTS = "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS given, split_part(p_name, ' ', 2) AS surname, p_size AS year FROM part"


@query(
    "WITH m AS (" + _PARTS + "), " + koelner_sql("SELECT DISTINCT surname AS name FROM m") + """,
k AS (SELECT m.*, key FROM m JOIN keys ON name = surname),
s AS (
  SELECT m.id, x.id AS cand, 100 + CASE WHEN m.surname = x.surname THEN 20 ELSE 0 END + CASE abs(m.year - x.year) WHEN 0 THEN 100 WHEN 1 THEN 50 ELSE 30 END AS points, abs(m.year - x.year) <= 1 AS anchor
  FROM k m JOIN k x ON m.key = x.key AND m.given = x.given AND x.id < m.id AND abs(m.year - x.year) <= 5),
r AS (SELECT *, row_number() OVER w AS nr, lead(points) OVER w AS nxt, count(*) OVER (PARTITION BY id) AS n FROM s WINDOW w AS (PARTITION BY id ORDER BY points DESC, cand)),
b AS (SELECT *, CASE WHEN points - nxt < 30 THEN 'unsicher' WHEN anchor AND (nxt IS NULL OR points - nxt >= 50) THEN 'sicher' ELSE 'wahrscheinlich' END AS stage FROM r WHERE nr = 1)
SELECT m.id AS p_partkey, coalesce(stage, 'neu') AS stufe, CASE WHEN stage IS NULL OR stage = 'unsicher' THEN 'neu' ELSE stage END AS final_stufe,
  CASE WHEN stage <> 'unsicher' THEN cand END AS best_key, points AS punkte, coalesce(n, 0) AS n_candidates
FROM m LEFT JOIN b USING (id)"""
)
def decide_top2_margin(spark, sf_dir):
    out = L.decide_by_name_and_year(parts(spark, sf_dir))
    return out.select(c("id").alias("p_partkey"), c("stage").alias("stufe"), c("final_stage").alias("final_stufe"), c("best_id").alias("best_key"), c("points").alias("punkte"), "n_candidates")


def tokens(spark, sf_dir) -> DataFrame:
    """Distinct words of all documents, in lower case."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"[^a-zäöüßéèêçñóí]+")).alias("name")).where("name <> ''").distinct()


_TOKENS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zäöüßéèêçñóí]+')) AS name FROM documents"


@query("WITH " + koelner_sql(_TOKENS) + " SELECT name, key FROM keys")
def koelner_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("name", koelner(c("name")).alias("key"))


def _canon_sql(names: str) -> str:
    table_ = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.VARIANTS.items()) + "}"
    e = "w"
    for pattern, put in ((r"^(.{3,}?)(ius|ii)$|^(.*..[^aeiouäöü])us$", r"\1\3"), ("sc([aou])", "\x01\\1"), ("c([aou])", r"k\1"), ("\x01", "sc"), ("ck", "k"), ("th", "t"), ("ph", "f"), ("y", "i"), ("ie", "i")):
        e = f"regexp_replace({e}, '{pattern}', '{put}', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyzäöüßéèêçñóí":
        e = f"replace({e}, '{letter}{letter}', '{letter}')"
    for pattern, put in (("dt$", "t"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ß", "ss"), ("([^aeiou])a$", r"\1e")):
        e = f"regexp_replace({e}, '{pattern}', '{put}', 'g')"
    return f"nm AS ({names}), v AS (SELECT name, coalesce({table_}[name], name) AS w FROM nm), canon AS (SELECT name, {e} AS canon FROM v)"


@query("WITH " + _canon_sql(_TOKENS) + " SELECT name, canon FROM canon")
def given_canon_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("name", N.given_canon(c("name")).alias("canon"))


def _name_words(spark, sf_dir) -> DataFrame:
    """Distinct words of part names and types, nations and market segments."""
    of = lambda t, col: table(spark, sf_dir, t).select(F.explode(F.split(F.lower(col), "[^a-z]+")).alias("name"))
    return of("part", "p_name").union(of("part", "p_type")).union(of("nation", "n_name")).union(of("customer", "c_mktsegment")).where("name <> ''").distinct()


_WORDS = " UNION ".join(f"SELECT unnest(regexp_extract_all(lower({col}), '[a-z]+')) AS name FROM {t}" for t, col in (("part", "p_name"), ("part", "p_type"), ("nation", "n_name"), ("customer", "c_mktsegment")))


def _word_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of distinct words that share a first letter."""
    w = _name_words(spark, sf_dir).withColumn("start", F.substring("name", 1, 1))
    return w.withColumnRenamed("name", "a").join(w.withColumnRenamed("name", "b"), "start").where("a < b").select("a", "b")


_PAIRS = "pr AS (SELECT x.name AS a, y.name AS b FROM nw x JOIN nw y ON x.name[1] = y.name[1] AND x.name < y.name)"
#: DuckDB's levenshtein counts bytes, so letters of two bytes are stood for by others.
_B = "translate(b, 'äöüßéèêçñóí', '0123456789@')"
_SIMILAR = "(lower(a) = lower(b) OR levenshtein(a, {b}) <= 1 OR (levenshtein(a, {b}) = 2 AND greatest(length(a), length(b)) >= 7 AND a[1:3] = b[1:3]))".replace("{b}", _B)


@query(f"WITH nw AS ({_WORDS}), {_PAIRS} SELECT a, b, levenshtein(a, b) AS distance FROM pr")
def levenshtein_pairs(spark, sf_dir):
    return _word_pairs(spark, sf_dir).select("a", "b", N.distance(c("a"), c("b")).alias("distance"))


@query(f"WITH nw AS ({_WORDS}), {_PAIRS}, " + koelner_sql("SELECT name FROM nw") + f" SELECT a, b, {_SIMILAR} AS close, {_SIMILAR} OR ka.key = kb.key AS similar FROM pr JOIN keys ka ON ka.name = a JOIN keys kb ON kb.name = b")
def names_similar_pairs(spark, sf_dir):
    return _word_pairs(spark, sf_dir).select("a", "b", N.close_spelling(c("a"), c("b")).alias("close"), N.names_similar(c("a"), c("b")).alias("similar"))


_ADULTS = f"ad AS (SELECT * FROM ({duck(PERSONS)}) WHERE person_id < 2000000)"
#: Canonical forms of the register's given names, by hand.
_GIVEN_CANON = (
    "CASE given WHEN 'Johann' THEN 'johan' WHEN 'Anna Maria' THEN 'ane maria' WHEN 'Catharina' THEN 'katarine' WHEN 'Johann Georg' THEN 'johan georg' WHEN 'Hans (Maria)' THEN 'johan maria' "
    "WHEN 'unbekannt' THEN 'unbekant' WHEN 'Jacob aus Winterbach' THEN 'jakob aus winterbach' WHEN 'HansPeter' THEN 'hanspeter' WHEN 'Georg 12.3.1750' THEN 'georg 1231750' WHEN 'Nicolaus' THEN 'nikolaus' "
    "WHEN 'Barbara (verw)' THEN 'barbare verw' ELSE '' END"
)


@query(f"""WITH {_ADULTS}, g AS (SELECT person_id, given, {_GIVEN_CANON} AS canon FROM ad),
p AS (SELECT DISTINCT x.given AS a, y.given AS b, x.canon AS ca, y.canon AS cb, string_split(x.canon, ' ') AS xs, string_split(y.canon, ' ') AS ys FROM orders JOIN g x ON x.person_id = o_custkey JOIN g y ON y.person_id = o_orderkey % 97 + 1 WHERE x.canon <> '' AND y.canon <> ''),
q AS (SELECT *, CASE WHEN len(xs) = 1 THEN xs[1] ELSE ys[1] END AS one, CASE WHEN len(xs) = 1 THEN ys ELSE xs END AS many FROM p)
SELECT a, b, (CASE WHEN ca = cb THEN 100 WHEN len(xs) = 1 OR len(ys) = 1 THEN
  CASE WHEN one = many[1] THEN CASE WHEN one IN ('johan', 'ane', 'maria') THEN 60 ELSE 90 END WHEN list_contains(many, one) THEN CASE WHEN one IN ('johan', 'ane', 'maria') THEN 40 ELSE 80 END ELSE 0 END
  WHEN len(list_filter(xs, lambda w: list_contains(ys, w))) >= 2 THEN 70 ELSE 0 END)::INT AS points, NOT list_has_any(xs, ys) AS contradiction FROM q""")
def given_points_pairs(spark, sf_dir):
    """The given names of each order's customer and of another one, each pair once."""
    g = register(spark, sf_dir).p.where("person_id < 1000000").select("person_id", "given")
    met = table(spark, sf_dir, "orders").select("o_custkey", (c("o_orderkey") % 97 + 1).alias("other"))
    met = met.join(g.select(c("person_id").alias("o_custkey"), c("given").alias("a")), "o_custkey").join(g.select(c("person_id").alias("other"), c("given").alias("b")), "other")
    pairs = met.select("a", "b").distinct().select("a", "b", N.given_canon(c("a")).alias("ca"), N.given_canon(c("b")).alias("cb")).where("ca <> '' AND cb <> ''")
    return pairs.select("a", "b", N.given_points(c("ca"), c("cb")).alias("points"), N.given_contradiction(c("ca"), c("cb")).alias("contradiction"))


# ---- dates and ages: each order's date written in one of six ways

_DATE_TEXTS = {
    0: "date_format(o_orderdate, 'yyyy-MM-dd')", 1: "date_format(o_orderdate, 'yyyy-MM')", 2: "date_format(o_orderdate, 'dd.MM.yyyy')", 3: "concat('um ', year(o_orderdate))",
    4: "concat(year(o_orderdate), '-93-04')", 5: "concat('vor ', year(o_orderdate) - 200, ' ungefaehr')",
}
_DUCK_DATE_TEXTS = {
    0: "strftime(o_orderdate, '%Y-%m-%d')", 1: "strftime(o_orderdate, '%Y-%m')", 2: "strftime(o_orderdate, '%d.%m.%Y')", 3: "'um ' || year(o_orderdate)",
    4: "year(o_orderdate) || '-93-04'", 5: "'vor ' || (year(o_orderdate) - 200) || ' ungefaehr'",
}


def _arms(texts: dict[int, str]) -> str:
    return "CASE CAST(o_orderkey % 6 AS INT) " + " ".join(f"WHEN {k} THEN {v}" for k, v in texts.items()) + " END"


def dated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.expr(_arms(_DATE_TEXTS)).alias("text"))


_DATED = f"d AS (SELECT o_orderkey, o_orderdate, o_orderkey % 6 AS kind, {_arms(_DUCK_DATE_TEXTS)} AS text FROM orders)"
_PARSED = """SELECT o_orderkey, (year(o_orderdate) - CASE WHEN kind = 5 THEN 200 ELSE 0 END)::INT AS y, CASE WHEN kind < 3 THEN month(o_orderdate)::INT END AS m, CASE WHEN kind IN (0, 2) THEN day(o_orderdate)::INT END AS d"""


@query(f"WITH {_DATED} {_PARSED}, CASE kind WHEN 3 THEN 'ABT' WHEN 5 THEN 'BEF' END AS prefix FROM d")
def partial_date_parse(spark, sf_dir):
    d = dated(spark, sf_dir).withColumn("date", D.partial_date(c("text")))
    return d.select("o_orderkey", "date.y", "date.m", "date.d", D.date_prefix(c("text")).alias("prefix"))


@query(f"""WITH {_DATED}, p AS ({_PARSED} FROM d)
SELECT o_orderkey, (make_date(y, coalesce(m, 6), coalesce(d, 15)) - DATE '0001-01-01')::BIGINT + 1 AS ordinal,
  strftime(make_date(y, coalesce(m, 6), coalesce(d, 15)) - (o_orderkey % 30000)::INT, '%Y-%m-%d') AS earlier FROM p""")
def ordinal_minus_days(spark, sf_dir):
    date = D.partial_date(c("text"))
    d = dated(spark, sf_dir).select("o_orderkey", date.alias("date")).withColumn("e", D.minus_days(c("date"), (c("o_orderkey") % 30000).cast("int")))
    return d.select("o_orderkey", D.ordinal(c("date")).cast("long").alias("ordinal"), F.format_string("%04d-%02d-%02d", "e.y", "e.m", "e.d").alias("earlier"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 80) * 365 + (o_orderkey % 12) * 30 + o_orderkey % 28 WHEN 1 THEN (o_orderkey % 50) * 7 WHEN 2 THEN 182
  WHEN 3 THEN o_orderkey % 90 WHEN 4 THEN (o_orderkey % 70) * 365 END::INT AS days FROM orders""")
def age_days_parse(spark, sf_dir):
    k = c("o_orderkey")
    text = (
        F.when(k % 6 == 0, F.format_string("%d J., %d M., %d T", k % 80, k % 12, k % 28)).when(k % 6 == 1, F.format_string("%d Wochen", k % 50)).when(k % 6 == 2, F.format_string("%d½ Jahre", k % 9))
        .when(k % 6 == 3, (k % 90).cast("string")).when(k % 6 == 4, F.format_string("%d jährig", k % 70)).otherwise("unbekannt")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", D.age_days(text).alias("days"))


@query(f"""WITH {_DATED}, p AS ({_PARSED} FROM d)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN '4.93.' || y WHEN 5 THEN y::VARCHAR WHEN 3 THEN y::VARCHAR ELSE concat_ws('.', CASE WHEN m IS NOT NULL THEN d END, m, y) END AS text, o_orderkey % 6 = 4 AS impossible FROM p""")
def rule_date_parse(spark, sf_dir):
    d = dated(spark, sf_dir).select("o_orderkey", D.rule_date(c("text")).alias("date"))
    return d.select("o_orderkey", D.date_text(c("date")).alias("text"), D.impossible(c("date")).alias("impossible"))


# ---- blocking

@query("WITH nw AS (" + _WORDS + "), dt AS (" + _TOKENS + " ), al AS (SELECT name FROM nw UNION SELECT name FROM dt), " + koelner_sql("SELECT name FROM al") + """
SELECT a.name AS a, count(*) AS n, min(b.name) AS first FROM nw a JOIN keys ka ON ka.name = a.name JOIN keys kb ON ka.key = kb.key AND ka.key <> '' JOIN dt b ON b.name = kb.name GROUP BY a.name""")
def block_phonetic_join(spark, sf_dir):
    return L.phonetic_pairs(_name_words(spark, sf_dir), tokens(spark, sf_dir)).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("first"))


_BUCKET = f"""nk AS MATERIALIZED (SELECT nw.name, key, nw.name[1:2] AS start FROM nw JOIN keys ON keys.name = nw.name WHERE length(nw.name) >= 5), dk AS MATERIALIZED (SELECT dt.name, key, dt.name[1:2] AS start FROM dt JOIN keys ON keys.name = dt.name WHERE length(dt.name) >= 5),
bp AS (SELECT a, b FROM (SELECT x.name AS a, y.name AS b, x.key AS ka, y.key AS kb FROM nk x JOIN dk y ON x.start = y.start AND abs(length(x.name) // 2 - length(y.name) // 2) <= 1) WHERE {_SIMILAR} OR ka = kb)"""


@query(f"WITH nw AS ({_WORDS}), dt AS ({_TOKENS}), " + koelner_sql("SELECT name FROM nw UNION SELECT name FROM dt") + f", {_BUCKET} SELECT a, b FROM bp")
def block_bucket_join(spark, sf_dir):
    return L.bucket_pairs(_name_words(spark, sf_dir), tokens(spark, sf_dir))


@query(f"WITH nw AS ({_WORDS}), dt AS ({_TOKENS}), " + koelner_sql("SELECT name FROM nw UNION SELECT name FROM dt") + f", {_BUCKET}, u AS (SELECT a, b FROM bp UNION SELECT x.name, y.name FROM nw x JOIN keys ka ON ka.name = x.name JOIN keys kb ON ka.key = kb.key AND ka.key <> '' JOIN dt y ON y.name = kb.name) SELECT a, count(*) AS n FROM u GROUP BY a")
def block_union_candidates(spark, sf_dir):
    return L.candidate_names(_name_words(spark, sf_dir), tokens(spark, sf_dir)).groupBy("a").agg(F.count("*").alias("n"))


# ---- scoring: an order is a burial entry, its customer and the next one are candidates

def scored(spark, sf_dir) -> DataFrame:
    m = register(spark, sf_dir)
    p = m.p.where("person_id < 1000000").select(c("person_id").alias("c_id"), N.given_canon(c("given")).alias("canon"), "surname", "sex", "birth", "death")
    o = table(spark, sf_dir, "orders")
    event = D.date_struct(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    entries = o.select(c("o_orderkey").alias("m_id"), event.alias("m_event"), F.explode(F.array(c("o_custkey"), c("o_custkey") + 1)).alias("c_id"), (c("o_custkey") - c("o_orderkey") % 2).alias("self"))
    own = p.select(c("c_id").alias("self"), c("canon").alias("m_given"), c("surname").alias("m_surname"), c("sex").alias("m_sex"), c("birth").alias("m_birth"), c("death").alias("m_death"))
    pairs = entries.join(own, "self").join(p, "c_id")
    none = F.lit(None).cast("string")
    return L.person_points(pairs.select(
        "m_id", "c_id", "m_event", "m_given", "m_surname", "m_sex", "m_birth", "m_death", F.lit(True).alias("m_adult"), (c("m_id") % 3 == 0).alias("m_burial"), c("canon").alias("c_given"), c("surname").alias("c_surname"),
        c("sex").alias("c_sex"), c("birth").alias("c_birth"), c("death").alias("c_death"), (c("birth.y") + 25).alias("c_adult"), c("death").alias("c_buried"),
        *[none.alias(x) for x in ("m_father", "c_father", "m_mother", "c_mother", "m_spouse", "c_spouse")],
    ))


_SCORED = f"""{_ADULTS}, p AS (SELECT *, {_GIVEN_CANON} AS canon FROM ad WHERE person_id < 1000000),
e AS (SELECT o_orderkey AS m_id, o_custkey + k AS c_id, o_custkey - o_orderkey % 2 AS self, year(o_orderdate) AS ey, o_orderdate::DATE AS ed FROM orders, (VALUES (0), (1)) t(k)),
q AS (SELECT m_id, p.person_id AS c_id, ey, ed, m_id % 3 = 0 AS burial, o.canon AS g, p.canon AS h, o.surname AS ms, p.surname AS cs, o.sex AS msex, p.sex AS csex, o.birth_y AS my, p.birth_y AS cy,
  o.birth_m AS mm, p.birth_m AS cm, o.birth_d AS md, p.birth_d AS cd, p.death_y AS dy, p.death_m AS dm, p.death_d AS dd, o.death_y AS oy, o.death_m AS om, o.death_d AS od, string_split(o.canon, ' ') AS xs, string_split(p.canon, ' ') AS ys
  FROM e JOIN p o ON o.person_id = self JOIN p ON p.person_id = c_id),
q2 AS (SELECT *, CASE WHEN len(xs) = 1 THEN xs[1] ELSE ys[1] END AS one, CASE WHEN len(xs) = 1 THEN ys ELSE xs END AS many, my IS NOT NULL AND mm IS NOT NULL AND md IS NOT NULL AND cy IS NOT NULL AND cm IS NOT NULL AND cd IS NOT NULL AS full2,
  coalesce(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', my, CASE WHEN mm BETWEEN 1 AND 12 THEN mm ELSE 6 END, coalesce(md, 15)) AS DATE), try_cast(format('{{:04d}}-{{:02d}}-01', my, CASE WHEN mm BETWEEN 1 AND 12 THEN mm ELSE 6 END) AS DATE)) AS mo,
  coalesce(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', cy, CASE WHEN cm BETWEEN 1 AND 12 THEN cm ELSE 6 END, coalesce(cd, 15)) AS DATE), try_cast(format('{{:04d}}-{{:02d}}-01', cy, CASE WHEN cm BETWEEN 1 AND 12 THEN cm ELSE 6 END) AS DATE)) AS co FROM q),
q3 AS (SELECT *, CASE WHEN g = '' OR h = '' THEN NULL WHEN g = h THEN 100 WHEN len(xs) = 1 OR len(ys) = 1 THEN CASE WHEN one = many[1] THEN CASE WHEN one IN ('johan', 'ane', 'maria') THEN 60 ELSE 90 END WHEN list_contains(many, one) THEN CASE WHEN one IN ('johan', 'ane', 'maria') THEN 40 ELSE 80 END ELSE 0 END
  WHEN len(list_filter(xs, lambda w: list_contains(ys, w))) >= 2 THEN 70 ELSE 0 END AS gp, abs(mo - co) AS days, full2 AND ((my = cy AND mm = cm AND md = cd) OR (ey - my < 2 AND abs(mo - co) <= 31)) AS sameday FROM q2),
s AS (SELECT *, CASE WHEN msex <> csex THEN 'sex' WHEN my > cy + 11 THEN 'born after adult' WHEN ey - cy < 14 THEN 'too young for the role'
  WHEN burial AND dy IS NOT NULL AND dm IS NOT NULL AND dd IS NOT NULL AND abs(ed - make_date(dy, dm, dd)) > 10 THEN 'already buried' WHEN h = '' THEN 'candidate without given name'
  WHEN (g <> '' AND h <> '' AND NOT list_has_any(xs, ys)) OR gp = 0 THEN 'given names differ' WHEN full2 AND ey - my < 2 AND days > 365 THEN 'infant born on another day'
  WHEN NOT coalesce(sameday, false) AND abs(my - cy) > 5 THEN 'born in other years' WHEN NOT burial AND ey > dy THEN 'already dead' WHEN ey - cy < 0 OR ey - cy > 100 THEN 'age' END AS rule FROM q3),
sc AS (SELECT *, CASE WHEN rule IS NULL THEN coalesce(gp, 0) + CASE WHEN ms = cs THEN 20 ELSE 0 END + CASE WHEN sameday THEN 100 WHEN my IS NULL OR cy IS NULL THEN 0 WHEN abs(my - cy) <= 1 THEN 50 ELSE 30 END
  + CASE WHEN oy IS NOT NULL AND om IS NOT NULL AND od IS NOT NULL AND oy = dy AND om = dm AND od = dd THEN 200 ELSE 0 END END AS points FROM s)"""


@query(f"WITH {_SCORED} SELECT m_id, c_id, points::INT AS points, rule AS excluded_by FROM sc")
def score_points(spark, sf_dir):
    return scored(spark, sf_dir).select("m_id", "c_id", "points", "excluded_by")


@query(f"WITH {_SCORED} SELECT rule, count(*) AS n, count(*) FILTER (gp > 0) AS n_given FROM sc WHERE rule IS NOT NULL GROUP BY rule")
def score_exclusion_counts(spark, sf_dir):
    return L.exclusion_counts(scored(spark, sf_dir))


@query("""WITH s AS (SELECT user_id AS m_id, event_id AS c_id, floor(value * 3)::INT AS points, event_type = 'purchase' AS anchor FROM events WHERE floor(value * 3)::INT >= 100),
r AS (SELECT *, row_number() OVER w AS nr, lead(points) OVER w AS nxt, count(*) OVER (PARTITION BY m_id) AS n FROM s WINDOW w AS (PARTITION BY m_id ORDER BY points DESC, c_id)),
a AS (SELECT m_id, string_agg(c_id || ':' || points, ' ' ORDER BY nr) AS alternatives FROM r WHERE nr BETWEEN 2 AND 4 GROUP BY m_id)
SELECT r.m_id AS user_id, CASE WHEN points - nxt < 30 THEN 'unsicher' WHEN anchor AND (nxt IS NULL OR points - nxt >= 50) THEN 'sicher' ELSE 'wahrscheinlich' END AS stage, points, n AS n_candidates, coalesce(alternatives, '') AS alternatives
FROM r LEFT JOIN a USING (m_id) WHERE nr = 1""")
def alternatives_top3(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(c("user_id").alias("m_id"), c("event_id").alias("c_id"), F.floor(c("value") * 3).cast("int").alias("points"), (c("event_type") == "purchase").alias("anchor"))
    out = L.decide(e)
    near = F.array_join(F.transform("alternatives", lambda x: F.concat_ws(":", x["id"], x["points"])), " ")
    return out.select(c("m_id").alias("user_id"), "stage", "points", "n_candidates", near.alias("alternatives"))


@query(f"""WITH {_ADULTS}, p AS (SELECT person_id, {_GIVEN_CANON} AS given, surname, birth_y, death_y FROM ad WHERE person_id < 1000000), """ + koelner_sql("SELECT DISTINCT surname AS name FROM p") + """,
k AS (SELECT p.*, key FROM p JOIN keys ON name = surname WHERE key <> '' AND given <> ''),
q AS (SELECT o_orderkey AS part_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS own, key, given, surname, (birth_y + 20 + o_orderkey % 30)::INT AS year FROM orders JOIN k ON person_id = o_custkey WHERE birth_y IS NOT NULL),
f AS (SELECT part_id, count(DISTINCT person_id) AS n, min(person_id) AS one FROM q JOIN k USING (key, given) WHERE abs(q.year - (k.birth_y + 30)) <= 15 AND coalesce(q.year - k.birth_y >= 14, true) AND coalesce(k.death_y >= q.year, true) AND (levenshtein(lower(q.surname), lower(k.surname)) <= 1 OR (levenshtein(lower(q.surname), lower(k.surname)) = 2 AND greatest(length(q.surname), length(k.surname)) >= 7 AND lower(q.surname)[1:3] = lower(k.surname)[1:3])) AND k.person_id <> q.own GROUP BY part_id)
SELECT part_id, CASE WHEN n = 1 THEN one END AS person_id, CASE WHEN n IS NULL THEN 'none fits' WHEN n > 1 THEN 'several fit' ELSE 'one fits' END AS reason FROM q LEFT JOIN f USING (part_id)""")
def participant_unique_match(spark, sf_dir):
    p = register(spark, sf_dir).p.where("person_id < 1000000").select("person_id", koelner(c("surname")).alias("key"), N.given_canon(c("given")).alias("given"), "surname", c("birth.y").alias("birth_y"), c("death.y").alias("death_y"))
    p = p.where("key <> '' AND given <> ''").withColumn("year", c("birth_y") + 30)
    o = table(spark, sf_dir, "orders").join(p.where("birth_y IS NOT NULL"), c("o_custkey") == c("person_id"))
    parts_ = o.select(c("o_orderkey").alias("part_id"), "key", "given", "surname", (c("birth_y") + 20 + (c("o_orderkey") % 30)).cast("int").alias("year"), c("o_orderkey").alias("entry"))
    return L.resolve_participants(parts_, p, table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("entry"), c("o_custkey").alias("person_id")))


@query("""WITH f AS (SELECT o_orderkey AS family_id, o_custkey AS husband, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END AS wife, o_orderstatus = 'F' AS wedded FROM orders)
SELECT family_id, CASE WHEN wife IS NULL THEN family_id ELSE first_value(family_id) OVER (PARTITION BY husband, wife ORDER BY wedded DESC, family_id) END AS kept_id FROM f""")
def family_merge_couples(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("family_id"), c("o_custkey").alias("husband"), F.when(c("o_orderkey") % 7 != 0, c("o_orderkey") % 5).alias("wife"), (c("o_orderstatus") == "F").alias("wedded"))
    return L.merge_couples(f)


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS ref, o_orderpriority AS surname FROM orders)
SELECT id, ref, CASE WHEN ref IS NULL THEN id ELSE min(id) OVER (PARTITION BY ref) END AS identity, ref IS NOT NULL AND min(surname) OVER (PARTITION BY ref) <> max(surname) OVER (PARTITION BY ref) AS contradiction FROM m""")
def ref_pinning(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return L.pin_references(o.select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 4 > 0, c("o_custkey")).alias("ref"), c("o_orderpriority").alias("surname")))


@query("""WITH l AS (SELECT source || '|' || doc_id AS key, doc_id AS identity, lang AS stage FROM documents),
d AS (SELECT l.key, CASE WHEN quality = 1 THEN 'gleich' ELSE 'neu' END AS kind, CASE WHEN doc_id % 9 = 0 THEN 'nowhere' ELSE 'src0|' || (doc_id - doc_id % 20) END AS target FROM labels JOIN documents USING (doc_id) JOIN l ON l.identity = doc_id)
SELECT l.key, CASE WHEN kind = 'gleich' AND t.key IS NOT NULL THEN t.identity WHEN kind = 'neu' THEN NULL ELSE l.identity END AS identity,
  CASE WHEN (kind = 'gleich' AND t.key IS NOT NULL) OR kind = 'neu' THEN 'entschieden' ELSE l.stage END AS stage, coalesce(kind = 'gleich' AND t.key IS NULL, false) AS pending
FROM l LEFT JOIN d ON d.key = l.key LEFT JOIN l t ON t.key = d.target""")
def decision_overlay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "doc_id").alias("key"), "lang")
    d = table(spark, sf_dir, "labels").join(docs, "doc_id")
    target = F.when(c("doc_id") % 9 == 0, "nowhere").otherwise(F.concat(F.lit("src0|"), (c("doc_id") - c("doc_id") % 20).cast("string")))
    return L.overlay_decisions(docs.select("key", c("doc_id").alias("identity"), c("lang").alias("stage")), d.select("key", F.when(c("quality") == 1, "gleich").otherwise("neu").alias("kind"), target.alias("target")))


@query("""SELECT 'orders|' || o_orderpriority || '|' || o_orderkey || '|' || l_linenumber AS key, count(*) AS n, min(l_partkey) AS first FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def stable_key_join(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    return j.groupBy(F.concat_ws("|", F.lit("orders"), "o_orderpriority", "o_orderkey", "l_linenumber").alias("key")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("first"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey - o_custkey % 7 - 1 AS b FROM orders WHERE o_orderkey % 5 > 1 AND o_custkey % 3 > 0),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS root FROM both_ UNION SELECT r.id, both_.b FROM r JOIN both_ ON both_.a = r.root),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT o_orderkey AS id, coalesce(root, o_orderkey) AS identity FROM orders LEFT JOIN m ON id = o_orderkey""")
def linkage_components(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    linked = o.where("o_orderkey % 5 > 1 AND o_custkey % 3 > 0").select(c("o_orderkey").alias("m_id"), (c("o_orderkey") - c("o_custkey") % 7 - 1).alias("best_id"))
    return L.link_set_based(linked, o.select(c("o_orderkey").alias("id")), graph.components)


#: Orders as mentions: each names the customer of the order before it of its day; its price tells how well that is known.
_EVIDENCE = """SELECT who, whom, CAST(points AS INT) AS points, CASE WHEN anchored THEN 'sicher' ELSE 'wahrscheinlich' END AS stage, CASE WHEN anchored THEN 'Vorname, Vater' ELSE 'Vorname' END AS reason FROM (
  SELECT CAST(o_custkey AS BIGINT) AS who, CAST(lag(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS BIGINT) AS whom, 100 + floor(o_totalprice / 20000) AS points, o_orderstatus = 'F' AS anchored, o_orderkey % 4 AS kept FROM {orders}) x
  WHERE whom IS NOT NULL AND who <> whom AND kept = 0"""


@query(f"""WITH RECURSIVE s AS MATERIALIZED ({_EVIDENCE.format(orders='orders')}),
b AS MATERIALIZED (SELECT a, b, max(CASE WHEN stage = 'sicher' THEN 4000 ELSE 2000 END + points) AS strength FROM (SELECT who AS a, whom AS b, stage, points FROM s UNION ALL SELECT whom, who, stage, points FROM s) GROUP BY a, b),
c AS (SELECT a AS id, a AS root FROM b UNION SELECT c.id, b.b FROM c JOIN b ON b.a = c.root),
m AS MATERIALIZED (SELECT c_custkey AS id, coalesce(min(root), c_custkey) AS identity FROM customer LEFT JOIN c ON c.id = c_custkey GROUP BY c_custkey),
w AS (SELECT id, 99999 AS strength FROM m WHERE id = identity UNION SELECT b.b, least(w.strength, b.strength) FROM w JOIN b ON b.a = w.id),
k AS (SELECT id, max(strength) AS strength FROM w GROUP BY id)
SELECT m.id, identity, CASE WHEN m.id = identity THEN 'neu' WHEN strength > 4000 THEN 'sicher' ELSE 'wahrscheinlich' END AS stage, CASE WHEN m.id = identity THEN 0 ELSE strength % 2000 END::INT AS points,
  CASE WHEN m.id = identity THEN '' WHEN strength > 4000 THEN 'Vorname, Vater' ELSE 'Vorname' END AS reason
FROM m JOIN k USING (id)""")
def linkage_stages(spark, sf_dir):
    """Customers tied by the orders of a day: identity, and stage, points and reason of the weakest link between each one and the first, on the strongest way there is."""
    s = spark.sql(_EVIDENCE, orders=table(spark, sf_dir, "orders"))
    ids = table(spark, sf_dir, "customer").select(c("c_custkey").cast("long").alias("id"))
    roots = graph.components(s.select(c("who").alias("a"), c("whom").alias("b")))
    links = materialise(ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("identity")), "links")
    edges = s.select("who", "whom", families._strength(c("stage"), c("points")).alias("strength"), "stage", "points", F.split("reason", ", ").alias("reasons"))
    decided = edges.select("who", "whom", "points", "reasons", F.lit(None).cast("int").alias("lead"), "stage", F.array().cast(families._ALTERNATIVES).alias("alternatives"))
    return families.evidence_of(ids, links, decided, edges).select("id", "identity", "stage", "points", "reason")


@query("""WITH s AS (SELECT o_orderkey AS who, o_custkey + d AS whom, 100 + (o_orderkey * 7 + d * 13) % 9 * 10 AS points, (o_orderkey + d) % 3 = 0 AS anchor FROM orders, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS d) WHERE (o_orderkey + d * d) % 4 > 0),
r AS (SELECT *, row_number() OVER w AS nr, lead(points) OVER w AS next FROM s WHERE points >= 120 WINDOW w AS (PARTITION BY who ORDER BY points DESC, whom)),
f AS (SELECT * FROM r WHERE nr = 1)
SELECT f.who, CASE WHEN coalesce(f.points - f.next < 30, false) THEN NULL ELSE f.whom END AS whom, f.points::INT AS points, (f.points - f.next)::INT AS lead,
  CASE WHEN coalesce(f.points - f.next < 30, false) THEN 'unsicher' WHEN f.anchor AND coalesce(f.points - f.next >= 50, true) THEN 'sicher' ELSE 'wahrscheinlich' END AS stage,
  coalesce((SELECT string_agg(whom || ':' || points, ' ' ORDER BY nr) FROM r WHERE r.who = f.who AND nr <= 4 AND (nr > 1 OR coalesce(f.points - f.next < 30, false))), '') AS alternatives
FROM f""")
def decide_with_evidence(spark, sf_dir):
    """Orders that choose among customers: the choice with its lead, stage and alternatives, or a tie with all that are tied."""
    k, d = c("o_orderkey"), c("d")
    s = table(spark, sf_dir, "orders").withColumn("d", F.explode(F.array(*map(F.lit, range(6))))).where((k + d * d) % 4 > 0)
    s = s.select(k.alias("who"), (c("o_custkey") + d).alias("whom"), (100 + (k * 7 + d * 13) % 9 * 10).cast("int").alias("points"), families.why(Vorname=F.lit(True), Vater=(k + d) % 3 == 0).alias("reasons"))
    told = F.array_join(F.transform("alternatives", lambda x: F.concat_ws(":", x["id"], x["points"])), " ")
    return families.settle(s, 120).select("who", "whom", "points", "lead", "stage", told.alias("alternatives"))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), e AS MATERIALIZED (
  SELECT c_custkey AS child, 1 + (c_custkey * 11 + 1) % n AS parent FROM customer, n WHERE c_custkey % 4 > 0 UNION SELECT c_custkey, 1 + (c_custkey * 37 + 5) % n FROM customer, n WHERE c_custkey % 3 > 0),
r AS (SELECT child, parent FROM e UNION SELECT r.child, e.parent FROM r JOIN e ON e.child = r.parent)
SELECT a.child AS id, min(a.parent) AS root FROM r a JOIN r b ON b.child = a.parent AND b.parent = a.child GROUP BY a.child""")
def strong_components(spark, sf_dir):
    """Customers who, by a descent reckoned from their numbers, are their own ancestors, with the smallest of their component."""
    k = table(spark, sf_dir, "customer").select(c("c_custkey").alias("child"))
    k = k.join(F.broadcast(k.agg(F.count("*").alias("n"))))
    of = lambda kept, factor, plus: k.where(c("child") % kept > 0).select("child", (1 + (c("child") * factor + plus) % c("n")).alias("parent"))
    return graph.strong_components(of(4, 11, 1).union(of(3, 37, 5)))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 2 UNION SELECT DISTINCT c_custkey, c_custkey // 5 + 1 FROM customer WHERE c_custkey > 10),
r AS (SELECT child, parent FROM e UNION SELECT r.child, e.parent FROM r JOIN e ON e.child = r.parent)
SELECT child AS person_id, count(*) AS n_ancestors, min(parent) AS first FROM r GROUP BY child""")
def ancestors_reach(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(c("c_custkey").alias("child"))
    edges = k.where("child > 2").select("child", F.expr("child div 3").alias("parent")).union(k.where("child > 10").select("child", F.expr("child div 5 + 1")))
    return graph.ancestors(edges).groupBy("person_id").agg(F.count("*").alias("n_ancestors"), F.min("ancestor").alias("first"))


#: Strength of the noise in the villages' registers.
NOISE = 0.3


def linked_villages(spark, sf_dir):
    """(mentions, links, families) of the villages that the customers' numbers make, with noise; linked once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _linked:
        m = village_mentions(table(spark, sf_dir, "customer").select((c("c_custkey") - 1).alias("n")), NOISE)
        links, found = families.link_families(m)
        _linked[key] = m, links, materialise(found, "families")
    return _linked[key]


_linked: dict = {}


@query()
def linkage_roundtrip(spark, sf_dir):
    """Precision and recall of linking all mentions of simulated registers with misspellings, homonyms and gaps, against the references they carry."""
    m, links, _ = linked_villages(spark, sf_dir)
    return evaluate.pairwise(m.where("ref IS NOT NULL").select("id", "ref").join(links, "id").select("ref", c("identity").alias("ident")))


@query()
def linkage_families(spark, sf_dir):
    """The families that linking finds: husband, wife, the wedding's year, and the number of children."""
    _, _, found = linked_villages(spark, sf_dir)
    return found.select("family", "husband", "wife", c("wedding.y").alias("wedding_y"), F.size("children").alias("n_children"))


@query()
def linkage_couples_found(spark, sf_dir):
    """The couples and children of the villages as they are, against those that linking finds; a person is known by the reference that most of their mentions bear."""
    m, links, found = linked_villages(spark, sf_dir)
    named = links.join(m.where("ref IS NOT NULL").select("id", "ref"), "id").groupBy("identity", "ref").agg(F.count("*").alias("n")).groupBy("identity").agg(F.max_by("ref", F.struct("n", "ref")).cast("long").alias("ref"))
    of = lambda who: named.select(c("identity").alias(who), c("ref").alias(f"{who}_ref"))
    _, true_families, true_children = people(table(spark, sf_dir, "customer").select((c("c_custkey") - 1).alias("n")))
    pairs = found.join(of("husband"), "husband").join(of("wife"), "wife")
    kids = pairs.select("husband_ref", "wife_ref", F.explode("children").alias("child")).join(of("child"), "child").select("husband_ref", "wife_ref", "child_ref")
    truth = true_families.select(c("husband").alias("husband_ref"), c("wife").alias("wife_ref"), "family_id")
    couples = evaluate.set_metrics(truth.select("husband_ref", "wife_ref"), pairs.where("wedded = 1").select("husband_ref", "wife_ref")).withColumn("kind", F.lit("couples"))
    children = evaluate.set_metrics(truth.join(true_children.select("family_id", c("child").alias("child_ref")), "family_id").select("husband_ref", "wife_ref", "child_ref"), kids).withColumn("kind", F.lit("children"))
    return couples.union(children).select("kind", "n_truth", "n_found", "n_both", "n_missing", "n_extra")


_VERDICT = "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'neu' WHEN 1 THEN '[' || o_custkey || ']' WHEN 2 THEN ' Offen ' WHEN 3 THEN 'zurück' WHEN 4 THEN '' || o_custkey WHEN 5 THEN 'quatsch' END"


@query(f"""WITH m AS (SELECT 'o' || o_orderkey AS key, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS ident FROM orders),
s AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE 'o' END || o_orderkey AS key, lower(trim(coalesce({_VERDICT}, ''))) AS said, o_custkey AS n, CASE WHEN o_orderkey % 7 = 1 THEN 'o' || (o_orderkey - o_orderkey % 3) END AS named FROM orders),
r AS (SELECT s.*, (SELECT count(*) FROM m WHERE m.key = s.key) > 0 AS here, CASE WHEN named IN (SELECT key FROM m) THEN named END AS hit FROM s),
f AS (SELECT r.key, min(m.key) AS other FROM r JOIN m ON m.ident = r.n AND m.key <> r.key WHERE said = n::VARCHAR OR said = '[' || n || ']' GROUP BY r.key),
t AS (SELECT r.*, coalesce(hit, other) AS target FROM r LEFT JOIN f USING (key)),
u AS (SELECT key, target, CASE WHEN said IN ('', 'offen', '?', '-') THEN 'uebergangen' WHEN NOT here THEN 'unknown mention' WHEN said = 'neu' THEN 'neu' WHEN said = 'zurück' THEN 'zurueck' WHEN target IS NULL THEN 'no such candidate' ELSE 'gleich' END AS status FROM t)
SELECT key, status, CASE WHEN status = 'gleich' THEN target END AS target FROM u""")
def verdict_import(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey")
    m = o.select(F.concat(F.lit("o"), k.cast("string")).alias("key"), F.when(k % 5 > 0, c("o_custkey")).alias("ident"))
    target = F.when(k % 7 == 1, F.concat(F.lit("o"), (k - k % 3).cast("string")))
    candidates = V.candidate_text(F.array(F.struct(c("o_custkey").alias("ident"), F.lit(100).alias("points"), F.lit("Vorname").alias("reason"), target.alias("key"))))
    sheet = o.select(F.concat(F.when(k % 11 == 0, "x").otherwise("o"), k.cast("string")).alias("key"), F.expr(_VERDICT).alias("verdict"), candidates.alias("candidates"))
    return V.read_verdicts(sheet, m)


@query("""WITH a AS (SELECT 'k' || o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'richtig' WHEN 'O' THEN 'falsch' ELSE 'offen' END AS answer, CASE WHEN o_orderkey % 2 = 0 THEN 'tod' ELSE 'taufe' END AS register, o_custkey AS ident FROM orders WHERE o_orderkey % 13 > 0),
f AS (SELECT o_custkey AS ident, min('k' || o_orderkey) AS target FROM orders WHERE o_custkey % 4 > 0 GROUP BY o_custkey)
SELECT key, 'gleich' AS kind, target FROM a JOIN f USING (ident) WHERE answer = 'richtig' UNION ALL SELECT key, 'neu', NULL FROM a WHERE answer = 'falsch' AND register = 'tod'""")
def sample_take_over(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey")
    key = F.concat(F.lit("k"), k.cast("string"))
    register_ = F.when(k % 2 == 0, "tod").otherwise("taufe")
    answers = o.select(k.alias("entry"), register_.alias("register"), c("o_custkey").alias("family"), F.when(c("o_orderstatus") == "F", "richtig").when(c("o_orderstatus") == "O", "falsch").otherwise("offen").alias("answer"), F.when(k % 2 == 0, "verstorbener").otherwise("vater").alias("role"), F.when(k % 13 > 0, key).alias("key"), c("o_custkey").alias("ident"))
    firsts = o.where("o_custkey % 4 > 0").groupBy(c("o_custkey").alias("ident")).agg(F.min(key).alias("key"))
    return V.take_over(answers, firsts)


_PAGE = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Taufe 1647/0' || o_custkey WHEN 1 THEN '  trauung ' || (1700 + o_custkey % 90) || ' / 00' || o_orderkey || 'a' WHEN 2 THEN 'Beerdigung 1750/' || o_custkey WHEN 3 THEN ' Seite   ' || o_custkey || '  unten ' ELSE 'Sterbefall 1801 /7' END"


@query(f"""WITH o AS (SELECT o_orderkey, {_PAGE} AS page FROM orders), m AS (SELECT *, regexp_extract(lower(page), '^\\s*(tauf|trau|heirat|ehe|begr|tod|sterb|beerd)\\w*\\s+(\\d{{4}})\\s*/\\s*0*(\\d+)', ['k', 'y', 'n']) AS p FROM o)
SELECT o_orderkey AS entry, CASE WHEN p.k = '' THEN regexp_replace(trim(page), '\\s+', ' ', 'g') ELSE CASE p.k WHEN 'tauf' THEN 'Tau' WHEN 'trau' THEN 'Tra' WHEN 'heirat' THEN 'Tra' WHEN 'ehe' THEN 'Tra' ELSE 'Beg' END || ' ' || p.y || '/' || p.n END AS citation FROM m""")
def citation_normal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("entry"), V.normal_citation(F.expr(_PAGE)).alias("citation"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 90 AS y, o_custkey % 13 AS m, '15.5.' || (1700 + o_custkey % 99) AS d FROM orders)
SELECT o_orderkey AS entry, CASE WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 2 THEN y::DOUBLE WHEN o_orderkey % 4 = 3 THEN NULL ELSE y + m / 12.0::DOUBLE + 10 / 365.0::DOUBLE END AS age FROM o""")
def age_from_death_text(spark, sf_dir):
    k, y, m = c("o_orderkey"), (c("o_custkey") % 90).cast("string"), (c("o_custkey") % 13).cast("string")
    date = F.concat(F.lit("15.5."), (1700 + c("o_custkey") % 99).cast("string"))
    told = F.when(k % 4 == 1, F.concat(F.lit("+ "), date, F.lit(" alt"))).when(k % 4 == 2, F.concat(F.lit("+ "), date, F.lit(" ("), y, F.lit(" Jahre)"))).when(k % 4 == 3, F.concat(F.lit("("), y, F.lit(" J)"))).otherwise(F.concat(F.lit("+ "), date, F.lit("  ( "), y, F.lit(" J "), m, F.lit(" M 10 T)")))
    return table(spark, sf_dir, "orders").select(k.alias("entry"), V.age_in_text(told, date).alias("age"))


@query("""WITH m AS (SELECT o_custkey AS identity, o_orderpriority AS register, CASE WHEN o_orderkey % 6 > 0 THEN year(o_orderdate) END AS year, o_orderkey AS id FROM orders)
SELECT identity, register, min_by(id, (year IS NULL, year, id)) AS id FROM m GROUP BY ALL""")
def earliest_by_register(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("identity"), c("o_orderpriority").alias("register"), F.when(c("o_orderkey") % 6 > 0, F.year("o_orderdate")).alias("year"), c("o_orderkey").alias("id"))
    return export.earliest_by_register(o).select("identity", "register", "id")


@query("""WITH h AS (SELECT l_linenumber AS col, 'Spalte ' || l_linenumber AS title, l_linenumber % 3 = 0 AS mapped FROM lineitem GROUP BY ALL),
k AS (SELECT l_orderkey AS entry, l_linenumber AS col, min(l_partkey) AS raw FROM lineitem GROUP BY ALL)
SELECT entry, string_agg(title || ': ' || raw, chr(10) ORDER BY col) AS note FROM k JOIN h USING (col) WHERE NOT mapped GROUP BY entry""")
def unmapped_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("entry"), c("l_linenumber").alias("col")).agg(F.min("l_partkey").cast("string").alias("raw")).withColumn("source", F.lit(1))
    headers = cells.select("source", "col").distinct().select("source", "col", F.concat(F.lit("Spalte "), c("col").cast("string")).alias("title"), (c("col") % 3 == 0).alias("mapped"))
    return export.unmapped_notes(cells, headers)
