"""Queries of ingest, schema matching, mentions and GEDCOM over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import date_text
from ..operators import ingest, matching, mentions
from ..sources import export, gedcom
from .frames import CHILDREN, FAMILIES, PERSONS, duck, register, table
from .linkage import linked_villages

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


_RAW = """CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '  ' || o_orderpriority || '   x ' WHEN 1 THEN CAST(o_custkey AS VARCHAR(20)) || '.0' WHEN 2 THEN 'k.A.' WHEN 3 THEN '' WHEN 4 THEN '1793-02-03 00:00:00' ELSE o_orderstatus END"""


@query(f"""WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, {_RAW} AS raw FROM orders)
SELECT o_orderkey, raw, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority || ' x' WHEN 1 THEN o_custkey::VARCHAR WHEN 4 THEN '1793-02-03' WHEN 5 THEN o_orderstatus END AS value FROM r""")
def ingest_clean_cells(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RAW).alias("raw"))
    return raw.withColumn("value", ingest.clean_cell(c("raw"), ["k.A.", "—"]))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
v AS (SELECT doc_id, f.field, trim(regexp_replace(w[f.i], '\\s+', ' ', 'g')) AS v, f.i FROM w, (VALUES ('vorname', 1), ('name', 2), ('vorname', 3)) f(field, i)),
l AS (SELECT doc_id, 'sprache' AS field, 'de' AS v, 9 AS i FROM documents WHERE lang = 'de')
SELECT doc_id AS entry, field, string_agg(v, ' | ' ORDER BY i) AS value FROM (SELECT * FROM v UNION ALL SELECT * FROM l) WHERE v <> '' AND v IS NOT NULL GROUP BY ALL""")
def ingest_unpivot_concat(spark, sf_dir):
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "documents").select(c("doc_id").alias("entry"), *[F.get(words, F.lit(i)).alias(f"c{i}") for i in range(3)], F.when(c("lang") == "de", "x").otherwise("nein").alias("tick"))
    mapping = [("vorname", ["c0"], None), ("name", ["c1"], None), ("vorname", ["c2"], None), ("sprache", ["tick"], "de")]
    return ingest.to_fields(rows, mapping).where("value IS NOT NULL").select("entry", "field", "value")


@query("""SELECT o_orderkey AS entry, CASE o_orderkey % 4 WHEN 0 THEN day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) WHEN 1 THEN month(o_orderdate) || '.' || year(o_orderdate) WHEN 2 THEN year(o_orderdate)::VARCHAR ELSE '?' END AS date FROM orders""")
def ingest_lead_date(spark, sf_dir):
    k = c("o_orderkey") % 4
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("entry"), F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unleserlich").alias("a"), F.when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).alias("b"), F.when(k == 2, F.date_format("o_orderdate", "yyyy")).alias("y"))
    return o.select("entry", date_text(ingest.lead_date([c("a"), c("b")], c("y"))).alias("date"))


@query("""WITH e AS (SELECT o_orderkey AS entry FROM orders), f AS (SELECT entry, CASE WHEN entry % 3 > 0 THEN 'sterbe_datum' END AS d, CASE WHEN entry % 5 = 0 THEN 'x' END AS x FROM e)
SELECT 'unbekannt_' || entry % 7 AS name, count(*) AS n FROM f GROUP BY ALL""")
def ingest_unknown_fields(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.explode(F.array(F.lit("sterbe_datum"), F.concat(F.lit("unbekannt_"), (c("o_orderkey") % 7).cast("string")))).alias("field"))
    unknown = ingest.unknown_fields(f, matching.catalogue(spark).select("name").distinct())
    return f.join(unknown, c("field") == c("name")).groupBy("name").agg(F.count("*").alias("n"))


#: Headings by hand, with the register, the carried role, and the field and points they must get.
HEADINGS = [
    ("taufe", "Taufdatum", None, "tauf_datum", 3.5), ("taufe", "Name", None, "kind_name", 3.3), ("taufe", "Vater", None, "vater", 4.0), ("taufe", "Beruf Vater", None, "vater_beruf", 4.0),
    ("ehe", "vn_vater_braeu", None, "braeutigam_vater_vorname", 4.0), ("ehe", "Braut Vorname", None, "braut_vorname", 4.0), ("ehe", "Datum", None, "trauung_datum", 3.5), ("ehe", "Vater Beruf", "braut", "braut_vater_beruf", 4.0),
    ("tod", "Alter", None, "verstorbener_alter", 3.3), ("tod", "Ehefrau", None, "verstorbener_ehepartner", 4.0), ("tod", "Krankheit", None, "todesursache", 3.5), ("tod", "Vorname_kb", None, "verstorbener_vorname_kb", 3.3),
]
_HEADS = ", ".join(f"({i}, '{r}', '{h}', {'NULL' if k is None else repr(k)}, '{f}', {p})" for i, (r, h, k, f, p) in enumerate(HEADINGS))


def _headings(spark, sf_dir):
    """Each conversation is a column; its number picks the heading."""
    rows = spark.createDataFrame([(i, r, h, k) for i, (r, h, k, _, _) in enumerate(HEADINGS)], "kind long, register string, heading string, context string")
    k = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return k.join(F.broadcast(rows), c("conv_id") % len(HEADINGS) == c("kind")).select(c("conv_id").alias("id"), "register", "heading", "context")


@query(f"""WITH h(kind, register, heading, context, field, points) AS (VALUES {_HEADS}), k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS id, heading, field, points::DOUBLE AS points FROM k JOIN h ON conv_id % {len(HEADINGS)} = kind""")
def match_heading_score(spark, sf_dir):
    return matching.guess_fields(_headings(spark, sf_dir), matching.catalogue(spark)).select("id", "heading", "field", "points")


@query("""WITH k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS sheet, CASE conv_id % 4 WHEN 0 THEN 'taufe' WHEN 1 THEN 'ehe' WHEN 2 THEN 'tod' END AS register FROM k""")
def match_register_detect(spark, sf_dir):
    k = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    n = c("conv_id") % 4
    heads = F.when(n == 0, F.array(F.lit("Tag"), F.lit("Pate"))).when(n == 1, F.array(F.lit("Braut"), F.lit("Ort"))).when(n == 2, F.array(F.lit("Sterbedatum"), F.lit("Alter"))).otherwise(F.array(F.lit("Spalte"), F.lit("Wert")))
    out = matching.detect_register(k.select(F.concat(F.lit("Blatt "), c("conv_id").cast("string")).alias("sheet"), F.lit("datei").alias("file"), heads.alias("headings")))
    return out.select(F.split_part("sheet", F.lit(" "), F.lit(2)).cast("long").alias("sheet"), "register")


@query("""WITH i AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM (SELECT conv_id, turn, CASE WHEN turn % 5 < 2 THEN 'paten' ELSE role END AS role FROM conversations))
SELECT conv_id AS sheet, role AS field, min(turn) AS first_pos, max(turn) AS last_pos, count(*) AS n FROM i GROUP BY conv_id, role, island""")
def match_run_folding(spark, sf_dir):
    cols = table(spark, sf_dir, "conversations").select(c("conv_id").alias("sheet"), c("turn").alias("pos"), F.when(c("turn") % 5 < 2, "paten").otherwise(c("role")).alias("field"))
    return matching.fold_runs(cols).select("sheet", "field", "first_pos", "last_pos", "n")


@query("""SELECT conv_id AS sheet, turn AS pos, last_value(CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'r' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM conversations""")
def match_carried_role(spark, sf_dir):
    main = F.when((c("role") == "user") & (c("turn") % 3 == 0), F.concat(F.lit("r"), c("turn").cast("string")))
    cols = table(spark, sf_dir, "conversations").select(c("conv_id").alias("sheet"), c("turn").alias("pos"), main.alias("main"))
    return matching.carried_role(cols).select("sheet", "pos", "context")


@query("""WITH v AS (SELECT unnest(string_split(text, ' ')) AS value FROM documents UNION ALL SELECT CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'k.A.' WHEN 1 THEN '—' WHEN 2 THEN 'NN' WHEN 3 THEN '?' ELSE '†' END FROM orders), t AS (SELECT trim(value) AS word FROM v)
SELECT word, count(*) AS n FROM t WHERE length(word) BETWEEN 1 AND 5 AND NOT regexp_matches(word, '^\\d+$') GROUP BY word
HAVING regexp_matches(word, '^[-—–?.\\[\\]()…/ ]+$') OR regexp_matches(word, '(?i)^k\\.?\\s?a\\.?$') OR (regexp_matches(word, '(?i)^n\\.?n?\\.?$') AND count(*) >= 2)""")
def match_blankwords(spark, sf_dir):
    k = c("o_orderkey") % 5
    own = table(spark, sf_dir, "orders").select(F.when(k == 0, "k.A.").when(k == 1, "—").when(k == 2, "NN").when(k == 3, "?").otherwise("†").alias("value"))
    return matching.blank_words(table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("value")).union(own))


@query("""WITH v AS (SELECT source AS col, doc_id AS row, CASE WHEN doc_id % 4 > 0 THEN lang || ' ' || doc_id % 6 END AS value FROM documents),
f AS (SELECT col, value, min(row) AS row, count(*) AS k FROM v WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY row, value) AS nr FROM f)
SELECT col, string_agg(value, ',' ORDER BY nr) FILTER (nr <= 3) AS samples, sum(k)::BIGINT AS filled FROM r GROUP BY col""")
def match_sample_profile(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").select(c("source").alias("col"), c("doc_id").alias("row"), F.when(c("doc_id") % 4 > 0, F.concat_ws(" ", "lang", c("doc_id") % 6)).alias("value"))
    return matching.sample_profile(cells).select("col", F.array_join("samples", ",").alias("samples"), "filled")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'unsicher' WHEN o_custkey % 4 = 3 THEN 'sicher' WHEN o_custkey % 4 = 2 THEN 'wahrscheinlich' ELSE 'unsicher' END AS confidence FROM orders""")
def match_confidence(spark, sf_dir):
    k = c("o_orderkey")
    samples = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 2 == 1, "alt").otherwise("1793"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), matching.confidence((c("o_custkey") % 4).cast("double"), F.when(k % 3 == 0, "datum").otherwise("text"), samples).alias("confidence"))


# ---- mentions: an order is a burial entry

_DEAD = ("Haag", "Eberle", "Müller", "Schmid")


def burials(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, _DEAD)), (k % 4 + 1).cast("int"))
    rows = o.select(
        k.alias("entry"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sterbe_datum"), name.alias("verstorbener_name"), F.when(k % 3 == 0, "Catharina (in)").otherwise("Hans ?").alias("verstorbener_vorname"),
        F.when(k % 2 == 0, F.concat((k % 70 + 1).cast("string"), F.lit(" J"))).otherwise(F.concat((k % 50).cast("string"), F.lit(" Wochen"))).alias("verstorbener_alter"),
        F.when(k % 5 == 0, F.concat(name, F.lit(", Jacob, weyl., Bauer"))).alias("verstorbener_vater"), F.when(k % 7 == 0, "NN").alias("verstorbener_ehepartner"),
    )
    return ingest.to_entries(ingest.to_fields(rows, [(x, [x], None) for x in rows.columns if x != "entry"]), "tod")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, (ARRAY['Haag', 'Eberle', 'Müller', 'Schmid'])[(o_orderkey % 4 + 1)::INT] AS name, (ARRAY['04', '0175', '657', '862'])[(o_orderkey % 4 + 1)::INT] AS key,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 70 + 1) * 365 ELSE o_orderkey % 50 * 7 END::INT AS age FROM orders)
SELECT k AS entry, 'verstorbener' AS path, name, CASE WHEN k % 3 = 0 THEN 'Catharina' ELSE 'Hans' END AS given, key AS name_key, CASE WHEN k % 3 = 0 THEN 'katarine' ELSE 'johan' END AS given_canon, CASE WHEN k % 3 = 0 THEN 'F' ELSE 'M' END AS sex,
  NULL AS occupation, false AS deceased, k % 3 > 0 AS uncertain, false AS unknown, age AS age_days, year(d - age)::INT AS birth_y, CASE WHEN age < 365 THEN day(d - age)::INT END AS birth_d, 'CAL' AS prefix FROM o
UNION ALL SELECT k, 'verstorbener_vater', name, 'Jacob', key, 'jakob', 'M', 'Bauer', true, false, false, NULL, NULL, NULL, NULL FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 'verstorbener_ehepartner', NULL, NULL, NULL, NULL, NULL, NULL, false, false, true, NULL, NULL, NULL, NULL FROM o WHERE k % 7 = 0""")
def mention_builder(spark, sf_dir):
    m = mentions.build_mentions(burials(spark, sf_dir))
    return m.select("entry", "path", "name", "given", "name_key", "given_canon", "sex", "occupation", "deceased", "uncertain", "unknown", "age_days", c("birth.y").alias("birth_y"), c("birth.d").alias("birth_d"), c("birth_prefix").alias("prefix"))


@query("""SELECT o_orderkey AS entry, unnest(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'Haag, Anna' END, 'Pate ' || o_orderkey % 9, CASE WHEN o_orderkey % 3 = 0 THEN 'Eberle, Hans' END], lambda x: x IS NOT NULL)) AS participant FROM orders""")
def split_participants(spark, sf_dir):
    k = c("o_orderkey")
    cell = F.concat_ws(" | ", F.when(k % 2 == 0, "Haag; Anna"), F.concat(F.lit("Pate "), (k % 9).cast("string")), F.when(k % 3 == 0, "Eberle; Hans"))
    return table(spark, sf_dir, "orders").select(k.alias("entry"), F.explode(mentions.split_participants(cell)).alias("participant"))


#: A burial sheet for each nation, whose customers are its rows: column, heading, cell, and by hand the field it must get, with its confidence where the cells fit.
_SHEET_COLUMNS = [
    (0, "lfd. Nr", "CAST(c_custkey % 1000 AS STRING)", "lfd_nr", "sicher"), (1, "lfd. Nr", "CAST(c_custkey + 1000 AS STRING)", "lfd_nr_gesamt", "sicher"),
    (2, "Sterbedatum", "CASE WHEN c_nationkey % 2 = 0 THEN concat('1', CAST(700 + c_custkey % 90 AS STRING), '-03-01') ELSE 'am Sonntag' END", "sterbe_datum", None),
    (3, "Verst. Name", "c_name", "verstorbener_name", "sicher"), (4, "Alter", "CASE WHEN c_custkey % 2 = 0 THEN concat(CAST(c_custkey % 80 AS STRING), ' J') END", "verstorbener_alter", "sicher"),
    (5, "Ehefrau", "CASE WHEN c_custkey % 5 = 0 THEN c_name END", "verstorbener_ehepartner", "sicher"), (6, "Zeuge 1", "c_mktsegment", "zeugen", "sicher"), (8, "Zeuge 3", "c_name", "zeugen", "sicher"),
    (9, "Quux", "c_name", None, None),
]
_SHEETS_SQL = " UNION ALL ".join(f"SELECT c_nationkey AS sheet, c_custkey AS r, {i} AS col, {v.replace('STRING', 'VARCHAR')} AS v, {repr(f) if f else 'NULL'} AS field, {repr(k) if k else 'NULL'} AS sure FROM customer" for i, _, v, f, k in _SHEET_COLUMNS)


@query(f"""WITH s AS ({_SHEETS_SQL}), f AS (SELECT sheet, col, v, min(r) AS r, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY sheet, col ORDER BY r, v) AS nr FROM f), p AS (SELECT sheet, col, string_agg(v, ' | ' ORDER BY nr) FILTER (nr <= 3) AS samples, sum(n)::BIGINT AS filled FROM g GROUP BY ALL),
k AS (SELECT DISTINCT sheet, col, field, sure FROM s WHERE col <> 8)
SELECT k.sheet::VARCHAR AS sheet, col AS first, CASE WHEN col = 6 THEN 8 ELSE col END AS last, field, CASE WHEN col = 2 THEN CASE WHEN k.sheet % 2 = 0 THEN 'sicher' ELSE 'unsicher' END ELSE sure END AS confidence, coalesce(samples, '') AS samples, coalesce(filled, 0) AS filled FROM k LEFT JOIN p USING (sheet, col)""")
def match_propose(spark, sf_dir):
    """What the columns of a burial sheet for each nation are taken for, all sheets at once."""
    rows = table(spark, sf_dir, "customer")
    cell = lambda row, i, value: F.struct(row.cast("int").alias("row"), F.lit(i).alias("col"), value.alias("value"))
    said = rows.select("c_nationkey", F.explode(F.array(*[cell(c("c_custkey") + 2, i, F.expr(v)) for i, _, v, _, _ in _SHEET_COLUMNS])).alias("x"))
    heads = rows.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array(*[cell(F.lit(1), i, F.lit(h)) for i, h, _, _, _ in _SHEET_COLUMNS])).alias("x"))
    cells = said.union(heads).select(F.lit("graeber.xlsx").alias("file"), c("c_nationkey").cast("string").alias("sheet"), "x.*").where("value IS NOT NULL")
    out = matching.propose(cells)
    return out.select("sheet", "first", "last", "field", "confidence", F.array_join("samples", " | ").alias("samples"), "filled")


# ---- GEDCOM

_P = f"p AS ({duck(PERSONS)})"
_DATE = "concat_ws(' ', CASE WHEN {x}_m BETWEEN 1 AND 12 THEN {x}_d END, ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'][{x}_m], {x}_y)"
_LINES = f"""{_P}, li AS (SELECT '@I' || person_id || '@' AS record, b AS block, s AS seq, lv AS level, t AS tag, v AS value FROM p, LATERAL (VALUES (0, 0, 0, 'INDI', NULL, true), (1, 0, 1, 'NAME', given || ' /' || surname || '/', true), (2, 0, 1, 'SEX', upper(sex), sex IN ('m', 'w')),
  (3, 0, 1, 'BIRT', NULL, birth_y IS NOT NULL), (3, 1, 2, 'DATE', {_DATE.format(x='birth')}, birth_y IS NOT NULL), (4, 0, 1, 'OCCU', occupation, occupation <> ''), (5, 0, 1, 'DEAT', NULL, death_y IS NOT NULL), (5, 1, 2, 'DATE', {_DATE.format(x='death')}, death_y IS NOT NULL)) x(b, s, lv, t, v, ok) WHERE ok)"""


@query(f"WITH {_LINES} SELECT record, block, seq, level, tag, value FROM li")
def gedcom_lines(spark, sf_dir):
    return gedcom.individual_lines(register(spark, sf_dir).p)


@query(f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY block, seq) - 1 AS line_no FROM li)
SELECT record, line_no::INT AS line_no, level, tag, CASE WHEN tag = 'NAME' THEN value ELSE nullif(value, '') END AS value, (CASE WHEN level = 1 THEN 0 WHEN level = 2 THEN line_no - 1 END)::INT AS parent_no FROM n""")
def gedcom_roundtrip(spark, sf_dir):
    texts = gedcom.record_texts(gedcom.individual_lines(register(spark, sf_dir).p))
    return gedcom.with_parents(gedcom.parse_records(texts)).select("record", "line_no", "level", "tag", "value", "parent_no")


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM p),
q AS (SELECT doc_id, i - 1 AS part, ls[i] AS line, CASE WHEN strlen(ls[i]) > 240 THEN (length(ls[i]) + 199) // 200 ELSE 1 END AS pieces FROM l),
r AS (SELECT doc_id, part, line, pieces, unnest(range(0, pieces)) AS piece FROM q)
SELECT doc_id AS id, part::INT AS part, piece::INT AS piece, CASE WHEN part = 0 AND piece = 0 THEN 1 ELSE 2 END AS level, CASE WHEN piece > 0 THEN 'CONC' WHEN part > 0 THEN 'CONT' ELSE 'NOTE' END AS tag,
  CASE WHEN pieces > 1 OR strlen(line) > 240 THEN substr(line, piece * 200 + 1, 200) ELSE line END AS value FROM r""")
def gedcom_wrap(spark, sf_dir):
    return gedcom.wrap(table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text"))


def _model(spark, sf_dir):
    """The derived register, written as records and read again."""
    m = register(spark, sf_dir)
    return gedcom.model_of(export.model_texts(m.p, m.f, m.fc))


_VALID = lambda x: f"{x}_y, CASE WHEN {x}_m BETWEEN 1 AND 12 THEN {x}_m END AS {x}_m, CASE WHEN {x}_m BETWEEN 1 AND 12 THEN {x}_d END AS {x}_d"
_parts = lambda x: [c(f"{x}.{part}").alias(f"{x}_{part}") for part in "ymd"]


@query(f"SELECT person_id, trim(given) AS given, trim(surname) AS surname, CASE WHEN sex IN ('m', 'w') THEN sex ELSE 'u' END AS sex, {_VALID('birth')}, {_VALID('death')}, baptism_y, burial_y, occupation, trim(note) AS note FROM ({duck(PERSONS)})")
def gedcom_model_persons(spark, sf_dir):
    p, _, _ = _model(spark, sf_dir)
    return p.select("person_id", "given", "surname", "sex", *_parts("birth"), *_parts("death"), c("baptism.y").alias("baptism_y"), c("burial.y").alias("burial_y"), "occupation", "note")


@query(f"SELECT family_id, husband, wife, {_VALID('wedding')}, note FROM ({duck(FAMILIES)})")
def gedcom_model_families(spark, sf_dir):
    _, f, _ = _model(spark, sf_dir)
    return f.select("family_id", "husband", "wife", *_parts("wedding"), "note")


@query(f"""WITH p AS MATERIALIZED ({duck(PERSONS)}), f AS MATERIALIZED ({duck(FAMILIES)}), fc AS MATERIALIZED ({duck(CHILDREN)}),
k AS (SELECT family_id, child, 0 AS own, pos AS place FROM fc SEMI JOIN f USING (family_id) UNION ALL SELECT DISTINCT family_id, child, 1, child FROM fc ANTI JOIN f USING (family_id) SEMI JOIN p ON person_id = child)
SELECT family_id, child, row_number() OVER (PARTITION BY family_id ORDER BY own, place, child)::INT AS pos FROM k""")
def gedcom_model_children(spark, sf_dir):
    return _model(spark, sf_dir)[2]


@query()
def gedcom_linked(spark, sf_dir):
    """The persons and families that linking finds in the villages, as GEDCOM records with the sources of their events."""
    m, links, found = linked_villages(spark, sf_dir)
    cited = m.withColumns({"source": F.when(c("register") == "taufe", 1).when(c("register") == "ehe", 2).otherwise(3).cast("long"), "page": F.concat(F.lit("Zeile "), c("entry").cast("string"))})
    titles = spark.range(1, 4).select(c("id").alias("source"), F.concat(F.lit("Register "), c("id").cast("string")).alias("title"))
    return export.record_texts(export.linked_records(cited, links, found, titles)).select("rank", "record", "text")


_CITED = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Zitat ' || o_orderkey WHEN 1 THEN concat_ws(', ', 'KB ' || o_orderpriority, 'S. ' || o_custkey, 'Nr. ' || o_orderkey) WHEN 2 THEN 'S. ' || o_custkey ELSE 'orders, Zeile ' || o_orderkey END"


@query(f"SELECT o_orderkey AS entry, {_CITED} AS page FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_CITED} IN (SELECT {_CITED} FROM orders WHERE o_orderkey % 10 <> 3))")
def citation_antijoin(spark, sf_dir):
    k = c("o_orderkey")
    e = table(spark, sf_dir, "orders").select(
        k.alias("entry"), F.when(k % 4 == 0, F.concat(F.lit("Zitat "), k.cast("string"))).alias("citation"), F.when(k % 4 == 1, F.concat(F.lit("KB "), "o_orderpriority")).alias("kb"),
        F.when((k % 4).isin(1, 2), c("o_custkey").cast("string")).alias("page"), F.when(k % 4 == 1, k.cast("string")).alias("number"), F.lit("orders").alias("source"), k.cast("string").alias("row"),
    )
    cited = e.select("entry", gedcom.citation().alias("page"))
    return gedcom.unreconciled(cited, cited.where("entry % 10 <> 3"))


@query("""WITH l AS (SELECT '@F' || o_orderkey || '@' AS record, 'HUSB' AS tag, '@I' || o_custkey || '@' AS value FROM orders)
SELECT record, tag, value FROM l WHERE value NOT IN (SELECT '@I' || c_custkey || '@' FROM customer WHERE c_custkey % 10 <> 1)""")
def dangling_pointers(spark, sf_dir):
    ref = lambda x, col: F.concat(F.lit(f"@{x}"), c(col).cast("string"), F.lit("@"))
    fam = table(spark, sf_dir, "orders").select(ref("F", "o_orderkey").alias("record"), F.explode(F.array(F.struct(F.lit(0).alias("level"), F.lit("FAM").alias("tag"), F.lit(None).cast("string").alias("value")), F.struct(F.lit(1).alias("level"), F.lit("HUSB").alias("tag"), ref("I", "o_custkey").alias("value")))).alias("x")).select("record", "x.*")
    ind = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 1").select(ref("I", "c_custkey").alias("record"), F.lit(0).alias("level"), F.lit("INDI").alias("tag"), F.lit(None).cast("string").alias("value"))
    return gedcom.dangling(fam.union(ind))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'CHIL' WHEN 1 THEN 'FATH' WHEN 2 THEN '(Braut: Vater)' ELSE '(Verstorbener)' END AS code FROM orders""")
def gedcom_role_codes(spark, sf_dir):
    k = c("o_orderkey") % 4
    path = F.when(k == 0, "kind").when(k == 1, "vater").when(k == 2, "braut_vater").otherwise("verstorbener")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), gedcom.role_code(path).alias("code"))
