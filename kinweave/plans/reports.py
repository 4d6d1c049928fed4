"""Queries of evaluation and reports over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import markers
from ..functions.stats import wilson
from ..operators import evaluate as E
from ..operators import graph
from ..operators import reports as R
from ..sources.shared import materialise
from .frames import CHILD, table

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


_W = "z AS (SELECT 1.96::DOUBLE AS z)"


def _wilson(k: str, n: str) -> tuple[str, str]:
    mid, half, scale = f"({k}::DOUBLE / {n} + 1.96 * 1.96 / (2 * {n}))", f"1.96 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))", f"(1 + 1.96 * 1.96 / {n})"
    return f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE round(greatest(({mid} - {half}) / {scale}, 0), 6) END", f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE round(least(({mid} + {half}) / {scale}, 1), 6) END"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("ref"), c("l_suppkey").alias("ident"))


@query("""WITH c AS (SELECT l_partkey AS ref, l_suppkey AS ident, count(*) AS n FROM lineitem GROUP BY ALL),
h AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS hits FROM c), s AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS should FROM (SELECT sum(n) AS n FROM c GROUP BY ref)), f AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS found FROM (SELECT sum(n) AS n FROM c GROUP BY ident))
SELECT should, found, hits, round(hits::DOUBLE / found, 9) AS precision, round(hits::DOUBLE / should, 9) AS recall FROM h, s, f""")
def pairwise_precision_recall(spark, sf_dir):
    return E.pairwise(_links(spark, sf_dir)).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query("""SELECT 'mixed' AS kind, l_suppkey AS id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS members FROM lineitem WHERE l_partkey % 50 = 0 GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1
UNION ALL SELECT 'splintered', l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FROM lineitem WHERE l_partkey % 50 = 0 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""")
def mixed_splintered(spark, sf_dir):
    text = lambda x: c(x).cast("string").alias(x)
    links = _links(spark, sf_dir).where("ref % 50 = 0").select(text("ref"), text("ident"))
    return E.mixed_and_splintered(links).withColumn("id", c("id").cast("long"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS ref, l_suppkey AS ident FROM lineitem)
SELECT 'mixed' AS kind, ident AS id, ref AS member FROM p QUALIFY count(*) OVER (PARTITION BY ident) > 1 UNION ALL SELECT 'splintered', ref, ident FROM p QUALIFY count(*) OVER (PARTITION BY ref) > 1""")
def mixed_splintered_members(spark, sf_dir):
    return E.several_members(_links(spark, sf_dir))


@query("""WITH t AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 40 AS b FROM orders WHERE o_orderkey % 3 > 0), f AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 40 AS b FROM orders WHERE o_orderkey % 4 > 0),
j AS (SELECT t.a IS NOT NULL AS t, f.a IS NOT NULL AS f FROM t FULL JOIN f ON t.a = f.a AND t.b = f.b)
SELECT count(*) FILTER (t) AS n_truth, count(*) FILTER (f) AS n_found, count(*) FILTER (t AND f) AS n_both, count(*) FILTER (t AND NOT f) AS n_missing, count(*) FILTER (f AND NOT t) AS n_extra FROM j""")
def couple_set_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pairs = lambda w: o.where(w).select(c("o_custkey").alias("a"), (c("o_orderkey") % 40).alias("b"))
    return E.set_metrics(pairs("o_orderkey % 3 > 0"), pairs("o_orderkey % 4 > 0"))


@query("""SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def compare_by_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality")


@query("""WITH k AS (SELECT doc_id, lang || '/' || n_chars AS key FROM documents), a AS (SELECT * FROM k WHERE doc_id % 2 = 0 QUALIFY count(*) OVER (PARTITION BY key) = 1), b AS (SELECT * FROM k WHERE doc_id % 2 = 1 QUALIFY count(*) OVER (PARTITION BY key) = 1)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, key FROM a JOIN b USING (key)""")
def compare_unique_content_key(spark, sf_dir):
    k = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "n_chars").alias("key"))
    return E.couple_records(k.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id"), k.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id"), "key").select("left_id", "right_id", "key")


_LO, _HI = _wilson("k", "n")


@query(f"WITH a AS (SELECT lang AS stage, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT stage, n, k::BIGINT AS n_right, {_LO} AS low, {_HI} AS high FROM a")
def stage_accuracy(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(c("lang").alias("stage"), (c("quality") == 1).alias("right"))
    return E.stage_accuracy(j).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(f"WITH a AS (SELECT source, count(*) AS n, sum(toxic)::BIGINT AS k FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY source) SELECT source, n, k, {_LO} AS low, {_HI} AS high FROM a")
def wilson_interval(spark, sf_dir):
    a = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("k"))
    low, high = wilson(c("k"), c("n"))
    return a.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 5 END AS fa, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 3 END AS ma, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 5 + (o_orderkey % 7 = 0)::INT END AS fb, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey % 3 + (o_orderkey % 11 = 0)::INT END AS mb FROM orders),
s AS (SELECT CASE WHEN fa IS NULL AND fb IS NULL THEN 'none' WHEN fa IS NULL OR fb IS NULL THEN 'one' WHEN fa = fb THEN 'same' ELSE 'other' END AS f, CASE WHEN ma IS NULL AND mb IS NULL THEN 'none' WHEN ma IS NULL OR mb IS NULL THEN 'one' WHEN ma = mb THEN 'same' ELSE 'other' END AS m FROM r)
SELECT CASE WHEN f = 'same' AND m = 'same' THEN 'both same' WHEN f = 'none' AND m = 'none' THEN 'no parents' WHEN f = 'other' AND m = 'other' THEN 'both other' WHEN f = 'other' THEN 'other father' WHEN m = 'other' THEN 'other mother'
  WHEN f = 'same' OR m = 'same' THEN 'one same, one open' WHEN f = 'one' AND m = 'one' THEN 'parents in one only' ELSE 'open' END AS class, count(*) AS n FROM s GROUP BY ALL""")
def parent_agreement(spark, sf_dir):
    k, u = c("o_orderkey"), c("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        F.when(k % 3 > 0, u % 5).alias("father_a"), F.when(k % 4 > 0, u % 3).alias("mother_a"), F.when(k % 5 > 0, u % 5 + (k % 7 == 0).cast("int")).alias("father_b"), F.when(k % 6 > 0, u % 3 + (k % 11 == 0).cast("int")).alias("mother_b")
    )
    return E.agreement_classes(rows)


@query("""WITH s AS (SELECT o_orderkey AS family_id, CASE WHEN o_totalprice > 300000 THEN 'rich' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'done' END AS stratum FROM orders)
SELECT family_id, stratum FROM s WHERE stratum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('1-' || family_id), family_id) <= CASE stratum WHEN 'rich' THEN 20 WHEN 'urgent' THEN 30 ELSE 10 END""")
def sample_strata(spark, sf_dir):
    f = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "family_id")
    return E.sample_strata(f, [("rich", c("o_totalprice") > 300000, 20), ("urgent", F.startswith("o_orderpriority", F.lit("1")), 30), ("done", c("o_orderstatus") == "F", 10)])


@query("""SELECT 0::BIGINT AS n_shared, 0::BIGINT AS n_addable, 0::BIGINT AS n_short, count(*) > 0 AS any_families FROM orders""")
def sample_disjoint(spark, sf_dir):
    """Customers as families whose lines' parts are their entries: of the largest set without a common entry none share one, none can be added, and none that is drawn from it has less than two."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    entries = materialise(lines.select(c("o_custkey").alias("family_id"), F.struct("l_partkey", F.year("l_shipdate"), F.month("l_shipdate")).alias("entry")).distinct(), "entries")
    fit = entries.groupBy("family_id").agg(F.count("*").alias("n")).where("n >= 2").select("family_id")
    apart = graph.independent(entries.join(fit, "family_id", "left_semi").select(c("family_id").alias("id"), c("entry").alias("member")))
    drawn = materialise(E.sample_disjoint(fit, entries, [("even", c("family_id") % 2 == 0, 10), ("odd", c("family_id") % 2 == 1, 20)]), "drawn")
    taken = materialise(entries.join(apart.select(c("id").alias("family_id")), "family_id"), "taken")
    shared = taken.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
    free = fit.join(taken.select("family_id").distinct(), "family_id", "left_anti").join(entries.join(taken.select("entry").distinct(), "entry", "left_semi").select("family_id").distinct(), "family_id", "left_anti")
    short = drawn.join(entries.groupBy("family_id").agg(F.count("*").alias("n")), "family_id").where("n < 2")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(shared, "n_shared").join(one(free, "n_addable")).join(one(short, "n_short")).join(fit.agg((F.count("*") > 0).alias("any_families")))


@query("""WITH f AS (SELECT c_custkey AS family_id, c_custkey % 50 AS key, 1995 + c_custkey % 3 AS a, 1998 + c_custkey % 4 AS b FROM customer), e AS (SELECT o_orderkey AS entry_id, o_custkey % 50 AS key, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 7 = 0)
SELECT family_id, entry_id, row_number() OVER w AS nr FROM f JOIN e USING (key) WHERE y BETWEEN a AND b WINDOW w AS (PARTITION BY family_id ORDER BY abs(2 * y - a - b), entry_id) QUALIFY nr <= 4""".replace("QUALIFY nr <= 4", "QUALIFY row_number() OVER w <= 4"))
def sample_top4_candidates(spark, sf_dir):
    k = c("c_custkey")
    f = table(spark, sf_dir, "customer").select(k.alias("family_id"), (k % 50).alias("key"), (k % 3 + 1995).alias("from_year"), (k % 4 + 1998).alias("to_year"))
    e = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(c("o_orderkey").alias("entry_id"), (c("o_custkey") % 50).alias("key"), F.year("o_orderdate").alias("year"))
    return E.nearest_candidates(f, e)


@query("""WITH f AS (SELECT c_custkey AS family_id, c_custkey % 50 AS key, 1995 + c_custkey % 3 AS a, 1998 + c_custkey % 4 AS b FROM customer), e AS (SELECT o_orderkey AS entry_id, o_custkey % 50 AS key, year(o_orderdate) AS y FROM orders)
SELECT family_id, entry_id, row_number() OVER w AS nr FROM f JOIN e USING (key) WHERE y BETWEEN a AND b WINDOW w AS (PARTITION BY family_id ORDER BY abs(2 * y - a - b), entry_id) QUALIFY row_number() OVER w <= 4""")
def sample_top4_all_entries(spark, sf_dir):
    k = c("c_custkey")
    f = table(spark, sf_dir, "customer").select(k.alias("family_id"), (k % 50).alias("key"), (k % 3 + 1995).alias("from_year"), (k % 4 + 1998).alias("to_year"))
    return E.nearest_candidates(f, table(spark, sf_dir, "orders").select(c("o_orderkey").alias("entry_id"), (c("o_custkey") % 50).alias("key"), F.year("o_orderdate").alias("year")))


_LO2, _HI2 = _wilson("r", "(r + w)")


@query(f"""WITH v AS (SELECT source AS stratum, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'unklar' WHEN quality = 1 THEN 'richtig' ELSE 'falsch' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)),
a AS (SELECT stratum, count(*) AS n, count(*) FILTER (verdict = 'richtig') AS r, count(*) FILTER (verdict = 'falsch') AS w, count(*) FILTER (verdict = 'unklar') AS u FROM v GROUP BY stratum)
SELECT stratum, n, r AS n_right, w AS n_wrong, u AS n_unclear, n - r - w - u AS n_open, {_LO2} AS low, {_HI2} AS high FROM a""")
def sample_evaluation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    v = d.select(c("source").alias("stratum"), F.when(c("toxic") == 1, "unklar").when(c("quality") == 1, "richtig").when(c("quality") == 0, "falsch").alias("verdict"))
    return E.evaluate_sample(v).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("run"), c("event_type").alias("metric")).agg(F.count("*").alias("value"))


_RUNS = "r AS (SELECT strftime(ts, '%Y-%m-%d %H') AS run, event_type AS metric, count(*) AS value FROM events GROUP BY ALL)"


@query(f"WITH {_RUNS} SELECT *, lag(value) OVER w AS before, value - lag(value) OVER w AS delta FROM r WINDOW w AS (PARTITION BY metric ORDER BY run)")
def regression_delta(spark, sf_dir):
    return E.run_deltas(_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT run, coalesce(sum(value) FILTER (metric = 'click'), 0)::BIGINT AS click, coalesce(sum(value) FILTER (metric = 'purchase'), 0)::BIGINT AS purchase FROM r GROUP BY run")
def run_log_pivot(spark, sf_dir):
    return E.run_pivot(_runs(spark, sf_dir), ["click", "purchase"])


@query("""WITH n AS (SELECT source AS project, lang AS rule, count(*) FILTER (n_chars % 2 = 0) AS e, count(*) AS p FROM documents WHERE doc_id % 3 > 0 GROUP BY ALL), b AS (SELECT source AS project, lang AS rule, count(*) FILTER (n_chars % 2 = 0) AS e, count(*) AS p FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT project, rule, round(coalesce(n.e * 1000.0::DOUBLE / n.p, 0), 6) AS now, round(coalesce(b.e * 1000.0::DOUBLE / b.p, 0), 6) AS before, round(coalesce(n.e * 1000.0::DOUBLE / n.p, 0) - coalesce(b.e * 1000.0::DOUBLE / b.p, 0), 6) AS delta FROM n FULL JOIN b USING (project, rule)""")
def regression_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    per = lambda w: d.where(w).groupBy(c("source").alias("project"), c("lang").alias("rule")).agg(F.count_if(c("n_chars") % 2 == 0).alias("errors"), F.count("*").alias("persons"))
    out = E.regression(per("doc_id % 3 > 0"), per("doc_id % 3 = 0"))
    return out.withColumns({x: F.round(x, 6) for x in ("now", "before", "delta")})


# ---- reports

@query("SELECT o_orderpriority AS register, count(*) AS n, min(CASE WHEN o_orderkey % 9 > 0 THEN year(o_orderdate) END)::INT AS first_year, max(CASE WHEN o_orderkey % 9 > 0 THEN year(o_orderdate) END)::INT AS last_year, count(*) FILTER (o_orderkey % 9 = 0) AS undated FROM orders GROUP BY ALL")
def year_span(spark, sf_dir):
    return R.register_counts(table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("register"), F.when(c("o_orderkey") % 9 > 0, F.year("o_orderdate")).alias("year")))


@query("SELECT (SELECT count(*) FROM documents) AS n_mentions, (SELECT count(*) FROM orders) AS n_families, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_with_children, (SELECT count(*) FROM lineitem) AS n_children")
def run_statistics(spark, sf_dir):
    return R.run_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("family_id")))


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def histogram_children(spark, sf_dir):
    return R.histogram(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM events GROUP BY user_id) GROUP BY size")
def histogram_mentions(spark, sf_dir):
    return R.histogram(table(spark, sf_dir, "events"), "user_id")


@query("""WITH m AS (SELECT o_custkey AS identity, (ARRAY['kind', 'verstorbener', 'braut', 'vater', 'mutter', 'braeutigam'])[(o_orderkey % 6 + 1)::INT] AS role FROM orders), s AS (SELECT identity, list(DISTINCT role) AS r FROM m GROUP BY identity)
SELECT count(*) FILTER (list_contains(r, 'kind') AND list_contains(r, 'verstorbener')) AS born_and_buried, count(*) FILTER (list_has_any(r, ['braut', 'braeutigam']) AND list_has_any(r, ['vater', 'mutter'])) AS married_parents, count(*) AS n FROM s""")
def role_profile(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ("kind", "verstorbener", "braut", "vater", "mutter", "braeutigam"))), (c("o_orderkey") % 6 + 1).cast("int"))
    return R.role_profile(table(spark, sf_dir, "orders").select(c("o_custkey").alias("identity"), role.alias("role")))


@query("""WITH v AS (SELECT n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_mktsegment FROM customer) SELECT value, count(*) AS n FROM v GROUP BY value""")
def freq_places(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), c("n_nationkey") == c("c_nationkey"))
    return R.frequencies(rows, ["n_name", "c_mktsegment"])


@query("SELECT doc_id AS id, lang, source FROM documents WHERE contains(lower(text), 'tion ') ORDER BY doc_id LIMIT 50")
def search_mentions(spark, sf_dir):
    return R.search(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "TION ", ["text"], 50).select("id", "lang", "source")


@query("""WITH n AS (SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '7') UNION ALL SELECT 1000000 + s_suppkey FROM supplier WHERE contains(lower(s_name), '7')), f AS (SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS y FROM orders),
s AS (SELECT DISTINCT o_orderkey FROM f JOIN n ON n.id = o_custkey UNION SELECT l_orderkey FROM lineitem JOIN n ON n.id = 1000000 + l_suppkey JOIN f ON o_orderkey = l_orderkey)
SELECT o_orderkey AS family_id, y AS year FROM f SEMI JOIN s USING (o_orderkey) ORDER BY y, o_orderkey LIMIT 300""")
def search_families(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("family_id"), c("o_custkey").alias("husband"), F.lit(None).cast("long").alias("wife"), F.year("o_orderdate").alias("year"))
    p = table(spark, sf_dir, "customer").select(c("c_custkey").alias("person_id"), c("c_name").alias("name")).union(table(spark, sf_dir, "supplier").select(c("s_suppkey") + 1000000, "s_name"))
    kids = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("family_id"), (c("l_suppkey") + 1000000).alias("child"))
    return R.search_families(f, p, kids, "7").select("family_id", "year")


@query("""WITH l AS (SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN 'unsicher' WHEN 1 THEN 'neu' WHEN 2 THEN 'sicher' ELSE 'wahrscheinlich' END AS stage, o_orderkey % 3 AS alts, year(o_orderdate)::INT AS year FROM orders)
SELECT key, stage, year, quality AS decision FROM l LEFT JOIN labels ON doc_id = key WHERE stage = 'unsicher' OR (stage = 'neu' AND alts > 0)""")
def review_list(spark, sf_dir):
    k = c("o_orderkey")
    stage = F.when(k % 4 == 0, "unsicher").when(k % 4 == 1, "neu").when(k % 4 == 2, "sicher").otherwise("wahrscheinlich")
    links = table(spark, sf_dir, "orders").select(k.alias("key"), stage.alias("stage"), F.slice(F.array(F.lit(1), F.lit(2)), 1, (k % 3).cast("int")).alias("alternatives"), F.year("o_orderdate").alias("year"))
    return R.review_list(links, table(spark, sf_dir, "labels").select(c("doc_id").alias("key"), c("quality").alias("decision"))).select("key", "stage", "year", "decision")


@query(f"""WITH k AS ({CHILD.format(lineitem='lineitem')}), f AS (SELECT o_orderkey AS family_id, CASE WHEN o_orderkey % 4 > 0 THEN year(o_orderdate) END AS y FROM orders)
SELECT family_id, coalesce(y, (SELECT min(year(born)) FROM k WHERE k.family_id = f.family_id), 9999)::INT AS sort_year FROM f ORDER BY sort_year, family_id LIMIT 100""")
def family_list_topn(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("family_id"), F.when(c("o_orderkey") % 4 > 0, F.year("o_orderdate")).alias("year"))
    kids = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("family_id"), F.year("l_shipdate").alias("birth_y"))
    return R.family_list(f, kids, 100).select("family_id", "sort_year")


@query("SELECT CASE WHEN regexp_matches(upper(p_name[1]), '^[A-Z]$') THEN upper(p_name[1]) ELSE '_' END AS page, count(*) AS n FROM part GROUP BY ALL")
def initial_pages(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(R.initial(c("p_name")).alias("page")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN 'Haag ?' WHEN 1 THEN 'weyl. Eberle' ELSE 'Müller (W)' END AS part FROM orders)
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Haag' WHEN 1 THEN 'Eberle' ELSE 'Müller' END AS text, o_orderkey % 3 = 0 AS uncertain, o_orderkey % 3 = 1 AS deceased, o_orderkey % 3 = 2 AS widowed, count(*) AS n FROM o GROUP BY ALL""")
def marker_counts(spark, sf_dir):
    k = c("o_orderkey") % 3
    m = table(spark, sf_dir, "orders").select(markers(F.when(k == 0, "Haag ?").when(k == 1, "weyl. Eberle").otherwise("Müller (W)")).alias("m"))
    return m.groupBy("m.text", "m.uncertain", "m.deceased", "m.widowed").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, min(year(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::INT AS earliest FROM orders""")
def earliest_adult_year(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.min(F.year("o_orderdate")).over(w).alias("earliest"))


@query("""WITH d AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY first) AS occupations FROM d GROUP BY ALL""")
def ordered_occupations(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))), lambda s: s["o_orderpriority"])
    return d.groupBy("o_custkey").agg(F.array_join(ordered, "; ").alias("occupations"))
