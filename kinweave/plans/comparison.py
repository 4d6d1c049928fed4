"""Queries that hold two assignments of the same entries against each other, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison as C
from ..sources.shared import materialise
from .frames import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


#: Orders are entries: here they are their customer's, there those of a nation and segment in a year, so that both sides join and part; only orders with lines are known there.
_BOTH = """b AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Tau' ELSE 'Beg' END AS kind, kind || ' ' || year(o_orderdate) || '/' || o_orderkey AS key, o_custkey AS ident,
  '@' || c_nationkey || c_mktsegment || year(o_orderdate) || '@' AS ref, o_orderstatus AS stage, o_orderpriority AS reason
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def _both(spark, sf_dir):
    kind = F.when(c("o_orderkey") % 2 == 0, "Tau").otherwise("Beg")
    o = table(spark, sf_dir, "orders").withColumns({"kind": kind, "key": F.concat(kind, F.lit(" "), F.year("o_orderdate"), F.lit("/"), c("o_orderkey"))})
    own = o.select("key", "kind", c("o_custkey").alias("ident"), c("o_orderstatus").alias("stage"), c("o_orderpriority").alias("reason"), c("o_orderkey").cast("string").alias("text"))
    known = o.join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    keys = known.select("key", F.concat(F.lit("@"), "c_nationkey", "c_mktsegment", F.year("o_orderdate"), F.lit("@")).alias("ref"), "kind")
    return materialise(C.shared(own, keys), "shared-entries")


@query(f"""WITH {_BOTH}, n AS (SELECT count(*) AS entries FROM b),
s AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS x FROM (SELECT count(*) AS n FROM b GROUP BY ref)), f AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS x FROM (SELECT count(*) AS n FROM b GROUP BY ident)),
h AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS x FROM (SELECT count(*) AS n FROM b GROUP BY ident, ref))
SELECT entries, s.x::BIGINT AS should, f.x::BIGINT AS found, h.x::BIGINT AS hits, (f.x - h.x)::BIGINT AS extra, (s.x - h.x)::BIGINT AS missed, round(h.x / f.x, 9) AS precision, round(h.x / s.x, 9) AS recall FROM n, s, f, h""")
def compare_report(spark, sf_dir):
    return C.report(_both(spark, sf_dir)).withColumns({x: F.round(x, 9) for x in ("precision", "recall")})


def _apart(group: str, part: str, kind: str) -> str:
    return f"""SELECT '{kind}' AS art, key, CASE WHEN kind = 'Beg' THEN coalesce(h.baptism, h.low) ELSE coalesce(h.burial, h.low) END AS partner, x.pairs::BIGINT AS pairs
FROM b JOIN (SELECT * FROM {group}_parts WHERE nr > 1) x USING ({group}, {part}) JOIN (SELECT * FROM {group}_parts WHERE nr = 1) h USING ({group})"""


def _parts(group: str, part: str) -> str:
    return f"""{group}_parts AS (SELECT *, row_number() OVER w AS nr, sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pairs
FROM (SELECT {group}, {part}, count(*) AS n, min(key) AS low, min(key) FILTER (kind = 'Tau') AS baptism, min(key) FILTER (kind = 'Beg') AS burial FROM b GROUP BY {group}, {part})
WINDOW w AS (PARTITION BY {group} ORDER BY n DESC, low))"""


@query(f"""WITH {_BOTH}, {_parts('ident', 'ref')}, {_parts('ref', 'ident')}, d AS ({_apart('ident', 'ref', C.EXTRA)} UNION ALL {_apart('ref', 'ident', C.MISSED)}),
o AS (SELECT *, key[1:3] AS kind, partner[1:3] AS other FROM d),
r AS (SELECT *, CASE WHEN kind <> other THEN kind = 'Beg' ELSE (key < partner) = (kind = 'Beg') END AS lead FROM o),
z AS (SELECT art, CASE WHEN lead THEN key ELSE partner END AS burial, CASE WHEN lead THEN partner ELSE key END AS baptism, pairs FROM r)
SELECT art, burial, baptism, x.stage, x.reason, 'k' || x.ident AS own, x.ref AS ref_burial, y.ref AS ref_baptism, pairs FROM z JOIN b x ON x.key = burial JOIN b y ON y.key = baptism""")
def compare_deviations(spark, sf_dir):
    """A row for each entry that stands apart in either side's persons; its pairs sum up to those that the report misses or has too many."""
    both = _both(spark, sf_dir)
    own = both.select("ident").distinct().withColumn("who", F.concat(F.lit("k"), c("ident")))
    out = C.deviations(both, own, both.select("ref", c("ref").alias("who")).distinct())
    names = dict(zip(C.DEVIATIONS, ("art", "burial", "baptism", "text", "own", "stage", "reason", "ref_burial", "ref_baptism", "pairs"), strict=False))
    return out.withColumnsRenamed(names).select("art", "burial", "baptism", "stage", "reason", "own", "ref_burial", "ref_baptism", "pairs")


@query(f"""WITH {_BOTH}, f AS (SELECT ident, arg_min({{'ref': ref, 'stage': stage}}, key) FILTER (kind = 'Tau') AS t, arg_min({{'ref': ref, 'stage': stage}}, key) FILTER (kind = 'Beg') AS g FROM b GROUP BY ident)
SELECT g.stage AS stage, count(*) AS n, count(*) FILTER (g.ref = t.ref) AS n_right FROM f WHERE t IS NOT NULL AND g IS NOT NULL GROUP BY 1""")
def compare_stages(spark, sf_dir):
    return C.stages(_both(spark, sf_dir)).select("stage", "n", "n_right")
