"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import re

from .licences import PHRASES, TEMPLATES

ORACLE: dict[str, str] = {}

ORACLE["op1_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS points
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""

# Targets by closed form: sources in order of 2 * size / weight are capped as long as the share of
# what is left is above the cap. Seats: the highest quotients target / (2k - 1).
ORACLE["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, text, '')) AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS nr
  FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY size::DOUBLE / w, nr) AS rk,
         coalesce(sum(size) OVER (ORDER BY size::DOUBLE / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         coalesce(sum(w) OVER (ORDER BY size::DOUBLE / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wbelow,
         sum(size) OVER () AS total, sum(w) OVER () AS wtotal
  FROM w),
first_open AS (
  SELECT min(rk) AS rk FROM r
  WHERE (3 * total - 4 * below) * w <= 2 * size * 2 * (wtotal - wbelow)),
level AS (SELECT (3 * total - 4 * below)::BIGINT AS spare, (wtotal - wbelow)::BIGINT AS weight, r.rk FROM r JOIN first_open USING (rk)),
t AS (
  SELECT source, nr, size, CASE WHEN r.rk < level.rk THEN (2 * size)::DOUBLE ELSE (spare * w)::DOUBLE / (weight * 2)::DOUBLE END AS target
  FROM r, level),
b AS (SELECT greatest(1, least(64, floor(min(target) FILTER (WHERE target > 0) / 16)))::BIGINT AS block FROM t),
seats AS (
  SELECT nr, count(*) AS quota FROM (
    SELECT nr FROM t, b, LATERAL (SELECT unnest(range(1, (target / block)::BIGINT + 3)) AS k)
    ORDER BY target / (2 * k - 1)::DOUBLE DESC, nr
    LIMIT (SELECT round_even(sum(target) / any_value(block), 0)::BIGINT FROM t, b))
  GROUP BY nr),
p AS (
  SELECT d.doc_id, d.size, t.size AS source_size, target, coalesce(quota, 0) AS quota,
         block, (t.size + block - 1) // block AS blocks,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM b, d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN seats ON seats.nr = t.nr)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE least(quota // blocks * size
         + greatest(0, least(size, least(quota % blocks * block, source_size) - start)), 2 * size) END::BIGINT AS taken
FROM p
"""

# The posterior of a host by the same moments; registered domains and suffixes by the same labels.
ORACLE["op7_url_reputation"] = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         len(regexp_extract_all(coalesce(html, ''), '\*\*\*|###|\$\$\$|%%%|!!')) AS junk,
         len(regexp_extract_all(coalesce(html, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM pages),
o AS (
  SELECT *, CASE WHEN words > 0 THEN (regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)') OR junk * 10 > words)::INT END AS outcome,
         regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') AS bare
  FROM p),
h AS (
  SELECT host, count(outcome) AS n, coalesce(sum(outcome), 0) AS bad, any_value(bare) AS bare, string_split(any_value(bare), '.') AS l,
         regexp_matches(any_value(bare), '^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\[') AS address
  FROM o GROUP BY host),
hk AS (
  SELECT *, CASE WHEN length(l[-1]) = 2 AND len(l) > 2 AND l[-2] IN ('ac', 'co', 'com', 'ed', 'edu', 'go', 'gob', 'gouv', 'gov', 'gub', 'gv', 'ltd', 'me', 'mil', 'muni', 'ne', 'net', 'nhs', 'nic', 'nom', 'or', 'org', 'plc', 'police', 'sch')
         THEN 2 ELSE 1 END AS k
  FROM h),
h2 AS (SELECT host, n, bad, CASE WHEN address THEN bare ELSE array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN address THEN 'ip' ELSE array_to_string(l[-k:], '.') END AS suffix FROM hk),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
levels AS (SELECT 1 AS lv, n, bad FROM s WHERE n > 0 UNION ALL SELECT 2, n, bad FROM d WHERE n > 0 UNION ALL SELECT 3, n, bad FROM h2 WHERE n > 0),
m AS (SELECT lv, sum(bad) / sum(n) AS p, sum(n) AS n, count(*) AS c FROM levels GROUP BY lv),
v AS (
  SELECT lv, any_value(p) AS p, sum(l.n * pow(l.bad / l.n - p, 2)) / any_value(m.n) - any_value(p * (1 - p) * c / m.n) AS spread
  FROM levels l JOIN m USING (lv) GROUP BY lv),
k AS (SELECT lv, p, CASE WHEN spread > 0 THEN least(greatest(p * (1 - p) / spread - 1, 1.0), 1000.0) ELSE 1000.0 END AS k FROM v),
sr AS (SELECT suffix, (k * p + bad) / (k + n) AS r FROM s, k WHERE lv = 1),
dr AS (SELECT domain, (k * r + bad) / (k + n) AS r FROM d JOIN sr USING (suffix), k WHERE lv = 2),
ab AS (SELECT host, k * r + bad AS a, k * (1 - r) + n - bad AS b FROM h2 JOIN dr USING (domain), k WHERE lv = 3),
bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(greatest(a * b, 0) / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rules.verdict, length(rhost || rpath)) AS verdict
  FROM o JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM o JOIN bound USING (host) LEFT JOIN fit USING (page_id)
"""


def _template_regex(markup: str) -> str:
    """A template as a regular expression over words that a blank follows each."""
    out = []
    for token in re.split(r"(<<[^>]*>>)", markup):
        if token.startswith("<<begin"):
            out.append("(?:")
        elif token.startswith("<<end"):
            out.append(")?")
        elif token.startswith("<<var"):
            match = re.search(r'match="([^"]*)"', token)[1]
            out.append(r"(?:[^ ]+ )+" if match == ".+" else f"(?:{match}) ")
        else:
            out += [w + " " for w in re.findall(r"[a-z0-9]+", token.lower())]
    return "(?:^| )" + "".join(out)


def _places(phrase: str) -> str:
    words = phrase.split()
    at = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
    return f"list_filter(range(0, len(w)), lambda i: {at})"


_LABELS = ", ".join(f"CASE WHEN regexp_matches(joined, '{_template_regex(m)}') THEN '{label}' END" for label, m in TEMPLATES)
_BASE = ", ".join(f"CASE WHEN len({_places(p)}) > 0 THEN '{label}' END" for p, label in PHRASES)
_distinct = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"

ORACLE["op10_licence_templates"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, array_to_string(w, ' ') || ' ' AS joined, {' || '.join(_places(p) for p, _ in PHRASES)} AS places FROM d),
q AS (SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, [{_BASE}] AS base, [{_LABELS}] AS found FROM p)
SELECT doc_id, n_words, n_base, first_word, last_word, {_distinct.format('base')} AS base_labels, {_distinct.format('list_concat(base, found)')} AS labels,
       CASE WHEN len(list_filter(found, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM q
"""

ORACLE["op13_hard_negatives"] = r"""
WITH e AS MATERIALIZED (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

ORACLE["op12_ranked_search"] = r"""
WITH t AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents)
  GROUP BY doc_id, term),
d AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
a AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term), a),
s AS (
  SELECT q.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * d.n * a.docs) // a.total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN d USING (doc_id), a
  GROUP BY q.item_id, t.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10
"""
