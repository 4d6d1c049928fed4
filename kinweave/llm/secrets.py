"""Secret scans: candidates by their shape, false positives removed by a random forest.

A candidate is a run of key characters with a digit in it, a value assigned to a password or token, or a
private key's block. A forest trained from labelled findings
judges its length, the changes between kinds of characters, how much of it the corpus' own words
cover, whether it stands in a path, and the words beside it. All that touches the texts is DataFrame
code; the forest learns from a bounded sample and is compiled into an expression.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, is_held_out, materialise, text_of
from .trees import forest_sql, random_forest

KEY = "A-Za-z0-9+/_-"
#: Characters of a candidate at least. A run is tried from its first character only, so that a long one costs no more than its length.
SHORTEST = 12
RUN = rf"(?<![{KEY}])(?=[{KEY}]{{{SHORTEST}}})[A-Za-z+/_-]*+[0-9][{KEY}]*+"
#: Names whose assigned values are candidates of whatever characters, and characters of such a value at least.
NAMES, SHORTEST_VALUE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey"), 4


def _assigned() -> str:
    """Values assigned to a name, whole if quoted, else up to white space or a quote."""
    kinds = []
    for quote, inside in (('"', r'[^"\x00-\x1F]'), ("'", r"[^'\x00-\x1F]"), ("", r"""[^"'\x00-\x20]""")):
        seps = [f"{left}[=:]{gap}{quote}" for left in ("", " ", "[\"']") for gap in ("", " ")]
        behind = "|".join(f"(?<=(?i:{name}){sep})" for name in NAMES for sep in seps)  # lookbehinds of one width each, for both engines
        kinds.append(f"(?:(?<=[=:]{quote})|(?<=[=:] {quote}))(?:{behind}){inside}{{{SHORTEST_VALUE},}}+")
    return "|".join(kinds)


_BODY = r"[A-Za-z0-9+/=:,\x20\x09-\x0D]*+"
#: A private key's block, or its first line alone if it is cut off.
BLOCK = rf"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY-----(?:{_BODY}(?:-(?!-){_BODY}){{0,20}}-----END [A-Z0-9 ]{{0,40}}PRIVATE KEY-----)?+"
#: A signed token of three parts, which is one candidate.
SIGNED = rf"(?<![{KEY}])eyJ[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]++){{1,2}}+"
CANDIDATE = f"{BLOCK}|{_assigned()}|{SIGNED}|{RUN}"
#: Characters kept of what stands before and after a candidate, of which three words are read.
BESIDE = 256
#: Documents that must have a word before it counts as one of the dictionary.
IN_DOCS = 3
#: Labelled findings to learn from at most; neighbouring words with a weight of their own; trees and their depth.
SAMPLE, NEIGHBOURS, TREES, DEPTH, SEED = 20_000, 200, 30, 6, 5

FEATURES = ("s_length", "s_changes", "s_kinds", "s_digits", "s_capitals", "s_distinct", "s_covered", "s_path", "s_assigned", "s_neighbours")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, candidate, before, after): every candidate of every whole text with what stands beside it.

    start counts characters from 0, stop is one past the last.
    """
    parts, found = F.split("text", CANDIDATE), F.col("found")
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    rows = rows.withColumn("parts", parts)
    each = F.transform(found, lambda c, i: F.struct(c.alias("candidate"), F.get("parts", i).alias("gap"), F.get("parts", i + 1).alias("next")))
    # Starts by running sums: what stands before a candidate is all gaps and candidates so far.
    starts = F.aggregate(
        each, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda s, c: F.struct((s["at"] + F.length(c["gap"]) + F.length(c["candidate"])).alias("at"), F.concat(s["starts"], F.array((s["at"] + F.length(c["gap"])).cast("long"))).alias("starts")),
    )["starts"]
    rows = rows.select("doc_id", F.explode(F.arrays_zip(F.transform(each, lambda c: F.struct(c["candidate"].alias("candidate"), F.right(c["gap"], F.lit(BESIDE)).alias("before"), F.left(c["next"], F.lit(BESIDE)).alias("after"))).alias("c"), starts.alias("start"))).alias("x"))
    return rows.select("doc_id", "x.start", (F.col("x.start") + F.length("x.c.candidate")).alias("stop"), "x.c.candidate", "x.c.before", "x.c.after")


def dictionary(docs: DataFrame, in_docs: int = IN_DOCS) -> DataFrame:
    """(word): words of three letters or more that ``in_docs`` documents have, in lower case."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_of()), "[^a-z]+"))).alias("word"))
    return words.where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= in_docs).select("word")


def neighbours() -> dict[str, Column]:
    """The two words before a candidate and the one after it, in lower case; empty if there is none."""
    return {
        "word1": F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1)),
        "word2": F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]+[A-Za-z]+[^A-Za-z]*$", 1)),
        "word3": F.lower(F.regexp_extract("after", r"^[^A-Za-z]*([A-Za-z]+)", 1)),
    }


def shape() -> dict[str, Column]:
    """The features that need nothing but the candidate and what stands beside it."""
    c = F.col("candidate")
    size = F.length(c).cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p))
    kinds = [F.regexp_like(c, F.lit(p)).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]")]
    return {
        "s_length": size,
        "s_changes": (count("[a-z]+|[A-Z]+|[0-9]+|[+/_-]+") - 1) / size,
        "s_kinds": sum(kinds[1:], kinds[0]).cast("double"),
        "s_digits": count("[0-9]") / size,
        "s_capitals": count("[A-Z]") / size,
        "s_distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "s_path": (F.regexp_like("before", F.lit(r"[/\\.]$")) | F.contains(c, F.lit("/")) | F.regexp_like("after", F.lit(r"^\.[a-z]{1,4}\b"))).cast("double"),
        "s_assigned": F.regexp_like("before", F.lit(r"[=:]\s*[\"']?$")).cast("double"),
    }


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` (with cand, a number for each row) and s_covered: the share of the candidate's characters in letter runs that are words."""
    runs = found.select("cand", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = runs.join(words, "word", "left_semi").groupBy("cand").agg(F.sum(F.length("word")).alias("letters"))
    return found.join(known, "cand", "left").withColumn("s_covered", F.coalesce("letters", F.lit(0)) / F.length("candidate")).drop("letters")


def neighbour_weights(rows: list, limit: int = NEIGHBOURS) -> dict[str, float]:
    """Log-odds of a secret for the neighbouring words of labelled findings, smoothed; the ``limit`` strongest."""
    good, bad = Counter(), Counter()
    for r in rows:
        (good if r["label"] else bad).update({r["word1"], r["word2"], r["word3"]} - {""})
    g, b = sum(bool(r["label"]) for r in rows) + 1, sum(not r["label"] for r in rows) + 1
    weights = {w: math.log((good[w] + 0.5) / g) - math.log((bad[w] + 0.5) / b) for w in good | bad if good[w] + bad[w] > 1}
    return dict(sorted(weights.items(), key=lambda x: (-abs(x[1]), x[0]))[:limit])


def _weight_of(weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return sum((F.coalesce(F.try_element_at(table, F.col(w)), F.lit(0.0)) for w in ("word1", "word2", "word3")), F.lit(0.0))


#: Published formats of keys.
FORMATS = (
    "(AKIA|ASIA)[0-9A-Z]{16}$", "gh[pousr]_[A-Za-z0-9]{20,}", "github_pat_[A-Za-z0-9_]{20,}", "[spr]k_(live|test)_[A-Za-z0-9]{10,}", "xox[abeprs]-[A-Za-z0-9-]{10,}", "glpat-[A-Za-z0-9_-]{16,}",
    "AIza[A-Za-z0-9_-]{35}$", "npm_[A-Za-z0-9]{36}$", "hf_[A-Za-z0-9]{30,}", "sk-[A-Za-z0-9_-]{20,}", "eyJ[A-Za-z0-9_-]{16,}", "-----BEGIN ",
)


def known_formats() -> Column:
    """The label of a finding: 1 for a published format or a value assigned to a name or borne as a token, 0 for numbers, dates, words and paths, null for all others."""
    like = lambda p, of="candidate": F.regexp_like(F.col(of), F.lit(p))
    key = like("^(" + "|".join(FORMATS) + ")")
    named = like(rf"(?i)({'|'.join(NAMES)}|api-key)[\"']?\s*[=:]\s*[\"']?$", "before") & ~like("^[A-Za-z]+[.,;:!?)]*$")
    bearer = like(r"(?i)\bbearer\s+$", "before") & like(rf"^[{KEY}]{{16,}}")
    part = "(([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,4})"
    words = F.regexp_like(F.left("candidate", F.lit(200)), F.lit(f"^{part}([+/_-]+{part})*[+/_-]*$"))
    path = like("^/|/$") | like(r"[/\\]$", "before") | like(r"^\.[a-z]{1,4}\b", "after")
    return F.when(key | named | bearer, 1).when(like("^[0-9+/_-]+$") | words | path, 0)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, start, stop, candidate, word1, word2, word3, features, held_out, score, is_secret), one row for each candidate.

    ``labelled`` has (doc_id, start, label) of findings that people have judged; without it, findings
    are labelled by published formats and clear non-secrets, and the rest is only judged. Findings in held-out documents are never learnt from. score is
    the forest's mean and is_secret is true from 0.5.

    Null texts have no candidates; nulls in ``labelled`` count for nothing. With no labelled findings
    of both kinds nothing is removed: all scores are 1. A null doc_id is scanned like any other,
    repeated rows give repeated findings; an empty table gives an empty result.
    """
    found = materialise(candidates(docs).withColumn("cand", F.monotonically_increasing_id()), "findings")
    rows = covered(found, dictionary(docs)).withColumns(neighbours() | shape()).withColumn("held_out", is_held_out())
    rows = materialise(rows, "features")
    if labelled is None:
        marked = rows.withColumn("label", known_formats())
    else:
        marked = rows.join(labelled.where("label IS NOT NULL").groupBy("doc_id", "start").agg(F.max("label").alias("label")), ["doc_id", "start"])
    own = [f for f in FEATURES if f != "s_neighbours"]
    seen = bounded(marked.where("NOT held_out AND label IS NOT NULL").select("doc_id", "start", "label", "word1", "word2", "word3", *own), F.struct("doc_id", "start"), sample)
    weights = neighbour_weights(seen)
    score = F.lit(1.0)
    if len({bool(r["label"]) for r in seen}) == 2:
        beside = [sum(weights.get(r[w], 0.0) for w in ("word1", "word2", "word3")) for r in seen]
        x = np.column_stack(([[r[f] for f in own] for r in seen], beside))
        forest = random_forest(x.astype(float), np.array([float(bool(r["label"])) for r in seen]), TREES, DEPTH, SEED)
        score = F.expr(forest_sql(forest, [*own, "s_neighbours"]))
    out = rows.withColumn("s_neighbours", _weight_of(weights)).withColumn("score", score)
    return out.select("doc_id", "start", "stop", "candidate", "word1", "word2", "word3", *FEATURES, "held_out", "score", (F.col("score") >= 0.5).alias("is_secret"))
