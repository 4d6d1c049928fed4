"""Measuring links against a truth, comparing trees, sampling for review, and following runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import independent
from ..functions.stats import pair_count, ratio, wilson

c = F.col


def pairwise(links: DataFrame) -> DataFrame:
    """One row should, found, hits, precision, recall of ``links`` (ref, ident): pairs of mentions of one reference against pairs of one identity, by counting, without making pairs."""
    cells = links.groupBy("ref", "ident").agg(F.count("*").alias("n"))
    hits = cells.agg(F.coalesce(F.sum(pair_count(c("n"))), F.lit(0)).alias("hits"))
    side = lambda key, as_: cells.groupBy(key).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pair_count(c("n"))), F.lit(0)).alias(as_))
    row = hits.withColumn("one", F.lit(1)).join(side("ref", "should").withColumn("one", F.lit(1)), "one").join(side("ident", "found").withColumn("one", F.lit(1)), "one")
    return row.select("should", "found", "hits", ratio(c("hits"), c("found")).alias("precision"), ratio(c("hits"), c("should")).alias("recall"))


def mixed_and_splintered(links: DataFrame) -> DataFrame:
    """kind, id, members: identities of several references (mixed) and references in several identities (splintered), members sorted."""
    def several(key: str, of: str, kind: str) -> DataFrame:
        sets = links.groupBy(key).agg(F.array_sort(F.collect_set(of)).alias("m")).where(F.size("m") > 1)
        return sets.select(F.lit(kind).alias("kind"), c(key).alias("id"), F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))

    return several("ident", "ref", "mixed").union(several("ref", "ident", "splintered"))


def several_members(links: DataFrame) -> DataFrame:
    """kind, id, member: a row for each reference of an identity that has several (mixed), and for each identity of a reference that has several (splintered).

    Pairs are distinct and stay rows: no group meets in one task, however many members it has. A null member counts for nothing; a null key is a key.
    """
    pairs = links.select("ref", "ident").distinct()

    def several(key: str, of: str, kind: str) -> DataFrame:
        members = pairs.where(c(of).isNotNull())
        keys = members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(c(key).alias("id"))
        return members.join(keys, c(key).eqNullSafe(c("id"))).select(F.lit(kind).alias("kind"), "id", c(of).alias("member"))

    return several("ident", "ref", "mixed").union(several("ref", "ident", "splintered"))


def set_metrics(truth: DataFrame, found: DataFrame) -> DataFrame:
    """n_truth, n_found, n_both, n_missing, n_extra of two sets of rows, in one grouping."""
    both = truth.distinct().withColumns({"t": F.lit(1), "f": F.lit(0)}).union(found.distinct().withColumns({"t": F.lit(0), "f": F.lit(1)}))
    each = both.groupBy(*truth.columns).agg(F.max("t").alias("t"), F.max("f").alias("f"))
    n = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    return each.agg(n(c("t")).alias("n_truth"), n(c("f")).alias("n_found"), n(c("t") * c("f")).alias("n_both"), n(c("t") * (1 - c("f"))).alias("n_missing"), n(c("f") * (1 - c("t"))).alias("n_extra"))


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key no other row has."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n"), list(keys), "left_semi")


def couple_records(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of two registers joined on a content key, after taking away keys that are ambiguous on either side."""
    return unique_by(left, *keys).join(unique_by(right, *keys), list(keys))


def stage_accuracy(judged: DataFrame) -> DataFrame:
    """stage, n, n_right, low, high: accuracy of each stage with its Wilson interval; ``judged`` has stage, right (boolean)."""
    out = judged.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("right").alias("n_right"))
    low, high = wilson(c("n_right"), c("n"))
    return out.withColumns({"low": low, "high": high})


def agreement_classes(rows: DataFrame) -> DataFrame:
    """class, n: eight classes of how two sources agree on father and mother (father_a, mother_a, father_b, mother_b; null: none)."""
    def side(x: str):
        a, b = c(f"{x}_a"), c(f"{x}_b")
        return F.when(a.isNull() & b.isNull(), "none").when(a.isNull() | b.isNull(), "one").when(a == b, "same").otherwise("other")

    f, m = side("father"), side("mother")
    kind = (
        F.when((f == "same") & (m == "same"), "both same").when((f == "none") & (m == "none"), "no parents").when((f == "other") & (m == "other"), "both other")
        .when(f == "other", "other father").when(m == "other", "other mother").when((f == "same") | (m == "same"), "one same, one open")
        .when((f == "one") & (m == "one"), "parents in one only").otherwise("open")
    )
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def sample_strata(families: DataFrame, strata: list[tuple[str, object, int]], seed: int = 1) -> DataFrame:
    """(family_id, stratum): a family is in the first stratum whose condition it fulfils; of each stratum the asked number is drawn by seeded hash."""
    kind = F.lit(None).cast("string")
    for name, fits, _ in reversed(strata):
        kind = F.when(fits, name).otherwise(kind)
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}-"), c("family_id").cast("string")).cast("binary")), "family_id")
    most = F.create_map(*[F.lit(x) for name, _, n in strata for x in (name, n)])
    # The draw is over one hash for each family; the lowest hashes of each stratum win.
    drawn = families.select("family_id", kind.alias("stratum")).where("stratum IS NOT NULL").withColumn("nr", F.row_number().over(w))
    return drawn.where(c("nr") <= F.element_at(most, c("stratum"))).select("family_id", "stratum")


def sample_disjoint(families: DataFrame, entries: DataFrame, strata: list[tuple[str, object, int]], seed: int = 1, least: int = 2) -> DataFrame:
    """(family_id, stratum): a stratified draw, like :func:`sample_strata`, of families that share no entry with one another.

    ``entries`` has family_id and entry; families of fewer than ``least`` entries are left out, as nothing has been linked there. A largest set of families without a common entry is
    found first (:func:`kinweave.operators.graph.independent`), over all of them, and the strata draw from it: so that one stratum's draw never blocks another's.
    """
    of = entries.where("family_id IS NOT NULL AND entry IS NOT NULL").select("family_id", "entry").distinct()
    enough = of.groupBy("family_id").agg(F.count("*").alias("n")).where(c("n") >= least).select("family_id")
    fit = families.join(enough, "family_id", "left_semi")
    apart = independent(fit.select(c("family_id").alias("id")).join(of.select(c("family_id").alias("id"), c("entry").alias("member")), "id"), seed)
    return sample_strata(fit.join(apart.withColumnRenamed("id", "family_id"), "family_id", "left_semi"), strata, seed)


def first_of_year(entries: DataFrame, k: int) -> DataFrame:
    """The k entries (key, year, entry_id) of the smallest ids of each key and year."""
    w = Window.partitionBy("key", "year").orderBy("entry_id")
    return entries.withColumn("nr", F.row_number().over(w)).where(c("nr") <= k).drop("nr")


def nearest_candidates(families: DataFrame, entries: DataFrame, k: int = 4) -> DataFrame:
    """(family_id, entry_id, nr): for each family the k entries of its key that are nearest to the middle of its years, of those within them.

    Entries of one key and year are equally near, so only the first k of them can be among a family's: the others never meet it.
    """
    met = families.join(first_of_year(entries, k), "key").where(c("year").between(c("from_year"), c("to_year")))
    off = F.abs(c("year") * 2 - c("from_year") - c("to_year"))
    w = Window.partitionBy("family_id").orderBy(off, "entry_id")
    return met.withColumn("nr", F.row_number().over(w)).where(c("nr") <= k).select("family_id", "entry_id", "nr")


def evaluate_sample(verdicts: DataFrame) -> DataFrame:
    """stratum, n, n_right, n_wrong, n_unclear, n_open, low, high of verdicts (stratum, verdict: richtig, falsch, unklar, other); the interval is of right among right and wrong."""
    is_ = lambda v: F.count_if(F.coalesce(c("verdict") == v, F.lit(False)))
    out = verdicts.groupBy("stratum").agg(F.count("*").alias("n"), is_("richtig").alias("n_right"), is_("falsch").alias("n_wrong"), is_("unklar").alias("n_unclear"))
    low, high = wilson(c("n_right"), c("n_right") + c("n_wrong"))
    return out.withColumns({"n_open": c("n") - c("n_right") - c("n_wrong") - c("n_unclear"), "low": low, "high": high})


def run_deltas(runs: DataFrame) -> DataFrame:
    """run, metric, value, before, delta of ``runs`` (run, metric, value): each run against the one before it of the same metric."""
    w = Window.partitionBy("metric").orderBy("run")
    return runs.withColumn("before", F.lag("value").over(w)).withColumn("delta", c("value") - c("before"))


def run_pivot(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each run with a column for each metric; 0 where a run lacks it."""
    return runs.groupBy("run").pivot("metric", metrics).agg(F.sum("value")).fillna(0, metrics)


def regression(now: DataFrame, before: DataFrame) -> DataFrame:
    """project, rule, now, before, delta: errors per 1000 persons now and before, both frames with project, rule, errors, persons."""
    rate = lambda df, as_: df.select("project", "rule", (c("errors") * 1000.0 / c("persons")).alias(as_))
    return rate(now, "now").join(rate(before, "before"), ["project", "rule"], "full").fillna(0.0, ["now", "before"]).withColumn("delta", c("now") - c("before"))
