"""What lists and pages of a project ask: counts, histograms, frequencies, searches, review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def register_counts(entries: DataFrame) -> DataFrame:
    """register, n, first_year, last_year, undated of entries (register, year), in the register's order."""
    return entries.groupBy("register").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(c("year").isNull()).alias("undated")).orderBy("register")


def run_statistics(mentions: DataFrame, families: DataFrame, children: DataFrame) -> DataFrame:
    """One row n_mentions, n_families, n_with_children, n_children."""
    one = lambda df, **aggs: df.agg(*[a.alias(k) for k, a in aggs.items()]).withColumn("one", F.lit(1))
    out = one(mentions, n_mentions=F.count("*")).join(one(families, n_families=F.count("*")), "one").join(one(children, n_with_children=F.countDistinct("family_id"), n_children=F.count("*")), "one")
    return out.drop("one")


def histogram(rows: DataFrame, key: str) -> DataFrame:
    """size, n: how many values of ``key`` have so many rows."""
    return rows.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def role_profile(mentions: DataFrame) -> DataFrame:
    """One row: identities born and buried (kind and verstorbener), married and parents (braut or braeutigam, and vater or mutter), of mentions (identity, role)."""
    sets = mentions.groupBy("identity").agg(F.collect_set("role").alias("roles"))
    has = lambda *r: F.arrays_overlap("roles", F.array(*map(F.lit, r)))
    return sets.agg(F.count_if(has("kind") & has("verstorbener")).alias("born_and_buried"), F.count_if(has("braut", "braeutigam") & has("vater", "mutter")).alias("married_parents"), F.count("*").alias("n"))


def frequencies(rows: DataFrame, columns: list[str], k: int | None = None) -> DataFrame:
    """value, n of several columns put together, most frequent first; the k first if asked."""
    values = rows.select(F.explode(F.array(*[c(x).cast("string") for x in columns])).alias("value")).where("value IS NOT NULL AND value <> ''")
    out = values.groupBy("value").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "value")
    return out if k is None else out.limit(k)


def search(mentions: DataFrame, text: str, columns: list[str], k: int = 500) -> DataFrame:
    """Mentions of which one of the columns holds the text, whatever its case; the k first by id."""
    hit = F.lit(False)
    for x in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c(x), F.lit(""))), F.lit(text.lower()))
    return mentions.where(hit).orderBy("id").limit(k)


def search_families(families: DataFrame, persons: DataFrame, children: DataFrame, text: str, k: int = 300) -> DataFrame:
    """Families of which a partner or a child bears the text in its name; the k first by year (unknown last)."""
    named = persons.where(F.contains(F.lower("name"), F.lit(text.lower()))).select("person_id")
    by = lambda col: families.join(named, c(col) == c("person_id"), "left_semi").select("family_id")
    kids = children.join(named, c("child") == c("person_id"), "left_semi").select("family_id")
    found = by("husband").union(by("wife")).union(kids).distinct()
    return families.join(found, "family_id", "left_semi").orderBy(c("year").asc_nulls_last(), "family_id").limit(k)


def needs_review(stage: Column, alternatives: Column) -> Column:
    """A link to be looked at: unsicher, or new although others came near."""
    return (stage == "unsicher") | ((stage == "neu") & (F.size(alternatives) > 0))


def review_list(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Links to be looked at (key, stage, year, alternatives array) with their decision, undecided ones first, then by year and key."""
    kept = links.where(needs_review(c("stage"), c("alternatives"))).join(decisions, "key", "left")
    return kept.orderBy(c("decision").isNotNull(), c("year").asc_nulls_last(), "key")


def family_list(families: DataFrame, children: DataFrame, k: int) -> DataFrame:
    """The k first families by wedding year, else the first child's birth year, else last."""
    first = children.groupBy("family_id").agg(F.min("birth_y").alias("first_child"))
    return families.join(first, "family_id", "left").withColumn("sort_year", F.coalesce("year", "first_child", F.lit(9999))).orderBy("sort_year", "family_id").limit(k)


def initial(name: Column) -> Column:
    """The page on which a name is listed: its first letter without dots, else _."""
    first = F.translate(F.upper(F.substring(F.coalesce(name, F.lit("")), 1, 1)), "ÄÖÜ", "AOU")
    return F.when(F.regexp_like(first, F.lit("^[A-Z]$")), first).otherwise("_")
