"""Linkage: blocking, scoring, and deciding by margin.

A mention is a row of (id, given, surname, year, …). Candidates come from equi-joins on phonetic keys
and on buckets of neighbouring spellings; the runner-up decides how sure a link is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import full, ordinal
from ..functions.names import close_spelling, given_contradiction, given_points, marital_kind, names_similar
from ..functions.phonetic import koelner

#: Points, thresholds and margins.
EXACT_BIRTH, YEAR_BIRTH, NEAR_BIRTH = 100, 50, 30
FATHER, MOTHER, SPOUSE, DEATH_REFERENCE = 30, 50, 50, 200
EXACT_SURNAME, MARRIAGE_AGE = 20, 10
THRESHOLD, THRESHOLD_BURIAL, THRESHOLD_SPOUSE = 100, 80, 50
SURE, CLEAR, NEAR_YEARS = 50, 30, 5

c = F.col


def phonetic_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of the distinct names of two frames (name) that share a phonetic key. Names are taken once, however many rows bear them."""
    # A generator keeps the optimiser from writing the key out again in filters and in the join.
    keyed = lambda df, as_: df.select("name").distinct().select(c("name").alias(as_), F.explode(F.array(koelner(c("name")))).alias("key"))
    a, b = keyed(left, "a"), keyed(right, "b")
    return a.where("key <> ''").join(b, "key").select("a", "b")


def bucket_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct names of five letters or more that are similar and share the first two letters and, within one, half the length."""
    def names(df: DataFrame, as_: str, offsets: tuple[int, ...]) -> DataFrame:
        n = df.select("name").distinct().where(F.length("name") >= 5)
        half = F.floor(F.length("name") / 2)
        return n.select(c("name").alias(as_), F.lower(F.substring("name", 1, 2)).alias("start"), F.explode(F.array(*[half + o for o in offsets])).alias("half"))

    met = names(left, "a", (-1, 0, 1)).join(names(right, "b", (0,)), ["start", "half"])
    return met.where(names_similar(c("a"), c("b"))).select("a", "b")


def candidate_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that either block finds, once."""
    return phonetic_pairs(left, right).union(bucket_pairs(left, right)).distinct()


def birth_points(mention: Column, candidate: Column) -> Column:
    """100 for the very year, 50 for the next or last, 30 up to five years; null, that is excluded, beyond; 0 if either is unknown."""
    d = F.abs(mention - candidate)
    return F.when(d.isNull(), 0).when(d == 0, EXACT_BIRTH).when(d == 1, YEAR_BIRTH).when(d <= NEAR_YEARS, NEAR_BIRTH)


def person_points(pairs: DataFrame) -> DataFrame:
    """``pairs`` with points, and the rule that excludes the pair (null if none).

    Mention columns are led by m, candidate columns by c: given (canonical), surname, sex, birth and death
    (partial dates), event (the mention's date), adult (c: the earliest year as an adult), buried (c: partial
    date), father and mother surname, spouse given. Any may be null, which excludes nothing. The first rule that fits
    excludes; nothing excluded scores.

    Further columns may be there: m_low and m_high, the ages that the mention's role allows; m_wedding, of which an age of 18 to 32 speaks for the
    candidate; m_marital; m_age_days, by which an infant's reckoned birth may be off by a quarter; m_dead_allowed and m_father_role (a father may
    be dead for a year); m_parent_name with c_parent_name, which may not be unlike; m_other_parent and m_other_parent_name with c_partner and
    c_partner_name: who is married to the one named parent is the other, not the child.
    """
    differs = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    no = F.lit(False)
    may = lambda name, kind: F.coalesce(c(name), F.lit(None).cast(kind)) if name in pairs.columns else F.lit(None).cast(kind)
    my, cy = c("m_birth.y"), c("c_birth.y")
    age = c("m_event.y") - cy
    given = given_points(c("m_given"), c("c_given"))
    days = F.abs(ordinal(c("m_birth")) - ordinal(c("c_birth")))
    both_days = full(c("m_birth")) & full(c("c_birth"))
    age_days = may("m_age_days", "int")
    infant = both_days & F.coalesce(age_days < 730, c("m_event.y") - my < 2)
    band = F.when(age_days.isNotNull(), F.greatest(F.lit(31), F.floor(age_days / 4))).otherwise(31)
    born_then = F.coalesce(both_days & ((c("m_birth") == c("c_birth")) | (infant & (days <= band))), no)
    years = F.abs(my - cy)
    dead_before = ~F.coalesce(c("m_burial"), no) & (c("m_event.y") > c("c_death.y")) & ~F.coalesce(may("m_dead_allowed", "boolean"), no)
    posthumous = F.coalesce(may("m_father_role", "boolean") & (c("m_event.y") - c("c_death.y") <= 1), no)
    other_father = may("m_parent_name", "string").isNotNull() & may("c_parent_name", "string").isNotNull() & ~names_similar(may("m_parent_name", "string"), may("c_parent_name", "string"))
    is_parent = names_similar(may("m_other_parent_name", "string"), may("c_partner_name", "string")) & F.coalesce(given_points(may("m_other_parent", "string"), may("c_partner", "string")) > 0, F.lit(True)) & c("m_spouse").isNull()
    excluded = (
        F.when(~F.coalesce(age.between(may("m_low", "int"), may("m_high", "int")), F.lit(True)), "age of the role")
        .when(differs(c("m_sex"), c("c_sex")), "sex")
        .when(my > c("c_adult") - 14, "born after adult")
        .when(c("m_adult") & (age < 14), "too young for the role")
        .when(F.coalesce(c("m_burial"), no) & (marital_kind(may("m_marital", "string")) == "ehe") & (age < 14), "married too young")
        .when(c("m_burial") & full(c("c_buried")) & full(c("m_event")) & (F.abs(ordinal(c("m_event")) - ordinal(c("c_buried"))) > 10), "already buried")
        .when(F.coalesce(c("c_given"), F.lit("")) == "", "candidate without given name")
        .when(given_contradiction(c("m_given"), c("c_given")) | (given == 0), "given names differ")
        .when(infant & (days > 365), "infant born on another day")
        .when(~born_then & (years > NEAR_YEARS), "born in other years")
        .when(dead_before & ~posthumous, "already dead")
        .when((age < 0) | (age > 100), "age")
        .when(other_father, "other father")
        .when(is_parent, "is the parent")
    )
    points = (
        F.coalesce(given, F.lit(0))
        + F.when(c("m_surname") == c("c_surname"), EXACT_SURNAME).otherwise(0)
        + F.when(may("m_wedding", "boolean") & age.between(18, 32), MARRIAGE_AGE).otherwise(0)
        + F.when(born_then, EXACT_BIRTH).when(years <= 1, YEAR_BIRTH).when(years <= NEAR_YEARS, NEAR_BIRTH).otherwise(0)
        + F.when(full(c("m_death")) & (c("m_death") == c("c_death")), DEATH_REFERENCE).otherwise(0)
        + F.when(names_similar(c("m_father"), c("c_father")), FATHER).otherwise(0)
        + F.when(names_similar(c("m_mother"), c("c_mother")), MOTHER).otherwise(0)
        + F.when(given_points(c("m_spouse"), c("c_spouse")) > 0, SPOUSE).otherwise(0)
    )
    out = pairs.withColumn("excluded_by", excluded)
    return out.withColumn("points", F.when(c("excluded_by").isNull(), points))


def exclusion_counts(scored: DataFrame) -> DataFrame:
    """rule, n, n_given: how often each rule excluded, and how often the given names had fitted."""
    fits = F.coalesce(given_points(c("m_given"), c("c_given")) > 0, F.lit(False))
    return scored.where("excluded_by IS NOT NULL").groupBy(c("excluded_by").alias("rule")).agg(F.count("*").alias("n"), F.count_if(fits).alias("n_given"))


def decide(scored: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(m_id, stage, final_stage, best_id, points, n_candidates, alternatives) of scored pairs (m_id, c_id, points, anchor).

    Candidates below the threshold don't count. A lead of less than 30 is unsicher, and the mention stays by itself (final stage
    neu); else it is sicher with an anchor and no rival, or a lead of 50; else wahrscheinlich. Alternatives are the next three.
    """
    w = Window.partitionBy("m_id").orderBy(c("points").desc(), "c_id")
    kept = scored.where(c("points") >= threshold).withColumns({"nr": F.row_number().over(w), "next": F.lead("points").over(w)})
    best = F.max(F.when(c("nr") == 1, F.struct("c_id", "points", "next", "anchor")))
    near = F.array_sort(F.collect_list(F.when(c("nr").between(2, 4), F.struct("nr", "c_id", "points"))))
    one = kept.groupBy("m_id").agg(best.alias("best"), F.count("*").alias("n_candidates"), near.alias("near"))
    lead = c("best.points") - c("best.next")
    stage = F.when(lead < CLEAR, "unsicher").when(c("best.anchor") & (lead.isNull() | (lead >= SURE)), "sicher").otherwise("wahrscheinlich")
    out = one.withColumn("stage", stage)
    final = F.when(c("stage") == "unsicher", "neu").otherwise(c("stage"))
    return out.select(
        "m_id", "stage", final.alias("final_stage"), F.when(final != "neu", c("best.c_id")).alias("best_id"), c("best.points").alias("points"), "n_candidates",
        F.transform("near", lambda x: F.struct(x["c_id"].alias("id"), x["points"].alias("points"))).alias("alternatives"),
    )


def decide_by_name_and_year(mentions: DataFrame) -> DataFrame:
    """(id, stage, final_stage, best_id, points, n_candidates): each mention against all of smaller id, without meeting them in pairs.

    ``mentions`` has id, given, surname, year. A candidate has the same given name, a surname of the same phonetic key and a year at
    most five apart; its points are 100, 20 for the very surname, and :func:`birth_points`. Those points depend on the candidate's
    surname and year only. So the mentions of one name and year form a cell; a mention asks at most eleven cells for each such
    surname, and a running count over the cell tells how many of it came before and which was first. Work grows with the mentions,
    not with the square of a name's bearers.
    """
    keyed = mentions.withColumn("key", koelner(c("surname")))
    names = keyed.select("key", "given", c("surname").alias("other")).distinct()
    member = mentions.select("given", c("surname").alias("other"), c("year").alias("cell_year"), "id", F.lit(1).alias("member"), F.lit(None).cast("int").alias("points"), F.lit(None).cast("boolean").alias("anchor"))
    offset = F.explode(F.sequence(F.lit(-NEAR_YEARS), F.lit(NEAR_YEARS)))
    asks = keyed.join(names, ["key", "given"]).select("given", "other", "surname", "year", "id", offset.alias("offset"))
    points = 100 + F.when(c("other") == c("surname"), EXACT_SURNAME).otherwise(0) + birth_points(F.lit(0), c("offset"))
    asks = asks.select("given", "other", (c("year") + c("offset")).alias("cell_year"), "id", F.lit(0).alias("member"), points.cast("int").alias("points"), (F.abs("offset") <= 1).alias("anchor"))
    w = Window.partitionBy("given", "other", "cell_year").orderBy("id", "member").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = member.union(asks).withColumns({"n": F.sum("member").over(w), "first": F.min(F.when(c("member") == 1, c("id"))).over(w)}).where("member = 0 AND n > 0")
    level = seen.groupBy("id", "points").agg(F.sum("n").alias("n"), F.min(F.struct("first", "anchor")).alias("best"))
    top = level.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-c("points")).alias("p"), "n", "best"))).alias("levels"), F.sum("n").alias("n_candidates"))
    first, second = F.get("levels", F.lit(0)), F.get("levels", F.lit(1))
    lead = F.when(first["n"] > 1, 0).otherwise(second["p"] - first["p"])
    stage = F.when(c("n_candidates").isNull(), "neu").when(lead < CLEAR, "unsicher").when(first["best"]["anchor"] & (lead.isNull() | (lead >= SURE)), "sicher").otherwise("wahrscheinlich")
    out = mentions.select("id").join(top, "id", "left").withColumn("stage", stage)
    final = F.when(c("stage") == "unsicher", "neu").otherwise(c("stage"))
    return out.select("id", "stage", final.alias("final_stage"), F.when(final != "neu", first["best"]["first"]).alias("best_id"), (-first["p"]).alias("points"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def link_set_based(decided: DataFrame, ids: DataFrame, components) -> DataFrame:
    """(id, identity): mentions that a decision links, directly or through others, are one identity, named by its smallest mention.

    ``decided`` has m_id, best_id; ``ids`` all mentions (id); ``components`` finds the connected components of edges (a, b).
    """
    edges = decided.where("best_id IS NOT NULL").select(c("m_id").alias("a"), c("best_id").alias("b"))
    return ids.join(components(edges), "id", "left").select("id", F.coalesce("root", "id").alias("identity"))


def merge_couples(families: DataFrame) -> DataFrame:
    """(family_id, kept_id): of the families of one couple the one with a wedding entry is kept, then the smallest id; others keep themselves."""
    w = Window.partitionBy("husband", "wife").orderBy(c("wedded").desc(), "family_id")
    both = c("husband").isNotNull() & c("wife").isNotNull()
    merged = families.where(both).select("family_id", F.first("family_id").over(w).alias("kept_id"))
    return merged.union(families.where(~both).select("family_id", c("family_id").alias("kept_id")))


def pin_references(mentions: DataFrame) -> DataFrame:
    """(id, ref, identity, contradiction): mentions of one reference are one identity, named by its first mention; contradiction marks references of several surnames."""
    known = mentions.where("ref IS NOT NULL").groupBy("ref").agg(F.min("id").alias("identity"), (F.min("surname") != F.max("surname")).alias("contradiction"))
    return mentions.join(known, "ref", "left").select("id", "ref", F.coalesce("identity", "id").alias("identity"), F.coalesce("contradiction", F.lit(False)).alias("contradiction"))


def overlay_decisions(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """``links`` (key, target, stage) under human decisions (key, kind gleich or neu, target): the human's word wins; a target that isn't known leaves the decision pending."""
    known = links.select(c("key").alias("to"), c("identity").alias("to_identity"))
    d = decisions.select("key", "kind", c("target").alias("to")).join(known, "to", "left")
    out = links.join(d, "key", "left")
    same, new = (c("kind") == "gleich") & c("to_identity").isNotNull(), c("kind") == "neu"
    return out.select(
        "key", F.when(same, c("to_identity")).when(new, None).otherwise(c("identity")).alias("identity"),
        F.when(same | new, "entschieden").otherwise(c("stage")).alias("stage"), F.coalesce((c("kind") == "gleich") & c("to_identity").isNull(), F.lit(False)).alias("pending"),
    )


#: Persons of one cell that are looked at: two more than an entry has principals, so that what is left tells whether one fits. Entries with more principals are asked of all persons.
_FEW = 16


def resolve_participants(participants: DataFrame, persons: DataFrame, principals: DataFrame | None = None, years: int = 15, least_age: int = 14) -> DataFrame:
    """(part_id, person_id, reason): a participant is a person if exactly one fits.

    ``participants`` has part_id, key (phonetic), given (canonical), surname, year, and may have single (said to be unmarried) and entry; ``persons``
    person_id, key, given, surname, year (of a mention), birth_y, death_y, and may have wed_y (first wedding); ``principals`` (entry, person_id) are those whom an entry
    is about, who are none of its participants.
    Key and given name must be equal, surnames close, the mention within ``years``, and the person old
    enough, not dead in an earlier year, and not married before if said to be single. Equal questions are asked once, of persons folded into cells of equal names and years, so
    that the work grows with names and years and not with the bearers of a frequent name: of a cell the first few persons tell whether
    one is left without the principals.
    """
    participants = participants if "single" in participants.columns else participants.withColumn("single", F.lit(False))
    persons = persons if "wed_y" in persons.columns else persons.withColumn("wed_y", F.lit(None).cast("int"))
    ask, cell = ["key", "given", "surname", "year", "single"], ["key", "given", "p_surname", "p_year", "birth_y", "death_y", "wed_y"]
    asks = participants.select(*ask).distinct()
    each = persons.select("key", "given", c("surname").alias("p_surname"), c("year").alias("p_year"), "birth_y", "death_y", "wed_y", "person_id").distinct()
    few = each.withColumn("nr", F.row_number().over(Window.partitionBy(*cell).orderBy("person_id"))).where(c("nr") <= _FEW)
    cells = few.groupBy(*cell).agg(F.collect_list("person_id").alias("ids"))
    near = F.abs(c("year") - c("p_year")) <= years
    alive = F.coalesce(c("year") - c("birth_y") >= least_age, F.lit(True)) & F.coalesce(c("death_y") >= c("year"), F.lit(True)) & ~(c("single") & F.coalesce(c("wed_y") < c("year"), F.lit(False)))
    fits = near & alive & close_spelling(c("surname"), c("p_surname"))
    met = asks.join(cells, ["key", "given"]).where(fits)
    found = met.groupBy(*ask).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    out = participants.join(found, ask, "left").withColumn("ids", F.coalesce("ids", F.array().cast(dict(each.select(F.array("person_id").alias("x")).dtypes)["x"])))
    n, one = F.size("ids"), F.get("ids", F.lit(0))
    if principals is not None:
        own = principals.select("entry", "person_id").distinct()
        sizes = own.groupBy("entry").agg(F.count("*").alias("n_own"))
        small = own.join(sizes.where(c("n_own") <= _FEW - 2), "entry").groupBy("entry").agg(F.collect_set("person_id").alias("own"))
        out = out.join(small, "entry", "left").withColumn("ids", F.when(c("own").isNotNull(), F.array_except("ids", "own")).otherwise(c("ids")))
        # Where an entry has more, all bearers are met, and its principals taken away.
        large = participants.join(sizes.where(c("n_own") > _FEW - 2), "entry", "left_semi")
        left = large.select("part_id", "entry", *ask).join(each, ["key", "given"]).where(fits).select("part_id", "entry", "person_id").distinct().join(own, ["entry", "person_id"], "left_anti")
        left = left.groupBy("part_id").agg(F.count("*").cast("int").alias("n_left"), F.min("person_id").alias("first"))
        of = large.select("part_id", F.lit(True).alias("large")).join(left, "part_id", "left")
        out = out.join(of, "part_id", "left")
        n, one = F.when(c("large"), F.coalesce("n_left", F.lit(0))).otherwise(n), F.when(c("large"), c("first")).otherwise(one)
    reason = F.when(n == 0, "none fits").when(n > 1, "several fit").otherwise("one fits")
    return out.select("part_id", F.when(n == 1, one).alias("person_id"), reason.alias("reason"))
