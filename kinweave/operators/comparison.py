"""A reconstitution against a reference tree: which entries both know, which of them both give to one person, and where they part.

Both sides are keys of entries (a citation, or what an entry is about) with the person that each side gives them to. Pairs of entries are counted over the
contingency of the two sides and never made: a person of n entries costs n rows, however wrong a link may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import given_canon, given_points, names_similar
from ..functions.stats import ratio
from ..sources.gedcom import with_parents
from .evaluate import pairwise, stage_accuracy, unique_by
from .verdicts import content_key, normal_citation

c = F.col

#: Which events are a baptism's and which a burial's, and the short names of both.
BAPTISM, BURIAL = ("BIRT", "CHR"), ("DEAT", "BURI")
SHORT = {"taufe": "Tau", "tod": "Beg"}
#: The columns of a list of deviations.
DEVIATIONS = ("ART", "BEGRAEBNIS", "TAUFE", "NENNUNG", "EIGEN", "STUFE", "BEGRUENDUNG", "REFERENZ BEGRAEBNIS", "REFERENZ TAUFE", "PAARE", "URTEIL", "BEMERKUNG")
EXTRA, MISSED = "zu viel", "verpasst"


def key_year(key: Column) -> Column:
    """The first four digits of a key as a year; null if there are none."""
    return F.regexp_extract(key, r"(\d{4})", 1).try_cast("int")


def reference(lines: DataFrame, by: str = "citation") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, keys, parents) of a GEDCOM's lines (see :func:`kinweave.sources.gedcom.parse_records`).

    persons: ref, given, surname, birth, death (years); keys: key, ref, kind (Tau or Beg), of births, baptisms, deaths and burials; parents: ref, father, mother, of the first family there is among those
    that a person names as a child's. ``by`` is "citation" (the pages that sources of an event give, made comparable) or "content" (kind, year, phonetic key and first given name; one
    that several persons have counts for none of them).
    """
    if by not in ("citation", "content"):
        raise ValueError(f"entries meet by citation or content, not by {by}")
    t = with_parents(lines.where("level < 4"))
    kinds = t.where("level = 0 AND xref IS NOT NULL").select(c("xref").alias("record"), c("tag").alias("kind"))
    t = t.join(kinds, "record")
    i = t.where("kind = 'INDI'")
    name = F.min_by(F.when((c("level") == 1) & (c("tag") == "NAME"), c("value")), F.when((c("level") == 1) & (c("tag") == "NAME"), c("line_no")))
    dated = (c("level") == 2) & (c("tag") == "DATE") & key_year(c("value")).isNotNull()
    year = lambda tags: F.min_by(F.when(dated & c("parent_tag").isin(*tags), key_year(c("value"))), F.when(dated & c("parent_tag").isin(*tags), c("line_no")))
    persons = i.groupBy(c("record").alias("ref")).agg(name.alias("called"), year(BAPTISM).alias("birth"), year(BURIAL).alias("death"))
    called = F.coalesce("called", F.lit(""))
    parted = F.regexp_like(called, F.lit("^.*?/.*?/"))
    persons = persons.select("ref", F.when(parted, F.trim(F.regexp_extract(called, "^(.*?)/", 1))).otherwise(called).alias("given"), F.trim(F.regexp_extract(called, "/([^/]*)/", 1)).alias("surname"), "birth", "death")
    if by == "content":
        events = i.where(dated & c("parent_tag").isin(*BAPTISM, *BURIAL)).select(c("record").alias("ref"), F.when(c("parent_tag").isin(*BAPTISM), "Tau").otherwise("Beg").alias("short"), key_year(c("value")).alias("year")).distinct()
        keys = unique_by(events.join(persons, "ref").select(content_key(c("short"), c("year"), c("surname"), c("given")).alias("key"), "ref", c("short").alias("kind")).distinct(), "key")
    else:
        # A source stands below an event, its page below the source.
        events = i.where((c("level") == 1) & c("tag").isin(*BAPTISM, *BURIAL)).select("record", c("line_no").alias("event"), F.when(c("tag").isin(*BAPTISM), "Tau").otherwise("Beg").alias("short"))
        sources = i.where((c("level") == 2) & (c("tag") == "SOUR")).select("record", c("line_no").alias("source"), c("parent_no").alias("event")).join(events, ["record", "event"])
        pages = i.where((c("level") == 3) & (c("tag") == "PAGE") & (F.trim("value") != "")).select("record", c("parent_no").alias("source"), "value")
        keys = pages.join(sources, ["record", "source"]).select(normal_citation(c("value")).alias("key"), c("record").alias("ref"), c("short").alias("kind")).distinct()
    first = lambda tag: F.min_by(F.when((c("level") == 1) & (c("tag") == tag), c("value")), F.when((c("level") == 1) & (c("tag") == tag), c("line_no")))
    couples = t.where("kind = 'FAM'").groupBy(c("record").alias("family")).agg(first("HUSB").alias("father"), first("WIFE").alias("mother"))
    named = i.where("level = 1 AND tag = 'FAMC'").select(c("record").alias("ref"), c("value").alias("family"), "line_no")
    parents = named.join(couples, "family").groupBy("ref").agg(F.min_by(F.struct("father", "mother"), "line_no").alias("x")).select("ref", "x.father", "x.mother")
    return persons, keys, parents


def own_keys(mentions: DataFrame, links: DataFrame, by: str = "citation") -> DataFrame:
    """(key, kind, ident, stage, reason, text) of children at their baptism and the dead at their burial; of several that cite one page the last counts, of several of one content none.

    ``mentions`` has id, register, path, date, name, given_name, page; ``links`` id, identity, stage, reason.
    """
    m = mentions.where("(register = 'taufe' AND path = 'kind') OR (register = 'tod' AND path = 'verstorbener')")
    short = F.element_at(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv]), c("register"))
    key = content_key(short, c("date.y"), c("name"), c("given_name")) if by == "content" else normal_citation(c("page"))
    rows = m.join(links.select("id", "identity", "stage", "reason"), "id").select(key.alias("key"), short.alias("kind"), c("identity").alias("ident"), "stage", "reason", F.concat_ws(", ", "name", "given_name").alias("text"), "id")
    if by == "content":
        return unique_by(rows, "key").drop("id")
    last = rows.groupBy("key").agg(F.max_by(F.struct("kind", "ident", "stage", "reason", "text"), "id").alias("x"))
    return last.select("key", "x.*")


def shared(own: DataFrame, keys: DataFrame, since: int = 0) -> DataFrame:
    """(key, kind, ident, ref, stage, reason, text) of the entries that both sides know, of year ``since`` or later; a key that several reference persons have is the first one's."""
    one = keys.where("key IS NOT NULL").groupBy("key").agg(F.min("ref").alias("ref"))
    return own.join(one, "key").where(F.coalesce(key_year(c("key")), F.lit(0)) >= since).select("key", "kind", "ident", "ref", "stage", "reason", "text")


def apart(links: DataFrame, group: str, part: str) -> DataFrame:
    """(group, key, partner, pairs): the entries of a group that stand in another part than its largest, each with an entry of the largest, and the number of pairs that it parts.

    ``links`` has key, kind, ``group`` and ``part``. The parts of a group stand by size, then smallest key; an entry parts as many pairs as there are entries in the parts before its own, so that
    the sum is that of all pairs of a group less those within its parts. The partner of a burial is the first baptism there, if there is one; else, and for others, the first burial, then any.
    """
    short = lambda s: F.min(F.when(c("kind") == s, c("key")))
    cells = links.groupBy(group, part).agg(F.count("*").alias("n"), F.min("key").alias("low"), short("Tau").alias("baptism"), short("Beg").alias("burial"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "low")
    cells = cells.withColumns({"nr": F.row_number().over(w), "pairs": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    head = cells.where("nr = 1").select(group, "low", "baptism", "burial")
    out = links.select("key", "kind", group, part).join(cells.where("nr > 1").select(group, part, "pairs"), [group, part]).join(head, group)
    partner = F.when(c("kind") == "Beg", F.coalesce("baptism", "low")).otherwise(F.coalesce("burial", "low"))
    return out.select(group, "key", partner.alias("partner"), "pairs")


def deviations(both: DataFrame, persons: DataFrame, ref_persons: DataFrame) -> DataFrame:
    """The rows of :data:`DEVIATIONS`: entries that are one person here and not in the reference ("zu viel"), and the other way round ("verpasst"); PAARE sums up to all pairs that differ.

    ``both`` as of :func:`shared`; persons (ident, who) and ref_persons (ref, who) say how a person is shown.
    """
    extra = apart(both, "ident", "ref").select(F.lit(EXTRA).alias("art"), "key", "partner", "pairs")
    missed = apart(both, "ref", "ident").select(F.lit(MISSED).alias("art"), "key", "partner", "pairs")
    at = both.select("key", "kind", "ident", "ref", "stage", "reason", "text")
    rows = extra.union(missed).join(at.select("key", "kind"), "key").join(at.select(c("key").alias("partner"), c("kind").alias("other")), "partner")
    # Of two of a kind the smaller key stands for the burial if both are one, else the greater.
    first = F.when(c("kind") != c("other"), c("kind") == "Beg").otherwise((c("key") < c("partner")) == (c("kind") == "Beg"))
    rows = rows.select("art", F.when(first, c("key")).otherwise(c("partner")).alias("burial"), F.when(first, c("partner")).otherwise(c("key")).alias("baptism"), "pairs")
    rows = rows.join(at.drop("kind").withColumnRenamed("key", "burial"), "burial").join(at.select(c("key").alias("baptism"), c("ref").alias("ref_b")), "baptism")
    rows = rows.join(persons.select("ident", c("who").alias("own")), "ident", "left")
    of = lambda key, as_: ref_persons.select(c("ref").alias(key), c("who").alias(as_))
    rows = rows.join(of("ref", "who_burial"), "ref", "left").join(of("ref_b", "who_baptism"), "ref_b", "left")
    shown = ("art", "burial", "baptism", "text", "own", "stage", "reason", "who_burial", "who_baptism", "pairs")
    return rows.select(*[c(x).alias(n) for x, n in zip(shown, DEVIATIONS, strict=False)], F.lit("").alias("URTEIL"), F.lit("").alias("BEMERKUNG"))


def stages(both: DataFrame) -> DataFrame:
    """stage, n, n_right, low, high: persons with a baptism and a burial that both sides know, by the stage of the first burial's link; right if the reference has both for one person."""
    first = lambda s: F.min_by(F.when(c("kind") == s, F.struct("ref", "stage")), F.when(c("kind") == s, c("key")))
    each = both.groupBy("ident").agg(first("Tau").alias("t"), first("Beg").alias("b")).where("t IS NOT NULL AND b IS NOT NULL")
    return stage_accuracy(each.select(c("b.stage").alias("stage"), (c("b.ref") == c("t.ref")).alias("right")))


def same_persons(pairs: DataFrame, own: DataFrame, keys: DataFrame, persons: DataFrame, ref_persons: DataFrame) -> DataFrame:
    """The pairs (ident, ref) that are one person: those with a common entry; those of whom both have entries of one kind are none; the others by name, if given names don't contradict.

    persons (ident, name, given, unknown) and ref_persons (ref, surname, given) tell the names.
    """
    pairs = pairs.where("ident IS NOT NULL AND ref IS NOT NULL").select("ident", "ref").distinct()
    common = own.select("key", "ident").join(keys.select("key", "ref"), "key").select("ident", "ref").distinct()
    kind = lambda side, who: side.select(who, "kind").distinct()
    clash = pairs.join(kind(own, "ident"), "ident").join(kind(keys, "ref"), ["ref", "kind"]).select("ident", "ref").distinct()
    open_ = pairs.join(common, ["ident", "ref"], "left_anti").join(clash, ["ident", "ref"], "left_anti")
    named = open_.join(persons.select("ident", "name", c("given").alias("own_given"), "unknown"), "ident").join(ref_persons.select("ref", "surname", "given"), "ref")
    nobody = (F.coalesce("unknown", F.lit(False)) | (F.coalesce("name", F.lit("")) == "")) & F.upper(F.btrim(F.coalesce("surname", F.lit("")), F.lit(". "))).isin("NN", "N", "")
    points = given_points(given_canon(F.coalesce("own_given", F.lit(""))), given_canon(F.coalesce("given", F.lit(""))))
    fits = (nobody | names_similar(c("name"), c("surname"))) & (F.coalesce(points, F.lit(1)) > 0)
    return pairs.join(common, ["ident", "ref"], "left_semi").union(named.where(fits).select("ident", "ref"))


def parents_of(both: DataFrame, own_parents: DataFrame, ref_parents: DataFrame) -> DataFrame:
    """(key, family: whether there is one here, own_father, ref_father, own_mother, ref_mother) of the baptisms that both sides know."""
    mine = own_parents.select("ident", F.lit(True).alias("family"), c("father").alias("own_father"), c("mother").alias("own_mother"))
    theirs = ref_parents.select("ref", c("father").alias("ref_father"), c("mother").alias("ref_mother"))
    return both.where("kind = 'Tau'").select("key", "ident", "ref").join(mine, "ident", "left").join(theirs, "ref", "left").drop("ident", "ref")


def parents_agree(parents: DataFrame, same: DataFrame) -> DataFrame:
    """class, n: how the parents agree, of rows as of :func:`parents_of`; ``same`` is of :func:`same_persons`."""
    x = parents
    for who in ("father", "mother"):
        x = x.join(same.select(c("ident").alias(f"own_{who}"), c("ref").alias(f"ref_{who}"), F.lit(True).alias(f"{who}_same")), [f"own_{who}", f"ref_{who}"], "left")
    alike = lambda who: (c(f"own_{who}").isNull() & c(f"ref_{who}").isNull()) | F.coalesce(f"{who}_same", F.lit(False))
    none = c("ref_father").isNull() & c("ref_mother").isNull()
    kind = (
        F.when(c("family").isNull() & none, "ohne Eltern").when(c("family").isNull(), "nur Referenz hat Eltern").when(none, "nur eigene Eltern").when(alike("father") & alike("mother"), "gleich")
        .when(alike("mother"), "anderer Vater").when(alike("father"), "andere Mutter").otherwise("beide anders")
    )
    return x.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def report(both: DataFrame) -> DataFrame:
    """One row: entries that both sides know, pairs that should be and are together, hits, those too many and those missed, precision and recall."""
    n = both.agg(F.count("*").alias("entries")).withColumn("one", F.lit(1))
    return pairwise(both.select("ref", "ident")).withColumn("one", F.lit(1)).join(n, "one").select(
        "entries", "should", "found", "hits", (c("found") - c("hits")).alias("extra"), (c("should") - c("hits")).alias("missed"), ratio(c("hits"), c("found")).alias("precision"), ratio(c("hits"), c("should")).alias("recall")
    )
