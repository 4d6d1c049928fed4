"""A project from sheets to a checked GEDCOM: build, link, export, verify, and what each of them is asked about."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.stats import ratio
from .operators import comparison, families, matching, verdicts
from .operators.ingest import to_entries, to_fields
from .operators.mentions import build_mentions
from .sources import export, gedcom, store, tables
from .sources.shared import materialise

c = F.col


@dataclass
class Project:
    """The tables of a project; entries are numbered by their sheet and row, so that a row keeps its number from build to build.

    mentions: as :func:`kinweave.operators.families.linkable` gives them, with source, page and stable_key (file, sheet, row and role); sources: source, title; links and families: see
    :func:`kinweave.operators.families.link_families`, null until linked.
    """

    mentions: DataFrame
    sources: DataFrame
    links: DataFrame | None = None
    families: DataFrame | None = None


def build(cells: DataFrame, sheets: list[dict], project: int = 0) -> Project:
    """The mentions of all sheets of a mapping (see :func:`kinweave.sources.tables.load_mapping`); one that names a file is for that file's sheet.

    ``cells`` has file, sheet, row, col, value. Sheets and their names are metadata and reach the driver; rows stay where they are. A sheet that the cells
    don't have adds nothing.
    """
    spark = cells.sparkSession
    known = sorted((r.file, r.sheet) for r in cells.select("file", "sheet").distinct().collect())
    entries, titles = [], []
    for n, (file, name) in enumerate(known):
        for s in (s for s in sheets if s["name"] == name and s.get("file") in (None, file.rsplit("/", 1)[-1])):
            columns = sorted({col for _, run, _ in s["fields"] for col in run})
            rows = cells.where((c("file") == file) & (c("sheet") == name) & (c("row") > 1)).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("v"))
            rows = rows.select((F.lit(n).cast("long") * (1 << 32) + c("row")).alias("entry"), *[F.try_element_at("v", F.lit(col)).alias(f"c{col}") for col in columns])
            fields = to_fields(rows, [(field, [f"c{col}" for col in run], constant) for field, run, constant in s["fields"]], s["blanks"])
            entries.append(to_entries(fields, s["register"]))
            titles.append((n, file, name, f"{file.rsplit('/', 1)[-1]}, {name} ({s['register']})"))
    all_sheets = spark.createDataFrame(titles, "source long, file string, sheet string, title string")
    sources = all_sheets.select("source", "title")
    if not entries:
        empty = to_entries(spark.createDataFrame([], "entry long, field string, value string, raw string"), "tod")
        entries = [empty]
    all_ = reduce(DataFrame.union, entries)
    said = lambda name: F.try_element_at("fields", F.lit(name))["value"]
    cited = all_.select("entry", said("zitat").alias("citation"), said("kb").alias("kb"), said("seite").alias("page"), said("lfd_nr").alias("number"), F.shiftright("entry", 32).alias("of"), c("entry").bitwiseAND((1 << 32) - 1).cast("string").alias("row"))
    books = all_sheets.groupBy(c("source").alias("of")).agg(F.min("title").alias("source"), F.first("file").alias("file"), F.first("sheet").alias("sheet"))
    cited = cited.join(books, "of", "left").select("entry", c("of").alias("source"), gedcom.citation().alias("page"), F.concat_ws("|", "file", "sheet", "row").alias("stable_key"))
    m = families.linkable(build_mentions(all_), F.lit(project)).join(cited, "entry").withColumn("stable_key", F.concat_ws("|", "stable_key", "path"))
    return Project(materialise(m, "mentions"), sources)


def propose(cells: DataFrame) -> str:
    """The text of a mapping file for all sheets of ``cells``, to be looked through (see :func:`kinweave.operators.matching.propose`)."""
    blanks = matching.blank_words(cells.where("row > 1"), ("file", "sheet"))
    return tables.dump_mapping(matching.as_mapping(matching.propose(cells), blanks))


def link(project: Project, decisions: DataFrame | None = None, pin: bool = False) -> Project:
    """The project with its links and families, under human decisions (key, kind, target: a key) if there are any.

    Decisions name mentions by key, so that they hold after a rebuild; those of keys that are no longer there count for nothing.
    """
    if decisions is not None:
        ids = project.mentions.select(c("stable_key").alias("key"), "id")
        decisions = decisions.select("key", "kind", c("target").alias("to")).join(ids, "key").join(ids.select(c("key").alias("to"), c("id").alias("target")), "to", "left").select("id", "kind", "target")
    links, found = families.link_families(project.mentions, decisions, pin, evidence=True)
    return Project(project.mentions, project.sources, links, materialise(found, "families"))


def save(project: Project, path: str, decisions: DataFrame | None = None) -> int:
    """Write the project, linked or not, and people's decisions (key, kind, target) as the next version at ``path`` (see :mod:`kinweave.sources.store`)."""
    parts = {"mentions": project.mentions, "sources": project.sources, "links": project.links, "families": project.families, "decisions": decisions}
    return store.save({name: table for name, table in parts.items() if table is not None}, path)


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[Project, DataFrame | None]:
    """(project, decisions) of a version at ``path``, the newest whole one if none is named."""
    parts = store.load(spark, path, version)
    return Project(parts["mentions"], parts["sources"], parts.get("links"), parts.get("families")), parts.get("decisions")


def rebuild(path: str, cells: DataFrame, sheets: list[dict], project: int = 0, pin: bool = False) -> Project:
    """The project at ``path`` built and linked anew from ``cells``, under the decisions of its newest version, which are kept by key; written as the next version.

    Until the new version is whole, readers have the one before; a rebuild that fails leaves it in place. Where nothing is stored yet, the first version is made.
    """
    spark = cells.sparkSession
    before = load(spark, path)[1] if store.versions(spark, path) else None
    number = save(link(build(cells, sheets, project), before, pin), path, before)
    return load(spark, path, number)[0]


def status(project: Project) -> DataFrame:
    """One row: entries, mentions, identities, families, those of a wedding entry, children, and mentions of which nobody knows a name."""
    m = project.mentions.agg(F.countDistinct("entry").alias("entries"), F.count("*").alias("mentions"), F.count_if(c("name").isNull()).alias("nameless"))
    i = project.links.agg(F.countDistinct("identity").alias("identities"))
    f = project.families.agg(F.count("*").alias("families"), F.coalesce(F.sum("wedded"), F.lit(0)).alias("wedded"), F.coalesce(F.sum(F.size("children")), F.lit(0)).alias("children"), (F.lit(1)).alias("one"))
    return f.join(m.withColumn("one", F.lit(1)), "one").join(i.withColumn("one", F.lit(1)), "one").select("entries", "mentions", "identities", "families", "wedded", "children", "nameless", ratio(c("nameless"), c("mentions")).alias("share_nameless"))


#: The columns of a review list.
REVIEW = ("FALL", "SCHLUESSEL", "REGISTER", "JAHR", "FUNDSTELLE", "ROLLE", "NENNUNG", "STUFE", "WAHL", "BEGRUENDUNG", "KANDIDATEN", "BISHER", "URTEIL", "BEMERKUNG")


def persons(project: Project) -> DataFrame:
    """(identity, who, key, second, name, given, unknown): each identity as lists show it, number, name, years of birth and death, the keys of its first two mentions, and its names."""
    m = project.mentions.join(project.links.select("id", "identity"), "id")
    named = lambda x, order: F.min_by(x, F.struct(c(x).isNull(), *order))
    birth = F.min(F.when(c("path") == "kind", F.coalesce("birth.y", "date.y")))
    one = m.groupBy("identity").agg(
        named("name", ["id"]).alias("name"), named("given_name", ["id"]).alias("given"), F.coalesce(birth, F.min("birth.y")).alias("born"), F.min(F.when(c("path") == "verstorbener", c("date.y"))).alias("died"),
        F.min(F.coalesce("unknown", F.lit(False))).alias("unknown"), F.min(F.struct("id", "stable_key")).alias("low"),
    )
    second = m.join(one.select("identity", c("low.id").alias("low_id")), "identity").where("id > low_id").groupBy("identity").agg(F.min(F.struct("id", "stable_key"))["stable_key"].alias("second"))
    said = lambda x, none: F.coalesce(c(x).cast("string"), F.lit(none))
    who = F.concat(F.lit("["), c("identity").cast("string"), F.lit("] "), F.coalesce("name", F.when(c("unknown"), "NN").otherwise("-")), F.lit(", "), said("given", "-"), F.lit(" *"), said("born", "?"), F.lit(" †"), said("died", "?"))
    return one.join(second, "identity", "left").select("identity", who.alias("who"), c("low.stable_key").alias("key"), "second", "name", "given", "unknown")


def review(project: Project, decisions: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """The mentions to be looked at, with the columns of :data:`REVIEW`, in order of their year: links that are unsicher, those left open between others, and whatever has been decided; all that are
    wahrscheinlich too, if ``everything`` is asked for. What is written into URTEIL is read by :func:`decide`.
    """
    none = project.links.sparkSession.createDataFrame([], "key string, kind string, target string")
    told = (none if decisions is None else decisions).select("key", c("kind").alias("said"), F.concat_ws(" ", "kind", "target").alias("before"))
    m = project.mentions.select("id", "entry", c("stable_key").alias("key"), "register", "path", "page", c("date.y").alias("year"), F.concat_ws(", ", "name", "given_name").alias("text"))
    rows = m.join(project.links, "id").join(told, "key", "left")
    seen = (c("stage") == "unsicher") | ((c("stage") == "neu") & (F.size("alternatives") > 0)) | c("said").isNotNull()
    rows = materialise(rows.where(seen | (c("stage") == "wahrscheinlich") if everything else seen), "review")
    known = persons(project)
    own = F.array(F.struct("identity", "points", "reason"))
    of = rows.select("id", "key", F.posexplode(F.when(c("stage") == "neu", c("alternatives")).otherwise(F.concat(own, c("alternatives")))).alias("nr", "x"))
    of = of.select("id", "nr", "x.*", c("key").alias("mine")).join(known.withColumnRenamed("key", "first"), "identity")
    key = F.when(c("first") != c("mine"), c("first")).otherwise(c("second"))
    of = of.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nr", c("identity").alias("ident"), "points", "reason", key.alias("key"), "who"))).alias("near"))
    rows = rows.join(of, "id", "left").join(known.select("identity", "who"), "identity")
    case = F.concat(c("register"), F.lit(" "), F.coalesce(c("year").cast("string"), F.lit("?")), F.lit(" · "), c("page"), F.lit(" · "), c("path"))
    choice = F.when(c("stage") == "neu", "eigene Person (unentschieden)").otherwise(c("who"))
    blank = F.lit("")
    cells = (case, c("key"), c("register"), c("year"), c("page"), c("path"), c("text"), c("stage"), choice, c("reason"), verdicts.candidate_text(F.coalesce("near", F.array().cast(rows.schema["near"].dataType)), "who"), F.coalesce("before", blank), blank, blank)
    return rows.orderBy(c("year").asc_nulls_first(), "entry", "id").select(*[x.alias(n) for x, n in zip(cells, REVIEW, strict=True)])


def decide(project: Project, sheet: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``decisions`` (key, kind, target) after the verdicts that people have written into URTEIL of a review list (see :func:`review`)."""
    said = sheet.select(c("SCHLUESSEL").alias("key"), c("URTEIL").alias("verdict"), c("KANDIDATEN").alias("candidates"))
    known = project.mentions.select("id", c("stable_key").alias("key")).join(project.links.select("id", c("identity").alias("ident")), "id").select("key", "ident")
    none = sheet.sparkSession.createDataFrame([], "key string, kind string, target string")
    return verdicts.apply_verdicts(none if decisions is None else decisions, verdicts.read_verdicts(said, known))


@dataclass
class Comparison:
    """report: one row of figures; deviations: the rows of :data:`kinweave.operators.comparison.DEVIATIONS`; stages: how often each stage is right; parents: how parents agree at baptisms."""

    report: DataFrame
    deviations: DataFrame
    stages: DataFrame
    parents: DataFrame


def compare(project: Project, lines: DataFrame, by: str = "citation", since: int = 0) -> Comparison:
    """The linked project against a reference tree (a GEDCOM's lines), entry by entry: by "citation", or by "content" where the reference cites nothing.

    A reference isn't free of faults: deviations are questions to both sides.
    """
    ref_persons, keys, ref_parents = comparison.reference(lines, by)
    keys = materialise(keys, "reference-keys")
    own = materialise(comparison.own_keys(project.mentions, project.links, by), "own-keys")
    both = materialise(comparison.shared(own, keys, since), "shared-entries")
    mine = persons(project)
    year = lambda x: F.coalesce(c(x).cast("string"), F.lit("?"))
    shown = F.concat("surname", F.lit(", "), "given", F.lit(" *"), year("birth"), F.lit(" †"), year("death"))
    ref_persons = materialise(ref_persons.withColumn("who", shown), "reference-persons")
    parents = project.families.select(F.explode("children").alias("ident"), c("husband").alias("father"), c("wife").alias("mother"))
    pairs = materialise(comparison.parents_of(both, parents, ref_parents), "parents")
    asked = pairs.select(c("own_father").alias("ident"), c("ref_father").alias("ref")).union(pairs.select("own_mother", "ref_mother"))
    same = comparison.same_persons(asked, own, keys, mine.withColumnRenamed("identity", "ident"), ref_persons)
    return Comparison(
        comparison.report(both), comparison.deviations(both, mine.select(c("identity").alias("ident"), "who"), ref_persons), comparison.stages(both),
        comparison.parents_agree(pairs, materialise(same, "same-persons")),
    )


def write_gedcom(project: Project, path: str, participants: DataFrame | None = None, notes: DataFrame | None = None) -> None:
    """The linked project as text files below ``path`` that, one after another, are a GEDCOM."""
    export.write_records(export.linked_records(project.mentions, project.links, project.families, project.sources, participants, notes), path)


def verify(project: Project, lines: DataFrame) -> DataFrame:
    """(kind, subject): entries that a GEDCOM's lines cite nowhere ("uncited"), and links in it that lead nowhere ("dangling"); none if all is well."""
    cited = lines.where("tag = 'PAGE'").select(c("value").alias("page"))
    missing = gedcom.unreconciled(project.mentions.select("entry", "page").distinct(), cited)
    lost = gedcom.dangling(lines)
    return missing.select(F.lit("uncited").alias("kind"), c("entry").cast("string").alias("subject")).union(lost.select(F.lit("dangling"), F.concat_ws(" ", "record", "tag", "value")))


def append_run(metrics: DataFrame, path: str) -> None:
    """Add a run's metrics (run, project, metric, value) to the log at ``path``, in long form."""
    metrics.select("run", "project", "metric", c("value").cast("double").alias("value")).write.mode("append").parquet(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """The hits of the rules (see :func:`kinweave.operators.rules.run_rules`), a partition for each rule, in place of those before."""
    hits.write.mode("overwrite").partitionBy("rule").parquet(path)
