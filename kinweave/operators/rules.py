"""The catalogue of plausibility rules over reconstructed persons and families.

A rule is a function of a :class:`Model` and a limit that gives its hits (person_id, family_id,
detail). Persons and families are DataFrames, so each rule is a filter, join, window or aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import before, date_text, full, impossible, months_between, pseudo_days, years_between
from .graph import own_ancestors

THIS_YEAR = 2026

#: Names that are no names, female call names, and patterns of what a name field should not hold.
NO_NAME = ("", "NN", "Anonymus", "Anonyma")
FEMALE_CALL_NAMES = (
    "Walburga", "Walpurga", "Maria", "Anna", "Catharina", "Katharina", "Margaretha", "Margarethe",
    "Barbara", "Elisabetha", "Elisabeth", "Magdalena", "Agnes", "Ursula", "Christina", "Christine",
    "Rosina", "Regina", "Dorothea", "Sophia", "Sophie", "Johanna", "Eva", "Susanna", "Agatha",
    "Apollonia", "Veronica", "Sibylla", "Salome", "Judith", "Justina", "Friederike", "Wilhelmine",
    "Louise", "Luise", "Caroline", "Charlotte", "Jacobina", "Jacobine", "Philippina", "Christiana",
    "Beata", "Benigna", "Euphrosina", "Helena", "Ottilia", "Sabina", "Sara", "Rebecca", "Esther",
    "Hanna", "Lydia", "Martha", "Emilie", "Pauline", "Mathilde", "Auguste", "Ernestine", "Henriette",
    "Theresia",
)
PHRASE_GIVEN = r"(?i)\b(keine? angaben?|unbekannt|ohne namen|findelkind|spurius|spuria|anonym|kein nachname|tochter|sohn|witwe|wittib|kind)\b"
PHRASE_SURNAME = r"(?i)\b(keine? angaben?|unbekannt|ohne namen|angaben)\b"
PLACE_GIVEN = (
    r"(?i)\b(zu|von|aus|in|nacher|bey|bei) [A-ZÄÖÜ][a-zäöüß]{3,}|\b(Tübingen|Stuttgart|Esslingen|Schorndorf|Winterbach|Waiblingen|Göppingen|Backnang|Lorch|Welzheim|Gmünd|Heilbronn|Ulm|Ludwigsburg"
    r"|Kirchheim|Nürtingen|Reutlingen|Urach|Böblingen|Herrenberg|Calw|Marbach|Weinsberg|Cannstatt|Plüderhausen|Urbach|Beutelsbach|Grunbach|Geradstetten|Hebsack|Schnait|Endersbach|Fellbach|Haubersbronn"
    r"|Miedelsbach|Schlichten|Oberberken|Baiereck|Steinenberg|Rudersberg|Buhlbronn|Hohengehren|Schornbach)\b"
)
PLACE_SURNAME = r"(?i)\b(zu|aus|in|bey|bei|nacher) [A-ZÄÖÜ]"
GLUED = "[a-zäöüß][A-ZÄÖÜ][a-zäöüß]"
SEVERAL_SURNAMES = "^[A-ZÄÖÜ][a-zäöüß]+([ ,/]+[A-ZÄÖÜ][a-zäöüß]+)+$"
SURNAME_PARTICLE = r"(?i)(^| )(von|van|de|zu|auf|der|dem|und|genannt|gen\.)( |$)"
DATE_IN_NAME = r"\d{4}|\d{1,2}\.\s*\d{1,2}\."
NAME_AS_OCCUPATION = (
    r"^(Hans|Johann|Johannes|Georg|Jerg|Jacob|Michael|Conrad|Caspar|Martin|Christoph|Friedrich|Ludwig|Wilhelm|Christian|Gottlieb|"
    r"Andreas|Philipp|Jakob|Anna|Maria|Catharina|Margaretha|Barbara)\b"
)
PROCESS_WORDS = (
    r"Prüfhinweis|Pruefhinweis|Zuordnung durch die Auswertung|Aus dem Namensfeld übernommen|Beim Einlesen|bis zur Klärung|bis zur Klaerung"
    r"|\b(?:Fliesstext|Fließtext|Parser|Regel \d|Auswertung|Einlesen|Import|Export|Zuordnung|automatisch|maschinell|Skript|Datenbank)\b"
)
NAME_WORD = "[A-Za-z0-9_äöüßÄÖÜ-]+"


@dataclass
class Model:
    """What rules see.

    p: person_id, given, surname, sex (m, w, u), birth, death, baptism, burial (partial dates), occupation, note, place, role,
    article, text_age; texts are never null. f: family_id, husband, wife, wedding, note. fc: family_id, child, pos.
    alias: a, b, persons known to be the same. rejected, confirmed, places: word lists. merged: person_id, death_a, death_b.
    """

    p: DataFrame
    f: DataFrame
    fc: DataFrame
    alias: DataFrame | None = None
    rejected_given: DataFrame | None = None
    confirmed_given: DataFrame | None = None
    rejected_surname: DataFrame | None = None
    places: DataFrame | None = None
    merged: DataFrame | None = None

    def person(self, prefix: str) -> DataFrame:
        """The persons with all columns led by a prefix."""
        return self.p.select(*[F.col(c).alias(f"{prefix}_{c}") for c in self.p.columns])

    def partners(self) -> DataFrame:
        """family_id, person_id, as (h or w), wedding, and the person's columns."""
        ends = self.f.select("family_id", "wedding", F.explode(F.array(F.struct(F.lit("h").alias("as"), F.col("husband").alias("person_id")), F.struct(F.lit("w").alias("as"), F.col("wife").alias("person_id")))).alias("e"))
        return ends.select("family_id", "wedding", "e.as", "e.person_id").where("person_id IS NOT NULL").join(self.p, "person_id")

    def children(self) -> DataFrame:
        """fc with the child's columns, led by k."""
        return self.fc.join(self.person("k"), F.col("child") == F.col("k_person_id"))

    def parented(self, parent: str) -> DataFrame:
        """Each child with its husband- or wife-parent (columns led by e) and family."""
        return self.children().join(self.f.select("family_id", "husband", "wife", "wedding"), "family_id").join(self.person("e"), F.col(parent) == F.col("e_person_id"))

    def couples(self) -> DataFrame:
        """Each family of two known partners, columns led by h and w."""
        return self.f.join(self.person("h"), F.col("husband") == F.col("h_person_id")).join(self.person("w"), F.col("wife") == F.col("w_person_id"))

    def marriages(self) -> DataFrame:
        """person_id, family_id, wedding, other, and the one before in the person's order (dated ones first): prev_family, prev_other."""
        ends = self.f.select("family_id", "wedding", F.col("husband").alias("person_id"), F.col("wife").alias("other")).union(self.f.select("family_id", "wedding", F.col("wife"), F.col("husband")))
        w = Window.partitionBy("person_id").orderBy(pseudo_days(F.col("wedding")).asc_nulls_last(), "family_id")
        return ends.where("person_id IS NOT NULL").withColumns({"prev_family": F.lag("family_id").over(w), "prev_other": F.lag("other").over(w)})

    def not_alias(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs that are not known to be one person."""
        if self.alias is None:
            return pairs
        both = self.alias.select(F.col("a").alias("_a"), F.col("b").alias("_b")).union(self.alias.select("b", "a"))
        return pairs.join(both, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left_anti")


def hits(df: DataFrame, where: Column | None = None, person: str | None = None, family: str | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    df = df if where is None else df.where(where)
    return df.select((F.col(person) if person else none).cast("long").alias("person_id"), (F.col(family) if family else none).cast("long").alias("family_id"), (F.lit("") if detail is None else detail).alias("detail"))


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str  #: error or warning
    limit: float | None
    text: str
    run: Callable[[Model, float | None], DataFrame]


CATALOGUE: dict[str, Rule] = {}


def rule(id_: str, severity: str, text: str, limit: float | None = None):
    def add(f):
        CATALOGUE[id_] = Rule(id_, severity, limit, text, f)
        return f

    return add


c = F.col
_two = lambda a, b: F.concat_ws(" / ", date_text(c(a)), date_text(c(b)))

# ---- chronology


@rule("010", "error", "death before birth")
def _(m, g):
    return hits(m.p, before(c("death"), c("birth")), "person_id", detail=_two("birth", "death"))


@rule("011", "error", "wedding before own birth")
def _(m, g):
    return hits(m.partners(), before(c("wedding"), c("birth")), "person_id", "family_id", _two("wedding", "birth"))


@rule("012", "error", "wedding after own death")
def _(m, g):
    return hits(m.partners(), before(c("death"), c("wedding")), "person_id", "family_id", _two("wedding", "death"))


@rule("013", "error", "child before mother")
def _(m, g):
    return hits(m.parented("wife"), before(c("k_birth"), c("e_birth")), "child", "family_id", _two("k_birth", "e_birth"))


@rule("014", "error", "child before father")
def _(m, g):
    return hits(m.parented("husband"), before(c("k_birth"), c("e_birth")), "child", "family_id", _two("k_birth", "e_birth"))


def _after_death(m, parent, g):
    born, died = c("k_birth"), c("e_death")
    late = F.when(full(born) & full(died), months_between(died, born) > g).otherwise(years_between(died, born) > 1)
    return hits(m.parented(parent), late, "child", "family_id", _two("k_birth", "e_death"))


@rule("015", "error", "child after mother's death", 0)
def _(m, g):
    return _after_death(m, "wife", g)


@rule("016", "error", "child too long after father's death", 9.5)
def _(m, g):
    return _after_death(m, "husband", g)


@rule("017", "warning", "child long before the parents' wedding", 1)
def _(m, g):
    both = m.children().join(m.f.where("husband IS NOT NULL AND wife IS NOT NULL"), "family_id")
    return hits(both, years_between(c("k_birth"), c("wedding")) > g, "child", "family_id", _two("k_birth", "wedding"))


@rule("018", "error", "date that no calendar has")
def _(m, g):
    dates = m.p.select("person_id", F.explode(F.array("birth", "death", "baptism", "burial")).alias("date"))
    return hits(dates, impossible(c("date")), "person_id", detail=date_text(c("date"))).union(hits(m.f, impossible(c("wedding")), None, "family_id", date_text(c("wedding"))))


@rule("019", "error", "date in the future")
def _(m, g):
    return hits(m.p, (F.coalesce(c("birth.y"), F.lit(0)) > THIS_YEAR) | (F.coalesce(c("death.y"), F.lit(0)) > THIS_YEAR), "person_id", detail=_two("birth", "death"))


@rule("020", "error", "baptism before birth")
def _(m, g):
    return hits(m.p, before(c("baptism"), c("birth")), "person_id", detail=_two("baptism", "birth"))


@rule("021", "error", "burial before death")
def _(m, g):
    return hits(m.p, before(c("burial"), c("death")), "person_id", detail=_two("burial", "death"))


@rule("022", "warning", "born on the wedding day")
def _(m, g):
    return hits(m.partners(), full(c("birth")) & full(c("wedding")) & (c("birth") == c("wedding")), "person_id", "family_id", date_text(c("birth")))


@rule("023", "warning", "children out of order; the first such child")
def _(m, g):
    dated = m.children().where(full(c("k_birth"))).withColumn("at", pseudo_days(c("k_birth")))
    w = Window.partitionBy("family_id").orderBy("pos")
    late = dated.withColumn("gone", F.lag("at").over(w)).where("gone > at")
    return hits(late.withColumn("nr", F.row_number().over(w)), c("nr") == 1, "child", "family_id", date_text(c("k_birth")))


# ---- ages


@rule("110", "error", "too old", 110)
def _(m, g):
    return hits(m.p, years_between(c("birth"), c("death")) > g, "person_id", detail=_two("birth", "death"))


def _parent_age(m, parent, young=None, old=None):
    age = years_between(c("e_birth"), c("k_birth"))
    return hits(m.parented(parent), (age >= 0) & (age < young) if young is not None else age > old, "child", "family_id", _two("e_birth", "k_birth"))


@rule("111", "error", "mother too young", 14)
def _(m, g):
    return _parent_age(m, "wife", young=g)


@rule("112", "error", "mother too old", 55)
def _(m, g):
    return _parent_age(m, "wife", old=g)


@rule("113", "error", "father too young", 14)
def _(m, g):
    return _parent_age(m, "husband", young=g)


@rule("114", "warning", "father too old", 75)
def _(m, g):
    return _parent_age(m, "husband", old=g)


@rule("115", "error", "married too young", 15)
def _(m, g):
    age = years_between(c("birth"), c("wedding"))
    return hits(m.partners(), (age >= 0) & (age < g), "person_id", "family_id", _two("birth", "wedding"))


@rule("116", "warning", "married too old", 90)
def _(m, g):
    return hits(m.partners(), years_between(c("birth"), c("wedding")) > g, "person_id", "family_id", _two("birth", "wedding"))


@rule("117", "warning", "spouses far apart in age", 40)
def _(m, g):
    return hits(m.couples(), F.abs(years_between(c("h_birth"), c("w_birth"))) > g, "husband", "family_id", _two("h_birth", "w_birth"))


def _siblings(m, where: Column) -> DataFrame:
    """Pairs of children of one family in listed order, columns led by a and b; one equi-join on the family."""
    kids = m.children().select("family_id", "pos", *[c for c in m.person("k").columns])
    a, b = (kids.select(*[F.col(x).alias(x.replace("k_", f"{s}_", 1) if x.startswith("k_") else f"{s}_{x}") for x in kids.columns]) for s in "ab")
    return a.join(b, (c("a_family_id") == c("b_family_id")) & (c("a_pos") < c("b_pos")) & where)


@rule("118", "warning", "siblings too close", 8)
def _(m, g):
    apart = F.abs(months_between(c("a_birth"), c("b_birth")))
    pairs = _siblings(m, full(c("a_birth")) & full(c("b_birth")) & (apart >= 0.1) & (apart <= g))
    return hits(m.not_alias(pairs, "a_person_id", "b_person_id"), None, "a_person_id", "a_family_id", _two("a_birth", "b_birth"))


@rule("119", "warning", "children over too many years", 30)
def _(m, g):
    span = m.children().where("k_birth.y IS NOT NULL").groupBy("family_id").agg((F.max("k_birth.y") - F.min("k_birth.y")).alias("span"))
    return hits(span, c("span") > g, None, "family_id", c("span").cast("string"))


@rule("120", "warning", "too many children", 16)
def _(m, g):
    return hits(m.fc.groupBy("family_id").agg(F.count("*").alias("n")), c("n") > g, None, "family_id", c("n").cast("string"))


@rule("121", "warning", "too many marriages", 3)
def _(m, g):
    return hits(m.partners().groupBy("person_id").agg(F.count("*").alias("n")), c("n") > g, "person_id", detail=c("n").cast("string"))


@rule("122", "warning", "married again too soon", 2)
def _(m, g):
    again = m.marriages().join(m.p.select(c("person_id").alias("prev_other"), c("death").alias("gone")), "prev_other").join(m.p.select("person_id"), "person_id", "left_semi")
    apart = months_between(c("gone"), c("wedding"))
    return hits(again, full(c("gone")) & full(c("wedding")) & (apart >= 0) & (apart <= g), "person_id", "family_id", _two("gone", "wedding"))


@rule("123", "error", "too many children of a mother", 20)
def _(m, g):
    mine = m.fc.join(m.f.select("family_id", c("wife").alias("person_id")), "family_id").groupBy("person_id").agg(F.countDistinct("child").alias("n")).where(c("n") > g)
    return hits(mine.join(m.p.where("sex <> 'm'"), "person_id"), None, "person_id", detail=c("n").cast("string"))


@rule("124", "warning", "long gap between siblings", 12)
def _(m, g):
    dated = m.children().where("k_birth.y IS NOT NULL")
    w = Window.partitionBy("family_id").orderBy("k_birth.y", "pos")
    return hits(dated.withColumn("gap", c("k_birth.y") - F.lag("k_birth.y").over(w)), c("gap") > g, "child", "family_id", c("gap").cast("string"))


@rule("125", "error", "wedding after own full death date")
def _(m, g):
    return hits(m.partners(), full(c("death")) & full(c("wedding")) & (months_between(c("death"), c("wedding")) > 0), "person_id", "family_id", _two("death", "wedding"))


# ---- structure


def _blank(s: str = "") -> Column:
    col = lambda n: c(s + n)
    return (col("given") == "") & col("surname").isin("", "NN") & col("birth").isNull() & col("death").isNull() & (col("occupation") == "") & (col("note") == "")


def _unlinked(m, p: DataFrame) -> DataFrame:
    linked = m.f.select("husband").union(m.f.select("wife")).union(m.fc.select("child")).toDF("person_id").where("person_id IS NOT NULL").distinct()
    return p.join(linked, "person_id", "left_anti")


@rule("210", "error", "person of whom nothing is known, in no family")
def _(m, g):
    return hits(_unlinked(m, m.p.where(_blank())), None, "person_id", detail=c("role"))


@rule("211", "warning", "person in no family")
def _(m, g):
    return hits(_unlinked(m, m.p), None, "person_id", detail=F.concat_ws(" ", "given", "surname"))


@rule("212", "warning", "unknown partner in a family without children")
def _(m, g):
    return hits(m.partners().where(_blank() & (c("place") == "")).join(m.fc.select("family_id").distinct(), "family_id", "left_anti"), None, "person_id", "family_id", c("role"))


@rule("213", "error", "child of several families")
def _(m, g):
    several = m.fc.groupBy("child").agg(F.min("family_id").alias("family_id"), F.countDistinct("family_id").alias("n")).where(c("n") > 1)
    return hits(several.join(m.p, c("child") == c("person_id"), "left_semi"), None, "child", "family_id", c("n").cast("string"))


@rule("214", "error", "child and parent of one family")
def _(m, g):
    return hits(m.partners().join(m.fc.select("family_id", c("child").alias("person_id")).distinct(), ["family_id", "person_id"], "left_semi"), None, "person_id", "family_id")


@rule("215", "error", "spouses of one sex")
def _(m, g):
    return hits(m.couples(), c("h_sex").isin("m", "w") & (c("h_sex") == c("w_sex")), "husband", "family_id", c("h_sex"))


@rule("216", "error", "female father or male mother")
def _(m, g):
    return hits(m.partners(), ((c("as") == "h") & (c("sex") == "w")) | ((c("as") == "w") & (c("sex") == "m")), "person_id", "family_id", c("given"))


@rule("217", "error", "family of nobody")
def _(m, g):
    return hits(m.f.where("husband IS NULL AND wife IS NULL").join(m.fc.select("family_id").distinct(), "family_id", "left_anti"), None, None, "family_id")


@rule("218", "error", "link to a missing person")
def _(m, g):
    ends = m.f.select("family_id", "husband").union(m.f.select("family_id", "wife")).union(m.fc.select("family_id", "child")).toDF("family_id", "person_id").where("person_id IS NOT NULL")
    return hits(ends.join(m.p.select("person_id"), "person_id", "left_anti"), None, None, "family_id", c("person_id").cast("string"))


@rule("219", "warning", "same name and full birth date")
def _(m, g):
    named = m.p.where(full(c("birth")) & ~c("surname").isin("", "NN") & ~c("given").isin(*NO_NAME)).select("person_id", "given", "surname", "birth")
    a, b = named.withColumnRenamed("person_id", "a"), named.withColumnRenamed("person_id", "b")
    pairs = a.join(b, ["given", "surname", "birth"]).where("a < b")
    return hits(m.not_alias(pairs, "a", "b"), None, "a", detail=F.concat_ws(" ", "given", "surname", date_text(c("birth")), c("b")))


@rule("220", "error", "spouses are siblings")
def _(m, g):
    of = lambda x, y: m.fc.select(c("child").alias(x), c("family_id").alias(y))
    known = m.couples().select("family_id", "husband", "wife")
    sib = known.join(of("husband", "origin"), "husband").join(of("wife", "origin"), ["wife", "origin"]).where("husband <> wife").select("family_id", "husband").distinct()
    return hits(sib, None, "husband", "family_id")


@rule("221", "error", "spouses are parent and child")
def _(m, g):
    known = m.couples().select("family_id", "husband", "wife")
    parents = m.fc.join(m.f.select("family_id", c("husband").alias("pa"), c("wife").alias("ma")), "family_id").select("child", "pa", "ma")
    one = known.join(parents, c("wife") == c("child")).where("husband IN (pa, ma)").select(c("husband").alias("person_id"), "family_id")
    two = known.join(parents, c("husband") == c("child")).where("wife IN (pa, ma)").select(c("wife").alias("person_id"), "family_id")
    return hits(one.union(two), None, "person_id", "family_id")


@rule("222", "error", "married while the partner before lived")
def _(m, g):
    again = m.marriages().join(m.p.select(c("person_id").alias("prev_other"), c("death").alias("gone")), "prev_other").join(m.p.select("person_id"), "person_id", "left_semi")
    return hits(again, before(c("wedding"), c("gone")), "person_id", "family_id", _two("wedding", "gone"))


@rule("223", "warning", "spouses of one surname")
def _(m, g):
    return hits(m.couples(), (c("h_surname") != "") & (c("h_surname") != "NN") & (c("h_surname") == c("w_surname")), "husband", "family_id", c("h_surname"))


@rule("224", "warning", "two living siblings of one given name")
def _(m, g):
    known = ~c("a_given").isin(*NO_NAME) & (c("a_given") == c("b_given")) & c("a_birth").isNotNull() & c("b_birth").isNotNull()
    pairs = m.not_alias(_siblings(m, known), "a_person_id", "b_person_id")
    first = F.coalesce(before(c("a_birth"), c("b_birth")), F.lit(True))
    pick = lambda x, y, f: F.when(first, c(f"{x}_{f}")).otherwise(c(f"{y}_{f}"))
    pairs = pairs.withColumns({"late": pick("b", "a", "person_id"), "gone": pick("a", "b", "death"), "born": pick("b", "a", "birth")})
    return hits(pairs, c("gone").isNull() | before(c("born"), c("gone")), "late", "a_family_id", c("a_given"))


@rule("225", "error", "own ancestor")
def _(m, g):
    ends = m.f.select("family_id", "husband").union(m.f.select("family_id", "wife")).toDF("family_id", "parent").where("parent IS NOT NULL")
    return hits(own_ancestors(m.fc.join(ends, "family_id").select("child", "parent")), None, "person_id")


@rule("226", "warning", "one couple as two families")
def _(m, g):
    w = Window.partitionBy("husband", "wife").orderBy("family_id")
    both = m.f.where("husband IS NOT NULL AND wife IS NOT NULL").withColumns({"nr": F.row_number().over(w), "head": F.first("family_id").over(w), "dated": F.first(F.struct("wedding")).over(w)})
    first = c("dated.wedding")
    return hits(both, (c("nr") > 1) & (first.isNull() | c("wedding").isNull() | (first == c("wedding"))), None, "family_id", c("head").cast("string"))


@rule("227", "warning", "one note on two persons of an article")
def _(m, g):
    noted = m.p.where("note <> '' AND article IS NOT NULL").select("person_id", "article", "birth", "note")
    parts = noted.withColumn("part", F.explode(F.split("note", ";"))).withColumn("part", F.trim("part")).where(F.length("part") > 12)
    other = noted.select(c("article").alias("o_article"), c("person_id").alias("o_id"), c("birth").alias("o_birth"), c("note").alias("o_note"))
    twins = F.coalesce(c("birth") == c("o_birth"), F.lit(False))
    same = parts.join(other, (c("article") == c("o_article")) & (c("person_id") < c("o_id")) & F.contains(c("o_note"), c("part")) & ~twins, "left_semi")
    return hits(same, None, "person_id", detail=F.substring("part", 1, 70))


# ---- fields


def _says(column: str, pattern: str) -> Column:
    return F.regexp_like(c(column), F.lit(pattern))


@rule("310", "error", "female call name as surname")
def _(m, g):
    return hits(m.p, c("surname").isin(*FEMALE_CALL_NAMES), "person_id", detail=c("surname"))


@rule("311", "error", "phrase for a name")
def _(m, g):
    return hits(m.p, _says("given", PHRASE_GIVEN) | _says("surname", PHRASE_SURNAME), "person_id", detail=F.concat_ws(" / ", "given", "surname"))


@rule("312", "error", "place in the given name")
def _(m, g):
    return hits(m.p, _says("given", PLACE_GIVEN), "person_id", detail=c("given"))


@rule("313", "error", "words glued together")
def _(m, g):
    return hits(m.p, _says("surname", GLUED) | _says("given", GLUED), "person_id", detail=F.concat_ws(" / ", "given", "surname"))


@rule("314", "error", "several surnames")
def _(m, g):
    return hits(m.p, _says("surname", SEVERAL_SURNAMES) & ~_says("surname", SURNAME_PARTICLE), "person_id", detail=c("surname"))


@rule("315", "error", "date in a name")
def _(m, g):
    return hits(m.p, _says("given", DATE_IN_NAME) | _says("surname", DATE_IN_NAME), "person_id", detail=F.concat_ws(" / ", "given", "surname"))


@rule("316", "warning", "name as occupation")
def _(m, g):
    return hits(m.p, _says("occupation", NAME_AS_OCCUPATION), "person_id", detail=c("occupation"))


@rule("317", "error", "words of the process in a note")
def _(m, g):
    detail = F.substring("note", 1, 80)
    return hits(m.p, _says("note", PROCESS_WORDS), "person_id", detail=detail).union(hits(m.f, _says("note", PROCESS_WORDS), None, "family_id", detail))


@rule("318", "warning", "place phrase in the surname")
def _(m, g):
    return hits(m.p, _says("surname", PLACE_SURNAME), "person_id", detail=c("surname"))


@rule("319", "warning", "partner of unknown sex")
def _(m, g):
    return hits(m.partners(), c("sex") == "u", "person_id", "family_id", F.concat_ws(" ", "given", "surname"))


def _words(column: str) -> Column:
    return F.regexp_extract_all(c(column), F.lit(NAME_WORD), F.lit(0))


@rule("320", "error", "rejected form in the given name")
def _(m, g):
    if m.rejected_given is None:
        return hits(m.p, F.lit(False))
    words = m.p.select("person_id", F.explode(F.array_distinct(_words("given"))).alias("word"))
    return hits(words.join(m.rejected_given, "word", "left_semi").groupBy("person_id").agg(F.concat_ws(", ", F.array_sort(F.collect_set("word"))).alias("words")), None, "person_id", detail=c("words"))


@rule("321", "warning", "bracket in the given name that holds no name")
def _(m, g):
    bracketed = m.p.where(F.contains("given", F.lit("(")) | F.contains("given", F.lit(")")))
    inside = F.regexp_extract_all(F.array_join(F.regexp_extract_all(c("given"), F.lit(r"\(([^)]*)\)?"), F.lit(1)), " "), F.lit(NAME_WORD), F.lit(0))
    words = bracketed.select("person_id", F.explode_outer(inside).alias("word"))
    if m.confirmed_given is not None:
        words = words.join(m.confirmed_given.withColumn("known", F.lit(1)), "word", "left")
    else:
        words = words.withColumn("known", F.lit(None).cast("int"))
    fine = words.groupBy("person_id").agg(F.every(c("known").isNotNull()).alias("fine"))
    return hits(bracketed.join(fine, "person_id"), ~c("fine"), "person_id", detail=c("given"))


@rule("322", "error", "place as surname that heads no article")
def _(m, g):
    if m.places is None:
        return hits(m.p, F.lit(False))
    heads = m.p.where("role = 'kopf'").select("surname")
    if heads.isEmpty():
        heads = m.partners().where("sex = 'm'").select("surname")
    named = m.p.where("surname <> ''").join(m.places.select(c("word").alias("surname")), "surname", "left_semi")
    return hits(named.join(heads.distinct(), "surname", "left_anti"), None, "person_id", detail=c("surname"))


@rule("323", "error", "rejected form as surname")
def _(m, g):
    if m.rejected_surname is None:
        return hits(m.p, F.lit(False))
    return hits(m.p.where("surname <> ''").join(m.rejected_surname.select(c("word").alias("surname")), "surname", "left_semi"), None, "person_id", detail=c("surname"))


@rule("410", "warning", "age in the text contradicts the dates", 1)
def _(m, g):
    return hits(m.p, F.abs(years_between(c("birth"), c("death")) - c("text_age")) > g, "person_id", detail=_two("birth", "death"))


@rule("411", "error", "merged person with two death dates")
def _(m, g):
    if m.merged is None:
        return hits(m.p, F.lit(False))
    bare = lambda x: F.regexp_replace(F.coalesce(c(x), F.lit("")), r"\s+", "")
    day = r"^(\d{1,2})\.(\d{1,2})\.?(1[3-9]\d\d)$"
    both = F.regexp_like(bare("death_a"), F.lit(day)) & F.regexp_like(bare("death_b"), F.lit(day))
    return hits(m.merged, both & (bare("death_a") != bare("death_b")), "person_id", detail=F.concat_ws(" / ", "death_a", "death_b"))


def run_rules(m: Model, ids: list[str] | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """Hits of all (or the named) rules: rule, severity, person_id, family_id, detail."""
    out = None
    for r in CATALOGUE.values():
        if ids is None or r.id in ids:
            found = r.run(m, (limits or {}).get(r.id, r.limit)).select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "*")
            out = found if out is None else out.union(found)
    return out
