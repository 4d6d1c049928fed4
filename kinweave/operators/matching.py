"""Schema matching: which register a sheet holds, and which field a heading means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col

#: Roles of each register and of each role, the words that name them, the words that name a register.
MAIN_ROLES = {"taufe": ["kind", "vater", "mutter"], "ehe": ["braeutigam", "braut"], "tod": ["verstorbener"]}
SUB_ROLES = {"kind": [], "vater": [], "mutter": ["vater", "mutter"], "braeutigam": ["vater", "mutter", "vorehe"], "braut": ["vater", "mutter", "vorehe"], "verstorbener": ["vater", "mutter", "ehepartner"]}
DEFAULT_ROLE = {"taufe": "kind", "ehe": None, "tod": "verstorbener"}
ROLE_WORDS = {
    "kind": ["kind", "täufling", "taeufling", "child"], "vater": ["vater", "father"], "mutter": ["mutter", "mother"],
    "braeutigam": ["bräutigam", "brätigam", "braeutigam", "braeu", "groom", "husband"], "braut": ["braut", "bride", "wife"],
    "verstorbener": ["verstorbener", "verstorbene", "verst", "deceased"],
    "ehepartner": ["ehepartner", "ehemann", "ehefrau", "gatte", "gattin", "ehepart", "spouse"],
    "vorehe": ["vormann", "vorfrau", "voriger", "vorige", "erster", "erste", "previous"],
}
REGISTER_WORDS = {
    "taufe": ["tauf", "pate", "baptism", "christ", "täufling", "kind", "geburt", "geb"],
    "ehe": ["braut", "brätigam", "bräutigam", "braeu", "trau", "heirat", "ehe", "marriage", "groom", "bride", "hochzeit"],
    "tod": ["sterbe", "beerd", "begr", "verst", "tod", "tote", "grab", "burial", "death", "krankheit", "famstand", "alter"],
}
#: Attributes of a role as (name, kind, synonyms); the empty name is a whole person in one cell.
ATTRIBUTES = (
    ("", "person", []), ("name", "text", ["name", "nachname", "familienname", "fn", "surname", "last name"]),
    ("vorname", "text", ["vorname", "vornamen", "vn", "given", "given name", "first name", "rufname"]), ("geschlecht", "geschlecht", ["geschlecht", "geschl", "sex", "gender"]),
    ("beruf", "text", ["beruf", "stand", "beruf u herkunft", "beruf herkunft", "occupation", "profession"]), ("beruf_ort", "ort", ["ort beruf", "beruf ort", "wirkungsort"]),
    ("herkunft", "ort", ["herkunft", "wohnort", "ort", "aus", "von", "ort herkunft", "origin", "residence"]), ("alter", "alter", ["alter", "age"]),
    ("geburt_datum", "datum", ["geb datum", "geburtsdatum", "geboren", "geb", "dat geburt", "birth", "born"]), ("geburt_ort", "ort", ["geb ort", "geburtsort", "ort geburt", "birthplace"]),
    ("stand", "text", ["familienstand", "famstand", "status", "marital"]), ("konfession", "text", ["konfession", "religion", "rel"]), ("verzogen", "ort", ["verzogen", "weggezogen", "moved"]),
    ("totgeburt", "text", ["art tod", "totgeburt", "todgeburt", "stillborn"]), ("bemerkung", "text", ["notiz", "bemerkung", "anmerkung", "note", "notes"]), ("ref", "text", ["ref", "referenz", "xref", "kennung", "id"]),
)
_SUB = ("", "name", "vorname", "beruf", "beruf_ort", "herkunft", "stand", "bemerkung", "ref")
ATTRIBUTES_OF = {
    "kind": ("", "name", "vorname", "geschlecht", "verzogen", "totgeburt", "bemerkung", "ref"), "vater": ("", "name", "vorname", "beruf", "beruf_ort", "herkunft", "stand", "konfession", "bemerkung", "ref"),
    "mutter": ("", "name", "vorname", "beruf", "herkunft", "stand", "konfession", "bemerkung", "ref"),
    "braeutigam": ("", "name", "vorname", "beruf", "beruf_ort", "herkunft", "alter", "geburt_datum", "geburt_ort", "stand", "konfession", "bemerkung", "ref"),
    "braut": ("", "name", "vorname", "beruf", "beruf_ort", "herkunft", "alter", "geburt_datum", "geburt_ort", "stand", "konfession", "bemerkung", "ref"),
    "verstorbener": ("", "name", "vorname", "geschlecht", "beruf", "beruf_ort", "herkunft", "alter", "stand", "konfession", "bemerkung", "ref"),
    "ehepartner": ("", "name", "vorname", "geschlecht", "beruf", "beruf_ort", "bemerkung", "ref"), "vorehe": ("", "name", "vorname", "beruf", "beruf_ort", "herkunft", "bemerkung", "ref"),
}
#: Fields without a role, of all registers and of each.
GENERAL = (
    ("ort", "ort", ["ort", "pfarrei", "parochie", "gemeinde", "kirche", "church", "parish"]), ("konfession", "text", ["konfession", "religion", "rel"]), ("kb", "text", ["kb", "kirchenbuch", "buch", "band", "quelle", "source", "register"]),
    ("seite", "zahl", ["seite", "s", "page", "blatt", "bild"]), ("lfd_nr", "zahl", ["lfd nr", "lfdnr", "nr", "nummer", "no", "lfd"]), ("lfd_nr_gesamt", "zahl", ["lfd nr gesamt", "id", "nr gesamt", "zähler"]),
    ("zitat", "text", ["zitat", "fundstelle", "citation"]), ("jahr", "zahl", ["jahr", "year"]), ("pfarrer", "text", ["pfarrer", "taufender", "trauender", "geistlicher", "minister", "priest"]),
    ("bemerkung", "text", ["bemerkung", "bemerkungen", "bem", "anmerkung", "notiz", "randvermerk", "note", "notes", "remarks"]),
    ("wortlaut", "text", ["wortlaut", "umschrift", "transkription", "abschrift", "volltext", "eintragstext", "transcription", "transcript"]),
)
OWN = {
    "taufe": (
        ("geburt_datum", "datum", ["geb datum", "geburtsdatum", "geboren", "geb", "dat geburt", "birth", "born"]), ("tauf_datum", "datum", ["tauf datum", "taufdatum", "taufe", "getauft", "dat taufe", "baptism", "christening"]),
        ("geburt_ort", "ort", ["geb ort", "geburtsort", "ort geburt", "birthplace"]), ("tauf_ort", "ort", ["tauf ort", "taufort", "ort taufe"]), ("unehelich", "text", ["unehelich", "status kind", "ehelich", "illegitimate"]),
        ("paten", "liste", ["pate", "paten", "taufpate", "taufpaten", "taufzeuge", "taufzeugen", "godparent", "godparents", "sponsor"]),
        ("sterbe_datum_rv", "datum", ["sterbe dat", "sterbedatum", "gestorben", "gest", "dat tod", "tod", "death"]), ("sterbe_ort_rv", "ort", ["ort tod", "sterbeort"]), ("todesursache_rv", "text", ["ursache tod", "todesursache", "krankheit"]),
    ),
    "ehe": (
        ("trauung_datum", "datum", ["datum", "trauung", "trauungsdatum", "heirat", "heiratsdatum", "getraut", "kopuliert", "dat trauung", "marriage", "date"]), ("trauung_ort", "ort", ["ort der trauung", "trauungsort", "ort trauung", "place"]),
        ("proklamation", "text", ["proklamation", "aufgebot", "banns"]), ("zeugen", "liste", ["zeuge", "zeugen", "trauzeuge", "trauzeugen", "witness", "witnesses"]),
    ),
    "tod": (
        ("sterbe_datum", "datum", ["sterbe dat", "sterbedatum", "gestorben", "todesdatum", "tod", "dat tod", "death", "died"]), ("begraebnis_datum", "datum", ["beerd datum", "beerdigung", "begräbnis", "begraebnis", "begraben", "dat grab", "grab", "burial", "buried"]),
        ("sterbe_ort", "ort", ["sterbeort", "ort tod"]), ("begraebnis_ort", "ort", ["begräbnisort", "ort grab", "friedhof"]), ("geburt_datum_rv", "datum", ["geb datum", "geburtsdatum", "geboren", "dat geburt", "birth"]),
        ("tauf_datum_rv", "datum", ["tauf dat", "taufdatum", "baptism"]), ("todesursache", "text", ["krankheit", "todesursache", "ursache", "ursache tod", "cause"]), ("zeugen", "liste", ["zeuge", "zeugen", "witness"]),
    ),
}


def fields_of(register: str) -> list[tuple[str, str | None, str, list[str]]]:
    """(name, role path, kind, synonyms) of a register's fields: roles first, then its own fields, then those of all registers; a field without a role has no path. Partners and former marriages have fields of their own, other sub-roles one list."""
    kinds = {name: (kind, syn) for name, kind, syn in ATTRIBUTES}
    out = []
    for role in MAIN_ROLES[register]:
        for path, names in [(role, ATTRIBUTES_OF[role]), *((f"{role}_{sub}", ATTRIBUTES_OF.get(sub if sub in ("ehepartner", "vorehe") else "", _SUB)) for sub in SUB_ROLES[role])]:
            out += [(f"{path}_{n}" if n else path, path, *kinds[n]) for n in names]
    return out + [(n, None, k, s) for n, k, s in (*OWN[register], *GENERAL)]


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as rows: register, place, name, path, kind, synonyms (arrays of words). A few hundred rows, made of constants."""
    rows = [(r, i, n, p, k, [s.split() for s in syn]) for r in MAIN_ROLES for i, (n, p, k, syn) in enumerate(fields_of(r))]
    return spark.createDataFrame(rows, "register string, place int, name string, path string, kind string, synonyms array<array<string>>")


def normal(text: Column) -> Column:
    """A heading made comparable: lower case, ß as ss, nothing but letters, digits and single blanks; v. Mann is vormann."""
    t = F.regexp_replace(F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit("_"), F.lit(" ")), r"(?U)\W+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<![^ ])v (mann|ehemann)(?![^ ])", "vormann"), r"(?<![^ ])v (frau|ehefrau)(?![^ ])", "vorfrau")
    return F.trim(F.regexp_replace(t, " +", " "))


def is_snake(text: Column) -> Column:
    return F.contains(text, F.lit("_")) & ~F.contains(F.trim(text), F.lit(" "))


def detect_register(sheets: DataFrame, key: str = "sheet") -> DataFrame:
    """(key, register) of sheets (key, sheet, file, headings array): the register whose words the names and headings carry most often; null if none."""
    words = F.split(F.concat_ws(" ", normal(c("sheet")), normal(c("file")), F.array_join(F.transform("headings", normal), " ")), " ")
    def points(register: str) -> Column:
        ws = REGISTER_WORDS[register]
        per = lambda t: sum(((t == w) | (F.startswith(t, F.lit(w)) if len(w) >= 4 else F.lit(False))).cast("int") for w in ws)
        start = F.substring(normal(c("sheet")), 1, 4).isin(*[w[:4] for w in ws if len(w) >= 4])
        return F.aggregate(words, F.lit(0), lambda s, t: s + per(t)) + F.when(start, 3).otherwise(0)

    p = {r: points(r) for r in REGISTER_WORDS}
    best = F.greatest(*p.values())
    pick = F.when(best == 0, None)
    for r in REGISTER_WORDS:
        pick = pick.when(p[r] == best, r)
    return sheets.select(key, pick.alias("register"))


def role_of(token: Column) -> Column:
    """The role that a word names, by itself or as a beginning of five letters or more; null if none."""
    out = F.lit(None).cast("string")
    for role, words in reversed(ROLE_WORDS.items()):
        fits = token.isin(*words)
        for w in words:
            if len(w) >= 5:
                fits = fits | F.startswith(token, F.lit(w))
        out = F.when(fits, role).otherwise(out)
    return out


def role_path(headings: DataFrame) -> DataFrame:
    """``headings`` (register, heading, context) with path, main, rest, words, suffix.

    The path is the main role and, if it may have it, a sub-role; technical headings name the main role last. A sub-role alone
    belongs to the register's default role, else to the one carried along.
    """
    words = F.filter(F.split(normal(c("heading")), " "), lambda w: (w != "") & ~F.regexp_like(w, F.lit(r"^\d+$")))
    h = headings.withColumn("words", words)
    suffix = F.when(F.size("words") > 1, F.when(F.array_contains("words", "kb"), "kb").when(F.array_contains("words", "praefix"), "praefix"))
    h = h.withColumn("suffix", suffix).withColumn("words", F.when(c("suffix").isNotNull(), F.array_remove("words", c("suffix"))).otherwise(c("words")))
    h = h.withColumn("roles", F.filter(F.transform("words", role_of), lambda r: r.isNotNull())).withColumn("rest", F.filter("words", lambda w: role_of(w).isNull()))
    mains = F.lit(None).cast("array<string>")
    default = F.lit(None).cast("string")
    for r in MAIN_ROLES:
        mains = F.when(c("register") == r, F.array(*map(F.lit, MAIN_ROLES[r]))).otherwise(mains)
        default = F.when(c("register") == r, F.lit(DEFAULT_ROLE[r])).otherwise(default)
    h = h.withColumns({"m": F.filter("roles", lambda r: F.array_contains(mains, r)), "u": F.filter("roles", lambda r: ~F.array_contains(mains, r))})
    several = F.size("m") >= 2
    top = F.when(several & is_snake(c("heading")), F.element_at("m", -1)).when(F.size("m") >= 1, F.get("m", F.lit(0))).when(F.size("u") >= 1, F.coalesce(default, c("context")))
    sub = F.when(several & is_snake(c("heading")), F.get("m", F.lit(0))).when(several, F.get("m", F.lit(1))).otherwise(F.get("u", F.lit(0)))
    h = h.withColumns({"main": top, "sub": sub})
    allowed = F.lit(False)
    for role, subs in SUB_ROLES.items():
        if subs:
            allowed = allowed | ((c("main") == role) & c("sub").isin(*subs))
    path = F.when(c("main").isNotNull(), F.when(F.coalesce(allowed, F.lit(False)), F.concat_ws("_", "main", "sub")).otherwise(c("main")))
    return h.withColumn("path", path).withColumn("default", default).drop("roles", "m", "u", "sub")


def synonym_points(rest: Column, synonyms: Column) -> Column:
    """The best of a field's synonyms: 3 for the very words, 2.1 and more if all of it is there, 1.5 for a common beginning of four letters."""
    def one(s: Column) -> Column:
        first = F.get(s, F.lit(0))
        begins = F.exists(rest, lambda t: (F.length(t) >= 4) & (F.startswith(t, first) | F.startswith(first, t)))
        return F.when(s == rest, 3.0).when(F.forall(s, lambda t: F.array_contains(rest, t)), 2 + 0.1 * F.size(s)).when((F.size(s) == 1) & (F.length(first) >= 4) & begins, 1.5).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(synonyms, one)), F.lit(0.0))


def guess_fields(headings: DataFrame, fields: DataFrame) -> DataFrame:
    """(heading key columns, field, points, kind, main): the best field of each heading (register, heading, context and a key ``id``).

    Each heading meets its register's fields, a few hundred constants, in a broadcast join.
    """
    h = role_path(headings)
    met = h.join(F.broadcast(fields.withColumnRenamed("path", "field_path")), "register")
    whole = c("name") == c("field_path")
    plain = synonym_points(c("rest"), c("synonyms"))
    wide = F.when(c("field_path").isNull(), F.greatest(plain, synonym_points(c("words"), c("synonyms")))).otherwise(plain)
    with_role = F.when(c("path") == c("field_path"), wide + 1).when(c("path").isNotNull(), None).when(c("field_path") == F.coalesce("default", "context"), wide + 0.3).otherwise(wide - 1)
    without = F.when(c("path").isNotNull() & ~c("path").eqNullSafe(c("default")), wide - 1.5).when((wide >= 3) & c("path").isNull(), wide + 0.5).otherwise(wide)
    points = F.when(whole, F.when(c("path") == c("field_path"), F.when(F.size("rest") == 0, 4.0).otherwise(2.0))).when(wide > 0, F.when(c("field_path").isNotNull(), with_role).otherwise(without))
    ranked = met.withColumn("points", points).where("points IS NOT NULL").withColumn("nr", F.row_number().over(Window.partitionBy("id").orderBy(c("points").desc(), "place")))
    best = ranked.where("nr = 1").select("id", F.concat_ws("_", "name", "suffix").alias("field"), F.round("points", 6).alias("points"), "kind")
    return h.select("id", "heading", "main").join(best, "id", "left")


def confidence(points: Column, kind: Column, samples: Column) -> Column:
    """sicher, wahrscheinlich or unsicher, by points; unsicher if samples of a date or number field don't look like one."""
    date = r"^\d{4}(-\d{2}(-\d{2})?)?$|^\d{1,2}\.\d{1,2}\.\d{4}$"
    odd = lambda p: (F.size(samples) > 0) & ~F.forall(samples, lambda s: F.regexp_like(s, F.lit(p)))
    return F.when((kind == "datum") & odd(date), "unsicher").when((kind == "zahl") & odd(r"^\d+$"), "unsicher").when(points >= 3, "sicher").when(points >= 2, "wahrscheinlich").otherwise("unsicher")


def sample_profile(cells: DataFrame, n: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, col, samples, filled) of cells (keys, col, row, value): the first n different values of each column, cut to 40 characters, and how many cells are filled."""
    of = [*keys, "col"]
    filled = cells.where("value IS NOT NULL AND value <> ''")
    first = filled.groupBy(*of, "value").agg(F.min("row").alias("row"), F.count("*").alias("k"))
    w = Window.partitionBy(*of).orderBy("row", "value")
    ranked = first.withColumn("nr", F.row_number().over(w))
    samples = F.transform(F.array_sort(F.collect_list(F.when(c("nr") <= n, F.struct("nr", F.substring("value", 1, 40).alias("v"))))), lambda s: s["v"])
    return ranked.groupBy(*of).agg(samples.alias("samples"), F.sum("k").alias("filled"))


def blank_words(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, word, n): short values (keys, value) that stand for nothing: only dashes and the like, k.A., or N / NN if seen twice."""
    t = F.trim("value")
    short = cells.select(*keys, t.alias("word")).where((F.length("word") > 0) & (F.length("word") <= 5) & ~F.regexp_like("word", F.lit(r"^\d+$")))
    seen = short.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    mark = F.regexp_like("word", F.lit(r"^[-—–?.\[\]()…/ ]+$"))
    return seen.where(mark | F.regexp_like("word", F.lit(r"(?i)^k\.?\s?a\.?$")) | (F.regexp_like("word", F.lit(r"(?i)^n\.?n?\.?$")) & (c("n") >= 2)))


def carried_role(headings: DataFrame, pos: str = "pos", keys: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """``headings`` (keys, pos, main) with context: the last main role named to the left in the sheet."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return headings.withColumn("context", F.last("main", ignorenulls=True).over(w))


def fold_runs(columns: DataFrame) -> DataFrame:
    """(sheet, first_pos, last_pos, field, n): neighbouring columns (sheet, pos, field) of one field become one run (gaps and islands)."""
    w = Window.partitionBy("sheet").orderBy("pos")
    per_field = Window.partitionBy("sheet", "field").orderBy("pos")
    island = columns.withColumn("island", F.row_number().over(w) - F.row_number().over(per_field))
    return island.groupBy("sheet", "field", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).drop("island")


#: The dates that an entry is dated by, for each register.
LEAD_DATES = {"taufe": ["geburt_datum", "tauf_datum"], "ehe": ["trauung_datum"], "tod": ["sterbe_datum", "begraebnis_datum"]}
_SHEET = ("file", "sheet")


def numbered_runs(columns: DataFrame, keys: tuple[str, ...] = _SHEET) -> DataFrame:
    """``columns`` (keys, col, heading, field) with ``first``: the column that a run of numbered headings ("Taufpate 1", "Taufpate 2", …) begins with, of others their own.

    Neighbours whose headings are alike but for the number at their end are a run. It begins with the first of them that has a field, which is the field of all;
    those before it stay alone.
    """
    number, base = F.regexp_like(F.trim("heading"), F.lit(r"\d$")), normal(F.regexp_replace("heading", r"\d+\s*$", ""))
    w = Window.partitionBy(*keys).orderBy("col")
    cols = columns.withColumn("_stem", F.when(number, base)).withColumn("_new", F.when(F.lag("_stem").over(w).eqNullSafe(c("_stem")) & c("_stem").isNotNull(), 0).otherwise(1))
    cols = cols.withColumn("_island", F.sum("_new").over(w))
    start = F.min(F.when(c("field").isNotNull(), c("col"))).over(Window.partitionBy(*keys, "_island"))
    return cols.withColumn("first", F.when(c("_stem").isNotNull() & (start <= c("col")), start).otherwise(c("col"))).drop("_stem", "_new", "_island")


def propose(cells: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """What the columns of all sheets are taken for: file, sheet, register, first, last (columns), field, confidence, heading, samples, filled.

    ``cells`` has file, sheet, row, col, value; headings stand in row 1. ``spoken`` (file, sheet, register) tells the register of sheets whose words don't, else it is found; a sheet of no register
    is left out. A heading without a role belongs to the role named last to its left. Of several running numbers the one that gets highest is the total. field is null where nothing fits, and a column whose heading is
    missing isn't there. All sheets are worked on at once; the cells are read twice, for headings and for samples of whole columns.
    """
    heads = cells.where("row = 1 AND trim(value) <> ''").select(*_SHEET, "col", c("value").alias("heading"))
    if spoken is None:
        sheets = heads.groupBy(*_SHEET).agg(F.sort_array(F.collect_list(F.struct("col", "heading")))["heading"].alias("headings"))
        stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")
        named = sheets.select(F.struct("file", c("sheet").alias("name")).alias("at"), "sheet", stem.alias("file"), "headings")
        spoken = detect_register(named, "at").select("at.file", c("at.name").alias("sheet"), "register")
    heads = heads.join(spoken.where("register IS NOT NULL").select(*_SHEET, "register"), list(_SHEET))
    # What a heading says of itself: a sub-role alone names the default role, or leaves the carried one as it is.
    alone = role_path(heads.withColumn("context", F.lit(None).cast("string"))).select(*_SHEET, "col", "heading", "register", "main")
    ids = carried_role(alone, "col", _SHEET).withColumn("id", F.struct(*_SHEET, "col"))
    found = guess_fields(ids, catalogue(cells.sparkSession)).select("id.*", "field", "points", "kind")
    profile = sample_profile(cells.where("row > 1").withColumn("value", F.replace("value", F.lit("\n"), F.lit(" "))), keys=_SHEET)
    none = F.array().cast("array<string>")
    cols = ids.drop("id", "context", "main").join(found, [*_SHEET, "col"]).join(profile, [*_SHEET, "col"], "left").withColumns({"samples": F.coalesce("samples", none), "filled": F.coalesce("filled", F.lit(0))})
    kind = F.when(F.endswith("field", F.lit("_praefix")), "text").otherwise(c("kind"))
    cols = numbered_runs(cols.withColumn("confidence", F.when(c("field").isNotNull(), confidence(c("points"), kind, c("samples")))))
    at_first = lambda x: F.min_by(x, "col").alias(x)
    runs = cols.groupBy(*_SHEET, "register", "first").agg(F.max("col").alias("last"), *map(at_first, ("field", "confidence", "heading", "samples", "filled")))
    numbers = F.transform("samples", lambda s: F.trim(s).try_cast("long"))
    most = F.when((c("field") == "lfd_nr") & (F.size("samples") > 0) & F.forall(numbers, lambda n: n.isNotNull()), F.array_max(numbers)).otherwise(0)
    per = Window.partitionBy(*_SHEET, c("field") == "lfd_nr")
    nr = F.row_number().over(per.orderBy(most.desc(), "first"))
    total = (c("field") == "lfd_nr") & (nr == 1) & (F.count("*").over(per) > 1)
    return runs.withColumn("field", F.when(total, "lfd_nr_gesamt").otherwise(c("field"))).select(*_SHEET, "register", "first", "last", "field", "confidence", "heading", "samples", "filled")


def as_mapping(proposal: DataFrame, blanks: DataFrame | None = None) -> list[dict]:
    """A proposal (see :func:`propose`) as :func:`kinweave.sources.tables.dump_mapping` writes it; ``blanks`` has word. Headings of sheets are metadata, and reach the driver as those of a mapping do."""
    words = sorted({r.word for r in blanks.select("word").distinct().collect()}) if blanks is not None else []
    out: dict[tuple, dict] = {}
    for r in proposal.orderBy(*_SHEET, "first").collect():
        s = out.setdefault((r.file, r.sheet), {"name": r.sheet, "file": r.file.rsplit("/", 1)[-1], "register": r.register, "blanks": words, "lead": LEAD_DATES[r.register], "fields": [], "comments": {}, "open": []})
        seen = " | ".join(r.samples) or "(leer)"
        if r.field:
            s["fields"].append((r.field, list(range(r.first, r.last + 1)), None))
            s["comments"][r.first] = f"{r.confidence}: {r.heading.strip()}: {seen}"
        else:
            s["open"].append((r.first, f"{'unbekannt' if r.filled else 'leer'}: {r.heading.strip()}" + (f": {seen}" if r.filled else "")))
    return list(out.values())
