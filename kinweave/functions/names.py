"""Names: canonical given names, similarity, points, markers of a person's cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonetic import koelner, let

#: Spelling variants of given names.
VARIANTS = {
    "johannes": "johann", "joannes": "johann", "johan": "johann", "georgius": "georg", "jacobus": "jacob", "jakobus": "jacob", "jakob": "jacob",
    "nicolaus": "nikolaus", "conrad": "konrad", "carl": "karl", "caspar": "kaspar", "catharina": "katharina", "christoph": "kristof",
    "christof": "kristof", "christina": "kristina", "christine": "kristina", "christian": "kristian", "hans": "johann", "hanß": "johann",
    "hanss": "johann", "hanns": "johann", "jerg": "georg", "jörg": "georg", "görg": "georg", "jeorg": "georg", "jeorgius": "georg",
    "petrus": "peter", "petri": "peter", "fridrich": "friedrich", "friderich": "friedrich", "friederich": "friedrich",
    "friderica": "friederike", "friederika": "friederike", "friedrika": "friederike", "friederica": "friederike", "luisa": "luise",
    "louise": "luise", "elisabetha": "elisabeth", "katarina": "katharina", "margretha": "margaretha", "margarete": "margaretha",
    "magdalene": "magdalena", "dorothee": "dorothea", "sophie": "sophia", "marie": "maria", "rosine": "rosina", "regine": "regina",
}

#: Spelling rules for given names, applied in this order (Java expressions).
SPELLING = (
    (r"(?<=...)(?:ius|ii)$|(?<=..[^aeiouäöü])us$", ""), (r"(?<!s)c(?=[aou])", "k"), ("ck", "k"), ("th", "t"), ("ph", "f"), ("y", "i"),
    ("ie", "i"), (r"(.)\1", "$1"), ("dt$", "t"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ß", "ss"), ("(?<=[^aeiou])a$", "e"),
)

#: Given names, in canonical form, that nearly everybody bears as a second one: Johann, Anna, Maria.
FILLERS = ("johan", "ane", "maria")

#: Nouns that tell a sex, and words that tell a marital status.
SEX_NOUNS = {"mädchen": "F", "töchterlein": "F", "tochter": "F", "knabe": "M", "söhnlein": "M", "sohn": "M", "knäblein": "M"}
MARITAL = (("ehe", "witw|verh|ehe|hausfrau|weib|uxor|vidu"), ("ledig", "ledig|jungfr|jungges|gesell|virgo"), ("kind", "s[äa]ugl|kind|knab|m[äa]dchen|s[öo]hn|t[öo]chter|infans|puer"))

#: Given names of men and of women, in lower case.
MALE = """johann hans georg michael martin jacob jakob christian christoph andreas friedrich adam bernhard
david daniel philipp peter paul konrad conrad leonhard ludwig matthias matthäus nicolaus nikolaus sebastian simon
stephan stefan tobias valentin wilhelm wolf wolfgang zacharias kaspar caspar melchior balthasar gottfried gottlieb
josef joseph karl carl heinrich ernst ferdinand franz lorenz benedikt bartholome bartholomäus jörg ulrich albrecht
alexander anton august eberhard erhard friedlieb israel johannes markus marcus nikolaus vollrad""".split()
FEMALE = """anna maria margaretha margarete katharina catharina elisabeth elisabetha barbara eva susanna susanne
christina christine dorothea dorothee magdalena agnes ursula rosina regina sabina judith juliana sophia sophie
friederike friederika friderica friedrika johanna justina lucia sara sarah salome helena helene anastasia apollonia
cordula felicitas gertrud hedwig kunigunde kunigunda ottilia sibylla sibilla veronica veronika agatha agathe
brigitte brigitta clara klara eleonora eleonore luisa luise louise eberhardina francisca franziska wilhelmina
wilhelmine augusta auguste karoline caroline charlotte amalia amalie philippina ernestina""".split()

#: Particles of a surname.
PARTICLE = "von der|von dem|von|zu|de|v\\."

_WORD = r"(?U)\W"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def given_canon(given: Column) -> Column:
    """The canonical form of given names, words parted by blanks; empty for null or empty."""
    words = F.split(F.trim(F.lower(F.coalesce(given, F.lit("")))), r"[\s-]+")
    table = _lookup(VARIANTS)

    def canonical(w: Column) -> Column:
        w = F.regexp_replace(w, _WORD, "")
        w = F.coalesce(F.try_element_at(table, w), w)
        for pattern, put in SPELLING:
            w = F.regexp_replace(w, pattern, put)
        return w

    return F.array_join(F.filter(F.transform(words, canonical), lambda w: w != ""), " ")


def distance(a: Column, b: Column) -> Column:
    """Edit distance, ignoring case; null counts as empty."""
    return F.levenshtein(F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit(""))))


def _filled(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")


def close_spelling(a: Column, b: Column) -> Column:
    """At most one letter apart, or two for names of seven letters and the same first three."""
    d = distance(a, b)
    same = F.lower(F.substring(a, 1, 3)) == F.lower(F.substring(b, 1, 3))
    return _filled(a, b) & ((F.lower(a) == F.lower(b)) | (d <= 1) | ((d == 2) & (F.greatest(F.length(a), F.length(b)) >= 7) & same))


def names_similar(a: Column, b: Column, key_a: Column | None = None, key_b: Column | None = None) -> Column:
    """Close in spelling, or of one phonetic key; false if either is missing."""
    keys = (koelner(a) if key_a is None else key_a) == (koelner(b) if key_b is None else key_b)
    return _filled(a, b) & (close_spelling(a, b) | keys)


def near_name(a: Column, b: Column) -> Column:
    """Similar, and not further apart than two letters, or a third of ``a``, the identity's name."""
    return names_similar(a, b) & (distance(a, b) <= F.greatest(F.lit(2), F.floor(F.length(a) / 3)))


def given_points(a: Column, b: Column) -> Column:
    """How well canonical given names agree: 100 equal; one name against several 90 if it comes first (60 a filler), 80 if later (40); several against several 70 if two are common; else 0. Null if either is missing."""
    x, y = F.split(a, " "), F.split(b, " ")
    one = F.when(F.size(x) == 1, F.element_at(x, 1)).otherwise(F.element_at(y, 1))
    many = F.when(F.size(x) == 1, y).otherwise(x)
    filler = one.isin(*FILLERS)
    single = F.when(one == F.element_at(many, 1), F.when(filler, 60).otherwise(90)).when(F.array_contains(many, one), F.when(filler, 40).otherwise(80)).otherwise(0)
    common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    return F.when(_filled(a, b), F.when(a == b, 100).when((F.size(x) == 1) | (F.size(y) == 1), single).when(common >= 2, 70).otherwise(0))


def given_contradiction(a: Column, b: Column) -> Column:
    """Both known, and no name in common."""
    return _filled(a, b) & ~F.coalesce(F.arrays_overlap(F.split(a, " "), F.split(b, " ")), F.lit(False))


def marital_kind(status: Column) -> Column:
    """ehe, ledig, kind or null, by the first family of words that the status carries."""
    s, out = F.lower(F.coalesce(status, F.lit(""))), F.lit(None).cast("string")
    for kind, pattern in reversed(MARITAL):
        out = F.when(F.regexp_like(s, F.lit(pattern)), kind).otherwise(out)
    return out


def sex_of_given(given: Column, male: list[str], female: list[str]) -> Column:
    """M or F by the first given name that one of two lists has, else null."""
    words = F.transform(F.split(F.lower(F.coalesce(given, F.lit(""))), r"[\s-]+"), lambda w: F.regexp_replace(w, _WORD, ""))
    of = lambda w: F.when(w.isin(*male), "M").when(w.isin(*female), "F")
    return F.get(F.filter(F.transform(words, of), lambda s: s.isNotNull()), F.lit(0))


def _void(text: Column) -> Column:
    return F.when(text != "", text)


def markers(part: Column) -> Column:
    """struct(text, deceased, widowed, birth_name, alternative, uncertain, sex, unknown): what a part of a person's cell says beside the name."""
    has = lambda t, p: F.regexp_like(t, F.lit(p))
    less = lambda t, p, put="": F.regexp_replace(t, p, put)
    widow, widow_word = r"(?i)\((W|Witwe|Witwer|Wwe|Wwer)\)", r"\bWitt?we(r)?\b"
    born, other = r"\bgeb\.?\s+([^\s(,]+(?:\s[^\s(,]+)?)", r"(?:\(\?\??\)\s*)?=\s*(\S+)\s*$"

    def dead(t: Column) -> Column:
        late = has(t, r"(?i)^(?:(weyl|weil|weiland|sel|seel|selig|seelig|gest|verst)\.?|[+†])$")
        first, cross = r"(?i)^(weyl|weil|weiland)\.?\s+", r"^\+\s|\s\+\s|†"
        rest = F.trim(less(less(t, first), cross, " "))
        return F.struct(F.when(late, "").otherwise(rest).alias("t"), (late | has(t, first) | has(t, cross)).alias("deceased"))

    def said(a: Column) -> Column:
        t = a["t"]
        unmarried = F.trim(less(less(t, widow), rf",?\s*{widow_word}"))
        bare = F.trim(less(F.trim(less(unmarried, born)), other))
        return F.struct(
            bare.alias("t"), a["deceased"].alias("deceased"), (has(t, widow) | has(t, widow_word)).alias("widowed"),
            _void(less(F.regexp_extract(unmarried, born, 1), r"\(in\)$")).alias("birth_name"), _void(F.regexp_extract(F.trim(less(unmarried, born)), other, 1)).alias("alternative"),
        )

    def plain(b: Column) -> Column:
        t = F.trim(less(b["t"], r"\s*\(\?+\)|\s*\?+"))
        return F.struct(F.trim(F.replace(t, F.lit("(in)"), F.lit(""))).alias("t"), F.contains(b["t"], F.lit("?")).alias("uncertain"), F.contains(t, F.lit("(in)")).alias("ending"), b.alias("b"))

    def done(d: Column) -> Column:
        nobody = has(d["t"], r"(?i)^(N\.?N?\.?|NN\.?|N\. N\.|unbekannt|unknown)$")
        t = less(d["t"], rf"^(.+?)\s+({PARTICLE})$", "$2 $1")
        noun = F.lit(None).cast("string")
        for word, sex in SEX_NOUNS.items():
            noun = F.when(has(t, rf"(?iU)\b{word}\b"), sex).otherwise(noun)
        noun = F.when(has(t, rf"(?iU)\b({'|'.join(SEX_NOUNS)})\b"), noun)
        text = F.when(nobody, "").otherwise(less(less(t, r"\s+", " "), r"^[ ,;]+|[ ,;]+$"))
        b = d["b"]
        return F.struct(
            text.alias("text"), b["deceased"].alias("deceased"), b["widowed"].alias("widowed"), b["birth_name"].alias("birth_name"), b["alternative"].alias("alternative"),
            d["uncertain"].alias("uncertain"), F.coalesce(noun, F.when(d["ending"], "F")).alias("sex"), nobody.alias("unknown"),
        )

    no, none = F.lit(False), F.lit(None).cast("string")
    nothing = F.struct(F.lit("").alias("text"), no.alias("deceased"), no.alias("widowed"), none.alias("birth_name"), none.alias("alternative"), no.alias("uncertain"), none.alias("sex"), no.alias("unknown"))
    return F.when(F.trim(F.coalesce(part, F.lit(""))) == "", nothing).otherwise(let(F.trim(part), lambda t: let(dead(t), lambda a: let(said(a), lambda b: let(plain(b), done)))))


def parse_person(cell: Column) -> Column:
    """struct(name, given, occupation, birth_name, sex, deceased, widowed, uncertain, unknown, stillborn) of a cell "Surname, Given, extras…"."""
    still = r"(?i)\b(tot|tod)\s*-?\s*geb[a-zäöüß]*"
    nouns = rf"(?iU)\b({'|'.join(SEX_NOUNS)})\b"
    first, last = rf"^({PARTICLE})\s+(.+)$", rf"^(.+?)\s+({PARTICLE})$"

    def part(t: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, still, ""), nouns, ""), r"[\s\-–,;]+", " "))
        return F.when(F.regexp_like(t, F.lit(still)), bare).otherwise(t)

    def person(text: Column, found: Column) -> Column:
        any_ = lambda f: F.exists(found, lambda m: m[f])
        latest = lambda f: F.get(F.reverse(F.filter(F.transform(found, lambda m: m[f]), lambda v: v.isNotNull())), F.lit(0))
        extras = F.array_join(F.filter(F.transform(F.slice(found, F.lit(3), F.greatest(F.size(found) - 2, F.lit(0))), lambda m: m["text"]), lambda t: t != ""), ", ")

        def named(n: Column) -> Column:
            led = F.regexp_extract(n["given"], first, 1)
            mark = F.coalesce(F.when(led != "", led).otherwise(F.regexp_extract(n["given"], last, 2)), F.lit(""))
            given = F.when(led != "", F.regexp_extract(n["given"], first, 2)).when(mark != "", F.regexp_extract(n["given"], last, 1)).otherwise(n["given"])
            name = F.when((mark != "") & (n["name"] != "") & ~F.startswith(F.lower(n["name"]), mark), F.concat_ws(" ", mark, n["name"])).otherwise(n["name"])
            return F.struct(
                _void(name).alias("name"), _void(given).alias("given"), _void(extras).alias("occupation"), latest("birth_name").alias("birth_name"), latest("sex").alias("sex"), any_("deceased").alias("deceased"),
                any_("widowed").alias("widowed"), any_("uncertain").alias("uncertain"), any_("unknown").alias("unknown"), F.regexp_like(text, F.lit(still)).alias("stillborn"),
            )

        return let(F.struct(part(F.get(found, F.lit(0))["text"]).alias("name"), part(F.get(found, F.lit(1))["text"]).alias("given")), named)

    text = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    no, none = F.lit(False), F.lit(None).cast("string")
    nothing = F.struct(*[none.alias(x) for x in ("name", "given", "occupation", "birth_name", "sex")], *[no.alias(x) for x in ("deceased", "widowed", "uncertain", "unknown", "stillborn")])
    return F.when(text == "", nothing).otherwise(let(text, lambda t: let(F.transform(F.split(t, r"\s*,\s*"), markers), lambda found: person(t, found))))
