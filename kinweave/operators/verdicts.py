"""What people decide about links, and how entries are told: verdicts of review lists and samples, citations, content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import given_canon
from ..functions.phonetic import koelner

c = F.col

#: Verdicts that say nothing, that a mention is a person of its own, and that a decision is taken back.
OPEN, NEW, BACK = ("", "offen", "?", "-"), ("neu", "eigene person", "keiner"), ("zurueck", "zurück", "loeschen", "löschen")
#: Kinds of entries as citations call them.
KINDS = {"tauf": "Tau", "trau": "Tra", "heirat": "Tra", "ehe": "Tra", "begr": "Beg", "tod": "Beg", "sterb": "Beg", "beerd": "Beg"}
#: An age in brackets after a date of death.
AGE = r"^\s*\(\s*(\d{1,3})\s*J(?:ahre?)?\.?(?:\s*(\d{1,2})\s*M)?(?:\s*(\d{1,2})\s*T)?"


def candidate_text(candidates: Column, who: str | None = None) -> Column:
    """The cell of a review list that names candidates (array of struct(ident, points, reason, key)): a line for each, then their keys after #. ``who`` is a field of theirs with what stands for [ident]."""
    name = lambda x: x[who] if who else F.concat(F.lit("["), x["ident"].cast("string"), F.lit("]"))
    said = F.transform(candidates, lambda x: F.concat(name(x), F.lit(" ("), x["points"].cast("string"), F.lit(" P.: "), F.coalesce(x["reason"], F.lit("")), F.lit(")")))
    keys = F.transform(candidates, lambda x: F.concat_ws("=", x["ident"].cast("string"), F.coalesce(x["key"], F.lit(""))))
    return F.concat(F.array_join(said, "\n"), F.lit("\n#"), F.array_join(keys, ";"))


def read_verdicts(sheet: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key, status, target) of a review list that people have filled in.

    ``sheet`` has key, verdict, candidates (see :func:`candidate_text`); ``mentions`` key, ident (null: unlinked), of which keys are unique. A verdict is a
    candidate's number, or one of the words above. status is gleich, neu, zurueck, uebergangen, "unknown mention" or "no such candidate"; target is the
    mention that the key is the same as: the one behind the number, else the first other mention of the identity of that number.
    """
    said = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    number = F.regexp_replace(said, r"^[\[\] ]+|[\[\] ]+$", "")
    hidden = F.when(F.contains("candidates", F.lit("#")), F.element_at(F.split("candidates", "#"), -1)).otherwise("")
    pairs = F.filter(F.split(hidden, ";"), lambda x: F.startswith(x, F.concat(c("number"), F.lit("="))))
    rows = sheet.withColumns({"said": said, "number": number}).withColumn("named", F.regexp_replace(F.get(pairs, F.lit(0)), "^[^=]*=", ""))
    known = mentions.select("key").distinct()
    rows = rows.join(known.withColumn("here", F.lit(True)), "key", "left").join(known.select(c("key").alias("named"), F.lit(True).alias("found")), "named", "left")
    # Two mentions of an identity are enough: one of them is another than the one in question.
    of = mentions.where("ident IS NOT NULL").groupBy("ident").agg(F.min("key").alias("low"))
    second = mentions.where("ident IS NOT NULL").join(of.select("ident", "low"), "ident").where("key > low").groupBy("ident").agg(F.min("key").alias("second"))
    of = of.join(second, "ident", "left").select(c("ident").alias("number_id"), "low", "second")
    rows = rows.withColumn("number_id", F.regexp_extract("number", r"^([0-9]{1,18})$", 1).try_cast("long")).join(of, "number_id", "left")
    other = F.when(c("low") != c("key"), c("low")).otherwise(c("second"))
    target = F.coalesce(F.when(c("found"), c("named")), other)
    void = c("key").isNull() | (c("key") == "") | c("said").isin(*OPEN)
    status = F.when(void, "uebergangen").when(c("here").isNull(), "unknown mention").when(c("said").isin(*NEW), "neu").when(c("said").isin(*BACK), "zurueck").when(target.isNull(), "no such candidate").otherwise("gleich")
    return rows.select("key", status.alias("status"), F.when(status == "gleich", target).alias("target"))


def apply_verdicts(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``decisions`` (key, kind, target) after verdicts (see :func:`read_verdicts`): new ones replace those of their key, and those taken back go."""
    told = verdicts.where("status IN ('gleich', 'neu', 'zurueck')")
    stay = decisions.select("key", "kind", "target").join(told, "key", "left_anti")
    return stay.union(told.where("status <> 'zurueck'").select("key", c("status").alias("kind"), "target"))


def take_over(answers: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, kind, target): decisions from a sample that people have judged.

    ``answers`` has entry, register, family, answer (richtig, falsch or others), role, key (the mention of that role in the entry), ident (whom the
    role is in the family); ``firsts`` ident, key, an identity's first mention. A right entry's roles are the same as the family's; at a burial that is wrong
    the dead one is a person of their own; a wrong baptism is left for review.
    """
    right = answers.where("answer = 'richtig' AND key IS NOT NULL").join(firsts.select("ident", c("key").alias("target")), "ident").select("key", F.lit("gleich").alias("kind"), "target")
    wrong = answers.where("answer = 'falsch' AND register = 'tod' AND role = 'verstorbener' AND key IS NOT NULL").select("key", F.lit("neu").alias("kind"), F.lit(None).cast("string").alias("target"))
    return right.union(wrong).distinct()


def normal_citation(page: Column) -> Column:
    """A citation made comparable: "Taufe 1647/01" and "Tauf 1647/1" are one; others lose superfluous blanks."""
    pattern = rf"(?i)^\s*({'|'.join(KINDS)})\w*\s+(\d{{4}})\s*/\s*0*(\d+)"
    p = F.coalesce(page, F.lit(""))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = F.try_element_at(kinds, F.lower(F.regexp_extract(p, pattern, 1)))
    told = F.concat(kind, F.lit(" "), F.regexp_extract(p, pattern, 2), F.lit("/"), F.regexp_extract(p, pattern, 3))
    return F.when(F.regexp_like(p, F.lit(pattern)), told).otherwise(F.regexp_replace(F.trim(p), r"\s+", " "))


def content_key(kind: Column, year: Column, surname: Column, given: Column) -> Column:
    """What an entry is about, for meeting one without a citation: kind, year, the surname's phonetic key and the first canonical given name."""
    sound, name = koelner(surname), F.coalesce(surname, F.lit(""))
    first = F.split_part(given_canon(given), F.lit(" "), F.lit(1))
    return F.concat_ws(" ", kind, F.coalesce(year.cast("string"), F.lit("?")), F.when(sound != "", sound).otherwise(F.lower(name)), F.when(first != "", first).otherwise("-"))


def age_in_text(raw: Column, death: Column) -> Column:
    """The age in years that stands in brackets after the date of death in a raw text; null if there is none."""
    date = F.trim(death)
    at = F.instr(raw, date)
    rest = F.substring(raw, at + F.length(date), F.length(raw))
    part = lambda i: F.regexp_extract(rest, AGE, i).try_cast("double")
    years = part(1) + F.coalesce(part(2), F.lit(0.0)) / 12 + F.coalesce(part(3), F.lit(0.0)) / 365
    return F.when((at > 0) & (date != ""), years)


def name_prefixes(a: Column, b: Column, size: int = 3) -> Column:
    """Two sets of names (texts, parted by blanks) have one in common, or one that begins alike."""
    starts = lambda x: F.transform(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, size))
    return F.size(F.array_intersect(starts(a), starts(b))) > 0
