"""Partial dates, ages, and the two ways of counting days.

A partial date is struct(y, m, d) of nullable ints, never a DATE: 1793-02-31 is what a register may say.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of vague dates; days of the units of an age.
PREFIXES = (("^(um|ca|etwa|abt)", "ABT"), ("^(vor|bef)", "BEF"), ("^(nach|aft)", "AFT"), ("^(err|cal|berechnet)", "CAL"), ("^(est|gesch)", "EST"))
UNITS = (("j(ahre?)?", 365.0), ("m(o|onate?)?", 30.0), ("w(o|ochen?)?", 7.0), ("t(age?)?", 1.0), ("st(unden?|d)?", 0.0))
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def date_struct(y: Column, m: Column | None = None, d: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(y.cast("int").alias("y"), (none if m is None else m.cast("int")).alias("m"), (none if d is None else d.cast("int")).alias("d"))


def _int(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.try_cast("int"))  # a failed cast costs more than all patterns


def partial_date(text: Column) -> Column:
    """The date that a cell begins with (y-m-d, y-m, d.m.y), else the first year from 1500 to 2099 in it; null if none.

    An impossible month is unknown, and so is a day that is impossible or has no month.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    ymd, ym, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})"
    year = r"(?<![0-9A-Za-z_])(1[5-9]\d\d|20\d\d)(?![0-9A-Za-z_])"
    is_ = lambda p: F.regexp_like(t, F.lit(p))
    y = F.when(is_(ymd), _int(t, ymd, 1)).when(is_(ym), _int(t, ym, 1)).when(is_(dmy), _int(t, dmy, 3)).otherwise(_int(t, year, 1))
    m = F.when(is_(ymd), _int(t, ymd, 2)).when(is_(ym), _int(t, ym, 2)).when(is_(dmy), _int(t, dmy, 2))
    d = F.when(is_(ymd), _int(t, ymd, 3)).when(is_(dmy), _int(t, dmy, 1))
    m = F.when(m.between(1, 12), m)
    d = F.when(d.between(1, 31) & m.isNotNull(), d)
    return F.when(y.isNotNull(), date_struct(y, m, d))


def date_prefix(text: Column) -> Column:
    """ABT, BEF, AFT, CAL or EST for a vague date, else null."""
    t, out = F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(None).cast("string")
    for pattern, prefix in reversed(PREFIXES):
        out = F.when(F.regexp_like(t, F.lit(pattern)), prefix).otherwise(out)
    return out


def ordinal(date: Column) -> Column:
    """Days since the first day of year 1, as day 1; an unknown month is June, an unknown day the 15th, an impossible day the first of its month."""
    m = F.when(date["m"].between(1, 12), date["m"]).otherwise(6)
    text = lambda d: F.format_string("%04d-%02d-%02d", date["y"], m, d)
    d = F.coalesce(date["d"], F.lit(15))
    day = F.coalesce(F.try_to_date(text(d), "yyyy-MM-dd"), F.try_to_date(text(F.lit(1)), "yyyy-MM-dd"))
    day = F.when(date["y"].between(1, 9999) & d.between(1, 28), F.make_date(date["y"], m, d)).otherwise(day)  # a day that every month has needs no text
    return F.unix_date(day) + 719163


def minus_days(date: Column, days: Column) -> Column:
    """The partial date that many days earlier: a birth from a death and an age."""
    day = F.date_sub(F.date_from_unix_date(ordinal(date) - 719163), days)
    return date_struct(F.year(day), F.month(day), F.dayofmonth(day))


def age_days(text: Column, bare: str = "days") -> Column:
    """An age in words ("59 J 10 M 4 T", "24 Wochen") in days: years 365, months 30, weeks 7, hours 0; null if it has none.

    A bare number counts as ``bare``: days, or years. Halves round to even.
    """
    t = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("½"), F.lit(" 0.5"))
    pair = r"(\d+(?:[.,]\d+)?)\s*([a-zäöü.]+)"
    pairs = F.regexp_extract_all(t, F.lit(pair), F.lit(0))

    def days(p: Column) -> Column:
        unit = F.regexp_replace(F.regexp_extract(p, pair, 2), r"\.+$", "")
        factor = F.lit(None).cast("double")
        for pattern, n in reversed(UNITS):
            factor = F.when(F.regexp_like(unit, F.lit(f"^({pattern})$")), n).otherwise(factor)
        return F.replace(F.regexp_extract(p, pair, 1), F.lit(","), F.lit(".")).try_cast("double") * factor

    known = F.filter(F.transform(pairs, days), lambda d: d.isNotNull())
    total = F.bround(F.aggregate(known, F.lit(0.0), lambda s, d: s + d)).cast("int")
    number = F.regexp_extract(t, r"^(\d+)$", 1).try_cast("int") * (365 if bare == "years" else 1)
    years = F.regexp_extract(t, r"^(\d+)\s*j.*$", 1).try_cast("int") * 365
    return F.when(F.regexp_like(t, F.lit(r"^\d+$")), number).when(F.size(known) > 0, total).otherwise(years)


def rule_date(text: Column) -> Column:
    """The date by which rules judge: D.M.Y, ISO, M.Y, GEDCOM's "31 AUG 1778" or a bare year; impossible parts are kept."""
    t = F.coalesce(text, F.lit(""))
    up = F.upper(t)
    dmy, iso, my = r"^\s*(\d{1,2})\.\s*(\d{1,2})\.?\s*(\d{4})\s*$", r"^\s*(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?\s*$", r"^\s*(\d{1,2})\.\s*(\d{4})\s*$"
    ged = rf"(?:(\d{{1,2}})\s+)?({'|'.join(MONTHS)})\s+(\d{{4}})"
    is_ = lambda p, x=t: F.regexp_like(x, F.lit(p))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(up, ged, 2))
    pick = lambda a, b, c, e, z: F.when(is_(dmy), a).when(is_(iso), b).when(is_(my), c).when(is_(ged, up), e).otherwise(z)
    none = F.lit(None).cast("int")
    y = pick(_int(t, dmy, 3), _int(t, iso, 1), _int(t, my, 2), _int(up, ged, 3), _int(t, r"(\d{4})", 1))
    m = pick(_int(t, dmy, 2), _int(t, iso, 2), _int(t, my, 1), month.cast("int"), none)
    d = pick(_int(t, dmy, 1), _int(t, iso, 3), none, _int(up, ged, 1), none)
    # What files say nearly always needs no further pattern: "31 AUG 1778", "AUG 1778" and "1778".
    plain, long = is_(rf"^(?:(?:\d{{1,2}} )?(?:{'|'.join(MONTHS)}) )?\d{{4}}$"), F.length(t) >= 8
    known = date_struct(F.right(t, F.lit(4)), F.when(long, F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(t, -8, 3))), F.when(F.length(t) > 8, F.split_part(t, F.lit(" "), F.lit(1))))
    return F.when(plain, known).otherwise(F.when(y.isNotNull(), date_struct(y, m, d)))


def full(date: Column) -> Column:
    return date["y"].isNotNull() & date["m"].isNotNull() & date["d"].isNotNull()


def pseudo_days(date: Column) -> Column:
    """Days of a year of 372 days: equal dates have equal numbers, and order holds."""
    return date["y"] * 372 + F.coalesce(date["m"], F.lit(1)) * 31 + F.coalesce(date["d"], F.lit(1))


def before(a: Column, b: Column) -> Column:
    """a is before b, by day if both are full, else by year; null if either is unknown."""
    return F.when(full(a) & full(b), pseudo_days(a) < pseudo_days(b)).otherwise(a["y"] < b["y"])


def years_between(a: Column, b: Column) -> Column:
    return F.when(full(a) & full(b), (pseudo_days(b) - pseudo_days(a)) / 372.0).otherwise((b["y"] - a["y"]).cast("double"))


def months_between(a: Column, b: Column) -> Column:
    """Months from a to b with the days as a fraction; null unless both have a month."""
    day = lambda x: F.coalesce(x["d"], F.lit(1))
    return (b["y"] - a["y"]) * 12 + (b["m"] - a["m"]) + (day(b) - day(a)) / 31.0


def impossible(date: Column) -> Column:
    """The date has a month or a day that no calendar has."""
    y, m, d = date["y"], date["m"], date["d"]
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(~m.between(1, 12) | (d < 1) | (d > longest), F.lit(False))


def date_text(date: Column) -> Column:
    """d.m.y, m.y or y, as far as known; ? if unknown."""
    return F.when(date["y"].isNull(), "?").otherwise(F.concat_ws(".", F.when(date["m"].isNotNull(), date["d"]), date["m"], date["y"]))


def gedcom_date(date: Column, prefix: Column | None = None) -> Column:
    """31 AUG 1778, led by a prefix; a month that no year has is left out, and its day."""
    month = F.when(date["m"] > 0, F.get(F.array(*map(F.lit, MONTHS)), date["m"] - 1))
    return F.concat_ws(" ", F.lit(None).cast("string") if prefix is None else prefix, F.when(month.isNotNull(), date["d"]), month, date["y"])
