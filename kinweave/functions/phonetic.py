"""Kölner Phonetik as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _letters(name: Column) -> Column:
    """Lower case, umlauts without their dots, ß as ss, ph as f, nothing but a to z."""
    plain = F.replace(F.translate(F.lower(name), "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.replace(plain, F.lit("ph"), F.lit("f")), "[^a-z]", "")


def _code(c: Column, before: Column, after: Column) -> Column:
    """The digits of a letter between two others; beyond the word's ends stands an empty string."""
    hard = lambda letters: (after == "") | F.contains(F.lit(letters), after)  # noqa: E731  a final c is hard
    initial_c = F.when(hard("ahkloqrux"), "4").otherwise("8")
    later_c = F.when(before.isin("s", "z"), "8").when(hard("ahkoqux"), "4").otherwise("8")
    return (
        F.when(c.isin(*"aeijouy"), "0")
        .when(c == "h", "")
        .when(c.isin("b", "p"), "1")
        .when(c.isin("d", "t"), F.when(after.isin("c", "s", "z"), "8").otherwise("2"))
        .when(c.isin(*"fvw"), "3")
        .when(c.isin(*"gkq"), "4")
        .when(c == "c", F.when(before == "", initial_c).otherwise(later_c))
        .when(c == "x", F.when(before.isin("c", "k", "q"), "8").otherwise("48"))
        .when(c == "l", "5")
        .when(c.isin("m", "n"), "6")
        .when(c == "r", "7")
        .otherwise("8")
    )


def koelner(name: Column) -> Column:
    """The phonetic key of a name; empty for null, empty, or a name without letters.

    Digits of all letters are put together, equal neighbours become one, and zeros go but for a
    leading one, in this order: digits that only a zero parted stay doubled.
    """
    def key(letters: Column) -> Column:
        near = lambda i: F.coalesce(F.get(letters, i), F.lit(""))
        codes = F.transform(letters, lambda letter, i: _code(letter, near(i - 1), near(i + 1)))
        return let(F.regexp_replace(F.array_join(codes, ""), r"(.)\1+", "$1"), lambda d: F.concat(F.substring(d, 1, 1), F.replace(F.substring(d, 2, 2**31 - 1), F.lit("0"), F.lit(""))))

    return let(F.coalesce(_letters(name), F.lit("")), lambda s: F.when(s == "", "").otherwise(let(F.split(s, ""), key)))
