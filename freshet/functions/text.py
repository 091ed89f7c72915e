"""Column functions on names, numbers and page links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words dropped when river names are compared, and abbreviations of institution names.
RIVER_NOISE = ("river", "nadi", "nadee", "nodi", "jan", "suti", "beel")
ABBREVIATIONS = {
    "lp": "lower primary", "lps": "lower primary school", "me": "middle english", "mes": "middle english school", "hs": "high school",
    "hss": "higher secondary school", "ghs": "government high school", "mv": "middle vernacular",
}


def slug(name: Column, fallback: str = "unknown") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(F.length(s), F.lit(0)) > 0, s).otherwise(fallback)


def letters(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def alnum(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))


def expand(name: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Tokens, each replaced by its long form if it has one. Dots are taken out first: "L.P." is "lp"."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(tokens(F.replace(name, F.lit("."), F.lit(""))), lambda t: F.coalesce(F.try_element_at(pairs, t), t)), " ")


def fold_river(name: Column) -> Column:
    """Sorted distinct tokens without the noise words."""
    return F.array_sort(F.array_distinct(F.filter(tokens(name), lambda t: ~t.isin(*RIVER_NOISE))))


def names_agree(a: Column, b: Column) -> Column:
    """One token set holds the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def bracket_pairs(text: Column) -> Column:
    """Array of (name, number) from "Name (12), Other (3)"."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z ]*?)\s*\(\s*\d+\s*\)"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(r"[A-Za-z]\s*\(\s*(\d+)\s*\)"), F.lit(1))
    return F.arrays_zip(names.alias("name"), numbers.alias("number"))


def phones(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,/;]"), lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: F.length(x).between(7, 12))


def first_sum(values: Column, tolerance: float = 1e-6) -> Column:
    """Index (from 1) of the first three numbers whose sum is the number after them; null if there is none."""
    ok = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values) - 3, F.lit(1))), lambda i: F.abs(F.try_element_at(values, i) + F.try_element_at(values, i + 1) + F.try_element_at(values, i + 2) - F.try_element_at(values, i + 3)) <= tolerance)
    return F.try_element_at(ok, F.lit(1))


def salted(token: Column, salt: str, month: Column) -> Column:
    zero = F.lit(b"\x00")
    return F.sha2(F.concat(F.encode(F.lit(salt), "UTF-8"), zero, F.encode(token, "UTF-8"), zero, F.encode(month, "UTF-8")), 256)
