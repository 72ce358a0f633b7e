"""Text functions: Column in, Column out, all of them inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it. What stands in f is evaluated by compiled code, not
    generated into a method that is too large to be compiled."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def clean(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed, dashes and signs made plain."""
    return F.trim(F.regexp_replace(F.translate(F.replace(F.lower(c), F.lit("≥"), F.lit(">=")), "—–", "--"), r"\s+", " "))


def count_of(c: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def density(c: Column, keywords: Sequence[str], most: int = 6) -> Column:
    """Sum over the keywords of their counts, each of them ``most`` at the highest."""
    return sum((F.least(count_of(c, k), F.lit(most)) for k in keywords), F.lit(0)).cast("bigint")


def any_of(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def first_category(c: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first rule, in order, of which the text holds a keyword."""
    out = None
    for name, words in rules:
        hit = any_of(c, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


def tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:[-'][a-z0-9]+)*"), F.lit(0))))


def domains(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "General") -> Column:
    """Names of the rules whose phrase the text holds or whose word is one of its tokens."""
    own, low = tokens(c), F.lower(c)
    named = [F.when(_any([low.contains(w) if " " in w else F.array_contains(own, w) for w in words]), F.lit(name)) for name, words in rules]
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def plain(c: Column) -> Column:
    """Lower case, white space collapsed, dashes and signs made plain."""
    return F.regexp_replace(F.translate(F.replace(F.lower(c), F.lit("≥"), F.lit(">=")), "—–", "--"), r"\s+", " ")


def number(c: Column) -> Column:
    """A number as catalogs write it: 1,234 / 12 million / 500k / 10 to 20 or 10-20 (the largest) / the
    first that there is."""
    scaled = r"(?i)(\d+(?:\.\d+)?)\s*(k|m|million|thousand)\b"

    def read(bare: Column) -> Column:
        n = F.regexp_extract(bare, scaled, 1).try_cast("double")
        times = bound(F.lower(F.regexp_extract(bare, scaled, 2)), lambda unit: F.when(unit.isin("m", "million"), n * 1e6).when(unit != "", n * 1e3))
        found = F.transform(F.regexp_extract_all(bare, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
        listed = bound(found, lambda xs: F.when(bare.rlike(r"(?i)\bto\b|-") & (F.size(xs) >= 2), F.array_max(xs)).otherwise(F.get(xs, F.lit(0))))
        whole = F.when(bare.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), bare.try_cast("double"))
        return F.when(bare.isNotNull(), F.coalesce(whole, times, listed))

    return bound(F.trim(F.replace(c, F.lit(","), F.lit(""))), read)


def numbered_sections(c: Column) -> Column:
    """Parts that begin with 1.2 or 1.2.3 and a blank; what stands before the first goes."""
    parts = F.split(F.regexp_replace(c, r"(\b\d+(?:\.\d+)+\s+)", "\u0001$1"), "\u0001")
    return F.transform(F.filter(parts, lambda x, i: i > 0), lambda x: F.trim(x))


def inline_bullets(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\S)\s+([a-zA-Z0-9][.)])\s+", "\n$1 ")


def first_url(c: Column) -> Column:
    return F.regexp_extract(c, r"https?://[^\s|\"'<>]+", 0)


def distinct_parts(parts: Column) -> Column:
    """Parts without those that an earlier part holds, whatever the case."""
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda a: F.contains(F.lower(a), F.lower(x))), acc).otherwise(F.array_append(acc, x)))


def largest_number(c: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("double")))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, as a fold over the characters of a; b is
    read once a character, so this is meant for short strings."""
    left, right = F.split(a, ""), F.split(b, "")
    row = F.transform(right, lambda _: F.lit(0))

    def step(prev, x):
        cell = lambda y, i: F.struct(y.alias("y"), F.get(prev, i - 1).alias("d"), F.get(prev, i).alias("u"))
        cells = F.transform(right, cell)
        return F.aggregate(cells, F.array().cast("array<int>"), lambda acc, s: F.array_append(acc, F.greatest(F.when(s["y"] == x, F.coalesce(s["d"], F.lit(0)) + 1).otherwise(0), s["u"], F.coalesce(F.array_max(acc), F.lit(0)))))

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.coalesce(F.array_max(F.aggregate(left, row, step)), F.lit(0)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (|a| + |b|) of the two texts with their words sorted."""
    a, b = (F.array_join(F.array_sort(F.split(F.trim(F.lower(c)), r"\s+")), " ") for c in (a, b))
    return F.coalesce(2.0 * lcs(a, b) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(1.0))
