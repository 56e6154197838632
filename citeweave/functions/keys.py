"""Derived keys: surname keys, canonical ids, cache keys, trigram vectors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name particles, stripped in this order.
PARTICLES = ("van", "von", "der", "de", "del", "la", "le", "da")
DIMENSIONS = 64


def _decomposed(ranges: tuple[range, ...]) -> dict[str, str]:
    """Characters whose compatibility form holds basic letters, with those letters."""
    found = {}
    for r in ranges:
        for c in map(chr, r):
            letters = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if "a" <= x <= "z")
            if letters:
                found[c] = letters
    return found


_FORMS = _decomposed((range(0xAA, 0x250), range(0x1D2C, 0x1D6B), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0x2100, 0x2190), range(0x2460, 0x2500), range(0xFB00, 0xFB07), range(0xFF21, 0xFF5B)))
_ONE = {c: x for c, x in _FORMS.items() if len(x) == 1}
_MANY = {c: x for c, x in _FORMS.items() if len(x) > 1}


def surname_key(surname: Column) -> Column:
    """Comparison key: compatibility letters a-z only, without leading particles."""
    name = F.coalesce(surname, F.lit(""))
    plain = F.translate(name, "".join(_ONE), "".join(_ONE.values()))
    for c, letters in _MANY.items():
        if "ﬀ" <= c <= "ﬆ":
            plain = F.replace(plain, F.lit(c), F.lit(letters))
    key = F.regexp_replace(F.lower(F.when(F.rlike(name, F.lit("[^\\x00-\\x7F]")), plain).otherwise(name)), "[^a-z]", "")
    strip_one = lambda k, p: F.when(F.startswith(k, p) & (F.length(k) > F.length(p) + 2), F.substring(k, F.length(p) + 1, F.length(k))).otherwise(k)
    return F.aggregate(F.array(*map(F.lit, PARTICLES)), key, strip_one)


def canonical_id(surname: Column, year: Column, title: Column) -> Column:
    """Twelve hex digits over the first surname, the year and the start of the title."""
    parts = (F.coalesce(F.lower(surname), F.lit("")), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("")), F.substring(F.lower(F.coalesce(title, F.lit(""))), 1, 60))
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 12)


def cache_key(cleaned: Column) -> Column:
    return F.substring(F.sha1(cleaned.cast("binary")), 1, 16)


def trigram_buckets(title: Column) -> Column:
    """Bucket 0..63 of each character trigram, in order; empty under three characters."""
    text = F.lower(F.coalesce(title, F.lit("")))
    bucket = lambda i: (F.conv(F.substring(F.md5(F.substring(text, i, F.lit(3)).cast("binary")), 1, 8), 16, 10).cast("long") % DIMENSIONS).cast("int")
    return F.when(F.length(text) < 3, F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 2), bucket))


def counts_vector(buckets: Column) -> Column:
    """Counts of the buckets as an array of 64 doubles; the buckets are worked out once."""
    count = lambda own: F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda b: (F.size(own) - F.size(F.array_remove(own, b))).cast("double"))
    return F.element_at(F.transform(F.array(buckets), count), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def characters(title: Column) -> Column:
    """Distinct characters of a lower-cased title."""
    text = F.lower(F.coalesce(title, F.lit("")))
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
