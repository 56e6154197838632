"""In-text markers and their links to bibliography entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.arrays import located
from citeweave.functions.keys import surname_key
from citeweave.functions.text import YEAR, first, index_surname, number_list

# The marker patterns.
BRACKET = "\\[(\\d+(?:\\s*(?:,|-|\\u2013)\\s*\\d+)*)\\]"
PARENTHETICAL = "\\(([^()]{0,160}?(?:19|20)\\d{2}[a-z]?[^()]*)\\)"
_NAME = "([A-Z][A-Za-z'`-]+)(?:\\s+et\\s+al\\.?|\\s+(?:and|&)\\s+[A-Z][A-Za-z'`-]+)?"
NARRATIVE = f"\\b{_NAME}\\s*\\(((?:19|20)\\d{{2}})([a-z])?\\)"
PAIR = f"{_NAME}[, ]+\\s*((?:19|20)\\d{{2}})([a-z])?"


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in code points from 0."""
    return F.transform(located(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def bracket_markers(pages: DataFrame) -> DataFrame:
    """(paper, page, raw_marker, start, end, number): one row for each number a bracket names."""
    found = pages.select("paper", "page", F.explode(matches(F.col("text"), BRACKET)).alias("m"))
    numbers = number_list(F.substring(F.col("m.value"), F.lit(2), F.length("m.value") - 2))
    return found.select("paper", "page", F.col("m.value").alias("raw_marker"), "m.start", "m.end", F.explode(numbers).alias("number"))


def link_numbered(pages: DataFrame, references: DataFrame) -> DataFrame:
    """Bracket citances linked to references(paper, ordinal, raw_ref); the same number of a marker counts once a page.

    The first place stays. Numbers beyond the list are unlinked.
    """
    markers = bracket_markers(pages)
    linked = markers.join(references.select("paper", F.col("ordinal").alias("number"), "raw_ref"), ["paper", "number"], "left")
    once = linked.groupBy("paper", "page", "raw_marker", "number", "raw_ref").agg(F.min(F.struct("start", "end")).alias("s"))
    done = F.col("raw_ref").isNotNull()
    return once.select("paper", "page", F.lit("numbered_bracket").alias("style"), "raw_marker", "number", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "raw_ref", F.when(done, "numbered_direct").otherwise("unlinked").alias("link_method"), F.when(done, 1.0).otherwise(0.0).alias("link_confidence"))


def author_year_index(references: DataFrame) -> DataFrame:
    """(paper, key, year, n, raw_ref): bibliography entries by surname key and year; raw_ref where there is one."""
    keyed = references.select("paper", "raw_ref", index_surname(F.col("raw_ref")).alias("s"), first(F.col("raw_ref"), YEAR).cast("int").alias("year")).where("s is not null and year is not null")
    return keyed.groupBy("paper", surname_key(F.col("s")).alias("key"), "year").agg(F.count(F.lit(1)).alias("n"), F.min("raw_ref").alias("one")).select("paper", "key", "year", "n", F.when(F.col("n") == 1, F.col("one")).alias("raw_ref"))


def paren_markers(pages: DataFrame) -> DataFrame:
    """(paper, page, raw_marker, start, end, pair, surname, year): author-year pairs inside parentheses."""
    found = pages.select("paper", "page", F.explode(matches(F.col("text"), PARENTHETICAL)).alias("m"))
    pairs = found.select("paper", "page", F.col("m.value").alias("raw_marker"), "m.start", "m.end", F.posexplode(F.regexp_extract_all(F.substring(F.col("m.value"), F.lit(2), F.length("m.value") - 2), F.lit(PAIR), F.lit(0))).alias("pair", "p"))
    return pairs.select("paper", "page", F.lit("paren_author_year").alias("style"), "raw_marker", "start", "end", "pair", first(F.col("p"), PAIR).alias("surname"), first(F.col("p"), PAIR, 2).cast("int").alias("year"))


def narrative_markers(pages: DataFrame) -> DataFrame:
    """(paper, page, raw_marker, start, end, pair, surname, year): a name before a year in parentheses."""
    found = pages.select("paper", "page", F.explode(matches(F.col("text"), NARRATIVE)).alias("m"))
    return found.select("paper", "page", F.lit("narrative_author_year").alias("style"), F.col("m.value").alias("raw_marker"), "m.start", "m.end", F.lit(0).alias("pair"), first(F.col("m.value"), NARRATIVE).alias("surname"), first(F.col("m.value"), NARRATIVE, 2).cast("int").alias("year"))


def link_author_year(markers: DataFrame, references: DataFrame, disambiguate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Author-year citances: linked where the index has one entry, else unlinked unless ``disambiguate`` settles it.

    Repeats at one place with one outcome count once.
    """
    index = author_year_index(references)
    joined = markers.withColumn("key", surname_key(F.col("surname"))).join(index, ["paper", "key", "year"], "left")
    linked = joined.withColumn("link_method", F.when(F.col("raw_ref").isNotNull(), "author_year_unique").otherwise("unlinked")).withColumn("link_confidence", F.when(F.col("raw_ref").isNotNull(), 0.9).otherwise(0.0))
    if disambiguate is not None:
        linked = disambiguate(linked)
    return linked.groupBy("paper", "page", "style", "raw_marker", "start", "end", "raw_ref").agg(F.min_by(F.struct("link_method", "link_confidence"), "pair").alias("l")).select("paper", "page", "style", "raw_marker", "start", "end", "raw_ref", "l.link_method", "l.link_confidence")


def link_all(pages: DataFrame, references: DataFrame, disambiguate=None) -> DataFrame:
    """All three scans of pages(paper, page, text) in one table."""
    author_year = link_author_year(paren_markers(pages).unionByName(narrative_markers(pages)), references, disambiguate)
    return link_numbered(pages, references).drop("number").unionByName(author_year)


def violations(citances: DataFrame) -> DataFrame:
    """Citances that break a rule: unlinked exactly without a reference, confidence from 0 to 1."""
    linked = F.col("link_method") != "unlinked"
    has = F.coalesce(F.col("raw_ref"), F.lit("")) != ""
    return citances.where((linked != has) | ~F.coalesce(F.col("link_confidence").between(0, 1), F.lit(False)))
