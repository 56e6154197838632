"""Paper search over a works table: filters, sorts, authors, PDF links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("relevance", "recency", "citations")


def pdf_url(best: Column, open_access: Column) -> Column:
    """The best location's PDF, else the open-access link if it ends in .pdf."""
    return F.coalesce(F.nullif(best, F.lit("")), F.when(F.endswith(F.lower(open_access), F.lit(".pdf")), open_access))


def work_rows(works: DataFrame) -> DataFrame:
    """Search rows: title stripped, counts and scores zero where missing, no empty author names."""
    return works.withColumns({"title": F.trim(F.coalesce("title", F.lit(""))), "cited_by_count": F.coalesce("cited_by_count", F.lit(0)), "relevance_score": F.coalesce("relevance_score", F.lit(0.0)), "authors": F.filter("authors", lambda a: F.coalesce(a, F.lit("")) != "")})


def ordering(sort_by: str) -> list[Column]:
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {SORTS}")
    return {"recency": [F.coalesce("year", F.lit(0)).desc()], "citations": [F.col("cited_by_count").desc()], "relevance": [F.col("relevance_score").desc(), F.col("cited_by_count").desc()]}[sort_by] + [F.col("work_id").asc()]


def search(works: DataFrame, n: int = 3, sort_by: str = "relevance", min_year: int | None = None, require_pdf: bool = True, max_candidates: int = 25, terms: str | None = None) -> DataFrame:
    """The first ``n`` of at most ``max_candidates`` works; works without PDF go after the candidates are taken."""
    found = works if terms is None else works.where(F.contains(F.lower("title"), F.lit(terms.lower())))
    found = found if min_year is None else found.where(F.col("year") >= min_year)
    taken = found.orderBy(*ordering(sort_by)).limit(max_candidates)
    return (taken.where("pdf_url is not null") if require_pdf else taken).orderBy(*ordering(sort_by)).limit(n)


def short_id(url: Column, letter: str = "W") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, f"({letter}\\d+)", 1), F.lit("")), F.lit(f"{letter}unknown"))


def resolve_author(authors: DataFrame, name: str) -> DataFrame:
    """The author row for an id, an id's address, or the most cited one whose name holds ``name``; none if nothing matches."""
    import re

    found = re.search(r"(A\d+)/?$", name.strip())
    if found:
        return authors.where(F.col("author_id") == found[1]).limit(1)
    return authors.where(F.contains(F.lower("display_name"), F.lit(name.strip().lower()))).orderBy(F.col("cited_by_count").desc(), "author_id").limit(1)


def author_works(works: DataFrame, author: DataFrame, n: int = 3) -> DataFrame:
    """The most cited works of the resolved author."""
    return works.join(F.broadcast(author.select("author_id")), "author_id").orderBy(F.col("cited_by_count").desc(), "work_id").limit(n)


def one_input(**given) -> str:
    """The name of the one input mode that is set; ValueError for none or several."""
    names = [k for k, v in given.items() if v]
    if len(names) != 1:
        raise ValueError("exactly one of " + ", ".join(given) + " must be given")
    return names[0]
