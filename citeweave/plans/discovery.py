"""From a search to co-cited works: papers of a works table, their pages, the pipeline, enrichment and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators import cocite, discover
from citeweave.plans.pipeline import Workdir, resolve_pages
from citeweave.sources.scratch import materialize

ENRICHED = 30


def source_papers(works: DataFrame, n: int, query: str | None = None, author: str | None = None, topic: str | None = None, authors: DataFrame | None = None, sort_by: str = "relevance", min_year: int | None = None) -> tuple[str, DataFrame]:
    """(mode, papers): by exactly one of query, author and topic; an unknown author has no papers."""
    mode = discover.one_input(query=query, author=author, topic=topic)
    if mode == "author":
        return mode, discover.author_works(works, discover.resolve_author(authors, author), n)
    return mode, discover.search(works, n, sort_by, min_year, terms=query or topic)


def run_discovery(works: DataFrame, pages: DataFrame, n: int = 3, enriched: int | None = ENRICHED, work: Workdir | None = None, **search) -> dict:
    """mode, papers, and the tables of ``resolve_pages`` with ranked enriched: counts of works(doi, cited_by_count) for the first ``enriched``.

    ``pages`` is (paper, page, text), paper being a work_id as text. Records get
    in_text_hits and the DOI of the work with their title, if the table has it.
    """
    mode, papers = source_papers(works, n, **search)
    chosen = materialize(papers, "papers")
    own = pages.join(F.broadcast(chosen.select(F.col("work_id").cast("string").alias("paper"))), "paper", "left_semi")  # at most n papers
    out = resolve_pages(own, work)
    hits = cocite.hits(out["occurrences"], out["canonical"])
    dois = works.where("doi is not null").groupBy(F.lower(F.trim("title")).alias("_t")).agg(F.min("doi").alias("doi"))
    records = out["ranked"].drop("rank").join(hits, "canonical_id").withColumn("_t", F.lower(F.trim("title"))).join(dois, "_t", "left").drop("_t")
    counted = materialize(cocite.enrich(records, works, enriched), "enriched")
    return out | {"mode": mode, "papers": chosen, "ranked": cocite.rank_all(counted, F.col("global_citation_count"))}


def display(ranked: DataFrame) -> DataFrame:
    """Display columns of a ranking."""
    return ranked.select(F.col("rank").alias("#"), F.col("title").alias("Title"), F.col("surname").alias("First author"), F.col("year").alias("Year"), F.col("cocitation_count").alias("Co-citations"), F.col("in_text_hits").alias("In text"), F.col("global_citation_count").alias("Global"), F.array_join("citing_source_ids", "; ").alias("Sources"), F.col("canonical_id").alias("Id"))
