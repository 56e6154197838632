"""Co-citation counts, occurrences, ranking and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import preclean
from citeweave.sources.scratch import materialize, once


def resolve_raws(rows: DataFrame, mapping: DataFrame, raw: str = "raw", how: str = "inner") -> DataFrame:
    """``rows`` with canonical_id: by the raw string, else by its cleaned form; rows that neither finds go, unless ``how`` is left."""
    exact = mapping.select(F.col("raw").alias("_exact"), F.col("canonical_id").alias("_one"))
    loose = mapping.select(F.col("raw").alias("_loose"), F.col("canonical_id").alias("_two"))

    def named(strings: DataFrame) -> DataFrame:
        cleaned = strings.withColumn("_cleaned", preclean(F.col(raw)))
        found = cleaned.join(exact, F.col(raw) == F.col("_exact"), "left").join(loose, F.col("_cleaned") == F.col("_loose"), "left")
        return found.select(raw, F.coalesce("_one", "_two").alias("canonical_id")).where("canonical_id is not null")

    return once(rows, raw, named, "named", how)


def counts(resolved: DataFrame, paper: str = "citing_paper_id") -> DataFrame:
    """(canonical_id, cocitation_count): distinct papers, reduced to distinct pairs before they are counted."""
    return resolved.select("canonical_id", paper).distinct().groupBy("canonical_id").agg(F.count(paper).alias("cocitation_count"))


def sources(resolved: DataFrame, paper: str = "citing_paper_id") -> DataFrame:
    """(canonical_id, citing_source_ids): sorted distinct papers."""
    return resolved.groupBy("canonical_id").agg(F.sort_array(F.collect_set(paper)).alias("citing_source_ids"))


def occurrences(citances: DataFrame, mapping: DataFrame) -> DataFrame:
    """Citances with a linked reference and its canonical_id."""
    return resolve_raws(citances.where("raw_ref is not null and raw_ref <> ''"), mapping, "raw_ref")


def in_order(occurring: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences with their number 1.. within their work, in file order ``by``; a work's passages are never gathered in a row."""
    return occurring.withColumn("number", F.row_number().over(Window.partitionBy("canonical_id").orderBy(*by)))


def without_papers(canonical: DataFrame) -> DataFrame:
    """Records where no citing papers are known: each work counts once, has no sources and no rank order."""
    return canonical.select("canonical_id", "title", F.lit(1).cast("long").alias("cocitation_count"), F.expr("cast(array() as array<string>)").alias("citing_source_ids")).dropDuplicates(["canonical_id"])


def headline(references: DataFrame, paper: str = "paper") -> DataFrame:
    """(papers, references): the counts that head a report, one row."""
    return references.agg(F.count_distinct(F.col(paper)).alias("papers"), F.count(F.lit(1)).alias("references"))


def hits(occurring: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_id, in_text_hits): zero for works that no passage cites."""
    n = occurring.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))
    return canonical.select("canonical_id").distinct().join(n, "canonical_id", "left").select("canonical_id", F.coalesce("n", F.lit(0)).alias("in_text_hits"))


def order(global_count: Column | None = None) -> list[Column]:
    """Co-citations, then global count, both falling, then title; the id settles what is left."""
    world = [F.coalesce(global_count, F.lit(0)).desc()] if global_count is not None else []
    return [F.col("cocitation_count").desc(), *world, F.lower(F.coalesce("title", F.lit(""))).asc(), F.col("canonical_id").asc()]


def top(records: DataFrame, n: int, global_count: Column | None = None) -> DataFrame:
    """The ``n`` best records with their rank, for reports."""
    best = records.orderBy(*order(global_count)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order(global_count))).cast("long"))


def rank_all(records: DataFrame, global_count: Column | None = None, partitions: int = 0) -> DataFrame:
    """Every record with its rank 1..n, without gathering them in one task.

    Records are range-partitioned by the ordering; a record's rank is its place
    in its partition after all earlier partitions.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(records.repartitionByRange(n, *order(global_count)).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("_part").count()  # one row a partition
    ahead = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order(global_count)))
    return placed.withColumn("_own", own).join(F.broadcast(ahead), "_part").withColumn("rank", (F.col("_own") + F.col("_ahead")).cast("long")).drop("_part", "_own", "_ahead")


def enrich(records: DataFrame, works: DataFrame, n: int | None = None) -> DataFrame:
    """``records`` with global_citation_count of works(doi, cited_by_count) by DOI; with ``n``, of the first n by rank only."""
    bare = lambda c: F.lower(F.regexp_replace(c, "^https?://(?:dx\\.)?doi\\.org/", ""))
    wanted = records if n is None else top(records, n).drop("rank")
    counted = wanted.where("doi is not null").select("canonical_id", bare(F.col("doi")).alias("_doi"))
    world = works.groupBy(bare(F.col("doi")).alias("_doi")).agg(F.max("cited_by_count").alias("global_citation_count"))
    return records.join(counted.join(world, "_doi").select("canonical_id", "global_citation_count"), "canonical_id", "left")
