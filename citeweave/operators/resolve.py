"""Decision table from clusters to canonical references and a review queue.

Only what a decision needs is aggregated: a cluster's first member, its
longest title and whether all titles agree with the first. Members are never
gathered, except as the list of distinct raw variants of a canonical row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.keys import canonical_id, characters, jaccard
from citeweave.schemas import WORK_TYPES
from citeweave.sources.scratch import materialize

SIMILAR_CHARACTERS = 0.6
FIELDS = ("surname", "year", "title")


def _own(rows: DataFrame) -> list[str]:
    """The fields of a record that its canonical row may take; details is a struct of those a model adds."""
    return [*FIELDS, "cleaned", *(["details"] if "details" in rows.columns else [])]


def verdicts(clustered: DataFrame, ord_col: str = "ord") -> DataFrame:
    """(cluster_id, verdict, confidence, first_*, best_*, n): the offline judge over every cluster of several groups.

    same if every title shares over 0.6 of its characters with the first
    member's, uncertain if the first has none, else different. best is the
    longest title, the first member's on ties.
    """
    row = lambda prefix: F.struct(*_own(clustered)).alias(prefix)
    # of equal records the first one stands for all
    each = materialize(clustered.groupBy("cluster_id", "auto_id", *_own(clustered)).agg(F.min(ord_col).alias(ord_col), F.count(F.lit(1)).alias("_n")), "variants")
    heads = each.groupBy("cluster_id").agg(F.min_by(row("h"), F.struct("auto_id", ord_col)).alias("head"), F.max_by(row("b"), F.struct(F.coalesce(F.length("title"), F.lit(0)), -F.col("auto_id"), -F.col(ord_col))).alias("best"), F.sum("_n").alias("n"))
    pairs = each.select("cluster_id", "title").distinct().join(heads.select("cluster_id", F.col("head.title").alias("head_title")), "cluster_id")
    agree = jaccard(characters(F.col("head_title")), characters(F.col("title"))) > SIMILAR_CHARACTERS
    checked = pairs.groupBy("cluster_id").agg(F.every(agree).alias("all_same"))
    verdict = F.when(F.col("n") <= 1, "different").when(F.coalesce(F.col("head.title"), F.lit("")) == "", "uncertain").when(F.col("all_same"), "same").otherwise("different")
    return heads.join(checked, "cluster_id").select("cluster_id", verdict.alias("verdict"), F.when(F.col("n") <= 1, 1.0).otherwise(0.6).alias("confidence"), F.lit(False).alias("needs_external_lookup"), "head", "best", "n")


def decide(clustered: DataFrame, judged: DataFrame | None = None, ord_col: str = "ord", agent: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every record with action, reason, group_id, confidence and the fields of its canonical row.

    action is canonical or review. auto and singleton clusters decide by
    themselves; others by the verdict: same is one row, different one for each
    titled member, uncertain goes to ``agent`` (verdict rows in, verdict rows
    out) and to review if that leaves it uncertain.
    """
    judged = verdicts(clustered, ord_col) if judged is None else judged
    if agent is not None:
        judged = agent(judged)
    joined = clustered.join(judged.select("cluster_id", "verdict", F.col("confidence").alias("judged"), "head", "best"), "cluster_id")
    sure = F.col("tier").isin("auto", "singleton")
    lead = F.when(sure, F.col("head")).when(F.col("verdict") == "same", F.col("best")).otherwise(F.struct(*_own(clustered)))
    has = F.coalesce(lead["title"], F.lit("")) != ""
    action = F.when(sure, F.when(has, "canonical").otherwise("review")).when(F.col("verdict") == "uncertain", "review").otherwise(F.when(has, "canonical").otherwise("review"))
    reason = F.when(action == "canonical", F.lit(None)).when(F.col("tier") == "auto", "auto cluster has no title").when(F.col("tier") == "singleton", "singleton with no title").when(F.col("verdict") == "uncertain", "uncertain").otherwise("member has no title")
    whole = sure | (F.col("verdict") == "same")
    group = F.when(whole | (F.col("verdict") == "uncertain"), F.col("cluster_id")).otherwise(F.col(ord_col))
    sureness = F.when(F.col("tier") == "auto", 0.95).when(F.col("tier") == "singleton", 1.0).otherwise(F.coalesce("judged", F.lit(0.7)))
    keep = [c for c in clustered.columns if c not in ("verdict", "judged", "head", "best")]
    return joined.select(*keep, "verdict", action.alias("action"), reason.alias("reason"), group.alias("group_id"), sureness.alias("confidence"), lead["surname"].alias("c_surname"), lead["year"].alias("c_year"), F.trim(lead["title"]).alias("c_title"), *([lead["details"].alias("c_details")] if "details" in clustered.columns else []))


def canonical_rows(decided: DataFrame) -> DataFrame:
    """One row for each canonical group: id, fields, distinct raw variants in a sorted list, confidence."""
    more = ["c_details"] if "c_details" in decided.columns else []
    fields = ("group_id", "c_surname", "c_year", "c_title", "confidence", *more)
    rows = decided.where("action = 'canonical'").select(*fields, "cleaned").distinct().groupBy(*fields).agg(F.sort_array(F.collect_set("cleaned")).alias("raw_variants"))
    return rows.select(canonical_id(F.col("c_surname"), F.col("c_year"), F.col("c_title")).alias("canonical_id"), "group_id", F.col("c_surname").alias("surname"), F.col("c_year").alias("year"), F.col("c_title").alias("title"), "confidence", "raw_variants", *[F.col(c).alias("details") for c in more])


def canonical_record(canonical: DataFrame) -> DataFrame:
    """The eleven columns of a canonical reference; what no extractor gave is null, an unknown kind is unknown."""
    given = lambda name: F.nullif(F.col(f"details.{name}"), F.lit("")) if "details" in canonical.columns else F.lit(None).cast("string")
    names = F.array_compact(F.array(F.when(F.coalesce("surname", F.lit("")) != "", F.struct(F.col("surname"), given("given").alias("given")))))
    kind = F.when(given("type").isin(*WORK_TYPES), given("type")).otherwise("unknown")
    return canonical.select("canonical_id", names.alias("authors"), "year", "title", given("venue").alias("venue"), kind.alias("type"), *[given(c).alias(c) for c in ("doi", "volume", "pages")], "raw_variants", "confidence")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest ``order`` for each ``key``."""
    return _at_end(rows, key, order, F.max, F.max_by)


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the least ``order`` for each ``key``."""
    return _at_end(rows, key, order, F.min, F.min_by)


def _at_end(rows: DataFrame, key: str, order: str, end: Callable, by: Callable) -> DataFrame:
    """One row a ``key``. Equal rows first keep their end of ``order`` alone, in a hash table; only distinct ones are sorted."""
    others = [c for c in rows.columns if c not in (key, order)]
    each = rows.groupBy(key, *others).agg(end(order).alias(order))
    return each.groupBy(key).agg(by(F.struct(*others, order), order).alias("_r")).select(key, "_r.*").select(*rows.columns)


def mapping(decided: DataFrame) -> DataFrame:
    """(raw, canonical_id, confidence): every raw variant once, that of the last canonical group that holds it."""
    own = canonical_id(F.col("c_surname"), F.col("c_year"), F.col("c_title"))
    each = decided.where("action = 'canonical'").select("cleaned", "c_surname", "c_year", "c_title", "confidence", "group_id").distinct()
    rows = each.select(F.col("cleaned").alias("raw"), own.alias("canonical_id"), "confidence", "group_id")
    return last_wins(rows, "raw", "group_id").select("raw", "canonical_id", "confidence")


def review_queue(decided: DataFrame) -> DataFrame:
    """(group_id, reason, n): what needs a person, one row for each undecided group."""
    return decided.where("action = 'review'").groupBy("group_id", "reason").agg(F.count(F.lit(1)).alias("n"))
