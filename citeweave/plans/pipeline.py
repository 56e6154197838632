"""The whole resolution pipeline as a chain of lazy tables with resumable artefacts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import context, sentences, with_cleaned
from citeweave.operators import citances, cluster, cocite, parse, resolve
from citeweave.plans.hooks import agent_over, extract_with, fallback_with, judge_with, offline_agent
from citeweave.plans.log import StageLog
from citeweave.plans.refs import extract
from citeweave.sources.scratch import materialize

STAGES = ("parse", "preclean", "extract", "cluster", "resolve", "cocite")


@dataclass
class Workdir:
    """Parquet artefacts of one run: those before ``force_from`` are reread where they exist, the rest are computed."""

    spark: SparkSession
    path: str
    resume: bool = True
    force_from: str | None = None
    log: list[str] = field(default_factory=list)
    stages: StageLog = field(default_factory=lambda: StageLog(STAGES))

    def stage(self, name: str, make) -> DataFrame:
        with self.stages.running(name):
            found = self._stage(name, make)
            self.stages.info(name, self.log[-1])
            return found

    def _stage(self, name: str, make) -> DataFrame:
        at, forced = f"{self.path}/{name}", self.force_from is not None and STAGES.index(name) >= STAGES.index(self.force_from)
        if self.resume and not forced:
            try:
                found = self.spark.read.parquet(at)
                self.log.append(f"{name}: loaded")
                return found
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        make().write.mode("overwrite").parquet(at)
        self.log.append(f"{name}: computed")
        return self.spark.read.parquet(at)


def parse_pages(pages: DataFrame, parser: Callable[[DataFrame], DataFrame] | None = None, fallback: Callable[[str], list[str]] | None = None, disambiguate: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, citances, quality) of pages(paper, page, text).

    ``parser`` (docs in, references out) takes the place of the heuristic one;
    ``fallback`` reads the papers again whose quality is too low;
    ``disambiguate`` settles author-year markers with several candidates.
    """
    docs = materialize(parse.reference_section(parse.documents(pages)), "sections")
    found = materialize((parser or parse.references)(docs), "references")
    quality = parse.quality(found, docs).withColumn("fallback_invoked", F.lit(False))
    if fallback is not None:
        found, quality = fallback_with(docs, found, quality.drop("fallback_invoked"), fallback)
        found = materialize(found, "references")
    body = materialize(parse.body_pages(docs), "body")
    bounded = body.withColumn("_bounds", sentences(F.col("text")))
    linked = citances.link_all(body, found, disambiguate).join(bounded, ["paper", "page"]).withColumn("context", context(F.col("text"), F.col("start"), F.col("end"), bounds=F.col("_bounds"))).drop("text", "_bounds")
    return found, linked, quality


def resolve_refs(
    refs: DataFrame, work: Workdir | None = None, agent: Callable[[DataFrame], DataFrame] | None = offline_agent, auto: float = cluster.AUTO, high: float = cluster.HIGH, low: float = cluster.LOW,
    extractor: Callable[[list[str]], list[dict]] | None = None, judge: Callable[[list[dict]], dict] | None = None, cluster_agent: Callable[[list[dict]], dict] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """refs(citing_paper_id, raw[, ord]) to cleaned, quarantine, clustered, decided, canonical, mapping, review and ranked tables.

    Models take the place of the offline steps: ``extractor`` maps cleaned
    strings to records (failures go to quarantine), ``embed`` adds the array
    column vector to the records, ``judge`` decides clusters that no rule does,
    ``cluster_agent`` those it leaves uncertain or wants looked up, seeing all
    members; ``agent`` maps verdict rows to verdict rows.
    """
    keep = work.stage if work else lambda name, make: materialize(make(), name)
    ordered = refs if "ord" in refs.columns else refs.withColumn("ord", F.monotonically_increasing_id())
    cleaned = keep("preclean", lambda: with_cleaned(ordered))
    extracted = keep("extract", lambda: extract(cleaned).withColumn("_error", F.lit(None).cast("string")) if extractor is None else extract_with(cleaned, extractor))
    quarantine = extracted.where("_error is not null").select("ord", "citing_paper_id", "raw", "cleaned", "_error")
    valid = cluster.block(extracted.where("_error is null").drop("_error"))
    records = valid if embed is None else materialize(embed(valid), "embedded")
    clustered = keep("cluster", lambda: cluster.cluster(records, auto, high, low, vector=None if embed is None else "vector"))
    judged = resolve.verdicts(clustered)
    if judge is not None:
        judged = materialize(judge_with(clustered, judged, judge), "judged")
    if cluster_agent is not None:
        judged = materialize(agent_over(clustered, judged, cluster_agent), "settled")
    decided = keep("resolve", lambda: resolve.decide(clustered, judged, agent=agent))
    canonical, mapping = resolve.last_wins(resolve.canonical_rows(decided), "canonical_id", "group_id"), resolve.mapping(decided)
    found = cocite.resolve_raws(ordered, mapping)
    ranked = keep("cocite", lambda: cocite.rank_all(canonical.join(cocite.counts(found), "canonical_id").join(cocite.sources(found), "canonical_id")))
    return {"cleaned": cleaned, "quarantine": quarantine, "clustered": clustered, "decided": decided, "canonical": canonical, "mapping": mapping, "review": resolve.review_queue(decided), "ranked": ranked}


def resolve_pages(pages: DataFrame, work: Workdir | None = None, parser=None, fallback=None, disambiguate=None, **how) -> dict[str, DataFrame]:
    """Pages of papers to everything ``resolve_refs`` gives, with citances and their occurrences; hooks as in both."""
    found, linked, quality = parse_pages(pages, parser, fallback, disambiguate)
    refs = found.select(F.col("paper").alias("citing_paper_id"), F.col("raw_ref").alias("raw"), F.xxhash64("paper", "ordinal").alias("ord"))
    out = resolve_refs(refs, work, **how)
    return out | {"references": found, "citances": linked, "quality": quality, "headline": cocite.headline(found), "occurrences": cocite.occurrences(linked, out["mapping"])}


def stub_papers(spark: SparkSession, n: int = 3) -> DataFrame:
    """Pages of ``n`` invented papers that share two references and have one of their own."""
    rows = []
    for k in range(n):
        refs = ["[1] Smith, J. (2020). Shared foundations of citing. Venue.", "[2] Jones, B. (2021). A second shared source of all. Venue.", f"[3] Nguyen, C. (20{10 + k}). Own work number {k} of the paper. Venue."]
        rows.append((f"W{k:04d}", 1, "We build on [1] and [2].\nSee also [1-3].\nReferences\n" + "\n".join(refs)))
    return spark.createDataFrame(rows, "paper string, page int, text string")
