"""Models and parsers in place of the offline steps, with answers that fail in part."""

import pytest
from pyspark.sql import functions as F

from citeweave.functions.jsonlist import flat_items
from citeweave.functions.text import title_case
from citeweave.operators import cocite, resolve
from citeweave.plans import hooks, pipeline
from citeweave.sources import io

REFS = [(1, "p", "Smith, J. (2020). Shared foundations of citing. Venue."), (2, "q", "Smith, J. (2020). Shared foundations of citing. Venue."), (3, "q", "Jones, B. (2021). A broken record of things. Venue.")]


def refs(spark, rows=REFS):
    return spark.createDataFrame(rows, "ord long, citing_paper_id string, raw string")


def test_an_extractor_that_fails_in_part(spark):
    def model(batch):
        if any("broken" in x for x in batch):
            raise ValueError("no answer")
        return [{"surname": "Smith", "given": "Jane", "year": "2020", "title": "Shared foundations of citing", "type": "book", "doi": "10.1/x", "pages": "1-2", "volume": 7} for _ in batch]

    out = pipeline.resolve_refs(refs(spark), extractor=model)
    assert [(r.ord, r._error) for r in out["quarantine"].collect()] == [(3, "no answer")]
    (row,) = resolve.canonical_record(out["canonical"]).collect()
    assert [(a.surname, a.given) for a in row.authors] == [("Smith", "Jane")]
    assert (row.year, row.type, row.doi, row.volume, row.pages, row.venue) == (2020, "book", "10.1/x", "7", "1-2", None)
    assert row.__fields__ == ["canonical_id", "authors", "year", "title", "venue", "type", "doi", "volume", "pages", "raw_variants", "confidence"]
    assert out["ranked"].first().cocitation_count == 2


def test_offline_records_have_all_columns(spark):
    out = pipeline.resolve_refs(refs(spark))
    assert out["quarantine"].isEmpty()
    rows = resolve.canonical_record(out["canonical"]).collect()
    assert len(rows) == 2 and all(r.type == "unknown" and r.doi is None and r.authors[0].given is None for r in rows)


def test_judge_and_agent_see_whole_clusters(spark):
    rows = [(k, f"p{k}", f"Smith, J. (2020). {t}. Venue.") for k, t in enumerate(["Deep residual learning for images", "Deep residual learning of sounds", "An unrelated work on rivers"])]

    def judge(members):
        if not any("residual" in m["title"] for m in members):
            raise ValueError("not asked for")
        return {"verdict": "different", "confidence": 0.9, "needs_external_lookup": True}

    def agent(members):
        assert len(members) >= 2 and {"surname", "year", "title", "raw"} <= members[0].keys()
        return {"verdict": "same", "confidence": 0.8}

    plain = pipeline.resolve_refs(refs(spark, rows))
    open_ = plain["clustered"].where("tier in ('candidate', 'borderline')").count()
    assert open_ == 2, "the fixture has one cluster that no rule decides"
    judged = pipeline.resolve_refs(refs(spark, rows), judge=judge)
    assert judged["canonical"].count() == 3
    settled = pipeline.resolve_refs(refs(spark, rows), judge=judge, cluster_agent=agent)
    assert settled["canonical"].count() == 2
    broken = pipeline.resolve_refs(refs(spark, rows), judge=lambda members: 1 / 0)
    assert broken["review"].first().reason == "uncertain"


def test_an_embedder_decides_what_is_alike(spark):
    rows = [(1, "p", "Smith, J. (2020). Alpha beta gamma. Venue."), (2, "q", "Smith, J. (2020). Wholly other words. Venue.")]
    same = pipeline.resolve_refs(refs(spark, rows), embed=lambda r: r.withColumn("vector", F.array(F.lit(1.0), F.lit(0.5))))
    assert same["canonical"].count() == 1
    assert pipeline.resolve_refs(refs(spark, rows))["canonical"].count() == 2


def test_parser_fallback_and_disambiguation(spark):
    pages = pipeline.stub_papers(spark, 2)
    own = lambda docs: docs.select("paper", F.lit(1).alias("ordinal"), F.lit("Own parser's only reference (2001).").alias("raw_ref"))
    found, _, quality = pipeline.parse_pages(pages, parser=own)
    assert {r.raw_ref for r in found.collect()} == {"Own parser's only reference (2001)."} and not quality.first().fallback_invoked
    tries = spark.sparkContext.accumulator(0)

    def again(text):
        tries.add(1)
        if "number 0" in text:
            raise ValueError("never answers")
        return [f"Read again {k} (20{k:02d})." for k in range(9)]

    found, _, quality = pipeline.parse_pages(pages, fallback=again)
    counts = {r.paper: r.n for r in found.groupBy("paper").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"W0000": 3, "W0001": 9} and tries.value == 3
    assert all(r.fallback_invoked for r in quality.collect())
    settle = lambda rows: rows.withColumn("link_method", F.when(F.col("raw_ref").isNull(), "llm_disambiguated").otherwise(F.col("link_method")))
    texts = spark.createDataFrame([("w", 1, "As Vance (2019) says.\nReferences\n[1] Smith, J. (2020). Some title of a work. V.\n[2] Doe, A. (2021). Another title of work. V.")], "paper string, page int, text string")
    linked = pipeline.parse_pages(texts, disambiguate=settle)[1]
    assert [r.link_method for r in linked.where("style = 'narrative_author_year'").collect()] == ["llm_disambiguated"]


def test_stage_log_and_headline(spark, tmp_path):
    work = pipeline.Workdir(spark, str(tmp_path / "w"))
    out = pipeline.resolve_pages(pipeline.stub_papers(spark), work)
    assert {s["status"] for s in work.stages.snapshot().values()} >= {"done"} and "[cluster] done" in work.stages.flat_text()
    assert tuple(out["headline"].first()) == (3, 9)
    numbered = cocite.in_order(out["occurrences"], ["paper", "page", "start"])
    assert numbered.groupBy("canonical_id").agg(F.max("number").alias("n")).agg(F.max("n")).first()[0] == 6
    alone = cocite.without_papers(out["canonical"]).collect()
    assert all(r.cocitation_count == 1 and r.citing_source_ids == [] for r in alone)


def test_files(spark, tmp_path):
    cleaned = spark.createDataFrame([("p", 'a "b"', "c, d"), ("", "x", "y")], "citing_paper_id string, raw string, cleaned string")
    io.write_precleaned(cleaned, str(tmp_path / "pre"))
    assert sorted(map(tuple, io.read_precleaned(spark, str(tmp_path / "pre")).collect())) == sorted(map(tuple, cleaned.collect()))
    (tmp_path / "m.csv").write_text("raw,canonical_id,confidence\nx,1,0.9\ny,2,0.9\nx,3,0.9\n")
    assert {r.raw: r.canonical_id for r in io.read_mapping(spark, str(tmp_path / "m.csv")).collect()} == {"x": "3", "y": "2"}
    docs = spark.createDataFrame([(["a"], [("p", "c1"), ("p", "c2")])], "references array<string>, citances array<struct<citing_paper_id:string,context:string>>")
    assert [r.context for r in io.citance_rows(docs).collect()] == ["c1", "c2"]
    (tmp_path / "none").mkdir()
    for path in ("none", "missing"):
        with pytest.raises(FileNotFoundError):
            io.pdf_files(spark, str(tmp_path / path))


def test_small_functions(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    assert one(title_case(F.lit("the art of  the iPhone and an end to"))) == "The Art of the iPhone and an End To"
    assert one(title_case(F.lit("DEEP LEARNING IN PRACTICE"))) == "Deep Learning in Practice"
    assert one(flat_items(F.lit('[{"a": 1}, [{"a": 2}, 5], "x"]'))) == ['{"a":1}', '{"a":2}']
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early")], "key string, at int, v string")
    assert resolve.first_wins(rows, "key", "at").first().v == "early"
    judged = spark.createDataFrame([(1, "same", 0.6, True, ("t",)), (2, "same", 0.6, False, ("u",))], "cluster_id long, verdict string, confidence double, needs_external_lookup boolean, head struct<title:string>")
    found = {r.cluster_id: r.verdict for r in hooks.agent_with(judged, lambda t: {"verdict": "different", "confidence": 0.5}).collect()}
    assert found == {1: "different", 2: "same"}
