import json
import zipfile

import pytest
from pyspark.sql import functions as F

from citeweave import schemas
from citeweave.operators import discover
from citeweave.plans import hooks, pipeline
from citeweave.sources import io
from citeweave.streaming import ingest


def test_pages_to_ranked_works_and_reports(spark, tmp_path):
    out = pipeline.resolve_pages(pipeline.stub_papers(spark))
    ranked = out["ranked"].orderBy("rank").collect()
    assert [r.cocitation_count for r in ranked] == [3, 3, 1, 1, 1]
    hits = {r.canonical_id: r.n for r in out["occurrences"].groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert hits[ranked[0].canonical_id] == 6
    shown = out["ranked"].withColumns({"in_text_hits": F.lit(1), "global_citation_count": F.lit(None).cast("int"), "authors": F.array("surname"), "venue": F.lit(None).cast("string"), "doi": F.lit(None).cast("string")})
    assert io.cocited_table(shown).first().confidence in ("0.95", "1.00")
    report = io.markdown_report(shown, "stub", ["W0000"])
    passages = io.in_context_report(out["ranked"], out["occurrences"].withColumn("citing_paper_id", F.col("paper")), 3)
    assert "| 1 | 3 |" in report and "—" in report and "Most quoted" in passages
    assert len(json.loads(io.json_report(out["ranked"], "q", []))["records"]) == 5
    (tmp_path / "r.md").write_text(report)
    io.bundle(str(tmp_path / "b.zip"), {"r.md": str(tmp_path / "r.md")}, {})
    assert zipfile.ZipFile(tmp_path / "b.zip").namelist() == ["README.txt", "reports/r.md"]


def test_stages_resume(spark, tmp_path):
    refs = spark.createDataFrame([(1, "a", "Smith, J. (2020). One title here. V."), (2, "b", "Smith, J. (2020). One title here. V.")], "ord long, citing_paper_id string, raw string")
    first = pipeline.Workdir(spark, str(tmp_path / "w"))
    pipeline.resolve_refs(refs, first)
    again = pipeline.Workdir(spark, str(tmp_path / "w"), force_from="cluster")
    out = pipeline.resolve_refs(refs, again)
    assert {x.split(": ")[1] for x in first.log} == {"computed"}
    assert [x for x in again.log if "loaded" in x] == ["preclean: loaded", "extract: loaded"]
    assert out["ranked"].first().cocitation_count == 2


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "refs.csv").write_text('citing_paper_id,raw,alt\np,"a ""quoted""\nref",\n,b,c\n')
    assert [tuple(r) for r in io.read_refs_csv(spark, str(tmp_path / "refs.csv"), "alt").collect()] == [("p", 'a "quoted"\nref'), ("", "c")]
    rows = [{"citing_paper_id": "p", "raw_ref": None, "context": "c", "marker": {"style": "numbered_bracket", "raw_marker": "[1]", "page": 1, "char_span": [0, 3]}, "link_method": "unlinked", "link_confidence": 0.0}, {"citing_paper_id": "p", "raw_ref": "r", "context": "c"}]
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(rows[0]), "", "{broken", json.dumps(rows[1])]))
    assert io.read_citances(spark, str(tmp_path / "c.jsonl")).count() == 1
    assert io.read_jsonl(spark, str(tmp_path / "none"), schemas.RAW_REF).count() == 0
    io.write_jsonl(io.read_citances(spark, str(tmp_path / "c.jsonl")), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert json.loads(text)["raw_ref"] is None
    io.write_csv(spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>"), str(tmp_path / "csv"))
    assert '["a","b"]' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*")).replace('""', '"')
    lines = [{"canonical_id": "x", "title": t, "authors": []} for t in ("old", "new")]
    (tmp_path / "k.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert io.read_canonical(spark, str(tmp_path / "k.jsonl")).first().title == "new"


def test_hooks(spark):
    def call(batch):
        if any("bad" in x for x in batch):
            raise ValueError("no")
        return [{"surname": x.split()[0], "year": 2020, "title": None} for x in batch]

    rows = spark.createDataFrame([(k, v) for k, v in enumerate(["Smith a", "bad one", "Roe b"])], "ord long, cleaned string")
    got = {r.ord: r for r in hooks.extract_with(rows, call).collect()}
    assert got[0].surname == "Smith" and got[1]._error == "no" and got[2].year == 2020
    assert hooks.tool_loop(lambda talk: {"tool": "t"}, {"t": lambda: "x"}, "?")["tool_calls_used"] == 5
    assert hooks.tool_loop(lambda talk: {"verdict": "same", "confidence": 1.0}, {}, "?")["verdict"] == "same"
    assert spark.sql("select cast(null as string) t").select(hooks.topic(F.col("t"))).first()[0] == "machine learning"
    assert discover.one_input(query="x", topic=None) == "query"
    with pytest.raises(ValueError):
        discover.one_input(query="x", topic="y")


def test_stream_takes_each_marker_once(spark, tmp_path):
    row = {"citing_paper_id": "p", "raw_ref": "r", "context": "c", "marker": {"style": "numbered_bracket", "raw_marker": "[1]", "page": 1, "char_span": [0, 3]}, "link_method": "numbered_direct", "link_confidence": 1.0}
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(row))
        stream = ingest.distinct_citances(ingest.stream_citances(spark, str(tmp_path / "in")))
        ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_discovery_to_ranking(spark):
    from citeweave.plans import discovery

    works = spark.createDataFrame([(f"W{k:04d}", "A1", f"topic paper {k}", 2000 + k, None, 10 * k, "a.pdf", 1.0) for k in range(3)] + [("S", "A2", "Shared foundations of citing", 2020, "https://doi.org/10.1/x", 77, None, 0.0)], "work_id string, author_id string, title string, year int, doi string, cited_by_count int, pdf_url string, relevance_score double")
    out = discovery.run_discovery(works, pipeline.stub_papers(spark), 3, topic="topic")
    first = out["ranked"].orderBy("rank").first()
    assert out["mode"] == "topic" and (first.title, first.cocitation_count, first.global_citation_count, first.in_text_hits) == ("Shared foundations of citing", 3, 77, 6)
    assert discovery.display(out["ranked"]).count() == 5


def test_cache_log_downloads_and_lookup(spark, tmp_path):
    from citeweave.plans.log import StageLog
    from citeweave.sources import cache

    rows = spark.createDataFrame([("Smith 2020", "Smith", 2020, "old")], "cleaned string, surname string, year int, title string")
    path = str(tmp_path / "cache")
    assert cache.read(spark, path, "v").count() == 0
    cache.append(rows, path, "v")
    cache.append(rows.withColumn("title", F.lit("new")), path, "v")
    hits, misses = cache.split(spark.createDataFrame([("Smith 2020",), ("Roe 2021",)], "cleaned string"), cache.read(spark, path, "v"))
    assert [r.title for r in hits.collect()] == ["new"] and [r.cleaned for r in misses.collect()] == ["Roe 2021"]
    log = StageLog(("a", "b"))
    with pytest.raises(ValueError), log.running("a"):
        raise ValueError("broken")
    with log.running("b") as at:
        at.progress("b", 1, 2)
    assert log.snapshot()["a"]["status"] == "error" and "[b] done" in log.flat_text() and "broken" in log.flat_text()

    def fetch(url):
        if "fail" in url:
            raise OSError("down")
        return ("text/html" if "page" in url else "application/pdf"), b"x" * (10 if "small" in url else 2000)

    urls = spark.createDataFrame([("u/fail",), ("u/page",), ("u/small.pdf",), ("u/ok",)], "url string")
    got = {r.url: r for r in hooks.download_with(urls, fetch, pause=0).collect()}
    assert got["u/ok"].error is None and got["u/fail"].error == "down" and got["u/page"].error.startswith("not a PDF") and got["u/small.pdf"].error == "10 bytes"
    works = spark.createDataFrame([("On graphs and trees", 2001), ("On graphs and more", 2000)], "title string, year int")
    found = hooks.lookup_works(spark.createDataFrame([(1, "On Graphs and trees!", 2001), (2, None, 1)], "ord long, title string, year int"), works).collect()
    assert [(r.ord, r.found[0].title, len(r.found)) for r in found] == [(1, "On graphs and trees", 2)]


def test_command_line(spark, tmp_path, capsys):
    from citeweave.__main__ import main

    (tmp_path / "in.csv").write_text('raw,canonical_id\n"Smith, J. (2020). One title here. V.",g1\n"Smith J 2020. One title here. J.",g1\n"Roe, K. (2001). Other words. V.",g2\n')
    main(["eval", str(tmp_path / "in.csv"), str(tmp_path / "out")])
    assert "1.0" in capsys.readouterr().out
    assert (tmp_path / "out" / "cocited_refs").exists()
