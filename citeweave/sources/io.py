"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from citeweave import schemas
from citeweave.functions.text import shorten
from citeweave.operators import cocite

# readers


def read_refs_csv(spark: SparkSession, path: str, raw_column: str = "raw") -> DataFrame:
    """(citing_paper_id, raw): the given column, else raw, else empty; a missing id is empty."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    cell = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(F.coalesce(cell("citing_paper_id"), F.lit("")).alias("citing_paper_id"), F.coalesce(cell(raw_column), cell("raw"), F.lit("")).alias("raw"))


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """Rows of a JSON-lines artefact; a missing one has none, malformed lines are skipped."""
    try:
        return spark.read.schema(schema).json(path, mode=mode)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_citances(spark: SparkSession, path: str) -> DataFrame:
    """Citances with a marker; short rows without one serve as lookup context only."""
    return read_jsonl(spark, path, schemas.CITANCE).where("marker is not null")


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows by id, the last one of each id. The file must exist."""
    rows = spark.read.schema(schemas.CANONICAL).json(path)
    ordered = rows.withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    others = [c for c in rows.columns if c != "canonical_id"]
    return ordered.groupBy("canonical_id").agg(F.max_by(F.struct(*others), "_at").alias("r")).select("canonical_id", "r.*")


def read_precleaned(spark: SparkSession, path: str) -> DataFrame:
    """(citing_paper_id, raw, cleaned) of a written table; empty cells are empty strings."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("citing_paper_id", "raw", "cleaned")])


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(raw, canonical_id): the last row of each raw string. The file must exist."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    ordered = rows.withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    return ordered.groupBy("raw").agg(F.max_by("canonical_id", "_at").alias("canonical_id"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the PDF files of a folder; FileNotFoundError for a missing folder or one without any."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
        empty = files.select("path").isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(path) from e
    if empty:
        raise FileNotFoundError(f"no PDF in {path}")
    return files


def read_pdf_spans(spark: SparkSession, path: str) -> DataFrame:
    """(paper, ord, text, size): type spans of first pages, for titles; needs a PDF library on the executors."""

    def run(frames: Iterator) -> Iterator:
        import fitz
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame.path, frame.content):
                with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                    found = [(s["text"].strip(), float(s["size"])) for block in (pdf[0].get_text("dict")["blocks"] if len(pdf) else []) for line in block.get("lines", []) for s in line["spans"]]
                yield pd.DataFrame({"paper": [os.path.basename(name)] * len(found), "ord": range(len(found)), "text": [t for t, _ in found], "size": [x for _, x in found]})

    return pdf_files(spark, path).mapInPandas(run, "paper string, ord int, text string, size double")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(paper, page, text) of the PDF files of a folder; needs a PDF library on the executors."""

    def run(frames: Iterator) -> Iterator:
        import fitz
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame.path, frame.content):
                with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                    yield pd.DataFrame({"paper": [os.path.basename(name)] * len(pdf), "page": range(1, len(pdf) + 1), "text": [p.get_text("text") for p in pdf]})

    return pdf_files(spark, path).mapInPandas(run, "paper string, page int, text string")


def read_config(path: str) -> dict:
    """A JSON or YAML configuration; YAML needs its library."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f) or {}
        return json.load(f)


# writers


def write_jsonl(df: DataFrame, path: str) -> None:
    """One row a line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested cells as JSON text; white space around a cell stays."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def raw_refs(documents: DataFrame) -> DataFrame:
    """(citing_paper_id, raw) of parsed documents with a list of references."""
    return documents.select("citing_paper_id", F.explode("references").alias("raw"))


def citance_rows(documents: DataFrame) -> DataFrame:
    """The citances of parsed documents, one row each."""
    return documents.select(F.explode("citances").alias("c")).select("c.*")


def write_precleaned(cleaned: DataFrame, path: str) -> None:
    """(citing_paper_id, raw, cleaned) as CSV."""
    write_csv(cleaned.select("citing_paper_id", "raw", "cleaned"), path)


def cocited_table(ranked: DataFrame) -> DataFrame:
    """Report columns as text: authors and sources joined, confidence with two places, nulls empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return ranked.select("rank", "cocitation_count", "in_text_hits", text("global_citation_count").alias("global_citation_count"), text("title").alias("title"), F.array_join("authors", "; ").alias("authors"), text("year").alias("year"), text("venue").alias("venue"), text("doi").alias("doi"), "canonical_id", F.array_join("citing_source_ids", ";").alias("citing_source_ids"), F.format_string("%.2f", "confidence").alias("confidence"))


# reports: text of a bounded number of rows


def markdown_report(ranked: DataFrame, query: str, papers: list[str], most: int = 50) -> str:
    """Header, source list and a table of the first ``most`` works."""
    cell = lambda s: str(s if s is not None else "").replace("|", "\\|")
    lines = [f"# Co-cited works: {query}", "", f"Source papers: {len(papers)}", "", *(f"- {p}" for p in papers), "", "| Rank | Co-citations | In text | Global | Title | Authors | Year |", "|---|---|---|---|---|---|---|"]
    for r in ranked.orderBy("rank").limit(most).collect():
        names = "; ".join((r.authors or [])[:3]) + (" et al." if len(r.authors or []) > 3 else "")
        world = "—" if r.global_citation_count is None else r.global_citation_count
        lines.append(f"| {r['rank']} | {r.cocitation_count} | {r.in_text_hits} | {world} | {cell(r.title)} | {cell(names)} | {cell(r.year)} |")
    return "\n".join(lines) + "\n"


def in_context_report(ranked: DataFrame, occurrences: DataFrame, n_sources: int, most: int = 10, per_work: int = 200) -> str:
    """Passages of the first ``most`` works that have any, by paper; the most quoted work on top.

    A work shows its first ``per_work`` passages by paper and page; the count
    is that of all.
    """
    counted = occurrences.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("hits"))
    cited = ranked.join(counted, "canonical_id")
    best = cited.orderBy(F.col("hits").desc(), "rank").limit(1).collect()
    first = cited.orderBy("rank").limit(most)
    if not best:
        return "## In context\n\nNo passages.\n"
    window = cocite.Window.partitionBy("canonical_id").orderBy("citing_paper_id", "page", "context")
    shown = occurrences.join(F.broadcast(first.select("canonical_id", "rank", "title", "hits")), "canonical_id").withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= per_work)
    lines = ["## In context", "", f"Most quoted: {best[0].title} ({best[0].hits} passages in {n_sources} papers)"]
    work = paper = None
    for r in shown.select("rank", "title", "hits", "citing_paper_id", "page", shorten(F.col("context")).alias("context"), "_n").orderBy("rank", "_n").collect():
        if r["rank"] != work:
            work, paper = r["rank"], None
            lines += ["", f"### {r['rank']}. {r.title} ({r.hits})"]
        if r.citing_paper_id != paper:
            paper = r.citing_paper_id
            lines += ["", f"**{paper}**"]
        lines.append(f"- p. {'?' if r.page is None else r.page}: {r.context}")
    return "\n".join(lines) + "\n"


def json_report(ranked: DataFrame, query: str, papers: list[str], most: int = 1000) -> str:
    rows = [json.loads(x) for x in ranked.orderBy("rank").limit(most).toJSON().collect()]
    return json.dumps({"query": query, "source_papers": papers, "records": rows}, ensure_ascii=False, indent=2)


def bundle(path: str, reports: dict[str, str], structured: dict[str, str], pdfs: dict[str, str] | None = None) -> None:
    """A ZIP with README.txt, reports/, structured/ and source_pdfs/; values are local files."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("README.txt", "reports: rankings and passages\nstructured: tables behind them\nsource_pdfs: input papers\n")
        for folder, files in (("reports", reports), ("structured", structured), ("source_pdfs", pdfs or {})):
            for name, file in files.items():
                if os.path.exists(file):
                    z.write(file, f"{folder}/{name}")
