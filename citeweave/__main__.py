"""spark-submit citeweave refs|pages|eval: the pipelines from files to tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from citeweave.operators.evaluate import pair_f1
from citeweave.operators.resolve import canonical_record
from citeweave.plans.pipeline import STAGES, Workdir, resolve_pages, resolve_refs
from citeweave.sources import io


def main(args: list[str] | None = None) -> None:
    """refs: CSV of raw references; pages: Parquet of (paper, page, text); eval: CSV with raw and canonical_id."""
    parser = argparse.ArgumentParser(prog="citeweave", description=main.__doc__)
    parser.add_argument("what", choices=("refs", "pages", "eval"))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--raw-column", default="raw")
    parser.add_argument("--force-from", choices=STAGES)
    parser.add_argument("--no-resume", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("citeweave").getOrCreate()
    work = Workdir(spark, f"{given.output}/stages", not given.no_resume, given.force_from)
    if given.what == "pages":
        out = resolve_pages(spark.read.parquet(given.input), work)
        io.write_jsonl(out["citances"], f"{given.output}/citances")
        io.write_csv(out["quality"], f"{given.output}/quality")
    else:
        out = resolve_refs(io.read_refs_csv(spark, given.input, given.raw_column), work)
    io.write_precleaned(out["cleaned"], f"{given.output}/precleaned")
    if not out["quarantine"].isEmpty():
        io.write_jsonl(out["quarantine"], f"{given.output}/quarantine")
    io.write_csv(canonical_record(out["canonical"]), f"{given.output}/canonical_refs")
    io.write_csv(out["mapping"], f"{given.output}/raw_to_canonical")
    io.write_jsonl(out["review"], f"{given.output}/review_queue")
    io.write_csv(out["ranked"], f"{given.output}/cocited_refs")
    if given.what == "eval":
        gold = spark.read.csv(given.input, header=True, multiLine=True, escape='"').select("raw", F.col("canonical_id").alias("gold"))
        cleaned = out["cleaned"].select("raw", "cleaned").distinct()
        found = gold.join(cleaned, "raw", "left").join(out["mapping"].select(F.col("raw").alias("cleaned"), F.col("canonical_id").alias("predicted")), "cleaned", "left")
        pair_f1(found).show(truncate=False)


if __name__ == "__main__":
    main()
