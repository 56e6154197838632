"""Steps that every reference passes: worked out once a string, with few shuffles, and with the results of the plain form."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeweave.functions import text
from citeweave.operators import evaluate, parse, resolve
from citeweave.plans import refs
from citeweave.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_matches(forms, truths, least):
    left, n = list(truths), 0
    for form in forms:
        scores = [SequenceMatcher(None, form, t).ratio() for t in left]
        if scores and max(scores) >= least:
            left.pop(scores.index(max(scores)))
            n += 1
    return n


def test_greedy_matching_compares_only_what_can_win(monkeypatch):
    rng, words = random.Random(3), ["smith", "doe", "and", "1990", "ring", "a", "b"]
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    cases = [([phrase() for _ in range(rng.randint(0, 6))], [phrase() for _ in range(rng.randint(0, 6))], rng.choice([0.5, 2 / 3, 0.8, 0.85])) for _ in range(3000)]
    want = [plain_matches(*c) for c in cases]
    asked = []
    monkeypatch.setattr(evaluate, "SequenceMatcher", lambda *a: asked.append(a) or SequenceMatcher(*a))
    assert [evaluate.matched(*c) for c in cases] == want
    assert len(asked) < sum(len(a) * len(b) for a, b, _ in cases) / 4


def test_white_space_as_one_pattern_would(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice(" \t\n\r\x0b\x1c\x1f\x85\xa0   　aé.~!") for _ in range(rng.randint(0, 12))),) for _ in range(2000)] + [(None,)]
    space = "[\\s\\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
    plain = lambda c: F.regexp_replace(c, f"^{space}+|{space}+$", "")
    frame = spark.createDataFrame(rows, "v string")
    got = frame.select("v", text.strip(F.col("v")).alias("a"), plain(F.col("v")).alias("b"), text.squeeze(F.col("v")).alias("c"), plain(F.regexp_replace("v", f"{space}+", " ")).alias("d"))
    assert got.where("not (a <=> b and c <=> d)").count() == 0
    assert plan(frame.select(text.preclean(F.col("v")).alias("p"))).count("regexp_replace") == 10


@pytest.mark.parametrize("name", ["q_preclean", "q_extract_record", "q_title_cosine_pairs", "q_authors_flat", "q_trigram_buckets", "q_raw_lookup_two_step", "q_quality_report"])
def test_equal_strings_are_worked_out_once(spark, name):
    assert "regexp_replace" not in plan(QUERIES[name](spark, DATA))


def test_a_string_that_none_shares_and_one_of_many(spark):
    rows = refs.refs(spark, DATA)
    kept = refs.cleaned(spark, DATA)
    assert kept.count() == rows.where(text.preclean(F.col("raw")).isNotNull()).count() and kept.columns[:-1] == rows.columns


@pytest.mark.parametrize("name, shuffles", [("q_header_ids", 1), ("q_reference_section", 1), ("q_split_blankline", 1), ("q_stage0_greedy_match", 1)])
def test_papers_are_gathered_once(spark, name, shuffles):
    assert plan(QUERIES[name](spark, DATA)).count("Exchange hashpartitioning") <= shuffles


def test_first_and_last_of_equal_rows(spark):
    rows = spark.createDataFrame([("k", "a", 3), ("k", "a", 1), ("k", "b", 2), ("j", None, 5)], "key string, v string, at int")
    assert sorted(map(tuple, resolve.first_wins(rows, "key", "at").collect())) == [("j", None, 5), ("k", "a", 1)]
    assert sorted(map(tuple, resolve.last_wins(rows, "key", "at").collect())) == [("j", None, 5), ("k", "a", 3)]
    assert "HashAggregate(keys=[key" in plan(resolve.first_wins(rows, "key", "at"))


def plain_split(section):
    """The rules line by line, as a list grows."""
    space = "[\\s\x1c-\x1f\x85\xa0]+"
    new = r"(?:\[[0-9]+\]|[0-9]+\.) |[A-Z][A-Za-z'`-]+, (?:[A-Z]\.|[A-Z][a-z]+)|[A-Z][A-Za-z'`-]+ (?:and|&|et al\.|[A-Z]\.)"
    tidy = lambda x: re.sub(space, " ", x).strip(" ")
    valid = lambda parts: [x for x in map(tidy, parts) if len(x) >= 20 and not re.fullmatch("[0-9]+", x)]
    lines = [tidy(x) for x in section.replace("\r", "\n").split("\n")]
    text = "\n".join(lines)
    for pattern in (r"(?m)^\s*\[[0-9]+\]\s+", r"(?m)^\s*[0-9]+\.\s+"):
        at = [m.start() for m in re.finditer(pattern, text)]
        if len(at) >= 2:
            return valid(text[a:b] for a, b in zip(at, at[1:] + [len(text)]))
    blank = valid(re.split(r"\n\s*\n", text)) if "\n\n" in text else []
    if len(blank) >= 2:
        return blank
    merged, groups = [], []
    for x in lines:
        last = merged[-1] if merged else ""
        if x and last and not re.match(new, x):
            merged[-1] = last[:-1] + x if last.endswith("-") else f"{last} {x}"
        elif x or last:
            merged.append(x)
    for x in filter(None, merged):
        if groups and not re.match(new, x):
            groups[-1] += " " + x
        else:
            groups.append(x)
    return valid(groups)


def test_lines_are_merged_as_one_by_one(spark):
    rng = random.Random(5)
    pieces = ["\n", "\n", "\n", "\r", "\n\n", " \n ", "\t", "  ", "\x0b", "\x85", "-", "-\n", "[1] ", "[2]", "1. ", "2.", "Smith, J.", "Smith", "Jones-", "and", "& Doe", "et al.", "Roe, Carl", "a title of many words", "12345678901234567890", "é", "(2020). Venue"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + ["Smith, J. (2020). A title-\n", "-\n-\nSmith, J. (2020). A title"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = {r.k: r.r for r in frame.select("k", parse.split_references(F.col("s")).alias("r")).collect()}
    assert [got[k] for k in range(len(texts))] == [plain_split(t) for t in texts]
    assert spark.createDataFrame([(None,)], "s string").select(parse.split_references(F.col("s")).alias("r")).first().r is None


def test_many_lines_cost_no_square_of_them(spark):
    text = "Smith, J. (2020). A title\nof a work in a venue\n" * 60_000
    frame = spark.createDataFrame([(text,)], "s string").select(F.size(parse.split_references(F.col("s"))).alias("n"))
    start = time.time()
    assert frame.first().n == 60_000 and time.time() - start < 30


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    path, size = str(tmp_path / "t"), "spark.sql.files.maxPartitionBytes"
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1).write.parquet(path)
    before = spark.conf.get(size)
    spark.conf.set(size, "32k")
    try:
        table = spark.read.parquet(path)
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert table.rdd.getNumPartitions() >= 4 and sizes(table) == [20_000]
        assert max(sizes(refs.spread(table, "id", "s"))) < 10_000
        assert refs.spread(table, "id", "s").orderBy("id").collect() == table.orderBy("id").collect()
    finally:
        spark.conf.set(size, before)


def test_strings_of_equal_pairs_and_refs_of_some_papers(spark):
    rows = refs.refs(spark, DATA)
    assert sorted(refs.strings(spark, DATA).collect()) == sorted(rows.select("raw").distinct().collect())
    assert "HashAggregate(keys=[l_partkey" in plan(refs.strings(spark, DATA))
    papers = spark.createDataFrame([("1",), ("7",), ("none",)], "paper string")
    some = refs.refs(spark, DATA, papers)
    assert sorted(some.collect()) == sorted(rows.where("citing_paper_id in ('O1', 'O7')").collect()) and some.count() > 0
