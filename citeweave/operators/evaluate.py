"""Evaluation: pair F1, greedy reference matching, macro means."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.text import eval_form
from citeweave.sources.scratch import materialize


def _pairs(n: Column) -> Column:
    return F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long")


def pair_f1(assigned: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over all pairs of rows, from group sizes alone.

    Rows without a prediction are one predicted group. Empty denominators give 0.
    """
    both = assigned.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = materialize(both, "pairs")
    tp = both.agg(_pairs(F.col("n")).alias("tp"))
    same_p = both.groupBy("p").agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("pp"))
    same_g = both.groupBy("g").agg(F.sum("n").alias("n")).agg(_pairs(F.col("n")).alias("gg"))
    # three one-row tables
    counts = tp.join(same_p, F.lit(True)).join(same_g, F.lit(True)).select("tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("gg") - F.col("tp")).alias("fn"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = counts.withColumn("precision", part(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


@lru_cache(maxsize=1 << 16)
def _letters(form: str) -> Counter:
    return Counter(form)


@lru_cache(maxsize=1 << 16)
def _ratio(form: str, other: str) -> float:
    return SequenceMatcher(None, form, other).ratio()


def _bound(form: str, other: str, least: float) -> float:
    """An upper bound of their ratio, as close as is needed to compare it with ``least``."""
    size = len(form) + len(other)
    bound = 2.0 * min(len(form), len(other)) / size
    if bound < least:
        return bound
    mine = _letters(other)
    return 2.0 * sum(min(n, mine[c]) for c, n in _letters(form).items()) / size


def _best(form: str, left: list[str], least: float) -> int | None:
    """Place of the best of ``left`` with a ratio of at least ``least``, the first of equals; what cannot win is not compared."""
    if form in left:  # only equal strings have ratio 1
        return left.index(form)
    top, place = least, None
    for bound, at in sorted((-_bound(form, t, least), k) for k, t in enumerate(left)):
        if -bound < top:
            break
        score = _ratio(form, left[at])
        if score > top or (score == top and (place is None or at < place)):
            top, place = score, at
    return place


def matched(forms: list[str], truths: list[str], least: float) -> int:
    """How many ``forms`` take a truth, each in order the best one left of at least ``least``, the first of equals."""
    left, n = list(truths), 0
    for form in forms:
        at = _best(form, left, least)
        if at is not None:
            left.pop(at)
            n += 1
    return n


def greedy_matches(predicted: DataFrame, truth: DataFrame, least: float = 0.85) -> DataFrame:
    """(paper, n_predicted, n_truth, matched): each prediction in order takes the best unmatched truth of at least ``least``.

    Both tables are (paper, ord, ref).
    """
    shaped = lambda df, mine: df.select(F.col("paper"), F.lit(mine).alias("mine"), F.struct(F.col("ord"), eval_form(F.col("ref")).alias("form")).alias("s"))
    forms = lambda mine: F.transform(F.sort_array(F.collect_list(F.when(F.col("mine") == mine, F.col("s")))), lambda s: s["form"])
    both = shaped(predicted, True).unionByName(shaped(truth, False))
    return greedy_lists(both.groupBy("paper").agg(forms(True).alias("a"), forms(False).alias("b")), least)


def greedy_lists(papers: DataFrame, least: float = 0.85) -> DataFrame:
    """``greedy_matches`` of papers(paper, a, b): predicted and true references in order, in the form of ``eval_form``.

    A paper's bibliography is one row of an Arrow batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [matched(a, b, least) for a, b in zip(frame.a, frame.b)]
            yield pd.DataFrame({"paper": frame.paper, "n_predicted": [len(a) for a in frame.a], "n_truth": [len(b) for b in frame.b], "matched": found})

    return papers.select("paper", "a", "b").mapInPandas(run, "paper string, n_predicted long, n_truth long, matched long")


def reference_scores(matches: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = matches.withColumn("recall", part("matched", "n_truth")).withColumn("precision", part("matched", "n_predicted"))
    return scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro_means(scores: DataFrame, fallback: str = "needs_fallback") -> DataFrame:
    return scores.agg(F.avg("recall").alias("ref_recall"), F.avg("precision").alias("ref_precision"), F.avg("f1").alias("ref_f1"), F.avg(F.col(fallback).cast("double")).alias("fallback_rate"))


def purity(assigned: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Share of rows in their cluster's most frequent gold group."""
    both = assigned.groupBy(predicted, gold).count()
    return both.groupBy(predicted).agg(F.max("count").alias("m"), F.sum("count").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))
