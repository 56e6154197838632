"""Array helpers of the library, and joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.arrays import let, located, running

__all__ = ["let", "located", "running", "salted"]

#: Parts that the rows of one key are dealt into.
SALTS = 16


def hot_keys(rows: DataFrame, on: list[str], parts: int = 1000, least: int = 1000) -> DataFrame:
    """Keys that hold more than one in ``parts`` of all rows, and more than ``least``: fewer than ``parts`` of them."""
    bound = max(rows.count() // parts, least)
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).select(*on)


def salted(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner", hot: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``few`` on equal (null-safe) columns: rows of one key of ``many`` are dealt to ``salts`` tasks by ``by``.

    A key's rows in ``few`` are repeated for each; with ``hot`` (the bounded
    table of hot_keys) only those of its keys are dealt and repeated, which
    suits a large ``few``. ``how`` is inner, left or left_semi.
    """
    dealt, copied = F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        table = F.broadcast(hot.select(*[F.col(c).alias(f"_hot_{c}") for c in on], F.lit(True).alias("_is_hot")))  # fewer keys than hot_keys' parts
        known = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on]
        many, few = many.join(table, known, "left"), few.join(table, known, "left")
        dealt, copied = F.when(F.col("_is_hot"), dealt).otherwise(0), F.when(F.col("_is_hot"), copied).otherwise(F.array(F.lit(0)))
    passing = [] if hot is None else [*[f"_hot_{c}" for c in on], "_is_hot"]
    left = many.withColumn("_salt", dealt).drop(*passing)
    right = few.withColumn("_other", F.explode(copied)).drop(*passing).withColumnsRenamed({c: f"_on_{c}" for c in on})
    meet = F.col("_salt") == F.col("_other")
    for c in on:
        meet &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(right, meet, how).drop("_salt", "_other", *[f"_on_{c}" for c in on])
