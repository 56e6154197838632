"""Column helpers over arrays: values evaluated once, running totals, located matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside the lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Totals of an array up to and with each element, under an associative ``step``.

    Chunks of about the square root of the length are totalled by themselves,
    so appending costs the power 1.5 of the length, not its square.
    """

    def whole(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return let(F.struct(v.alias("v"), size.alias("c"), F.sequence(F.lit(0), F.greatest((F.size(v) - 1).cast("int"), F.lit(0)), size).alias("at")), chunks)

    def chunks(s: Column) -> Column:
        totals = F.transform(s["at"], lambda a: F.aggregate(F.slice(s["v"], a + 1, s["c"]), zero, step))
        ahead = F.aggregate(totals, F.array(zero), lambda done, t: F.concat(done, F.array(step(F.element_at(done, -1), t))))
        return let(F.struct(s["v"].alias("v"), s["c"].alias("c"), s["at"].alias("at"), ahead.alias("ahead")), within)

    def within(s: Column) -> Column:
        part = lambda a, k: F.aggregate(F.slice(s["v"], a + 1, s["c"]), F.array(F.get(s["ahead"], k)), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))), lambda done: F.slice(done, F.lit(2), F.size(done)))
        return F.flatten(F.transform(s["at"], part))

    return let(values, whole)


def located(text: Column, pattern: str) -> Column:
    """(start, end, value, gap) of the matches, leftmost and non-overlapping, in code points; gap is the text since the last match."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def place(b: Column) -> Column:
        sizes = F.transform(b["found"], lambda v, i: F.length(v) + F.length(F.get(b["gaps"], i)))
        return let(F.struct(b["found"].alias("found"), b["gaps"].alias("gaps"), running(sizes, lambda a, x: a + x, F.lit(0)).alias("ends")), spans)

    def spans(b: Column) -> Column:
        return F.transform(b["found"], lambda v, i: F.struct((F.get(b["ends"], i) - F.length(v)).alias("start"), F.get(b["ends"], i).alias("end"), v.alias("value"), F.get(b["gaps"], i).alias("gap"), F.get(b["gaps"], i + 1).alias("next")))

    return let(both, place)
