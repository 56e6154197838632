import re

from pyspark.sql import functions as F

from citeweave.llm.arrays import hot_keys, located, running, salted


def test_running_totals(spark):
    rows = [(n, [(k * 7919) % 101 for k in range(n)]) for n in (0, 1, 2, 3, 10, 99, 100, 101, 2500)]
    frame = spark.createDataFrame(rows, "n int, v array<int>")
    sums = running(F.col("v"), lambda a, x: a + x, F.lit(0))
    tops = running(F.col("v"), lambda a, x: F.greatest(a, x), F.lit(0))
    for r in frame.select("v", sums.alias("s"), tops.alias("t")).collect():
        assert r.s == [sum(r.v[: k + 1]) for k in range(len(r.v))] and r.t == [max(r.v[: k + 1]) for k in range(len(r.v))]


def test_located_matches(spark):
    texts = ["", "a1b22c", "123", "\U0001d54f9é8", "x" * 50, "1 " * 500]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", located(F.col("t"), "[0-9]+").alias("m")).collect()
    for r in found:
        assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", r.t)]


def test_salted_joins_equal_plain_ones(spark):
    many = spark.createDataFrame([(None if k % 7 == 0 else k % 3, k) for k in range(3000)], "key int, id int")
    few = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n"), (9, "z")], "key int, v string")
    hot = hot_keys(many, ["key"], parts=4, least=10)
    assert 0 < hot.count() < 4
    for how, n in (("inner", 429 + 1714), ("left", 3000), ("left_semi", 429 + 1714)):
        for given in (None, hot):
            got = salted(many, few, ["key"], ["id"], how, hot=given).collect()
            assert len(got) == len({r.id for r in got}) == n
            if how != "left_semi":
                assert all(r.v == {0: "a", 1: "b", None: "n"}.get(r.key) for r in got)
