import pytest
from pyspark.sql import functions as F

from citeweave.functions import jsonlist, keys, text


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in frame.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_preclean(spark):
    cases = {"23": None, "  ": None, None: None, "abc": None, "Smith & Jones (1990).": "Smith and Jones (1990).", "Foo (1990), p. 154": "Foo (1990)", "Foo  bar (1990, pp. 1-2)": "Foo bar (1990)", "Foo bar (1990 p. 1)": "Foo bar (1990)", "Foo 1990, pp. 12-34": "Foo 1990", "Foo 1990 p. 3": "Foo 1990", "Smith andJones 1990": "Smith and Jones 1990", "Smith's work 1990": "Smith work 1990", "a  b c d": "a b c d"}
    assert column(spark, list(cases), text.preclean) == list(cases.values())


def test_surname_keys(spark):
    cases = {"van der Vaart": "vaart", "de Boor": "boor", "Müller": "muller", "Levin": "vin", "Davis": "vis", "Lee": "lee", "Dean": "dean", "Vance": "vance", "ﬁsher": "fisher", "Ørsted": "rsted", None: "", "O'Neil-Ü": "oneilu"}
    assert column(spark, list(cases), keys.surname_key) == list(cases.values())


def test_canonical_id(spark):
    row = spark.sql("select 'Smith' s, 2020 y, 'Deep learning for citations' t").select(keys.canonical_id(F.col("s"), F.col("y"), F.col("t")).alias("i")).first()
    assert row.i == "a437475ccc00"
    none = spark.sql("select cast(null as string) s, 0 y, cast(null as string) t").select(keys.canonical_id(F.col("s"), F.col("y"), F.col("t")).alias("i")).first()
    assert len(none.i) == 12


def test_extraction(spark):
    raw = "van der Vaart, A. W. (1996a). Weak convergence. Springer."
    frame = spark.createDataFrame([(raw,), ("Vaswani et al. Attention is all you need. 2017.",), ("no year at all here",)], "v string")
    got = [tuple(r) for r in frame.select(text.fields(F.col("v")).alias("f")).select("f.*").collect()]
    assert got == [("Vaart", 1996, "a", "Weak convergence"), ("need", 2017, None, None), ("here", None, None, None)]


@pytest.mark.parametrize("inner, numbers", [("1-3", [1, 2, 3]), ("1, 4–6", [1, 4, 5, 6]), ("5-2", []), ("1-99", []), ("7", [7]), ("99999999999", [])])
def test_number_lists(spark, inner, numbers):
    assert column(spark, [inner], text.number_list) == [numbers]


def test_context(spark):
    body = "First one. We cite [1] here! Then more? Last."
    got = spark.createDataFrame([(body,)], "t string").select(text.context(F.col("t"), F.lit(19), F.lit(22)).alias("c")).first().c
    assert got == "First one. We cite [1] here! Then more?"
    assert column(spark, ["x" * 500], text.shorten) == ["x" * 400 + "…"]
    assert column(spark, ["word " * 100], text.shorten)[0].endswith("word…")


def test_index_surnames(spark):
    cases = {"J. Smith. 2020. Title": "Smith", "[3] Doe, J. and Roe (2019)": "Doe", "12. Ann Lee and Bo Li 2001": "Lee", "Smith et al. 2020": "Smith"}
    assert column(spark, list(cases), text.index_surname) == list(cases.values())


def test_vectors_and_characters(spark):
    assert column(spark, ["ab", None, "abcd"], lambda c: F.size(keys.trigram_buckets(c))) == [0, 0, 2]
    assert column(spark, ["aAbé\U0001d54f", "", None], lambda c: F.size(keys.characters(c))) == [4, 0, 0]


def test_json_lists(spark):
    cases = {'["a", "b"]': ["a", "b"], '```json\n{"references": [{"raw": "a"}, "b", {"other": 1}]}\n```': ["a", "b"], '{"x": ["only"]}': ["only"], "nonsense": None, "[]": []}
    assert column(spark, list(cases), jsonlist.string_list) == list(cases.values())
    people = {'[{"surname": "Roe", "given": "A."}, "Plain Name"]': ["A. Roe", "Plain Name"], "Just A. Name": ["Just A. Name"], None: [], "": []}
    assert column(spark, list(people), jsonlist.flat_authors) == list(people.values())
    assert jsonlist.repaired("text [1, 2,] more") == "[1, 2]" and jsonlist.repaired("{'a': 1}") == '{"a": 1}' and jsonlist.repaired("none") is None
    assert column(spark, ["[1,]", None], jsonlist.repair) == ["[1]", None]
