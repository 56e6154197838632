"""Quality rules as a bitmask ledger. DataFrame functions only.

Every rule is evaluated once: the ledger holds the measurements of a document
and one bit for each rule it fails. A policy is a named mask of rules, so
applying another version, or asking what each rule costs, needs only bitwise
work on the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.arrays import let

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A condition in SQL over the measurements; true means that the document fails."""

    name: str
    fails: str


#: The bit of a rule is its place; new rules go to the end, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 25 * n_words"),
    Rule("shouting", "100 * n_upper > 60 * word_chars"),
    Rule("exclamations", "100 * n_exclaimed > 30 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
#: Policies by version: names of the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(r.name for r in RULES),
    "no_lines": tuple(r.name for r in RULES if r.name != "repeated_lines"),
}


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << k for k, r in enumerate(RULES) if r.name in names)


def _repeat_words(words: Column, window: int = 3) -> Column:
    """Words in windows of three that occur twice or more in the text, the first time included.

    Windows are compared by a 64-bit hash within one text.
    """

    def covered(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (window - 1))
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))

    def _covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            def place(x: Column, i: Column) -> Column:
                before = (i > 0) & (F.get(s, i - 1)["h"] == x["h"])
                after = (i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])
                return F.when(before | after, x["i"])

            places = F.sort_array(F.filter(F.transform(s, place), lambda p: p.isNotNull()))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])

        return let(ordered, repeats)

    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(covered(words))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every whole text; null has none of anything. One row for each row, other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACES)).alias("_words"))
    gone = lambda pattern: F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))
    lines = lambda body: let(F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), body)
    both = lines(lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    words = let(F.col("_words"), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeat")))
    seen = rows.select("doc_id", words.alias("w"), both.alias("l"), gone("[#*$%&|<>]+").alias("n_symbols"), gone("\\p{Lu}+").alias("n_upper"), gone("!+").alias("n_exclaimed"))
    long = lambda c, name: c.cast("long").alias(name)
    return seen.select("doc_id", long(F.col("w.n"), "n_words"), long(F.col("w.chars"), "word_chars"), long(F.col("n_symbols"), "n_symbols"), long(F.col("l.dup"), "n_dup_lines"), long(F.col("w.repeat"), "n_repeat_words"), long(F.col("l.n"), "n_lines"), long(F.col("n_upper"), "n_upper"), long(F.col("n_exclaimed"), "n_exclaimed"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of every document."""
    bits = " | ".join(f"shiftleft(cast({r.fails} as int), {k})" for k, r in enumerate(RULES))
    return measure(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy that includes the base rules."""
    base, own = mask(POLICIES["base"]), mask(POLICIES[version]) | mask(POLICIES["base"])
    return entries.withColumn("base_failed", F.col("fail_bits").bitwiseAND(base) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(own) == 0)


def ablation(entries: DataFrame, version: str = "v1") -> DataFrame:
    """(rule, failed, failed_alone, kept_without): rows failing each rule of the policy, failing no other, and kept if it went."""
    spark, own = entries.sparkSession, mask(POLICIES[version])
    by_bits = entries.groupBy(F.col("fail_bits").bitwiseAND(own).alias("bits")).count()
    rules = spark.createDataFrame([(r.name, 1 << k) for k, r in enumerate(RULES) if own >> k & 1], "rule string, bit int")
    total = lambda condition, name: F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0)).alias(name)
    bits, bit = F.col("bits"), F.col("bit")
    failed = bits.bitwiseAND(bit) != 0
    return by_bits.join(F.broadcast(rules), F.lit(True)).groupBy("rule").agg(total(failed, "failed"), total(bits == bit, "failed_alone"), total(bits.bitwiseAND(F.bitwise_not(bit)) == 0, "kept_without"))
