"""Personal data by fixed patterns and bootstrapped context. DataFrame functions only.

Base spans come from one pattern for each kind. They are the seeds. The words
around a mention make lexical patterns of three forms: two words before, a
word on either side, two words after. Candidates are tokens of a kind's loose
shape that no base span covers. Patterns and instances form a bipartite graph
that Spark scores in rounds: a pattern is as good as the share of its instances
that are good, an unseen instance as good as the patterns around it, in the way
of repeated noisy-or. An instance found good in one round supports further
patterns in the next, which may find others that no seed's words surround.
Occurrences of good instances between the words of good patterns become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.arrays import let, located, running, salted
from citeweave.sources.scratch import discard, materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns in words of java.util.regex. Possessive
# repeats and the look-behinds change no match; they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried on it.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Loose shapes of unseen instances, one token each: spelt-out addresses, IPv6, 12 to 19 digits (the most a card
#: number has), 7 to 15 digits (the most a telephone number has).
SHAPE = {
    "email": r"^[A-Za-z0-9._%+-]+(?:@|\[at\]|\(at\))[A-Za-z0-9.\[\]()-]+$",
    "ip": r"^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9](?:-?[0-9]){11,18}$",
    "phone": r"^[(]?[0-9](?:[().-]*+[0-9]){6,14}$",
}
#: A token that may have one of the shapes; no shape asks for less than the look-ahead.
TOKEN = r"(?<!\S)(?=[(]?[0-9]|[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:|[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\)))\S++"
MENTION = "struct<rank:int,start:int,end:int,value:string,around:array<string>>"
NONE = f"cast(array() as array<{MENTION}>)"
#: A word of a pattern: no digit, no @, of any length. Words of a pattern are parted by one space; spaces before
#: the mention and punctuation right behind it do not count.
_WORD = r"[^\s0-9@]++"
#: An instance of at least this score counts as found.
GOOD = 0.7


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn sum."""

    def weight(d: Column, i: Column) -> Column:
        v = d.cast("int") * (F.lit(1) + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0)), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"))
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of one kind; a match that fails its test is dropped without a retry."""
    hit = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(HINT[kind]))
    rank = F.lit(KINDS.index(kind))
    mention = lambda s: F.struct(rank.alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), around(s["gap"], s["next"]).alias("around"))
    return F.when(hit, F.transform(F.filter(located(text, BASE[kind]), lambda s: _valid(kind, s["value"])), mention)).otherwise(F.expr(NONE))


def around(left: Column, right: Column) -> Column:
    """The patterns of a mention between two stretches of text, lower-cased; those that lack a word are left out.

    Only the nearest pieces between spaces are looked at, so long stretches cost little.
    """
    near = F.substring_index(F.rtrim(left), " ", -2)
    two = F.regexp_extract(near, rf"(?:^|(?<=\s))({_WORD}\x20{_WORD})$", 1)
    one = F.regexp_extract(near, rf"(?:^|(?<=\s))({_WORD})$", 1)
    after = F.regexp_replace(F.substring_index(right, " ", 4), r"^[.,;:!?)]*+(?=\x20)", "")
    next_one = F.regexp_extract(after, rf"^\x20({_WORD})(?=\s|$)", 1)
    next_two = F.regexp_extract(after, rf"^\x20({_WORD}\x20{_WORD})(?=\s|$)", 1)
    forms = (F.when(two != "", F.concat(F.lit("b|"), two)), F.when((one != "") & (next_one != ""), F.concat_ws("|", F.lit("m"), one, next_one)), F.when(next_two != "", F.concat(F.lit("a|"), next_two)))
    return F.transform(F.array_compact(F.array(*forms)), lambda x: F.lower(x))


def _identity(rank: Column, value: Column) -> Column:
    """What two mentions of one instance share: digits, or for addresses the lower-cased text with a plain @."""
    return F.when(rank.isin(0, 1), F.lower(F.regexp_replace(value, r"\[at\]|\(at\)", "@"))).otherwise(_digits(value))


def _free(mentions: Column, base: Column) -> Column:
    """The mentions that no base span overlaps."""
    item = lambda s, taken: F.struct(s["start"].alias("start"), taken.alias("taken"), s["end"].alias("end"), s.alias("s"))
    both = F.array_sort(F.concat(F.transform(base, lambda s: item(s, F.lit(0))), F.transform(mentions, lambda s: item(s, F.lit(1)))))

    def kept(x: Column) -> Column:
        # the furthest end of base spans that start before, and the nearest start of those that start after
        reach = running(F.transform(x, lambda i: F.when(i["taken"] == 0, i["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
        ahead = F.reverse(running(F.transform(F.reverse(x), lambda i: F.when(i["taken"] == 0, i["start"]).otherwise(F.lit(2147483647))), lambda a, b: F.least(a, b), F.lit(2147483647)))
        marked = let(F.struct(x.alias("x"), reach.alias("reach"), ahead.alias("ahead")), lambda s: F.transform(s["x"], lambda i, k: F.when((i["taken"] == 1) & (F.get(s["reach"], k) <= i["start"]) & (F.get(s["ahead"], k) >= i["end"]), i["s"])))
        return F.array_compact(marked)

    return F.when((F.size(mentions) == 0) | (F.size(base) == 0), mentions).otherwise(let(both, kept))


def _candidates(text: Column, base: Column) -> Column:
    def token(s: Column) -> Column:
        value = F.regexp_replace(s["value"], r"(?<![.,;:!?])[.,;:!?]+$", "")
        rest = F.concat(F.substring(s["value"], F.length(value) + 1, F.length(s["value"])), s["next"])
        return F.struct(F.lit(-1).alias("rank"), s["start"].alias("start"), (s["start"] + F.length(value)).alias("end"), value.alias("value"), around(s["gap"], rest).alias("around"))

    shaped = lambda s: F.rlike(s["value"], F.lit("|".join(f"(?:{p})" for p in SHAPE.values())))
    found = F.filter(F.transform(located(text, TOKEN), token), lambda s: shaped(s) & (F.size(s["around"]) > 0))
    return let(found, lambda m: _free(m, base))


def may_hold(text: Column) -> Column:
    """False only for texts without any mention: every base span and every token of a shape holds one of these."""
    holds = lambda part: F.contains(text, F.lit(part))
    return holds("@") | holds("[at]") | holds("(at)") | F.rlike(text, F.lit("[0-9]")) | (holds(":") & F.rlike(text, F.lit("[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:")))


def extract(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, base, candidates) of rows(rid, doc_id, text), written once: mentions by kind and start; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = rows.select("rid", "doc_id", text.alias("_text"), may_hold(text).alias("_may"))
    based = marked.withColumn("base", F.when(F.col("_may"), F.concat(*[base_spans(F.col("_text"), k) for k in KINDS])).otherwise(F.expr(NONE)))
    candidates = F.when(F.col("_may"), _candidates(F.col("_text"), F.col("base"))).otherwise(F.expr(NONE))
    return materialize(based.select("rid", "doc_id", "base", candidates.alias("candidates")), "pii")


def _ranks(value: Column) -> Column:
    """The kinds whose loose shape a value has."""
    return F.array_compact(F.array(*[F.when(F.rlike(value, F.lit(SHAPE[k])), F.lit(n)) for n, k in enumerate(KINDS)]))


def _loose(extracted: DataFrame) -> DataFrame:
    """(rid, start, end, text, rank, pattern, value): every candidate in every kind it may be and every pattern around it."""
    each = extracted.where(F.size("candidates") > 0).select("rid", F.explode("candidates").alias("c"))
    kinds = each.select("rid", "c", F.explode(_ranks(F.col("c.value"))).alias("rank"))
    return kinds.select("rid", "c.start", "c.end", F.col("c.value").alias("text"), "rank", F.explode("c.around").alias("pattern"), _identity(F.col("rank"), F.col("c.value")).alias("value"))


def score_patterns(extracted: DataFrame, rounds: int = 6, support: int = 3, prior: float = 0.05, good: float = GOOD) -> DataFrame:
    """(rank, pattern, value, pattern_score, instance_score): the graph's edges to unseen instances after ``rounds``.

    An edge is a pattern and a distinct instance of one kind, counted once
    however many documents copy it. Seeds score 1, others begin at ``prior``.
    In each round a pattern scores the sum of its instances' scores over their
    number plus one, or 0 until ``support`` of them score ``good``; an unseen
    instance scores one minus the product of what its patterns lack to one, at
    least ``prior``. Patterns with fewer than ``support`` instances never score.
    """
    seeds = extracted.where(F.size("base") > 0).select(F.explode("base").alias("s")).select("s.rank", F.explode("s.around").alias("pattern"), _identity(F.col("s.rank"), F.col("s.value")).alias("value"), F.lit(1.0).alias("seed"))
    loose = _loose(extracted).select("rank", "pattern", "value", F.lit(0.0).alias("seed"))
    every = materialize(seeds.unionByName(loose).groupBy("rank", "pattern", "value").agg(F.max("seed").alias("seed")), "pii-all")
    able = every.groupBy("rank", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("rank", "pattern")
    edges = materialize(salted(every, able, ["rank", "pattern"], ["value"], "left_semi"), "pii-edges")
    discard(every)
    scored = edges.withColumn("instance_score", F.greatest("seed", F.lit(prior)))
    if edges.where("seed = 0").isEmpty():
        return scored.where("seed = 0").select("rank", "pattern", "value", F.lit(0.0).alias("pattern_score"), "instance_score")
    # a seed may be known from another pattern only
    known = edges.groupBy("rank", "value").agg(F.max("seed").alias("is_seed"))
    edges = materialize(salted(edges, known.select("rank", "value", "is_seed"), ["rank", "value"], ["pattern"]).select("rank", "pattern", "value", "is_seed"), "pii-graph")
    scored = edges.withColumn("instance_score", F.greatest("is_seed", F.lit(prior)))
    for _ in range(rounds):
        found = F.sum("instance_score") / (F.count(F.lit(1)) + 1)
        patterns = scored.groupBy("rank", "pattern").agg(F.when(F.count(F.when(F.col("instance_score") >= good, 1)) >= support, found).otherwise(0.0).alias("pattern_score"))
        joined = salted(edges, patterns, ["rank", "pattern"], ["value"])
        reached = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("pattern_score"), F.lit(1e-9)))))
        instances = joined.groupBy("rank", "value").agg(F.when(F.max("is_seed") == 1, F.lit(1.0)).otherwise(F.greatest(reached, F.lit(prior))).alias("instance_score"))
        after = materialize(salted(joined, instances, ["rank", "value"], ["pattern"]).select("rank", "pattern", "value", "is_seed", "pattern_score", "instance_score"), "pii-scores")
        discard(scored)
        scored = after
    return scored.where("is_seed = 0").select("rank", "pattern", "value", "pattern_score", "instance_score")


def discover(extracted: DataFrame, least_pattern: float = GOOD, least_instance: float = GOOD, **how) -> DataFrame:
    """(rid, found): spans (rank, start, end, value) of candidates that are good instances amid good patterns; no row without any."""
    scores = score_patterns(extracted, **how).where((F.col("pattern_score") >= least_pattern) & (F.col("instance_score") >= least_instance))
    chosen = materialize(scores.select("rank", "pattern", "value", "instance_score"), "pii-found")
    hits = salted(_loose(extracted), chosen, ["rank", "pattern", "value"], ["rid", "start"])
    best = hits.groupBy("rid", "start", "end", "text").agg(F.max_by("rank", F.struct("instance_score", -F.col("rank"))).alias("rank"))
    return materialize(best.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", F.col("text").alias("value")))).alias("found")), "pii-spans")


_SPANS = "cast(array() as array<struct<rank:int,start:int,end:int,value:string>>)"


def _plain(mentions: str) -> Column:
    return F.transform(mentions, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, base, spans): base spans and all spans, by kind and start. One row for each row of ``docs``.

    Null and empty texts have no spans; repeated rows each have their own; an
    empty table gives no rows; other columns are not read.
    """
    extracted = extract(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    joined = extracted.select("rid", "doc_id", _plain("base").alias("base")).join(discover(extracted), "rid", "left")
    return joined.select("rid", "doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", F.coalesce("found", F.expr(_SPANS)))).alias("spans"))


def listing(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Contract columns of the result of ``find``."""
    count = lambda n, k: F.size(F.filter("base", lambda s: s["rank"] == n)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(n, k) for n, k in enumerate(KINDS)], F.sha2(listing("base").cast("binary"), 256).alias("base_sha256"), listing("spans").alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span as its kind in brackets; overlapping spans are one, of the first's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))

    def cut(x: Column) -> Column:
        return let(F.struct(x.alias("x"), running(F.transform(x, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)).alias("reach")), joined)

    def joined(b: Column) -> Column:
        done = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(b["reach"], i - 1))
        part = lambda s, i: F.when(s["start"] >= done(i), F.concat(F.substring(text, done(i) + 1, s["start"] - done(i)), F.get(names, s["rank"]))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(b["x"], part), ""), F.substring(text, F.element_at(b["reach"], -1) + 1, F.length(text)))

    return let(by_start, cut)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in its text replaced by its kind in brackets; overlapping spans are one, of the first's kind.

    A null text stays null; the other columns and their order stay; an empty
    table gives no rows. Spans depend on the text alone, so the few that are
    discovered come back by two 64-bit hashes of the text; base spans are found
    again in place, and texts move only if the table of discovered spans is large.
    """
    text = F.col(text_col)
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(11)).alias("b"))
    found = discover(extract(docs.select(key.alias("rid"), F.lit(None).cast("long").alias("doc_id"), text.alias("text"))))
    own = docs.withColumn("_key", key).join(found.withColumnsRenamed({"rid": "_rid", "found": "_found"}), F.col("_key") == F.col("_rid"), "left")
    base = F.concat(*[F.transform(base_spans(text, k), lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))) for k in KINDS])
    spanned = own.withColumn("_spans", F.when(may_hold(text), F.concat(base, F.coalesce("_found", F.expr(_SPANS)))))
    masked = F.when(F.size("_spans") > 0, replaced(text, F.col("_spans"))).otherwise(text)
    return spanned.select(*[masked.alias(c) if c == text_col else F.col(c) for c in docs.columns])
