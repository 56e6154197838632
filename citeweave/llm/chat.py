"""Chat formatting checked by a grammar round trip. DataFrame functions only.

A conversation is rendered as turns between control strings, reparsed by the
one deterministic grammar below, and compared with its source. Only if the two
differ, or a text holds a control string, is the content escaped, and checked
again; the last level is proven reversible, so every conversation comes back
identical.

    conversation = turn*
    turn         = "### " role ": " body "</turn>"

The parser undoes the escapes ``\\t`` (turn end), ``\\h`` (heading), ``\\c``
(colon), ``\\l`` (line feed), ``\\e`` (backslash), in that order. Escaped
content holds no control string, and each of its backslashes begins an escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.arrays import let, running

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>"
BODY_ESCAPES = (("\\", "\\e"), ("</turn>", "\\t"), ("### ", "\\h"))
ROLE_ESCAPES = (*BODY_ESCAPES, (":", "\\c"), ("\n", "\\l"))
#: A conversation whose texts hold every control string.
PROBE = ((-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"))


def _escaped(text: Column, escapes) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescaped(text: Column) -> Column:
    for plain, code in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: Column, level: int) -> Column:
    """Text of an array of (role, text) turns; level 0 leaves content as it is, level 1 escapes it."""
    part = lambda x: (_escaped(x["role"], ROLE_ESCAPES), _escaped(x["text"], BODY_ESCAPES)) if level else (x["role"], x["text"])
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(HEAD), part(x)[0], F.lit(MIDDLE), part(x)[1], F.lit(TAIL))), "")


def _cells(text: Column) -> Column:
    """Rendered turns without their tails; what follows the last tail is one more, empty in whole texts."""
    return F.split(text, TAIL, -1)


def _role_of(cell: Column) -> Column:
    """Escaped role, null if the cell is no turn."""
    found = F.instr(cell, MIDDLE)
    return F.when(F.startswith(cell, F.lit(HEAD)) & (found > len(HEAD)), F.substring(cell, F.lit(len(HEAD) + 1), found - len(HEAD) - 1))


def _body_of(cell: Column) -> Column:
    return F.substring(cell, F.instr(cell, MIDDLE) + len(MIDDLE), F.length(cell))


def parse(text: Column) -> Column:
    """Array of (role, text) turns of a rendered text; roles are null where the grammar does not hold."""
    turn = lambda c: F.struct(_unescaped(_role_of(c)).alias("role"), _unescaped(_body_of(c)).alias("text"))
    return let(_cells(text), lambda cells: F.transform(F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0))), turn))


def loss_spans(text: Column) -> Column:
    """(start, length) in code points of every assistant body of a rendered text."""

    def spans(cells: Column) -> Column:
        whole = F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0)))
        return let(F.struct(whole.alias("cells"), running(F.transform(whole, lambda c: F.length(c) + len(TAIL)), lambda a, x: a + x, F.lit(0)).alias("ends")), own)

    def own(s: Column) -> Column:
        def span(cell: Column, i: Column) -> Column:
            size = F.length(cell) - (F.instr(cell, MIDDLE) + len(MIDDLE) - 1)
            return F.when(_unescaped(_role_of(cell)) == "assistant", F.struct((F.get(s["ends"], i) - len(TAIL) - size).cast("int").alias("start"), size.cast("int").alias("length")))

        return F.filter(F.transform(s["cells"], span), lambda x: x.isNotNull())

    return let(_cells(text), spans)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, level) of conversations(conv_id, turn, role, text).

    Turns are ordered by turn, then role and text, a null turn first; null
    roles and texts are empty; rows with a null conv_id are one conversation;
    repeated rows are turns of their own. No rows give no conversations.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    turns = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    own = grouped.select("conv_id", turns.alias("turns"))
    plain = let(render(F.col("turns"), 0), lambda t: F.struct(t.alias("t"), parse(t).alias("p")))
    checked = own.withColumn("_plain", plain)
    clean = ~F.exists("turns", lambda x: F.contains(x["text"], F.lit(HEAD)) | F.contains(x["text"], F.lit(TAIL))) & (F.col("_plain.p") == F.col("turns"))
    level = F.when(clean, F.lit(0)).otherwise(F.lit(1))
    formatted = F.when(clean, F.col("_plain.t")).otherwise(render(F.col("turns"), 1))
    return checked.select("conv_id", "turns", formatted.alias("formatted"), level.alias("level"))


def digests(formatted: DataFrame) -> DataFrame:
    """Contract columns, all read back from ``formatted``; raises at run time if a conversation does not come back identical."""
    whole = F.when(F.col("p") == F.col("turns"), F.col("p")).otherwise(F.raise_error("a conversation does not survive its round trip").cast("array<struct<role:string,text:string>>"))
    read = formatted.select("conv_id", "turns", "formatted", parse(F.col("formatted")).alias("p"), loss_spans(F.col("formatted")).alias("spans"), "level").withColumn("turns", whole)
    body = F.array_join(F.transform("spans", lambda s: _unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    flat = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.withColumn("_loss", body).select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(flat).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), sha(F.col("_loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "level")


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` and the conversation -7, which holds every control string."""
    return rows.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
