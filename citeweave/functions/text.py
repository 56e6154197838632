"""Reference-string cleaning and field extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.arrays import let, located

# Patterns whose matches decide the results.
_BLANK = "[\\s\\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: White space; printable ASCII is ruled out by one range before the list is looked at.
SPACE = f"[[^!-~]&&{_BLANK}]"
#: Runs of white space that are not already one plain space.
RUNS = f"(?:[[^ -~]&&{_BLANK}]{SPACE}*| {SPACE}+)"
#: The same runs within a line.
RUNS_IN_LINE = RUNS.replace(_BLANK, f"{_BLANK}&&[^\\n]")
PAGES = "pp?\\.\\s*\\d+(?:\\s*[-\\u2013]\\s*\\d+)?\\s*"
YEAR = "\\b((?:19|20)\\d{2})([a-z])?\\b"
DOI = "(?i)\\b10\\.\\d{4,9}/[-._;()/:A-Z0-9]+\\b"
ARXIV = "(?i)\\barXiv:\\s*([0-9]{4}\\.[0-9]{4,5}(?:v\\d+)?)\\b"
AUTHORLIKE = "^\\s*(?:\\[\\d+\\]\\s*|\\d+\\.\\s*)?[A-Z][A-Za-z'`-]{2,}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Fixed value: a reference has as many characters once stripped.
MIN_CHARS = 6


def _stripped(text: Column) -> Column:
    """``text`` without white space at its ends; the pattern runs only where an end has some."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(F.rlike(ends, F.lit(SPACE)), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def strip(text: Column) -> Column:
    return let(text, _stripped)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, RUNS, " "))


def filled(text: Column) -> Column:
    """``text``, evaluated once, with null in place of the empty string."""
    return let(text, lambda t: F.when(t != "", t))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return filled(F.regexp_extract(text, pattern, group))


def _noise(bare: Column) -> Column:
    return (F.length(bare) < MIN_CHARS) | F.rlike(bare, F.lit("^\\p{Nd}+$"))


def is_noise(raw: Column) -> Column:
    """Null, digits only, or under six characters once stripped."""
    return let(raw, lambda r: r.isNull() | _noise(_stripped(r)))


def preclean(raw: Column) -> Column:
    """Cleaned reference string; null for noise."""
    steps = (
        (RUNS, " "),
        ("\\s*&\\s*", " and "),
        ("'s\\b", ""),
        (f",\\s*{PAGES}\\)", ")"),
        (f"\\s+{PAGES}\\)", ")"),
        (f",\\s*{PAGES}$", ""),
        (f"\\s+{PAGES}$", ""),
        ("\\band([A-Z])", "and $1"),
        ("  +", " "),
    )

    def cleaned(text: Column) -> Column:
        for pattern, put in steps:
            text = F.regexp_replace(text, pattern, put)
        return filled(F.trim(text))

    return let(strip(raw), lambda bare: F.when(~_noise(bare), cleaned(bare)))


def with_cleaned(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` that are no noise, with cleaned; a filter would clean every string twice."""
    return rows.select("*", F.explode(F.array_compact(F.array(preclean(F.col(raw))))).alias("cleaned"))


def fields(text: Column) -> Column:
    """surname, year, year_suffix and title of a cleaned reference.

    The surname is the last word that is no initial of the first author before
    the first year; the title is what follows the year up to the first full
    stop, null if nothing does. Without a year all text is before it.
    """
    found = F.struct(F.regexp_instr(text, F.lit(YEAR)).alias("at"), F.regexp_extract(text, YEAR, 0).alias("y"))

    def parts(m: Column) -> Column:
        head = F.when(m["at"] > 0, F.rtrim(F.substring(text, F.lit(1), m["at"] - 1), F.lit(" .,("))).otherwise(text)
        tail = F.when(m["at"] > 0, F.ltrim(F.substring(text, m["at"] + F.length(m["y"]), F.length(text)), F.lit(" .,)"))).otherwise("")
        chunk = strip(F.element_at(F.split(head, ",|\\band\\b|&", 2), 1))
        surname = let(chunk, lambda c: _last_name(F.split(c, f"{SPACE}+"), F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown")), ".,"))
        title = filled(F.btrim(F.substring_index(tail, ".", 1), F.lit(" .")))
        year = F.nullif(F.substring(m["y"], 1, 4), F.lit("")).cast("int")
        return F.struct(surname.alias("surname"), year.alias("year"), F.nullif(F.substring(m["y"], 5, 1), F.lit("")).alias("year_suffix"), title.alias("title"))

    return let(found, parts)


def _last_name(tokens: Column, otherwise: Column, chars: str) -> Column:
    def named(names: Column) -> Column:
        return F.when(F.size(names) > 0, F.btrim(F.element_at(names, -1), F.lit(chars))).otherwise(otherwise)

    return let(F.filter(tokens, lambda t: (t != "") & ~F.rlike(t, F.lit("^[A-Z]\\.?$"))), named)


def index_surname(reference: Column) -> Column:
    """Surname under which a bibliography entry is found by author-year markers; null if none is left."""
    ref = strip(F.regexp_replace(reference, "^\\s*(?:\\[\\d+\\]|\\d+\\.)\\s*", ""))

    def head(r: Column) -> Column:
        at = F.regexp_instr(r, F.lit(YEAR))
        return F.regexp_replace(F.substring(r, F.lit(1), F.when(at > 0, at - 1).otherwise(120)), "(?i)\\bet\\s+al\\.?", "")

    def name(h: Column) -> Column:
        whole = F.element_at(F.split(h, "\\s+(?:and|&)\\s+", 2), 1)
        words = F.transform(F.split(whole, f"{SPACE}+"), lambda t: F.btrim(t, F.lit(" .")))
        return F.when(F.contains(h, F.lit(",")), F.substring_index(h, ",", 1)).otherwise(_last_name(words, whole, ""))

    return filled(F.btrim(let(let(ref, head), name), F.lit(" .;:")))


def number_list(inner: Column) -> Column:
    """Numbers of a bracket marker: ``1, 4-6`` is 1, 4, 5, 6; a range that falls or spans over 50 has none."""
    none = F.expr("cast(array() as array<int>)")

    def expand(piece: Column) -> Column:
        low, high = F.try_element_at(F.split(piece, "\\s*[-\\u2013]\\s*"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(piece, "\\s*[-\\u2013]\\s*"), F.lit(2)).try_cast("int")
        ranged = F.when((low <= high) & (high - low <= 50) & F.rlike(piece, F.lit("^\\d+\\s*[-\\u2013]\\s*\\d+$")), F.sequence(low, high)).otherwise(none)
        return F.when(F.rlike(piece, F.lit("[-\\u2013]")), ranged).otherwise(F.when(F.rlike(piece, F.lit("^\\d+$")) & piece.try_cast("int").isNotNull(), F.array(piece.try_cast("int"))).otherwise(none))

    return F.flatten(F.transform(F.split(F.trim(inner), "\\s*,\\s*"), expand))


def normalize_lines(text: Column) -> Column:
    """``text`` with the white space of each line squeezed; blank lines are empty."""
    squeezed = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), RUNS_IN_LINE, " ")
    return F.trim(F.replace(F.replace(squeezed, F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n")))


#: Words that stay small inside a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "en", "for", "if", "in", "of", "on", "or", "the", "to", "v", "v.", "via", "vs", "vs.")


def title_case(title: Column) -> Column:
    """A title for display: words begin with a capital, small words only at either end; words with capitals inside stay."""
    clean = squeeze(title)
    calm = F.when(F.upper(clean) == clean, F.lower(clean)).otherwise(clean)
    words = F.split(calm, " ")
    raised = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))

    def cased(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            small = F.lower(w).isin(*SMALL_WORDS) & (i > 0) & (i < F.size(ws) - 1)
            return F.when(small, F.lower(w)).when(F.rlike(w, F.lit("^.+[A-Z]")), w).otherwise(raised(w))

        return F.array_join(F.transform(ws, one), " ")

    return let(words, cased)


def eval_form(text: Column) -> Column:
    """Lower-case letters and digits with single spaces between, for comparing references."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def shorten(context: Column, most: int = 400) -> Column:
    """One line of at most ``most`` characters; a cut drops the last partial word and ends in an ellipsis."""
    line = F.regexp_replace(context, "\\n", " ")
    return F.when(F.length(line) > most, F.concat(F.regexp_replace(F.substring(line, 1, most), " [^ ]*$", ""), F.lit("…"))).otherwise(line)


def sentences(text: Column) -> Column:
    """(s, e) of every sentence in code points from 0; they end at ``.``, ``!`` or ``?``; stops without a sentence belong to none."""
    return F.transform(located(text, "[^.!?]+[.!?]?"), lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e")))


def context(text: Column, start: Column, end: Column, most: int = 300, bounds: Column | None = None) -> Column:
    """Sentence at ``start`` with the one before and the one after, at most ``most`` characters.

    ``bounds`` are the ``sentences`` of the text, found once a page where many markers need them.
    """
    def chosen(spans: Column) -> Column:
        marks = F.transform(spans, lambda s, i: F.when((s["s"] <= start) & (start <= s["e"]), i))
        at = F.element_at(F.filter(marks, lambda i: i.isNotNull()), 1)
        low = F.greatest(F.lit(1), at)
        around = F.array_join(F.transform(F.slice(spans, low, at + 3 - low), lambda s: strip(F.substring(text, s["s"] + 1, s["e"] - s["s"]))), " ")
        has = F.exists(marks, lambda i: i.isNotNull())
        half = most // 2
        window = F.substring(text, F.greatest(start - half, F.lit(0)) + 1, end + half - F.greatest(start - half, F.lit(0)))
        return F.when(has, around).otherwise(window)

    line = squeeze(let(sentences(text) if bounds is None else bounds, chosen))
    return F.when(F.length(line) <= most, line).otherwise(strip(F.substring(line, 1, most)))
