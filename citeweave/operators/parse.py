"""From page text to reference strings: section, split, quality, header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.arrays import let
from citeweave.functions.text import ARXIV, AUTHORLIKE, DOI, YEAR, first, normalize_lines, squeeze, strip

# Section headings, alone on a line.
HEADING = "(?imd)^\\s*(references|bibliography|works cited|参考文献)\\s*$"
NEXT_SECTION = "(?imd)^\\s*(?:appendix|appendices|acknowledg(?:e)?ments?|supplementary materials?|funding|author contributions)\\s*$"
# The number that begins a squeezed line.
NUMBERED = ("\\[\\d+\\]", "\\d+\\.")
# How a squeezed line begins that starts a reference.
NEW_REFERENCE = (
    "(?:\\[\\d+\\]|\\d+\\.) ",
    "[A-Z][A-Za-z'`-]+, (?:[A-Z]\\.|[A-Z][a-z]+)",
    "[A-Z][A-Za-z'`-]+ (?:and|&|et al\\.|[A-Z]\\.)",
)
_BEGINS = "|".join(NEW_REFERENCE)
MIN_REFS, MIN_WITH_YEAR, MIN_AUTHORLIKE = 5, 0.50, 0.60


def documents(pages: DataFrame) -> DataFrame:
    """(paper, texts): page texts of each paper in page order."""
    return pages.groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("_p")).select("paper", F.transform("_p", lambda x: x["text"]).alias("texts"))


def reference_section(docs: DataFrame) -> DataFrame:
    """``docs`` with section(text, start_page, heading) after the last heading of all pages, null without one."""

    def section(whole: Column) -> Column:
        headings = F.regexp_extract_all(whole, F.lit(HEADING), F.lit(1))
        return let(headings, lambda found: F.when(F.size(found) > 0, F.struct(_cut(whole).alias("text"), page.alias("start_page"), F.element_at(found, -1).alias("heading"))))

    page = F.array_max(F.transform("texts", lambda t, i: F.when(F.rlike(t, F.lit(HEADING)), i + 1)))
    return docs.withColumn("section", let(F.array_join("texts", "\n"), section))


def _cut(whole: Column) -> Column:
    """What stands between the last heading and the next section; greedy text before a heading finds the last one."""
    after = F.regexp_replace(whole, f"(?s)\\A.*(?:{HEADING})", "")
    return strip(F.regexp_replace(after, f"(?:{NEXT_SECTION})(?s:.*)\\z", ""))


def is_reference(text: Column) -> Column:
    return (F.length(text) >= 20) & ~F.rlike(text, F.lit("^\\p{Nd}+$"))


def _by_beginnings(text: Column) -> Column:
    """References of squeezed lines by how lines begin; a trailing hyphen is undone, blank lines part what a wrapped line joins.

    Each pass goes over the whole text once, however many lines it has. Squeezed
    lines hold no tab, so a tab stands for a line end within a reference.
    """
    wrapped = F.regexp_replace(text, f"\\n(?!\\n|\\z|{_BEGINS})(?<=[^\\n]\\n)", "\t")
    joined = F.replace(F.replace(wrapped, F.lit("-\t"), F.lit("")), F.lit("\t"), F.lit(" "))
    return F.filter(F.split(F.trim(F.regexp_replace(joined, f"\\n++(?!{_BEGINS})", " ")), "\n+", -1), is_reference)


def split_references(section: Column) -> Column:
    """References of a section's text: by bracket numbers, else by plain numbers, else by blank lines, else by how lines begin."""

    def body(text: Column) -> Column:
        has = lambda mark: F.rlike(text, F.lit(f"(?md)^{mark}\\s(?s:.*?)^{mark}\\s"))
        numbered = lambda mark: F.slice(F.split(F.regexp_replace(text, f"(?md)^{mark}\\s", "\x01$0"), "\x01", -1), 2, 1 << 30)
        valid = lambda parts: F.filter(F.transform(parts, squeeze), is_reference)
        blank = let(valid(F.split(text, "\n\n+", -1)), lambda found: F.when(F.size(found) >= 2, found).otherwise(_by_beginnings(text)))
        return F.when(has(NUMBERED[0]), valid(numbered(NUMBERED[0]))).when(has(NUMBERED[1]), valid(numbered(NUMBERED[1]))).when(F.contains(text, F.lit("\n\n")), blank).otherwise(_by_beginnings(text))

    return let(normalize_lines(section), body)


def references(docs: DataFrame) -> DataFrame:
    """(paper, ordinal, raw_ref) from 1 on, of docs with a section."""
    return docs.select("paper", F.posexplode(split_references(F.col("section.text"))).alias("p", "raw_ref")).select("paper", (F.col("p") + 1).alias("ordinal"), "raw_ref")


def body_pages(docs: DataFrame) -> DataFrame:
    """(paper, page, text) before the section; its own page up to the first occurrence of the heading's word.

    A paper without a section keeps all its pages.
    """
    pages = docs.select("paper", "section", F.posexplode("texts").alias("p", "text")).withColumn("page", F.col("p") + 1)
    start = F.col("section.start_page")
    at = F.instr(F.lower("text"), F.lower(F.col("section.heading")))
    kept = F.when(F.col("page") == start, F.substring(F.col("text"), F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(F.col("text"))
    return pages.where(start.isNull() | (F.col("page") <= start)).select("paper", "page", kept.alias("text"))


def quality(refs: DataFrame, papers: DataFrame, min_refs: int = MIN_REFS, with_year: float = MIN_WITH_YEAR, authorlike: float = MIN_AUTHORLIKE) -> DataFrame:
    """(paper, n_refs, pct_with_year, pct_with_authorlike, needs_fallback, notes) of every paper of papers(paper)."""
    share = lambda pattern: F.avg(F.rlike(F.col("raw_ref"), F.lit(pattern)).cast("double"))
    seen = refs.groupBy("paper").agg(F.count(F.lit(1)).alias("n"), share("\\b(?:19|20)\\d{2}[a-z]?\\b").alias("y"), share(AUTHORLIKE).alias("a"))
    zero = papers.select("paper").distinct().join(seen, "paper", "left").select("paper", F.coalesce("n", F.lit(0)).alias("n_refs"), F.coalesce("y", F.lit(0.0)).alias("pct_with_year"), F.coalesce("a", F.lit(0.0)).alias("pct_with_authorlike"))
    low = F.format_string
    notes = F.filter(F.array(
        F.when(F.col("n_refs") < min_refs, low("n_refs_extracted below threshold: %d < %d", F.col("n_refs"), F.lit(min_refs))),
        F.when(F.col("pct_with_year") < with_year, low("pct_with_year below threshold: %.2f < %.2f", F.col("pct_with_year"), F.lit(with_year))),
        F.when(F.col("pct_with_authorlike") < authorlike, low("pct_with_authorlike below threshold: %.2f < %.2f", F.col("pct_with_authorlike"), F.lit(authorlike))),
    ), lambda n: n.isNotNull())
    told = F.when(F.col("n_refs") == 0, F.array(F.lit("no references extracted"))).otherwise(notes)
    return zero.withColumn("needs_fallback", F.size(told) > 0).withColumn("notes", told)


def header(docs: DataFrame) -> DataFrame:
    """``docs`` with doi, arxiv_id, year and title of the first page."""
    page = F.coalesce(F.try_element_at("texts", F.lit(1)), F.lit(""))
    titled = lambda x: (F.length(x) >= 12) & ~F.rlike(x, F.lit("(?i)\\b(?:abstract|doi|arxiv)\\b"))
    # lines after the title are not looked at
    title = F.aggregate(F.split(page, "\\R"), F.lit(None).cast("string"), lambda done, line: F.when(done.isNotNull(), done).otherwise(let(squeeze(line), lambda x: F.when(titled(x), x))))
    doi = F.rtrim(first(page, DOI, 0), F.lit("."))
    return docs.withColumns({"doi": doi, "arxiv_id": first(page, ARXIV), "year": first(F.substring(page, 1, 2500), "\\b(?:19|20)\\d{2}\\b", 0).cast("int"), "title": F.substring(title, 1, 250)})


def titled_by_spans(spans: DataFrame) -> DataFrame:
    """(paper, title) of spans(paper, ord, text, size): the first three of the largest type, if 8 to 250 characters."""
    usable = spans.where((F.length("text") >= 8) & ~F.rlike("text", F.lit(DOI)) & ~F.rlike("text", F.lit(ARXIV)) & ~F.rlike("text", F.lit("(?i)\\b(?:abstract|keywords|introduction)\\b")))
    largest = usable.groupBy("paper").agg(F.max("size").alias("most"))
    near = usable.join(largest, "paper").where(F.col("size") >= F.col("most") - 0.5)
    joined = near.groupBy("paper").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ord", "text"))), 1, 3), lambda x: x["text"]), " ").alias("t"))
    return joined.select("paper", squeeze(F.col("t")).alias("title")).where(F.length("title").between(8, 250))


def paper_id(doi: Column, arxiv: Column, file_name: Column) -> Column:
    """DOI, else arXiv id, else twelve hex digits over the file's name."""
    return F.coalesce(doi, arxiv, F.substring(F.sha1(file_name.cast("binary")), 1, 12))


def head_snippet(pages: DataFrame) -> DataFrame:
    """(paper, title, snippet): first non-blank line and 4000 characters of the first two pages."""
    two = documents(pages.where("page <= 2"))
    text = F.array_join("texts", "\n")
    return two.select("paper", F.try_element_at(F.filter(F.transform(F.split(text, "\\R"), strip), lambda x: x != ""), F.lit(1)).alias("title"), F.substring(text, 1, 4000).alias("snippet"))


YEAR_PATTERN = YEAR
