"""Row types of the bibliographic tables."""

from __future__ import annotations

# The admissible kinds.
WORK_TYPES = ("article", "book", "inproceedings", "chapter", "preprint", "unknown")
MARKER_STYLES = ("numbered_bracket", "numbered_superscript", "paren_author_year", "narrative_author_year")
LINK_METHODS = ("numbered_direct", "author_year_unique", "llm_disambiguated", "unlinked")

AUTHOR = "struct<surname:string,given:string>"
RAW_REF = "citing_paper_id string, raw string"
EXTRACTED = f"raw string, citing_paper_id string, authors array<{AUTHOR}>, year int, year_suffix string, title string, venue string, type string, doi string"
CANONICAL = f"canonical_id string, authors array<{AUTHOR}>, year int, title string, venue string, type string, doi string, volume string, pages string, raw_variants array<string>, confidence double"
MARKER = "struct<style:string,raw_marker:string,page:int,char_span:array<int>>"
CITANCE = f"citing_paper_id string, raw_ref string, context string, marker {MARKER}, link_method string, link_confidence double"
WORK = "work_id string, title string, year int, doi string, cited_by_count int, pdf_url string, relevance_score double, authors array<string>, venue string"
VERDICT = "verdict string, confidence double, reasoning string, needs_external_lookup boolean, tool_calls_used int"
