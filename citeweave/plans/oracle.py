"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from citeweave.functions.keys import PARTICLES
from citeweave.plans.refs import RENDER

YEAR = r"\b((?:19|20)\d{2})([a-z])?\b"
#: Digits only, or too short once stripped.
NOISE = r"regexp_full_match(bare, '\d+') OR length(bare) < 6"
PAGES = r"pp?\.\s*\d+(?:\s*[-–]\s*\d+)?\s*"


def _preclean() -> str:
    text = "bare"
    for pattern, put in ((r"\s+", " "), (r"\s*&\s*", " and "), (r"''s\b", ""), (rf",\s*{PAGES}\)", ")"), (rf"\s+{PAGES}\)", ")"), (rf",\s*{PAGES}$", ""), (rf"\s+{PAGES}$", ""), (r"\band([A-Z])", r"and \1"), (r"\s+", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"CASE WHEN {NOISE} THEN NULL ELSE nullif(trim({text}), '') END"


def surname_key(source: str, column: str, key: str = "key") -> str:
    """``source`` with the surname key of ``column``; each particle is one nested select."""
    sql = f"SELECT *, regexp_replace(lower(strip_accents({column})), '[^a-z]', '', 'g') AS k0 FROM {source}"
    for n, p in enumerate(PARTICLES):
        sql = f"SELECT *, CASE WHEN starts_with(k{n}, '{p}') AND length(k{n}) > {len(p) + 2} THEN substr(k{n}, {len(p) + 1}) ELSE k{n} END AS k{n + 1} FROM ({sql})"
    drop = ", ".join(f"k{n}" for n in range(len(PARTICLES) + 1))
    return f"SELECT * EXCLUDE ({drop}), k{len(PARTICLES)} AS {key} FROM ({sql})"


def offsets(source: str, keep: str, pattern: str, text: str = "text") -> str:
    """(keep, value, start, end) of all matches, offsets from 0."""
    return f"""
SELECT {keep}, found[i] AS value, pos AS "start", pos + length(found[i]) AS "end" FROM (
  SELECT *, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0))::INT AS pos FROM (
    SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT *, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}', 0) AS found FROM {source})))"""


BRACKET = r"\[(\d+(?:\s*(?:,|-|–)\s*\d+)*)\]"
NAME = r"([A-Z][A-Za-z''`-]+)(?:\s+et\s+al\.?|\s+(?:and|&)\s+[A-Z][A-Za-z''`-]+)?"
NARRATIVE = rf"\b{NAME}\s*\(((?:19|20)\d{{2}})([a-z])?\)"
PAIR = rf"{NAME}[, ]+\s*((?:19|20)\d{{2}})([a-z])?"
PARENTHETICAL = r"\(([^()]{0,160}?(?:19|20)\d{2}[a-z]?[^()]*)\)"
#: Conversations as pages of papers; accepted by both engines.
RENDER_PAGES = """
SELECT cast(conv_id as string) AS paper, cast(turn + 1 as int) AS page,
  concat(coalesce(text, ''), ' As shown [', cast(turn % 4 + 1 as string), '] and [1-3] and again [', cast(turn % 4 + 1 as string), ']. ',
    s, ' (', y, ') proved [2, 9]. Others agree (', s, ' and Doe, ', y, '; Roe et al., 1991b). Nobody objects.') AS text
FROM (SELECT *, split_part('{names}', ',', cast(conv_id % 10 + 1 as int)) AS s, cast(1990 + turn % 5 as string) AS y FROM conversations WHERE conv_id is not null AND turn is not null) AS c
"""
#: Papers with header, body, a heading and references in one of three layouts.
RENDER_SECTIONS = """
SELECT concat(citing_paper_id, '-', cast(lay as string)) AS paper, lay,
  concat('On ', citing_paper_id, ' and its works', chr(10), 'doi:10.1234/abc.', substr(citing_paper_id, 2), ' arXiv: 2101.01234v2', chr(10), 'Published 2019.', chr(10), 'Body text.', chr(10), chr(10), 'References', chr(10), body, chr(10), 'Appendix', chr(10), 'More.') AS text
FROM ({inner}) AS d
"""

#: How a line begins that starts a reference.
NEW_REFERENCE = r"^\s*(?:\[\d+\]|\d+\.)\s+|^\s*[A-Z][A-Za-z''`-]+,\s+(?:[A-Z]\.|[A-Z][a-z]+)|^\s*[A-Z][A-Za-z''`-]+\s+(?:and|&|et al\.|[A-Z]\.)"
#: Documents behind two references that are wrapped over lines; accepted by both engines.
RENDER_WRAPPED = """
SELECT doc_id, concat_ws(chr(10), 'Smith, J. (2020). Deep learning for', 'citations. Venue.', 'Jones, B. 2021. A hyphen-', 'ated title. Venue.', text) AS text
FROM documents
"""
_SQUEEZED = r"trim(regexp_replace(z, '\s+', ' ', 'g'))"
_REFERENCES = f"list_filter(list_transform({{}}, lambda z: {_SQUEEZED}), lambda z: length(z) >= 20 AND NOT regexp_full_match(z, '\\d+'))"
_BLANKS = _REFERENCES.format(r"string_split_regex(body, '\n\s*\n')")
_NUMBERED = [_REFERENCES.format(rf"string_split(regexp_replace(body, '(?m)^\s*{number}\s+', chr(1) || '\0', 'g'), chr(1))[2:]") for number in (r"\[\d+\]", r"\d+\.")]

CTES: list[tuple[str, str]] = [
    ("r", RENDER),
    ("rs", r"SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS bare FROM r"),
    ("pc", f"SELECT * EXCLUDE (bare), {_preclean()} AS cleaned FROM rs"),
    ("p", "SELECT * FROM pc WHERE cleaned IS NOT NULL"),
    ("x0", rf"SELECT *, regexp_matches(cleaned, '{YEAR}') AS has, nullif(regexp_extract(cleaned, '{YEAR}', 1), '')::INT AS year, nullif(regexp_extract(cleaned, '{YEAR}', 2), '') AS year_suffix FROM p"),
    ("x1", rf"SELECT *, CASE WHEN has THEN rtrim(regexp_extract(cleaned, '^([\s\S]*?){YEAR}', 1), ' .,(') ELSE cleaned END AS head, CASE WHEN has THEN ltrim(regexp_extract(cleaned, '^[\s\S]*?{YEAR}([\s\S]*)$', 3), ' .,)') ELSE '' END AS tail FROM x0"),
    ("x2", r"SELECT *, trim(string_split_regex(head, ',|\band\b|&')[1]) AS chunk FROM x1"),
    ("x3", r"SELECT *, list_filter(string_split_regex(chunk, '\s+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[A-Z]\.?')) AS names FROM x2"),
    ("x", "SELECT ord, line, citing_paper_id, partkey, raw, cleaned, year, year_suffix, CASE WHEN len(names) > 0 THEN trim(names[-1], '.,') WHEN chunk <> '' THEN chunk ELSE 'Unknown' END AS surname, nullif(trim(split_part(tail, '.', 1), ' .'), '') AS title FROM x3"),
    ("b", surname_key("x", "surname", "block_key")),
    ("n0", "SELECT block_key, year, title, min(ord) AS node FROM b WHERE length(title) >= 3 GROUP BY ALL"),
    ("n1", "SELECT *, list_transform(range(1, length(title) - 1), lambda i: ('0x' || substr(md5(substr(lower(title), i, 3)), 1, 8))::BIGINT % 64) AS buckets FROM n0"),
    ("n2", "SELECT *, list_transform(range(64), lambda k: len(list_filter(buckets, lambda z: z = k))::DOUBLE) AS v FROM n1"),
    ("n", "SELECT *, sqrt(list_dot_product(v, v)) AS size FROM n2"),
    ("e", "SELECT * FROM (SELECT a.node AS src, c.node AS dst, list_dot_product(a.v, c.v) / (a.size * c.size + 1e-12) AS score FROM n a JOIN n c ON a.block_key = c.block_key AND a.year IS NOT DISTINCT FROM c.year AND a.node < c.node) WHERE score >= 0.65"),
    ("ea", "SELECT src AS u, dst AS w FROM e WHERE score >= 0.95 UNION ALL SELECT dst, src FROM e WHERE score >= 0.95"),
    ("el", "SELECT src AS u, dst AS w FROM e UNION ALL SELECT dst, src FROM e"),
    ("ra", "SELECT node, node AS root FROM n UNION SELECT ea.w, ra.root FROM ra JOIN ea ON ea.u = ra.node WHERE ra.root < ea.w"),
    ("rl", "SELECT node, node AS root FROM n UNION SELECT el.w, rl.root FROM rl JOIN el ON el.u = rl.node WHERE rl.root < el.w"),
    ("ca", "SELECT node, min(root) AS auto_id FROM ra GROUP BY node"),
    ("cl", "SELECT node, min(root) AS cluster_id FROM rl GROUP BY node"),
    ("cn", "SELECT n.block_key, n.year, n.title, n.node, ca.auto_id, cl.cluster_id FROM n JOIN ca USING (node) JOIN cl USING (node)"),
    ("cb", "SELECT cluster_id, max(score) AS best FROM e JOIN cl ON cl.node = e.src WHERE score < 0.95 GROUP BY 1"),
    ("cg", "SELECT cluster_id, count(DISTINCT auto_id) AS n_auto, any_value(best) AS best FROM cn LEFT JOIN cb USING (cluster_id) GROUP BY 1"),
    ("m0", "SELECT b.*, coalesce(cn.cluster_id, b.ord) AS cluster_id, coalesce(cn.auto_id, b.ord) AS auto_id FROM b LEFT JOIN cn ON b.block_key = cn.block_key AND b.year IS NOT DISTINCT FROM cn.year AND b.title = cn.title"),
    ("m1", "SELECT cluster_id, count(*) AS cluster_size FROM m0 GROUP BY 1"),
    ("m", "SELECT m0.*, cluster_size, coalesce(n_auto, 1) AS n_auto, best, CASE WHEN coalesce(n_auto, 1) = 1 THEN CASE WHEN cluster_size > 1 THEN 'auto' ELSE 'singleton' END WHEN best >= 0.80 THEN 'candidate' ELSE 'borderline' END AS tier FROM m0 JOIN m1 USING (cluster_id) LEFT JOIN cg USING (cluster_id)"),
    ("h", "SELECT cluster_id, arg_min({'s': surname, 'y': year, 't': title, 'c': cleaned}, (auto_id, ord)) AS head, arg_max({'s': surname, 'y': year, 't': title}, (coalesce(length(title), 0), -auto_id, -ord)) AS best_row, count(*) AS size FROM m GROUP BY 1"),
    ("jd", "SELECT DISTINCT cluster_id, title, list_distinct(string_split(lower(coalesce(title, '')), '')) AS cs FROM m"),
    ("jh", "SELECT cluster_id, head, best_row, size, list_distinct(string_split(lower(coalesce(head.t, '')), '')) AS hs FROM h"),
    ("js", "SELECT cluster_id, bool_and(CASE WHEN title IS NULL THEN false ELSE len(list_intersect(cs, hs)) / greatest(len(cs) + len(hs) - len(list_intersect(cs, hs)), 1) > 0.6 END) AS same FROM jd JOIN jh USING (cluster_id) GROUP BY 1"),
    ("vd", "SELECT cluster_id, head, best_row, size AS n, CASE WHEN size <= 1 THEN 'different' WHEN coalesce(head.t, '') = '' THEN 'uncertain' WHEN same THEN 'same' ELSE 'different' END AS verdict, CASE WHEN size <= 1 THEN 1.0 ELSE 0.6 END::DOUBLE AS judged FROM jh JOIN js USING (cluster_id)"),
    ("d0", "SELECT m.*, verdict, judged, CASE WHEN tier IN ('auto', 'singleton') THEN {'s': head.s, 'y': head.y, 't': head.t} WHEN verdict = 'same' THEN best_row ELSE {'s': surname, 'y': year, 't': title} END AS lead FROM m JOIN vd USING (cluster_id)"),
    ("d", "SELECT *, CASE WHEN tier NOT IN ('auto', 'singleton') AND verdict = 'uncertain' THEN 'review' WHEN coalesce(lead.t, '') <> '' THEN 'canonical' ELSE 'review' END AS action, CASE WHEN tier IN ('auto', 'singleton') OR verdict IN ('same', 'uncertain') THEN cluster_id ELSE ord END AS group_id, CASE tier WHEN 'auto' THEN 0.95 WHEN 'singleton' THEN 1.0 ELSE judged END::DOUBLE AS confidence FROM d0"),
    ("dc", "SELECT *, substr(sha1(lower(lead.s) || '|' || coalesce(nullif(lead.y, 0)::VARCHAR, '') || '|' || substr(lower(trim(lead.t)), 1, 60)), 1, 12) AS canonical_id FROM d WHERE action = 'canonical'"),
    ("mp", "SELECT cleaned AS raw, arg_max(canonical_id, group_id) AS canonical_id, arg_max(confidence, group_id) AS confidence FROM dc GROUP BY 1"),
    ("xm", "SELECT DISTINCT cleaned AS raw, surname, year, title, substr(sha1(lower(surname) || '|' || coalesce(nullif(year, 0)::VARCHAR, '') || '|' || substr(lower(title), 1, 60)), 1, 12) AS canonical_id FROM x WHERE title IS NOT NULL"),
    ("xc", "SELECT r.*, coalesce(a.canonical_id, z.canonical_id) AS canonical_id FROM pc r LEFT JOIN xm a ON r.raw = a.raw LEFT JOIN xm z ON r.cleaned = z.raw"),
    ("xr", "SELECT * FROM xc WHERE canonical_id IS NOT NULL"),
    ("xt", "SELECT canonical_id, min(title) AS title, min(surname) AS surname, min(year) AS year FROM xm GROUP BY 1"),
    ("xn", "SELECT canonical_id, count(DISTINCT citing_paper_id) AS cocitation_count FROM xr GROUP BY 1"),
    ("xk", "SELECT canonical_id, title, surname, year, cocitation_count FROM xn JOIN xt USING (canonical_id)"),
    ("pg", RENDER_PAGES.replace("{names}", "Smith,van der Vaart,Jones,de la Cruz,Nguyen,Levin,Vance,Hastie,Wood,Vaswani")),
    ("rf", f"SELECT substr(citing_paper_id, 2) AS paper, row_number() OVER (PARTITION BY citing_paper_id ORDER BY ord) AS ordinal, raw AS raw_ref FROM rs WHERE NOT ({NOISE})"),
    ("bm0", offsets("pg", "paper, page", BRACKET)),
    ("bm1", r"SELECT *, unnest(string_split_regex(substr(value, 2, length(value) - 2), '\s*,\s*')) AS piece FROM bm0"),
    ("bm2", r"SELECT *, CASE WHEN regexp_full_match(piece, '\d+') THEN [piece::INT] WHEN regexp_full_match(piece, '\d+\s*[-–]\s*\d+') THEN CASE WHEN regexp_extract(piece, '^(\d+)', 1)::INT <= regexp_extract(piece, '(\d+)$', 1)::INT AND regexp_extract(piece, '(\d+)$', 1)::INT - regexp_extract(piece, '^(\d+)', 1)::INT <= 50 THEN range(regexp_extract(piece, '^(\d+)', 1)::INT, regexp_extract(piece, '(\d+)$', 1)::INT + 1)::INT[] ELSE [] END ELSE [] END AS ns FROM bm1"),
    ("bm", 'SELECT paper, page, value AS raw_marker, "start", "end", unnest(ns)::INT AS number FROM bm2'),
    ("nl", 'SELECT paper, page, raw_marker, number, raw_ref, min("start") AS "start" FROM bm LEFT JOIN rf ON bm.paper = rf.paper AND bm.number = rf.ordinal GROUP BY ALL'.replace("SELECT paper,", "SELECT bm.paper,")),
    ("ix0", rf"SELECT paper, raw_ref, trim(regexp_replace(raw_ref, '^\s*(?:\[\d+\]|\d+\.)\s*', '')) AS ref FROM rf"),
    ("ix1", rf"SELECT *, nullif(regexp_extract(ref, '{YEAR}', 1), '')::INT AS year, regexp_replace(CASE WHEN regexp_matches(ref, '{YEAR}') THEN regexp_extract(ref, '^([\s\S]*?){YEAR}', 1) ELSE substr(ref, 1, 120) END, '\bet\s+al\.?', '', 'gi') AS head FROM ix0"),
    ("ix2", r"SELECT *, string_split_regex(head, '\s+(?:and|&)\s+')[1] AS whole FROM ix1"),
    ("ix3", r"SELECT *, list_filter(list_transform(string_split_regex(whole, '\s+'), lambda t: trim(t, ' .')), lambda t: t <> '' AND NOT regexp_full_match(t, '[A-Z]\.?')) AS names FROM ix2"),
    ("ix4", "SELECT paper, raw_ref, year, nullif(trim(CASE WHEN contains(head, ',') THEN split_part(head, ',', 1) WHEN len(names) > 0 THEN names[-1] ELSE whole END, ' .;:'), '') AS sname FROM ix3"),
    ("ix5", surname_key("(SELECT * FROM ix4 WHERE sname IS NOT NULL AND year IS NOT NULL)", "sname")),
    ("ix", "SELECT paper, key, year, count(*) AS n, CASE WHEN count(*) = 1 THEN min(raw_ref) END AS raw_ref FROM ix5 GROUP BY ALL"),
    ("sn0", offsets("pg", "paper, page", "[^.!?]+[.!?]?")),
    ("sn1", 'SELECT *, row_number() OVER (PARTITION BY paper, page ORDER BY "start") AS i FROM sn0'),
    ("sn2", 'SELECT bm0.paper, bm0.page, bm0."start", min(i) AS i FROM bm0 JOIN sn1 ON sn1.paper = bm0.paper AND sn1.page = bm0.page AND bm0."start" BETWEEN sn1."start" AND sn1."end" GROUP BY ALL'),
    ("sn", r"""SELECT sn2.paper, sn2.page, sn2."start", trim(substr(trim(regexp_replace(string_agg(value, ' ' ORDER BY sn1.i), '\s+', ' ', 'g')), 1, 300)) AS context FROM sn2 JOIN sn1 ON sn1.paper = sn2.paper AND sn1.page = sn2.page AND sn1.i BETWEEN sn2.i - 1 AND sn2.i + 1 GROUP BY ALL"""),
    ("pm0", offsets("pg", "paper, page", PARENTHETICAL)),
    ("pm1", f"SELECT *, regexp_extract_all(substr(value, 2, length(value) - 2), '{PAIR}', 0) AS ps FROM pm0"),
    ("pm2", "SELECT *, unnest(range(len(ps)))::INT AS pair FROM pm1"),
    ("pm", f"SELECT paper, page, 'paren_author_year' AS style, value AS raw_marker, \"start\", \"end\", pair, regexp_extract(ps[pair + 1], '{PAIR}', 1) AS surname, regexp_extract(ps[pair + 1], '{PAIR}', 2)::INT AS year FROM pm2"),
    ("nm0", offsets("pg", "paper, page", NARRATIVE)),
    ("nm", f"SELECT paper, page, 'narrative_author_year' AS style, value AS raw_marker, \"start\", \"end\", 0 AS pair, regexp_extract(value, '{NARRATIVE}', 1) AS surname, regexp_extract(value, '{NARRATIVE}', 2)::INT AS year FROM nm0"),
    ("ym", surname_key("(SELECT * FROM pm UNION ALL SELECT * FROM nm)", "surname")),
    ("yl", 'SELECT DISTINCT ym.paper, page, style, raw_marker, "start", "end", ix.raw_ref FROM ym LEFT JOIN ix ON ym.paper = ix.paper AND ym.key = ix.key AND ym.year = ix.year'),
    ("occ", "SELECT paper, page, raw_ref FROM nl WHERE raw_ref IS NOT NULL UNION ALL SELECT paper, page, raw_ref FROM yl WHERE raw_ref IS NOT NULL"),
    ("ocs", rf"SELECT occ.*, regexp_replace(raw_ref, '^\s+|\s+$', '', 'g') AS bare FROM occ"),
    ("ocl", f"SELECT ocs.*, {_preclean()} AS cleaned FROM ocs"),
    ("oc", "SELECT paper, page, raw_ref, coalesce(a.canonical_id, z.canonical_id) AS canonical_id FROM ocl LEFT JOIN xm a ON ocl.raw_ref = a.raw LEFT JOIN xm z ON ocl.cleaned = z.raw WHERE coalesce(a.canonical_id, z.canonical_id) IS NOT NULL"),
    ("sb", f"SELECT citing_paper_id, lay, CASE WHEN lay = 2 THEN string_agg(raw, chr(10) || chr(10) ORDER BY k) ELSE string_agg(concat(CASE lay WHEN 0 THEN concat('[', cast(k as string), '] ') ELSE concat(cast(k as string), '. ') END, raw), chr(10) ORDER BY k) END AS body FROM (SELECT *, row_number() OVER (PARTITION BY citing_paper_id ORDER BY ord) AS k FROM rs WHERE NOT ({NOISE})), (SELECT unnest([0, 1, 2]) AS lay) GROUP BY 1, 2"),
    ("sd", RENDER_SECTIONS.replace("({inner}) AS d", "sb")),
    ("ss", r"SELECT paper, lay, text, regexp_replace(string_split_regex(string_split_regex(text, '(?im)^\s*(?:references|bibliography|works cited)\s*$')[-1], '(?im)^\s*(?:appendix|appendices|acknowledge?ments?|supplementary materials?|funding|author contributions)\s*$')[1], '^\s+|\s+$', '', 'g') AS section FROM sd"),
    ("sr0", r"SELECT paper, lay, unnest(list_filter(list_transform(CASE WHEN lay = 0 AND len(regexp_extract_all(section, '(?m)^\s*\[(\d+)\]\s+')) >= 2 THEN string_split(regexp_replace(section, '(?m)^\s*\[\d+\]\s+', chr(1) || '\0', 'g'), chr(1))[2:] WHEN lay = 1 AND len(regexp_extract_all(section, '(?m)^\s*(\d+)\.\s+')) >= 2 THEN string_split(regexp_replace(section, '(?m)^\s*\d+\.\s+', chr(1) || '\0', 'g'), chr(1))[2:] ELSE string_split_regex(section, '\n\s*\n') END, lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: length(t) >= 20)) AS raw_ref FROM ss"),
    ("wl0", f"SELECT doc_id, row_number() OVER () AS row_id, list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda z: {_SQUEEZED}) AS ls FROM ({RENDER_WRAPPED})"),
    ("wl1", "SELECT *, array_to_string(ls, chr(10)) AS body FROM wl0"),
    ("wl2", rf"SELECT *, {_BLANKS} AS blank, CASE WHEN len(regexp_extract_all(body, '(?m)^\s*\[\d+\]\s+')) >= 2 THEN 0 WHEN len(regexp_extract_all(body, '(?m)^\s*\d+\.\s+')) >= 2 THEN 1 WHEN contains(body, chr(10) || chr(10)) AND len(blank) >= 2 THEN 2 ELSE 3 END AS lay FROM wl1"),
    ("wl3", f"SELECT doc_id, unnest(CASE lay WHEN 0 THEN {_NUMBERED[0]} WHEN 1 THEN {_NUMBERED[1]} ELSE blank END) AS raw_ref FROM wl2 WHERE lay < 3"),
    ("wl4", f"SELECT *, regexp_matches(one, '{NEW_REFERENCE}') AS fresh FROM (SELECT doc_id, row_id, unnest(ls) AS one, unnest(range(1, len(ls) + 1)) AS k FROM wl2 WHERE lay = 3)"),
    ("wl5", "SELECT *, coalesce(one <> '' AND NOT fresh AND ends_with(lag(one) OVER lines, '-'), false) AS glued FROM wl4 WINDOW lines AS (PARTITION BY row_id ORDER BY k)"),
    ("wl6", "SELECT *, coalesce(lead(glued) OVER lines, false) AS cut, sum(fresh::INT) OVER lines AS part FROM wl5 WINDOW lines AS (PARTITION BY row_id ORDER BY k)"),
    ("wl7", "SELECT doc_id, row_id, part, string_agg(concat(CASE WHEN glued THEN '' ELSE ' ' END, CASE WHEN cut THEN left(one, length(one) - 1) ELSE one END), '' ORDER BY k) AS z FROM wl6 WHERE one <> '' GROUP BY ALL"),
    ("wl8", rf"SELECT doc_id, {_SQUEEZED} AS raw_ref FROM wl7"),
    ("wl", r"SELECT * FROM wl3 UNION ALL SELECT * FROM wl8 WHERE length(raw_ref) >= 20 AND NOT regexp_full_match(raw_ref, '\d+')"),
]
_NAMES = [n for n, _ in CTES]


def sql(body: str, last: str) -> str:
    """``body`` after all named tables that ``last`` needs."""
    import re

    known, wanted = dict(CTES), set()

    def need(text: str) -> None:
        for word in set(re.findall(r"\b[a-z]{1,3}\d?\b", text)):
            if word in known and word not in wanted:
                wanted.add(word)
                need(known[word])

    wanted.add(last)
    need(known[last])
    need(body)
    listed = [n for n in _NAMES if n in wanted]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({known[n]})" for n in listed) + " " + body
