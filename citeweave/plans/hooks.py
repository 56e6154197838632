"""Pluggable model and lookup steps with offline stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, MAX_CALLS, RESULT_CHARS = 30, 5, 4000


def bisected(batch: list[str], call: Callable[[list[str]], list[dict]]) -> tuple[list[tuple[int, dict]], list[tuple[int, str]]]:
    """(results, failures) by position: a batch that fails is halved until single items fail alone."""
    done: list[tuple[int, dict]] = []
    failed: list[tuple[int, str]] = []
    open_ = [(0, batch)]
    while open_:
        at, part = open_.pop()
        try:
            found = call(part)
            if len(found) != len(part):
                raise ValueError(f"{len(found)} results for {len(part)} items")
            done += [(at + k, r) for k, r in enumerate(found)]
        except Exception as e:  # noqa: BLE001  a model's answer may fail in any way
            if len(part) == 1:
                failed.append((at, str(e)))
            else:
                half = len(part) // 2
                open_ += [(at, part[:half]), (at + half, part[half:])]
    return sorted(done, key=lambda x: x[0]), sorted(failed)


#: Fields beyond surname, year and title that a model may give.
DETAILS = ("given", "venue", "type", "doi", "volume", "pages")


def extract_with(rows: DataFrame, call: Callable[[list[str]], list[dict]], batch: int = BATCH) -> DataFrame:
    """``rows`` with surname, year, year_suffix, title, details and _error by a model that maps cleaned strings to records.

    A batch that fails is halved; a string that fails alone has its error and no fields.
    """
    texts = ("surname", "year_suffix", "title", *DETAILS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch].reset_index(drop=True)
                done, failed = bisected(list(part.cleaned), call)
                found, why = dict(done), dict(failed)
                out = {c: part[c] for c in part.columns}
                for name in texts:
                    out[f"_{name}"] = pd.Series([None if found.get(i, {}).get(name) is None else str(found[i][name]) for i in range(len(part))], dtype=object)
                out["_year"] = pd.Series([_whole(found.get(i, {}).get("year")) for i in range(len(part))], dtype="Int32")
                out["_error"] = pd.Series([why.get(i) for i in range(len(part))], dtype=object)
                yield pd.DataFrame(out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"_{c} string" for c in texts), "_year int", "_error string"])
    found = rows.mapInPandas(run, schema)
    return found.select(*rows.columns, F.col("_surname").alias("surname"), F.col("_year").alias("year"), F.col("_year_suffix").alias("year_suffix"), F.col("_title").alias("title"), F.struct(*[F.col(f"_{c}").alias(c) for c in DETAILS]).alias("details"), "_error")


def _whole(value: object) -> int | None:
    """An int where the value is one, else None."""
    try:
        return int(str(value))
    except ValueError:
        return None


def members(clustered: DataFrame) -> DataFrame:
    """(cluster_id, members): distinct records of the clusters that no rule decides, in order."""
    open_ = clustered.where(~F.col("tier").isin("auto", "singleton"))
    one = F.struct("member_rank", "surname", "year", "title", "cleaned")
    return open_.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_set(one)), lambda m: F.struct(m["surname"].alias("surname"), m["year"].alias("year"), m["title"].alias("title"), m["cleaned"].alias("raw"))).alias("members"))


def _asked(judged: DataFrame, sets: DataFrame, call: Callable[[list[dict]], dict]) -> DataFrame:
    """``judged`` rows of the clusters in ``sets`` with what ``call(members)`` says in place of their verdict; a failure is uncertain."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for rows in frame.members:
                try:
                    said.append(dict(call([dict(r) for r in rows])))
                except Exception as e:  # noqa: BLE001  a model's answer may fail in any way
                    said.append({"reasoning": str(e)})
            yield pd.DataFrame({"_cluster": frame.cluster_id, "_verdict": [x.get("verdict") if x.get("verdict") in ("same", "different") else "uncertain" for x in said], "_confidence": [float(x.get("confidence") or 0.2) for x in said], "_lookup": [bool(x.get("needs_external_lookup")) for x in said]})

    told = sets.mapInPandas(run, "_cluster long, _verdict string, _confidence double, _lookup boolean")
    joined = judged.join(told, judged["cluster_id"] == F.col("_cluster"), "left")
    kept = [c for c in judged.columns if c not in ("verdict", "confidence", "needs_external_lookup")]
    return joined.select(*kept, F.coalesce("_verdict", "verdict").alias("verdict"), F.coalesce("_confidence", "confidence").alias("confidence"), F.coalesce("_lookup", "needs_external_lookup").alias("needs_external_lookup"))


def judge_with(clustered: DataFrame, judged: DataFrame, call: Callable[[list[dict]], dict]) -> DataFrame:
    """Verdicts of ``call(members)`` for clusters that no rule decides; a failed answer is uncertain at 0.2."""
    return _asked(judged, members(clustered), call)


def needs_agent() -> Column:
    return (F.col("verdict") == "uncertain") | F.col("needs_external_lookup")


def agent_over(clustered: DataFrame, judged: DataFrame, call: Callable[[list[dict]], dict]) -> DataFrame:
    """Verdicts of ``call(members)`` where the judge is uncertain or asks for a lookup; the agent sees the whole cluster."""
    wanted = judged.where(needs_agent()).select(F.col("cluster_id").alias("_open"))
    sets = members(clustered).join(wanted, F.col("cluster_id") == F.col("_open"), "left_semi")
    return _asked(judged, sets, call)


def fallback_with(docs: DataFrame, found: DataFrame, quality: DataFrame, call: Callable[[str], list[str]], most: int = 30_000, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(references, quality with fallback_invoked): papers below the thresholds are read again by ``call(section text)``.

    The section is cut to ``most`` characters and tried ``attempts`` times; an
    answer counts if it has no fewer references than the heuristic found.
    """

    def one(text: str) -> list[str] | None:
        for _ in range(attempts):
            try:
                return [str(x).strip() for x in call(text) if str(x).strip()]
            except Exception:  # noqa: BLE001  a model's answer may fail in any way
                continue
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [one(t) for t in frame.text]
            yield pd.DataFrame({"paper": [p for p, g, n in zip(frame.paper, got, frame.n_refs) if g and len(g) >= n], "refs": [g for g, n in zip(got, frame.n_refs) if g and len(g) >= n]})

    low = quality.where("needs_fallback").select("paper", "n_refs")
    section = F.coalesce(F.col("section.text"), F.array_join("texts", "\n"))
    again = docs.join(low, "paper").select("paper", F.substring(section, 1, most).alias("text"), "n_refs").mapInPandas(run, "paper string, refs array<string>")
    from citeweave.sources.scratch import materialize

    again = materialize(again, "fallback")
    read = again.select("paper", F.posexplode("refs").alias("p", "raw_ref")).select("paper", (F.col("p") + 1).alias("ordinal"), "raw_ref")
    merged = found.join(again.select("paper"), "paper", "left_anti").unionByName(read)
    return merged, quality.withColumn("fallback_invoked", F.col("needs_fallback"))


def tool_loop(ask: Callable[[list[dict]], dict], tools: dict[str, Callable[..., object]], question: str, max_calls: int = MAX_CALLS) -> dict:
    """A verdict from a model that may call ``tools``: at most ``max_calls`` calls, ``max_calls + 2`` turns, results cut to 4000 characters.

    Without a verdict the answer is uncertain at confidence 0.2.
    """
    talk, used = [{"role": "user", "content": question}], 0
    for _ in range(max_calls + 2):
        said = ask(talk)
        if said.get("verdict"):
            return {**said, "tool_calls_used": used}
        name = said.get("tool")
        if name is None:
            break
        if used >= max_calls:
            result = "no calls left"
        else:
            used += 1
            result = str(tools[name](**said.get("arguments", {}))) if name in tools else f"unknown tool {name}"
        talk += [{"role": "assistant", "content": str(said)}, {"role": "tool", "content": result[:RESULT_CHARS]}]
    return {"verdict": "uncertain", "confidence": 0.2, "reasoning": "no verdict", "needs_external_lookup": False, "tool_calls_used": used}


def offline_agent(judged: DataFrame) -> DataFrame:
    """The stand-in for an agent: what the judge left uncertain stays so, at confidence 0.2."""
    return judged.withColumn("confidence", F.when(F.col("verdict") == "uncertain", 0.2).otherwise(F.col("confidence")))


def agent_with(judged: DataFrame, decide: Callable[[str], dict]) -> DataFrame:
    """Verdicts of ``decide(title)`` for uncertain rows only; the others never reach Python."""

    @F.pandas_udf("verdict string, confidence double")
    def ask(titles: pd.Series) -> pd.DataFrame:
        found = [decide(t or "") for t in titles]
        return pd.DataFrame({"verdict": [x.get("verdict", "uncertain") for x in found], "confidence": [float(x.get("confidence", 0.2)) for x in found]})

    open_ = judged.where(needs_agent()).withColumn("_a", ask(F.col("head.title")))
    settled = open_.withColumn("verdict", F.col("_a.verdict")).withColumn("confidence", F.col("_a.confidence")).drop("_a")
    return judged.where(~needs_agent()).unionByName(settled)


def citing_context(rows: DataFrame, citances: DataFrame) -> DataFrame:
    """``rows`` with the last context of their (citing_paper_id, raw), cut to 500 characters."""
    last = citances.groupBy("citing_paper_id", F.col("raw_ref").alias("raw")).agg(F.max_by(F.substring("context", 1, 500), F.col("ord")).alias("context"))
    return rows.join(last, ["citing_paper_id", "raw"], "left")


def topic(title: Column) -> Column:
    """Search topic of a paper offline: eighty characters of its title, else a fixed one."""
    return F.coalesce(F.nullif(F.trim(F.substring(title, 1, 80)), F.lit("")), F.lit("machine learning"))


def download_with(rows: DataFrame, fetch: Callable[[str], tuple[str, bytes]], retries: int = 2, pause: float = 1.5, least: int = 1000) -> DataFrame:
    """(url, content, error) of rows(url): ``fetch`` gives (content type, bytes).

    A failed try is repeated ``retries`` times after ``pause`` times the try's
    number in seconds. Refused: other types than PDF unless the address ends in
    .pdf, and files under ``least`` bytes.
    """

    def one(url: str) -> tuple[bytes | None, str | None]:
        import time

        why = ""
        for attempt in range(retries + 1):
            try:
                kind, content = fetch(url)
                if "pdf" not in kind.lower() and not url.lower().endswith(".pdf"):
                    return None, f"not a PDF: {kind}"
                return (content, None) if len(content) >= least else (None, f"{len(content)} bytes")
            except Exception as e:  # noqa: BLE001  any network error is one more try
                why = str(e)
                if attempt < retries:
                    time.sleep(pause * (attempt + 1))
        return None, why

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [one(u) for u in frame.url]
            yield pd.DataFrame({"url": frame.url, "content": [c for c, _ in got], "error": [e for _, e in got]})

    return rows.select("url").mapInPandas(run, "url string, content binary, error string")


def lookup_works(rows: DataFrame, works: DataFrame, most: int = 5) -> DataFrame:
    """(ord, found): up to ``most`` works(title, year, ...) for each of rows(ord, title, year), offline in place of a web search.

    Works share the first three words of the title; an equal title and year come first.
    """
    from citeweave.functions.text import eval_form

    key = lambda c: F.array_join(F.slice(F.split(eval_form(c), " "), 1, 3), " ")
    wanted = rows.where("title is not null").select("ord", eval_form(F.col("title")).alias("_t"), F.col("year").alias("_y"), key(F.col("title")).alias("_k"))
    known = works.where("title is not null").withColumn("_k", key(F.col("title")))
    fields = [c for c in works.columns]
    scored = wanted.join(known, "_k").select("ord", F.struct((eval_form(F.col("title")) != F.col("_t")).alias("other_title"), (~F.col("year").eqNullSafe(F.col("_y"))).alias("other_year"), F.struct(*fields).alias("work")).alias("s"))
    from pyspark.sql import Window

    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("ord").orderBy("s"))).where(F.col("_n") <= most)
    return best.groupBy("ord").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["work"]).alias("found"))
