"""Lists of reference strings out of JSON text, and flat author names."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeweave.functions.arrays import let

# Keys that hold a reference, and keys of objects that wrap a list.
ITEM_KEYS = ("raw", "reference", "text", "ref", "citation")
LIST_KEYS = ("references", "refs", "bibliography", "entries", "items", "data", "results")
NONE = "cast(array() as array<string>)"


def unfenced(text: Column) -> Column:
    """JSON text without a Markdown fence around it."""
    return F.regexp_replace(F.trim(text), "^```(?:json)?\\s*|\\s*```$", "")


def string_list(text: Column) -> Column:
    """Strings of a JSON list of strings or objects, of an object that wraps one, or of an object's only list.

    Objects give the first of their known keys; what has none is dropped; text
    that is no JSON list gives null.
    """
    bare = unfenced(text)
    as_map = F.from_json(bare, "map<string,string>")
    wrapped = F.coalesce(*[F.get_json_object(bare, f"$.{k}") for k in LIST_KEYS])
    lists = F.filter(F.map_values(as_map), lambda v: F.startswith(v, F.lit("[")))
    only = F.when(F.size(lists) == 1, F.element_at(lists, 1))
    chosen = F.when(F.startswith(bare, F.lit("[")), bare).otherwise(F.coalesce(F.when(F.startswith(wrapped, F.lit("[")), wrapped), only))
    items = F.from_json(chosen, "array<string>")
    item = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ITEM_KEYS])).otherwise(x)
    return F.filter(F.transform(items, item), lambda x: x.isNotNull() & (F.trim(x) != ""))


def flat_authors(cell: Column) -> Column:
    """Author names of a JSON cell of objects or strings; a cell that is no list is one name."""
    name = lambda x: F.when(F.startswith(x, F.lit("{")), F.trim(F.concat_ws(" ", F.get_json_object(x, "$.given"), F.get_json_object(x, "$.surname")))).otherwise(x)
    listed = lambda parsed: F.filter(F.transform(parsed, name), lambda x: x.isNotNull() & (x != ""))
    read = lambda c: F.coalesce(listed(F.from_json(c, "array<string>")), F.array(c))
    return let(cell, lambda c: F.when(c.isNull() | (F.trim(c) == ""), F.expr(NONE)).when(F.startswith(F.trim(c), F.lit("[")), read(c)).otherwise(F.array(c)))


def repaired(text: str | None) -> str | None:
    """Valid JSON made of nearly valid text: fences, trailing commas, single quotes, text around the outermost value."""
    if text is None:
        return None
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip())
    spans = [(body.find(a), body.rfind(b)) for a, b in ("[]", "{}") if a in body]
    inner = [body[i : j + 1] for i, j in sorted(spans) if 0 <= i < j]
    for candidate in (body, *inner):
        for form in (candidate, re.sub(r",\s*([\]}])", r"\1", candidate), re.sub(r",\s*([\]}])", r"\1", candidate.replace("'", '"'))):
            try:
                return json.dumps(json.loads(form), ensure_ascii=False)
            except ValueError:
                continue
    return None


@F.pandas_udf(StringType())
def repair(text: pd.Series) -> pd.Series:
    """Arrow-batched ``repaired``, for rows that ``string_list`` could not read."""
    return text.map(repaired)


def flat_items(cell: Column) -> Column:
    """JSON objects of a model's answer as strings: lists inside the list are opened one level, other items are dropped."""
    items = F.from_json(cell, "array<string>")
    opened = F.flatten(F.transform(items, lambda x: F.when(F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, "array<string>")).otherwise(F.array(x))))
    return F.filter(opened, lambda x: F.coalesce(F.startswith(F.ltrim(x), F.lit("{")), F.lit(False)))
