"""K-d tree sharding at distributed weighted medians.

A node is split along its widest metadata dimension at the weighted median
until each leaf has its share of the bytes; rows go down one level a join with
that level's cuts, so the plan does not grow with the tree. Medians are found without sorting:
every round weighs a bounded number of equal ranges of the ordering key around
the median of all nodes of a level at once, and zooms into the one that holds
it. Ties along a dimension are ordered by text, so equal texts stay together;
only a group too heavy for a balanced cut is divided, by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.sources.scratch import discard, materialize

#: Bits of a coordinate and of the text hash in the ordering key, and of the id hash that divides heavy groups.
COORDINATE_BITS, HASH_BITS = 30, 30
TOP = 1 << (COORDINATE_BITS + HASH_BITS)
BINS_BITS = 12


@dataclass(frozen=True)
class Cut:
    """Rows of ``node`` go right if (key, divider) of ``dimension`` is at least (key, divider)."""

    node: int
    dimension: int
    key: int
    divider: int
    left: int
    right: int


def _key(dimension: Column) -> Column:
    """Ordering key of a row along one of its coordinates, ties by text."""
    return F.shiftleft(F.get(F.col("_at"), dimension), HASH_BITS) + F.col("_text_hash")


def coordinates(docs: DataFrame, dimensions: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, _text_hash, _divider, _at: a coordinate of 0..2^30-1 for each dimension, _leaf 0), written once.

    ``dimensions`` are numbers from 0 to 1; null counts as 0. size is the UTF-8
    bytes plus one, of a null text one.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    scaled = [F.least(F.floor(F.coalesce(F.greatest(v, F.lit(0.0)), F.lit(0.0)) * (1 << COORDINATE_BITS)), F.lit((1 << COORDINATE_BITS) - 1)).cast("long") for v in dimensions.values()]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.pmod(F.xxhash64(raw), F.lit(1 << HASH_BITS)).alias("_text_hash"), F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << HASH_BITS)).alias("_divider"), F.array(*scaled).alias("_at"), F.lit(0).alias("_leaf"))
    return materialize(own, "shard-points")


def _descended(points: DataFrame, cuts: list[Cut]) -> DataFrame:
    """``points`` one level further down the tree, written once; the cuts of a level are a table of one row a node."""
    rows = [(c.node, c.dimension, c.key, c.divider, c.left, c.right) for c in cuts]
    table = F.broadcast(points.sparkSession.createDataFrame(rows, "_node int, _d int, _k long, _v long, _left int, _right int"))
    key = _key(F.col("_d"))
    right = (key > F.col("_k")) | ((key == F.col("_k")) & (F.col("_divider") >= F.col("_v")))
    leaf = F.when(F.col("_node").isNull(), F.col("_leaf")).otherwise(F.when(right, F.col("_right")).otherwise(F.col("_left")))
    moved = points.join(table, F.col("_leaf") == F.col("_node"), "left").withColumn("_leaf", leaf).select(*points.columns)
    return materialize(moved, "shard-level")


def _medians(level: DataFrame, wanted: dict[int, tuple[int, float]], tolerance: float) -> dict[int, tuple[int, int]]:
    """node -> (key, divider) of its cut: the weight before it is the wanted one within ``tolerance`` bytes, or as near as rows allow.

    First ranges of keys are weighed, then, if one key alone is too heavy, ranges of its divider.
    """
    spark = level.sparkSession
    state = {n: {"low": 0, "width": TOP, "before": 0.0, "target": t, "key": None, "done": None} for n, (_, t) in wanted.items()}
    step = max(4, BINS_BITS - max(0, len(wanted) - 1).bit_length())
    while any(s["done"] is None for s in state.values()):
        open_ = {n: s for n, s in state.items() if s["done"] is None}
        rows = [(n, wanted[n][0], s["low"], max(1, s["width"] >> step), s["width"], -1 if s["key"] is None else s["key"]) for n, s in open_.items()]
        table = F.broadcast(spark.createDataFrame(rows, "_leaf int, _d int, _low long, _bin long, _width long, _k long"))  # one row a node
        joined = level.join(table, "_leaf")
        joined = joined.withColumn("_own", _key(F.col("_d"))).where((F.col("_k") < 0) | (F.col("_own") == F.col("_k"))).withColumn("_place", F.when(F.col("_k") < 0, F.col("_own")).otherwise(F.col("_divider")))
        inside = joined.where((F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_low") + F.col("_width")))
        found: dict[int, list[tuple[int, int]]] = {n: [] for n in open_}
        for r in inside.groupBy("_leaf", F.floor((F.col("_place") - F.col("_low")) / F.col("_bin")).cast("long").alias("_range")).agg(F.sum("size").alias("w")).collect():  # at most 2^BINS_BITS ranges for all nodes, or 17 a node
            found[r._leaf].append((r._range, r.w))
        for n, s in open_.items():
            size = max(1, s["width"] >> step)
            for at, w in sorted(found[n]):
                if s["before"] + w <= s["target"]:
                    s["before"] += w
                    continue
                start = s["low"] + at * size
                short = s["target"] - s["before"]
                if min(short, w - short) <= tolerance or size == 1 and s["key"] is not None:
                    past = w - short < short
                    edge = start + (size if past else 0)
                    s["done"] = (edge, 0) if s["key"] is None else (s["key"], edge)
                elif size == 1:
                    s |= {"key": start, "low": 0, "width": 1 << HASH_BITS}
                else:
                    s |= {"low": start, "width": size}
                break
            else:
                end = s["low"] + s["width"]
                s["done"] = (end, 0) if s["key"] is None else (s["key"], end)
    return {n: s["done"] for n, s in state.items()}


def placed(points: DataFrame, n_dimensions: int, shards: int, tolerance: float = 0.002) -> tuple[DataFrame, dict[int, int]]:
    """(points with their leaf, leaf -> shard) of a k-d tree with ``shards`` leaves of nearly equal bytes.

    A node is cut along the dimension whose spread is widest against that of
    the whole table, so dimensions of any unit compare. ``tolerance`` is the
    part of a leaf's share by which a cut may miss to keep a group of equal
    texts whole.
    """
    spread = [F.coalesce(F.stddev_pop(F.get("_at", F.lit(d)).cast("double")), F.lit(0.0)).alias(f"d{d}") for d in range(n_dimensions)]
    first = points.agg(F.sum("size").alias("w"), *spread).first()
    total, unit = first.w or 0, [first[f"d{d}"] or 1.0 for d in range(n_dimensions)]
    level, leaves = {0: (0, shards)}, 1
    while total:
        split = {n: span for n, span in level.items() if span[1] - span[0] > 1}
        if not split:
            break
        stats = {r._leaf: r for r in points.groupBy("_leaf").agg(F.sum("size").alias("_w"), *spread).collect()}  # one row a leaf
        wanted = {}
        for n, (a, b) in split.items():
            if n in stats:
                widest = max(range(n_dimensions), key=lambda d: (stats[n][f"d{d}"] / unit[d], -d))
                wanted[n] = (widest, stats[n]._w * ((b - a) // 2) / (b - a))
        edges = _medians(points, wanted, tolerance * total / shards) if wanted else {}
        after, cuts = {n: span for n, span in level.items() if n not in split}, []
        for n, (a, b) in split.items():
            middle = a + (b - a) // 2
            after[n], after[leaves] = (a, middle), (middle, b)
            if n in edges:
                cuts.append(Cut(n, wanted[n][0], *edges[n], n, leaves))
            leaves += 1
        below = _descended(points, cuts)
        discard(points)
        points, level = below, after
    return points, {leaf: a for leaf, (a, _) in level.items()}


def shard(docs: DataFrame, shards: int = 8, dimensions: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 20_000, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of ``docs`` in a shard of nearly equal bytes.

    With ``target_bytes`` the number of shards follows from the total. Slots
    count from 0 without gaps in each shard, ties by id, checksum and size.
    Null ids, null texts (one byte) and repeated rows each have a slot; an
    empty table gives no rows; other columns than the dimensions are not read.
    """
    if dimensions is None:
        dimensions = default_dimensions(docs, text_col)
    points = coordinates(docs, dimensions, id_col, text_col)
    rows, total = points.agg(F.count(F.lit(1)), F.sum("size")).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    leafed, names = placed(points, len(dimensions), shards)
    # one row a shard
    table = F.broadcast(leafed.sparkSession.createDataFrame(sorted(names.items()), "_leaf int, shard int"))
    buckets = max(1, -(-rows // bucket_rows))
    dealt = leafed.join(table, "_leaf").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_text_hash", F.lit(3)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    slots = dealt.withColumn("_own", own).join(ahead, ["shard", "_bucket"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("_own") + F.col("_ahead")).cast("long").alias("slot"))


def default_dimensions(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Text size on a log scale and, where the table has it, language: the same for equal texts."""
    size = F.log2(F.octet_length(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) + 1) / 40
    if "lang" not in docs.columns:
        return {"_d_size": size}
    return {"_d_size": size, "_d_lang": F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")) / float(1 << 32)}
