"""SimHash near-duplicate classes by pigeonhole blocks.

A fingerprint has one bit for each of 64: set when more than half of the
document's shingle hashes have it set. Fingerprints that differ in at most
``max_bits`` places link; classes are the connected components.

Whatever ``max_bits`` places differ, at least ``matched`` of the ``blocks``
blocks are equal when ``blocks - matched = max_bits``, so every combination of
``matched`` blocks is one join key and no link is lost. Only distinct
fingerprints are joined; copies follow their fingerprint. Rows with one key
meet in a sorted partition, where a breadth-first walk compares them and emits
a spanning forest of the links: rows out are linear in rows in, however large
a group of near copies is. A key with more than ``tile`` fingerprints is cut
into chunks, and each pair of chunks is a task's work of its own.

No number of blocks holds for the wide fingerprints of the pipeline's stage.
Its keys are the least shingle hashes of each text: texts that share enough of
their shingles share one of those. Classes by a wide bound are candidates, in
which the exact shares of shingles make the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.arrays import hot_keys, salted
from citeweave.llm.batches import gather, released, slices
from citeweave.operators.components import connected_components
from citeweave.sources.scratch import materialize

BITS = 64
#: Words of 64 bits in a wide fingerprint.
WIDE = 4


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included.

    Only A-Z are lower-cased; words are runs of other characters than ASCII
    white space; a text of fewer words than a shingle has one shingle of them
    all; no words (or null) have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, ">u8")
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    if len(words) > shingle:
        stop = start[shingle - 1 :] + size[shingle - 1 :] - 1
        start = start[: len(stop)]
    else:
        start, stop = start[:1], np.array([len(line)])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(start.tolist(), stop.tolist())], dtype=">u8")


def _majority(rows: np.ndarray) -> bytes:
    """Bits that are set in over half of the rows of bytes."""
    n, count = len(rows), np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(rows[at : at + 255 * 64], axis=1)
        whole = len(bits) // 255
        if whole:
            count += bits[: whole * 255].reshape(whole, 255, -1).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        count += bits[whole * 255 :].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n).tobytes()


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text; zero without words."""
    hashes = shingle_hashes(text, shingle, seed)
    return int.from_bytes(_majority(hashes.view(np.uint8).reshape(-1, 8)), "big") if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, text_hash): fp is the fingerprint as a signed 64-bit integer. One row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                known: dict[str | None, int] = {}
                out = []
                for text in part.column("text").to_pylist():
                    if text not in known:
                        known[text] = fingerprint(text, shingle, seed)
                    out.append(known[text])
                fp = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fp), part.column("text_hash")], names=["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(released(run), "doc_id long, fp long, text_hash long")


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE) -> tuple[int, ...]:
    """``words`` unsigned fingerprints over a set of shingle hashes, each from hashes mixed anew; no hashes: zeros."""
    if not len(hashes):
        return (0,) * words
    mixed = hashes[:, None] + (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    bits = _majority(mixed.astype(">u8").view(np.uint8).reshape(len(hashes), -1))
    return tuple(int.from_bytes(bits[k : k + 8], "big") for k in range(0, 8 * words, 8))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, shingle).astype(np.uint64))


def prefix(hashes: np.ndarray, least: float) -> np.ndarray:
    """The least hashes of a set, of which any set that shares ``least`` of the union with it has one in its own prefix."""
    return hashes[: len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1]


def shingle_prints(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, words: int = WIDE) -> DataFrame:
    """(doc_id, text_hash, fp, f0.., size, prefix): fp names the shingle set, of ``size`` hashes. One row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                known: dict[str | None, tuple] = {}
                out = []
                for text in part.column("text").to_pylist():
                    if text not in known:
                        own = shingle_set(text, shingle)
                        known[text] = (xxhash.xxh64_intdigest(own.tobytes()), *wide_fingerprint(own, words)), len(own), prefix(own, least).view(np.int64)
                    out.append(known[text])
                fps = np.array([x for x, _, _ in out], dtype=np.uint64).view(np.int64).reshape(-1, words + 1)
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), *[pa.array(np.ascontiguousarray(fps[:, k])) for k in range(words + 1)], pa.array([n for _, n, _ in out], pa.int64()), pa.array([x for _, _, x in out], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp", *_names(words), "size", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(released(run), "doc_id long, text_hash long, fp long, " + ", ".join(f"{c} long" for c in _names(words)) + ", size long, prefix array<long>")


def _names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def block_keys(fp: str, max_bits: int, matched: int) -> list:
    """One key expression for each combination of ``matched`` equal blocks."""
    blocks = max_bits + matched
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), matched)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        keys.append(F.struct(F.lit(number).alias("combination"), F.expr(f"{fp} & {signed}L" if signed != -(1 << 63) else f"{fp} & shiftleft(1L, 63)").alias("block")))
    return keys


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _forest(node: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among fingerprints: each is compared with those not reached yet."""
    if len(node) <= 96 and (_distance(fps[:, None], fps[None]) <= max_bits).sum() == len(node):
        return []  # nothing but each with itself
    links: list[tuple[int, int]] = []
    rest = np.arange(len(node))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            near = _distance(fps[rest], fps[one]) <= max_bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links.extend((int(node[one]), int(node[x])) for x in found)
                frontier.extend(found.tolist())
    return links


def _linked_in_runs(max_bits: int, words: int):
    """Links within runs of equal (combination, block, tile); the partition must be sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 4 + words), np.int64)

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            start = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])
            size = np.diff(start)
            node, fps = rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
            two = start[:-1][size == 2]
            close = two[_distance(fps[two], fps[two + 1]) <= max_bits]
            more = [x for at, n in zip(start[:-1][size > 2].tolist(), size[size > 2].tolist()) for x in _forest(node[at : at + n], fps[at : at + n], max_bits)]
            ends = np.array(more, dtype=np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(np.concatenate([node[close], ends[:, 0]])), pa.array(np.concatenate([node[close + 1], ends[:, 1]]))], names=["src", "dst"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([kept, rows])
            if not len(rows):
                continue
            other = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))
            whole = other[-1] + 1 if len(other) else 0
            if whole:
                yield flush(rows[:whole])
            kept = rows[whole:]
        if len(kept):
            yield flush(kept)

    return run


def links(distinct: DataFrame, keys: list | Column, words: list[str], max_bits: int, tile: int = 32768) -> DataFrame:
    """(src, dst): links that connect the same fingerprints as all pairs that share a key and differ in at most ``max_bits`` do.

    ``distinct`` has fp, which names a fingerprint, and its ``words``, without
    repeats. ``keys``: one expression for each key, or an array of them all.
    """
    keys = keys if isinstance(keys, Column) else F.array(*keys)
    keyed = distinct.select("fp", *[F.col(w).alias(f"_{w}") for w in words], F.explode(keys).alias("k"))
    names = [f"_{w}" for w in words]
    keyed = keyed.select("fp", *names, "k.combination", "k.block")
    hot = materialize(keyed.groupBy("combination", "block").count().where(F.col("count") > tile), "hot-blocks")
    if hot.isEmpty():
        tiled = keyed.withColumn("tile", F.lit(0))
    else:
        chunks = F.coalesce(F.ceil(F.col("count") / tile).cast("int"), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        met = F.sequence(F.lit(0), F.col("chunks") - 1)
        tile_of = F.transform(met, lambda other: F.greatest(F.col("own"), other) * F.col("chunks") + F.least(F.col("own"), other))
        tiled = keyed.join(hot, ["combination", "block"], "left").withColumn("chunks", chunks).withColumn("own", own).select("fp", *names, "combination", "block", F.explode(tile_of).alias("tile"))
    by = ["combination", "block", "tile"]
    return tiled.select(*by, "fp", *names).repartition(*by).sortWithinPartitions(*by).mapInArrow(released(_linked_in_runs(max_bits, len(words))), "src long, dst long")


def classes(prints: DataFrame, keys: list, words: list[str], max_bits: int) -> DataFrame:
    """(fp, leader, component_id): the class of each fingerprint of (doc_id, fp, its words, text_hash).

    leader is the least (doc_id, text_hash) of the class, a null doc_id after
    all others; component_id is its doc_id.
    """
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")
    own = list(dict.fromkeys(["fp", *words]))
    least = materialize(prints.groupBy(*own).agg(F.min(row).alias("least")), "fingerprints")
    return _named(least, links(least.select(*own), keys, words, max_bits))


def _named(least: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, leader, component_id) of (fp, least) under links (src, dst)."""
    linked = connected_components(found)
    root = materialize(least.join(linked, least.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "roots")
    named = root.groupBy("root").agg(F.min("least").alias("leader"))
    return salted(root.select("fp", "root"), named, ["root"], ["fp"], hot=hot_keys(root, ["root"])).select("fp", "leader", F.col("leader.doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, max_bits: int = 4, matched: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Texts without words share the fingerprint zero and link like any others. A
    null id names a class only if it has no other. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    named = salted(prints, classes(prints, block_keys("fp", max_bits, matched), ["fp"], max_bits), ["fp"], ["doc_id", "text_hash"], hot=hot_keys(prints, ["fp"]))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _exact_forest(node: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets that share ``least`` of their union."""
    size = np.array([len(x) for x in sets])
    bounds = np.concatenate([[0], np.cumsum(size)])
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    marked, found = np.zeros(len(distinct), np.int64), []
    rest = np.flatnonzero(size)
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            marked[number[bounds[one] : bounds[one + 1]]] = 1
            flat, count = gather(number, bounds, rest)
            both = np.add.reduceat(marked[flat], np.cumsum(count) - count)
            marked[number[bounds[one] : bounds[one + 1]]] = 0
            near = both >= least * (size[one] + size[rest] - both) - 1e-9
            found.extend((node[one], node[x]) for x in rest[near].tolist())
            frontier.extend(rest[near].tolist())
            rest = rest[~near]
    return found


def exact_links(texts: DataFrame, least: float, shingle: int = 5, tile: int = 2 << 20) -> DataFrame:
    """(src, dst): links that connect the same fps as all pairs of one ``component`` that share ``least`` of their shingles.

    ``texts`` has component, fp, size and text; a component of more than
    ``tile`` shingles is cut into chunks, and pairs of chunks are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, {}

        def flush() -> pa.RecordBatch:
            ends = np.array(_exact_forest(list(kept), list(kept.values()), least) if len(kept) > 1 else [], dtype=np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            for some in slices(batch, "text"):
                for component, part, fp, text in zip(*[c.to_pylist() for c in some.columns]):
                    if (component, part) != at:
                        yield flush()
                        at, kept = (component, part), {}
                    if fp not in kept:
                        kept[fp] = shingle_set(text, shingle)
        yield flush()

    total = texts.groupBy("component").agg(F.ceil(F.sum("size") / tile).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tile_of = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.greatest(F.col("own"), other) * F.col("chunks") + F.least(F.col("own"), other))
    tiled = texts.join(total, "component").withColumn("own", own).select("component", F.explode(tile_of).alias("tile"), "fp", "text")
    by = ["component", "tile"]
    return tiled.repartition(*by).sortWithinPartitions(*by).mapInArrow(released(run), "src long, dst long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 80, least: float = 0.8) -> DataFrame:
    """The row of ``docs`` that leads each class of near copies: one document of each group stays, with all its columns.

    Near copies share ``least`` of their distinct five-word shingles; classes
    are the connected components of such pairs. Those of 0.8 differ in 39 of
    256 bits with a deviation of 6, so a bound of 80 leaves none out that
    chance would show, and keeps texts with little in common (128, 8) apart.
    Pairs within it that share a key of their prefixes make candidates; links
    are the exact shares within them.

    The leader has the least id, then the least text hash; of rows that repeat
    both id and text one stays.
    """
    prints = materialize(shingle_prints(docs, least, id_col, text_col, shingle), "prints")
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")
    alike = [F.first(c).alias(c) for c in (*_names(WIDE), "size", "prefix")]
    distinct = materialize(prints.groupBy("fp").agg(F.min(row).alias("least"), *alike), "fingerprints")
    keys = F.transform("prefix", lambda h: F.struct(F.lit(0).alias("combination"), h.alias("block")))
    groups = connected_components(links(distinct, keys, _names(WIDE), max_bits))
    members = distinct.join(groups, distinct.fp == groups.node).select("fp", "size", "component", F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_hash"))
    texts = docs.select(F.col(id_col).cast("long").alias("_own"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_text_hash"))
    texts = texts.join(members, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))).select("component", "fp", "size", "text")
    found = exact_links(materialize(texts, "near-texts"), least, shingle)
    leaders = _named(distinct, found).select(F.col("leader.doc_id").alias("_id"), F.col("leader.text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_text_hash", F.xxhash64(text_col))
    kept = hashed.join(leaders, hashed[id_col].cast("long").eqNullSafe(leaders["_id"]) & (hashed["_text_hash"] == leaders["_hash"]), "left_semi")
    return kept.dropDuplicates([id_col, "_text_hash"]).drop("_text_hash")
