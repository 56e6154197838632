"""Blocking, similarity edges and tiers of candidate works.

Records with the same non-trivial title in a block have cosine one, so titles
are compared once each and members follow their title. A block whose titles
outgrow ``tile`` is dealt into pairs of chunks, each a matrix product of
bounded size. Clustering takes from a tile only which nodes hang together and
its groups' best loose link, so rows out are linear in nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.keys import counts_vector, norm, surname_key, trigram_buckets
from citeweave.operators.components import connected_components
from citeweave.sources.scratch import materialize

AUTO, HIGH, LOW = 0.95, 0.80, 0.65


def block(extracted: DataFrame, surname: str = "surname") -> DataFrame:
    """``extracted`` with block_key; a record without author is in the block of the empty key."""
    return extracted.withColumn("block_key", surname_key(F.col(surname)))


def title_nodes(blocked: DataFrame, ord_col: str = "ord", title: str = "title", year: str = "year") -> DataFrame:
    """(block_key, year, title, node): distinct titles of three characters or more; node is the least ord."""
    named = blocked.where(F.length(F.col(title)) >= 3)
    return named.groupBy("block_key", F.col(year).alias("year"), F.col(title).alias("title")).agg(F.min(ord_col).alias("node"))


def with_vectors(nodes: DataFrame, vector: str | None = None) -> DataFrame:
    """``nodes`` with v and len: the trigram counts of the title, or the given array column, and its norm."""
    filled = nodes.withColumn("v", counts_vector(trigram_buckets(F.col("title"))) if vector is None else F.col(vector).cast("array<double>"))
    return filled.withColumn("len", norm(F.col("v")))


def _tiles(nodes: DataFrame, keys: list[str], node: str, tile: int) -> DataFrame:
    """Nodes dealt to (keys, i, j): with up to ``tile`` nodes a block is one tile, larger ones are pairs of chunks."""
    sizes = nodes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks"))
    sized = nodes.join(sizes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, F.col(node).alias("n"), "v", "len", "chunks")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("n"), F.col("chunks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    return dealt.select(*keys, "n", "v", "len", "own", F.explode(met).alias("t")).select(*keys, "n", "v", "len", "own", "t.i", "t.j")


def _scores(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes in order, their chunks, cosine of each two)."""
    frame = frame.sort_values("n")
    v, size = np.stack(frame.v.to_numpy()), frame.len.to_numpy()
    return frame.n.to_numpy(), frame.own.to_numpy(), (v @ v.T) / (size[:, None] * size[None, :] + 1e-12)


def similar_pairs(nodes: DataFrame, keys: list[str], low: float = LOW, node: str = "node", tile: int = 1000) -> DataFrame:
    """(src, dst, score): all node pairs of a block with cosine of at least ``low``, src < dst. Null keys equal each other."""

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        n, own, score = _scores(frame)
        wanted = np.triu(score >= low, 1)
        if frame.i.iloc[0] != frame.j.iloc[0]:
            wanted &= own[:, None] != own[None, :]  # pairs within a chunk are its own tile's
        a, b = np.nonzero(wanted)
        return pd.DataFrame({"src": n[a], "dst": n[b], "score": score[a, b]})

    return _tiles(nodes, keys, node, tile).groupBy(*keys, "i", "j").applyInPandas(pairs, "src long, dst long, score double")


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index that each row reaches; every row is expanded once."""
    label = np.full(len(linked), -1)
    for k in range(len(linked)):
        if label[k] >= 0:
            continue
        frontier = np.array([k])
        while len(frontier):
            label[frontier] = k
            frontier = np.flatnonzero(linked[frontier].any(axis=0) & (label < 0))
    return label


def tile_links(nodes: DataFrame, keys: list[str], auto: float = AUTO, low: float = LOW, node: str = "node", tile: int = 1000) -> DataFrame:
    """(kind, src, dst, score): what clustering needs of a tile's pairs, at most three rows a node.

    Kinds auto and all tie every node to the least one it reaches in the tile
    by links of at least ``auto`` or ``low``; best is the highest link below
    ``auto`` of each such group.
    """

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        n, _, score = _scores(frame)
        parts = []
        for kind, least in (("auto", auto), ("all", low)):
            root = _roots(score >= least)
            moved = np.flatnonzero(root != np.arange(len(n)))
            parts.append(pd.DataFrame({"kind": kind, "src": n[root[moved]], "dst": n[moved], "score": 0.0}))
        loose = np.where(np.triu((score >= low) & (score < auto), 1), score, -1.0)
        mate = loose.argmax(axis=1)
        value = loose[np.arange(len(n)), mate]
        top = pd.DataFrame({"root": root, "src": n, "dst": n[mate], "score": value})
        top = top[top.score >= 0].sort_values(["root", "score", "src"], ascending=[True, False, True]).drop_duplicates("root")
        return pd.concat([*parts, top.assign(kind="best")[["kind", "src", "dst", "score"]]])

    return _tiles(nodes, keys, node, tile).groupBy(*keys, "i", "j").applyInPandas(links, "kind string, src long, dst long, score double")


def components_of(nodes: DataFrame, edges: DataFrame, name: str, node: str = "node") -> DataFrame:
    """``nodes`` with the least node each reaches through ``edges``; itself without edges."""
    linked = connected_components(edges).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return nodes.join(linked, nodes[node] == F.col("_n"), "left").withColumn(name, F.coalesce("_c", node)).drop("_n", "_c")


def cluster(blocked: DataFrame, auto: float = AUTO, high: float = HIGH, low: float = LOW, ord_col: str = "ord", vector: str | None = None) -> DataFrame:
    """``blocked`` with cluster_id, tier, max_sim, auto_id and member_rank.

    Records link within a block from ``low`` on and merge from ``auto`` on.
    tier is auto or singleton for a cluster of one merged group, else candidate
    if its best link below ``auto`` reaches ``high``, else borderline. Members
    rank by (least ord of their merged group, ord). Titles under three
    characters and missing ones are clusters of their own.
    """
    nodes = title_nodes(blocked, ord_col)
    if vector is not None:
        nodes = nodes.join(blocked.select(F.col(ord_col).alias("node"), vector), "node")
    links = materialize(tile_links(with_vectors(nodes, vector), ["block_key", "year"], auto, low), "links")
    named = components_of(components_of(nodes.select("block_key", "year", "title", "node"), links.where("kind = 'auto'"), "auto_id"), links.where("kind = 'all'"), "cluster_id")
    best = links.where("kind = 'best'").join(named.select(F.col("node").alias("src"), "cluster_id"), "src").groupBy("cluster_id").agg(F.max("score").alias("best"))
    groups = named.groupBy("cluster_id").agg(F.countDistinct("auto_id").alias("n_auto")).join(best, "cluster_id", "left")
    labelled = named.join(groups, "cluster_id")
    renamed = labelled.select(*[F.col(c).alias(f"_{c}") for c in ("block_key", "year", "title", "cluster_id", "auto_id", "n_auto")], "best")
    on = F.col("block_key").eqNullSafe(F.col("_block_key")) & F.col("year").eqNullSafe(F.col("_year")) & (F.col("title") == F.col("_title"))
    own = [F.coalesce(F.col(f"_{c}"), F.col(ord_col)).alias(c) for c in ("cluster_id", "auto_id")]
    joined = blocked.join(renamed, on, "left").select(*blocked.columns, *own, F.coalesce("_n_auto", F.lit(1)).alias("n_auto"), "best")
    sizes = joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    sized = joined.join(sizes, "cluster_id")
    tier = F.when(F.col("n_auto") == 1, F.when(F.col("cluster_size") > 1, "auto").otherwise("singleton")).otherwise(F.when(F.col("best") >= high, "candidate").otherwise("borderline"))
    sim = F.when(F.col("n_auto") == 1, F.when(F.col("cluster_size") > 1, 1.0).otherwise(0.0)).otherwise(F.col("best"))
    return sized.withColumn("tier", tier).withColumn("max_sim", sim).withColumn("member_rank", F.struct("auto_id", ord_col)).drop("best")
