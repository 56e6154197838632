"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The benchmark is the query set, taken in blocks of bounded bytes; the corpus is
never shuffled. Every n-gram of an item is a seed: which of them an edited copy
keeps cannot be told from how rare they are, and seeds on the rarest alone lost
edited copies. One pass finds seeds in every whole document and aligns each
(document, item, diagonal) they point at, unless the words in common bound the
score below the threshold. A copy without ``n`` words of the item in a row has
no seed; an item of fewer words than that is found where it is a document's
whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.batches import gather, released, slices, words

WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Longer items count as leaked once this many of their words align.
FULL_WORDS = 50
#: Seed hits that are turned into candidates at once.
HITS = 1 << 20
SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"


def word_list(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


class Items:
    """Benchmark items as word numbers; n-grams as exact integer keys over them."""

    def __init__(self, rows: list[tuple[int, str]], n: int) -> None:
        listed = [word_list(t) for _, t in rows]
        self.n = n
        self.ids = [i for (i, _), w in zip(rows, listed) if len(w) >= n]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for (i, _), w in zip(rows, listed):
            if 0 < len(w) < n and i not in self.short.setdefault(tuple(w), []):
                self.short[tuple(w)].append(i)
        self.number = {w: k for k, w in enumerate(sorted({w for ws in listed for w in ws}))}
        self.base = len(self.number) + 1
        if self.base**n >= 1 << 63:
            raise ValueError("a block of the benchmark has too many distinct words for exact keys")
        self.words = [np.array([self.number[w] for w in ws], np.int64) for ws in listed if len(ws) >= n]
        grams = [self.grams(w) for w in self.words]
        self.keys = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        self.at = [np.searchsorted(self.keys, g) for g in grams]

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """Keys of the n-grams starting at each word, -1 where a word is no benchmark word."""
        if len(numbers) < self.n:
            return np.zeros(0, np.int64)
        parts = [numbers[k : len(numbers) - self.n + 1 + k] for k in range(self.n)]
        key = sum(p * self.base**k for k, p in enumerate(parts))
        return np.where(np.min(parts, axis=0) >= 0, key, -1)

    def corpus(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, row of each word, gram of each word or -1, row bounds) of a slice of texts."""
        distinct, codes, offsets = words(text)
        split = [WORD.findall(w.lower()) for w in distinct.to_pylist()]
        size = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((self.number.get(w, -1) for ws in split for w in ws), np.int64, int(size.sum()))
        numbers, count = gather(flat, np.concatenate([[0], np.cumsum(size)]), codes)
        bounds = np.concatenate([[0], np.cumsum(count)])[offsets]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        gram = np.full(len(numbers), -1, np.int64)
        if len(self.keys) and len(numbers) >= self.n:
            key = self.grams(numbers)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (key >= 0) & (self.keys[at] == key) & (row[: len(key)] == row[self.n - 1 :])
            gram[: len(key)] = np.where(ok, at, -1)
        return numbers, row, gram, bounds

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, item, position) of every n-gram, by gram."""
        size = np.fromiter(map(len, self.at), np.int64, len(self.at))
        if not len(size):
            return (np.zeros(0, np.int64),) * 3
        table = np.column_stack([np.concatenate(self.at), np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(k) for k in size])])
        table = table[np.lexsort(table.T[::-1])]
        return table[:, 0], table[:, 1], table[:, 2]


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of row k of ``items`` against row k of ``passages``: (best score, start, end) in the passage.

    Rows are padded with -1 (items) and -2 (passages) beyond their words; word
    -1 of a passage is one outside the benchmark. No padding ever matches.
    """
    n, wide = passages.shape
    ramp = np.arange(wide + 1) * -GAP
    above = np.zeros((n, wide + 1), np.int32)
    origin = np.tile(np.arange(wide + 1, dtype=np.int32), (n, 1))
    best, start, end = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    every = np.arange(n)[:, None]
    for k in range(items.shape[1]):
        same = (passages == items[:, k : k + 1]) & (items[:, k : k + 1] >= 0)
        step = above[:, :-1] + np.where(same, MATCH, MISMATCH)
        drop = above[:, 1:] + GAP
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(np.maximum(step, drop), 0)
        source = np.tile(np.arange(wide + 1, dtype=np.int32), (n, 1))
        source[:, 1:] = np.where(here[:, 1:] == 0, source[:, 1:], np.where(step >= drop, origin[:, :-1], origin[:, 1:]))
        lifted = here + ramp
        run = np.maximum.accumulate(lifted, axis=1)
        back = np.maximum.accumulate(np.where(lifted == run, np.arange(wide + 1), 0), axis=1)
        above = (run - ramp).astype(np.int32)
        origin = source[every, back]
        top = above.argmax(axis=1)
        value = above[every[:, 0], top]
        better = value > best
        best = np.where(better, value, best)
        start, end = np.where(better, origin[every[:, 0], top], start), np.where(better, top, end)
    return best, start, end


def common(items: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """At least as many words as any alignment of row k of ``items`` and row k of ``passages``, padded as for align, can match."""
    row = np.arange(len(items))[:, None] * (int(max(items.max(), passages.max())) + 1)
    own, other = np.where(items < 0, -1, items + row), np.where(passages < 0, -2, passages + row)
    return np.minimum(np.isin(own, other).sum(axis=1), np.isin(other, own).sum(axis=1))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for k in range(parts):
        yield sorted(((r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # about block_bytes


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = 3, slack: int = 8, full_words: int = FULL_WORDS, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents that hold an item or an edited copy of one.

    score is the best alignment score over the most that the item's words, or
    ``full_words`` of them, can reach; rows from ``threshold`` on are returned,
    one for each document row and item, with the aligned words' positions (of
    tied alignments the first). An item of fewer than ``n`` words matches where
    a document's words are the item's. Null texts and items without words match
    nothing; repeated documents and items each have rows; empty tables give none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for k, block in enumerate(_blocks(benchmark, item_id_col, item_text_col, block_bytes)):
        items = Items(block, n)
        part = own.mapInArrow(released(_finder(items, items.seeds(), threshold, slack, full_words)), SCHEMA)
        found = part if k == 0 else found.unionByName(part)
    return found


def _finder(items: Items, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float, slack: int, full_words: int):
    gram_of, item_of, place_of = seeds
    lengths = np.array([len(w) for w in items.words], np.int64)
    most = MATCH * np.minimum(lengths, full_words)

    def candidates(row: np.ndarray, gram: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Distinct (row, item, diagonal) in parts of at most ``HITS`` hits, diagonals within ``slack`` of the first as one."""
        at = np.flatnonzero(gram >= 0)
        low, high = np.searchsorted(gram_of, gram[at]), np.searchsorted(gram_of, gram[at], side="right")
        ends = np.cumsum(high - low)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, HITS):
            number = np.arange(begin, min(begin + HITS, int(ends[-1])))
            seed = np.searchsorted(ends, number, side="right")
            where, hit = at[seed], high[seed] - (ends[seed] - number)
            yield merged(where, hit, row, bounds)

    def merged(where: np.ndarray, hit: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        diagonal = where - bounds[row[where]] - place_of[hit]
        rows = np.unique(np.column_stack([row[where], item_of[hit], diagonal]), axis=0)
        if len(rows) < 2:
            return rows
        fresh = np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])
        new, first = np.zeros(len(rows), bool), 0
        for k, (other, diagonal) in enumerate(zip(fresh.tolist(), rows[:, 2].tolist())):
            if other or diagonal > first + slack:
                new[k], first = True, diagonal
        return rows[new]

    def aligned(pairs: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, best: dict[tuple[int, int], tuple[float, int, int]]) -> None:
        """Raises ``best`` of (row, item) to the alignments at these candidates."""
        order = np.argsort(lengths[pairs[:, 1]], kind="stable")
        for k in range(0, len(order), 512):
            some = pairs[order[k : k + 512]]
            size = lengths[some[:, 1]]
            item = np.full((len(some), int(size.max())), -1, np.int64)
            passage = np.full((len(some), int(size.max()) + 4 * slack), -2, np.int64)
            first = np.maximum(some[:, 2] - slack, 0)
            for j, (r, i, _) in enumerate(some.tolist()):
                item[j, : lengths[i]] = items.words[i]
                a = int(bounds[r] + first[j])
                text = numbers[a : min(a + lengths[i] + 4 * slack, int(bounds[r + 1]))]
                passage[j, : len(text)] = np.where(text < 0, -2, text)
            able = np.flatnonzero(MATCH * common(item, passage) >= threshold * most[some[:, 1]])
            if not len(able):
                continue
            some, first, item, passage = some[able], first[able], item[able], passage[able]
            value, start, end = align(item, passage)
            share = value / most[some[:, 1]]
            for j in np.flatnonzero(share >= threshold).tolist():
                key = (int(some[j, 0]), int(some[j, 1]))
                new = (min(1.0, float(share[j])), int(first[j] + start[j]), int(first[j] + end[j]) - 1)
                if key not in best or (new[0], -new[1]) > (best[key][0], -best[key][1]):
                    best[key] = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                numbers, row, gram, bounds = items.corpus(part.column("text"))
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for pairs in candidates(row, gram, bounds):
                    aligned(pairs, numbers, bounds, best)
                found = [(r, items.ids[i], *best[r, i]) for r, i in sorted(best)]
                if items.short:
                    for r in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < items.n)).tolist():
                        own = tuple(word_list(part.column("text")[r].as_py()))
                        found += [(r, i, 1.0, 0, len(own) - 1) for i in items.short.get(own, ())]
                columns = list(zip(*found)) or [()] * 5
                yield pa.record_batch([part.column("doc_id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64()))]], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` without a benchmark item; rows that share an id with a contaminated one go too, null ids stay."""
    from citeweave.sources.scratch import materialize

    hits = materialize(contaminated(docs, benchmark, id_col=id_col, **how).select("doc_id").distinct(), "contaminated")
    return docs.join(hits.withColumnRenamed("doc_id", "_hit"), docs[id_col] == F.col("_hit"), "left_anti")
