"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised once into pieces of at most ``capacity`` tokens. Pieces
of one length are interchangeable, so a solution is a table of bin patterns
with multiplicities over the histogram of lengths, which has at most
``capacity`` rows whatever the corpus holds. Islands evolve populations of
such solutions in Spark tasks; between epochs each sends its elite to the next.
The best solution becomes a table of (length, rank range) -> (sequence, offset),
and every piece finds its place by its rank among the pieces of its length.

Crossover injects whole well-filled bins of one parent, keeps the other
parent's bins as far as their documents are still free, removes the rest
as duplicates, and puts the displaced documents where they fit best, after
exchanges with documents of bins that they fill better.
"""

from __future__ import annotations

import json
import os
import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.batches import gather, released, slices, words
from citeweave.sources.scratch import materialize

Pattern = tuple[tuple[int, int], ...]
Solution = dict[Pattern, int]

#: Words whose ids a Python worker remembers before it starts anew.
REMEMBERED_WORDS = 200_000
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Trailing characters that are a token group of their own; none can begin a contraction or a special token.
PUNCTUATION = "".join(c for c in string.punctuation if c not in "'<|>")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bytes as byte-level vocabularies write them: printable ones as they are, the rest from U+0100 on.
BYTE_LETTERS = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


class _WordIds:
    """Token ids of white-space separated words.

    The vocabulary drops white space and never joins letters with punctuation,
    so a word of Latin letters and trailing punctuation is two lookups; each
    distinct part is tokenised once. Other words go to the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.values, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, part: str) -> list[int]:
        if LATIN.fullmatch(part) or not part.strip(PUNCTUATION):
            return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def lookup(self, distinct: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in order, number of ids of each)."""
        if len(self.at) > REMEMBERED_WORDS:
            self.clear()
        new: list[str] = []
        flat, size = [], []
        at = self.at
        for word in distinct:
            base = word.rstrip(PUNCTUATION)
            parts = (word,) if not base or not LATIN.fullmatch(base) else (base.lower(),) if len(base) == len(word) else (base.lower(), word[len(base) :])
            for part in parts:
                if part not in at:
                    at[part] = len(at)
                    new.append(part)
                flat.append(at[part])
            size.append(len(parts))
        if new:
            ids = [self._ids(part) for part in new]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            self.values = np.concatenate([self.values, np.fromiter((x for i in ids for x in i), np.uint32, int(count.sum()))])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(count)])
        by_word, own = gather(self.values, self.bounds, np.array(flat, np.int64))
        ends = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
        return gather(by_word, ends, codes)


_KNOWN: dict[str, _WordIds] = {}


def _word_ids(path: str) -> _WordIds:
    """The worker's own table, kept between its tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = _WordIds(path)
    return _KNOWN[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents cut into pieces of ``capacity`` tokens.

    A null or empty text is the end id alone. Only documents of more than
    ``capacity`` tokens have several pieces, of which only the last is shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                distinct, codes, offsets = words(part.column("text"))
                ids, count = known.lookup(distinct.to_pylist(), codes)
                ends = np.concatenate([[0], np.cumsum(count)])[offsets]
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for number, at in enumerate(range(0, len(whole), capacity)):
                        own = whole[at : at + capacity]
                        rows.append(row)
                        piece.append(number)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            kept.append(own)
                columns = {"doc_id": part.column("doc_id").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int64) for x in kept], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(bins: Solution, items: dict[int, int], capacity: int) -> Solution:
    """``bins`` with ``items`` (length -> count) added, longest first, each where it leaves the least room.

    Bins of equal pattern are filled together, so the work depends on the
    numbers of lengths and patterns only.
    """
    used = {p: sum(s * k for s, k in p) for p in bins}
    room: dict[int, Solution] = {}
    for p, n in bins.items():
        room.setdefault(capacity - used[p], {})[p] = n
    free = sorted(r for r in room if r)
    for size in sorted(items, reverse=True):
        need = items[size]
        while need > 0:
            at = bisect_left(free, size)
            if at == len(free):
                k = min(capacity // size, need)
                n, left, grown = need // k, capacity - k * size, ((size, k),)
            else:
                r = free[at]
                pattern, held = room[r].popitem()
                k = min(r // size, need)
                n, left = min(held, need // k), r - k * size
                if held > n:
                    room[r][pattern] = held - n
                if not room[r]:
                    del room[r], free[at]
                had = dict(pattern)
                had[size] = had.get(size, 0) + k
                grown = tuple(sorted(had.items(), reverse=True))
            if left not in room:
                room[left] = {}
                if left:
                    insort(free, left)
            room[left][grown] = room[left].get(grown, 0) + n
            need -= n * k
    out: Solution = {}
    for group in room.values():
        for p, n in group.items():
            out[p] = out.get(p, 0) + n
    return out


def _fitness(bins: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller bins (mean squared fill) first."""
    n = sum(bins.values())
    return n, -sum(m * (sum(s * k for s, k in p) / capacity) ** 2 for p, m in bins.items()) / max(n, 1)


def _take(order: list[tuple[Pattern, int]], left: dict[int, int]) -> Solution:
    """Whole bins in that order, as many of each as the free items allow; ``left`` loses their items."""
    taken: Solution = {}
    for pattern, m in order:
        n = min([m, *(left.get(s, 0) // k for s, k in pattern)])
        if n > 0:
            taken[pattern] = taken.get(pattern, 0) + n
            for s, k in pattern:
                left[s] -= n * k
    return taken


def _within(pattern: Pattern, rng: random.Random, most: int = 8) -> list[tuple[int, ...]]:
    """Distinct lengths and pairs of lengths of a bin, of ``most`` lengths at random if it has more."""
    some = pattern if len(pattern) <= most else rng.sample(pattern, most)
    flat = [s for s, k in some for _ in range(min(k, 2))]
    return sorted({c for n in (1, 2) for c in combinations(flat, n)})


def _fuller(loose: dict[int, int], more: int, at_most: int) -> tuple[int, ...] | None:
    """One or two loose lengths whose sum is the largest from ``more`` + 1 to ``at_most``; one rather than two."""
    sizes = sorted(loose)
    at = bisect_right(sizes, at_most) - 1
    best = (sizes[at],) if at >= 0 and sizes[at] > more else None
    for one in sizes:
        if 2 * one > at_most:
            break
        k = bisect_right(sizes, at_most - one) - 1
        if k >= 0 and sizes[k] == one and loose[one] < 2:
            k -= 1
        if k >= 0 and sizes[k] >= one and one + sizes[k] > max(more, sum(best) if best else 0):
            best = (sizes[k], one)
    return best


def exchange(bins: Solution, loose: dict[int, int], capacity: int, rng: random.Random, tries: int = 200) -> Solution:
    """Best fit of ``loose`` into ``bins`` after exchanges: up to two documents of a bin give way to one or two loose ones that fill it better.

    At most ``tries`` bins are looked at, chosen at random, fewer the more
    lengths are loose; what gave way is loose again and smaller, so it fits
    elsewhere more easily.
    """
    bins, loose = dict(bins), dict(loose)
    room = [p for p in bins if sum(s * k for s, k in p) < capacity]
    for _ in range(max(10, min(tries, 20_000 // (len(loose) + 1))) if room else 0):
        if not loose:
            break
        pattern = room[rng.randrange(len(room))]
        if pattern not in bins:
            continue
        used, best = sum(s * k for s, k in pattern), None
        for out in _within(pattern, rng):
            into = _fuller(loose, sum(out), capacity - used + sum(out))
            if into and (best is None or sum(into) - sum(out) > best[0]):
                best = (sum(into) - sum(out), out, into)
        if best is None:
            continue
        kept = Counter({s: k for s, k in pattern})
        kept.subtract(best[1])
        kept.update(best[2])
        bins[pattern] -= 1
        if not bins[pattern]:
            del bins[pattern]
        grown = tuple(sorted(((s, k) for s, k in kept.items() if k), reverse=True))
        if grown not in bins and sum(s * k for s, k in grown) < capacity:
            room.append(grown)
        bins[grown] = bins.get(grown, 0) + 1
        for size in best[2]:
            loose[size] -= 1
            if not loose[size]:
                del loose[size]
        for size in best[1]:
            loose[size] = loose.get(size, 0) + 1
    return best_fit(bins, loose, capacity)


def crossover(one: Solution, other: Solution, items: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Child of two solutions: injected well-filled bins of ``one``, what fits of ``other``, the rest by exchanges and best fit."""
    left = dict(items)
    full = sorted(one.items(), key=lambda x: -sum(s * k for s, k in x[0]))
    chosen = [(p, rng.randint((m + 1) // 2, m)) for p, m in full[: max(1, len(full) // 2)] if rng.random() < 0.7]
    child = _take(chosen, left)
    for p, n in _take(sorted(other.items(), key=lambda x: -sum(s * k for s, k in x[0])), left).items():
        child[p] = child.get(p, 0) + n
    return exchange(child, {s: n for s, n in left.items() if n}, capacity, rng)


def mutate(bins: Solution, capacity: int, rng: random.Random, share: float = 0.1) -> Solution:
    """Empty one of the least filled bins and some at random; their documents go where they fit best, after exchanges."""
    kept, loose = {}, {}
    order = sorted(bins.items(), key=lambda x: sum(s * k for s, k in x[0]))
    worst = {p for p, _ in order[: max(1, int(len(bins) * share))]}
    for p, m in bins.items():
        n = (1 if rng.random() < 0.5 else m) if p in worst or rng.random() < share / 2 else 0
        for s, k in p:
            if n:
                loose[s] = loose.get(s, 0) + n * k
        if m > n:
            kept[p] = m - n
    return exchange(kept, loose, capacity, rng)


def _founder(items: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Best fit after exact pairs of randomly chosen lengths."""
    left, bins = dict(items), {}
    for size in rng.sample(sorted(left), len(left)):
        mate = capacity - size
        n = left[size] // 2 if mate == size else min(left[size], left.get(mate, 0))
        if n > 0 and rng.random() < 0.5:
            n = rng.randint(1, n)
            pattern = ((size, 2),) if mate == size else ((max(size, mate), 1), (min(size, mate), 1))
            bins[pattern] = bins.get(pattern, 0) + n
            left[size] -= n
            left[mate] -= n if mate != size else n
    return best_fit(bins, {s: n for s, n in left.items() if n}, capacity)


def lower_bound(items: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: total length, and for each least length the bins that only longer ones can share."""
    top = max([capacity, *items])
    count = np.zeros(top + 1, np.int64)
    for s, n in items.items():
        count[s] = n
    number, total = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count * np.arange(top + 1)))  # of sizes below each
    half = capacity // 2 + 1
    least = np.array(sorted({s for s in items if 2 * s <= capacity} | {0}))
    shared = capacity - least + 1  # longer ones stand alone
    room = capacity * (number[shared] - number[half]) - (total[shared] - total[half])
    more = np.maximum(0, -(-(total[half] - total[least] - room) // capacity))
    return max(-(-int(total[-1]) // capacity), int(number[-1] - number[half] + more.max()))


def evolve(items: dict[int, int], capacity: int, seed: int, migrants: list[Solution], population: int = 8, generations: int = 12, patience: int = 4) -> Solution:
    """The elite of one island after some generations, at the lower bound, or when ``patience`` of them save no bin.

    Deterministic in its arguments.
    """
    rng, bound = random.Random(seed), lower_bound(items, capacity)
    people = [best_fit({}, items, capacity), *migrants]
    while len(people) < population and _fitness(people[0], capacity)[0] > bound:
        people.append(mutate(_founder(items, capacity, rng), capacity, rng))
    people.sort(key=lambda x: _fitness(x, capacity))
    least, since = _fitness(people[0], capacity)[0], 0
    for _ in range(generations):
        if least <= bound or since == patience:
            break
        children = []
        for _ in range(population):
            a, b = (min(rng.sample(people, 2), key=lambda x: _fitness(x, capacity)) for _ in range(2))
            child = crossover(a, b, items, capacity, rng)
            children.append(mutate(child, capacity, rng) if rng.random() < 0.5 else child)
        people = sorted([*people, *children], key=lambda x: _fitness(x, capacity))[:population]
        now = _fitness(people[0], capacity)[0]
        least, since = now, 0 if now < least else since + 1
    return people[0]


def _packed(bins: Solution) -> str:
    return json.dumps(sorted([p, m] for p, m in bins.items()))


def _unpacked(text: str) -> Solution:
    return {tuple((s, k) for s, k in p): m for p, m in json.loads(text)}


def solve(spark: SparkSession, items: dict[int, int], capacity: int = 2048, islands: int = 6, epochs: int = 3, seed: int = 7) -> Solution:
    """Best solution of all islands. After each epoch every elite also joins the next island of the ring."""
    if not items:
        return {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"island": frame.island, "elite": [_packed(evolve(items, capacity, seed * 1000 + int(s), [_unpacked(x) for x in m])) for s, m in zip(frame.seed, frame.migrants)]})

    elites: list[str] = []
    bound = lower_bound(items, capacity)
    for epoch in range(epochs):
        rows = [(i, epoch * islands + i, [elites[i], elites[i - 1]] if elites else []) for i in range(islands)]
        frame = spark.createDataFrame(rows, "island int, seed int, migrants array<string>").repartition(islands, "island")
        elites = [r.elite for r in sorted(frame.mapInPandas(run, "island int, elite string").collect())]
        if min(sum(_unpacked(x).values()) for x in elites) <= bound:
            break
    return min(map(_unpacked, elites), key=lambda x: (_fitness(x, capacity), _packed(x)))


def layout(bins: Solution) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, each, sequence, offset): pieces of that length with low <= rank < high.

    The piece of rank r is in sequence + (r - low) // each, at
    offset + (r - low) % each * length.
    """
    rows, next_rank, sequence = [], {}, 0
    for pattern, m in sorted(bins.items(), reverse=True):
        at = 0
        for size, k in pattern:
            low = next_rank.get(size, 0)
            next_rank[size] = low + m * k
            rows.append((size, low, low + m * k, k, sequence, at))
            at += size * k
        sequence += m
    return rows


def pack(pieces: DataFrame, capacity: int = 2048, islands: int = 6, epochs: int = 3, bucket_rows: int = 20_000) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must be a materialised table.

    Sequences hold at most ``capacity`` tokens, without gaps. Rows that repeat
    (same id, piece and checksum) are all placed. Ranks come from buckets of
    about ``bucket_rows`` rows, so a length that many pieces share is spread.
    """
    spark = pieces.sparkSession
    items = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = layout(solve(spark, items, capacity, islands, epochs))
    buckets = max(1, -(-sum(items.values()) // bucket_rows))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_own", own).join(ahead, ["length", "_bucket"]).withColumn("_rank", F.col("_own") + F.col("_ahead"))
    # at most 63 lengths a pattern and two patterns a length: bounded by the capacity alone
    table = F.broadcast(spark.createDataFrame(places, "_size int, _low long, _high long, _each int, _sequence long, _at long"))
    put = ranked.join(table, (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    within = F.col("_rank") - F.col("_low")
    return put.select(*pieces.columns, (F.col("_sequence") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_at") + within % F.col("_each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset); no documents, no rows."""
    return pack(materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)
