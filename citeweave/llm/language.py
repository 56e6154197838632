"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a run of letters is the sum over all its segmentations into
pieces, found by the forward algorithm; a text's is the product over its runs.
Piece probabilities come from expectation maximisation over the same lattice.

The lattice of a list of runs is a flat table of edges (from, to, piece), found
by walking all runs down the vocabulary's trie at once: pieces and runs may be
of any length. Sums are of logarithms, so no run underflows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.batches import released, slices, words
from citeweave.sources.scratch import materialize

#: Sample rows (two longs each) up to which their table is broadcast.
BROADCAST_ROWS = 200_000
#: Letter runs whose scores a task remembers before it starts anew.
REMEMBERED_RUNS = 250_000
#: Letters of a lattice built at once; a longer single run is a lattice of its own.
LATTICE_LETTERS = 400_000
LETTERS = regex.compile(r"\p{L}+")


def letter_runs(word: str) -> list[str]:
    """Runs of letters of a lower-cased word; digits, numerals and marks part them."""
    return LETTERS.findall(word)


def vocabulary(model_path: str) -> list[str]:
    """All distinct lower-cased pieces of letters, and all their single letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    pieces = {p for p in pieces if LETTERS.fullmatch(p)}
    return sorted(pieces | {c for p in pieces for c in p})


class Lattice:
    """Edges of every span of a run that is a piece; number 0 stands for a letter outside the vocabulary."""

    def __init__(self, pieces: list[str]) -> None:
        alphabet = sorted({c for p in pieces for c in p})
        self.size = len(pieces) + 1
        self.base = len(alphabet) + 2
        self.code = np.full(0x110000, 1, np.int64)
        self.code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        number = {p: i + 1 for i, p in enumerate(pieces)}
        # one level a length: sorted keys (node of the level above, letter) and the piece that ends there, -1 for none
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = {"": 0}
        for n in range(1, max(map(len, pieces), default=0) + 1):
            keyed = sorted((above[p[:-1]] * self.base + int(self.code[ord(p[-1])]), p) for p in {p[:n] for p in pieces if len(p) >= n})
            above = {p: k for k, (_, p) in enumerate(keyed)}
            self.levels.append((np.array([k for k, _ in keyed], np.int64), np.array([number.get(p, -1) for _, p in keyed], np.int64)))

    def edges(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece, place of from in its run, ends): a run of n letters has n + 1 nodes in a row, the last one in ends."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        code = self.code[np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)]
        stop = np.cumsum(size)
        row = np.repeat(np.arange(len(runs)), size)
        first = (stop - size)[row]
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        starts, lengths, numbers = [], [], []
        for n, (keys, piece) in enumerate(self.levels or [(np.zeros(1, np.int64) - 1, np.zeros(1, np.int64) - 1)], 1):
            inside = at + n <= stop[row[at]]
            at, node = at[inside], node[inside]
            key = node * self.base + code[at + n - 1]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[place] == key
            if n == 1:
                starts.append(at[~known])
                lengths.append(np.ones(len(starts[0]), np.int64))
                numbers.append(np.zeros(len(starts[0]), np.int64))
            at, node = at[known], place[known]
            whole = piece[node] >= 0
            starts.append(at[whole])
            lengths.append(np.full(int(whole.sum()), n))
            numbers.append(piece[node[whole]])
            if not len(at):
                break
        start, length, number = map(np.concatenate, (starts, lengths, numbers))
        begin = start + row[start]
        return begin, begin + length, number, start - first[start], stop + np.arange(len(runs))

    @staticmethod
    def _sums(nodes: int, into: np.ndarray, out_of: np.ndarray, steps: np.ndarray, turn: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """log sums[node, language]: ``into`` gets what ``out_of`` has plus the step, all edges of one turn at once."""
        sums = np.full((nodes, steps.shape[1]), -np.inf)
        sums[seeds] = 0.0
        order = np.lexsort((into, turn))
        into, out_of, steps, turn = into[order], out_of[order], steps[order], turn[order]
        fresh = np.concatenate([[True], into[1:] != into[:-1]]) if len(into) else np.zeros(0, bool)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1, [len(turn)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b:
                groups = np.flatnonzero(fresh[a:b])
                sums[into[a:b][groups]] = np.logaddexp.reduceat(sums[out_of[a:b]] + steps[a:b], groups, axis=0)
        return sums

    def _forward(self, edges: tuple[np.ndarray, ...], log: np.ndarray) -> np.ndarray:
        begin, end, number, place, last = edges
        return self._sums(int(last[-1]) + 1, end, begin, log[number], place + end - begin, np.concatenate([[0], last[:-1] + 1]))

    def _parts(self, runs: list[str]) -> Iterator[np.ndarray]:
        """Places of runs in lattices of about ``LATTICE_LETTERS`` letters, short runs first."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        order = np.argsort(size, kind="stable")
        part = (np.cumsum(size[order]) - size[order]) // LATTICE_LETTERS
        yield from np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else ()

    def log_chance(self, runs: list[str], chance: np.ndarray) -> np.ndarray:
        """log probability[run, language], summed over all segmentations."""
        out, log = np.zeros((len(runs), chance.shape[1])), _log(chance)
        for part in self._parts(runs):
            edges = self.edges([runs[i] for i in part])
            out[part] = self._forward(edges, log)[edges[-1]]
        return out

    def lattices(self, counts: dict[str, int]) -> list[tuple[tuple[np.ndarray, ...], np.ndarray]]:
        """(edges, counts) of runs, for ``expected``."""
        runs = sorted(counts, key=lambda r: (len(r), r))
        return [(self.edges([runs[i] for i in part]), np.array([counts[runs[i]] for i in part], float)) for part in self._parts(runs)]

    def expected(self, counts: dict[str, int] | list, chance: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language's runs (or their ``lattices``) under ``chance`` (pieces + 1 rows or more, 1)."""
        total, log = np.zeros(self.size), _log(chance)
        for edges, weight in self.lattices(counts) if isinstance(counts, dict) else counts:
            begin, end, number, place, last = edges
            alpha = self._forward(edges, log)
            beta = self._sums(len(alpha), begin, end, log[number], -place, last)
            run = np.searchsorted(last, begin)
            share = np.exp(alpha[begin, 0] + log[number, 0] + beta[end, 0] - alpha[last[run], 0])
            total += np.bincount(number, share * weight[run], self.size)
        return total


def _log(chance: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(chance)


def _with_zero(chance: np.ndarray) -> np.ndarray:
    """A last row of zeros, for no piece."""
    return np.concatenate([chance, np.zeros((1, chance.shape[1]))])


def fit(samples: dict[str, Counter], pieces: list[str], rounds: int = 4, smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, chance): maximum-likelihood pieces of each language, smoothed by ``smooth`` counts a piece."""
    lattice, langs = Lattice(pieces), sorted(samples)
    out = []
    for lang in langs:
        chance, own = np.full((lattice.size, 1), 1 / lattice.size), lattice.lattices(samples[lang])
        for _ in range(rounds if samples[lang] else 0):
            found = lattice.expected(own, chance) + smooth
            chance = (found / found.sum())[:, None]
        out.append(chance)
    return langs, _with_zero(np.concatenate(out, axis=1)) if langs else np.zeros((lattice.size + 1, 0))


def sample_counts(docs: DataFrame, per_language: int) -> dict[str, Counter]:
    """Letter runs of at most ``per_language`` rows of each language, counted by the executors.

    Rows are chosen by strata of the id's hash, in each the least (id, text
    hash); rows that repeat language, id and text count once.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "doc_id", "text", F.xxhash64("text").alias("_h"))
    stratum = F.pmod(F.xxhash64("doc_id"), F.lit(per_language)).cast("int")
    least = known.groupBy("lang", stratum.alias("_s")).agg(F.min(F.struct("doc_id", "_h")).alias("_m"))
    chosen = materialize(least.select("lang", F.col("_m.doc_id").alias("doc_id"), F.col("_m._h").alias("_h")), "language-sample")
    # at most per_language rows a language; beyond the checked size the join shuffles
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    rows = known.join(chosen, ["lang", "doc_id", "_h"], "left_semi").dropDuplicates(["lang", "doc_id", "_h"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = Counter((lang, r) for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()) for w in text.lower().split() for r in letter_runs(w))
                yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "run", "n"])

    counted = rows.mapInArrow(released(run), "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = {r.lang: Counter() for r in chosen.select("lang").distinct().collect()}  # one row a language
    for row in counted.toLocalIterator():  # the distinct runs of the bounded sample
        out[row.lang][row.run] = row.n
    return out


def predict(docs: DataFrame, langs: list[str], chance: np.ndarray, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its share of all; ``und`` and 0 without letters or languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        known: dict[str, int] = {}
        by_run = np.zeros((0, len(langs)))
        for batch in batches:
            for part in slices(batch, "text"):
                distinct, codes, offsets = words(pc.utf8_lower(pc.fill_null(part.column("text"), "")))
                runs = [letter_runs(w) for w in distinct.to_pylist()]
                if len(known) > REMEMBERED_RUNS:
                    known, by_run = {}, by_run[:0]
                new = [r for r in dict.fromkeys(r for rs in runs for r in rs) if r not in known]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                if new:
                    by_run = np.concatenate([by_run, lattice.log_chance(new, chance) if langs else np.zeros((len(new), 0))])
                size = np.fromiter(map(len, runs), np.int64, len(runs))
                flat = np.fromiter((known[r] for rs in runs for r in rs), np.int64, int(size.sum()))
                by_word = _sums(by_run[flat], np.concatenate([[0], np.cumsum(size)]))
                total = _sums(by_word[codes], offsets)
                lettered = _sums(size[codes][:, None].astype(float), offsets)[:, 0] > 0
                if langs:
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                else:
                    best, share, lettered = np.zeros(len(offsets) - 1, int), np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, bool)
                name = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
                yield pa.record_batch([part.column("doc_id"), pa.array(name, pa.string()), pa.array(np.where(lettered, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, lang_pred string, score double")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row sums of ``values`` between bounds; empty ranges are zero."""
    ends = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return ends[bounds[1:]] - ends[bounds[:-1]]


def identify(docs: DataFrame, vocabulary_path: str, held_out_mod: int = 5, per_language: int = 512) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents(doc_id, text, lang).

    Learns from text and lang of at most ``per_language`` rows of each language
    whose crc32(doc_id as text) is not a multiple of ``held_out_mod``. A null
    id counts as not held out and is never learned from. An empty table gives
    no rows; without any lang every row is ``und``.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_mod == 0, F.lit(False))
    samples = sample_counts(own.where(~held & F.col("doc_id").isNotNull()), per_language)
    pieces = vocabulary(vocabulary_path)
    langs, chance = fit(samples, pieces)
    return predict(own, langs, chance, pieces).select("doc_id", held.alias("held_out"), "lang_pred", "score")
