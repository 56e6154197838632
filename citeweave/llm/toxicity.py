"""Toxicity by a weighted lexicon on folded text.

Texts are folded (case, width, accents, homoglyphs, digit and symbol
substitutions inside words) to words parted by single spaces. An Aho-Corasick
automaton finds lexicon entries, whole words or word beginnings, in one pass;
each word counts with its heaviest entry unless an exception phrase covers it.
The sum of weights, normalised by the number of words, goes through a logistic
curve. Weights and curve are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.batches import released, slices

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
# Digits and symbols that stand for letters within words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clown car", "rodeo clown", "sore loser board", "idiot light", "pond scum")

_LATIN = {c: unicodedata.normalize("NFKD", chr(c))[0] for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF21, 0xFF3B), range(0xFF41, 0xFF5B)) for c in r if unicodedata.normalize("NFKD", chr(c))[0].isalpha()}
_FOLD = {c: b.lower() for c, b in _LATIN.items()} | {ord(a): b for a, b in HOMOGLYPHS.items()} | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]) | dict.fromkeys(range(0x300, 0x370))
_SUBSTITUTED = re.compile(r"[^\W_]*(?:[0134570@$!|][^\W_]*)+")
_WORD = re.compile(r"[^\W\d_]+")
_TABLE = str.maketrans(SUBSTITUTES)


def _unmasked(match: re.Match) -> str:
    word = match[0].rstrip("!$|@")
    if not any(c.isalpha() for c in word):
        return match[0]
    return word.translate(_TABLE) + " "


def fold(text: str | None) -> list[str]:
    """Folded words of a whole text; null: none."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    if any(c in low for c in "013457@$!|"):
        low = _SUBSTITUTED.sub(_unmasked, low)
    return _WORD.findall(low)


@dataclass(frozen=True)
class Model:
    whole: dict[str, float]
    starts: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton:
        """Patterns carry their word boundaries; a value is (kind, length, weight)."""
        out = ahocorasick.Automaton()
        entries = [(f" {w} ", ("word", len(w), x)) for w, x in self.whole.items()] + [(f" {w}", ("start", len(w), x)) for w, x in self.starts.items()]
        # a masked l may have been folded to i
        entries += [(p.replace("l", "i"), v) for p, v in entries if "l" in p]
        for pattern, value in sorted(entries, key=lambda e: e[1][2]):
            out.add_word(pattern, value)
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", ("except", len(phrase), 0.0))
        out.make_automaton()
        return out


def measure(words: Sequence[str], automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
    """(sum of weights, words matched, words)."""
    if not words or not len(automaton):
        return 0.0, 0, len(words)
    line = f" {' '.join(words)} "
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (kind, size, weight) in automaton.iter(line):
        start = end - size + (kind == "start")
        if kind == "except":
            spared.append((start, start + size))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in spared)}
    return sum(best.values()), len(best), len(words)


def _features(measured: Sequence[tuple[float, int, int]]) -> np.ndarray:
    m = np.array(measured, float).reshape(-1, 3)
    n = np.maximum(m[:, 2], 1)
    return np.column_stack([np.ones(len(m)), 100 * m[:, 0] / (n + 20), np.log1p(m[:, 0]), np.log1p(m[:, 1]), np.log1p(n)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def learn(rows: Sequence[tuple[str | None, int]], prior: float, exceptions: tuple[str, ...] = EXCEPTIONS, support: int = 4, least: float = 1.5) -> Model:
    """Model of labelled texts; ``prior`` is the share of label 1 among all labelled rows.

    An entry needs ``support`` toxic texts and a log rate ratio of ``least``;
    a longer entry stays only if it weighs clearly more than its beginnings.
    Phrases in which entries turn out harmless join the given exceptions.
    Equal texts count once. Without both labels every score is the prior.
    """
    texts = [(" ".join(fold(t)), y) for t, y in dict(rows).items()]
    toxic, clean = [t for t, y in texts if y], [t for t, y in texts if not y]
    logit = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not toxic or not clean:
        return Model({}, {}, exceptions, (logit, 0.0, 0.0, 0.0, 0.0))

    def entries(text: str, wanted=None) -> Counter:
        """Counts of whole words and of word beginnings, which end in a star."""
        found: Counter = Counter()
        for w, n in Counter(text.split()).items():
            for key in (w, *(f"{w[:k]}*" for k in range(4, min(len(w), 11)))):
                if wanted is None or key in wanted:
                    found[key] += n
        return found

    def counted(part: list[str]) -> tuple[Counter, Counter]:
        docs, hits = Counter(), Counter()
        for text in part:
            own = entries(text, wanted)
            docs.update(own.keys())
            hits.update(own)
        return docs, hits

    wanted: set[str] | None = None
    wanted = {k for k, n in _document_counts(toxic, entries).items() if n >= support}
    docs, hits = counted(toxic)
    seen, base = counted(clean)
    n_toxic, n_clean = max(1, sum(t.count(" ") + 1 for t in toxic)), max(1, sum(t.count(" ") + 1 for t in clean))
    top: Counter = Counter()
    for word, n in hits.items():
        for k in range(4, min(len(word), 11)) if word[-1] != "*" else ():
            top[f"{word[:k]}*"] = max(top[f"{word[:k]}*"], n)
    weights: dict[str, float] = {}
    for key in wanted:
        if top[key] >= 0.8 * hits[key]:
            continue  # one word explains this beginning
        ratio = math.log((hits[key] + 0.5) / n_toxic) - math.log((base[key] + 0.5) / n_clean)
        expected = len(toxic) * (seen[key] + 0.5) / len(clean)
        if ratio >= least and (docs[key] - expected) / math.sqrt(expected + 1) >= 3:
            weights[key] = ratio
    kept: dict[str, float] = {}
    for key in sorted(weights, key=lambda k: (len(k.rstrip("*")), k)):
        shorter = max((kept.get(f"{key[:n]}*", 0.0) for n in range(4, len(key.rstrip("*")) + 1)), default=0.0)
        if weights[key] > shorter + (0.5 if shorter else 0.0):
            kept[key] = weights[key]
    model = Model({w: x for w, x in kept.items() if w[-1] != "*"}, {w[:-1]: x for w, x in kept.items() if w[-1] == "*"}, exceptions, (0.0,))
    model = Model(model.whole, model.starts, tuple(dict.fromkeys((*exceptions, *_harmless(model, toxic, clean, support)))), (0.0,))
    automaton = model.automaton()
    x = _features([measure(t.split(), automaton) for t, _ in texts])
    y = np.array([label for _, label in texts], float)
    curve = _logistic(x, y)
    curve[0] += logit - math.log(len(toxic) / len(clean))
    return Model(model.whole, model.starts, model.exceptions, tuple(curve.tolist()))


def _harmless(model: Model, toxic: list[str], clean: list[str], support: int) -> list[str]:
    """Two-word phrases with an entry that are in ``support`` clean texts and in no greater share of the toxic ones."""

    def heavy(word: str) -> bool:
        return word in model.whole or any(word[:k] in model.starts for k in range(4, min(len(word), 11)))

    def phrases(texts: list[str]) -> Counter:
        found: Counter = Counter()
        for text in texts:
            words = text.split()
            found.update({f"{a} {b}" for a, b in zip(words, words[1:]) if heavy(a) or heavy(b)})
        return found

    seen, bad = phrases(clean), phrases(toxic)
    return sorted(p for p, n in seen.items() if n >= support and bad[p] * len(clean) <= n * len(toxic))


def _document_counts(texts: list[str], entries) -> Counter:
    """In how many texts each entry is."""
    found: Counter = Counter()
    for text in texts:
        found.update(entries(text).keys())
    return found


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, weight, hits): score from 0 to 1 of every whole text; empty and null texts have no hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = model.automaton(), np.array(model.curve)
        for batch in batches:
            for part in slices(batch, "text"):
                measured = [measure(fold(t), automaton) for t in part.column("text").to_pylist()]
                p = 1 / (1 + np.exp(-np.clip(_features(measured) @ curve, -30, 30)))
                yield pa.record_batch([part.column("doc_id"), pa.array(p), pa.array([m[0] for m in measured], pa.float64()), pa.array([m[1] for m in measured], pa.int64())], names=["doc_id", "score", "weight", "hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, score double, weight double, hits long")


def held_out(column: str = "doc_id", mod: int = 4, rest: int = 2):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2500, clean_rows: int = 4000) -> Model:
    """Model from documents(doc_id, text) and labels(doc_id, toxic) of rows that are not held out.

    Fits on a sample of at most ``toxic_rows`` and ``clean_rows`` labelled ids,
    the first by a hash of the id, one text each (of a repeated id that of the
    least hash); the share of label 1 is that of all of them. Null texts are
    empty; without labels every score is the same.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = known.where("toxic > 0").orderBy(order).limit(toxic_rows).union(known.where("toxic <= 0").orderBy(order).limit(clean_rows))
    chosen = {r.doc_id: int(r.toxic > 0) for r in picked.collect()}  # at most toxic_rows + clean_rows ids
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row an id
    texts = sorted(((r.doc_id, r.text) for r in rows.toLocalIterator()))
    return learn([(t, chosen[i]) for i, t in texts], counts.get(1, 0) / max(1, sum(counts.values())))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits): one row for each document; a null id counts as not held out."""
    model = train(docs, labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns in order.

    A score at the threshold goes; null and empty texts score by the curve
    without hits; equal rows share their fate; an empty table gives no rows.
    """
    model, fields = train(docs, labels), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = model.automaton(), np.array(model.curve)
        for batch in batches:
            for part in slices(batch, "text"):
                measured = [measure(fold(t), automaton) for t in part.column("text").to_pylist()]
                p = 1 / (1 + np.exp(-np.clip(_features(measured) @ curve, -30, 30)))
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(released(run), fields)
