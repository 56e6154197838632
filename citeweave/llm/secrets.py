"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. Only
(blob, rule version) pairs that the ledger lacks are scanned, each blob once
however many paths and versions hold it; findings join back to all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.arrays import salted
from citeweave.llm.batches import released, slices
from citeweave.sources.scratch import discard, materialize

#: (path, blob) pairs, about 100 bytes each, up to which a table of them is broadcast.
BROADCAST_PAIRS = 200_000

RULES_VERSION = "2"
BASE_KINDS = ("assign", "access", "hex")
LEDGER_SCHEMA = "blob string, rules_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Rules beyond the base ones, each with a literal that must occur for it to match.
EXTRA = (
    ("pem", "-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,20000}(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("forge", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("url", "://", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/@]{8,100}@[^\s/]+")),
)
_HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else b if b != 120 else 0 for b in range(256))


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of one whole text, by start and kind; null: none.

    Base matches are leftmost and non-overlapping within a kind; one that is
    too short is dropped without a retry.
    """
    if not text:
        return []
    found: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    for kind, literal, rule in EXTRA:
        if literal in text:
            found += [(m.start(), kind, m.end()) for m in rule.finditer(text)]
    kinds = [*BASE_KINDS, *(k for k, _, _ in EXTRA)]
    return sorted(found, key=lambda x: (x[0], kinds.index(x[1])))


def address(history: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, blob, text) of every version; a null text is the empty blob, a null path a path like any other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return history.select(F.col(path_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_unseen(addressed: DataFrame, ledger: DataFrame | None = None, rules_version: str = RULES_VERSION) -> DataFrame:
    """New ledger rows: one for each blob that ``ledger`` has not under ``rules_version``.

    Which (path, blob) pairs to scan is settled on pairs alone: the least path
    stands for a blob. Texts then meet either the pairs to scan or the pairs to
    leave, whichever are few enough to broadcast, and are shuffled only if both
    are many. Rows that repeat path and blob give one ledger row.
    """
    pairs = materialize(addressed.select("path", "blob"), "blob-pairs")
    firsts = pairs.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        firsts = firsts.join(ledger.where(F.col("rules_version") == rules_version).select("blob").distinct(), "blob", "left_anti")
    todo = materialize(firsts.select(F.col("blob").alias("_blob"), F.col("path").alias("_path")), "blob-todo")
    same = lambda t: F.col("path").eqNullSafe(t["_path"]) & (F.col("blob") == t["_blob"])
    others = materialize(pairs.join(todo, same(todo), "left_anti").select(F.col("path").alias("_path"), F.col("blob").alias("_blob")).distinct(), "blob-rest")
    if todo.count() <= BROADCAST_PAIRS:
        unseen = addressed.join(F.broadcast(todo), same(todo), "left_semi")
    elif others.count() <= BROADCAST_PAIRS:
        unseen = addressed.join(F.broadcast(others), same(others), "left_anti")
    else:
        unseen = addressed.join(todo.hint("shuffle_hash"), same(todo), "left_semi")
    return unseen.select("blob", "text").mapInArrow(released(_scanned(rules_version)), LEDGER_SCHEMA).dropDuplicates(["blob"])


def _scanned(rules_version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for blob, text in zip(part.column("blob").to_pylist(), part.column("text").to_pylist()):
                    spans = scan(text)
                    base = [s for s in spans if s[1] in BASE_KINDS]
                    rows.append((blob, rules_version, *(sum(s[1] == k for s in base) for k in BASE_KINDS), _joined(base), _joined(spans)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 2 + [pa.int64()] * 3 + [pa.string()] * 2)], names=["blob", "rules_version", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return run


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def findings(addressed: DataFrame, ledger: DataFrame, rules_version: str = RULES_VERSION) -> DataFrame:
    """(path, blob, n_assign, n_access, n_hex, base_spans, spans): every path with its blob's findings, zeros and '' without any.

    Only blobs with findings are joined, and the paths of one are dealt to
    several tasks, so neither a clean nor a leaking common blob gathers its paths.
    """
    hits = ledger.where((F.col("rules_version") == rules_version) & (F.col("spans") != "")).drop("rules_version").dropDuplicates(["blob"])
    joined = salted(addressed.select("path", "blob"), hits, ["blob"], ["path"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return joined.select("path", "blob", *counts, F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty before its first run."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(history: DataFrame, ledger_path: str, path_col: str = "path", text_col: str = "text", rules_version: str = RULES_VERSION) -> int:
    """Scans what the stored ledger has not, appends the new rows to it, and returns how many they are.

    A run that dies before its commit leaves the ledger as it was; the next one
    scans the same blobs again.
    """
    new = materialize(scan_unseen(address(history, path_col, text_col), read_ledger(history.sparkSession, ledger_path), rules_version), "blob-new")
    n = new.count()
    if n:
        new.write.mode("append").parquet(ledger_path)
    discard(new)
    return n


def scan_history(history: DataFrame, path_col: str = "path", text_col: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings of every version, the ledger with the new rows), of ``ledger`` as a table; update_ledger keeps one in storage.

    Null and empty texts share the empty blob; repeated versions each have a
    row of findings; an empty history has none; other columns are not read.
    """
    addressed = address(history, path_col, text_col)
    new = materialize(scan_unseen(addressed, ledger), "blob-ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return findings(addressed, whole), whole


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
