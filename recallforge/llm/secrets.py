"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger records which (blob, rule version) pairs were scanned and what was
found, so a run scans only pairs not yet in it, each blob once however many
paths hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm._common import side, small_batches, stash

#: Kinds in their order, patterns, the group whose length counts, its least length. The first three are the base.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
RULE_VERSION = "2"
BASE = ("assign", "access", "hex")

#: What must stand in a text for a rule to match at all, lower-cased for ``assign``; ``hex`` has a pattern of its own.
_NEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "github": ("gh",), "slack": ("xox",), "google": ("AIza",), "jwt": ("eyJ",), "pem": ("PRIVATE KEY",)}
_PATTERNS = {kind: re.compile(p, re.ASCII) for kind, p, _, _ in RULES}
_LONG_HEX = re.compile(r"[0-9a-f]{16}")


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of every secret of a text, by start and kind; matches are leftmost and do not overlap within a kind."""
    if not text:
        return []
    lowered = text.lower()
    out = []
    for k, (kind, _, group, least) in enumerate(RULES):
        if kind == "hex":
            if not _LONG_HEX.search(text):
                continue
        elif not any(x in (lowered if kind == "assign" else text) for x in _NEEDS[kind]):
            continue
        out += [(m.start(), m.end(), k) for m in _PATTERNS[kind].finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], s[2]))


def spans_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] | None = None) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, b, k in spans if kinds is None or RULES[k][0] in kinds)


_FOUND = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_FOUND_ARROW = pa.schema([("blob", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_NONE = hashlib.sha256(b"").hexdigest()


def _scan(batches):
    for batch in batches:
        rows = []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = find(text.as_py() or "")
            if spans:
                kinds = [RULES[k][0] for _, _, k in spans]
                base = spans_text(spans, BASE)
                rows.append((blob, *(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), spans_text(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)


def scan(paths: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan the unseen blobs of ``paths`` and join findings back to every path.

    ``paths`` has a row for each version of each path (columns ``path``, ``text``;
    others, whatever their names, are left out). ``ledger``: an earlier second result, or None.
    Returns (findings, ledger): findings has a row for each row of ``paths`` with
    ``path``, ``blob``, counts of the base kinds, ``base_sha256`` and ``spans``;
    the ledger has a row for each (blob, rule_version) scanned so far, with its findings.

    Null texts are the empty blob; empty texts have no findings; rows that repeat
    are kept, each with its findings; an empty table gives empty results. Texts are
    scanned whole, one blob in memory at a time.
    """
    small_batches(paths.sparkSession)
    own = paths.select(F.col(path).alias("__path"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    own = own.withColumn("__blob", F.sha2("__text", 256))
    seen = stash(own.select("__path", "__blob"), "blobs")
    chosen = seen.groupBy("__blob").agg(F.min("__path").alias("__path"))
    if ledger is not None:
        chosen = chosen.join(ledger.where(F.col("rule_version") == version).select(F.col("blob").alias("__blob")).distinct(), "__blob", "left_anti")
    # A path may have several versions, so a blob is told by both; equal rows of one path are scanned again rather than grouped with their
    # texts. The list to scan has 16 bytes a blob: while it is small enough to broadcast, no text is shuffled.
    few = side(stash(chosen.select(F.col("__path").alias("__p"), F.xxhash64("__blob").alias("__h")), "chosen"))
    todo = own.join(few, F.col("__path").eqNullSafe(F.col("__p")) & (F.xxhash64("__blob") == F.col("__h")), "left_semi")
    found = stash(todo.select("__blob", "__text").mapInArrow(_scan, _FOUND), "found").dropDuplicates(["blob"])
    fresh = chosen.select(F.col("__blob").alias("blob")).join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")], F.coalesce("base_sha256", F.lit(_NONE)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    whole = fresh if ledger is None else ledger.unionByName(fresh)
    known = whole.where((F.col("rule_version") == version) & (F.col("spans") != ""))  # blobs without findings need no join
    out = seen.join(known, seen["__blob"] == known["blob"], "left").select(F.col("__path").alias(path), F.col("__blob").alias("blob"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")], F.coalesce("base_sha256", F.lit(_NONE)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    return out, whole


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: contract columns from ``scan`` with an empty ledger."""
    found, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
