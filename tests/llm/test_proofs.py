"""Whole results against independent forms: secrets by plain patterns, shards against a random deal, quality scores by a plain refit."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from recallforge.llm import quality_classifier as QC
from recallforge.llm import secrets as SE
from recallforge.llm import sharding as SH

SF = "/root/testdata/sf0.001"
#: The base of the contract, written down once more.
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets_of_all_documents(spark, tmp_path):
    odd = [None, "", "token=" + "a" * 11, "TOKEN:'" + "a" * 12, "api_key = " + "f" * 40, "apikey=secret=" + "0123456789abcdef" * 2, "é" * 5 + " passwd:AKIA" + "Z" * 20, "ſecret=abcdefghijklmnop", "secret\n=abcdefghijklmnop", "AKIAAKIA" + "1" * 9, "x" + "deadbeef" * 4 + "G"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in docs.collect():
        spans = base_spans(r["text"] or "")
        kinds = Counter(s[3] for s in spans)
        want[r["doc_id"]] = (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in SE.op9_blob_ledger(spark, str(tmp_path)).collect()}
    assert got == want


def test_a_stored_ledger_leaves_only_new_blobs_and_rules(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    half = docs.where("doc_id % 2 = 0")
    _, ledger = SE.scan(half)
    ledger.withColumn("spans", F.concat(F.lit("stored "), "spans")).write.parquet(f"{tmp_path}/ledger")
    kept = spark.read.parquet(f"{tmp_path}/ledger")
    found, after = SE.scan(docs, kept)
    assert after.count() == docs.select(F.sha2(F.coalesce("text", F.lit("")), 256)).distinct().count()
    known = {r[0] for r in half.select(F.sha2(F.coalesce("text", F.lit("")), 256)).collect()}
    assert all((r["blob"] in known) == r["spans"].startswith("stored ") for r in found.collect())
    _, other = SE.scan(half, kept, version="next")
    assert {(r["rule_version"], r["n"]) for r in other.groupBy("rule_version").agg(F.count(F.lit(1)).alias("n")).collect()} == {(SE.RULE_VERSION, len(known)), ("next", len(known))}


def test_shards_of_long_and_short_texts_are_even(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(1, 90) + str(i) for i in range(3_000)] + ["y" * rng.randint(20_000, 40_000) + str(i) for i in range(30)] + [None, "", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = SH.shard_documents(d, shards=8).collect()
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert len(rows) == len(texts) and max(sums) - min(sums) <= sum(sums) / 8 / 64
    giant = spark.createDataFrame([(0, "z" * 50_000), *((i, "a" * 20 + str(i)) for i in range(1, 500))], "doc_id long, text string")
    rows = SH.shard_documents(giant, shards=4).collect()
    sums = sorted(sum(r["size"] for r in rows if r["shard"] == s) for s in range(4))
    assert sums[3] == 50_008 and sums[2] - sums[0] <= 120 and sums[0] > 4_000  # what is left of the others is dealt evenly


def test_level_and_largest_first():
    for loads, more in (([5, 10], 3), ([5, 10], 10), ([0, 0, 7], 0), ([3, 3, 3], 4), ([9, 1, 1], 5)):
        h = SH.level(loads, more)
        assert sum(max(0, h - x) for x in loads) >= more > sum(max(0, h - 1 - x) for x in loads) or more == 0
    loads = [4, 0, 0]
    assert SH.largest_first([("a",), ("b",), ("c",)], [1, 6, 5], loads) == [("b", 1), ("c", 2), ("a", 0)] and loads == [5, 6, 5]


def test_shards_cut_few_links_and_are_even(spark):
    """Of the links between copies far fewer are cut than by a random deal; sums differ by little more than the largest document."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 60)).otherwise(F.col("id")).cast("string"), F.repeat(F.lit(" x"), (F.col("id") % 20).cast("int") * F.when(F.col("id") % 3 == 0, 0).otherwise(1))).alias("text"))
    rows = SH.shard_documents(docs).join(docs, "doc_id").collect()
    cut = lambda shard: sum(shard(a) != shard(b) for group in groups.values() for a, b in zip(group, group[1:], strict=False))
    groups, loads, slots = defaultdict(list), Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        groups[r["text"]].append(r)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert cut(lambda r: r["shard"]) < cut(lambda r: hash(("deal", r["doc_id"])) % 24) / 5
    assert len(loads) == 24 and max(loads.values()) - min(loads.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_statistics(text):
    """The statistics of a text, counted with plain Python."""
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not w:
        return [0.0] * len(QC.FEATURES)
    among = lambda chars: sum(b in chars for b in raw)
    capitals, small = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
    lines, runs = [x for x in raw.split(b"\n") if x], [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = lambda xs: np.sqrt(1 - len(set(xs)) / len(xs)) if xs else 0.0
    share = lambda chars: np.sqrt(among(chars) / len(raw))
    return [
        np.log1p(len(w)), np.log(sum(map(len, w)) / len(w)), share(b"#*$%&<>^~@\\"), np.sqrt(among(capitals) / max(1, among(capitals + small))), share(b"!?"), share(b"|"), share(b"0123456789"), share(b".,;:"),
        np.log1p(len(w) / len(lines)), again(runs), again(lines), len(set(w)) / len(w), np.sqrt(np.mean([a == b for a, b in zip(w, w[1:], strict=False)])) if len(w) > 1 else 0.0,
    ]


def test_quality_scores_against_a_plain_refit(spark):
    """Scores are a logistic of the log-density difference of two shrunk Gaussians, with the slope and shift of least loss."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r["score"] for r in QC.op1_quadratic_discriminant(spark, sf).collect()}
    x = np.array([plain_statistics(r["text"]) for r in rows])
    learnt = np.array([labels.get(r["doc_id"]) in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in rows])
    y = np.array([labels.get(r["doc_id"]) or 0 for r in rows])
    centre, spread = x[learnt].mean(axis=0), np.sqrt(np.maximum(x[learnt].var(axis=0), 1e-6))
    z = (x - centre) / spread
    parts = [z[learnt & (y == k)] for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs, strict=True)) / learnt.sum()
    density = []
    for p, c in zip(parts, covs, strict=True):
        c = 0.95 * c + 0.05 * pooled
        c = 0.999 * c + 0.001 * (np.trace(c) / len(c) + 1e-3) * np.eye(len(c))
        apart = np.clip(z, -12, 12) - p.mean(axis=0)
        density.append(np.log(len(p) / learnt.sum()) - np.linalg.slogdet(c)[1] / 2 - (apart * np.linalg.solve(c, apart.T).T).sum(axis=1) / 2)
    v = density[1] - density[0]
    v = v / (1 + np.abs(v) / 20)
    score = np.array([got[r["doc_id"]] for r in rows])
    inner = (score > 1e-6) & (score < 1 - 1e-6)
    slope, shift = np.polyfit(v[inner], np.log(score[inner] / (1 - score[inner])), 1)
    assert slope > 0 and np.abs(1 / (1 + np.exp(-(slope * v + shift))) - score).max() < 1e-4
    scale = v[learnt].std()
    loss = lambda a, b: np.mean(np.logaddexp(0, a * v[learnt] + b) - (0.98 * y[learnt] + 0.01) * (a * v[learnt] + b)) + 5e-5 * ((a * scale) ** 2 + b**2)
    least = loss(slope, shift)
    assert all(loss(slope * (1 + a), shift + b) > least - 1e-9 for a in (-0.1, 0, 0.1) for b in (-0.1, 0, 0.1))
