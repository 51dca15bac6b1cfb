"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a Gaussian over transformed statistics of a text. Its covariance
is shrunk towards the pooled one and then towards a multiple of the identity;
the score is the log-density difference of the two classes, from Mahalanobis
distances by the cached Cholesky factor of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import _kernel as K
from recallforge.llm._common import small_batches, stash

FEATURES = ("log_words", "word_bytes", "symbols", "upper", "exclaim", "pipes", "digits", "stops", "line_words", "repeats", "dup_lines", "distinct", "echo")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOLS, _UPPER, _ALPHA = _table("#*$%&<>^~@\\"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_EXCLAIM, _PIPES, _DIGITS, _STOPS, _LINES = _table("!?"), _table("|"), _table("0123456789"), _table(".,;:"), _table("\n")
_LINE_GAP = _LINES.copy()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; shares go through a square root and sizes through a logarithm, so that both are nearer to normal."""
    n = len(offsets) - 1
    sums = K.byte_sums(data)
    starts, ends, bounds = K.words(data, offsets, K.BLANK)
    hashes = K.cut_hash(sums, starts, ends)
    runs = K.grams(K.gram_sums(hashes), 8)
    lines = K.words(data, offsets, _LINE_GAP)
    line_hashes = K.cut_hash(sums, lines[0], lines[1])
    out = np.zeros((n, len(FEATURES)))
    for t in range(n):
        count = np.bincount(data[offsets[t] : offsets[t + 1]], minlength=256)
        size, lo, hi = max(1, offsets[t + 1] - offsets[t]), bounds[t], bounds[t + 1]
        w, share = hi - lo, lambda table: np.sqrt(count[table].sum() / size)  # noqa: B023
        if not w:
            continue
        own = runs[lo : hi - 7] if w >= 8 else runs[:0]
        rows = line_hashes[lines[2][t] : lines[2][t + 1]]
        out[t] = (
            np.log1p(w), np.log((ends[lo:hi] - starts[lo:hi]).mean()), share(_SYMBOLS), np.sqrt(count[_UPPER].sum() / max(1, count[_ALPHA].sum())),
            share(_EXCLAIM), share(_PIPES), share(_DIGITS), share(_STOPS), np.log1p(w / max(1, len(rows))),
            np.sqrt(1 - len(np.unique(own)) / max(1, len(own))) if len(own) else 0.0,
            np.sqrt(1 - len(np.unique(rows)) / max(1, len(rows))) if len(rows) else 0.0,
            len(np.unique(hashes[lo:hi])) / w, np.sqrt((hashes[lo + 1 : hi] == hashes[lo : hi - 1]).mean()) if w > 1 else 0.0,
        )
    return out


def _measure(batches):
    for batch in batches:
        rows = [statistics(data, offsets) for _, _, data, offsets in K.slices(batch.column(1))]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[batch.schema.names[0], "x"])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of every whole text; of null and of texts without words they are all zero."""
    small_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(_measure, f"{key} {dict(docs.dtypes)[key]}, x array<double>")


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    offsets: list[float]
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -12, 12)
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.offsets, strict=True)]
        apart = density[1] - density[0]
        return apart / (1 + np.abs(apart) / 20)  # keeps the order; far tails of a Gaussian mean little

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -40, 40)))


def fit(train: DataFrame, label: str = "label", pooled: float = 0.05, ridge: float = 0.001, sample: int = 200_000, seed: int = 3) -> Model | None:
    """Fit on rows (x, ``label`` 0 or 1), other labels and null being left out. None where a class has fewer than two rows.

    Moments of the classes are distributed sums over all rows. ``pooled`` is the
    share of the pooled covariance, ``ridge`` that of the identity. The log-density
    difference of correlated statistics is too sure of itself: it gets a logistic
    slope and shift, fitted on at most ``sample`` rows, drawn by hash where there are more.
    """
    d = len(FEATURES)
    rows = train.where(F.col(label).isin(0, 1) & F.col("x").isNotNull()).select(F.col(label).cast("int").alias("y"), "x")
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]).alias("q")]
    got = {r["y"]: r for r in rows.groupBy("y").agg(*sums).collect()}
    if any(k not in got or got[k]["n"] < 2 for k in (0, 1)):
        return None
    upper = np.triu_indices(d)
    moments = []
    for k in (0, 1):
        second = np.zeros((d, d))
        second[upper] = got[k]["q"]
        moments.append((got[k]["n"], np.array(got[k]["s"]), second + np.triu(second, 1).T))
    total = sum(m[0] for m in moments)
    centre = sum(m[1] for m in moments) / total
    spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments)) / total - centre**2, 1e-6))
    means = [(s / n - centre) / spread for n, s, _ in moments]
    covs = [(q / n - np.outer(s / n, s / n)) / np.outer(spread, spread) for n, s, q in moments]
    mean_cov = sum(m[0] * c for m, c in zip(moments, covs, strict=True)) / total
    factors, offsets = [], []
    for k in (0, 1):
        cov = (1 - pooled) * covs[k] + pooled * mean_cov
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / d + 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(moments[k][0] / total) - np.log(np.diag(lower)).sum()))
    model = Model(centre, spread, means, factors, offsets)
    at_most = min(1.0, sample / total)
    drawn = rows if at_most == 1 else rows.where(F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * at_most))
    some = drawn.select("y", "x").limit(sample).toPandas()
    if len(some):
        model.slope, model.shift = _logistic(model.difference(np.stack(some["x"].to_numpy())), some["y"].to_numpy(float))
    return model


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least log loss, by damped Newton steps; the slope stays positive so that the order of scores is the discriminant's."""
    scale = max(1e-9, float(np.std(v)))
    z = np.clip(np.stack([v / scale, np.ones_like(v)], axis=1), -50, 50)
    target, b = 0.98 * y + 0.01, np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - target) / len(y) + 1e-4 * b)
        b = b - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (max(float(b[0]), 1e-3) / scale, float(b[1]))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(key.cast("string")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, stats: DataFrame | None = None) -> DataFrame:
    """Score every row of ``docs``: key, held_out, score, predicted (1 if score >= ``threshold``).

    Rows whose key is null are scored too and are not held out. Null and empty
    texts get the score of all-zero statistics; rows that repeat are scored each;
    an empty table gives an empty one. Where labels have fewer than two rows of a
    class, every score is 0.5. Columns of ``docs`` beyond key and text are not read.
    """
    stats = stash(measure(docs, key, text), "stats") if stats is None else stats
    known = labels.where(F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("label"))
    model = fit(stats.dropDuplicates([key]).join(known, key).select("x", "label"))

    def score(batches):
        for batch in batches:
            x = batch.column(1)
            values = np.asarray(x.flatten()).reshape(-1, len(FEATURES)) if len(x) else np.zeros((0, len(FEATURES)))
            got = np.full(len(x), 0.5) if model is None else model.score(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=[batch.schema.names[0], "score"])

    scored = stats.select(key, "x").mapInArrow(score, f"{key} {dict(stats.dtypes)[key]}, score double")
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score, learnt from the labels of documents whose crc32 of the id is not divisible by 5. Null and empty texts are scored too."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
