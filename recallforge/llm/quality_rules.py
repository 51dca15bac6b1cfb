"""Quality rules: a decision list learned by sequential covering from labelled statistics.

A rule is a conjunction of thresholds on statistics of a text; the list is one
Spark CASE WHEN. Rules are grown one condition at a time by information gain on
one part of the labelled rows and pruned on the other; rows that a rule covers
leave, and the next rule is learned on the rest. Every count is a Spark
aggregate over all labelled rows; the driver only sees counts by statistic and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm._common import stash

_GAP = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_length", "symbol_share", "upper_share", "exclaim_share", "dup_line_share", "repeat_share", "distinct_share")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other ``STATS`` of every whole text; null counts as empty."""
    t = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.withColumn("words", F.array_remove(F.split("t", _GAP), ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select(
        "key", F.size("words").alias("n"), F.char_length(F.array_join("words", "")).alias("word_chars"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        *[F.regexp_count("t", F.lit(p)).alias(n) for n, p in (("symbols", "[#*$%&|<>]"), ("upper", "[A-Z]"), ("exclaim", "[!?]"))], lines.alias("lines"),
    )
    at = lambda i, j: F.get("h", i + j)
    windows = F.when(F.col("n") >= 8, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 8, F.lit(0))), lambda i: F.xxhash64(*[at(i, j) for j in range(8)])))
    t = t.select("key", "n", "word_chars", "symbols", "upper", "exclaim", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup"), F.size(F.array_distinct("h")).alias("kinds"), windows.alias("w"))
    # Only texts where a window comes twice need the places of their windows.
    placed = F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    t = t.withColumn("placed", placed).drop("w")
    twice = F.filter("placed", lambda s, i: F.coalesce(F.get("placed", i - 1)["x"] == s["x"], F.lit(False)) | F.coalesce(F.get("placed", i + 1)["x"] == s["x"], F.lit(False)))
    t = t.withColumn("at", F.sort_array(F.transform(twice, lambda s: s["i"]))).drop("placed")
    covered = F.aggregate("at", F.struct(F.lit(-8).alias("last"), F.lit(0).alias("sum")), lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(8), p - a["last"])).alias("sum")))["sum"]
    t = t.withColumn("repeat", F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0))).drop("at")
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return t.select(
        F.col("key").alias(key), *[F.col(a).cast("long").alias(b) for a, b in (("n", "n_words"), ("word_chars", "word_chars"), ("symbols", "n_symbols"), ("dup", "n_dup_lines"), ("repeat", "n_repeat_words"))],
        per("word_chars", "n").alias("word_length"), per("symbols", "word_chars").alias("symbol_share"), per("upper", "word_chars").alias("upper_share"), per("exclaim", "word_chars").alias("exclaim_share"),
        per("dup", "n_lines").alias("dup_line_share"), per("repeat", "n").alias("repeat_share"), per("kinds", "n").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.stat) >= self.threshold if self.at_least else F.col(self.stat) < self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def meets(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """False for rows that any rule of the list rejects, as one CASE WHEN in the order of the list."""
    out = None
    for r in rules:
        out = F.when(meets(r), F.lit(False)) if out is None else out.when(meets(r), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(rows: DataFrame, label: str = "label", stats: tuple[str, ...] = STATS, bins: int = 24, most_rules: int = 12, most_conditions: int = 3, least_precision: float = 0.8, least_cover: int = 5) -> list[Rule]:
    """Rules that reject rows with ``label`` 0, from all rows whose label is 0 or 1.

    Thresholds are quantiles of a statistic, of rejects and of keeps. Two thirds of
    the rows (by hash) grow a rule, the others prune it. Learning ends at a rule
    that rejects too few rows or too many good ones. No labels, no rules.
    """
    known = rows.where(F.col(label).isin(0, 1)).select(F.col(label).alias("y"), *stats)
    known = stash(known.withColumn("grow", F.pmod(F.xxhash64("y", *stats), F.lit(3)) > 0), "labelled")
    marks = [i / bins for i in range(1, bins)]
    cuts = known.groupBy("y").agg(*[F.percentile_approx(s, marks, 2000).alias(s) for s in stats]).collect()
    if len(cuts) < 2:
        return []
    thresholds = {s: sorted({v for r in cuts for v in r[s] or []}) for s in stats}

    def bin_of(s: str) -> Column:
        """Number of thresholds met: bin b is from threshold b - 1 on."""
        value = F.col(s)
        return F.size(F.filter(F.array(*[F.lit(float(v)) for v in thresholds[s]]), lambda v: v <= value)).alias(f"b_{s}")

    binned = stash(known.select("y", "grow", *[bin_of(s) for s in stats], *stats), "binned")

    def counts(where: Column) -> dict[tuple[str, int, int], int]:
        cells = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"b_{s}").alias("b")) for s in stats]))
        return {(r["s"], r["b"], r["y"]): r["count"] for r in binned.where(where).select("y", cells.alias("c")).groupBy("c.s", "c.b", "y").count().collect()}

    def both(rule: Rule, where: Column) -> list[tuple[int, int]]:
        """(rejects, keeps) that each beginning of a rule covers."""
        firsts = [meets(rule[:i]) for i in range(len(rule) + 1)]
        r = binned.where(where).agg(*[F.count_if(f & (F.col("y") == y)) for f in firsts for y in (0, 1)]).first()
        return [(r[2 * i], r[2 * i + 1]) for i in range(len(firsts))]

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < most_conditions:
            seen = counts(left & F.col("grow") & meets(rule))
            p0, n0 = (sum(v for (s, _, y), v in seen.items() if s == stats[0] and y == k) for k in (0, 1))
            if not p0 or not n0:
                break
            best = None
            for s in stats:
                for i, v in enumerate(thresholds[s]):
                    for at_least in (True, False):
                        p, n = (sum(c for (t, b, y), c in seen.items() if t == s and y == k and (b > i) == at_least) for k in (0, 1))
                        if p < least_cover:
                            continue
                        gain = p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1)))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, Condition(s, at_least, float(v)), n)
            if best is None or best[0] <= 1e-6:
                break
            rule = (*rule, best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in both(rule, left & ~F.col("grow"))]
        keep = max(range(1, len(worth)), key=lambda i: (worth[i], -i))
        rule = rule[:keep]
        p, n = both(rule, left)[-1]
        if p < least_cover or p < least_precision * (p + n):
            break
        rules.append(rule)
        left = left & ~meets(rule)
    return rules


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``base_failed``: fewer than 20 words, or over 30 per cent of words in repeated
    8-word windows; such rows are not kept, others as the learned list says. Null
    and empty texts have no words and fail. Labels of rows whose crc32(key) is
    divisible by 5, null labels and labels without a document are not learned
    from; without labels the base alone decides. Rows that repeat are judged each
    (and learned from once); an empty table gives an empty one; other columns are not read.
    """
    stats = stash(statistics(docs, key, text), "stats")
    known = labels.where(F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0)).groupBy(key).agg(F.max(label).alias("label"))
    rules = learn(stats.dropDuplicates([key]).join(known, key))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the base counts and the verdict of the learnt list; null and empty texts have no words and fail."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
