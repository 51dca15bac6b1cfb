"""Index, automaton, tiles, matching rounds, interval and set joins against brute force on random rows."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from recallforge.operators import index as I
from recallforge.operators import retrieve as R
from recallforge.operators import tiles as T
from recallforge.operators import upkeep as U
from recallforge.operators.phrases import count_items, find_items
from recallforge.sources.shared import new_folder

MEM = "bank string, record_idx long, content string, reason string, purpose string, keywords array<string>"


def test_index_gives_the_best_of_a_plain_scan(spark):
    """Many small shards and blocks, ties, empty records, a bank without a hit; queries in one group and in several."""
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(4000)]
    rows = [(b, i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40]))), "", "", []) for b in ("x", "y") for i in range(150)] + [("z", 1, "none", None, None, None)]
    m = spark.createDataFrame(rows, MEM)
    q = spark.createDataFrame([(i, b, " ".join(rng.choices(words, k=6)), []) for i in range(12) for b in ("x", "y", "z", "absent")], "query_id long, bank string, anchor string, keywords array<string>")
    path = new_folder(spark)
    I.build_index(m, R.record_text(), path, shard=40, block=4)
    x = I.open_index(spark, path)
    want = sorted((r["query_id"], r["bank"], r["record_idx"], round(r["score"], 9)) for r in R.search_bm25(m, q, 7).collect())
    assert sorted((r["query_id"], r["bank"], r["record_idx"], round(r["score"], 9)) for r in R.search_bm25(m, q, 7, index=x).collect()) == want
    terms = R.query_terms(q)
    few = R.top_k(I.search_index(x, terms, 7, most=60), 7).where("bank <> 'z'")
    assert sorted((r["query_id"], r["bank"], r["record_idx"], round(r["score"], 9)) for r in few.collect()) == [w for w in want if w[3] > 0]
    tf = {(r["bank"], r["record_idx"], r["term"], r["tf"], r["dl"]) for r in I.tf_rows(x).collect()}
    assert tf == {(b, i, t, re.findall("[a-z0-9]+", c).count(t), len(re.findall("[a-z0-9]+", c))) for b, i, c, *_ in rows for t in set(re.findall("[a-z0-9]+", c))}


def test_index_is_built_without_a_shuffle_of_tokens(spark, monkeypatch):
    """Shards are closed by records and by tokens; what the build shuffles is a count a term and task, not the postings of a record."""
    monkeypatch.setattr(I, "SHARD_TOKENS", 60)
    rows = [(b, i, "w " * (i % 9) + f"v{i % 3}", "", "", []) for b in ("x", "y") for i in range(300)] + [("x", 300, "long " * 500, "", "", [])]
    m = spark.createDataFrame(rows, MEM).repartition(3)
    path = new_folder(spark)
    I.build_index(m, R.record_text(), path, shard=20, block=2)
    x = I.open_index(spark, path)
    per = x.records.groupBy("bank", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("size"), F.max("dl").alias("most")).collect()
    assert sum(p["n"] for p in per) == 601 and len({(p["bank"], p["shard"]) for p in per}) == len({p["shard"] for p in per})
    assert all(p["n"] <= 20 and p["size"] - p["most"] < 60 for p in per)
    assert "Exchange" not in x.postings._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(f"{path}/shards").inputFiles().__len__() == 3  # a file a task that read records: no stage between


def test_index_scores_few_records_where_bounds_tell(spark):
    """Three records hold the rare word often; blocks of the others cannot reach the list."""
    rows = [("x", i, "common " * (1 + i % 3) + "filler " * (i % 17), "", "", []) for i in range(600)] + [("x", 600 + i, "rare rare common", "", "", []) for i in range(3)]
    m = spark.createDataFrame(rows, MEM)
    path = new_folder(spark)
    I.build_index(m, R.record_text(), path, shard=1_000, block=8)
    q = spark.createDataFrame([(1, "x", "rare common", [])], "query_id long, bank string, anchor string, keywords array<string>")
    got = I.search_index(I.open_index(spark, path), R.query_terms(q), 3).collect()
    assert {r["record_idx"] for r in got} == {600, 601, 602} and got[0]["scored"] < 100


def test_automaton_finds_phrases_and_words(spark):
    rng = random.Random(2)
    letters = "ab é"
    texts = [(b, i, "".join(rng.choices(letters, k=rng.randint(0, 30)))) for b in ("x", "y") for i in range(40)] + [("x", 99, None), ("none", 1, "ab")]
    items = {(b, "".join(rng.choices(letters, k=rng.randint(1, 4))), w) for b in ("x", "y") for w in (False, True) for _ in range(20)}
    r, it = spark.createDataFrame(texts, "bank string, record_idx long, full string"), spark.createDataFrame(sorted(items), "bank string, item string, word boolean")
    want = sorted((b, i, x, w) for b, i, t in texts for bi, x, w in items if b == bi and t is not None and (x in re.findall("[a-z0-9]+", t) if w else x in t))
    for most in (10**6, 50):
        assert sorted(tuple(r) for r in find_items(r, it, most).collect()) == want
    assert find_items(r, it.limit(0)).count() == 0


def test_tiles_equal_all_pairs_and_leave_most_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)) * 0.5, np.zeros((2, 16))])
    rows = [("b" if i % 3 else "c", i, v.tolist()) for i, v in enumerate(x)] + [("b", 999, None), ("b", 1000, x[1].tolist())]
    v = spark.createDataFrame(rows, "bank string, idx long, embedding array<double>")
    unit = {i: (b, np.array(e or [0.0] * 16)) for b, i, e in rows}
    for threshold in (0.85, 0.2):
        want = set()
        for i, (bi, a) in unit.items():
            for j, (bj, c) in unit.items():
                size = np.linalg.norm(a) * np.linalg.norm(c)
                if i < j and bi == bj and size > 0 and a @ c / size >= threshold:
                    want.add((bi, i, j))
        got = T.similar_pairs(v, threshold, tile=30).collect()
        assert len(got) == len(want) and {(r["bank"], r["i"], r["j"]) for r in got} == want
    assert T.similar_pairs(v.where("idx < 30"), -1.0, tile=7).count() == sum(len(g) * (len(g) - 1) // 2 for g in ([i for i in range(30) if i % 3], [i for i in range(30) if not i % 3]))
    tested = sum(r["tested"] for r in T.pairs_tested(T.blocked(v, 0.85, tile=30)[1]).collect())
    whole = sum(r["tested"] for r in T.pairs_tested(T.blocked(v, -1.0, tile=30)[1]).collect())
    assert tested < whole / 2
    assert T.similar_pairs(v.limit(0)).count() == 0


def loop(rows):
    gone, out = set(), set()
    for b, o, i, j, d in sorted(rows, key=lambda r: (r[0], r[1])):
        if d in ("MERGE", "SUPERSEDE") and i is not None and j is not None and not {(b, i), (b, j)} & gone:
            gone |= {(b, i), (b, j)}
            out.add((b, o))
    return out


def test_rounds_of_decisions_equal_the_loop(spark):
    rng = random.Random(4)
    kind = lambda: rng.choice(["MERGE", "SUPERSEDE", "KEEP_BOTH", None])
    rows = [(b, o, rng.choice([*range(40), None]), rng.randrange(40), kind()) for b in ("x", "y") for o in range(120)]
    rows += [("hub", o, 0 if o % 2 else o, o + 1, "MERGE") for o in range(60)] + [("chain", o, o, o + 1, "MERGE") for o in range(30)] + [("self", 1, 5, 5, "MERGE"), ("self", 2, 5, 6, "MERGE")]
    d = spark.createDataFrame(rows, "bank string, ord long, idx_new long, idx_old long, decision string")
    for together, rounds in ((0, 4), (0, 40), (10**6, 40)):
        got = U.acting(d, together, rounds).collect()
        assert len(got) == len(loop(rows)) and {(r["bank"], r["ord"]) for r in got} == loop(rows)


def test_a_bank_of_a_million_decisions(spark):
    d = spark.range(1_000_000).select(F.lit("b").alias("bank"), F.col("id").alias("ord"), F.pmod(F.xxhash64("id"), F.lit(700_000)).alias("idx_new"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(700_000)).alias("idx_old"), F.lit("MERGE").alias("decision"))
    acts = U.acting(d).join(d, ["bank", "ord"]).select(F.explode(F.array("idx_new", "idx_old")).alias("i"))
    n, distinct = acts.agg(F.count("i"), F.count_distinct("i")).first()
    assert n > 400_000 and n - distinct <= 5  # a decision of a memory with itself names it twice


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(5)
    times = ["", "x", "2023", "2023-02", "2024-02-29", "2023-12-31", "2024-01-01T10:30:00", "2022-06-15", "1999", "2024"]
    rows = [(b, i, rng.choice(times), rng.choice([None, f"2023-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} 0{rng.randint(0, 9)}:00:00"])) for b in ("x", "y") for i in range(80)]
    m = spark.createDataFrame(rows, "bank string, record_idx long, time string, s string").withColumn("source_time", F.to_timestamp("s").cast("timestamp_ntz"))
    asked = ["", "never", "before 2023-03-05", "after 2023-11", "on 2023-12-31", "around 2024-01", "between 2023-01-31 and 2023-03-01", "2023", "after 2030", "before 1990", "on 2024-02-29", "between 2023-05-01 and 2023-04-01", "around 2023"]
    q = spark.createDataFrame([(i, b, t) for i, t in enumerate(asked) for b in ("x", "y", "absent")], "query_id long, bank string, time string")
    want = sorted((r["query_id"], r["bank"], r["record_idx"], r["score"]) for r in R.time_matches(m, q).where("score > 0").collect())
    assert want and sorted((r["query_id"], r["bank"], r["record_idx"], r["score"]) for r in R.time_hits(m, q).collect()) == want


def test_set_join_with_a_keyword_of_all(spark, monkeypatch):
    monkeypatch.setattr(U, "HEAVY", 7)
    rng = random.Random(6)
    rows = [("b", "fact", i, ["all", *rng.sample([f"k{n}" for n in range(12)], rng.randint(0, 5))]) for i in range(70)] + [("b", "fact", 70, []), ("b", "fact", 71, None), ("c", None, 72, ["all"])]
    m = spark.createDataFrame(rows, "bank string, memory_type string, idx long, keywords array<string>")
    for least in (0.3, 0.6, 1.0):
        want = {(i, j) for b, _, i, x in rows for c, _, j, y in rows if i < j and b == c and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        got = U.keyword_pairs(m, least, ("bank",)).collect()
        assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want


def test_set_join_settles_candidates_in_place(spark):
    """A keyword of all makes 20 000 candidates; none is shuffled, and nulls are no keywords."""
    rows = [("b", i, ["All", None, f"x{i}"]) for i in range(200)] + [("b", 200, ["all"]), ("b", 201, [None])]
    m = spark.createDataFrame(rows, "bank string, idx long, keywords array<string>")
    p = U.keyword_pairs(m, 0.3, ("bank",))
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan  # no candidates made distinct
    assert p.count() == 201 * 200 // 2 and {round(r["jaccard"], 9) for r in p.select("jaccard").distinct().collect()} == {round(1 / 3, 9), 0.5}


def test_contents_are_sent_once_a_cluster(spark, monkeypatch):
    """Pairs of clusters, one dealt over several cells: cosine as counted by hand, and far fewer contents sent than pairs have ends."""
    monkeypatch.setattr(U, "CELL", 500)
    rng = random.Random(7)
    texts = {i: None if i == 3 else " ".join(rng.choice(["a", "B", "c", "d é"]) for _ in range(rng.randint(0, 9))) for i in range(90)}
    m = spark.createDataFrame([("b", i, t) for i, t in texts.items()], "bank string, idx long, content string")
    pairs = [("b", i, j) for j in range(60) for i in range(j)] + [("b", i, i + 1) for i in range(60, 89)]
    p = spark.createDataFrame(pairs, "bank string, i long, j long")
    sent = U._cells(p, m.select("bank", "idx", F.array("content").alias("values")), U.CELL).where("j is null").count()
    assert sent < len(pairs) / 4
    count = lambda t: {w: t.lower().split().count(w) for w in t.lower().split() if w != "é"} if t else {}
    size = lambda x: math.sqrt(sum(v * v for v in x.values()))
    got = {(r["i"], r["j"]): r["similarity"] for r in U.count_cosine(m, p).collect()}
    assert len(got) == len(pairs)
    for (i, j), s in got.items():
        x, y = count(texts[i]), count(texts[j])
        d = sum(x[w] * y.get(w, 0) for w in x)
        assert s == (d / (size(x) * size(y)) if d else 0.0)
    both = {(r["i"], r["j"]): (r["of_i"], r["of_j"]) for r in U.with_both(p, m, [F.col("content"), F.col("idx")]).collect()}
    assert both == {(i, j): ([texts[i], str(i)], [texts[j], str(j)]) for _, i, j in pairs}


def test_a_cluster_takes_few_rounds(spark, monkeypatch):
    """In a cluster all of whose pairs are merged a round settles two memories; the rest is streamed and not taken up in 40 rounds. Decisions are settled once a table."""
    calls = []
    monkeypatch.setattr(U, "forget", lambda *t: calls.append(t))
    rows = [("b", o, j, i, "MERGE") for o, (j, i) in enumerate((j, i) for j in range(60) for i in range(j))]
    d = spark.createDataFrame(rows, "bank string, ord long, idx_new long, idx_old long, decision string")
    assert {(r["bank"], r["ord"]) for r in U.acting(d, 0, 40).collect()} == loop(rows)
    assert len(calls) <= 2
    assert U._fold(d) is U._fold(d)


def test_prefixes_of_decisions_equal_the_loop(spark, monkeypatch):
    """Some decisions at a time, a task a bank: clusters, in which the first ones void most others, a chain and random pairs."""
    monkeypatch.setattr(U, "PREFIX", 200)
    rng = random.Random(8)
    rows = [(b, o, j, i, "MERGE") for b in ("p", "q") for o, (j, i) in enumerate((j, i) for j in range(45) for i in range(j))]
    rows += [("chain", o, o, o + 1, "SUPERSEDE") for o in range(90)] + [("r", o, rng.randrange(80), rng.randrange(80), rng.choice(["MERGE", "KEEP_BOTH"])) for o in range(300)]
    d = spark.createDataFrame(rows, "bank string, ord long, idx_new long, idx_old long, decision string")
    for rounds in (0, 40):
        got = U.acting(d, 100, rounds).collect()
        assert len(got) == len(loop(rows)) and {(r["bank"], r["ord"]) for r in got} == loop(rows)
    n = {b: [sum(1 for x in rows if x[0] == b), sum(1 for x in loop(rows) if x[0] == b)] for b in ("p", "q", "chain", "r")}
    stats = {r["bank"]: [r["decisions"], r["merged"] + r["superseded"], r["keep_both"]] for r in U.decision_stats(d).collect()}
    assert stats == {b: [a, k, a - k] for b, (a, k) in n.items()}


def test_parts_of_a_dimension_are_looked_up_for_acting_decisions_only(spark):
    d = spark.createDataFrame([("b", o, o, o + 1, "MERGE", "m", ("profile", "", None, None, None, ["k"])) for o in range(6)], "bank string, ord long, idx_new long, idx_old long, decision string, merged_content string, merged_dimension struct<memory_type:string,time:string,location:string,reason:string,purpose:string,keywords:array<string>>")
    m = spark.range(8).select(F.lit("b").alias("bank"), F.col("id").alias("idx"), F.lit("c").alias("content"), F.lit("fact").alias("memory_type"), *[F.lit("").alias(c) for c in ("time", "location", "reason", "purpose")], F.array(F.lit("w")).alias("keywords"))
    got = U.apply_dimensions(m, d)
    assert not [x for x in _plan(got).split("\n") if "LogicalRDD" in x and "merged_dimension" in x]  # those of the stored acting ones are joined
    assert sorted((r["seq"], r["origin"], r["memory_type"]) for r in got.collect()) == sorted([(s, "added", "profile") for s in (0, 2, 4)] + [(6, "kept", "fact"), (7, "kept", "fact")])


def test_pairs_are_not_joined_with_their_cosines(spark):
    m = spark.createDataFrame([("b", i, t) for i, t in enumerate(["a b", "a", "c", None])], "bank string, idx long, content string")
    p = spark.createDataFrame([("b", i, j, f"{i}{j}") for j in range(4) for i in range(j)], "bank string, i long, j long, note string")
    got = U.count_cosine(m, p)
    assert _plan(got).startswith("MapInArrow")
    assert {(r["i"], r["j"], r["note"]): round(r["similarity"], 9) for r in got.collect()} == {(i, j, f"{i}{j}"): round(0.5**0.5, 9) if (i, j) == (0, 1) else 0.0 for j in range(4) for i in range(j)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_counted_by_query_where_records_lie(spark):
    """Items of several parts and queries, some of them twice; one group of queries and several; nothing is shuffled."""
    rng = random.Random(5)
    letters = "ab c"
    texts = [(b, i, "".join(rng.choices(letters, k=rng.randint(0, 20)))) for b in ("x", "y") for i in range(30)] + [("x", 99, None), ("none", 1, "ab")]
    asked = [(b, q, p, "".join(rng.choices("ab", k=rng.randint(1, 2))), w) for b in ("x", "y", "absent") for q in range(6) for p, w in (("phrase", False), ("token", True), ("anchor", True)) for _ in range(2)]
    r, a = spark.createDataFrame(texts, "bank string, record_idx long, full string"), spark.createDataFrame(asked, "bank string, query_id long, part string, item string, word boolean")
    want: dict = {}
    for b, q, p, x, w in asked:
        for bi, i, t in texts:
            if b == bi and t is not None and (x in re.findall("[a-z0-9]+", t) if w else x in t):
                want.setdefault((q, b, i), {}).setdefault(p, 0)
                want[q, b, i][p] += 1
    parts = ["phrase", "token", "anchor"]
    for most in (10**6, 20):
        got = count_items(r, a, parts, most)
        assert "Aggregate" not in _plan(got) and "Join" not in _plan(got)
        assert sorted(tuple(x) for x in got.collect()) == sorted((*k, *[n.get(p, 0) for p in parts]) for k, n in want.items())


def test_cosines_are_those_of_the_column_function(spark):
    rng = random.Random(6)
    rows = [(b, i, None if i == 3 else [0.0] * 4 if i == 4 else [rng.uniform(-1, 1) for _ in range(4)]) for b in ("x", "y") for i in range(20)]
    v = spark.createDataFrame(rows, "bank string, record_idx long, embedding array<float>")
    q = v.where("record_idx < 7").select(F.col("record_idx").alias("query_id"), "bank", F.col("embedding").alias("vector"))
    rounded = lambda x: sorted(((r[0], r[1], None if r[2] is None else round(r[2], 9)) for r in x.collect()), key=str)
    want = rounded(R.per_bank(v, q).select("query_id", "record_idx", R.cosine(F.col("vector"), F.col("embedding"))))
    for most in (10**6, 12):
        got = R.cosines(v, q, most)
        assert "zip_with" not in _plan(got) and rounded(got) == want


def test_texts_and_times_are_read_once_a_record_not_once_a_query(spark):
    """Joins with all queries start from stored columns, so no expression over a text or a time is left for them to repeat."""
    rows = [("x", i, "word " * (i % 5), "why", "", "", "", "fact", ["word"], None) for i in range(20)]
    m = spark.createDataFrame(rows, "bank string, record_idx long, content string, reason string, purpose string, location string, time string, memory_type string, keywords array<string>, source_time timestamp_ntz")
    q = spark.createDataFrame([(i, "x", "word two", ["word"], "on 2024-01-05", ["fact"], "") for i in range(4)], "query_id long, bank string, anchor string, keywords array<string>, time string, types array<string>, location string")
    for got, n in ((R.answer_field_score(m, q.select("query_id", "bank", F.lit("content").alias("answer_field"))), 80), (R.time_matches(m, q), 80), (R.structured_scores(m, q), 80)):
        assert not re.search(r"\b(content|source_time)#", _plan(got)) and got.count() == n
    assert R.lexical_scores(m, q).count() == 80
    assert "Join" not in _plan(R.bm25_scores(m, q)) and R.bm25_scores(m, q).count() == 80


def test_counts_of_hits_are_not_broadcast(spark):
    """Counts are small as files and many as rows, so no join may build on them, whatever their files say."""
    rows = [("x", i, "word " * (i % 5), "why", "", "", "", "fact", ["word"], None) for i in range(20)]
    m = spark.createDataFrame(rows, "bank string, record_idx long, content string, reason string, purpose string, location string, time string, memory_type string, keywords array<string>, source_time timestamp_ntz")
    q = spark.createDataFrame([(i, "x", "word two", ["word"], "", ["fact"], "") for i in range(4)], "query_id long, bank string, anchor string, keywords array<string>, time string, types array<string>, location string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for got, n in ((R.search_lexical(m, q, 3), 12), (R.search_structured(m, q, 3), 12), (R.lexical_scores(m, q), 80)):
            lines, inside = got._jdf.queryExecution().sparkPlan().toString().split("\n"), None
            assert got.count() == n and any("/counts-" in x for x in lines)
            lines, sends = got._jdf.queryExecution().executedPlan().toString().split("\n"), 0
            for x in lines:
                depth = re.search(r"[A-Za-z]", x).start() if re.search(r"[A-Za-z]", x) else 0
                inside = None if inside is not None and depth <= inside else inside
                if "BroadcastExchange" in x and inside is None:
                    inside, sends = depth, sends + 1
                assert inside is None or "/counts-" not in x
            assert sends
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_bm25_scores_of_several_groups_of_queries(spark, monkeypatch):
    rows = [("x", i, f"a{i % 4} b{i % 3} " * (1 + i % 2), "", "", []) for i in range(30)]
    m, q = spark.createDataFrame(rows, MEM), spark.createDataFrame([(i, "x", f"a{i % 4} b{i % 3}", []) for i in range(8)], "query_id long, bank string, anchor string, keywords array<string>")
    one = sorted((r["query_id"], r["record_idx"], round(r["score"], 9)) for r in R.bm25_scores(m, q).collect())
    monkeypatch.setattr(R, "MAX_TERMS", 4)
    monkeypatch.setattr(R, "MAX_SCORES", 20)
    assert sorted((r["query_id"], r["record_idx"], round(r["score"], 9)) for r in R.bm25_scores(m, q).collect()) == one and one
