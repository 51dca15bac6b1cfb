"""Edge rows of the scalar functions, and small models of the windows, fusion and the decision fold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recallforge.functions import parsing as P
from recallforge.functions import text as T
from recallforge.functions import timespan as S
from recallforge.operators import retrieve as R
from recallforge.operators import segment as G
from recallforge.operators import upkeep as U


def one(spark, x, f, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("x", "y"), [(None, ""), ("", ""), ("  ", ""), ("\t a\n", "a"), (" b ", "b")])
def test_clean(spark, x, y):
    assert one(spark, x, T.clean) == y


@pytest.mark.parametrize("x", ["0", "false", "[]", "{}", "null", None])
def test_falsy_json_is_empty(spark, x):
    assert one(spark, x, T.clean_json) == ""


@pytest.mark.parametrize(("n", "size"), [(10, 10), (11, 4 + 5 + 2 + 5 + 3)])
def test_truncate(spark, n, size):
    assert len(one(spark, "x" * n, lambda c: T.truncate(c, 10, 4, 2, 3))) == size


def test_truncate_to_nothing(spark):
    assert one(spark, "abcdef", lambda c: T.truncate(c, 3, 0, 0, 0)) == "abcdef"
    assert one(spark, "abcdef", lambda c: T.truncate(c, 3, 0, 0, 0, keep_if_zero=False)) == ""


def test_tokens_drop_accents(spark):
    assert one(spark, "für A1-b!", T.tokens) == ["f", "r", "a1", "b"]


@pytest.mark.parametrize(("x", "y"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('pre {"a": 1} post', '{"a": 1}'), ("[1, 2] tail", "[1, 2]"), ("{bad [3]", "[3]"), ("none", None), ("", None)])
def test_json_strict(spark, x, y):
    assert one(spark, x, P.json_strict) == y


def test_chat_response_parts(spark):
    r = '{"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3}}'
    assert one(spark, r, P.message_content) == "hi"
    assert one(spark, r, P.usage).asDict() == {"prompt_tokens": 3, "completion_tokens": 0, "total_tokens": 0}
    assert one(spark, "{}", P.message_content) == ""


@pytest.mark.parametrize(("x", "hit"), [("on 2023-06-25", True), ("before 2023-06-25", False), ("before 2023-06-26", True), ("after 2023-06-25", False), ("after 2023-06-24", True), ("around 2023-06-28", True), ("around 2023-06-29", False), ("between 2023-06-24 and 2023-06-25", True), ("on 2023-13", False)])
def test_constraint_at_its_edges(spark, x, hit):
    assert one(spark, x, lambda c: S.meets(S.parse_time_constraint(c), S.parse_time_span(F.lit("2023-06-25")))) is hit


@pytest.mark.parametrize(("w", "o", "want"), [(25, -1, 5), (25, 30, 24), (5, -1, 1), (10, 0, 0)])
def test_overlap(w, o, want):
    assert G.overlap_of(w, o) == want


@pytest.mark.parametrize("clamp", [True, False])
@pytest.mark.parametrize(("n", "w", "o"), [(1, 5, 2), (4, 5, 2), (5, 5, 2), (6, 5, 2), (11, 5, 0), (11, 5, 4), (7, 3, 5)])
def test_windows_as_a_loop_makes_them(spark, n, w, o, clamp):
    step, at, want = max(1, w - o), 0, []
    while True:
        size = min(w, n - at)
        k = at // step
        want += [(k, i + 1, at + i + 1, size, 0 if k == 0 else (min(o, size) if clamp else o)) for i in range(size)]
        if at + w >= n:
            break
        at += step
    rows = spark.createDataFrame([(1, i) for i in range(1, n + 1)], "sample long, global_idx int")
    got = G.sliding_windows(rows, w, o, clamp).select("window_index", "pos", "global_idx", "message_count", "overlap_count").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_histories_and_conversations(spark):
    item = [("q1", [[("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "d")], [("user", "lost")]], ["2023/06/25 (Sun) 13:22", "2023/06/26 (Mon) 09:00"], ["s1"])]
    df = spark.createDataFrame(item, "question_id string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>, haystack_session_ids array<string>")
    rows = G.number_messages(G.flatten_histories(df)).orderBy("global_idx").select("session", "global_idx", "local_idx", T.iso(F.col("ts")).alias("ts"), "content").collect()
    assert list(map(tuple, rows)) == [("s1", 1, 1, "2023-06-25T13:22:00", "a"), ("s1", 2, 2, "2023-06-25T13:22:00.500000", "c"), ("session_0002", 3, 1, "2023-06-26T09:00:00", "d")]
    talk = [("c1", '{"speaker_a": "A", "session_10": [{"speaker": "A", "text": "late"}], "session_10_date_time": "8:56 pm on 20 July, 2023", "session_2": [{"speaker": "B", "text": "early"}], "session_2_date_time": "1:05 am on 3 May, 2023", "session_3": [{"speaker": "B", "text": "undated"}]}')]
    rows = G.number_messages(G.flatten_conversations(spark.createDataFrame(talk, "sample string, conversation string")), None).orderBy("global_idx").select("session", "speaker", "content", T.iso(F.col("ts")).alias("ts")).collect()
    assert list(map(tuple, rows)) == [("session_2", "B", "early", "2023-05-03T01:05:00"), ("session_10", "A", "late", "2023-07-20T20:56:00")]


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0]


def test_bm25_fills_up_and_breaks_ties(spark):
    mem = spark.createDataFrame([("b", i, t, "", "", []) for i, t in enumerate(["x y", "y", "x y", "", "z"])], "bank string, record_idx long, content string, reason string, purpose string, keywords array<string>")
    q = spark.createDataFrame([(1, "b", "x x", []), (2, "b", "nothing", [])], "query_id long, bank string, anchor string, keywords array<string>")
    got = R.search_bm25(mem, q, 4).orderBy("query_id", "rank").select("query_id", "record_idx").collect()
    assert list(map(tuple, got)) == [(1, 0), (1, 2), (1, 1), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_fusion_keeps_the_first_and_all_sources(spark):
    rows = [(1, "b", "two", 1, 0.5, 7, "Same"), (1, "b", "one", 2, 0.1, 8, " same "), (1, "b", "one", 1, 0.2, 9, "other"), (1, "b", "two", 2, 0.4, 6, ""), (1, "b", "off", 1, 0.4, 5, "off")]
    df = spark.createDataFrame(rows, "query_id long, bank string, route string, rank int, score double, record_idx long, content string")
    got = R.fuse(df, ["one", "two"]).orderBy("position").collect()
    assert [(r["record_idx"], [s["method"] for s in r["sources"]]) for r in got] == [(9, ["one"]), (8, ["one", "two"]), (6, ["two"])]
    assert [r["record_idx"] for r in R.fuse(df, ["one", "two"], T.normalize_content(F.col("content")), 1, True).collect()] == [9]


def test_decisions_as_a_loop_takes_them(spark):
    rng = random.Random(3)
    mem = [(b, i, f"c{i}") for b in ("p", "q") for i in range(12)]
    dec = [(b, k, rng.randrange(12), rng.randrange(12), rng.choice(["MERGE", "SUPERSEDE", "KEEP_BOTH", "?"]), rng.choice(["", "new"])) for b in ("p", "q") for k in range(25)]
    dec = [d for d in dec if d[2] != d[3]]
    want = []
    for b in ("p", "q"):
        gone, added = set(), []
        for _, k, new, old, action, text in (d for d in dec if d[0] == b):
            if action in ("MERGE", "SUPERSEDE") and new not in gone and old not in gone:
                gone |= {new, old}
                added.append((b, k, "added", new, text or f"c{new}"))
        want += [(b, i, "kept", i, f"c{i}") for i in range(12) if i not in gone] + added
    m = spark.createDataFrame(mem, "bank string, idx long, content string")
    d = spark.createDataFrame(dec, "bank string, ord int, idx_new long, idx_old long, decision string, merged_content string")
    assert sorted(map(tuple, U.apply_decisions(m, d).collect())) == sorted(want)


def test_source_time_formats(spark):
    rows = spark.createDataFrame([("2023-06-25T13:22:00",), ("2023-06-25T13:22:00.500000",), ("2023-06-25 13:22:00",), ("2023-06-25",), ("junk",), (None,)], "x string")
    assert [r[0] is None for r in rows.select(U.source_time(F.col("x"))).collect()] == [False] * 4 + [True] * 2
