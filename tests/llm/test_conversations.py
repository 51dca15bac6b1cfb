"""Operators over conversations and licences against brute force, on the small tables and on rows of edge cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from recallforge.llm import license_scan as LS
from recallforge.llm import prefix_trie as PT
from recallforge.llm import structure_repair as SR

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def edge_turns():
    rows = [(5, 0, "user", "a"), (5, 1, "assistant", "b."), (5, None, None, "first"), (6, 0, "user", "é"), (6, 0, "user", "c"), (6, 0, "user", "c"), (7, 3, "system", None), (7, 4, "user", ""), (11, 0, "user", "only"), (13, 2, "user", "x!"), (13, 9, "tool", "y"), (-3, 1, "user", "minus")]
    rows += [(20, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 50}.") for t in range(300)]  # long and repeating
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t < 3 else f"{c % 3} {t}") for c in range(30, 90) for t in range(c % 7)]
    return rows


# Trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    for own in turns.values():
        own.sort()
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple((r, x) for _, r, x in turns.get(c - c % 5, [])[:h]) + tuple((r, x) for _, r, x in own[h:])
    members, last = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        last[rebuilt[c]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += children[node] == 0
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), children[n], leaves[n], saved[n], sha(",".join(map(str, last[n])))) for n, m in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_trie(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*TRIE).collect())


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_trie(PT.op11_partial_tries(spark, SF)) == brute_trie(rows)


@pytest.mark.parametrize(("fan", "part", "block"), [(64, 1000, 128), (2, 3, 4)])
def test_trie_of_edge_cases(spark, monkeypatch, fan, part, block):
    """Nulls, ties, repeats, ids below 0, turnless conversations, many equal openings and long ones, in many small parts and blocks too."""
    monkeypatch.setattr(PT, "FAN", fan)
    monkeypatch.setattr(PT, "PART", part)
    monkeypatch.setattr(PT, "BLOCK", block)
    rows = [*edge_turns(), (None, 0, "user", "nobody's")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], CONV + ", a long, d long").repartition(5)
    assert as_trie(PT.trie(*PT.rebuild(PT.ordered_turns(df)))) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert PT.trie(*PT.rebuild(PT.ordered_turns(spark.createDataFrame([], CONV)))).count() == 0


# Repair


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        space = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        r, x = space(r), space(x)
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute_repair(turns):
    """Cheapest, then ASCII-least edits by a search of all edit sequences in the order (cost, edits)."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, kinds = set(), []
    for _, r, x in turns:
        body = x.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "ok")
        seen.add((r, x))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in follow:
                heapq.heappush(heap, (cost + 5, edits + "I", i, role[0], (*out, f"{role}:")))
        if i < len(turns):
            _, r, x = turns[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, out))
            if kinds[i] in ("ok", "truncated"):
                more = 5 * (kinds[i] == "truncated")
                for role, edit, price in ((r, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (state, role[:1]) in follow:
                        heapq.heappush(heap, (cost + price + more, edits + edit, i + 1, role[:1], (*out, f"{role}:{x}")))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, edits, sha("\n".join(out))


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = defaultdict(list)
    for c, *turn in brute_damage(rows):
        left[c].append(tuple(turn))
    want = sorted((c, *brute_repair(left[c])) for c in {r[0] for r in rows})
    got = SR.op12_cost_to_go(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want


def random_turns(seed):
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b", " ", "", None, "c!", "d", "long text.", "é?", "x\n."]))
    return [(c, rng.choice([None, t, t, t, t - 1]), *pick()) for c in [*range(60), None] for t in range(rng.randint(0, 14))] + [(100 + c, t, *pick()) for c in range(3) for t in range(120)]


@pytest.mark.parametrize("whole", [2_000, 7])
def test_repair_of_random_turns(spark, tmp_path, monkeypatch, whole):
    """Any roles, nulls, blanks, ties and repeats; with pieces of 7 turns all longer conversations go over borders."""
    rows = random_turns(3)
    own = lambda f: lambda *a, **b: f(*a, **b | {"whole": whole})
    monkeypatch.setattr(SR, "repair", own(SR.repair))
    path = f"{tmp_path}/{whole}"
    spark.createDataFrame([(*r, 1, "x") for r in rows], CONV + ", piece long, at string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    left = defaultdict(list)
    for c, *turn in brute_damage(rows):
        left[c].append(tuple(turn))
    want = {c: brute_repair(left[c]) for c in {r[0] for r in rows}}
    got = {r[0]: tuple(r)[1:] for r in SR.op12_cost_to_go(spark, path).collect()}
    assert got == want


def test_repair_of_nothing(spark):
    assert SR.repair(spark.createDataFrame([], CONV)).count() == 0


def test_repaired_turns_are_given(spark):
    r = SR.repair(spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "So."), (1, 2, "user", "")], CONV)).first()
    assert (r["audit"], r["cost"]) == ("RKD", 3) and [tuple(t) for t in r["turns"]] == [("R", "user", "Hello."), ("K", "assistant", "So.")]


# Licences


def brute_places(texts):
    """By text: (label, base, start, share), all places tried for every template."""
    words = {x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for x in texts}
    indexed = {w for _, text, _ in LS.TEMPLATES for w in text.split() if len(w) >= LS.LETTERS}
    df = Counter(w for _, x in enumerate(texts) for w in indexed & set(words[x]))
    out = {}
    for x, ws in words.items():
        found = [(label, True, s, 1.0) for p, label in LS.BASE for s in range(len(ws)) if ws[s : s + len(p.split())] == p.split()]
        looked = set(sorted(indexed & set(ws), key=lambda w: (df[w], w))[: LS.RAREST])
        for label, text, keys in LS.TEMPLATES:
            t = text.split()
            must = LS._key_places(text, keys)
            least = min(LS.VOTES, sum(len(w) >= LS.LETTERS for w in t))
            for s in range(-len(t), len(ws)):
                there = [i for i, w in enumerate(t) if 0 <= s + i < len(ws) and ws[s + i] == w]
                if must <= set(there) and sum(t[i] in looked for i in there) >= least:
                    found.append((label, False, s, len(there) / len(t)))
        out[x] = (len(ws), found)
    return out


def licence_rows():
    notices = [text for _, text, _ in LS.TEMPLATES]
    rng = random.Random(5)
    texts = [None, "", "  ", "MIT License", "mit\nlicense, Mit LICENSE!", "cc-by 4.0; CC BY", "GNU General Public  License gnu general public license", "apache éapache license", "İmit license", "license mit"]
    texts += [f"x {n.upper()} y" for n in notices] + [n.replace(" the ", " a ", 1) for n in notices] + [" ".join(n.split()[3:]) for n in notices] + [" ".join(n.split()[:-4]) for n in notices]
    texts += [" ".join(rng.choice(" ".join(notices).split()) for _ in range(200)) for _ in range(20)] + ["license software mit " * 3_000 + notices[0]]
    return [*enumerate(texts), (3, "MIT License"), (3, "another text of id 3: apache license"), (None, notices[2]), (None, None)]


def test_licences_of_edge_cases(spark, tmp_path):
    rows = licence_rows()
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, h long, word string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    known = brute_by_rows(rows)
    got = Counter(tuple(r) for r in LS.op13_rare_token_index(spark, str(tmp_path)).collect())
    assert got == Counter(known)


def brute_by_rows(rows):
    distinct = sorted({(d, x or "") for d, x in rows}, key=repr)
    places = brute_places([x for _, x in distinct])
    out = []
    for d, x in rows:
        n, found = places[x or ""]
        base = [p for p in found if p[1]]
        starts = [p[2] for p in base]
        out.append((d, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[0] for p in base})), ",".join(sorted({p[0] for p in found})), max((p[3] for p in found), default=0.0)))
    return out


def test_licences_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_by_rows(rows)
    assert sorted(map(repr, (tuple(r) for r in LS.op13_rare_token_index(spark, SF).collect()))) == sorted(map(repr, want))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(repr, con.sql(LS.OP13_SQL).fetchall())) == sorted(map(repr, want))


def test_licences_of_nothing(spark):
    files, places = LS.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert files.count() == 0 and places.count() == 0
