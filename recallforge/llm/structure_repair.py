"""Least-cost repair of the turn structure of conversations.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles. A backward
dynamic program over (turn, state of the grammar) gives the cost to go from every
place; a forward walk then takes, among the edits that lie on a cheapest repair,
the one whose initial is least. Edits: Delete (2), Insert (5), Keep (0), Rerole (1).

Conversations of up to ``WHOLE`` turns are repaired in one go. Longer ones are cut into
pieces: a piece is a 4 x 4 matrix of least costs from state to state (products in which
sums take the place of products and minima that of sums), so costs to go at the borders follow from the
matrices, and each piece is walked on its own from the state in which the walk enters it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm._common import side, small_batches, stash

#: Turns up to which a conversation is repaired as one piece, and turns of a piece of a longer one.
WHOLE = 2_000

#: States: at the start, after s, after u, after a. What a state asks for next, where that leads, and what is left to pay at the end.
NEEDS, NEXT, END = "uuau", (2, 2, 3, 2), (0, 10, 5, 0)
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NAMES = {"u": "user", "a": "assistant"}
BLANK = " \t\n\x0b\x0c\r"
OK, EMPTY, AGAIN, CUT = range(4)
_FAR = 1 << 60


def kind_of(text: str) -> int:
    """EMPTY without a character that is not blank, CUT if the last such character ends no sentence, else OK; AGAIN is for the caller."""
    body = text.strip(BLANK)
    return EMPTY if not body else OK if body[-1] in ".!?" else CUT


def _options(initial: str, kind: int, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, state after it) of the edits that take a turn, in the order of their initials; Insert takes none."""
    yield 2, "D", state
    if kind in (OK, CUT):
        extra = 5 if kind == CUT else 0
        if (initial, state) in KEEPS:
            yield extra, "K", KEEPS[initial, state]
        yield 1 + extra, "R", NEXT[state]


def _before(initial: str, kind: int, after: list[int]) -> list[int]:
    """Costs to go before a turn out of those after it; up to two turns may be inserted ahead of it (three never pay)."""
    plain = [min(c + after[t] for c, _, t in _options(initial, kind, s)) for s in range(4)]
    return [min(plain[s], 5 + plain[NEXT[s]], 10 + plain[NEXT[NEXT[s]]]) for s in range(4)]


def costs_to_go(initials: list[str], kinds: list[int], end: list[int]) -> list[list[int]]:
    """Costs to go before each turn and, last, after all of them (``end``)."""
    out = [list(end)]
    for i, k in zip(reversed(initials), reversed(kinds), strict=True):
        out.append(_before(i, k, out[-1]))
    return out[::-1]


def matrix(initials: list[str], kinds: list[int]) -> list[int]:
    """Least cost from each state before the turns to each state after them, row by row."""
    columns = [costs_to_go(initials, kinds, [0 if s == t else _FAR for s in range(4)])[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(initials: list[str], kinds: list[int], costs: list[list[int]], state: int, tail: bool) -> tuple[str, int]:
    """(edits, state at the end) of the ASCII-least of the cheapest repairs; with ``tail`` turns may be inserted at the very end."""
    edits, i, n = [], 0, len(initials)
    while i < n:
        delete, *others = _options(initials[i], kinds[i], state)
        options = [(delete, 1), ((5, "I", NEXT[state]), 0), *((o, 1) for o in others)]
        (_, edit, state), step = next((o, d) for o, d in options if o[0] + costs[i + d][o[2]] == costs[i][state])
        edits.append(edit)
        i += step
    while tail and costs[n][state]:
        edits.append("I")
        state = NEXT[state]
    return "".join(edits), state


def _repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that are there after ``edits``."""
    out, i = [], 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        role, text = (roles[i], texts[i]) if e == "K" else (NAMES[NEEDS[state]], "" if e == "I" else texts[i])
        state = KEEPS[role[:1], state] if e == "K" else NEXT[state]
        i += e != "I"
        out.append((e, role, text))
    return out


_TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_OUT = "conv_id long, piece long, pieces int, first_turn long, last_turn long, distinct_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<edit string, role string, text string>>"
_OUT_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("pieces", pa.int32()), *[(c, pa.int64()) for c in ("first_turn", "last_turn", "distinct_turns", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("turns", pa.list_(_TURN))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _runs(batches, width: int):
    """(key, list of rows) of equal first columns in a row, over the borders of batches; None as key of a batch's end."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:width] != key:
                yield key, rows
                rows = []
            key = row[:width]
            rows.append(row)
        yield None, []
    if rows:
        yield key, rows


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _whole(batches):
    """Repair the conversations of a partition sorted by conversation, turn, role and text."""
    out: list[tuple] = []
    for key, rows in _runs(batches, 1):
        if key is None:
            yield _batch(out, _OUT_ARROW)
            out = []
            continue
        roles, texts = [r[2] for r in rows], [r[3] for r in rows]
        initials, seen, kinds = [r[:1] for r in roles], set(), []
        for role, text in zip(roles, texts, strict=True):
            kind = kind_of(text)
            kinds.append(AGAIN if kind != EMPTY and (role, text) in seen else kind)
            seen.add((role, text))
        costs = costs_to_go(initials, kinds, END)
        edits, _ = walk(initials, kinds, costs, 0, True)
        turns = [r[1] for r in rows if r[1] is not None]
        out.append((key[0], 0, 1, min(turns, default=None), max(turns, default=None), len(set(turns)), *(kinds.count(k) for k in (EMPTY, AGAIN, CUT)), _illegal(initials), costs[0][0], edits, _repaired(edits, 0, roles, texts)))
    yield _batch(out, _OUT_ARROW)


# Long conversations, in pieces.

_ROWS = "conv_id long, piece long, at long, turn long, role string, text string, kind int, initial string"
_ROWS_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("kind", pa.int32()), ("initial", pa.string())])
_PIECE = "conv_id long, piece long, m array<long>, first string, last string, first_turn long, last_turn long, distinct_turns long, illegal long"
_PIECE_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("m", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("distinct_turns", pa.int64()), ("illegal", pa.int64())])


def _cut(size: int):
    """Number the rows of a sorted partition and the pieces of ``size`` rows in it; pieces come in the order of turns over all partitions."""

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, last = (n + 1 if (conv,) == last else 0), (conv,)
                out.append((conv, (part << 32) + n // size, n, turn, role, text, kind_of(text), role[:1]))
            yield _batch(out, _ROWS_ARROW)

    return run


def _sum_up(batches):
    """What a piece, sorted (conv_id, piece, at, turn, kind, initial), adds to its conversation."""
    out = []
    for key, rows in _runs(batches, 2):
        if key is not None:
            turns, initials = [r[3] for r in rows if r[3] is not None], [r[5] for r in rows]
            out.append((*key, matrix(initials, [r[4] for r in rows]), initials[0], initials[-1], min(turns, default=None), max(turns, default=None), len(set(turns)), _illegal(initials)))
    yield _batch(out, _PIECE_ARROW)


_BORDER = "array<struct<piece:long,number:int,pieces:int,first_turn:long,last_turn:long,distinct_turns:long,illegal:long,after:array<long>>>"


def _borders(pieces):
    """Costs to go after each piece of a conversation, from the last one back; what counts over a border goes to the later piece."""
    out, after = [], list(END)
    for p in reversed(pieces):
        out.append([p["piece"], 0, len(pieces), p["first_turn"], p["last_turn"], p["distinct_turns"], p["illegal"], after])
        after = [min(p["m"][4 * s + t] + after[t] for t in range(4)) for s in range(4)]
    out.reverse()
    for n, row in enumerate(out):
        row[1] = n
        if n:
            row[6] += pieces[n - 1]["last"] + pieces[n]["first"] not in ("su", "ua", "au")
            row[5] -= pieces[n - 1]["last_turn"] is not None and pieces[n - 1]["last_turn"] == pieces[n]["first_turn"]
    return [tuple(r) for r in out]


def _exits(batches):
    """The state in which the walk leaves a piece for each in which it may enter; ``number + 1 == pieces`` has the end."""
    out = []
    for key, rows in _runs(batches, 2):
        if key is not None:
            initials, kinds = [r[5] for r in rows], [r[4] for r in rows]
            costs = costs_to_go(initials, kinds, rows[0][6])
            out.append((*key, [walk(initials, kinds, costs, s, False)[1] for s in range(4)]))
    yield _batch(out, pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("exits", pa.list_(pa.int32()))]))


def _entries(pieces):
    out, state = [], 0
    for p in pieces:
        out.append((p["piece"], state))
        state = p["exits"][state]
    return out


def _emit(batches):
    """Walk each piece from its entry: rows (conv_id, piece, at, kind, initial, role, text, state, number, pieces, first_turn, last_turn, distinct_turns, illegal, after)."""
    out: list[tuple] = []
    for key, rows in _runs(batches, 2):
        if key is None:
            yield _batch(out, _OUT_ARROW)
            out = []
            continue
        kinds, initials = [r[3] for r in rows], [r[4] for r in rows]
        state, number, pieces, first, last, distinct, illegal, after = rows[0][7:]
        costs = costs_to_go(initials, kinds, after)
        edits, end = walk(initials, kinds, costs, state, number + 1 == pieces)
        spent = costs[0][state] - (0 if number + 1 == pieces else after[end])
        out.append((key[0], number, pieces, first, last, distinct, *(kinds.count(k) for k in (EMPTY, AGAIN, CUT)), illegal, spent, edits, _repaired(edits, state, [r[5] for r in rows], [r[6] for r in rows])))
    yield _batch(out, _OUT_ARROW)


def _in_pieces(own: DataFrame, size: int) -> DataFrame:
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    dealt = own.repartitionByRange(*order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    rows = stash(dealt.mapInArrow(_cut(size), _ROWS), "turns")
    # A turn is a repeat unless it is the first of its role and text; pieces and places tell turns of a conversation apart.
    place = F.struct("piece", "at")
    first = rows.where(F.col("kind") != EMPTY).groupBy("conv_id", F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256).alias("what")).agg(F.min(place).alias("p")).select(F.col("conv_id").alias("c"), "p.*")
    same = rows["conv_id"].eqNullSafe(first["c"]) & (rows["piece"] == first["piece"]) & (rows["at"] == first["at"])
    kinds = rows.select("conv_id", "piece", "at", "turn", "kind", "initial").join(first, same, "left").select("conv_id", rows["piece"], rows["at"], "turn", F.when((F.col("kind") == EMPTY) | F.col("c").isNotNull(), F.col("kind")).otherwise(AGAIN).alias("kind"), "initial")
    kinds = stash(kinds, "kinds")
    sort = lambda df: df.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at")
    sums = stash(sort(kinds).select("conv_id", "piece", "at", "turn", "kind", "initial").mapInArrow(_sum_up, _PIECE), "pieces")
    fields = ["piece", "m", "first", "last", "first_turn", "last_turn", "distinct_turns", "illegal"]
    # A conversation has at most a piece for each partition and each WHOLE turns, a few numbers a piece.
    borders = sums.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("p")).select("conv_id", F.explode(F.udf(_borders, _BORDER)("p")).alias("x")).select("conv_id", "x.*")
    borders = stash(borders, "borders")
    after = side(borders.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "after"))
    exits = sort(kinds.join(after, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).select("conv_id", "piece", "at", "turn", "kind", "initial", "after")).mapInArrow(_exits, "conv_id long, piece long, exits array<int>")
    entries = exits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "exits"))).alias("p")).select("conv_id", F.explode(F.udf(_entries, "array<struct<piece:long,state:int>>")("p")).alias("x")).select(F.col("conv_id").alias("c"), F.col("x.piece").alias("p"), "x.state")
    known = stash(borders.join(entries, borders["conv_id"].eqNullSafe(F.col("c")) & (borders["piece"] == F.col("p"))).select(F.col("c"), F.col("p"), "state", "number", "pieces", "first_turn", "last_turn", "distinct_turns", "illegal", "after"), "known")
    texts = rows.select(F.col("conv_id").alias("tc"), F.col("piece").alias("tp"), F.col("at").alias("ta"), "role", "text")
    whole = kinds.join(texts, F.col("conv_id").eqNullSafe(F.col("tc")) & (F.col("piece") == F.col("tp")) & (F.col("at") == F.col("ta"))).join(side(known), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    return sort(whole).select("conv_id", "piece", "at", "kind", "initial", "role", "text", "state", "number", "pieces", "first_turn", "last_turn", "distinct_turns", "illegal", "after").mapInArrow(_emit, _OUT)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", whole: int = WHOLE) -> DataFrame:
    """Repaired conversations, a row each (a row a piece for those of over ``whole`` turns, ``pieces`` in all, numbered by ``piece``).

    Turns are ordered by ``turn`` (null first), ties by role, then text. Columns: first_turn, last_turn and
    distinct_turns (nulls not counted), the numbers of blank, duplicate, truncated and illegally following turns, cost, audit (initials
    of the edits), ``turns`` (edit, role, text) as they are after it. Sums over the pieces are those of the conversation.
    Null roles and texts are one space; a null ``conv`` is a conversation of its own; no rows give no rows.
    """
    small_batches(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    counts = stash(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select(F.col("conv_id").alias("long_id")), "long")
    if counts.limit(1).count() == 0:
        few, pieces = own, None
    else:
        listed = F.col("conv_id").eqNullSafe(F.col("long_id"))
        few, pieces = own.join(side(counts), listed, "left_anti"), _in_pieces(own.join(side(counts), listed, "left_semi"), whole)
    done = few.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(_whole, _OUT)
    return done if pieces is None else done.unionByName(pieces)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32(``conv_id:turn``) % 20: 0 drops a turn, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fault")).where("fault <> 0")
    text: Column = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return r.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


_NONE = hashlib.sha256(b"").hexdigest()


def _digest(batches):
    """SHA-256 of the pieces (conv_id, piece, text, n) of each conversation, those without turns left out, and its audit."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    sha, last, audit, any_yet, out = hashlib.sha256(), None, [], False, []
    for batch in batches:
        for conv, _, text, edits, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv,) != last:
                if last:
                    out.append((*last, "".join(audit), sha.hexdigest()))
                sha, last, audit, any_yet = hashlib.sha256(), (conv,), [], False
            if n:
                sha.update((b"\n" if any_yet else b"") + text.encode())
                any_yet = True
            audit.append(edits)
    if last:
        out.append((*last, "".join(audit), sha.hexdigest()))
    yield _batch(out, schema)


def op12_cost_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table repaired; one that lost all its turns has zeros and empty strings."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair(damage(table))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    numbers = ["distinct_turns", "blank", "duplicate", "truncated", "illegal", "cost"]
    flat = stash(done.select("conv_id", "piece", "pieces", "first_turn", "last_turn", *numbers, "audit", F.when(F.col("pieces") == 1, F.sha2(text, 256)).alias("repaired_sha256"), F.when(F.col("pieces") > 1, text).alias("text"), F.size("turns").alias("n")), "repaired")
    gaps = (F.coalesce(F.col("last_turn") - F.col("first_turn") + 1, F.lit(0)) - F.col("distinct_turns")).alias("gaps")
    ends = ["gaps", *numbers[1:], "audit", "repaired_sha256"]
    one = flat.where("pieces = 1").select(F.col("conv_id").alias("c"), gaps, *ends[1:])
    many = flat.where("pieces > 1")
    sums = many.groupBy("conv_id").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), *[F.sum(c).alias(c) for c in numbers])
    read = many.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "piece", "text", "audit", "n").mapInArrow(_digest, "conv_id long, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "d")
    long = sums.join(read, F.col("conv_id").eqNullSafe(F.col("d"))).select(F.col("conv_id").alias("c"), gaps, *ends[1:])
    ids = table.select("conv_id").distinct()
    found = ids.join(one.unionByName(long), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ends[:-2]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_NONE)).alias("repaired_sha256"))
