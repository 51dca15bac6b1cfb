"""Many phrases in many texts: one pass of an Aho-Corasick automaton over each text."""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.sources.shared import small_batches

#: Characters of phrases in one automaton (some 50 bytes of nodes each); more phrases are dealt over several, each of which passes over the texts.
MAX_CHARACTERS = 2_000_000

_TOKEN = re.compile("[a-z0-9]+")
_FOUND = "bank string, record_idx long, item string, word boolean"
_FOUND_ARROW = pa.schema([("bank", pa.string()), ("record_idx", pa.int64()), ("item", pa.string()), ("word", pa.bool_())])


def _scan(items):
    """(bank, record_idx, item, word) of the phrases in, and the words among the tokens of, each text (bank, record_idx, full)."""

    def run(batches):
        machines, words = {}, {}
        for bank, (phrases, wanted) in items.value.items():
            if phrases:
                machines[bank] = ahocorasick.Automaton()
                for p in phrases:
                    machines[bank].add_word(p, p)
                machines[bank].make_automaton()
            words[bank] = wanted
        for batch in batches:
            out = []
            for bank, idx, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                full = text.as_py() or ""
                if bank in machines:
                    out += [(bank, idx, p, False) for p in {p for _, p in machines[bank].iter(full)}]
                if words.get(bank):
                    out += [(bank, idx, w, True) for w in words[bank].intersection(_TOKEN.findall(full))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


def find_items(records: DataFrame, items: DataFrame, most: int = MAX_CHARACTERS) -> DataFrame:
    """(bank, record_idx, item, word) of ``items`` (bank, item, word; distinct, lower-cased, not empty) in ``records`` (bank, record_idx, full; lower-cased).

    A phrase (``word`` false) is found wherever it stands, a word where it is a token. Up to ``most`` characters of
    items, counted, make one broadcast; more are dealt by hash into so many groups, each with a pass of its own. No text meets a phrase in a join.
    """
    spark = records.sparkSession
    small_batches(spark)
    total = items.agg(F.sum(F.length("item") + 1)).first()[0] or 0
    groups = 1 + total // most
    texts, found = records.select(F.col("bank").cast("string").alias("bank"), F.col("record_idx").cast("long").alias("record_idx"), "full"), None
    for g in range(groups):
        own = items if groups == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        t = own.select(F.col("bank").cast("string").alias("bank"), "item", "word").toArrow()
        known: dict[str, tuple[set, set]] = {}
        for bank, item, word in zip(*(t.column(c).to_pylist() for c in ("bank", "item", "word")), strict=True):
            known.setdefault(bank, (set(), set()))[word].add(item)
        got = texts.mapInArrow(_scan(spark.sparkContext.broadcast(known)), _FOUND)
        found = got if found is None else found.unionByName(got)
    return found


#: Counts (8 bytes each) that a task holds at a time; places of items in queries in one broadcast.
MAX_COUNTS, MAX_ASKED = 1_000_000, 2_000_000


def _count(known, parts: list[str]):
    """(query_id, bank, record_idx, n_<part>) of the records (bank, record_idx, full) of a task with each query that has an item in them."""

    def run(batches):
        machines = {}
        for bank, (phrases, *_) in known.value.items():
            if phrases:
                machines[bank] = ahocorasick.Automaton()
                for p, at in phrases.items():
                    machines[bank].add_word(p, at)
                machines[bank].make_automaton()
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for name in rows.column(0).unique():
                bank = name.as_py()
                if bank not in known.value:
                    continue
                _, words, ids, first, cells = known.value[bank]
                own = rows.filter(pc.equal(rows.column(0), name)).combine_chunks()
                width = len(ids) * len(parts)
                step = max(1, MAX_COUNTS // width)
                for at in range(0, own.num_rows, step):
                    part, found = own.slice(at, step), []
                    for text in part.column(2).to_pylist():
                        full = text or ""
                        got = {i for _, i in machines[bank].iter(full)} if bank in machines else set()
                        got.update(words[w] for w in words.keys() & set(_TOKEN.findall(full)))
                        found.append(np.fromiter(got, np.int64, len(got)))
                    item = np.concatenate(found)
                    n = first[item + 1] - first[item]
                    pair = np.repeat(first[item] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                    count = np.bincount(np.repeat(row, n) * width + cells[pair], minlength=len(found) * width).reshape(-1, len(parts))
                    hits = np.flatnonzero(count.any(axis=1))
                    row, q = np.divmod(hits, len(ids))
                    banks = pa.array([bank]).take(pa.array(np.zeros(len(hits), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), banks, part.column(1).combine_chunks().take(pa.array(row)), *[pa.array(count[hits, i].astype(np.int64)) for i in range(len(parts))]], names=["query_id", "bank", "record_idx", *[f"n_{p}" for p in parts]])

    return run


def count_items(records: DataFrame, asked: DataFrame, parts: list[str], most: int = MAX_CHARACTERS) -> DataFrame:
    """(query_id, bank, record_idx, n_<part>) for pairs with a hit: how many of the items ``asked`` (bank, query_id, part, item, word) by a query stand in a record (bank, record_idx, full; lower-cased; one row a record).

    Items are found as by ``find_items`` and counted by query where the record lies, so neither finds nor pairs are shuffled.
    Over ``most`` characters or ``MAX_ASKED`` places of items, counted, the queries are dealt into groups with a pass each.
    """
    spark = records.sparkSession
    small_batches(spark)
    size = asked.agg(F.coalesce(F.sum(F.length("item") + 1), F.lit(0)), F.count(F.lit(1))).first()
    groups, out = 1 + max(size[0] // most, size[1] // MAX_ASKED), []
    texts = records.select(F.col("bank").cast("string").alias("bank"), F.col("record_idx").cast("long").alias("record_idx"), "full")
    place = {p: i for i, p in enumerate(parts)}
    for g in range(groups):
        own = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        t = own.select(F.col("bank").cast("string").alias("bank"), F.col("query_id").cast("long").alias("query_id"), "part", "item", "word").sort("bank").toArrow()
        known = {}
        for bank in t.column("bank").unique().to_pylist():
            x = t.filter(pc.equal(t.column("bank"), bank))
            ids, query = np.unique(x.column("query_id").to_numpy(), return_inverse=True)
            items: tuple[dict, dict] = ({}, {})
            at = np.array([items[w].setdefault(i, len(items[0]) + len(items[1])) for i, w in zip(x.column("item").to_pylist(), x.column("word").to_pylist(), strict=True)], np.int64)
            cells = query * len(parts) + np.array([place[p] for p in x.column("part").to_pylist()], np.int64)
            order = np.argsort(at, kind="stable")
            known[bank] = (*items, ids, np.searchsorted(at[order], np.arange(len(items[0]) + len(items[1]) + 1)), cells[order])
        got = texts.mapInArrow(_count(spark.sparkContext.broadcast(known), parts), f"query_id long, bank string, record_idx long, {', '.join(f'n_{p} long' for p in parts)}")
        out.append(got)
    return reduce(DataFrame.unionByName, out)
