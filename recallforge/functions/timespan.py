"""Time spans and time constraints as columns: closed intervals struct(start, end, granularity)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallforge.functions.text import clean

#: Days added on each side of ``around`` by granularity.
AROUND_DAYS = {"day": 3, "month": 31, "year": 366, "datetime": 1}
_SPAN = "struct<start:timestamp_ntz,end:timestamp_ntz,granularity:string>"


def _ntz(x: Column) -> Column:
    return F.try_to_timestamp(x).cast("timestamp_ntz")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def _day_end(x: Column) -> Column:
    return x + F.expr("interval '0 23:59:59.999999' day to second")


def parse_time_span(x: Column) -> Column:
    """Year, month or day as a closed interval, an ISO date and time as a point (its offset is dropped); else null, also for impossible dates."""
    t = clean(x)
    day, month, year = _ntz(F.concat(t, F.lit(" 00:00:00"))), _ntz(F.concat(t, F.lit("-01 00:00:00"))), _ntz(F.concat(t, F.lit("-01-01 00:00:00")))
    stamp = F.regexp_replace(F.regexp_replace(t, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), "T", " ")
    point = _ntz(F.when(F.length(stamp) == 16, F.concat(stamp, F.lit(":00"))).otherwise(stamp))
    span = lambda a, b, g: F.when(a.isNotNull(), F.struct(a.alias("start"), b.alias("end"), F.lit(g).alias("granularity")))
    return (
        F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), span(day, _day_end(day), "day"))
        .when(t.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), span(month, _day_end(F.last_day(month).cast("timestamp_ntz")), "month"))
        .when(t.rlike("^[0-9]{4}$"), span(year, _day_end(F.last_day(year + F.expr("interval '11' month")).cast("timestamp_ntz")), "year"))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"), span(point, point, "datetime"))
        .cast(_SPAN)
    )


def parse_time_constraint(x: Column) -> Column:
    """struct(op, start, end, granularity) of ``between A and B``, ``on/before/after/around X`` or a bare X (as on); null if a part is no time.

    ``before`` has only an end (the start of X), ``after`` only a start (the end of X).
    """
    t = clean(x)
    two = r"(?i)^between\s+(.+?)\s+and\s+(.+)$"
    one = r"(?i)^(on|before|after|around)\s+(.+)$"
    op = F.lower(F.regexp_extract(t, one, 1))
    op = F.when(op == "", F.lit("on")).otherwise(op)
    single = F.when(t.rlike(one), F.regexp_extract(t, one, 2)).otherwise(t)
    read = F.transform(F.array(F.regexp_extract(t, two, 1), F.regexp_extract(t, two, 2), single), parse_time_span)
    none = F.lit(None).cast("timestamp_ntz")
    order = F.create_map(*[F.lit(v) for g, o in (("datetime", 0), ("day", 1), ("month", 2), ("year", 3)) for v in (g, o)])

    def made(o: Column, lo: Column, hi: Column, g: Column) -> Column:
        return F.struct(o.alias("op"), lo.alias("start"), hi.alias("end"), g.alias("granularity"))

    def build(spans: Column) -> Column:
        a, b, s = spans[0], spans[1], spans[2]
        days = F.expr("interval '0' day")
        for g, n in AROUND_DAYS.items():
            days = F.when(s["granularity"] == g, F.expr(f"interval '{n}' day")).otherwise(days)
        coarser = F.when(order[a["granularity"]] >= order[b["granularity"]], a["granularity"]).otherwise(b["granularity"])
        alone = (
            F.when(s.isNull(), F.lit(None))
            .when(op == "before", made(op, none, s["start"], s["granularity"]))
            .when(op == "after", made(op, s["end"], none, s["granularity"]))
            .when(op == "around", made(op, s["start"] - days, s["end"] + days, s["granularity"]))
            .otherwise(made(op, s["start"], s["end"], s["granularity"]))
        )
        return F.when(t.rlike(two), F.when(a.isNotNull() & b.isNotNull(), made(F.lit("between"), a["start"], b["end"], coarser))).otherwise(alone)

    return _let(read, build)


def meets(constraint: Column, span: Column) -> Column:
    """Closed overlap for on, between and around; strictly before or after for those. Null spans and constraints do not meet."""
    c, s = constraint, span
    got = F.when(c["op"] == "before", s["end"] < c["end"]).when(c["op"] == "after", s["start"] > c["start"]).otherwise((s["start"] <= c["end"]) & (s["end"] >= c["start"]))
    return F.coalesce(got, F.lit(False))


def constraint_score(constraints: Column, spans: Column) -> Column:
    """Share of the constraints (array) that any span (array) meets; 0 without constraints."""
    hit = F.size(F.filter(constraints, lambda c: F.exists(F.array_compact(spans), lambda s: meets(c, s))))
    return F.when(F.size(constraints) > 0, hit / F.size(constraints)).otherwise(F.lit(0.0))
