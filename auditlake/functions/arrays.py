"""Arrays inside a row: what windows do between rows, without moving any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def runs(items: Column, begins: Callable[[Column, Column], Column], body: Callable[[Column], Column]) -> Column:
    """Cut an array into runs and apply ``body`` to each; ``begins(before, item)`` tells whether
    an item starts a run. Every item is copied once."""

    def cut(xs: Column) -> Column:
        first = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | begins(F.get(xs, i - 1), x), i)),
                         lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda a, k: body(
            F.slice(xs, a + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - a))))

    return let(items, cut)


def _sums(values: Column, start: Column) -> Column:
    """Running sums by appending; for short arrays, as an append copies."""
    return F.aggregate(values, F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("all")), lambda a, x: let(
        a["s"] + x, lambda s: F.struct(s.alias("s"), F.array_append(a["all"], s).alias("all"))), lambda a: a["all"])


def running(values: Column) -> Column:
    """Running sums of a bigint array. They are taken in pieces of about the square root of the
    length, so that a long array is not copied for every item."""
    zero = F.lit(0).cast("bigint")

    def go(xs: Column, n: Column) -> Column:
        width = F.ceil(F.sqrt(n)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1, width), lambda a: _sums(F.slice(xs, a + 1, width), zero))
        return let(pieces, lambda ps: let(_sums(F.transform(ps, lambda p: F.element_at(p, -1)), zero), lambda ends: F.flatten(
            F.transform(ps, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: x + F.get(ends, k - 1)))))))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(go(xs, F.size(xs))))
