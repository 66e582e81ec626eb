"""Small helpers for expressions made of Spark functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: named in a lambda, it can't be copied to where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def indices(first: Column | int, last: Column) -> Column:
    """first, ..., last; empty (not falling) where ``last`` is before ``first``."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def running_starts(sizes: Column, chunk: int = 256) -> Column:
    """Where each part begins if parts of these ``sizes`` (array<int>) follow each other.

    Sums are taken by chunks, so a long array costs its length times the chunk, not its square.
    """
    zero = lambda: F.array().cast("array<int>")

    def starts(part: Column, base: Column) -> Column:
        done = F.aggregate(part, F.struct(base.alias("at"), zero().alias("out")), lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
        return done["out"]

    def chunked(whole: Column) -> Column:
        parts = F.transform(indices(0, F.ceil((F.size(whole)) / chunk).cast("int") - 1), lambda c: F.slice(whole, c * chunk + 1, chunk))
        bases = lambda ps: starts(F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return let(parts, lambda ps: let(bases(ps), lambda bs: F.flatten(F.zip_with(ps, bs, starts))))

    return let(sizes, chunked)
