"""Small column combinators used where an expression needs a local name or a scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` by name."""
    return F.transform(F.array(value), body).getItem(0)


def _scan(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    # Two levels of blocks of about sqrt(n) keep a long array near-linear; a plain
    # re-fold of every prefix would be quadratic in the number of matches.
    def body(v: Column) -> Column:
        n = F.size(v)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

        def with_width(w: Column) -> Column:
            last = F.greatest(F.ceil(n / w).cast("int") - 1, F.lit(0))
            totals = F.transform(
                F.sequence(F.lit(0), last),
                lambda b: F.aggregate(F.slice(v, b * w + 1, w), zero, merge),
            )
            offsets = let(
                totals,
                lambda t: F.transform(
                    t, lambda _x, b: F.aggregate(F.slice(t, F.lit(1), b), zero, merge)
                ),
            )
            return let(
                offsets,
                lambda o: F.transform(
                    v,
                    lambda _x, i: F.aggregate(
                        F.slice(v, F.floor(i / w).cast("int") * w + 1, i % w),
                        F.get(o, F.floor(i / w).cast("int")),
                        merge,
                    ),
                ),
            )

        return let(width, with_width)

    return let(values, body)


def running_sum(values: Column) -> Column:
    """Exclusive prefix sums of an ``array<int>``."""
    return _scan(values, F.lit(0), lambda a, x: a + x)


def running_max(values: Column) -> Column:
    """Exclusive prefix maxima of a non-negative ``array<int>``."""
    return _scan(values, F.lit(0), lambda a, x: F.greatest(a, x))
