"""Percentiles of very large numeric columns.

Method: exact bisection. For each group and percentile an interval of values is
kept; a pass counts the rows up to middles inside all intervals at once, and the
part that holds the target rank stays, until no interval is wider than the error
that is allowed. Values are bisected as 64-bit integers in their order, so there
is an end after 64 halvings whatever the range. The passes run over counts of
values per group, which are made per part (dataset, day) and simply add up; rows
outside all open intervals are left behind, so of a continuous column each pass
reads a part only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chronocount.session import cut

#: Parts that a pass divides each interval into: three halvings at once.
WAYS = 8


def value_counts(rows: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``groups, v, n``: how often each value occurs in each group; the summary that can be combined.

    Summaries of different parts are combined by ``unionByName`` or by leaving
    the part out of a later ``value_counts(..., weight="n")``. Null and NaN values count
    nowhere; null group keys are groups. ``v`` is a double.
    """
    v = F.col(value).cast("double")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("v")).agg(n.cast("bigint").alias("n"))


def _image(v: np.ndarray) -> np.ndarray:
    bits = (v.astype(np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _to_image(v: pd.Series) -> pd.Series:
    return pd.Series(_image(v.to_numpy()))


def _from_image(i: pd.Series) -> pd.Series:
    bits = i.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def image(v: Column) -> Column:
    """A double as a 64-bit integer of the same order; -0.0 is 0.0."""
    return pandas_udf(_to_image, "bigint")(v)


def from_image(i: Column) -> Column:
    """The double of an image."""
    return pandas_udf(_from_image, "double")(i)


def percentiles(summary: DataFrame, groups: Sequence[str], at: Sequence[float], error: float = 0.0, whole: bool = False) -> DataFrame:
    """``groups, n, p, value`` for each group of a ``value_counts`` summary and each percentile of ``at``.

    The percentile p of n values is the smallest value with at least p * n
    values up to it (the first value for p = 0). ``value`` is not below it and
    above by ``error`` at most; an ``error`` of 0 gives the percentile itself.
    With ``whole`` the values are whole numbers (bisected as such, in fewer
    passes). An empty summary gives no rows. Infinite values are values.
    """
    keys, count = list(groups), len(at)
    v = F.col("v").cast("bigint") if whole else image(F.col("v"))
    data = cut(summary.select(F.struct(*keys).alias("g"), v.alias("v"), "n").groupBy("g", "v").agg(F.sum("n").alias("n")).filter("n > 0"))
    ends = data.groupBy("g").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    # An interval is open below and closed above, and a rank counts from its lower end: the rank-th row of (low, high] is looked for.
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).cast("bigint")
    state = ends.select("g", "n", *[x for i, p in enumerate(at) for x in (rank(p).alias(f"r{i}"), (F.col("least") - 1).alias(f"low{i}"), F.col("most").alias(f"high{i}"))])
    each, parts, turn = range(count), range(1, WAYS), 0
    # The passes' expressions are SQL texts: there are many of them.
    inside = [f"(open{i} AND v > low{i} AND v <= high{i})" for i in each]
    sums = [F.expr(f"sum(CASE WHEN {inside[i]} AND v <= {middle(i, j)} THEN n ELSE 0 END) AS c{i}_{j}") for i in each for j in parts]
    while True:
        state = cut(state)
        # Open: wider than allowed and still to be divided.
        if whole:
            open_ = [F.expr(f"high{i} - low{i} > {int(max(error, 1.0))}") for i in each]
        else:
            wide = lambda i: from_image(F.col(f"high{i}")) - from_image(F.col(f"low{i}") + 1) > error
            open_ = [F.expr(f"high{i} > low{i} + 1") & (wide(i) if error else F.lit(True)) for i in each]
        marked = state.select("*", *[o.alias(f"open{i}") for i, o in enumerate(open_)])
        busy = marked.filter(" OR ".join(f"open{i}" for i in each)).drop("n", *[f"r{i}" for i in each])
        if busy.isEmpty():
            break
        if turn in (1, 2, 4):
            # What lies outside all intervals is not read again.
            data = cut(data.join(busy, "g").filter(" OR ".join(inside)).select("g", "v", "n"))
        counted = data.join(busy, "g").filter(" OR ".join(inside)).groupBy("g").agg(*sums)
        moved = []
        for i in each:
            # The part whose counts reach the rank first; before it the rank falls by what lies below.
            reached = [f"WHEN c{i}_{j} >= r{i} THEN {j}" for j in parts]
            moved.append(F.expr(f"CASE WHEN NOT open{i} THEN NULL {' '.join(reached)} ELSE {WAYS} END AS part{i}"))
        at_part = lambda i, last, f: " ".join(f"WHEN {j} THEN {f(j)}" for j in last)
        stepped = marked.join(counted, "g", "left").select("*", *moved)
        state = stepped.select("g", "n", *[F.expr(x) for i in each for x in (
            f"CASE part{i} {at_part(i, range(2, WAYS + 1), lambda j: f'r{i} - c{i}_{j - 1}')} ELSE r{i} END AS r{i}",
            f"CASE part{i} {at_part(i, range(2, WAYS + 1), lambda j: middle(i, j - 1))} ELSE low{i} END AS low{i}",
            f"CASE part{i} {at_part(i, parts, lambda j: middle(i, j))} ELSE high{i} END AS high{i}",
        )])
        turn += 1
    value = (lambda i: F.col(f"high{i}").cast("double")) if whole else (lambda i: from_image(F.col(f"high{i}")))
    found = state.select("g", "n", *[value(i).alias(f"value{i}") for i in each])
    pair = F.explode(F.array(*[F.struct(F.lit(p).cast("double").alias("p"), F.col(f"value{i}").alias("value")) for i, p in enumerate(at)]))
    return found.select("g", "n", pair.alias("f")).select("g.*", "n", "f.p", "f.value")


def middle(i: int, j: int) -> str:
    """SQL of the whole part of low + (high - low) * j / WAYS of interval ``i``, without going beyond 64 bits."""
    low, high, rest = f"low{i}", f"high{i}", WAYS - 1
    return f"(shiftright({low}, 3) * {WAYS - j} + shiftright({high}, 3) * {j} + shiftright(({low} & {rest}L) * {WAYS - j} + ({high} & {rest}L) * {j}, 3))"
