"""Most similar vectors for every vector.

Method: multi-probe p-stable hashing. A vector is projected on Gaussian
directions, each projection is cut into slots of one width, and the slots make
its bucket. A query looks into its own bucket and into neighbouring ones, in the
order in which they are likely to hold a near vector: by the squared distances
to the slot borders that lie between. Candidates of all tables are merged and
ranked by exact distance.

The directions of one table are made orthonormal. Then the squared distance of
two vectors is at least the sum over those borders, so for a given radius the
probing ends with a proof that nothing is missed.

All pairs within a radius (``near_pairs``) are found by planes instead: each
divides the vectors in two, those behind it that a pair may join to the front
are in both halves, and the halves are divided again until all pairs are tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocount.session import cut, spread

#: Rows a side of a block in which queries meet all rows.
PART = 4096

#: Rows, lowest by hash, on which the slot width of the k-nearest search and the planes between parts are fitted. All rows are indexed.
FIT_ROWS = 20_000

#: Vectors of a part that a task divides further, at least and at most, parts there are if both hold, vectors of which all pairs are tried, and rows a side of their blocks.
LEAST_PART, MOST_PART, PARTS, LEAF, BLOCK = 4096, 65_536, 48, 512, 256

_LOOK = 512  # vectors looked at for a plane


@dataclass(frozen=True)
class Table:
    """One hash table: ``M`` orthonormal directions (columns), offsets, width, and the multipliers that make a bucket's number."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    multipliers: np.ndarray

    def slots(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot numbers and places within the slots, in units of the vectors."""
        p = (v @ self.directions + self.offsets) / self.width
        whole = np.floor(p)
        return whole.astype(np.int64), (p - whole) * self.width

    def bucket(self, slots: np.ndarray) -> np.ndarray:
        return slots @ self.multipliers  # wraps around


def make_table(dim: int, functions: int, width: float, seed: int) -> Table:
    rng = np.random.Generator(np.random.Philox(key=[seed, dim]))
    q, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    m = min(functions, dim)
    odd = rng.integers(-(2**62), 2**62, size=m, dtype=np.int64) * 2 + 1
    return Table(q[:, :m], rng.uniform(0, width, m), width, odd)


def probes(table: Table, v: np.ndarray, radius: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, score)`` of all buckets to visit, the home bucket with score 0 first.

    ``score`` is the sum of squared distances to the borders crossed. Only sets
    of borders with a score of at most ``radius`` squared are made; of these the
    ``most`` best of each row are kept, or all of them. A radius above half the
    width considers the nearer border of a slot only.
    """
    slots, inside = table.slots(v)
    step = np.where(inside < table.width / 2, -1, 1)
    cost = np.minimum(inside, table.width - inside) ** 2
    row, at, score = np.arange(len(v)), table.bucket(slots), np.zeros(len(v))
    limit = (radius * (1 + 1e-6)) ** 2
    for j in range(cost.shape[1]):
        more = score + cost[row, j]
        ok = more <= limit
        row, at, score = (
            np.concatenate([row, row[ok]]),
            np.concatenate([at, at[ok] + step[row[ok], j] * table.multipliers[j]]),
            np.concatenate([score, more[ok]]),
        )
        if most is not None and len(row) > 4 * most * len(v):
            row, at, score = _best(row, at, score, most)
    return (row, at, score) if most is None else _best(row, at, score, most)


def _best(row: np.ndarray, at: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((score, row))
    row, at, score = row[order], at[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < most], at[rank < most], score[rank < most]


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key, v``: vectors of ``dim`` finite numbers. Null, shorter, longer and partly missing ones are left out."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter((F.size(v) == dim) & fine & F.col(key).isNotNull()).select(F.col(key).alias("key"), v.cast("array<float>").alias("v"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_list() or [np.zeros(0)]).reshape(-1, dim).astype(np.float64)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one: ``rep, v, n`` by vector, and ``key, rep`` by row."""
    hashed = vectors.select("key", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("h2"))
    keys = hashed.select("key", "h", "h2").distinct()
    reps = hashed.groupBy("h", "h2").agg(F.min("key").alias("rep"), F.first("v").alias("v"))
    return reps.select("rep", "v"), keys.join(reps.select("h", "h2", "rep"), ["h", "h2"]).select("key", "rep")


def _plane(p: np.ndarray, radius: float) -> tuple[float, int, float]:
    """``(cost, coordinate, place)`` of the plane that divides ``p`` best; the cost is the share of the pairs left to try, both halves together."""
    best = (np.inf, 0, 0.0)
    for j in np.argsort(-p.std(axis=0), kind="stable")[:3]:
        x = np.sort(p[:, j])
        place = x[(len(x) * np.arange(3, 8)) // 10]
        front = np.searchsorted(x, place) / len(x)
        cost = (np.searchsorted(x, place + radius, "right") / len(x)) ** 2 + (1 - front) ** 2
        i = int(cost.argmin())
        best = min(best, (float(cost[i]), int(j), float(place[i])))
    return best


def _halves(x: np.ndarray, place: float, spent: np.ndarray, fresh: bool, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are in the front half and which behind a plane, and what those in front have spent.

    Of a pair that the plane parts, the row behind is also in the front half. It
    is as far from the plane as the pair apart at least, in this direction, and
    planes of different (``fresh``) directions add up; so a row whose sum of
    squares is above the radius' has no pair left in front.
    """
    gap = x - place
    behind = gap >= 0
    total = spent + np.where(behind, gap * gap, 0.0) if fresh else spent
    front = ~behind | ((gap <= radius) & (total <= radius * radius))
    return np.flatnonzero(front), np.flatnonzero(behind), total


def _tree(p: np.ndarray, weight: float, most: float, radius: float, numbers: Iterator[int]) -> tuple | int:
    """Planes ``(coordinate, place, front, behind)`` that divide the sample ``p`` until a part stands for ``most`` rows; a number is a part."""
    cost, j, place = _plane(p, radius) if len(p) * weight > most and len(p) >= 32 else (1.0, 0, 0.0)
    if cost > 0.9:
        return next(numbers)
    x = p[:, j]
    return j, place, _tree(p[x <= place + radius], weight, most, radius, numbers), _tree(p[x >= place], weight, most, radius, numbers)


def _placed(tree: tuple | int, p: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray]]:
    """``(part, rows)`` of all parts of ``tree`` that have rows of ``p``; a row may be in several."""
    todo = [(tree, np.arange(len(p)), np.zeros(len(p)), frozenset())]
    while todo:
        node, at, spent, used = todo.pop()
        if isinstance(node, int):
            yield node, at
        elif len(at):
            j, place, front, behind = node
            x, y, total = _halves(p[at, j], place, spent, j not in used, radius)
            todo += [(front, at[x], total[x], used | {j}), (behind, at[y], spent[y], used)]


def tried_pairs(p: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(rows, rows, tried)``: pairs of rows of ``p`` that are within ``radius`` up to rounding, some more than once, and of how many tried."""
    n = (p * p).sum(axis=1, keepdims=True) * (1 - 1e-12)  # less by more than a product may lose to rounding
    # The squared distance is one product: |a|^2 - 2 ab + |b|^2.
    left, right = np.hstack([p, n, np.ones_like(n)]), np.hstack([-2 * p, np.ones_like(n), n])
    todo = [(np.arange(len(p)), np.zeros(len(p)), frozenset())]
    while todo:
        at, spent, used = todo.pop()
        if len(at) > LEAF:
            cost, j, place = _plane(p[at[:: -(-len(at) // _LOOK)]], radius)
            if cost <= 0.9:
                x, y, total = _halves(p[at, j], place, spent, j not in used, radius)
                if len(x) < len(at):
                    todo += [(at[x], total[x], used | {j}), (at[y], spent[y], used)]
                    continue
        a, b = left[at], right[at].T
        for i in range(0, len(at), BLOCK):
            for k in range(i, len(at), BLOCK):
                d = a[i : i + BLOCK] @ b[:, k : k + BLOCK]
                x, y = np.divmod(np.flatnonzero(d <= radius * radius), d.shape[1])
                if i == k:
                    x, y = x[x < y], y[x < y]
                yield at[i + x], at[k + y], d.size


def _sample(vectors: DataFrame, key: str, n: int, dim: int) -> np.ndarray:
    """The ``FIT_ROWS`` of ``n`` vectors lowest by hash. Twice as many at most leave the tasks, not as many from each."""
    h = F.xxhash64(key)
    low = vectors.filter(h < -(2**63) + int(min(2 * FIT_ROWS / max(n, 1), 0.999) * 2**64)) if n > 3 * FIT_ROWS else vectors
    few = low.select("v", h.alias("h")).toPandas().sort_values("h", kind="stable")[:FIT_ROWS]
    return _matrix(few["v"], dim)


def near_pairs(vectors: DataFrame, dim: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """All pairs of different vectors within ``radius``: ``rep_a, rep_b, distance`` and the membership ``key, rep``.

    Copies of a vector are one class; ``rep`` is its smallest key. A key with
    several different vectors belongs to several classes. Nothing is missed: a
    row goes to every part that can hold a vector within the radius of it. The
    planes between the parts lie in the sample's principal directions, where
    the vectors are widest; within a part a task divides further.
    """
    reps, members = classes(vectors)
    reps = cut(reps)
    n = reps.count()
    sample = _sample(reps, "rep", n, dim)
    turn = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))[1] if len(sample) > 1 else np.eye(dim)
    reach = radius * (1 + 1e-6)
    tree = _tree(sample @ turn, n / max(len(sample), 1), min(max(n / PARTS, LEAST_PART), MOST_PART), reach, count())
    kind = dict(reps.dtypes)["rep"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, at in _placed(tree, _matrix(b["v"], dim) @ turn, reach):
                yield b.iloc[at].assign(part=part)

    def search(b: pd.DataFrame) -> pd.DataFrame:
        v, names, out = _matrix(b["v"], dim), b["rep"].to_numpy(), []
        for x, y, _ in tried_pairs(v @ turn, reach):
            square = np.zeros(len(x))
            for i in range(dim):  # in this order, as SQL adds up
                square += (v[x, i] - v[y, i]) ** 2
            d = np.sqrt(square)
            good = (d <= radius) & (names[x] != names[y])
            if good.any():
                a, c = names[x[good]], names[y[good]]
                out.append(pd.DataFrame({"rep_a": np.minimum(a, c), "rep_b": np.maximum(a, c), "distance": d[good]}))
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame(columns=["rep_a", "rep_b", "distance"])

    parts = spread(reps.mapInPandas(place, f"rep {kind}, v array<float>, part bigint"), "part")
    return parts.groupBy("part").applyInPandas(search, f"rep_a {kind}, rep_b {kind}, distance double").distinct(), members


def _distance(a: str, b: str, dim: int) -> Column:
    terms = [F.col(a)[i].cast("double") - F.col(b)[i].cast("double") for i in range(dim)]
    return F.sqrt(reduce(lambda x, y: x + y, (t * t for t in terms)))


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``key_a, key_b`` (a < b) of all rows behind the pairs of classes, and of the copies in a class."""
    a = members.select(F.col("key").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("key").alias("y"), F.col("rep").alias("rep_b"))
    between = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").filter("x <> y").select("x", "y")
    many = members.filter("key <> rep").select("rep").distinct()
    copies = a.join(many, F.col("rep_a") == F.col("rep"), "left_semi").join(b, F.col("rep_a") == F.col("rep_b")).filter("x < y").select("x", "y")
    both = between.unionByName(copies)
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def _fit_width(sample: np.ndarray, n: int, functions: int, full: float, seed: int) -> float:
    """The slot width at which a vector's bucket holds about ``full`` of the ``n`` vectors."""
    low, high = 1e-6, float(np.abs(sample).max() * 2 * sample.shape[1] + 1)
    for _ in range(30):
        mid = (low * high) ** 0.5
        t = make_table(sample.shape[1], functions, mid, seed)
        _, size = np.unique(t.bucket(t.slots(sample)[0]), return_counts=True)
        if ((size.astype(float) ** 2).sum() / len(sample) - 1) * n / len(sample) > full:
            high = mid
        else:
            low = mid
    return low


def nearest(
    queries: DataFrame, base: DataFrame, dim: int, k: int = 10, tables: int = 4, functions: int = 8, visits: int = 24, full: float = 400, seed: int = 0
) -> DataFrame:
    """``key, rank, neighbour, distance``: the ``k`` nearest other rows of ``base`` for each row of ``queries``.

    ``queries`` and ``base`` are made by ``usable``. Every row of ``base`` is in
    every table; only the slot width is fitted on the ``FIT_ROWS`` rows lowest by
    hash. A query that meets fewer than ``k`` candidates is asked again with half
    as many functions, in the end among all rows, block by block: so a query gets
    fewer than ``k`` only where ``base`` has no more. Ties go to the smaller
    key. A key that comes twice in ``base`` with one vector counts once.
    """
    base = cut(base.dropDuplicates(["key", "v"]))
    left = cut(queries.dropDuplicates(["key", "v"]))
    n = max(base.count(), 1)
    sample = _sample(base, "key", n, dim)
    done: list[DataFrame] = []
    while True:
        if functions and len(sample):
            width = _fit_width(sample, n, functions, full, seed)
            found = cut(_search(left, base, dim, k, tables, functions, width, visits, seed))
            enough = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("key")
            done.append(found.join(enough, "key", "left_semi"))
            left = cut(left.join(enough, "key", "left_anti"))
            if left.isEmpty():
                break
            functions //= 2
        else:
            done.append(_among_all(left, base, dim, k))
            break
    return reduce(DataFrame.unionByName, done)


def _search(queries, base, dim, k, tables, functions, width, visits, seed) -> DataFrame:
    made = [make_table(dim, functions, width, seed + i) for i in range(tables)]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _matrix(b["v"], dim)
            for i, t in enumerate(made):
                yield pd.DataFrame({"t": i, "bucket": t.bucket(t.slots(v)[0]), "neighbour": b["key"], "w": b["v"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _matrix(b["v"], dim)
            for i, t in enumerate(made):
                row, at, _ = probes(t, v, width * functions**0.5, visits)
                yield pd.DataFrame({"t": i, "bucket": at, "key": b["key"].to_numpy()[row], "v": b["v"].to_numpy()[row]})

    kind = dict(base.dtypes)["key"]
    homes = base.mapInPandas(index, f"t int, bucket bigint, neighbour {kind}, w array<float>")
    asked = queries.mapInPandas(ask, f"t int, bucket bigint, key {kind}, v array<float>")
    met = homes.join(asked, ["t", "bucket"]).filter("key <> neighbour").select("key", "neighbour", _distance("v", "w", dim).alias("distance"))
    by = Window.partitionBy("key").orderBy("distance", "neighbour")
    # A neighbour comes at most once from each table, so these hold the k nearest.
    first = met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k * tables)
    merged = first.groupBy("key", "neighbour").agg(F.min("distance").alias("distance"))
    return merged.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("key", "rank", "neighbour", "distance")


def _among_all(queries: DataFrame, base: DataFrame, dim: int, k: int) -> DataFrame:
    """The nearest of all rows. Both sides are cut by hash into parts of about ``PART`` rows, and a task holds one part of each."""
    parts = [max(1, -(-df.count() // PART)) for df in (queries, base)]
    number = lambda n: F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(number(parts[0]).alias("q"), every(parts[1]).alias("b"), "key", "v")
    there = base.select(every(parts[0]).alias("q"), number(parts[1]).alias("b"), "key", "v")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, names, out = _matrix(a["v"], dim), _matrix(b["v"], dim), b["key"].to_numpy(), []
        for key, v in zip(a["key"], x):
            d = np.sqrt(((y - v) ** 2).sum(axis=1))
            d[names == key] = np.inf
            # All rows as near as the k-th, so that ties go by key.
            near = np.flatnonzero((d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]) & (d < np.inf)) if len(d) else np.zeros(0, int)
            near = near[np.lexsort((names[near], d[near]))][:k]
            out.append(pd.DataFrame({"key": key, "neighbour": names[near], "distance": d[near]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["key", "neighbour", "distance"])

    kind = dict(base.dtypes)["key"]
    found = asked.groupBy("q", "b").cogroup(there.groupBy("q", "b")).applyInPandas(run, f"key {kind}, neighbour {kind}, distance double")
    # A key that has several vectors asks once with each.
    by = Window.partitionBy("key").orderBy("distance", "neighbour")
    merged = found.groupBy("key", "neighbour").agg(F.min("distance").alias("distance"))
    return merged.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("key", "rank", "neighbour", "distance")
