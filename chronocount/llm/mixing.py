"""Mixing sources to target shares of the total size.

Method: subset-sum budget fitting. Documents are counted by exact token length;
each source's budget is filled with whole repeats of the source and, for what
remains, with a number of documents of each length that a bounded-knapsack
dynamic program picks; which documents these are is decided by a seeded hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter of every operator here.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: The dynamic program begins with the last so many tokens of a budget; what lies
#: above is filled in proportion to the length counts. Where it doesn't reach the
#: best sum that can be, it goes on with twice as many, up to the second number
#: or, if asked to be exact, to the whole budget.
KNAPSACK_TOKENS, MOST_KNAPSACK_TOKENS = 1 << 14, 1 << 18

# Sub-groups that a (source, length) group is ranked in, so that a hot one is never sorted by one task.
_SALTS = 64


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, key: str, text: str, source: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_key, source, n_tokens``: whole texts, null and empty ones with 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary).encode_ordinary
        for b in batches:
            code, values = pd.factorize(b["text"])
            sizes = np.array([*(len(encode(v)) for v in values), 0], dtype=np.int64)
            yield pd.DataFrame({"doc_key": b["doc_key"], "source": b["source"], "n_tokens": sizes[code]})

    few = docs.select(F.col(key).alias("doc_key"), F.col(source).alias("source"), F.col(text).alias("text"))
    return few.mapInPandas(run, f"doc_key {dict(docs.dtypes)[key]}, source string, n_tokens bigint")


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near below ``budget`` as can be.

    All sums up to ``budget`` that the lengths reach are the bits of an integer;
    a count is taken apart into powers of two, so each step is one shift.
    """
    reach, steps = 1, []
    mask = (1 << (budget + 1)) - 1
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        count, part = min(count, budget // length), 1
        while count > 0:
            part = min(part, count)
            steps.append((k, part, reach))
            reach |= (reach << (part * length)) & mask
            count, part = count - part, part * 2
            if reach >> budget:
                break
        if reach >> budget:
            break
    rest, take = reach.bit_length() - 1, np.zeros(len(lengths), dtype=np.int64)
    for k, part, before in reversed(steps):
        if not before >> rest & 1:
            take[k] += part
            rest -= part * int(lengths[k])
    return take


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = KNAPSACK_TOKENS, most: int | None = MOST_KNAPSACK_TOKENS) -> np.ndarray:
    """Documents to take of each length for ``budget`` tokens; never more tokens than that.

    All lengths are multiples of their greatest common divisor, so the largest
    such multiple is the best there can be: a fill that reaches it is optimal.
    One that doesn't is made again with twice the window, up to ``most`` (None:
    up to the budget, which is the exact optimum of the whole).
    """
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    step = int(np.gcd.reduce(lengths[counts > 0]))
    while True:
        take = _filled(lengths, counts, budget, min(window, budget), total)
        best = (budget // step) * step
        if window >= (budget if most is None else min(most, budget)) or int((lengths * take).sum()) == best:
            return take
        window *= 2


def _filled(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int, total: int) -> np.ndarray:
    # In proportion first, so that a part of a source looks like the whole.
    take = np.floor(counts * (max(budget - window, 0) / max(total, 1))).astype(np.int64)
    left = budget - int((lengths * take).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if left <= window:
            break
        more = int(min(counts[k] - take[k], -(-(left - window) // lengths[k])))
        more = min(more, left // int(lengths[k]))
        take[k] += more
        left -= more * int(lengths[k])
    return take + bounded_knapsack(lengths, counts - take, min(left, window))


def mix_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, exact: bool = False) -> DataFrame:
    """One row per target source: what it has, its budget, and what it gives.

    Columns: ``source, target_share, max_repeats, n_docs, own_tokens,
    total_tokens, budget, repeats, plan_lengths, plan_counts, taken_tokens,
    reachable``. ``repeats`` is how often the whole source is taken,
    ``plan_counts`` how many documents of each length once more.

    ``total_tokens`` is the size of the mix; by default that of all documents
    whose source has a target. Documents without a source or with one that has
    no target count nowhere; a target without documents is not reachable; a null
    share or cap counts as 0; of targets named twice the larger share holds.
    Only counts by length leave the documents' tasks. With ``exact`` a budget's
    dynamic program may grow to the whole budget (a bit for each token and step).
    """
    wanted = targets.groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeats", F.lit(0))).cast("bigint").alias("max_repeats"),
    ).filter("source is not null")
    by_length = sizes.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).join(wanted, "source", "left_semi")
    per_source = by_length.groupBy("source").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.col("n") * F.col("n_tokens")).alias("own_tokens"),
        F.sort_array(F.collect_list(F.struct("n_tokens", "n"))).alias("lengths"),
    )
    total = F.lit(total_tokens).cast("bigint") if total_tokens is not None else F.sum("own_tokens").over(Window.partitionBy())
    have = wanted.join(per_source, "source", "left").select(
        "source", "target_share", "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"),
        F.transform("lengths", lambda x: x["n_tokens"]).alias("plan_lengths"), F.transform("lengths", lambda x: x["n"]).alias("plan_counts"),
    ).withColumn("total_tokens", F.coalesce(total, F.lit(0)))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                budget = int(r["target_share"] * r["total_tokens"])
                own, cap = int(r["own_tokens"]), int(r["max_repeats"])
                repeats = min(budget // own, cap) if own else 0
                keep = np.array([], dtype=np.int64) if r["plan_lengths"] is None else np.asarray(r["plan_lengths"], dtype=np.int64)
                counts = np.array([], dtype=np.int64) if r["plan_counts"] is None else np.asarray(r["plan_counts"], dtype=np.int64)
                counts, keep = counts[keep > 0], keep[keep > 0]
                rest = budget - repeats * own if repeats < cap else 0
                take = fill(keep, counts, rest, most=None if exact else MOST_KNAPSACK_TOKENS) if rest > 0 and own else np.zeros(len(keep), dtype=np.int64)
                out.append(
                    r | {"budget": budget, "repeats": repeats, "plan_lengths": keep, "plan_counts": take}
                    | {"taken_tokens": repeats * own + int((keep * take).sum()), "reachable": cap * own >= r["target_share"] * r["total_tokens"]}
                )
            if out:
                yield pd.DataFrame(out)[_PLAN_COLUMNS]

    return have.mapInPandas(plan, ", ".join(f"{c} {t}" for c, t in zip(_PLAN_COLUMNS, _PLAN_TYPES)))


_PLAN_COLUMNS = ["source", "target_share", "max_repeats", "n_docs", "own_tokens", "total_tokens", "budget", "repeats", "plan_lengths", "plan_counts", "taken_tokens", "reachable"]
_PLAN_TYPES = ["string", "double", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "array<bigint>", "array<bigint>", "bigint", "boolean"]


def reached_shares(plan: DataFrame) -> DataFrame:
    """``source, target_share, n_docs, own_tokens, taken_tokens, reached_share, reachable``."""
    all_taken = F.sum("taken_tokens").over(Window.partitionBy())
    return plan.select(
        "source", "target_share", "n_docs", "own_tokens", "taken_tokens",
        F.when(all_taken > 0, F.col("taken_tokens") / all_taken).otherwise(F.lit(0.0)).alias("reached_share"), "reachable",
    )


def mixed_documents(sizes: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_key, source, n_tokens, copies`` of every document that is in the mix.

    Documents of one source and length are ranked by a seeded hash. A hot group
    is ranked in sub-groups whose sizes say where each one's ranks begin.
    """
    once = plan.select("source", F.explode(F.arrays_zip("plan_lengths", "plan_counts")).alias("p")).select(
        "source", F.col("p.plan_lengths").alias("n_tokens"), F.col("p.plan_counts").alias("take")
    )
    order = F.xxhash64(F.lit(seed), "doc_key")
    salted = sizes.withColumn("order", order).withColumn("salt", F.pmod(order, F.lit(_SALTS)))
    before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = (
        salted.groupBy("source", "n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(before, F.lit(0)))
        .join(plan.select("source", "repeats"), "source").join(once, ["source", "n_tokens"], "left")
        .select("source", "n_tokens", "salt", "start", "repeats", F.coalesce("take", F.lit(0)).alias("take"))
    )
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "salt").orderBy("order", "doc_key"))
    ranked = salted.withColumn("rank", rank).join(groups, ["source", "n_tokens", "salt"])
    extra = (F.col("start") + F.col("rank") <= F.col("take")).cast("bigint")
    return ranked.withColumn("copies", F.col("repeats") + extra).filter("copies > 0").select("doc_key", "source", "n_tokens", "copies")
