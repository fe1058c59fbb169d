"""Evaluation passages inside training text.

Method: spaced-seed hashing. Fixed masks over windows of eight words leave some
positions out, so a window still hits when a word at such a position was
changed; hashes of items and documents are joined. A hit also carries a hash of
the whole window: where it agrees all eight words are equal, where it doesn't
the word at the position left out was changed. The hits' windows, one at every
word, overlap to passages, whose words are then counted both ways.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronocount.llm.lookalike import folded
from chronocount.session import cut

#: Positions of a window that are hashed. Any run of eight equal words hits under
#: both; with one changed word it hits under the mask that ignores its place.
MASKS = ((0, 1, 3, 4, 5, 6, 7), (0, 1, 2, 3, 4, 6, 7))
SPAN = 8

# Bits of the filter that documents' hashes go through before they leave their
# task: so many for each of the items' seeds, between the two bounds (half a
# megabyte and 16 MB). A fuller filter lets more through, but drops nothing.
_BITS_PER_SEED, _LEAST_BITS, _MOST_BITS = 32, 1 << 22, 1 << 27

_INLINE = re.compile(r"</?(?:b|i|u|em|sub|sup|strong|span|font|a)\b[^<>]{0,80}>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]{0,80}>", re.I)
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """The words of a text as compared here.

    Case, punctuation, markup, line breaks (also inside a hyphenated word), width
    and look-alike letters don't count.
    """
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    # A hyphen at the end of a line may or may not belong to the word.
    return _WORD.findall(folded(text).replace("-\n", "").replace("-", ""))


def _word_ids(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of all words of all texts, and where each text begins."""
    starts, parts = [0], []
    for text in texts:
        found = words(text)
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        parts.append(np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found)))
        starts.append(starts[-1] + len(found))
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.array(starts)


def _seed_hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at ``mask`` for every window of ``SPAN`` words."""
    n = max(len(ids) - SPAN + 1, 0)
    h = np.full(n, len(mask), dtype=np.uint64)
    for at in mask:
        h = (h ^ ids[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _seeds(bits: np.ndarray | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            b = b[b["text"].notna()]
            if len(known) > 1_000_000:
                known.clear()
            ids, starts = _word_ids(b["text"].tolist(), known)
            row = np.repeat(np.arange(len(b)), np.diff(starts))
            n = max(len(ids) - SPAN + 1, 0)
            inside = row[:n] == row[SPAN - 1 : SPAN - 1 + n]
            whole = _seed_hashes(ids, tuple(range(SPAN)))
            for number, mask in enumerate(MASKS):
                h = _seed_hashes(ids, mask)
                ok = inside
                if bits is not None:
                    slot = h % np.uint64(len(bits) * 8)
                    ok = inside & (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(ok)
                if bits is not None:
                    # A window that a document repeats leaves it once.
                    at = at[~pd.DataFrame({"row": row[at], "whole": whole[at]}).duplicated().to_numpy()]
                yield pd.DataFrame(
                    {"key": b["key"].to_numpy()[row[at]], "mask": np.int8(number), "seed": h[at].view(np.int64), "whole": whole[at].view(np.int64), "pos": (at - starts[row[at]]).astype(np.int32)}
                )

    return run


def seeds(df: DataFrame, key: str, text: str, bits: np.ndarray | None = None) -> DataFrame:
    """``key, mask, seed, whole, pos`` of every window, or of the different ones of each text that pass the filter ``bits``."""
    kind = dict(df.dtypes)[key]
    few = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return few.mapInPandas(_seeds(bits), f"key {kind}, mask tinyint, seed bigint, whole bigint, pos int")


def seed_filter(item_seeds: DataFrame) -> np.ndarray:
    """A bit field of the items' hashes; its size is bounded, however many items there are."""
    wanted = _BITS_PER_SEED * item_seeds.count()
    size = min(max(_LEAST_BITS, 1 << max(wanted - 1, 1).bit_length()), _MOST_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, dtype=bool)
        for b in batches:
            bits[(b["seed"].to_numpy().view(np.uint64) % np.uint64(size)).astype(np.int64)] = True
        yield pd.DataFrame({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, dtype=np.uint8)
    # One field per partition, read one after the other.
    for r in item_seeds.select("seed").coalesce(4).mapInPandas(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _words_in(at: Column) -> Column:
    """Words that lie in windows beginning at the sorted positions ``at``; 0 without any."""
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(SPAN)))
    return F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(SPAN), lambda total, x: total + x)).otherwise(F.lit(0))


def leaks(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, min_share: float = 0.5, changed_words: bool = False
) -> DataFrame:
    """``doc_key, item_key, n_words, n_covered, n_alike, share`` of documents that hold at least ``min_share`` of an item.

    ``n_covered`` counts the item's words that stand in the document in runs of
    eight or more in the item's order; the runs themselves may come in any order,
    as the parts of a passage do that was taken apart. ``n_alike`` counts the
    words that lie in windows of eight with at most one changed word (at a place
    that a mask leaves out), without those changed. ``share`` is the part that
    ``n_covered`` (with ``changed_words``: ``n_alike``) is of all the item's words.

    Null and empty texts and items of fewer than eight words give no row; rows of
    one key count as one text. Whole texts are read; only hashes of windows that
    pass the items' filter leave a document's task. Equal hashes of 64 bits count
    as equal words.
    """
    item_seeds = seeds(items, item_key, item_text).select(F.col("key").alias("item"), "mask", "seed", F.col("whole").alias("item_whole"), F.col("pos").alias("at")).distinct()
    item_seeds = cut(item_seeds)
    sizes = item_seeds.groupBy("item").agg((F.max("at") + SPAN).alias("n_words"))
    bits = seed_filter(item_seeds)
    # A seed that a third of all documents hold is a hot key on their side of the
    # join only: it is split there, by a broadcast of the items' side while that
    # is small, else as a skewed key.
    hits = seeds(docs, doc_key, doc_text, bits).select(F.col("key").alias("doc"), "mask", "seed", "whole").join(item_seeds, ["mask", "seed"])
    same = F.col("whole") == F.col("item_whole")
    one = hits.groupBy("doc", "item").agg(
        F.sort_array(F.collect_set(F.when(same, F.col("at")))).alias("equal"),
        *[F.collect_set(F.when(~same & (F.col("mask") == m), F.col("at"))).alias(f"near{m}") for m in range(len(MASKS))],
    )
    places = lambda at, mask: F.flatten(F.transform(at, lambda p: F.array(*[p + i for i in mask])))
    alike = F.size(F.array_distinct(F.concat(places("equal", tuple(range(SPAN))), *[places(f"near{m}", mask) for m, mask in enumerate(MASKS)])))
    # The cheaper count first: words in any window hit are at least those that count.
    most = _words_in(F.sort_array(F.array_distinct(F.concat("equal", *[f"near{m}" for m in range(len(MASKS))]))) if changed_words else F.col("equal"))
    some = one.join(sizes, "item").filter(most >= F.lit(min_share) * F.col("n_words"))
    counted = some.select("doc", "item", "n_words", _words_in(F.col("equal")).alias("n_covered"), alike.alias("n_alike"))
    share = F.col("n_alike" if changed_words else "n_covered") / F.col("n_words")
    return counted.withColumn("share", share).filter((F.col("share") > 0) & (F.col("share") >= min_share)).select(
        F.col("doc").alias(doc_key), F.col("item").alias(item_key), *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "n_covered", "n_alike")], "share"
    )
