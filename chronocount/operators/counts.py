"""The long count table, brought to one row per cell.

Counts come as (cell, gene, x) rows with implicit zeros. Here a cell's rows are
packed into one array of codes, ``gene * 2**21 + x + 1``, before the shuffle; a
code without an x part says that the gene was not measured in the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A valid count is not null, not negative, and below this.
ABSURD = 1_000_000
_BITS = 21


def pack_by_cell(counts: DataFrame) -> DataFrame:
    """``cell_id, codes``: the genes of each cell, sorted, each gene once.

    Rows without a cell or gene are left out. A null, negative or absurd ``x``
    is "not measured"; where a (cell, gene) comes several times the largest
    valid ``x`` holds. Cells without rows have no row. Rows of a cell that lie
    together are packed before the shuffle; others meet behind it.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, x = b["cell_id"].to_numpy(), b["x"].fillna(-1).to_numpy(np.int64)
            code = (b["gene_id"].to_numpy(np.int64) << _BITS) + np.where((x >= 0) & (x < ABSURD), x + 1, 0)
            order = np.lexsort((code, cell))
            cell, code = cell[order], code[order]
            yield from _one_row_each(cell, code)

    few = counts.select(F.col("cell_id").cast("bigint"), F.col("gene_id").cast("int"), F.col("x").cast("bigint")).filter("cell_id is not null and gene_id is not null")
    packed = few.mapInPandas(pack, "cell_id bigint, codes array<bigint>")
    whole = packed.groupBy("cell_id").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    return whole.mapInPandas(_merge, "cell_id bigint, codes array<bigint>")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        cell, code = unpacked(b)
        order = np.lexsort((code, cell))
        yield from _one_row_each(cell[order], code[order])


def _one_row_each(cell: np.ndarray, code: np.ndarray) -> Iterator[pd.DataFrame]:
    """Of sorted rows the last of every (cell, gene), as one row per cell."""
    if not len(cell):
        return
    gene = code >> _BITS
    last = np.append((cell[1:] != cell[:-1]) | (gene[1:] != gene[:-1]), True)
    cell, code = cell[last], code[last]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    yield pd.DataFrame({"cell_id": cell[starts], "codes": np.split(code, starts[1:])})


def unpacked(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The cell and the code of every entry of a batch of packed rows."""
    return np.repeat(b["cell_id"].to_numpy(), b["codes"].str.len()), np.concatenate([np.zeros(0, np.int64), *b["codes"]]).astype(np.int64)


def gene_and_x(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gene and count of codes; -1 where the gene was not measured."""
    return code >> _BITS, (code & ((1 << _BITS) - 1)) - 1


def counts_long(packed: DataFrame, *keep: str) -> DataFrame:
    """``cell_id, keep, gene_id, x`` of packed rows; ``x`` is null where the gene was not measured."""
    code = F.explode("codes").alias("code")
    x = F.col("code").bitwiseAND(F.lit((1 << _BITS) - 1)) - 1
    return packed.select("cell_id", *keep, code).select("cell_id", *keep, F.shiftright("code", _BITS).cast("int").alias("gene_id"), F.when(x >= 0, x).alias("x"))


#: Words for an unknown label, in letters and digits only.
UNKNOWN_LABELS = ("", "unknown", "na", "nan", "none", "null", "unassigned", "undefined", "undetermined", "nd", "tbd", "missing", "other")


def plain_label(column: str) -> Column:
    """A label in lower-case letters and digits; null if missing or a word for unknown."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]", "")
    return F.when(~plain.isin(*UNKNOWN_LABELS), plain)


def one_row_per_cell(cells: DataFrame) -> DataFrame:
    """``cells`` with the first delivery of every ``cell_id`` (the one with the earliest ``load_ts``)."""
    rest = [c for c in cells.columns if c != "cell_id"]
    first = cells.filter("cell_id is not null").groupBy("cell_id").agg(F.min_by(F.struct(*rest), F.struct("load_ts", *[c for c in ("rd", "cell_type") if c in rest])).alias("r"))
    return first.select("cell_id", "r.*")
