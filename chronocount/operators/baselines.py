"""Baseline methods: lagged regression on distribution changes, forest importances, a classifier of cells."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lagged_regression(ks: DataFrame, strength: float = 0.01, rounds: int = 2000) -> DataFrame:
    """``src, tgt, w`` >= 0 from a table of distribution changes (gene_id, time_h, ks): each gene's changes explained by all genes' changes one step before.

    An elastic net without intercept, non-negative, by projected steps. The
    table is times by genes, whatever the number of cells; each target is a group.
    """
    changes = ks.groupBy("time_h").agg(F.sort_array(F.collect_list(F.struct("gene_id", "ks"))).alias("row"))
    whole = changes.agg(F.sort_array(F.collect_list(F.struct("time_h", "row"))).alias("m"))
    targets = ks.select(F.col("gene_id").alias("tgt")).distinct().join(F.broadcast(whole))

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        rows = [{r["gene_id"]: r["ks"] for r in t["row"]} for t in b["m"].iloc[0]]
        genes = sorted({g for r in rows for g in r})
        m = np.array([[r.get(g, 0.0) for g in genes] for r in rows])
        a, y, w = m[:-1], m[1:, genes.index(b["tgt"].iloc[0])], np.zeros(len(genes))
        if len(a):
            size = 1 / (np.linalg.eigvalsh(a.T @ a / len(a))[-1] + strength)
            for _ in range(rounds):
                w = np.maximum(w - size * (a.T @ (a @ w - y) / len(a) + strength / 2 * w + strength / 2), 0)
        return pd.DataFrame({"src": genes, "tgt": int(b["tgt"].iloc[0]), "w": w})

    return targets.groupBy("tgt").applyInPandas(fit, "src int, tgt int, w double")


def forest_importances(cells: DataFrame, width: int, targets: list[int], n_trees: int = 20, seed: int = 0, at_once: int = 8) -> DataFrame:
    """``src, tgt, w``: how much each other gene (position in the array ``x``) helps a forest to predict the target; one forest per target.

    Forests are Spark jobs of their own over all cells, ``at_once`` of them at a time.
    """
    spark = cells.sparkSession

    def one(t: int) -> list[tuple[int, int, float]]:
        others = [g for g in range(width) if g != t]
        data = cells.select(array_to_vector(F.array(*[F.col("x")[g].cast("double") for g in others])).alias("features"), F.col("x")[t].cast("double").alias("label"))
        model = RandomForestRegressor(numTrees=n_trees, featureSubsetStrategy="sqrt", maxDepth=6, seed=seed).fit(data)
        return [(others[i], t, float(v)) for i, v in enumerate(model.featureImportances.toArray())]

    with ThreadPoolExecutor(at_once) as pool:
        out = [r for rows in pool.map(one, targets) for r in rows]
    return spark.createDataFrame(out, "src int, tgt int, w double")


def train_classifier(cells: DataFrame, width: int, n_trees: int = 50, seed: int = 0):
    """A forest that gives ``cell_type`` from the array ``x``; cells without a type are left out. Returns the fitted pipeline."""
    data = cells.filter("cell_type is not null").select("cell_type", *[F.col("x")[i].cast("double").alias(f"x{i}") for i in range(width)])
    stages = [StringIndexer(inputCol="cell_type", outputCol="label"), VectorAssembler(inputCols=[f"x{i}" for i in range(width)], outputCol="features"), RandomForestClassifier(numTrees=n_trees, maxDepth=8, seed=seed)]
    return Pipeline(stages=stages).fit(data)


def predict_cell_types(model, cells: DataFrame, width: int) -> DataFrame:
    """``cell_id, predicted``."""
    data = cells.select("cell_id", *[F.col("x")[i].cast("double").alias(f"x{i}") for i in range(width)])
    indexer, assembler, forest = model.stages
    labels = F.array(*[F.lit(v) for v in indexer.labels])
    return forest.transform(assembler.transform(data)).select("cell_id", labels[F.col("prediction").cast("int")].alias("predicted"))


def signed(edges: DataFrame, signs: DataFrame) -> DataFrame:
    """``edges`` (src, tgt, w) with the signs of ``partial_corr_sign``; an edge of a gene to itself, or one without a sign, stays as it is."""
    both = signs.select(F.col("gene_a").alias("src"), F.col("gene_b").alias("tgt"), "sign").unionByName(signs.select(F.col("gene_b").alias("src"), F.col("gene_a").alias("tgt"), "sign"))
    return edges.join(both, ["src", "tgt"], "left").select("src", "tgt", (F.col("w") * F.when(F.col("sign") < 0, -1).otherwise(1)).alias("w"))


def swapped(base: DataFrame, perturbed: DataFrame, genes: DataFrame) -> DataFrame:
    """``base`` (cell_id, gene_id, x) with the rows of ``genes`` taken from ``perturbed``; a gene absent there is absent."""
    return base.join(genes, "gene_id", "left_anti").unionByName(perturbed.join(genes, "gene_id", "left_semi"))
