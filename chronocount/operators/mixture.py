"""Negative-binomial mixtures per gene, fitted on histograms.

Everything a fit needs from the cells of a gene is how often each count occurs
at each time, so fits work on (gene, time, x, n) rows; their number depends on
the counts that occur, not on the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocount.functions.nb import nb_logpmf
from chronocount.session import spread

# Fixed values of the method: lower bound of rates (the upper is its inverse), largest rate that comes out, gain of the
# likelihood that ends the hard assignment, rounds of a coupling, least probability.
SMALLEST, LARGEST_RATE, LEAST_GAIN, COUPLING_ROUNDS, LEAST_P = 1e-2, 9.0, 1 / 200, 500, 1e-12


def moment_fit(moments: DataFrame) -> DataFrame:
    """``gene_id, k, c`` from ``gene_id, mean, var``: k = mean^2 / (var - mean), c = k / mean.

    Without counts k = c = 1; without overdispersion k is the larger of 50 and the mean.
    """
    m, v = F.col("mean"), F.col("var")
    k = F.when(m <= 0, F.lit(1.0)).when(v <= m + 1e-8, F.greatest(F.lit(50.0), m)).otherwise(F.greatest(F.lit(1e-3), m * m / F.nullif(v - m, F.lit(0.0))))
    return moments.withColumn("k", k).select("gene_id", "k", F.when(m <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1e-6), F.col("k") / F.nullif(m, F.lit(0.0)))).alias("c"))


def initial_modes(fit: DataFrame, spread: tuple[float, ...] = (0.8, 1.2)) -> DataFrame:
    """``gene_id, mode, k, c``: one shape per mode around the fitted one."""
    return fit.select("gene_id", F.posexplode(F.array(*[F.col("k") * s for s in spread])).alias("mode", "k"), "c")


def responsibilities(hist: DataFrame, modes: DataFrame) -> DataFrame:
    """``hist`` by ``mode`` with ``p``, the probability of the mode given the count, and ``joint``, the log joint probability.

    Weights are those of ``modes`` (column ``w``), or equal without that column. Probabilities are kept above 1e-12.
    """
    w = F.col("w") if "w" in modes.columns else 1.0 / F.count(F.lit(1)).over(Window.partitionBy("gene_id"))
    weighted = modes.withColumn("lw", F.log(w))
    each = hist.join(weighted, "gene_id").withColumn("joint", nb_logpmf(F.col("x"), F.col("k"), F.col("c")) + F.col("lw"))
    row = Window.partitionBy(*hist.columns)
    top = F.max("joint").over(row)
    raw = F.greatest(F.exp(F.col("joint") - top) / F.sum(F.exp(F.col("joint") - F.col("top"))).over(row), F.lit(1e-12))
    shares = each.withColumn("top", top).withColumn("p", raw)
    return shares.withColumn("p", F.col("p") / F.sum("p").over(row)).select(*hist.columns, "mode", "p", "joint")


def log_likelihood(hist: DataFrame, modes: DataFrame) -> DataFrame:
    """``gene_id, n, loglik``."""
    each = responsibilities(hist, modes)
    top = each.groupBy(*hist.columns).agg(F.max("joint").alias("top"), F.collect_list("joint").alias("all"))
    one = F.col("top") + F.log(F.aggregate("all", F.lit(0.0), lambda s, j: s + F.exp(j - F.col("top"))))
    return top.withColumn("l", one * F.col("n")).groupBy("gene_id").agg(F.sum("n").alias("n"), F.sum("l").alias("loglik"))


def bic(likelihood: DataFrame, n_modes: int, zero_inflation: str = "none") -> DataFrame:
    """``gene_id, bic``: ln(N) p - 2 LL with p = 2K, 2K + 1 with one share of zeros, 3K with one for each mode."""
    p = parameter_count(n_modes, zero_inflation)
    return likelihood.select("gene_id", (F.log("n") * p - 2 * F.col("loglik")).alias("bic"))


def parameter_count(n_modes: int, zero_inflation: str = "none") -> int:
    return {"none": 2 * n_modes, "global": 2 * n_modes + 1, "component": 3 * n_modes}[zero_inflation]


def most_likely_mode(each: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, mode``: the mode of highest probability, the first of equals."""
    return each.groupBy(*keys).agg(F.max_by("mode", F.struct(F.round("p", 12), -F.col("mode"))).alias("mode"))


def emd_to_modes(hist: DataFrame, upper_share: DataFrame) -> DataFrame:
    """``gene_id, time_h, x, n_upper``: exact transport to two modes.

    For two modes the cost difference grows with the count, so the cells with the
    largest counts go to the upper mode until its share of the (gene, time) is
    full; a count on the edge is divided.
    """
    above = Window.partitionBy("gene_id", "time_h").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("gene_id", "time_h")
    want = F.round(F.col("w") * F.sum("n").over(whole)).cast("bigint")
    rows = hist.join(upper_share.select("gene_id", "time_h", "w"), ["gene_id", "time_h"])
    upper = F.least(F.greatest(F.col("want") - F.col("before"), F.lit(0)), F.col("n"))
    return rows.withColumn("want", want).withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).select("gene_id", "time_h", "x", "n", upper.alias("n_upper"))


def mixture_curve(modes: DataFrame, top: DataFrame) -> DataFrame:
    """``gene_id, x, density``: the mixture's probability of every count from 0 to the gene's largest (``top``: gene_id, top)."""
    grid = top.select("gene_id", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("x"))
    w = F.col("w") if "w" in modes.columns else F.lit(0.5)
    return grid.join(modes, "gene_id").groupBy("gene_id", "x").agg(F.sum(w * F.exp(nb_logpmf(F.col("x"), F.col("k"), F.col("c")))).alias("density"))


# --- numerics of one gene -------------------------------------------------------------------------------------------


def lgamma(z: np.ndarray) -> np.ndarray:
    w = z + 8
    shift = np.prod([z + i for i in range(8)], axis=0)
    return (w - 0.5) * np.log(w) - w + 0.9189385332046727 + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9) - 691 / (360360 * w**11) - np.log(shift)


def logpmf(x: np.ndarray, k: np.ndarray, c: float) -> np.ndarray:
    """Rows by ``x``, columns by ``k``."""
    x, k = x[:, None].astype(float), np.clip(k, 1e-8, 1e5)[None, :]
    return lgamma(x + k) - lgamma(k) - lgamma(x + 1) + k * np.log(c) - (x + k) * np.log1p(c)


def _shares(x: np.ndarray, k: np.ndarray, c: float, w: np.ndarray) -> np.ndarray:
    joint = logpmf(x, k, c) + np.log(np.maximum(w, 1e-300))
    p = np.maximum(np.exp(joint - joint.max(axis=1, keepdims=True)), 1e-12)
    return p / p.sum(axis=1, keepdims=True)


def _weighted(e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Shares of the modes from relative probabilities and weights."""
    p = e * np.maximum(w, 1e-300)
    p = np.maximum(p / p.sum(axis=1, keepdims=True), 1e-12)
    return p / p.sum(axis=1, keepdims=True)


def mean_constrained(w0: np.ndarray, means: np.ndarray, mean: float, alpha: float) -> np.ndarray:
    """Weights that trade the mean of the data (``alpha`` = 0) against ``w0`` (1); closed form for two modes, projected steps beyond."""
    m = max(mean, 1e-12)
    if len(w0) == 2:
        d = (means[1] - means[0]) / m
        top = (1 - alpha) * d * (mean - means[0]) / m + 2 * alpha * w0[1]
        w = np.clip(top / ((1 - alpha) * d * d + 2 * alpha + 1e-300), 0, 1)
        return np.array([1 - w, w])
    w = w0.copy()
    for _ in range(200):
        w = w - 0.1 / (1 + (means / m) @ (means / m)) * (2 * (1 - alpha) * ((w @ means - mean) / m) * means / m + 2 * alpha * (w - w0))
        w = np.maximum(w, 0)
        w /= w.sum()
    return w


def sinkhorn_labels(p: np.ndarray, n: np.ndarray, target: np.ndarray, rounds: int = COUPLING_ROUNDS) -> np.ndarray:
    """The mode of each row under the entropic coupling (regularisation 1) of the rows to modes of the given weights.

    The coupling is u_i p_ik v_k; only v, one number per mode, is iterated.
    """
    v, share = np.ones(p.shape[1]), n / n.sum()
    for _ in range(rounds):
        got = (share[:, None] * p * v / (p @ v)[:, None]).sum(axis=0)
        new = v * target / np.maximum(got, 1e-300)
        new /= new.max()
        if np.abs(new - v).max() < 1e-9:
            break
        v = new
    return (p * v).argmax(axis=1)


def _newton_shapes(x: np.ndarray, n: np.ndarray, mode: np.ndarray, k: np.ndarray, c: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Shapes of all modes and their common rate: Newton steps on each shape, the rate in closed form.

    The digamma differences are sums over 1 / (a + j) for j below the count.
    """
    top = int(x.max()) if len(x) else 0
    j = np.arange(top)
    total = float((n * x).sum())
    for _ in range(rounds):
        new = k.copy()
        for m in range(len(k)):
            own = mode == m
            size = n[own].sum()
            if not size:
                continue
            inv = 1 / (k[m] + j)
            first, second = np.append(0, np.cumsum(inv)), np.append(0, np.cumsum(inv * inv))
            g = (n[own] * first[x[own]]).sum() + size * (np.log(c) - np.log1p(c))
            h = -(n[own] * second[x[own]]).sum()
            new[m] = np.clip(k[m] - g / h if h < 0 else k[m], k[m] / 3, k[m] * 3)
            new[m] = np.clip(new[m], 1e-4, 1e5)
        size = np.array([n[mode == m].sum() for m in range(len(k))])
        c = (size * new).sum() / total if total > 0 else c
        moved = np.abs(new - k).max()
        k = new
        if moved < 1e-6 * (1 + k.max()):
            break
    low = np.clip(c, SMALLEST, 1 / SMALLEST)
    k, c = k * low / c, low
    return np.maximum(k, min(c / 2, k.max() / 100)), c


def fit_gene(time: np.ndarray, x: np.ndarray, n: np.ndarray, n_modes: int = 2, forcing: float = 0.5, rounds: int = 50) -> tuple[np.ndarray, float, dict[float, np.ndarray]]:
    """Shapes (ascending), rate and weights by time of one gene by hard assignment: responsibilities, weights, transport, Newton."""
    n = n.astype(float)
    mean = (n * x).sum() / n.sum()
    var = (n * (x - mean) ** 2).sum() / n.sum()
    k0 = 1.0 if mean <= 0 else max(50.0, mean) if var <= mean + 1e-8 else max(1e-3, mean * mean / (var - mean))
    c = 1.0 if mean <= 0 else max(1e-6, k0 / mean)
    k = k0 * np.linspace(0.8, 1.2, n_modes)
    # Modes whose means are the same whole number say nothing: spread them over quantiles of the data.
    share, order = 0.5, np.argsort(x, kind="stable")
    cum = np.cumsum(n[order]) / n.sum()
    quantile = lambda q: float(x[order][min(np.searchsorted(cum, q), len(x) - 1)])
    low, high = k[0], k[-1]
    while len({int(v / c) for v in k}) < n_modes and share > 1 / n.sum():
        k = np.linspace(min(low, SMALLEST + quantile(share) * c), max(high, SMALLEST + quantile(1 - share) * c), n_modes)
        share /= 2
    times, grid = np.unique(time), np.arange(int(x.max()) + 1)
    values, at = np.unique(x, return_inverse=True)
    by = [time == t for t in times]
    means = np.array([(n[b] * x[b]).sum() / n[b].sum() for b in by])
    weights, best = {t: np.full(n_modes, 1 / n_modes) for t in times}, (-np.inf, None)
    for step in range(rounds):
        mode, gain, new_weights = np.zeros(len(x), int), 0.0, {}
        # Probabilities of all counts under all modes, once a round.
        each = logpmf(values, k, c)
        cdf, each = np.cumsum(np.exp(logpmf(grid, k, c)), axis=0), np.exp(each - each.max(axis=1, keepdims=True))
        for t, b, m in zip(times, by, means):
            e, size_t = each[at[b]], n[b].sum()
            p = _weighted(e, weights[t])
            likely = star = n[b] @ p / size_t
            for _ in range(20):
                star = n[b] @ _weighted(e, star) / size_t
            data = np.cumsum(np.bincount(x[b], weights=n[b], minlength=len(grid))) / size_t
            alpha = 1.0 if forcing == 0 else min(float(np.abs(cdf @ star - data).max()) / forcing, 1.0)
            target = np.maximum(mean_constrained(likely, k / c, m, alpha), 1e-12)
            target /= target.sum()
            new_weights[t] = target
            mode[b] = sinkhorn_labels(p, n[b], target)
        size = np.array([n[mode == i].sum() for i in range(n_modes)])
        if (size == 0).any() and step == 0:
            mode = _shares(x, k, c, np.full(n_modes, 1 / n_modes)).argmax(axis=1)
            size = np.array([n[mode == i].sum() for i in range(n_modes)])
        if (size == 0).any():
            break
        k2, c2 = _newton_shapes(x, n, mode, k.copy(), c)
        k2[0], k2[-1] = min(k2[0], means.min() * c2), max(k2[-1], means.max() * c2)
        k2 = np.maximum(k2, min(c2 / 2, k2.max() / 100))
        lw = np.log(np.array([new_weights[t] for t in time]))
        gain = float((n * (logpmf(x, k2, c2) + lw)[np.arange(len(x)), mode]).sum())
        if step > 0 and gain - best[0] < LEAST_GAIN:
            break
        best, k, c, weights = (gain, mode), k2, c2, new_weights
    order = np.argsort(k)
    if c > LARGEST_RATE:
        k, c = k * LARGEST_RATE / c, LARGEST_RATE
    return k[order], c, {t: w[order] for t, w in weights.items()}


def soft_em(x: np.ndarray, n: np.ndarray, k: np.ndarray, c: float, w: np.ndarray, rounds: int = 100, tolerance: float = 1e-5) -> tuple[np.ndarray, float, np.ndarray, list[float]]:
    """Shapes, rate, weights and the log likelihood of each round of expectation maximisation; the likelihood never falls.

    A maximisation step moves all shapes by damped Newton and sets the rate in
    closed form; it is halved towards the old parameters while it would lose
    likelihood.
    """
    n, path = n.astype(float), []
    value = lambda k, c, w: float((n * np.log(np.maximum(np.exp(logpmf(x, k, c)) @ w, 1e-300))).sum())
    j, total = np.arange(int(x.max()) if len(x) else 0), float((n * x).sum())
    now = value(k, c, w)
    for _ in range(rounds):
        r = _shares(x, k, c, w) * n[:, None]
        w2, size = r.sum(axis=0) / n.sum(), r.sum(axis=0)
        k2 = k.copy()
        for m in range(len(k)):
            inv = 1 / (k[m] + j)
            g = (r[:, m] * np.append(0, np.cumsum(inv))[x]).sum() + size[m] * (np.log(c) - np.log1p(c))
            h = -(r[:, m] * np.append(0, np.cumsum(inv * inv))[x]).sum()
            k2[m] = np.clip(k[m] - 0.7 * g / h if h < 0 else k[m], max(k[m] / 3, 1e-4), min(k[m] * 3, 1e5))
        c2 = (size * k2).sum() / total if total > 0 else c
        new = value(k2, c2, w2)
        for _ in range(20):
            if new >= now:
                break
            k2, c2, w2 = (k + k2) / 2, (c + c2) / 2, (w + w2) / 2
            new = value(k2, c2, w2)
        if new < now:
            break
        path.append(new)
        k, c, w, gain, now = k2, c2, w2, new - now, new
        if gain < tolerance:
            break
    return k, c, w, path


def merged_modes(k: np.ndarray, c: float, w: np.ndarray, nearest: float) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and weights in order, neighbours nearer than ``nearest`` * c made one by their weighted mean."""
    order = np.argsort(k)
    out: list[list[float]] = []
    for a, b in zip(k[order], w[order]):
        if out and a - out[-1][0] < nearest * c:
            p, q = out[-1]
            out[-1] = [(p * q + a * b) / (q + b), q + b]
        else:
            out.append([a, b])
    return np.array([o[0] for o in out]), np.array([o[1] for o in out])


def fit_soft(hist: DataFrame, n_modes: int = 2, nearest: float = 5.0) -> DataFrame:
    """``gene_id, mode, k, c, w, loglik``: one mixture per gene over all times by expectation maximisation, near modes merged and fitted again."""

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        one = b.groupby("x", as_index=False)["n"].sum()
        x, n = one["x"].to_numpy(np.int64), one["n"].to_numpy()
        k, c, by_time = fit_gene(np.zeros(len(x)), x, n, n_modes)
        w = by_time[0.0]
        while True:
            k, c, w, path = soft_em(x, n, k, c, np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum())
            k2, w2 = merged_modes(k, c, w, nearest)
            if len(k2) == len(k):
                break
            k, w = k2, w2
        order = np.argsort(k)
        return pd.DataFrame({"gene_id": b["gene_id"].iloc[0], "mode": range(len(k)), "k": k[order], "c": c, "w": w[order], "loglik": path[-1] if path else float("nan")})

    return spread(hist.select("gene_id", "x", "n"), "gene_id").groupBy("gene_id").applyInPandas(fit, "gene_id int, mode int, k double, c double, w double, loglik double")


def fit_mixtures(hist: DataFrame, n_modes: int = 2, forcing: float = 0.5) -> DataFrame:
    """``gene_id, time_h, mode, k, c, w``: shapes, rate and weights of each gene from its histogram by time.

    One gene is one task's group; its rows are the distinct (time, count) pairs.
    """

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        k, c, w = fit_gene(b["time_h"].to_numpy(), b["x"].to_numpy(np.int64), b["n"].to_numpy(), n_modes, forcing)
        return pd.DataFrame([(b["gene_id"].iloc[0], t, m, k[m], c, v[m]) for t, v in w.items() for m in range(n_modes)], columns=["gene_id", "time_h", "mode", "k", "c", "w"])

    return spread(hist.select("gene_id", "time_h", "x", "n"), "gene_id").groupBy("gene_id").applyInPandas(fit, "gene_id int, time_h double, mode int, k double, c double, w double")


def assign_modes(hist: DataFrame, mixture: DataFrame) -> DataFrame:
    """``gene_id, time_h, x, mode, kon``: the mode of each count by entropic transport to the weights of its time; ``kon`` is shape / largest shape."""
    whole = hist.select("gene_id", "time_h", "x", "n").join(
        mixture.groupBy("gene_id", "time_h").agg(F.sort_array(F.collect_list(F.struct("mode", "k", "c", "w"))).alias("m")), ["gene_id", "time_h"]
    )

    def label(b: pd.DataFrame) -> pd.DataFrame:
        m = b["m"].iloc[0]
        k, c, w = np.array([r["k"] for r in m]), m[0]["c"], np.array([r["w"] for r in m])
        at = sinkhorn_labels(_shares(b["x"].to_numpy(), k, c, np.full(len(k), 1 / len(k))), b["n"].to_numpy(float), w)
        return b[["gene_id", "time_h", "x"]].assign(mode=at, kon=k[at] / k.max())

    return spread(whole, "gene_id", "time_h").groupBy("gene_id", "time_h").applyInPandas(label, "gene_id int, time_h double, x bigint, mode int, kon double")


def sample_nb(rows: DataFrame, keys: list[str], k: Column, c: Column, zero: Column | None = None, seed: int = 0) -> DataFrame:
    """``keys, x``: a count drawn for each row, a gamma-Poisson variate seeded by the row's keys alone.

    The same keys and seed give the same count, however the rows are
    partitioned. ``zero`` is the probability of a zero put in its place.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b), np.int64)
            for i, (h, shape, rate, z) in enumerate(zip(b["h"], b["k"], b["c"], b["z"])):
                r = np.random.Generator(np.random.Philox(key=h & (2**64 - 1)))
                out[i] = 0 if r.random() < z else r.poisson(r.gamma(max(shape, 1e-8)) / rate)
            yield b[keys].assign(x=out)

    few = rows.select(*keys, F.xxhash64(F.lit(seed), *keys).alias("h"), k.alias("k"), c.alias("c"), (zero if zero is not None else F.lit(0.0)).alias("z"))
    schema = ", ".join(f"`{n}` {t}" for n, t in few.dtypes if n in keys) + ", x bigint"
    return few.mapInPandas(draw, schema)
