"""Fewer features: greedy correlation pruning, standardising, principal components.

Sums of products of the columns are added up where the rows are, one matrix a partition; only the
matrix of the columns (tens of them, not of the rows) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import feature_names, purged_split


def _products(names: list[str], centre: np.ndarray):
    """Of a partition's rows, for every pair of columns over the rows that have both: count, sums, squares, products."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1) - centre
            have = ~np.isnan(x)
            x, have = np.where(have, x, 0.0), have.astype(float)
            total += np.stack([have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    return run


def moments(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means of the columns, and (4, k, k): counts, sums, squares and products about the means, of pairs without nulls."""
    k = len(names)
    df = df.select(*(F.col(f"`{n}`").cast("double").alias(n) for n in names)).persist()  # read twice; lost parts are made anew
    centre = np.array([0.0 if v is None else v for v in df.agg(*(F.avg(f"`{n}`") for n in names)).first()])
    total = np.zeros(4 * k * k)
    for place, value in df.mapInArrow(_products(names, centre), "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        total[place] = value
    df.unpersist()
    return centre, total.reshape(4, k, k)


def correlation_matrix(df: DataFrame, names: list[str]) -> np.ndarray:
    """Pearson's correlations over the rows that have both columns; NaN where one is constant."""
    _, (n, s, q, p) = moments(df, names)
    with np.errstate(all="ignore"):
        own = q / n - (s / n) ** 2  # of the row's column over the rows that have the other
        own = np.where(own <= 1e-14 * np.maximum(q / n, 1e-300), 0.0, own)
        return (p / n - s * s.T / n**2) / np.sqrt(own * own.T)


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, corr of every pair of columns in order; null where one is constant."""
    matrix = correlation_matrix(df, names)
    rows = [(a, b, None if not np.isfinite(c := float(matrix[i, i + 1 + j])) else c) for i, a in enumerate(names) for j, b in enumerate(names[i + 1 :])]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def prune(df: DataFrame, names: list[str], above: float = 0.95) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Columns kept in order, and (dropped, its closest kept column, correlation) for the rest."""
    matrix = np.nan_to_num(np.abs(correlation_matrix(df, names)), posinf=0.0)
    of = {(a, b): float(matrix[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)}
    kept, dropped = [], []
    for name in names:
        close = max(kept, key=lambda k: of.get((k, name), 0.0), default=None)
        if close is not None and of.get((close, name), 0.0) > above:
            dropped.append((name, close, round(of[close, name], 3)))
        else:
            kept.append(name)
    return kept, dropped


def principal_components(df: DataFrame, names: list[str], share: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales, explained shares and loadings (a row each) up to the share of variance.

    Population scales, 1 for a constant column; each component's largest loading is positive.
    """
    k = len(names)
    centre, (n, sums, _, products) = moments(df.dropna(subset=names), names)
    off = sums.diagonal() / n.diagonal()  # what rounding left of the means
    mean, matrix = centre + off, products / n - np.outer(off, off)
    scale = np.sqrt(matrix.diagonal())
    scale = np.where(scale == 0, 1.0, scale)
    matrix = matrix / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    ratio = values[order] / values.sum()
    n = min(int(np.searchsorted(np.cumsum(ratio), share, side="right")) + 1, k)
    loadings = vectors[:, order[:n]].T
    return mean, scale, ratio[:n], loadings * np.sign(loadings[np.arange(n), np.abs(loadings).argmax(axis=1)])[:, None]


def project(df: DataFrame, names: list[str], mean, scale, loadings) -> DataFrame:
    z = [(F.col(n) - float(m)) / float(s) for n, m, s in zip(names, mean, scale)]
    total = lambda v: sum((x * float(c) for x, c in zip(z[1:], v[1:])), z[0] * float(v[0]))
    return df.withColumns({f"pc{i + 1}": total(v) for i, v in enumerate(loadings)})


def top_loadings(names: list[str], loadings, components: int = 3, each: int = 6) -> list[tuple[str, str, float]]:
    return [(f"pc{i + 1}", names[j], round(float(v[j]), 3)) for i, v in enumerate(loadings[:components]) for j in np.argsort(-np.abs(v), kind="stable")[:each]]


def run_reduction(matrix: DataFrame, fraction: float = 0.7, embargo: int | None = None, above: float = 0.95, share: float = 0.95, names: list[str] | None = None) -> dict:
    """Split, prune and principal components, both fitted on the train part; the report as a dictionary.

    Also under "components" the whole matrix with its principal components, lazily.
    """
    names = names or feature_names()
    parts = purged_split(matrix, fraction, **({} if embargo is None else {"embargo": embargo})).where("split IS NOT NULL").persist()
    train = parts.where("split = 'train'")
    sizes = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    kept, dropped = prune(train, names, above)
    mean, scale, ratio, loadings = principal_components(train, kept, share)
    return {
        "n_features": len(names),
        "n_after_prune": len(kept),
        "dropped_features": [d[0] for d in dropped],
        "dropped_table": [dict(zip(("dropped", "correlated_with", "corr"), d)) for d in dropped],
        "pca_components": len(ratio),
        "pca_explained_variance": [round(float(r), 4) for r in ratio],
        "train_rows": sizes.get("train", 0),
        "test_rows": sizes.get("test", 0),
        "top_loadings": [dict(zip(("pc", "feature", "loading"), t)) for t in top_loadings(kept, loadings)],
        "params": {"train_frac": fraction, "embargo_days": embargo or "max_horizon+1", "corr_threshold": above, "pca_var_target": share},
        "kept": kept,
        "components": project(parts, kept, mean, scale, loadings),
    }


def even_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n distinct keys at even spacing in order: those at places int(i * total / n).

    Keys are dealt by ranges and numbered within each; the ranges' sizes (one row a task) give the offsets.
    """
    keys = df.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().repartitionByRange("key").sortWithinPartitions("key")
    # The low 33 bits of this id number a task's rows; the high ones are the task.
    numbered = keys.withColumn("id", F.monotonically_increasing_id()).select("key", F.shiftright("id", 33).alias("part"))
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    w = Window.orderBy("part")
    offsets = sizes.select("part", (F.sum("size").over(w) - F.col("size")).alias("before"), F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    placed = numbered.withColumn("inner", inner).join(F.broadcast(offsets), "part").withColumn("i", F.col("before") + F.col("inner"))
    nth = F.ceil(F.col("i") * n / F.col("total"))
    hit = (F.floor(nth * F.col("total") / n) == F.col("i")) & (nth < n)
    return placed.where((F.col("total") <= n) | hit).select(F.col("key").alias(key))
