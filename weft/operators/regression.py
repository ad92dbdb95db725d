"""Ridge regression from moments: penalty search, cross-validation that leaves one event out, controls and ablations.

The rows are read once: sums of products of all columns by event, centred on the table's means. Leaving an event out takes its
moments off the total; a family of features is a sub-matrix; the error on the event that was left out follows from its moments as well. So the
table is never fitted or predicted row by row, and every event, penalty and family is a small system of its own, solved where the event's moments lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moments(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, n, s, p): rows, sums and sums of products (row by row of the upper triangle) of the columns, each minus its mean over the table.
    Rows with a null in any column do not count."""
    rows = df.select(by, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    mean = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    z = [F.col(c) - F.lit(mean[c]) for c in columns]
    pairs = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*map(F.sum, z)).alias("s"), F.array(*pairs).alias("p"))


def _square(p: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = p
    return m + np.triu(m, 1).T


def fit(n: float, s: np.ndarray, p: np.ndarray, use: list[int], alpha: float) -> tuple[np.ndarray, float]:
    """(slopes, intercept) of the last column on the columns ``use``, standardised within the fit; a constant column has slope 0."""
    at = [*use, len(s) - 1]
    m, c = s[at] / n, p[np.ix_(at, at)] / n
    c = c - np.outer(m, m)
    scale = np.sqrt(np.maximum(np.diag(c)[:-1], 0.0))
    live = scale > 1e-12
    w = np.zeros(len(use))
    if live.any():
        a = c[:-1, :-1][np.ix_(live, live)] / np.outer(scale[live], scale[live]) + alpha / n * np.eye(int(live.sum()))
        w[live] = np.linalg.lstsq(a, c[:-1, -1][live] / scale[live], rcond=None)[0] / scale[live]
    return w, float(m[-1] - w @ m[:-1])


def missed(n: float, s: np.ndarray, p: np.ndarray, use: list[int], w: np.ndarray, b: float) -> float:
    """Sum of squared errors of a fit over rows of which only the moments are known."""
    at = [*use, len(s) - 1]
    v = np.append(-w, 1.0)
    return float(v @ p[np.ix_(at, at)] @ v - 2 * b * (v @ s[at]) + n * b * b)


def leave_one_out(df: DataFrame, event: str, features: list[str], target: str, families: dict[str, list[str]], alphas: list[float]) -> DataFrame:
    """(family, alpha, r2, events, best): out-of-event r2 of every family of features at every penalty; ``best`` marks a family's penalty (ties: the smallest).
    An event that holds all rows is predicted by nothing and does not count."""
    columns = [*features, target]
    k, known = len(columns), moments(df, event, columns)
    total = known.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(k * (k + 1) // 2)]).first()
    schema = "family string, alpha double, n long, sse double, sst double"
    n = total["n"] or 0
    s, p = np.array([total[f"s{i}"] or 0.0 for i in range(k)]), _square(np.array([total[f"p{i}"] or 0.0 for i in range(k * (k + 1) // 2)]), k)
    index = {name: [features.index(c) for c in use] for name, use in families.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n_e, s_e, p_e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n_e == n:
                    continue
                s_e, p_e = np.array(s_e), _square(np.array(p_e), k)
                around = p_e[-1, -1] - 2 * s[-1] / n * s_e[-1] + n_e * (s[-1] / n) ** 2
                for name, use in index.items():
                    for alpha in alphas:
                        w, b = fit(n - n_e, s - s_e, p - p_e, use, alpha)
                        out.append((name, alpha, n_e, missed(n_e, s_e, p_e, use, w, b), float(around)))
            columns_ = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, (pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["family", "alpha", "n", "sse", "sst"])

    scores = known.select("n", "s", "p").mapInArrow(run, schema).groupBy("family", "alpha").agg((1 - F.try_divide(F.sum("sse"), F.sum("sst"))).alias("r2"), F.count("*").alias("events"))
    order = Window.partitionBy("family").orderBy(F.col("r2").desc_nulls_last(), "alpha")  # a row a penalty
    return scores.withColumn("best", F.row_number().over(order) == 1)
