"""Iterative imputation of numeric columns by chained Bayesian ridge regressions.

Every imputed value is a linear function of the row's known values, with coefficients that depend only on which
columns are missing. So the sums of products per missing pattern hold all that the rounds need: one aggregation
over the table, the rounds on small matrices, one projection. Tables with very many patterns are updated column
by column instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import quoted
from millrace.session import checkpoint

MAX_PATTERNS = 4096


def bayes_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: float) -> np.ndarray:
    """Evidence-maximising ridge weights from centred sums of products (MacKay's updates)."""
    prior = 1e-6
    eig, basis = np.linalg.eigh(xx)
    eig = np.maximum(eig, 0.0)
    turned = basis.T @ xy
    noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    previous = None
    for _ in range(300):
        coef = basis @ (turned / (eig + weight / noise))
        error = max(yy - 2.0 * coef @ xy + coef @ xx @ coef, 0.0)
        if previous is not None and np.abs(previous - coef).sum() < 1e-3:
            break
        previous = coef
        used = float(np.sum(noise * eig / (weight + noise * eig)))
        weight = (used + 2 * prior) / (coef @ coef + 2 * prior)
        noise = (n - used + 2 * prior) / (error + 2 * prior)
    return coef


def _regress(gram: np.ndarray, target: int) -> np.ndarray:
    """Coefficients over (1, all columns) of one column on the others; its own coefficient is 0."""
    n = gram[0, 0]
    others = [i for i in range(1, len(gram)) if i != target]
    means = gram[0] / n
    centred = gram - n * np.outer(means, means)
    coef = bayes_ridge(centred[np.ix_(others, others)], centred[others, target], max(centred[target, target], 0.0), n)
    out = np.zeros(len(gram))
    out[others] = coef
    out[0] = means[target] - means[others] @ coef
    return out


def _gram_aggs(values: Sequence[Column]) -> list[Column]:
    """Sums of all products of (1, values); a missing value counts as 0."""
    full = [F.lit(1.0)] + [F.coalesce(v, F.lit(0.0)) for v in values]
    return [F.sum(full[i] * full[j]).alias(f"g{i}_{j}") for i in range(len(full)) for j in range(i, len(full))]


def _gram(row, size: int) -> np.ndarray:
    out = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def chained_impute(df: DataFrame, columns: Sequence[str], rounds: int = 8, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Fill the missing cells of ``columns``; other columns and known cells stay as they are."""
    columns = list(columns)
    if rounds < 1:
        raise ValueError(f"rounds must be 1 or more, got {rounds}")
    values = [number(df, n) for n in columns]
    stats = df.agg(
        F.count("*").alias("rows"),
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
    ).first()
    gaps = [stats["rows"] - stats[f"n{i}"] for i in range(len(columns))]
    if not any(gaps) or not stats["rows"]:
        return df
    means = [stats[f"m{i}"] for i in range(len(columns))]
    order = [i for i in sorted(range(len(columns)), key=lambda i: gaps[i]) if gaps[i] and means[i] is not None]
    if len(columns) == 1:
        filled = [F.coalesce(values[0], F.lit(means[0]))]
        return df.withColumns(dict(zip(columns, filled)))
    means = [m if m is not None else 0.0 for m in means]
    centred = [v - F.lit(m) for v, m in zip(values, means)]
    # One character for each column, 1 where it is missing.
    marked = df.withColumn("_mask", F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values]))
    if marked.select("_mask").distinct().limit(max_patterns + 1).count() > max_patterns:
        return _by_column(marked, columns, values, means, order, rounds).drop("_mask")

    size = len(columns) + 1
    lift: dict[int, np.ndarray] = {}
    grams: dict[int, np.ndarray] = {}
    for r in marked.groupBy("_mask").agg(*_gram_aggs(centred)).collect():
        mask = r["_mask"]
        grams[mask] = _gram(r, size)
        known = np.array([1.0] + [0.0 if gap == "1" else 1.0 for gap in mask])
        lift[mask] = np.diag(known)
    for _ in range(rounds):
        for j in order:
            train = sum(lift[m] @ grams[m] @ lift[m].T for m in grams if m[j] == "0")
            coef = _regress(train, j + 1)
            for m in grams:
                if m[j] == "1":
                    lift[m][j + 1] = coef @ lift[m]
    rows = [(m, [[float(v) for v in lift[m][j + 1]] for j in range(len(columns))]) for m in lift if "1" in m]
    table = df.sparkSession.createDataFrame(rows, "_mask string, _coef array<array<double>>")
    # One row per missing pattern, at most max_patterns.
    joined = marked.join(F.broadcast(table), "_mask", "left")
    filled = []
    for j, v in enumerate(values):
        mine = F.element_at("_coef", j + 1)
        guess = F.element_at(mine, 1) + F.lit(means[j])
        for i, u in enumerate(centred):
            if i != j:
                guess = guess + F.element_at(mine, i + 2) * F.coalesce(u, F.lit(0.0))
        filled.append(F.coalesce(v, guess))
    new = dict(zip(columns, filled))
    return joined.select(*[new[n].alias(n) if n in new else F.col(quoted(n)) for n in df.columns])


def _by_column(marked: DataFrame, columns, values, means, order, rounds: int) -> DataFrame:
    """The same rounds with one aggregation per column step, for tables with very many missing patterns."""
    current = marked.withColumns({f"_f{i}": F.coalesce(v - F.lit(means[i]), F.lit(0.0)) for i, v in enumerate(values)})
    current = checkpoint(current)
    size = len(columns) + 1
    names = [f"_f{i}" for i in range(len(columns))]
    for _ in range(rounds):
        for j in order:
            missing = F.substring("_mask", j + 1, 1) == "1"
            row = current.where(~missing).agg(*_gram_aggs([F.col(n) for n in names])).first()
            coef = _regress(_gram(row, size), j + 1)
            guess = F.lit(float(coef[0]))
            for i, n in enumerate(names):
                guess = guess + F.lit(float(coef[i + 1])) * F.col(n)
            current = checkpoint(current.withColumn(names[j], F.when(missing, guess).otherwise(F.col(names[j]))))
    new = {n: F.col(f"_f{i}") + F.lit(means[i]) for i, n in enumerate(columns)}
    return current.withColumns(new).drop(*names)


def imputation_preview(before: DataFrame, after: DataFrame, columns: Sequence[str], key: str, limit: int = 12) -> DataFrame:
    """The first rows along a key, before and after."""
    old = before.select(quoted(key), *[F.col(quoted(n)).alias(f"{n}_before") for n in columns])
    new = after.select(quoted(key), *[F.col(quoted(n)).alias(f"{n}_after") for n in columns])
    first = old.orderBy(quoted(key)).limit(limit)
    return first.join(new, key).orderBy(quoted(key))
