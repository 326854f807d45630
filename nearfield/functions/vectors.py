"""Vector arithmetic: Column expressions in double precision, and their counterparts on arrays.

``sequential_dot`` adds products from left to right, as the expressions do, so both give the same bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _column(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _total(F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: ColumnOrName, b: ColumnOrName) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _total(F.zip_with(_column(a), _column(b), square))


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: ColumnOrName) -> Column:
    """The unit vector; a zero vector gives nulls."""
    n = norm(a)
    return F.transform(_column(a), lambda x: F.when(n > 0, x.cast("double") / n))


def rounded(a: ColumnOrName, places: int) -> Column:
    """Half away from zero; what is negative stays so (-0.0), as it does in SQL engines that round doubles as such."""
    return F.round(F.abs(_column(a)), places) * F.signum(_column(a))


def score(a: ColumnOrName, b: ColumnOrName, metric: str = "ip") -> Column:
    """Higher is better: the dot product (ip) or the negative squared distance (l2)."""
    check_metric(metric)
    return dot(a, b) if metric == "ip" else -squared_l2(a, b)


def check_metric(metric: str) -> None:
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric {metric!r}: ip or l2")


def sequential_score(a: np.ndarray, b: np.ndarray, metric: str = "ip") -> np.ndarray:
    """Row-wise scores of two (n, d) arrays, summed from left to right."""
    terms = a * b if metric == "ip" else (a - b) ** 2
    total = np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))
    return total if metric == "ip" else -total


def block_scores(queries: np.ndarray, rows: np.ndarray, metric: str = "ip") -> np.ndarray:
    """(query, row) scores by matrix product; equal to the exact ones but for rounding."""
    products = queries @ rows.T
    if metric == "ip":
        return products
    return 2 * products - (queries**2).sum(1)[:, None] - (rows**2).sum(1)[None, :]
