"""Literal coefficient tables for the ordered-series smoothers.

Built once on the driver with numpy from the window length alone (no data),
then embedded in the plan as array literals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def savgol_hat_matrix(window: int, order: int) -> np.ndarray:
    """Least-squares polynomial smoother over ``window`` equally spaced points.

    Row ``i`` gives the fitted value at position ``i`` of the window from the
    ``window`` observed values: ``H = A (A^T A)^-1 A^T`` with ``A`` the
    Vandermonde matrix of positions ``-m..m``. The centre row is the
    Savitzky-Golay interior filter; the other rows evaluate the polynomial
    fitted to the first/last window at the series edges.
    """
    m = window // 2
    x = np.arange(-m, window - m, dtype=float)
    a = np.vander(x, order + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def literal_matrix(h: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in h])


def dot(values: Column, coefs: Column) -> Column:
    """Sum of element-wise products of two equally long arrays."""
    return F.aggregate(F.zip_with(values, coefs, lambda x, c: x * c), F.lit(0.0), lambda acc, v: acc + v)
