"""Vectors of floating-point numbers as integers, for operators whose results must be exact.

Defined cases: rows whose vector is null, has another width, or holds a null or
non-finite component go; a component beyond LIMIT in absolute value is an error, as
squared distances would not fit in 64 bits; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of integer components: a squared distance of 64 of them stays below 2 ** 63.
LIMIT = 1 << 27
#: More than the relative error of a rounded square root, sum or difference of distances.
SLACK = 1e-12


def floored(rows: DataFrame, scale: int, width: int, columns: dict[str, Column], vector_column: str = "embedding") -> DataFrame:
    """The columns, and x: floor(scale * component) of each component (an array of long)."""
    vector = F.col(vector_column)
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(F.coalesce((F.size(vector) == width) & finite, F.lit(False)))
    return kept.select(*(c.alias(n) for n, c in columns.items()), F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")).alias("x"))


def matrix(batch: pa.RecordBatch, width: int, column: str = "x") -> np.ndarray:
    """The integer vectors of a batch as rows."""
    out = np.asarray(batch.column(column).flatten()).astype(np.int64, copy=False).reshape(-1, width)
    if len(out) and max(out.max(), -out.min()) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} as an integer")
    return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from those of y, or from one vector."""
    d = x - y
    return (d * d).sum(axis=-1)


def below(d: np.ndarray) -> np.ndarray:
    """A bound that is not above the distance whose square (an integer) is given."""
    return np.sqrt(d.astype(np.float64)) * (1 - SLACK)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + SLACK)
