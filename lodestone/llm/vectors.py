"""What the vector operators share: which vectors count, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that aren't null, empty or zero and hold no null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def one_each(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id; of rows with one id the smallest vector counts, null last."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id is not null")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, in double precision."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for each d and seed."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, d)))
    return q * np.sign(np.diag(r))
