"""Embeddings as integer vectors, for operators whose results are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond this magnitude count as it: sums of squares stay within what Python and decimals hold.
LIMIT = 1 << 40


def integers(vectors: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, c0, c1, ... (the columns ``keep``) and vec: floor(scale * component), an array of long.

    Rows whose vector is null, empty, or holds a null or non-finite component
    are dropped, as are those of another length than most (ties: the shorter).
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where((F.size("vec") > 0) & F.coalesce(finite, F.lit(False)))
    size = v.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    within = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(float(-LIMIT))))
    return v.where(F.size("vec") == (size[0]["d"] if size else 0)).withColumn("vec", F.transform("vec", within))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length, as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def exact(most: int, terms: int) -> type:
    """The fastest type in which a sum of ``terms`` squares of magnitudes up to ``most`` is exact."""
    bound = max(1, terms) * most * most
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
