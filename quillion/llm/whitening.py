"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Vectors become integers; those that differ are the fit list. Each task reads
its share of the list batch by batch and keeps a summary: how many vectors,
their exact sums, and all singular values and vectors of what it has read,
centred on its own mean. Two summaries merge by stacking their scaled vectors
and one row for the distance of their means, sqrt(n1 n2 / (n1 + n2)) times the
difference, and decomposing again: nothing is truncated, so the last summary
has the singular values of the whole list. ``FAN_IN`` summaries merge in a
task, level by level, each level a table in the shared folder.

A summary has d values and d x d numbers, whatever it stands for. The driver
gets one, the last; broadcast are the components' vectors and the sums.

Squared lengths of what is projected are exact integers, whatever their size;
the projection itself is in double precision of exactly centred vectors.

Defined results: vectors that are null, empty or hold null or non-finite
components are dropped, as are those of another length than most; magnitudes
over 2**40 count as that; equal vectors count once in the fit but each row has
its result, repeated rows and rows without id too; eigenvalues tie in the order
of the decomposition; each component's largest coordinate is positive; a
component along which the vectors don't differ has an explained share of 0 and
null for whitened, and takes no part in identity_error (0 if there is no
other); a deviation beyond the range of long is null; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm.common import small_batches
from quillion.llm.vectors import integers, matrix
from quillion.session import cut, delete, read

SCALE, OFFSET, COMPONENTS, FAN_IN = 64, 1_000_000, 16, 8
#: Eigenvalues below this share of the trace are what rounding leaves of zero.
NOTHING = 1e-13
LONG = (1 << 63) - 1
SUMMARY = "place long, n long, sums array<decimal(38,0)>, singular array<double>, vectors array<double>"


@dataclass
class Summary:
    """Vectors seen: their number, exact sums, and the decomposition of what they are without their mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """Of the rows of x, integers."""
        total = [int(v) for v in x.sum(0)]
        _, values, vectors = np.linalg.svd(centred(x, len(x), total), full_matrices=False)
        return Summary(len(x), total, values, vectors)

    def merged(self, other: Summary) -> Summary:
        between = np.array([float(Fraction(a * other.n - b * self.n, self.n * other.n)) for a, b in zip(self.sums, other.sums, strict=True)])
        rows = [self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, np.sqrt(self.n / (self.n + other.n) * other.n) * between[None, :]]
        _, values, vectors = np.linalg.svd(np.concatenate(rows), full_matrices=False)
        return Summary(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], values, vectors)

    def row(self, place: int) -> dict[str, list]:
        return {"place": [place], "n": [self.n], "sums": [[Decimal(s) for s in self.sums]], "singular": [self.values.tolist()], "vectors": [self.vectors.ravel().tolist()]}

    @staticmethod
    def read(r) -> Summary:
        values = np.array(r["singular"], np.float64)
        return Summary(int(r["n"]), [int(s) for s in r["sums"]], values, np.array(r["vectors"], np.float64).reshape(len(values), len(r["sums"])))


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n, rounded once: n * x - total is exact."""
    return _scaled(x, n, total).astype(np.float64) / n


def _scaled(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    return n * x - np.array(total, np.int64) if most < 1 << 62 else n * x.astype(object) - np.array(total, object)


def squares(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n * x - total)^2 over each row, exact; null beyond the range of long."""
    y = _scaled(x, n, total)
    if y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
        return (y.astype(np.int64) ** 2).sum(1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) <= LONG else None for row in y]


def summaries(fit: DataFrame) -> DataFrame:
    """A summary for each task that has rows."""
    small_batches(fit.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            if b.num_rows:
                here = Summary.of(matrix(b.column("vec")))
                done = done.merged(here) if done else here
        if done:
            yield pa.RecordBatch.from_pydict(done.row(TaskContext.get().partitionId()), schema=SCHEMA)

    return fit.select("vec").mapInArrow(run, SUMMARY)


SCHEMA = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("singular", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def merged(table: pa.Table) -> pa.Table:
    """The summaries of one group as one, in order of their places."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    done = Summary.read(rows[0])
    for r in rows[1:]:
        done = done.merged(Summary.read(r))
    return pa.Table.from_pydict(done.row(rows[0]["place"] // FAN_IN), schema=SCHEMA)


def decomposition(fit: DataFrame) -> Summary | None:
    """The summary of all vectors, merged level by level."""
    level, path = cut(summaries(fit), "svd")
    try:
        while True:
            most = level.agg(F.max("place")).first()[0]
            if most is None:
                return None
            if most == 0:
                return Summary.read(level.first())
            had = path
            level, path = cut(level.groupBy(F.floor(F.col("place") / FAN_IN)).applyInArrow(merged, SUMMARY), "svd")
            delete(fit.sparkSession, had)
    finally:
        delete(fit.sparkSession, path)


@dataclass
class Whitening:
    """Components (rows of ``vectors``, signs settled), eigenvalues and their shares; sums of n integer vectors."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(s: Summary, components: int) -> Whitening:
        # fewer vectors than dimensions: the components that are left have no variance
        _, _, full = np.linalg.svd(s.vectors, full_matrices=True) if len(s.values) < len(s.sums) else (0, 0, s.vectors)
        vectors = np.concatenate([s.vectors, full[len(s.values) :]])[:components]
        e = np.zeros(len(s.sums))
        e[: len(s.values)] = s.values**2 / s.n
        trace = e.sum()
        e = np.where(e > NOTHING * trace, e, 0)
        sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
        return Whitening(s.n, s.sums, e[:components], vectors * sign[:, None], e[:components] / trace if trace else e[:components])

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; nan where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, centred(x, self.n, self.sums) @ self.vectors.T / np.sqrt(self.eigenvalues), np.nan)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from sums of products of each task."""
    k = int((w.eigenvalues > 0).sum())
    if not k:
        return 0.0
    small_batches(fit.sparkSession)
    known = fit.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k + 1, k + 1))
        for b in batches:
            if b.num_rows:
                z = np.pad(known.value.apply(matrix(b.column("vec")))[:, :k], ((0, 0), (0, 1)), constant_values=1)
                g += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    found = fit.select("vec").mapInArrow(run, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()  # (k + 1)^2 numbers
    known.unpersist()
    g = np.array([r["s"] for r in found]).reshape(k + 1, k + 1) / w.n
    return float(np.abs(g[:k, :k] - np.outer(g[k, :k], g[k, :k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, fit, identity_error): for each kept row its id, deviation and whitened, an array with null where there is no variance."""
    spark = vectors.sparkSession
    whole = integers(vectors, scale, id_col, vec_col).withColumn("vec", F.transform("vec", lambda c: c + F.lit(offset)))
    rows, path = cut(whole, "white-vectors")
    fit, fit_path = cut(rows.select("vec").distinct(), "white-fit")
    s = decomposition(fit)
    w = Whitening.of(s, components) if s else None
    error = identity_error(fit, w) if w else 0.0
    delete(spark, fit_path)
    schema = "id long, deviation long, whitened array<double>"
    if not w:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col), None, 0.0
    known = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"))
                z = known.value.apply(x)
                white = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(squares(x, known.value.n, known.value.sums), pa.int64()), white], ["id", "deviation", "whitened"])

    return rows.select("id", "vec").mapInArrow(run, schema).withColumnRenamed("id", id_col), w, error


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, w, error = whiten(read(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(float(e)) for e in w.explained]) if w else F.array().cast("array<double>")
    return rows.select("vec_id", F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
