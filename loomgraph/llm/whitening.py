"""Embedding whitening: Spark MLlib's computeSVD on centred distributed rows.

Entries become whole numbers x, so the sums S and each row's deviation are exact. The rows n*x - S, divided by n, are the
centred rows; MLlib's RowMatrix adds up their Gramian on the executors and returns singular values s and right singular
vectors. The covariance has the divisor n, so its eigenvalues are e = s^2 / n. The total variance doesn't come from the
decomposition but from the exact deviations: trace(V) = sum(deviation) / n^3.

The driver sees S, the vectors asked for and the sums of a few columns; MLlib adds the Gramian (dimensions squared) there.
All right singular vectors are asked for, as MLlib then decomposes the Gramian at full double precision instead of by
iterations that stop at 1e-10.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry are dropped, and so are rows whose
vector is not of the commonest length (of equally common ones the longest); a null vec_id is a row like any other;
repeated rows count each; components whose variance is below 1e-13 of the largest don't exist, so rows that are all equal,
a single row or an empty table give an empty result; a deviation beyond a long is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, slices

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Singular values below this share of the largest count as zero.
RANK_SHARE = 3e-7
#: Products up to this size are exact in 64 bits.
EXACT = 1 << 62


def fit_list(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = rows.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("vector"))
    # A comparison with the largest double is null for nulls and false for NaN's order and infinities.
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) <= F.lit(float(np.finfo("f8").max)), F.lit(False)))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    return rows.where(F.size("vector") == lengths.select(F.max_by("length", F.struct("count", "length"))).scalar())


def whole(vectors: pa.Array, scale: int, shift: int) -> np.ndarray:
    """The entries of equally long vectors as whole numbers, a row for each vector; Python's integers where 64 bits are too few."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
    flat = flat.astype("i8") + shift if not len(flat) or np.abs(flat).max() < EXACT / 2 else np.array([int(v) + shift for v in flat], object)
    return flat.reshape(len(vectors), -1)


def totals(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = whole(batch.column(0), scale, shift)
                n += len(x)
                part = x.sum(axis=0) if x.dtype == object or np.abs(x).max() < EXACT // len(x) else x.astype(object).sum(axis=0)
                sums = part.astype(object) if sums is None else sums + part  # object: Python's integers don't overflow
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(sums)), pa.int32()), "n": pa.array([n] * len(sums), pa.int64()), "total": pa.array([str(v) for v in sums])})

    found = rows.select("vector").mapInArrow(run, "dim int, n long, total string")
    exact = T.DecimalType(38, 0)
    sums = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(exact)).cast(exact).alias("total")).orderBy("dim").collect()
    return (sums[0]["n"], [int(r["total"]) for r in sums]) if sums else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact."""
    most = max([n, *map(abs, sums)])
    if x.dtype == object or (len(x) and int(np.abs(x).max()) * n + most >= EXACT):
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, "i8")


def squared(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if d.dtype != object and (not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < EXACT):
        return (d * d).sum(axis=1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in d]


def centred_rows(rows: DataFrame, n: int, sums: list[int], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, deviation, centred): the exact sum of squares of n*x - S in digits, and x - S/n rounded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            d = deviations(whole(batch.column(1), scale, shift), n, sums)
            centred = (d / n).astype("f8")
            ends = pa.array(np.arange(len(d) + 1) * len(sums), pa.int32())
            values = pa.ListArray.from_arrays(ends, pa.array(centred.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(v) for v in squared(d)], pa.string()), values], names=["vec_id", "deviation", "centred"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation string, centred array<double>")


def components(centred: DataFrame, n: int, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of the covariance, at most ``k`` with falling eigenvalues."""
    dims = len(centred.select("centred").head()[0])
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("v")), "v")
    found = RowMatrix(vectors, n, dims).computeSVD(dims, computeU=False, rCond=RANK_SHARE)
    values, axes = np.asarray(found.s)[:k] ** 2 / n, found.V.toArray()[:, :k]
    top = np.abs(axes).argmax(axis=0)
    return values, axes * np.where(axes[top, range(axes.shape[1])] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error.

    identity_error is the largest absolute entry of the whitened vectors' covariance (divisor n, centred before
    multiplying) minus the identity.
    """
    spark = rows.sparkSession
    rows = fit_list(rows, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, sums = totals(rows, scale, shift)
    nothing = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if not n:
        return nothing
    centred = centred_rows(rows, n, sums, scale, shift)
    total = centred.agg(F.sum(F.col("deviation").cast("double"))).head()[0]
    if not total:
        return nothing
    values, axes = components(centred, n, k)
    scaled = axes / np.sqrt(values)
    names = [f"w{i}" for i in range(len(values))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(w[:, i]) for i in range(w.shape[1]))], names=["vec_id", "deviation", *names])

    schema = ", ".join([f"vec_id {kind}", "deviation string", *(f"{c} double" for c in names)])
    wide = materialize(centred.mapInArrow(project, schema), "whitened")
    means = wide.agg(*[F.avg(c) for c in names]).head()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = wide.agg(*[F.avg((F.col(names[i]) - F.lit(means[i])) * (F.col(names[j]) - F.lit(means[j]))) for i, j in pairs]).head()
    error = max(abs(m - (i == j)) for m, (i, j) in zip(moments, pairs))
    trace = total / float(n) ** 3
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(c).alias("whitened"), F.lit(float(values[i] / trace)).alias("explained")) for i, c in enumerate(names)]))
    long = wide.select("vec_id", "deviation", each.alias("c"))
    exact = F.col("deviation").try_cast(T.DecimalType(38, 0)).alias("deviation")
    return long.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), exact, "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
