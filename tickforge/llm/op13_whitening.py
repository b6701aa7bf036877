"""Embedding whitening by the SVD of centred distributed rows.

An entry c becomes the whole number floor(64 * c) + 1000000, so that sums and deviations are exact. The fit list is each
distinct vector once; its sums by dimension give the centre. Spark MLlib's ``RowMatrix.computeSVD`` takes the centred rows:
their right singular vectors are the components, and a singular value s gives the eigenvalue s * s / n. The total
variance comes from another place, the exact deviations of the fit list, so that the shares explained don't rest on the
decomposition they judge. Whitened rows are the centred rows times the components over the roots of their eigenvalues.

What comes to the driver is a row a dimension (sums), a matrix of dimension by dimension inside ``computeSVD``, and one
row of it a component; tasks get the components. None of these grows with the rows. Copies are combined in their tasks
before the shuffle of the fit list. All singular vectors are asked for, with which MLlib decomposes the Gramian directly
instead of by iteration to a tolerance.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are left out; so are vectors shorter than the longest,
as their last entries are missing, and empty ones. Entries beyond 2^52 / 64 count as that. A deviation beyond 63 bits is null. Eigenvalues
under ``LEAST`` of the largest are rounding errors and give no component; equal vectors, a single one or no row at all give no rows.
Repeated rows each get theirs. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Share of the largest eigenvalue below which one can't be told from rounding.
LEAST = 1e-12
_BOUND = 2.0**52


class Fit(NamedTuple):
    """n vectors with sums S by dimension: ``base`` is S // n, ``rest`` S % n. ``axes`` has a column a component."""

    n: int
    base: list[int]
    rest: list[int]
    eigenvalues: np.ndarray
    axes: np.ndarray
    total: float
    identity_error: float


def whole(rows: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of each usable vector, stored."""
    entries = F.col("embedding").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * float(SCALE), F.lit(_BOUND)), F.lit(-_BOUND))) + SHIFT)
    known = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("embedding")).filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", x.alias("x")), "whole")
    longest = known.agg(F.max(F.size("x"))).first()[0]
    return known.filter(F.size("x") == (longest or 0))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums by dimension; a task sends a row a dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if len(batch):
                n += len(batch)
                # halves of a number, so that no sum of a batch leaves 63 bits
                x = _matrix(batch, "x")
                total = total + (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * len(total))], names=["at", "total", "n"])

    rows = fit_list.mapInArrow(add, "at int, total string, n long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["at"])
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def deviations(x: np.ndarray, n: int, base: list[int], rest: list[int]) -> list[int]:
    """For each row of x the sum over dimensions of (n * x - S)^2, exact."""
    off = x - np.array(base, np.int64)
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    kind = np.int64 if most * most * x.shape[1] < 2**63 else object
    off = off.astype(kind) * n - np.array(rest, kind)
    return [int(v) for v in (off * off).sum(1)]


def _centred(x: np.ndarray, n: int, base: list[int], rest: list[int]) -> np.ndarray:
    return (x - np.array(base, np.int64)) - np.array(rest, float) / n


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Centre, components and total variance of the distinct vectors of x; None if they don't vary."""
    fit_list = stored(x.select("x").distinct(), "fit-list")
    n, sums = _sums(fit_list)
    if n < 2:
        return None
    base, rest = [s // n for s in sums], [s % n for s in sums]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total += sum(deviations(_matrix(batch, "x"), n, base, rest)) if len(batch) else 0
        # in two parts, each within a decimal whatever the number of tasks
        yield pa.record_batch([pa.array([str(total >> 90)]), pa.array([str(total & (1 << 90) - 1)])], names=["high", "low"])

    high, low = fit_list.mapInArrow(spread, "high string, low string").agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")]).first()
    exact = (int(high) << 90) + int(low)
    if not exact:
        return None
    total = exact / n**3
    offset = F.array(*[F.lit(r / n) for r in rest])
    centred = F.zip_with(F.zip_with("x", F.array(*[F.lit(b) for b in base]), lambda a, b: (a - b).cast("double")), offset, lambda a, b: a - b)
    rows = MLUtils.convertVectorColumnsFromML(fit_list.select(array_to_vector(centred).alias("v")), "v")
    found = RowMatrix(rows, n, len(sums)).computeSVD(len(sums), False, LEAST**0.5)
    values = np.array(found.s.toArray())[:components]
    eigenvalues = values * values / n
    axes = np.array(found.V.toArray())[:, : len(values)]
    found = Fit(n, base, rest, eigenvalues, axes, total, 0.0)
    return found._replace(identity_error=_identity_error(fit_list, found))


def _whitened(x: np.ndarray, model: Fit) -> np.ndarray:
    return _centred(x, model.n, model.base, model.rest) @ (model.axes / np.sqrt(model.eigenvalues))


def _identity_error(fit_list: DataFrame, model: Fit) -> float:
    """Largest entry of the whitened fit list's covariance less the identity; a task sends one matrix of components by components."""
    k = len(model.eigenvalues)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch):
                w = _whitened(_matrix(batch, "x"), model)
                total, sums = total + w.T @ w, sums + w.sum(0)
        values = np.concatenate([total.ravel(), sums])
        yield pa.record_batch([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    rows = fit_list.mapInArrow(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = np.array([r["value"] for r in sorted(rows, key=lambda r: r["at"])])
    mean = values[k * k :] / model.n
    return float(np.abs(values[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(x: DataFrame, model: Fit | None) -> DataFrame:
    """A row for each row of x and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    k, names = len(model.eigenvalues), [c.split()[0] for c in schema.split(", ")]
    shared = x.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        explained = m.eigenvalues / m.total
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                matrix, rows = _matrix(part, "x"), len(part)
                exact = [d if d < 2**63 else None for d in deviations(matrix, m.n, m.base, m.rest)]
                each = np.repeat(np.arange(rows), k)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)),
                        pa.array(exact, pa.int64()).take(pa.array(each)), pa.array(_whitened(matrix, m).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, m.identity_error)),
                    ],
                    names=names,
                )

    return x.mapInArrow(project, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitened(x, fit(x))
