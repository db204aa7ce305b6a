"""Embedding whitening by weighted multiplicity covariance.

Vectors become vectors of whole numbers; equal ones are grouped, and each distinct one is worked on once, with the
number of its rows as its weight.  Every task multiplies its share of the centred distinct vectors, and only the
sums over tasks, a square matrix of the dimension, meet on the driver, which finds the eigenvectors.  Whitened
distinct vectors go back to the rows by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import stored

#: A component whose eigenvalue is below this part of the largest is none: the vectors don't vary along it.
LEAST = 1e-12


#: Entries of vectors of whole numbers go no further from 0 than this, before the shift.
FARTHEST = float(1 << 30)


def whole_numbers(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of each entry as a long; null for vectors that are null, empty, or hold null, infinite or NaN entries.

    A finite entry beyond ``FARTHEST`` in size counts as that, so that sums stay within longs.
    """
    c = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(c(v)) | (F.abs(c(v)) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), c(v) * scale))).cast("long") + shift))


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's lists of longs (column ``x``) as a matrix."""
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def task_sums(distinct: DataFrame, of_batch: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> list:
    """Sums of an array over all distinct vectors: ``of_batch`` gives a batch's share of (x, rows); each task emits one array.

    Its cells are summed by Spark, so the driver sees one array, however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                share = of_batch(vectors(batch), batch.column("rows").to_numpy(zero_copy_only=False)).ravel()
                total = share if total is None else total + share
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    cells = distinct.select("x", "rows").mapInArrow(run, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v").alias("v"))
    return [r["v"] for r in cells.orderBy("cell").collect()]


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries drop out, and so do those of another length than most
    (of lengths equally frequent, the larger counts).  Repeated rows and null keys stay, each with its own rows.
    ``deviation`` is null where it is no long any more.  There are as many components as the vectors vary
    along, up to ``components``: none for a table without rows or with one vector only.  The sign makes an eigenvector's
    largest entry positive.  Other columns are dropped.
    """
    rows = table.select(F.col(key).alias("_key"), whole_numbers(F.col(vector)).alias("x")).where("x is not null")
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (length["d"], length["n"]) if length else (1, 0)
    rows = rows.where(F.size("x") == d)
    # A vector that a third of the rows share is one row after the task's own counts.
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("rows")), "distinct-vectors")
    sums = np.array(task_sums(distinct, lambda x, w: w @ x, "long"), dtype=np.int64) if n else np.zeros(d, np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        # n * x - sums is exact; only then is it divided.
        return (n * x - sums) / max(n, 1)

    def products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        c = centred(x)
        return (c * w[:, None]).T @ c

    covariance = np.array(task_sums(distinct, products, "double")).reshape(d, d) / n if n else np.zeros((d, d))
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int(min(components, np.sum(values > LEAST * max(values[0], 0)))) if values[0] > 0 else 0
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(0), np.arange(kept)])
    weights = axes / np.sqrt(values[:kept])
    explained = (values[:kept] / np.trace(covariance)).tolist() if kept else []

    def white_products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        y = centred(x) @ weights
        return np.append((y * w[:, None]).T @ y, w @ y)

    error = 0.0
    if kept:
        got = np.array(task_sums(distinct, white_products, "double"))
        second, mean = got[: kept * kept].reshape(kept, kept) / n, got[kept * kept :] / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(kept)).max())

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch) if batch.num_rows else np.zeros((0, d), np.int64)
            y = (centred(x) @ weights).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * kept), pa.array(y))
            yield pa.RecordBatch.from_arrays([batch.column("x"), lists, pa.array(deviations(x, n, sums), pa.int64())], names=["x", "white", "deviation"])

    done = distinct.select("x").mapInArrow(white, "x array<long>, white array<double>, deviation long")
    # The hash comes first in the comparison.
    hashed = lambda df: df.withColumn("_h", F.xxhash64("x"))
    back = hashed(rows).join(hashed(done), ["_h", "x"]).select("_key", "deviation", F.posexplode("white").alias("_c", "whitened"))
    share = F.get(F.array(*[F.lit(e) for e in explained]), F.col("_c")) if kept else F.lit(0.0)
    return back.select(F.col("_key").alias(key), (F.col("_c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum of (n * v - sums)^2 of each row v, exactly; None beyond a long."""
    off = n * x - sums
    most = int(np.abs(off).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", off, off).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in off]
    return [t if t < 1 << 63 else None for t in totals]
