"""Whitening of embeddings: each distinct vector is fitted and whitened once, with its copies as weight or without."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stage

#: Principal components that are returned.
COMPONENTS = 4
#: Steps of the integer grid that an entry is put on.
GRID = 256
#: Copies of a vector above this many, or above a share of 1 / MOST_HOT of all rows, are dealt out in pages.
PAGE = 256
MOST_HOT = 10_000
#: Partial sums of a matrix row that are added up together.
FAN = 32
#: Vectors that are multiplied at once.
ROWS = 4096

_LIMIT = 1 << 62


def usable(df: DataFrame) -> DataFrame:
    """`vec_id` and `x`, the integer vector floor(256 c), of every row whose vector has finite entries only."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    grid = F.transform("embedding", lambda c: F.floor(c.cast("double") * GRID).cast("bigint"))
    return df.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", grid.alias("x"))


def _matrix(lists: pa.Array, width: int, kind) -> np.ndarray:
    """Vectors of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width).astype(kind, copy=False)


def _sums(distinct: DataFrame, weight: str, width: int) -> tuple[int, list[int]]:
    """The weight of all vectors, and the exact weighted sum of each dimension. The driver sees one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * width
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                x, w = _matrix(piece.column(0), width, np.int64), piece.column(1).to_numpy()
                total += int(w.sum())
                most = float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum())
                own = w @ x if most < _LIMIT else w.astype(object) @ x.astype(object)
                sums = [a + b for a, b in zip(sums, own.tolist())]
        rows = [total, *sums]
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array(range(-1, len(sums)), pa.int32()),
                "s": pa.array([Decimal(s) for s in rows], pa.decimal128(38, 0)),
            }
        )

    found = distinct.select("x", weight).mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s"))
    by_dim = {row.dim: int(row.s) for row in found.collect()}
    total = by_dim.pop(-1, 0)
    return total, [by_dim.get(i, 0) for i in range(width)]


def _covariance(vectors: DataFrame, column: str, weight: str, mean: np.ndarray, total: int) -> np.ndarray:
    """The covariance of an array column: a weighted product of the centred vectors in each task, then sums of its rows.

    The driver sees the matrix once, whatever the number of vectors."""
    width = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = np.zeros((width, width)), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                centred = _matrix(piece.column(0), width, float) - mean
                out += (centred * piece.column(1).to_numpy()[:, None]).T @ centred
                part = int(piece.column(2)[0].as_py())
        yield _rows(np.arange(width), np.full(width, part % FAN), out)

    def added(rows: pa.Table) -> pa.Table:
        total_row = np.zeros(width)
        for row in rows["row"]:
            total_row += np.asarray(row.values)
        return pa.Table.from_batches([_rows(rows["i"][:1].to_numpy(), rows["part"][:1].to_numpy(), total_row[None])])

    schema = "i int, part int, row array<double>"
    parts = vectors.select(column, weight, F.spark_partition_id()).mapInArrow(products, schema)
    few = parts.groupBy("i", "part").applyInArrow(added, schema)
    out = np.zeros((width, width))
    for row in few.groupBy("i").applyInArrow(added, schema).collect():
        out[row.i] = row.row
    return out / total


def _rows(i: np.ndarray, part: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.RecordBatch.from_pydict(
        {
            "i": pa.array(i, pa.int32()), "part": pa.array(part, pa.int32()),
            "row": pa.ListArray.from_arrays(ends, pa.array(matrix.ravel())),
        }
    )


def _whitened(distinct: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> DataFrame:
    """`x`, `copies`, `deviation` and `whitened` of every distinct vector."""
    width = len(sums)
    mean = np.array([s / n for s in sums]) if n else np.zeros(0)

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = float(n) * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
        if width * largest**2 < _LIMIT:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
        return [d if d < 2 * _LIMIT else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                x = _matrix(piece.column(0), width, np.int64)
                found = (x - mean) @ basis
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * basis.shape[1])
                values = pa.array(found.ravel(), mask=np.isnan(found.ravel()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "x": piece.column(0), "copies": piece.column(1), "deviation": pa.array(deviations(x), pa.int64()),
                        "whitened": pa.ListArray.from_arrays(ends, values),
                    }
                )

    return distinct.select("x", "copies").mapInArrow(
        run, "x array<bigint>, copies bigint, deviation bigint, whitened array<double>"
    )


def whiten(df: DataFrame, components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """For each row with a usable vector: vec_id, n, deviation, whitened, explained, identity_error.

    The vector x is floor(256 c) of the entries. Distinct vectors are the fit list, each with weight one or, with
    `weights="counts"`, as often as it occurs; n is the sum of the weights, S of the weighted vectors. `deviation` is the
    sum over dimensions of (n x - S)^2, exact, or null where that passes 64 bits. `whitened` has x - S / n projected on
    the first eigenvectors of the covariance, by falling eigenvalue, each over the root of its eigenvalue; `explained` the
    eigenvalues' shares of the trace. `identity_error` is the largest absolute entry of the covariance of `whitened`
    minus the identity. All covariances are centred before multiplying.

    Rows with a null vector, or null or non-finite entries in it, are left out; a null vec_id is kept, and repeated rows
    each get a row. A component without variance has nulls in `whitened` and counts in no error; without any variance,
    `explained` and `identity_error` are null too. Shorter vectors end in zeros; there are no more components than
    dimensions. An empty table gives no rows. Further columns of `df` are not read. Memory of tasks and driver
    grows with the square of the dimensions, not with the rows.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    weight = "copies" if weights == "counts" else "single"
    vectors = stage(usable(df).withColumn("pos", F.monotonically_increasing_id()), "vectors")
    rows, least, most = vectors.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(most) - F.size("x"))
        vectors = vectors.withColumn("x", F.concat("x", zeros))
    distinct = stage(
        vectors.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("single", F.lit(1).cast("bigint")),
        "distinct-vectors",
    )
    n, sums = _sums(distinct, weight, most or 0)
    width = len(sums)
    kept = min(components, width)
    mean = np.array([s / n if n else 0.0 for s in sums])
    values, basis = np.zeros(0), np.zeros((0, 0))
    if kept:
        values, basis = np.linalg.eigh(_covariance(distinct, "x", weight, mean, n))
    trace = values.sum()
    values, basis = values[::-1][:kept], basis[:, ::-1][:, :kept]
    flat = ~(values > trace * width * np.finfo(float).eps)
    scaled = basis / np.sqrt(np.where(flat, np.nan, values))
    whitened = stage(_whitened(distinct, n, sums, scaled), "whitened")

    error = None
    live = np.nonzero(~flat)[0]
    if len(live):
        chosen = whitened.select(
            F.array(*[F.element_at("whitened", int(i) + 1) for i in live]).alias("w"), "copies",
            F.lit(1).cast("bigint").alias("single"),
        )
        of_fit = F.col(weight).cast("double")
        means = chosen.agg(*[F.sum(F.col("w")[i] * of_fit) / n for i in range(len(live))]).first()
        error = float(np.abs(_covariance(chosen, "w", weight, np.array(means, float), n) - np.eye(len(live))).max())
    shares = [float(v / trace) if trace > 0 else None for v in values]

    page = max(PAGE, rows // MOST_HOT)
    pages = F.ceil(F.col("copies") / page)
    # No more than MOST_HOT vectors can have so many copies.
    hot = distinct.where(pages > 1).select(F.col("x").alias("_x"), pages.alias("_pages"))
    dealt = vectors.join(F.broadcast(hot), F.col("x") == F.col("_x"), "left").select(
        "vec_id", "x", F.pmod("pos", F.coalesce("_pages", F.lit(1))).alias("page")
    )
    on_pages = whitened.select(
        "x", F.explode(F.sequence(F.lit(0).cast("bigint"), pages - 1)).alias("page"), "deviation", "whitened"
    )
    return dealt.join(on_pages, ["x", "page"]).select(
        "vec_id",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(s).cast("double") for s in shares]).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
