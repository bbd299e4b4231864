"""Embedding whitening by QDWH spectral divide and conquer.

An entry ``c`` of a vector is used as the integer ``floor(64 * c) + 1000000``.
The fit list holds each distinct integer vector once. Spark reduces it to the
row count, the exact sums and the centred covariance; only these (numbers that
depend on the dimension, not on the rows) reach the driver.

The covariance ``A`` is split without a general eigensolver: the orthogonal
polar factor ``U`` of ``A - shift * I`` comes from QDWH iterations (dynamically
weighted Halley steps: by QR while badly conditioned, by Cholesky after that),
``(U + I) / 2`` projects on the invariant subspace above the shift, two steps
of subspace iteration give bases of it and of its complement, and the two
smaller blocks are split again until they are single components. Blocks that
lie wholly behind the wanted components are not split.

The basis is broadcast and every row is projected where it is read.

Defined cases: rows whose vector is null or holds null or non-finite entries
are dropped; so are vectors of another length than the commonest one of the
fit list (ties: the longest), for they have no covariance with the others;
entries beyond 2**50 / 64 count as that bound. A component whose variance is not
above rounding error has no whitened value and is not returned, so a table of
one distinct vector, of empty vectors or without rows gives no rows. Repeated
rows are returned each; a null vec_id is an id like any other; extra columns
are ignored by the digest and kept by ``whiten``, whose new column gets the
next free name. An exact deviation that does not fit its type is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.tables import free_name, materialise, quoted

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
MOST = 1 << 50
EPS = float(np.finfo(np.float64).eps)
BLOCK_ROWS = 4096


# ---- spectral divide and conquer (driver, dimension x dimension) -----------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH iterations."""
    n = len(a)
    eye = np.eye(n)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    try:  # a lower bound of the least singular value
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, EPS))
    while True:
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            factor = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(factor, x.T)
            new = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(factor.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        step = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 10 * EPS and step < (5 * EPS) ** (1 / 3):
            return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places inside the spectrum to split at, the likeliest first."""
    diagonal = np.diag(a)
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(len(a))) / np.sqrt(len(a))
    for part in (0.25, -0.25, 0.5, -0.5, 0.75, -0.75, 1 / 16, -1 / 16):
        yield float(diagonal.mean() + part * spread)


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift;
    none if all eigenvalues agree to rounding error."""
    n = len(a)
    eye = np.eye(n)
    if np.linalg.norm(a - np.diag(a).mean() * eye) <= 2 * EPS * n * scale:
        return None
    best = None
    for shift in _shifts(a):
        projector = (polar_factor(a - shift * eye) + eye) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        q, _ = np.linalg.qr(projector @ rng.standard_normal((n, k)))
        q, _ = np.linalg.qr(projector @ q, mode="complete")
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 20 * EPS * n * scale:
            break
    return None if best is None else best[1:]


def spectral_components(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix by
    falling eigenvalue; the first ``wanted`` of them. The largest entry of each
    vector is positive."""
    n = len(a)
    wanted = n if wanted is None else min(n, wanted)
    scale = np.linalg.norm(a)
    rng = np.random.default_rng(0)
    found: list[np.ndarray] = []
    blocks = [(0, np.eye(n))]  # (rank of the first component, basis), topmost last
    while blocks:
        first, basis = blocks.pop()
        if first >= wanted or not basis.shape[1]:
            continue
        inside = basis.T @ a @ basis
        inside = (inside + inside.T) / 2
        parts = _split(inside, scale, rng) if len(inside) > 1 else None
        if parts is None:
            found.append(basis)
        else:
            above, below = basis @ parts[0], basis @ parts[1]
            blocks += [(first + above.shape[1], below), (first, above)]
    vectors = np.hstack(found) if found else np.zeros((n, 0))
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)


# ---- fit (Spark) -----------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What a row needs to be whitened: bounded by the dimension."""

    n: int
    sums: list[int]
    basis: np.ndarray  # dimension x components
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n as an integer and a fraction, so that centring is exact
        before it is rounded."""
        whole = [s // self.n for s in self.sums]
        part = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]
        return np.array(whole, np.int64), np.array(part)


def integer_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which rows remain, the length of each row, and the
    integers of all rows one after the other."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become nan
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    good = np.isfinite(values)
    bad = np.concatenate([[0], np.cumsum(~good)])
    remains = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    bound = MOST / SCALE
    clipped = np.clip(np.where(good, values, 0.0), -bound, bound)
    return remains, lengths, np.floor(clipped * SCALE).astype(np.int64) + OFFSET


def integer_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """The integer vector ``x`` of every remaining row."""

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            remains, lengths, cells = integer_cells(batch.column(0))
            kept = lengths[remains]
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells[np.repeat(remains, lengths)]))
            yield pa.RecordBatch.from_arrays([x], names=["x"])

    return embeddings.select(vector).mapInArrow(convert, "x array<bigint>")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches: Iterable[pa.RecordBatch], name: str, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield _matrix(batch.column(name).slice(at, BLOCK_ROWS), width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact per-dimension sums: one partial row per task and
    dimension, added up by Spark."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, totals = 0, [0] * width
        for x in _blocks(batches, "x", width):
            rows += len(x)
            totals = [t + int(s) for t, s in zip(totals, x.sum(axis=0))]  # 4096 * (2**50 + OFFSET) fits
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(width), pa.int32()),
                    pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0)),
                    pa.array([rows] * width, pa.int64()),
                ],
                names=["i", "s", "n"],
            )

    parts = fit.mapInArrow(partial, "i int, s decimal(38,0), n bigint")
    rows = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [0] * width)


def _second_moment(fit: DataFrame, width: int, size: int, project) -> np.ndarray:
    """Sum of the outer products of ``project(block)`` (rows of ``size``
    values) over the fit list: one partial triangle per task."""
    upper = np.triu_indices(size)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        seen = False
        for x in _blocks(batches, "x", width):
            y = project(x)
            total += y.T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], names=["cell", "v"]
            )

    cells = fit.mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for r in cells:
        i, j = upper[0][r.cell], upper[1][r.cell]
        out[i, j] = out[j, i] = r.v
    return out


def _centre(mean: tuple[np.ndarray, np.ndarray]):
    whole, part = mean
    return lambda x: (x - whole).astype(np.float64) - part


def fit_whitening(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """Fit on the distinct integer vectors; None without a row to fit on."""
    # combines map-side: a vector that makes up a third of all rows is one row of each task
    fit, _ = materialise(integer_vectors(embeddings, vector).distinct(), "whitening-fit")
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    width = int(sizes.d)
    fit = fit.where(F.size("x") == width)
    n, sums = _sums(fit, width) if width else (1, [])  # there is one vector without entries
    plain = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)
    if n < 2:
        return plain
    centre = _centre(plain.mean)
    covariance = _second_moment(fit, width, width, centre) / n
    trace = float(np.trace(covariance))
    values, basis = spectral_components(covariance, components)
    sound = values > 8 * width * EPS * max(float(values[0]), 0.0) if len(values) else np.zeros(0, bool)
    values, basis = values[sound], basis[:, sound]
    if not len(values):
        return plain
    weights = basis / np.sqrt(values)
    whitened = _second_moment(fit, width, len(values), lambda x: centre(x) @ weights) / n
    # the whitened mean is zero: rows are centred by the exact mean
    error = float(np.abs(whitened - np.eye(len(values))).max())
    return Whitening(n, sums, basis, values, trace, error)


# ---- apply -----------------------------------------------------------------


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Sum over the dimensions of (n * x - S)**2, exactly."""
    spread = max((max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(0), x.max(0), sums)), default=0)
    far = max((max(abs(n * int(lo)), abs(n * int(hi))) for lo, hi in zip(x.min(0), x.max(0))), default=0)
    if x.shape[1] * spread * spread < 1 << 62 and far + max(map(abs, sums), default=0) < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        totals = (off * off).sum(axis=1).tolist()
    else:
        off = n * x.astype(object) - np.array(sums, object)
        totals = (off * off).sum(axis=1).tolist()
    return [Decimal(t) if t < 10**38 else None for t in totals]


def whiten(embeddings: DataFrame, model: Whitening | None, vector: str = "embedding", name: str = "whitened",
           keep_vector: bool = True) -> DataFrame:
    """All columns of the remaining rows (without the vector itself unless
    ``keep_vector``) plus ``name``: a struct of ``deviation`` (exact) and
    ``components`` (the whitened values)."""
    spark = embeddings.sparkSession
    struct = T.StructType([
        T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("components", T.ArrayType(T.DoubleType())),
    ])
    new = free_name(embeddings.columns, name)
    if model is None or not len(model.sums):
        return embeddings.where("false").withColumn(new, F.lit(None).cast(struct))
    width = len(model.sums)
    shared = spark.sparkContext.broadcast((model.n, model.sums, model.basis / np.sqrt(model.values), model.mean))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, weights, mean = shared.value
        centre = _centre(mean)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                remains, lengths, cells = integer_cells(piece.column("x"))
                remains &= lengths == width
                x = cells[np.repeat(remains, lengths)].reshape(-1, width)
                if not len(x):
                    continue
                values = centre(x) @ weights
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * values.shape[1])
                out = pa.StructArray.from_arrays(
                    [
                        pa.array(exact_deviation(x, n, sums), pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(offsets, pa.array(values.ravel())),
                    ],
                    names=["deviation", "components"],
                )
                row = piece.column("row").filter(pa.array(remains))
                yield pa.RecordBatch.from_arrays([row, out], names=["row", "out"])

    rows = embeddings.select(
        F.struct(*[quoted(c) for c in embeddings.columns if c != vector or keep_vector]).alias("row"),
        quoted(vector).alias("x"),
    )
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("out", struct)])
    return rows.mapInArrow(project, schema).select("row.*", F.col("out").alias(new))


def whitening_digest(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component."""
    rows = embeddings.select("vec_id", "embedding")
    model = fit_whitening(rows, components)
    explained = [] if model is None else [float(v / model.trace) for v in model.values]
    shares = F.array(*[F.lit(v) for v in explained]).cast("array<double>")
    return (
        whiten(rows, model, keep_vector=False)
        .select("vec_id", "whitened.deviation", F.posexplode("whitened.components").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(0 if model is None else model.n).cast("long").alias("n"),
            F.expr("try_cast(deviation AS bigint)").alias("deviation"),
            "whitened",
            F.get(shares, F.col("at")).alias("explained"),
            F.lit(0.0 if model is None else model.identity_error).alias("identity_error"),
        )
    )
