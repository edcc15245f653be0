"""Whitened principal components of a table of vectors, by a randomised range finder.

The fit list holds every distinct vector of whole numbers once. A random subspace of a few dimensions more than
components are asked for goes through power passes; each pass multiplies all centred vectors of the list with the
subspace, and the small matrix that comes with it gives Ritz values and vectors (Rayleigh-Ritz) and their residuals. They are
taken once the residuals are small beside the distance to the other eigenvalues and what is left of the trace is below the
last component's eigenvalue, which rules out that a component was overlooked. Where that is out of reach (a flat
spectrum), the subspace grows to the full dimension, in which one pass gives all eigenvectors.

A pass is one scan of the written fit list: a matrix a task, summed by blocks of rows in two groupings, so that the driver
gets one matrix and no task more than a few hundred blocks.
"""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.storage import fresh, materialize

#: Dimensions up to which the full dimension is taken: a square matrix of doubles then has 128 MB at most.
MOST_DIMENSIONS = 4096
#: Residual over distance to the next eigenvalue, up to which a Ritz vector is an eigenvector.
TOLERANCE = 1e-11
#: Eigenvalues below this part of the largest one count as zero.
ZERO = 1e-12
#: Partial matrices of as many groups of tasks are summed before the last grouping; bytes of a block.
SLOTS, BLOCK_BYTES = 256, 1 << 20

RESULTS = {"component": "int", "n": "bigint", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}


def whole_numbers(vector: Column, scale: int) -> Column:
    """The array of floor(scale * entry) as longs, beyond their range its nearest end; null where the vector or an entry is null or not finite."""
    entries = vector.cast("array<double>")
    infinite = float("inf")
    finite = F.forall(entries, lambda c: F.coalesce((F.abs(c) < infinite) & ~F.isnan(c), F.lit(False)))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * F.lit(float(scale)))))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The batch's first column as rows of ``dims`` longs; shorter vectors end in zeros."""
    lists = batch.column(0)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    full = np.zeros((len(lists), dims), np.int64)
    full[np.arange(dims) < sizes[:, None]] = values
    return full


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension: halves of 32 bits are summed apart."""

    def run(batches):
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dimension": pa.array(np.arange(dims)), "high": pa.array(high), "low": pa.array(low)})

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = fit.mapInArrow(run, "dimension bigint, high bigint, low bigint").groupBy("dimension").agg(*exact).collect()
    return [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(rows)]


def _summed(fit: DataFrame, dims: int, part, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``part`` (of a matrix of vectors, returns a matrix of ``shape``)."""
    each = max(1, BLOCK_BYTES // (8 * shape[1]))

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            total += part(_matrix(batch, dims))
        blocks = [total[k : k + each].tobytes() for k in range(0, shape[0], each)]
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "slot": pa.array([slot] * len(blocks), pa.int32()), "data": pa.array(blocks, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("data")], axis=0)
        return table.slice(0, 1).set_column(2, "data", pa.array([total.tobytes()], pa.binary()))

    schema = "block int, slot int, data binary"
    parts = fit.mapInArrow(run, schema).groupBy("block", "slot").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    return np.frombuffer(b"".join(bytes(r["data"]) for r in sorted(parts.collect()))).reshape(shape)


def _worst(theta: np.ndarray, residuals: np.ndarray, rest: float, wanted: int) -> float:
    """The largest residual over the distance to any other eigenvalue; infinite where that distance isn't known to be positive."""
    worst = 0.0
    for k in range(wanted):
        others = np.append(np.delete(theta, k), rest)
        distance = min(np.abs(others - theta[k]).min(), theta[k] - rest)
        worst = max(worst, residuals[k] / distance if distance > 0 else math.inf)
    return worst


def principal_components(fit: DataFrame, dims: int, n: int, mean: np.ndarray, wanted: int, oversample: int = 8, most_passes: int = 12, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Eigenvalues (falling), unit eigenvectors (columns), the trace of the covariance and the last subspace's dimension.

    ``fit`` has one column, the vectors; the covariance is that of its rows around ``mean`` with divisor ``n``.
    """
    wanted, width = min(wanted, dims), min(dims, wanted + oversample)
    random = np.random.default_rng(seed)
    basis, before = np.linalg.qr(random.standard_normal((dims, width)))[0], math.inf
    for done in range(1, most_passes + 2):
        shared = fit.sparkSession.sparkContext.broadcast((basis, mean))

        def part(x: np.ndarray, shared=shared) -> np.ndarray:
            q, centre = shared.value
            c = x - centre
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), np.vdot(c, c))])

        product = _summed(fit, dims, part, (dims + 1, width)) / n
        shared.unpersist()
        image, trace = product[:-1], float(product[-1, 0])
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz = basis @ turn
        if width == dims:
            break
        rest = max(0.0, trace - float(theta.sum()))
        worst = _worst(theta, np.linalg.norm(image @ turn - ritz * theta, axis=0), rest, wanted)
        if worst <= TOLERANCE:
            break
        if worst == math.inf:
            hopeless = done > 2
        else:
            rate = worst / before
            hopeless = 0 < rate and (rate >= 1 or done + math.log(TOLERANCE / worst) / math.log(rate) > most_passes)
        if hopeless:
            if dims > MOST_DIMENSIONS:
                raise ValueError(f"the spectrum needs all {dims} dimensions, more than {MOST_DIMENSIONS}")
            basis, width = np.linalg.qr(np.hstack([ritz, random.standard_normal((dims, dims - width))]))[0], dims
        else:
            basis = np.linalg.qr(image)[0]
        before = worst
    return theta[:wanted], ritz[:, :wanted], trace, width


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256, **search) -> DataFrame:
    """The rows with a usable vector, once for each of the first ``components`` components of the fit list.

    A vector's entries become x = floor(``scale`` * entry). Rows whose vector is null or holds a null or
    non-finite entry are left out. Vectors shorter than the longest end in zeros; entries beyond the range of a long take its end.
    Added columns (an underscore in front where the name is taken): component (from 1, by falling eigenvalue e of the
    covariance of the distinct x), n (distinct x), deviation (sum of (n * x - sums)^2, exact, null beyond 38
    digits), whitened (x less the mean, on the component, over sqrt(e)), explained (e over the trace), identity_error
    (largest entry of whitened's covariance over the fit list minus the identity). A component with e = 0 has whitened null and explained 0;
    identity_error is of the others, null if there are none. Repeated rows and null ids are rows as any. An empty table, one without
    usable vectors, or with empty vectors only, gives no rows. The sign of a component is arbitrary, but one for all rows.
    """
    x = fresh("_x", rows)
    names = {c: fresh(c, rows) for c in RESULTS}
    kept = rows.withColumn(x, whole_numbers(F.col(f"`{vector}`"), scale)).where(F.col(x).isNotNull())
    fit = materialize(kept.select(x).distinct(), "whitening-fit")
    n, dims = fit.agg(F.count("*"), F.max(F.size(x))).first()
    schema = T.StructType([*rows.schema.fields, *(T.StructField(names[c], T._parse_datatype_string(t)) for c, t in RESULTS.items())])
    if not n or not dims:
        return rows.sparkSession.createDataFrame([], schema)
    sums = _sums(fit, dims)
    mean = np.array([s / n for s in sums])
    values, vectors, trace, _ = principal_components(fit, dims, n, mean, components, **search)
    count = len(values)
    positive = values > ZERO * max(values[0], 0.0)
    onto = vectors * np.where(positive, 1 / np.sqrt(np.where(positive, values, 1.0)), 0.0)
    explained = np.where(positive, values, 0.0) / (trace or 1.0)
    shared = rows.sparkSession.sparkContext.broadcast((onto, mean, sums))

    def moments(block: np.ndarray) -> np.ndarray:
        w = (block - shared.value[1]) @ shared.value[0]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moment = _summed(fit, dims, moments, (count + 1, count)) / n
    covariance = moment[:-1] - np.outer(moment[-1], moment[-1])
    kept_axes = np.flatnonzero(positive)
    error = float(np.abs(covariance - np.eye(count))[np.ix_(kept_axes, kept_axes)].max()) if len(kept_axes) else None
    total = max(map(abs, sums))

    def deviations(block: np.ndarray) -> pa.Array:
        most = n * max(abs(int(block.min(initial=0))), abs(int(block.max(initial=0)))) + total
        if dims * most * most < 2**63:
            return pa.array(((block * n - np.array(sums)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = ((block.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))

    def run(batches):
        for batch in batches:
            block = _matrix(batch.select([batch.num_columns - 1]), dims)
            w = (block - mean) @ shared.value[0]
            each = np.repeat(np.arange(len(block)), count)
            alike = lambda values, kind: pa.array(np.tile(values, len(block)), kind)
            whitened = pa.array(w.ravel(), pa.float64(), mask=np.tile(~positive, len(block)))
            added = [alike(np.arange(1, count + 1), pa.int32()), alike(np.full(count, n), pa.int64()), deviations(block).take(pa.array(each)), whitened, alike(explained, pa.float64()), pa.array([error] * len(each), pa.float64())]
            given = batch.select(range(batch.num_columns - 1)).take(pa.array(each))
            yield pa.RecordBatch.from_arrays([*given.columns, *added], names=schema.names)

    return kept.mapInArrow(run, schema)
