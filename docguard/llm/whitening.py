"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred table.

With X the centred rows over the root of their number, alternating products u = Xv - beta u' and v = X'u - alpha v' bring X
to a bidiagonal matrix whose singular values are the deviations and whose right vectors give the components. Each
product is one Spark job over the integer rows, written in blocks. Left vectors are as long as the table and are never stored:
u_k = X c_k with c_k as wide as a vector, so a pass recomputes the entries of all u_j for its rows, and inner products of
u_k with the earlier ones come from the rows themselves. Both sides are fully reorthogonalised. The process runs until the
space is exhausted (as many steps as dimensions, two jobs each), with a fresh direction after a breakdown, so that
components with equal deviations are all found. What reaches the driver is a few sums as wide as a vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import Handoff

SCALE, SHIFT = 1024, 100_000
#: Directions with less than this share of the greatest deviation count as none.
RANK = 1e-10
#: Greatest value of a long.
LONG = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x array<bigint>) with x = floor(1024 c) + 100000, c as double; rows without a usable vector are left out.

    Unusable: null, without entries, or with a null or non-finite entry.
    """
    own = df.selectExpr(f"bigint(`{id_column}`) AS id", f"CAST(`{vector}` AS array<double>) AS c")
    bad = "exists(c, e -> e IS NULL OR isnan(e) OR abs(e) = double('infinity'))"
    return own.filter("c IS NOT NULL AND size(c) > 0").filter(f"NOT ({bad})").selectExpr(
        # guarded once more: Spark may compute x before it filters
        "id", f"transform(c, e -> if(isnan(e) OR abs(e) = double('infinity'), NULL, floor({SCALE}D * e) + {SHIFT}L)) AS x")


def _rows(batch, dims: int) -> np.ndarray:
    """The integer vectors of an Arrow batch as a matrix."""
    return np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, dims)


def packed(vectors: DataFrame, dims: int, size: int = 1 << 21) -> DataFrame:
    """(x binary): blocks of vectors, each of at most `size` bytes, so that a pass reads bytes and no lists."""
    def run(batches):
        import pyarrow as pa
        rows = max(1, size // (8 * dims))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.record_batch([pa.array([_rows(batch.slice(at, rows), dims).tobytes()], pa.binary())], names=["x"])

    return vectors.select("x").mapInArrow(run, "x binary")


class Centred:
    """The centred table as an operator: n, dims, per-dimension sums, and distributed products with it.

    Products run over blocks (see packed), written once by the caller.
    """

    def __init__(self, vectors: DataFrame, dims: int, blocks: DataFrame):
        self.blocks, self.dims = blocks, dims
        sums = vectors.selectExpr("posexplode(x) AS (d, e)").groupBy("d").agg(F.expr("sum(e) AS s"), F.expr("count(1) AS n"))
        held = {r.d: (r.s, r.n) for r in sums.collect()}
        self.n = held[0][1]
        self.sums = [int(held[d][0]) for d in range(dims)]

    def total(self, per_block) -> np.ndarray:
        """Sum over all rows of per_block(centred rows / sqrt(n)), a vector of doubles for each block of rows."""
        n, dims, sums = self.n, self.dims, np.array(self.sums, dtype=object)
        # the mean as two doubles, so that centring loses nothing beyond the last place
        high = np.array([float(int(s) // n) for s in sums])
        low = np.array([float(int(s) % n) / n for s in sums])

        def run(batches):
            import pyarrow as pa
            out = None
            for batch in batches:
                for held in batch.column("x"):
                    x = np.frombuffer(held.as_buffer(), np.int64).reshape(-1, dims)
                    part = per_block(((x - high.astype(np.int64)) - low) / np.sqrt(n))
                    out = part if out is None else out + part
            if out is not None:
                yield pa.record_batch([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], names=["k", "s"])

        held = self.blocks.mapInArrow(run, "k int, s double").groupBy("k").agg(F.expr("sum(s) AS s")).collect()
        out = np.zeros(len(held))
        for r in held:
            out[r.k] = r.s
        return out

    def left_products(self, c: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """For u = X c: its inner products with each X c_j and with itself, from the entries of all rows."""
        both = np.vstack([earlier, c]) if len(earlier) else c[None]
        return self.total(lambda x: (u := x @ both.T).T @ u[:, -1])

    def right_product(self, c: np.ndarray) -> np.ndarray:
        """X' u for u = X c."""
        return self.total(lambda x: x.T @ (x @ c))


def _clear(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v less its parts along an orthonormal basis, twice."""
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(table: Centred, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(V, alphas, betas): orthonormal right vectors as rows and the upper bidiagonal matrix, over the whole space.

    c_k holds u_k = X c_k. After correction by the inner products with earlier left vectors the norm is measured
    again on the rows. A left vector that vanishes or a right one without a rest is a breakdown: the entry is 0 and the
    process goes on with a fresh direction.
    """
    d, rng = table.dims, np.random.default_rng(seed)
    rights, lefts, alphas, betas = [], [], [], []
    v, beta, scale = None, 0.0, 0.0
    while len(rights) < d:
        if v is None:
            v = _clear(rng.standard_normal(d), rights)
            v = _clear(v / np.linalg.norm(v), rights)
            v /= np.linalg.norm(v)
        rights.append(v)
        betas.append(beta)
        c = v - (beta * lefts[-1] if beta else 0.0)
        kept = [x for x in lefts if x is not None]
        inner = table.left_products(c, np.array(kept))
        for h, x in zip(inner[:-1], kept):
            c = c - h * x
        # the norm after the correction: the left vectors are orthonormal
        alpha = float(np.sqrt(max(inner[-1] - inner[:-1] @ inner[:-1], 0.0)))
        scale = max(scale, alpha, beta)
        if alpha <= RANK * scale:
            alphas.append(0.0)
            lefts.append(None)
            v, beta = None, 0.0
            continue
        if alpha * alpha < 0.5 * inner[-1]:
            alpha = float(np.sqrt(table.left_products(c, np.zeros((0, d)))[-1]))
        c = c / alpha
        alphas.append(alpha)
        lefts.append(c)
        rest = _clear(table.right_product(c) - alpha * v, rights)
        beta = float(np.linalg.norm(rest))
        v, beta = (rest / beta, beta) if beta > RANK * scale else (None, 0.0)
        if v is not None:
            v = _clear(v, rights)
            v /= np.linalg.norm(v)
    return np.array(rights), np.array(alphas), np.array(betas)


def components(table: Centred) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as rows, their variances, falling; the trace): from the singular vectors of the bidiagonal matrix."""
    rights, alphas, betas = bidiagonalise(table)
    small = np.diag(alphas) + np.diag(betas[1:], 1)
    _, deviations, turned = np.linalg.svd(small)
    found = turned @ rights
    return found, deviations ** 2, float((alphas ** 2).sum() + (betas ** 2).sum())


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows with a null vector, an empty one, or one with null or non-finite entries are left out; so are vectors of another
    length than most have (of equally frequent lengths the greater one counts). Components are numbered by falling
    variance; a direction in which the vectors do not differ cannot be whitened and is no component, so fewer than
    `most` may come back, and none for a single vector. Repeated rows and ties count and get rows of their own; rows
    with a null id are kept. An empty table gives no rows; other columns are ignored. deviation is exact; the job fails
    if it, or an x, does not fit a long.
    """
    spark, hand = df.sparkSession, Handoff(df.sparkSession, "whitening")
    schema = f"`{id_column}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = hand.write(integer_vectors(df, id_column, vector), "vectors")
    lengths = vectors.groupBy(F.expr("size(x)").alias("d")).agg(F.expr("count(1) AS n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        hand.drop()
        return spark.createDataFrame([], schema)
    dims = lengths.d
    vectors = vectors.filter(f"size(x) = {dims}")
    table = Centred(vectors, dims, hand.write(packed(vectors, dims), "blocks"))
    found, variances, trace = components(table)
    used = [k for k in range(min(most, dims)) if variances[k] > (RANK ** 2) * variances[0] and variances[k] > 0]
    if not used:
        hand.drop()
        return spark.createDataFrame([], schema)
    axes = found[used] / np.sqrt(variances[used])[:, None]
    n, sums, k = table.n, table.sums, len(used)

    # the covariance of what is returned, less the identity
    moments = table.total(lambda x: np.concatenate([(w := x @ axes.T).sum(0) / np.sqrt(n), (w.T @ w).ravel()]))
    mean, square = moments[:k], moments[k:].reshape(k, k)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    hand.drop("blocks")
    explained = variances[used] / trace

    def run(batches):
        import pyarrow as pa
        high = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _rows(batch, dims) - high
                # n x - S = n (x - S div n) - S mod n; exact in Python's numbers where a long could overflow
                far = float(np.abs(x).max(initial=0) + 1) * n
                if far * far * dims < LONG:
                    deviation = ((n * x - rest) ** 2).sum(1)
                else:
                    deviation = [sum((n * e - r) ** 2 for e, r in zip(row, rest.tolist())) for row in x.tolist()]
                    if max(deviation) > LONG:
                        raise OverflowError("a deviation does not fit a long")
                white = (x - rest / n) @ axes.T
                rows = batch.num_rows
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(rows), k)))
                yield pa.record_batch([
                    ids, pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(np.repeat(np.array(deviation, np.int64), k)), pa.array(white.ravel()),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                    names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("id", "x").mapInArrow(run, schema)
