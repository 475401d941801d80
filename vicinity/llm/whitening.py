"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers, so sums and the scatter are exact: tasks subtract the
whole number nearest to the mean before they multiply, and the driver, which sees one
scatter matrix a vector length and no rows, corrects for the rest of the mean in whole
numbers.  The covariance matrix is factored with pivoting; plane rotations then make
the columns of the triangular factor orthogonal, without forming a product again, so
that small eigenvalues keep their digits.  Squared column norms are the eigenvalues,
normalised columns the components.

Vectors of each length are whitened apart.  Dropped are rows whose vector is null, or
holds a null or non-finite entry, or one beyond what the whole numbers (64 bits) hold.
Rows that repeat count again; a null id is an id.  A component whose eigenvalue isn't
above the rounding of the largest has no whitened value (null, as for equal vectors);
deviation is null where it needs more than 64 bits.  Empty vectors have no components;
an empty table gives no rows.  Other columns are ignored.
"""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
EXACT = 2.0**52  # whole numbers below this are exact in double precision
ROWS = 4096


def usable(vector: Column) -> Column:
    """Whether there are entries, all finite, that fit in a long once scaled."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= 2.0**63 / SCALE - 2.0**20)), F.lit(False))


def _whole(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: (row numbers, x as longs)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(column.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64) + SHIFT
    first, out = column.offsets.to_numpy()[:-1], {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = rows, values[first[rows][:, None] + np.arange(d)[None, :]]
    return out


LIMBS = ("top", "high", "mid", "low")  # a whole number is top * 2^96 + high * 2^64 + mid * 2^32 + low
PARTS = "d int, n long, at long, top long, high long, mid long, low long"


def _rows(sums: dict) -> pa.RecordBatch:
    """A task's sums (by vector length: rows, whole numbers) as PARTS."""
    cols: list = [[] for _ in range(7)]
    for d, (n, values) in sums.items():
        for at, v in enumerate(values.tolist()):
            for c, x in zip(cols, (d, n, at, v >> 96, v >> 64 & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF, v & 0xFFFFFFFF)):
                c.append(x)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["d", "n", "at", *LIMBS])


def _sums_of(parts: DataFrame) -> dict[int, tuple[int, dict[int, int]]]:
    """By vector length: (rows, {position: sum}), from the PARTS of all tasks."""
    total = parts.groupBy("d", "at").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in LIMBS))
    out: dict = {}
    for r in total.collect():  # one row for each entry of the matrices
        out.setdefault(r.d, (r.n, {}))[1][r.at] = (r.top << 96) + (r.high << 64) + (r.mid << 32) + r.low
    return out


def _products(y: np.ndarray) -> np.ndarray:
    """The upper triangle of y'y, exactly, as whole numbers of any size."""
    d = y.shape[1]
    upper = np.triu_indices(d)
    most = float(np.abs(y).max()) if y.size else 0.0
    total = np.zeros(len(upper[0]), object)
    if most * most < EXACT:
        rows = max(1, int(min(ROWS, EXACT / max(1.0, most * most))))
        for at in range(0, len(y), rows):
            z = y[at : at + rows].astype(np.float64)
            total = total + (z.T @ z)[upper].astype(np.int64).astype(object)
    else:
        for row in y.astype(object):
            total = total + row[upper[0]] * row[upper[1]]
    return total


def covariance(n: int, sums: list[int], products: list[int]) -> np.ndarray:
    """(n * sum of products - product of sums) / n^2, rounded once."""
    d = len(sums)
    v = np.zeros((d, d))
    for i, j, p in zip(*np.triu_indices(d), products):
        v[i, j] = v[j, i] = float(Fraction(n * p - sums[i] * sums[j], n * n))
    return v


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', of as many columns as v has rank, rows in the order of v."""
    d = len(v)
    rest, columns = np.diag(v).astype(np.float64).copy(), []
    floor = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for _ in range(d):
        p = int(np.argmax(rest))
        if not rest[p] > floor:
            break
        done = np.array(columns).reshape(len(columns), d)
        column = (v[:, p] - done.T @ done[:, p]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0  # rows of earlier pivots: the factor is triangular in pivot order
        column[p] = np.sqrt(rest[p])
        columns.append(column)
        rest = rest - column * column
        rest[p] = -np.inf
    return np.array(columns).reshape(len(columns), d).T


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of factor factor', falling.  Rotates pairs of
    columns, each pair of a round apart from the others, until all are orthogonal."""
    a = np.array(factor, np.float64)
    r = a.shape[1]
    players = np.arange(r + r % 2)
    for _ in range(sweeps if r > 1 else 0):
        most = 0.0
        for _ in range(len(players) - 1):
            p, q = players[: len(players) // 2], players[len(players) // 2 :][::-1]
            p, q = (x[(p < r) & (q < r)] for x in (p, q))
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(float).tiny))
            most = max(most, float(cosine.max()))
            turn = cosine > 1e-16
            zeta = (yy - xx) / (2 * np.where(turn, xy, 1))
            t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, t), 1)
            s = np.where(turn, c * t, 0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if most <= len(a) * np.finfo(float).eps:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    a = a[:, order] / norms[order]
    return norms[order] ** 2, a * np.where(a[np.abs(a).argmax(0), np.arange(r)] < 0, -1, 1) if r else a


def fit(vectors: DataFrame, vector_col="embedding", most: int = 32) -> dict[int, dict]:
    """By vector length: n, sums S, whole centre, components, eigenvalues, trace.  The
    bound of what the driver holds is the square of each length."""
    rows = vectors.where(usable(F.col(vector_col))).select(vector_col)

    def sum_up(batches):
        sums: dict = {}
        for batch in batches:
            for d, (at, x) in _whole(batch.column(0)).items():
                n, s = sums.get(d, (0, np.zeros(d, object)))
                low = x & 0xFFFFFFFF  # halves, so that sums of longs can't overflow
                sums[d] = n + len(at), s + (x >> 32).sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
        yield _rows(sums)

    models = {}
    for d, (n, s) in _sums_of(rows.mapInArrow(sum_up, PARTS)).items():
        s = [s[k] for k in range(d)]
        models[d] = {"n": n, "sums": s, "centre": [(2 * v + n) // (2 * n) for v in s]}
    centres = {d: np.array(m["centre"], np.int64) for d, m in models.items()}

    def multiply(batches):
        sums: dict = {}
        for batch in batches:
            for d, (at, x) in _whole(batch.column(0)).items():
                n, s = sums.get(d, (0, 0))
                sums[d] = n + len(at), s + _products(_centred(x, centres[d]))
        yield _rows(sums)

    for d, (n, p) in _sums_of(rows.mapInArrow(multiply, PARTS)).items():
        m = models[d]
        v = covariance(n, [s - n * c for s, c in zip(m["sums"], m["centre"])], [p[k] for k in range(d * (d + 1) // 2)])
        e, q = one_sided_jacobi(pivoted_cholesky(v))
        sound = e > d * np.finfo(float).eps * e.max(initial=0.0)
        m |= {"values": e[sound][:most], "components": q[:, sound][:, :most], "trace": float(np.trace(v)), "width": min(d, most)}
    return models


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre as longs, or as whole numbers of any size where a long might overflow."""
    wide = len(x) and (float(np.abs(x.astype(np.float64)).max()) + float(np.abs(centre.astype(np.float64)).max()) >= 2.0**62)
    return x.astype(object) - centre.astype(object) if wide else x - centre


def _whitened(y: np.ndarray, m: dict) -> np.ndarray:
    """Projections of the centred rows over the square roots of the eigenvalues; each
    row's result is the same whatever rows it comes with."""
    rest = np.array([float(Fraction(s, m["n"]) - c) for s, c in zip(m["sums"], m["centre"])])
    return np.einsum("ij,jk->ik", y.astype(np.float64) - rest, m["components"] / np.sqrt(m["values"]), optimize=False)


def _deviations(y: np.ndarray, m: dict) -> list:
    """Sum of (n x - S)^2, exact; null beyond 64 bits."""
    n, rest = m["n"], [s - m["n"] * c for s, c in zip(m["sums"], m["centre"])]
    most = (float(np.abs(y).max()) * n + n) if y.size else 0.0
    if most * most * y.shape[1] < 2.0**62:
        return (((y * n) - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = ((y.astype(object) * n - np.array(rest, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def identity_errors(vectors: DataFrame, models: dict, vector_col="embedding") -> dict[int, float]:
    """By vector length: the largest entry of the whitened values' covariance, as it is
    over all rows, minus the identity.  Sums of tasks are rounded to 2^-40, so that the
    order in which they are added doesn't matter."""

    def multiply(batches):
        sums: dict = {}
        for batch in batches:
            for d, (at, x) in _whole(batch.column(0)).items():
                w = _whitened(_centred(x, centres[d]), models[d])
                n, s = sums.get(d, (0, 0.0))
                sums[d] = n + len(at), s + (w.T @ w)[np.triu_indices(w.shape[1])]
        yield _rows({d: (n, np.array([round(v * 2**40) for v in s.tolist()], object)) for d, (n, s) in sums.items()})

    centres = {d: np.array(m["centre"], np.int64) for d, m in models.items()}
    out = dict.fromkeys(models, 0.0)
    rows = vectors.where(usable(F.col(vector_col))).select(vector_col)
    for d, (n, s) in _sums_of(rows.mapInArrow(multiply, PARTS)).items():
        for k, (i, j) in enumerate(zip(*np.triu_indices(len(models[d]["values"])))):
            out[d] = float(max(out[d], abs(s[k] / 2**40 / n - (i == j))))
    return out


def whiten(vectors: DataFrame, id_col="vec_id", vector_col="embedding", most: int = 32) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every
    usable row and each component up to `most`."""
    models = fit(vectors, vector_col, most)
    errors = identity_errors(vectors, models, vector_col)
    centres = {d: np.array(m["centre"], np.int64) for d, m in models.items()}
    spark = vectors.sparkSession

    def run(batches):
        for batch in batches:
            for d, (at, x) in _whole(batch.column(1)).items():
                m, y = models[d], _centred(x, centres[d])
                w = np.full((len(at), m["width"]), np.nan)
                w[:, : len(m["values"])] = _whitened(y, m)
                flat = pa.array(w.reshape(-1), mask=np.isnan(w).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * m["width"], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), d), pa.int32()), pa.array(_deviations(y, m), pa.int64()), lists], ["id", "d", "deviation", "w"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), vector_col)
    found = rows.mapInArrow(run, f"id {kind}, d int, deviation long, w array<double>")
    facts = []  # at most `most` rows for each length
    for d, m in models.items():
        share = [float(v) / m["trace"] for v in m["values"]] if m["trace"] else []
        share += [0.0 if m["trace"] else None] * (m["width"] - len(share))
        facts += [(d, k + 1, m["n"], s, errors[d]) for k, s in enumerate(share)]
    facts = F.broadcast(spark.createDataFrame(facts, "d int, component int, n long, explained double, identity_error double"))
    out = found.select("id", "d", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1).join(facts, ["d", "component"])
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
