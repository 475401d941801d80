"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of cosine c or more have unit vectors at squared distance 2 - 2c or less.
Unit vectors are turned by a fixed rotation and cut into blocks of `block`
dimensions; each block gets its share of the squared distance in proportion to its
dimensions, and by the pigeonhole principle a pair within the whole budget is within
the share of one block at least.  Each block is a range join of its own: vectors are
dealt to cells of the block's first axis, wide enough that pairs in range meet in
exactly one cell, and a cell with many vectors is dealt out as pairs of tiles.  A
pair is taken up by the first block that finds it and is verified exactly, by cosine
in double precision of the vectors as given.

Equal vectors of a label are one class with a number of its own and a count, so copies
don't multiply pairs.
Links are counted where they are found and leave a task as one row per vector, with
one edge to the smallest vector of its group: no pair is emitted.

Only vectors of the same label (not null) and dimension are compared.  Vectors that
are null, zero or hold null or non-finite components link with nothing; others may be
of any size.  Rows that repeat an id add up their links and share its component: an id
with several vectors, or labels, is one node that has the links of all.  Extra columns
are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, written


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def turned(v: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; each row's result is the same whatever rows it comes with."""
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    return np.einsum("ij,kj->ik", unit, rotation(v.shape[1]), optimize=False)


def _stack(column) -> np.ndarray:
    """The vectors, each times a power of two, which leaves cosines as they are, so that
    its squares neither over- nor underflow."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.zeros((0, 1))
    v = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _blocks(d: int, block: int) -> list[tuple[int, int]]:
    return [(a, min(d, a + block)) for a in range(0, d, block)]


def _cells(classes: DataFrame, budget: float, block: int) -> DataFrame:
    """(rep, block, cell, home): the cells that each vector is dealt to."""

    def run(batches):
        for batch in batches:
            dims = np.asarray(pa.compute.list_value_length(batch.column(1)))
            out = [[], [], [], []]
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                u = turned(_stack(batch.column(1).take(pa.array(rows))))
                reps = batch.column(0).to_numpy()[rows]
                for b, (a, z) in enumerate(_blocks(int(d), block)):
                    reach = np.sqrt(budget * (z - a) / d) * (1 + 1e-9) + 1e-12
                    at = u[:, a] / (2 * reach)
                    cell = np.floor(at).astype(np.int64)
                    guest = np.flatnonzero((cell + 1 - at) <= 0.5 + 1e-9)
                    for rep, c, home in ((reps, cell, True), (reps[guest], cell[guest] + 1, False)):
                        out[0].append(rep), out[1].append(np.full(len(rep), b)), out[2].append(c), out[3].append(np.full(len(rep), home))
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())], ["rep", "block", "cell", "home"])

    return classes.select("rep", "v").mapInArrow(run, "rep long, block int, cell long, home boolean")


def _products(left, right, home, same, rows_at_once):
    """(rows, rows, whether only later ones count): what to compare in a pair of tiles.
    Pairs in range meet in one cell where one of them is at home, so guests aren't
    compared with guests; within a tile (same) each row is compared with those after it."""
    own, guests = left[home[left]], left[~home[left]]
    if same:
        order = np.concatenate([own, guests])
        for at in range(0, len(own), rows_at_once):
            yield own[at : at + rows_at_once], order[at:], True
        return
    for rows, others in ((own, right), (guests, right[home[right]])):
        for at in range(0, len(rows), rows_at_once):
            yield rows[at : at + rows_at_once], others, False


def _links_of(ids, v, times, home, tile, b, i, j, min_cos, block, rows_at_once=512):
    """Links that block b finds between tiles i and j of one cell: (links of each row,
    row it is grouped with)."""
    d = v.shape[1]
    cuts = _blocks(d, block)
    u = turned(v)
    norm = np.sqrt((v * v).sum(1))
    share = (2 - 2 * min_cos) * np.array([z - a for a, z in cuts]) / d
    count, group = np.zeros(len(ids), np.int64), np.arange(len(ids))
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    a, z = cuts[b]
    x = u[:, a:z].astype(np.float32)
    sq = (x * x).sum(1)

    def find(k):
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for own, other, later in _products(left, right, home, i == j, rows_at_once):
        near = sq[own][:, None] + sq[other][None, :] - 2 * (x[own] @ x[other].T) <= share[b] + 1e-5
        p, q = np.nonzero(near)
        if later:
            p, q = p[p < q], q[p < q]
        p, q = own[p], other[q]
        for c in [*range(b), b]:  # the first block that has the pair in range takes it
            s, t = cuts[c]
            within = ((u[p, s:t] - u[q, s:t]) ** 2).sum(1) <= share[c] + 1e-9
            keep = within if c == b else ~within
            p, q = p[keep], q[keep]
        for s in range(0, len(p), 65536):
            pp, qq = p[s : s + 65536], q[s : s + 65536]
            cos = (v[pp] * v[qq]).sum(1) / (norm[pp] * norm[qq])
            pp, qq = pp[cos >= min_cos], qq[cos >= min_cos]
            np.add.at(count, pp, times[qq])
            np.add.at(count, qq, times[pp])
            for k, m in zip(*_forest(pp, qq)):
                k, m = find(k), find(m)
                if k != m:
                    group[max(k, m)] = min(k, m)
    return count, np.array([find(k) for k in range(len(ids))])


def _forest(p: np.ndarray, q: np.ndarray):
    """Pairs that join the same rows as the given ones, one per row at most, by
    hooking each row to the smallest it is paired with until nothing changes."""
    if not len(p):
        return [], []
    nodes, back = np.unique(np.concatenate([p, q]), return_inverse=True)
    x, y = back[: len(p)], back[len(p) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return nodes.tolist(), nodes[low].tolist()


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", min_cos: float = 0.93, block: int = 8, tile: int = 4096) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    if not -1 <= min_cos <= 1:
        raise ValueError("min_cos must be from -1 to 1")
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.coalesce(good, F.lit(False)))
    classes = valid.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("times"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))  # as written, so numbered once
    members = valid.join(classes, ["label", "v"]).select("id", "rep", "least", "times")

    cells = _cells(classes, 2 - 2 * min_cos, block)
    dealt = cells.join(classes.select("rep", "label", F.size("v").alias("d")), "rep")
    dealt = written(dealt)
    key = ["label", "d", "block", "cell"]
    tiles = dealt.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = dealt.join(tiles, key).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*key, F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "home", "rep")
    sent = dealt.join(classes.select("rep", "times", "v"), "rep")

    def run(key, table):
        b, i, j = (key[k].as_py() for k in (2, 4, 5))
        table = table.sort_by("rep")
        ids = table.column("rep").to_numpy()
        count, group = _links_of(ids, _stack(table.column("v")), table.column("times").to_numpy(), table.column("home").to_numpy(), table.column("tile").to_numpy(), b, i, j, min_cos, block)
        some = np.flatnonzero(count)
        return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[group[some]], pa.int64()), "n": pa.array(count[some], pa.int64())})

    found = written(sent.groupBy(*key, "i", "j").applyInArrow(run, "a long, b long, n long"))
    linked = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    several = members.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("z")).where("b != z")  # ids that stand for several classes join them
    edges = found.select("a", "b").unionByName(members.join(several, "id").select(F.col("rep").alias("a"), "b"))
    groups = written(components(edges).withColumnRenamed("node", "rep").join(classes.select("rep", "least"), "rep"))
    named = groups.join(groups.groupBy("component").agg(F.min("least").alias("c")), "component").select("rep", "c")
    own = members.join(linked, "rep", "left").join(named, "rep", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("c", "least").alias("c"))
    own = own.groupBy("id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    out = rows.select("id").join(own, "id", "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
