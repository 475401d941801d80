"""Exact Jaccard join of documents on word n-grams, in regions around pivots.

A document is the set of its distinct n-word shingles (64-bit hashes).  Two link
when 100 * |A & B| >= percent * |A | B|.  Jaccard distance is a metric; limit is
the largest distance of linked documents.

1. Tasks cut texts into shingles and send them to buckets of the hash space, packed
   by chunk of documents; what a chunk holds several times goes as one entry with its
   count, so a bucket's work on a shingle is an entry a chunk.  A bucket counts in how
   many documents each shingle lies and answers for those that lie in more than one.
2. A document of n shingles that links with another shares at least one of its
   first n - ceil(n * percent / 100) + 1 shingles, rarest first.  If so many are
   unique, it links with nothing.  Equal sets collapse into classes.
3. First regions: documents without a shingle in common are at distance 1, so that
   around pivots drawn from all documents nearly every window holds nearly everything
   (README has figures).  First pivots are drawn where documents meet instead: of all
   that have one of those first shingles, the most shared document is the pivot, and
   linked documents meet in the region of a pivot at least.
4. A region of more than `region` documents is split into Voronoi regions: up to 16
   pivots are drawn, each document is at home with its nearest pivot, and is a guest of
   every pivot at no more than that distance + 2 * limit (by the triangle inequality, a
   document linked with one that is at home there is no further).  Documents linked with
   a pivot are labelled as connected, and what is connected isn't compared again.
   Regions are split again until they are small, `rounds` times at most.
5. Small regions are joined in one task each, by the same recursion, down to direct
   comparison of those at home with all, where the distances to a pivot don't exclude it.
   A region that splitting doesn't shrink (all distances alike) is joined in blocks.
6. Links found span the components; components() numbers them.

Nothing is capped: groups of any size are resolved exactly.  Equality of shingles is
equality of hashes: 64 bits, and while there are fewer than 2**16 buckets of them the
first 48 + log2(buckets), 53 at least.

Null or empty texts, or texts without words: no shingles, linked with nothing.
Texts shorter than n words: one shingle, the whole sequence.  Rows with a null id
are kept with a null component.  Extra columns are ignored; ids must be integers,
and rows that repeat an id count as documents of that id: each comes out, and all are
in one component.  An empty table gives no rows.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import components, tidy, written

CHUNK_BYTES = 3 << 20
BUCKET_SHINGLES, MOST_SHINGLES = 1 << 20, 1 << 23  # a bucket holds, with few and with many buckets
CHUNK_DOCS = 1 << 16
PIVOTS = 16  # of a split
BROADCAST_IDS = 2_000_000  # 16 MB of ids; more are joined by a shuffle


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, end to end; offsets."""
    starts, ends, first = tx.spans(~tx.WHITE[data], offsets)
    words = tx.span_hashes(tx.LOWER[data], starts, ends)
    grams, at = tx.gram_hashes(words, first, n)
    begin = np.searchsorted(at, first)
    out = []
    for d in range(len(offsets) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= n:
            out.append(np.unique(grams[begin[d] : begin[d + 1]]))
        elif b > a:  # the whole sequence
            total = (words[a:b] * tx.GRAM_KEYS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(tx.mix(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _low_bits(bits: int) -> int:
    """Bits of a hash that a bucket tells shingles by."""
    return min(48, 64 - bits)


def _deal(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows (bucket, chunk, kind, data): packed shingles of a chunk for a bucket
    (kind 0), a chunk's ids, sizes and set fingerprints (kind 1), or its shingles
    that lie in several of its documents, with those (kind 2)."""
    low_bits, drop = np.uint64(_low_bits(bits)), np.uint64(max(0, 16 - bits))
    most = CHUNK_BYTES << max(0, bits - 16)  # more buckets, larger chunks: rows don't get shorter

    def flush(chunk, held):
        hashes, doc, *meta = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], doc[order]
        edge = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        times = np.diff(np.append(edge, len(hashes)))
        alone = edge[times == 1]
        lone, lone_doc = hashes[alone], doc[alone]
        many, times_many = hashes[edge[times > 1]], times[times > 1].astype(np.uint32)
        together = np.repeat(times > 1, times)
        rows, buckets, kinds = [], [], []
        pack = lambda h: ((h >> drop) & ((np.uint64(1) << low_bits) - np.uint64(1))).view(np.uint8).reshape(-1, 8)[:, :6]
        low, low_many = pack(lone), pack(many)
        where = [(h >> np.uint64(64 - bits)).astype(np.int64) for h in (lone, many)]
        used = np.unique(np.concatenate(where))
        cuts = [(np.searchsorted(w, used), np.searchsorted(w, used, "right")) for w in where]
        for k, bucket in enumerate(used.tolist()):
            (a, b), (c, d) = ((x[k], y[k]) for x, y in cuts)
            rows.append(np.uint32(b - a).tobytes() + low[a:b].tobytes() + lone_doc[a:b].tobytes() + low_many[c:d].tobytes() + np.arange(c, d, dtype=np.uint32).tobytes() + times_many[c:d].tobytes())
            buckets.append(bucket), kinds.append(0)
        rows.append(b"".join(np.concatenate([x]).astype(np.int64, copy=False).tobytes() for x in (m.view(np.int64) for m in meta)))
        rows.append(np.uint32(len(many)).tobytes() + (many >> drop).tobytes() + times_many.tobytes() + doc[together].tobytes())
        buckets += [chunk & ((1 << bits) - 1)] * 2
        kinds += [1, 2]
        for a in range(0, len(rows), 4096):
            part = slice(a, a + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(buckets[part], pa.int32()), pa.array([chunk] * len(rows[part]), pa.int64()), pa.array(kinds[part], pa.int32()), pa.array(rows[part], pa.binary())], ["bucket", "chunk", "kind", "data"])

    def run(batches):
        part_id, nth, held, size, n_docs = TaskContext.get().partitionId(), 0, [], 0, 0
        key = lambda: int(tx.mix(np.array([(part_id << 32) + nth], np.uint64)).view(np.int64)[0])  # noqa: E731  mix is one to one: no two chunks share a key
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in tx.text_slices(batch.column(1), CHUNK_BYTES):
                for c in range(a, b, CHUNK_DOCS):
                    d = min(b, c + CHUNK_DOCS)
                    part = offsets[c - a : d - a + 1]
                    if held and (size + part[-1] - part[0] > most or n_docs + d - c > CHUNK_DOCS):
                        yield from flush(key(), held)
                        nth, held, size, n_docs = nth + 1, [], 0, 0
                    hashes, at = shingles(data[part[0] : part[-1]], part - part[0], n)
                    doc = np.repeat(np.arange(n_docs, n_docs + d - c).astype(np.uint16), np.diff(at))
                    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (hashes, tx.mix(hashes * tx.GRAM_KEYS[9]))]
                    held.append((hashes, doc, ids[c:d], np.diff(at).astype(np.int64), *(t[at[1:]] - t[at[:-1]] for t in total)))
                    size, n_docs = size + int(part[-1] - part[0]), n_docs + d - c
        if held:
            yield from flush(key(), held)

    return docs.mapInArrow(tidy(run), "bucket int, chunk long, kind int, data binary")


def _keys(low: np.ndarray) -> np.ndarray:
    """Numbers of packed shingles, six bytes each."""
    out = np.zeros((len(low) // 6, 8), np.uint8)
    out[:, :6] = low.reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _common(dealt: DataFrame) -> DataFrame:
    """Rows (chunk, kind, data) back to chunks: shingles that lie in more than one
    document, with the class of their count, and the chunks' own rows."""

    def run(key, table):
        bucket = key[0].as_py()
        out_chunk, out_kind, out_data, packs = [], [], [], []
        for chunk, kind, blob in zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", "data"))):
            if kind:
                out_chunk.append(chunk), out_kind.append(kind), out_data.append(blob)
            else:
                raw = np.frombuffer(blob, np.uint8)
                m = int(raw[:4].view(np.uint32)[0])
                more = (len(raw) - 4 - 8 * m) // 14
                a, b = 4 + 6 * m, 4 + 8 * m
                packs.append((chunk, raw[4:a], raw[a:b], raw[b : b + 6 * more], raw[b + 6 * more : b + 10 * more], raw[b + 10 * more :]))
        if packs:
            keys = np.concatenate([_keys(x) for p in packs for x in (p[1], p[3])])
            weight = np.concatenate([x for p in packs for x in (np.ones(len(p[1]) // 6, np.int64), np.frombuffer(p[5].tobytes(), np.uint32).astype(np.int64))])
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
            count = np.empty(len(keys), np.int64)
            count[order] = np.repeat(np.add.reduceat(weight[order], edge), np.diff(np.append(edge, len(ranked)))) if len(ranked) else 0
            # classes keep the order of counts; far apart they are coarse, which no result depends on
            grade = np.where(count < 128, count, np.minimum(255, 121 + np.log2(np.maximum(count, 1)).astype(np.int64))).astype(np.uint8)
            at = 0
            for chunk, low, doc, low_many, index, _ in packs:
                m, more = len(low) // 6, len(low_many) // 6
                shared = np.flatnonzero(count[at : at + m] > 1)
                if len(shared) or more:
                    out_chunk.append(chunk), out_kind.append(0)
                    out_data.append(np.array([bucket, len(shared)], np.uint32).tobytes() + low.reshape(-1, 6)[shared].tobytes() + doc.reshape(-1, 2)[shared].tobytes() + grade[at : at + m][shared].tobytes() + index.tobytes() + grade[at + m : at + m + more].tobytes())
                at += m + more
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "kind": pa.array(out_kind, pa.int32()), "data": pa.array(out_data, pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "chunk long, kind int, data binary")


def _profiles(common: DataFrame, bits: int, percent: int) -> DataFrame:
    """(id, n, p1, p2, n_first, shared): for documents that may link, shared holds
    their shingles that lie elsewhere too, rarest first, and n_first how many of
    those a linked document can't all miss."""
    shift = np.uint64(_low_bits(bits))

    def run(table):
        kinds, blobs = table.column("kind").to_pylist(), table.column("data").to_pylist()
        (meta,) = [b for k, b in zip(kinds, blobs) if k == 1]
        (several,) = [b for k, b in zip(kinds, blobs) if k == 2]
        ids, sizes, p1, p2 = np.frombuffer(meta, np.int64).reshape(4, -1)
        m = int(np.frombuffer(several, np.uint32, 1)[0])
        many, times = np.frombuffer(several, np.uint64, m, 4), np.frombuffer(several, np.uint32, m, 4 + 8 * m).astype(np.int64)
        grade_many = np.zeros(m, np.uint8)
        full, docs, grades = [np.repeat(many, times)], [np.frombuffer(several, np.uint16, -1, 4 + 12 * m)], []
        for k, b in zip(kinds, blobs):
            if k == 0:
                bucket, c = np.frombuffer(b, np.uint32, 2).tolist()
                full.append((np.uint64(bucket) << shift) | _keys(np.frombuffer(b, np.uint8, 6 * c, 8)))
                docs.append(np.frombuffer(b, np.uint8, 2 * c, 8 + 6 * c).copy().view(np.uint16))
                grades.append(np.frombuffer(b, np.uint8, c, 8 + 8 * c))
                more = (len(b) - 8 - 9 * c) // 5
                grade_many[np.frombuffer(b, np.uint8, 4 * more, 8 + 9 * c).copy().view(np.uint32)] = np.frombuffer(b, np.uint8, more, 8 + 9 * c + 4 * more)
        full, docs, grades = np.concatenate(full), np.concatenate(docs), np.concatenate([np.repeat(grade_many, times), *grades])
        order = np.lexsort((full, grades, docs))
        full, docs = full[order], docs[order]
        at = np.searchsorted(docs, np.arange(len(ids) + 1))
        unique = sizes - np.diff(at)
        first = np.maximum(0, sizes - -(-sizes * percent // 100) + 1 - unique)
        first[sizes == 0] = 0
        lists = [full[a:b].view(np.int64) if f else full[:0].view(np.int64) for a, b, f in zip(at[:-1], at[1:], first)]
        values, ends = np.concatenate([*lists, full[:0].view(np.int64)]), np.cumsum([0, *map(len, lists)])
        shared = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        return pa.table({"id": ids, "n": sizes, "p1": p1, "p2": p2, "n_first": first, "shared": shared})

    return common.groupBy("chunk").applyInArrow(run, "id long, n long, p1 long, p2 long, n_first long, shared array<long>")


class _Sets:
    """Shingle lists of documents, and what one of them shares with others."""

    def __init__(self, n: np.ndarray, lists: list[np.ndarray]):
        self.n, tokens = n, np.concatenate([*lists, np.zeros(0, np.int64)])
        names, flat = np.unique(tokens, return_inverse=True)
        self.flat, self.mark = flat.reshape(-1), np.zeros(len(names), np.int32)
        self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in lists])])

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.at[rows + 1] - self.at[rows])])
        return np.concatenate([self.flat[self.at[r] : self.at[r + 1]] for r in rows.tolist()] or [self.flat[:0]]), begin

    def against(self, p: int, rows: np.ndarray, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the intersections and unions of p with rows (gathered)."""
        own = self.flat[self.at[p] : self.at[p + 1]]
        self.mark[own] = 1
        both, full = np.zeros(len(rows), np.int64), begin[1:] > begin[:-1]
        if full.any():
            both[full] = np.add.reduceat(self.mark[tokens], begin[:-1][full])
        self.mark[own] = 0
        return both, self.n[rows] + self.n[p] - both


def _join_region(ids: np.ndarray, n: np.ndarray, lists: list[np.ndarray], percent: int, home: np.ndarray, label: np.ndarray, leaf: int = 48, pivots: int = 8) -> list[tuple[int, int]]:
    """Links (id, id) that, with what equal labels say, span all links that have an end
    at home.  Splits around pivots and recurs until a part is small or doesn't shrink."""
    sets = _Sets(n, lists)
    group = np.unique(label, return_inverse=True)[1].reshape(-1)
    links: list[tuple[int, int]] = []
    limit = 1 - percent / 100 + 1e-9

    def link(p, rows, both, union, ask):
        for q in rows[ask & (100 * both >= percent * union) & (union > 0)].tolist():
            if group[q] != group[p]:
                links.append((int(ids[p]), int(ids[q])))
                group[group == group[q]] = group[p]

    def solve(rows, mine, depth):
        tokens, begin = sets.gather(rows)
        own, near = np.flatnonzero(mine), None
        if len(rows) > leaf and len(own) > 1 and depth < 8:
            drawn = own[:: max(1, len(own) // pivots)][:pivots]
            far = np.ones((len(drawn), len(rows)))
            for j, k in enumerate(drawn.tolist()):
                both, union = sets.against(rows[k], rows, tokens, begin)
                far[j] = 1 - both / np.maximum(union, 1)
                link(rows[k], rows, both, union, group[rows] != group[rows[k]])
            inside = far <= far.min(0) + 2 * limit  # the windows
            if inside.sum() < 0.7 * inside.size:
                nearest = far.argmin(0)
                for j in range(len(drawn)):
                    part = rows[inside[j]]
                    at_home = (mine & (nearest == j))[inside[j]]
                    if at_home.any() and (group[part] != group[part[0]]).any():
                        solve(part, at_home, depth + 1)
                return
            near = far[0]
        for k in own.tolist():
            ask = group[rows] != group[rows[k]]
            if near is not None:
                ask &= np.abs(near - near[k]) <= limit
            if ask.any():
                both, union = sets.against(rows[k], rows, tokens, begin)
                link(rows[k], rows, both, union, ask)

    solve(np.arange(len(ids)), home, 0)
    return links


def _region_links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) of regions whose rows are (*keys, rank, x, n, shared, home, label)."""

    def run(table):
        table = table.sort_by([("rank", "ascending"), ("x", "ascending")])
        ids, n, label = (table.column(c).to_numpy() for c in ("x", "n", "label"))
        lists = [s.values.to_numpy() for s in table.column("shared")]
        links = _join_region(ids, n, lists, percent, table.column("home").to_numpy(), label) if len(ids) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def _spread(salt: int, k) -> Column:
    return F.pmod(F.xxhash64(F.col("x"), F.lit(salt)), k)


def _split(cells: DataFrame, members: DataFrame, percent: int, region: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits regions (region, x, home, label) around pivots.  Returns links found, the
    Voronoi regions with their guests, and the regions that don't shrink (both as cells,
    with labels of what is now known to be connected)."""
    limit = 1 - percent / 100 + 1e-9
    sizes = cells.groupBy("region").agg(F.count("*").alias("m")).withColumns({"k": F.least(F.lit(PIVOTS), F.greatest(F.lit(2), F.ceil(F.col("m") / max(1, region // 2)))), "salts": F.ceil(F.col("m") / region)})
    sized = cells.join(sizes, "region")
    free = F.col("label") != F.col("x")  # what nothing is linked with yet comes first
    picks = sized.where("home").groupBy("region", _spread(2 * level, F.col("k")).alias("j")).agg(F.min(F.struct(free, F.xxhash64("x", F.lit(2 * level + 1)), F.col("x"))).alias("p"), F.max("salts").alias("salts"))
    picks = picks.select("region", F.col("j").cast("int").alias("j"), F.col("p.x").alias("x"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = sized.withColumn("salt", _spread(2 * level + 1, F.col("salts"))).join(members, "x").select("region", "salt", "x", "home", "label", "n", "shared")
    right = written(picks.join(members, "x").select("region", "salt", "j", "x", "n", "shared"))

    def run(key, rows, pivots):
        names = ["region", "j", "pivot", "x", "home", "label", "linked"]
        cols = [[] for _ in names]
        if rows.num_rows and pivots.num_rows:
            ids, home, label = (rows.column(c).to_numpy() for c in ("x", "home", "label"))
            pivots = pivots.sort_by("j")
            m = len(ids)
            sets = _Sets(np.concatenate([rows.column("n").to_numpy(), pivots.column("n").to_numpy()]), [s.values.to_numpy() for t in (rows, pivots) for s in t.column("shared")])
            at = np.arange(m)
            tokens, begin = sets.gather(at)
            found = [sets.against(m + j, at, tokens, begin) for j in range(pivots.num_rows)]
            far = np.stack([1 - both / np.maximum(union, 1) for both, union in found])
            close = np.stack([(100 * both >= percent * union) & (union > 0) for both, union in found])
            nearest = far.argmin(0)
            j, x = np.nonzero(far <= far.min(0) + 2 * limit)
            cols = [np.full(len(x), key[0].as_py()), pivots.column("j").to_numpy()[j], pivots.column("x").to_numpy()[j], ids[x], home[x] & (nearest[x] == j), label[x], close[j, x]]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(names, cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()))})

    schema = "region long, j int, pivot long, x long, home boolean, label long, linked boolean"
    found = written(left.groupBy("region", "salt").cogroup(right.groupBy("region", "salt")).applyInArrow(run, schema))
    close = found.where("linked")
    links = close.where("x != pivot").select(F.col("pivot").alias("a"), F.col("x").alias("b"))
    # all that are linked with a pivot are connected: they take the label of one of them
    names = close.groupBy("region", "j").agg(F.min(F.struct((F.col("label") == F.col("x")).alias("own"), "label")).alias("name"))
    named = close.where("label = x").join(names, ["region", "j"]).groupBy("region", "x").agg(F.min("name").alias("name")).select("region", "x", F.col("name.label").alias("name"))
    relabel = lambda t: t.join(named, ["region", "x"], "left").withColumn("label", F.coalesce("name", "label")).drop("name")
    gain = found.groupBy("region").agg(F.count("*").alias("rows")).join(sizes, "region").select("region", (F.col("rows") < 0.7 * F.col("m") * F.col("k")).alias("shrinks"))
    inner = relabel(found.join(gain.where("shrinks"), "region")).select(F.xxhash64("region", "j", F.lit(level)).alias("region"), "x", "home", "label")
    inner = inner.groupBy("region", "x").agg(F.bool_or("home").alias("home"), F.min("label").alias("label"))  # rows of one id are one node
    rest = relabel(cells.join(gain.where("NOT shrinks"), "region")).select("region", "x", "home", "label")
    return links, written(inner), written(rest)


def _in_blocks(cells: DataFrame, members: DataFrame, percent: int, region: int) -> DataFrame:
    """Links of regions that are left: in pairs of blocks, those at home against all, but
    for pairs that bear the region's most frequent label both."""
    half = max(1, region // 2)
    main = cells.groupBy("region", "label").agg(F.count("*").alias("m")).groupBy("region").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    cells = cells.join(main, "region").withColumn("inner", F.col("label") == F.col("main"))
    sides = []
    for kind, left, right in ((0, "home AND NOT inner", "true"), (1, "home AND inner", "NOT home AND NOT inner")):
        n = cells.groupBy("region").agg(F.ceil(F.count_if(F.expr(left)) / half).alias("ni"), F.ceil(F.count_if(F.expr(right)) / half).alias("nj")).where("ni > 0 AND nj > 0")
        own = cells.join(n, "region")
        put = lambda where, i, j, home: own.where(where).select("region", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), "x", "label", F.lit(home).alias("home"))  # noqa: B023, E731
        each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        sides += [put(left, _spread(1, F.col("ni")), each("nj"), True), put(right, each("ni"), _spread(2, F.col("nj")), False)]
    rows = reduce(DataFrame.unionByName, sides).groupBy("region", "kind", "i", "j", "x", "label").agg(F.bool_or("home").alias("home"))
    rows = rows.join(members, "x").select("region", "kind", "i", "j", (~F.col("home")).cast("int").alias("rank"), "x", "n", "shared", "home", "label")
    return _region_links(rows, ["region", "kind", "i", "j"], percent)


def _small(ids: DataFrame) -> DataFrame:
    """The ids, staged, and broadcast if they are few: then lists needn't be shuffled to
    meet them."""
    ids = written(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def jaccard_links(docs: DataFrame, id_col="doc_id", text_col="text", n: int = 5, percent: int = 75, region: int = 512, rounds: int = 4, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (profiles, links): profiles has id, n and rep (the smallest id with the
    same set; null without shingles); links (a, b) between representatives span all
    components of the link graph.  bits: log2 of the number of buckets, by default from
    the size of the texts."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where(F.col(id_col).isNotNull())
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    need = lambda held: math.ceil(math.log2(max(1, size / 6 / held)))
    bits = bits or max(5, min(16, need(BUCKET_SHINGLES)), need(MOST_SHINGLES))
    common = _common(_deal(docs, n, bits))
    profiles = written(_profiles(common, bits, percent))

    small = profiles.select("id", "n", "p1", "p2")
    reps = small.where("n > 0").groupBy("n", "p1", "p2").agg(F.min("id").alias("rep"))
    # equal documents share everything, so of each class its representative goes on
    may = profiles.where("n_first > 0")
    repeated = written(small.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"))
    again = not repeated.isEmpty()
    if again:  # rows of one id with equal sets say the same
        may = may.dropDuplicates(["id", "n", "p1", "p2"])
    rep_ids = reps.join(may.select("n", "p1", "p2").distinct(), ["n", "p1", "p2"], "left_semi").select(F.col("rep").alias("id"))
    rare = F.lit(1.0) - F.size("shared") / F.col("n")
    first = may.select("id", rare.alias("rare"), F.slice("shared", 1, F.col("n_first").cast("int")).alias("first"))
    keyed = first.join(_small(rep_ids), "id", "left_semi").select(F.col("id").alias("x"), "rare", F.explode("first").alias("shingle"))
    pivots = keyed.groupBy("shingle").agg(F.min(F.struct("rare", "x")).alias("p"), F.count("*").alias("m")).where("m > 1").select("shingle", F.col("p.x").alias("region"))
    regions = written(keyed.join(pivots, "shingle").select("region", "x").distinct())
    sizes = regions.groupBy("region").agg(F.count("*").alias("members"))
    sharing = regions.join(sizes.where("members > 1"), "region").select("x").distinct()
    members = may.select(F.col("id").alias("x"), "n", "shared").join(_small(sharing), "x", "left_semi")

    little = regions.join(sizes.where(F.col("members").between(2, region)), "region")
    rows = little.join(members, "x").select("region", (F.col("x") != F.col("region")).cast("int").alias("rank"), "x", "n", "shared", F.lit(True).alias("home"), F.col("x").alias("label"))
    links = _region_links(rows, ["region"], percent)
    if again:  # rows of one id are one node, whichever sets they are equal to
        links = links.unionByName(small.join(repeated, "id").join(reps, ["n", "p1", "p2"]).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    links = written(links)

    big = written(regions.join(sizes.where(F.col("members") > region), "region").select("region", "x"))
    if big.isEmpty():
        return small.join(reps, ["n", "p1", "p2"], "left").select("id", "n", "rep"), links
    # only what lies in large regions is split
    members = written(may.select(F.col("id").alias("x"), "n", "shared").join(big.select("x").distinct(), "x", "left_semi"))
    found, left = [links], []
    cells = big.select("region", "x", F.lit(True).alias("home"), F.col("x").alias("label"))
    for level in range(rounds):
        more, inner, rest = _split(cells, members, percent, region, level)
        found.append(more)
        left.append(rest)
        # regions where all that is left is known to be connected are done
        sizes = inner.groupBy("region").agg(F.count("*").alias("m"), F.count_if("home").alias("homes"), F.count_distinct("label").alias("labels")).where("homes > 0 AND labels > 1").select("region", "m")
        inner = inner.join(sizes, "region")
        rows = inner.where(F.col("m") <= region).join(members, "x").select("region", (~F.col("home")).cast("int").alias("rank"), "x", "n", "shared", "home", "label")
        found.append(written(_region_links(rows, ["region"], percent)))
        cells = written(inner.where(F.col("m") > region).drop("m"))
        if cells.isEmpty():
            break
    else:
        left.append(cells)
    found.append(written(_in_blocks(reduce(DataFrame.unionByName, left), members, percent, region)))
    links = reduce(DataFrame.unionByName, found)
    return small.join(reps, ["n", "p1", "p2"], "left").select("id", "n", "rep"), links


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: the component is the smallest
    id reachable by links, the document's own if it has none."""
    profiles, links = jaccard_links(docs, id_col, text_col, **how)
    groups = components(links)
    kind = docs.schema[id_col].dataType
    out = profiles.withColumn("rep", F.coalesce("rep", "id")).join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").cast(kind).alias("component_id"))
    nulls = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col(id_col).alias("component_id"))
    return out.unionByName(nulls)


def distinct_documents(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The documents with one of each component kept (that with the smallest id);
    all columns stay."""
    found = jaccard_components(docs, id_col, text_col, **how).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
