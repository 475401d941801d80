"""Statistics of targets over their candidates, in passes over the market.

A pass reads the market in Arrow batches, a task after the other its own rows, and
meets them with targets that came with the task: at most as many as a block holds
(knn.BROADCAST_TARGETS), a row each.  Pairs exist only as arrays of one target and one
chunk of rows.  What leaves a task are sums by target and bucket, or single values of
the buckets that hold a wanted rank; Spark adds them up, and what comes back to the
driver are some numbers a target.
"""
from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EARTH_KM, FIRST_YEAR
from ..sources.stage import collected, staged
from .robust import picked_values, wanted_buckets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

AREAS = ("built_area", "private_area", "lot_area", "frontage")
FEATURES = (*AREAS, "year")
CHUNK = 1 << 16  # rows of the market at once
DENSE = 1 << 16  # span of buckets that are counted in an array
SENT = 1 << 18  # rows of results that leave a task at once
STRIPS = 64  # of latitude, by which a chunk's rows are found by distance
KM_DEGREE = EARTH_KM * np.pi / 180


class Values(dict):
    """A table's columns as arrays, each made when it is first used."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __missing__(self, c: str) -> np.ndarray:
        self[c] = self.table.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy()
        return self[c]


class Rows:
    """A chunk's candidates of one purpose."""

    def __init__(self, table: pa.Table, last_year: int):
        self.table, self.n, self.last_year = table, table.num_rows, last_year
        self.x = Values(table)
        self.kept: dict = {}

    @cached_property
    def year_ok(self) -> np.ndarray:
        year, near = self.x["year"], np.rint(self.x["year"])
        with np.errstate(invalid="ignore"):
            return (np.abs(year - near) <= 1e-9 + 1e-5 * np.abs(near)) & (near >= FIRST_YEAR) & (near <= self.last_year)

    @cached_property
    def place_ok(self) -> np.ndarray:
        return (np.abs(self.x["lat"]) <= 90) & (np.abs(self.x["lon"]) <= 180)

    @cached_property
    def log_unit(self) -> np.ndarray:
        return np.log(np.where(self.x["unit"] > 0, self.x["unit"], 1.0))

    @cached_property
    def strips(self) -> tuple[np.ndarray, np.ndarray, float, float, float, float]:
        """(rows, keys, ...): the rows with a place by strip of latitude, then longitude;
        keys are strip * width + longitude - least, in order."""
        at = np.flatnonzero(self.place_ok)
        lat, lon = self.x["lat"][at], self.x["lon"][at]
        if not len(at):
            return at, lat, 0.0, 1.0, 0.0, 1.0
        low, least = lat.min(), lon.min()
        step, width = max((lat.max() - low) / STRIPS, 1e-9), (lon.max() - least) + 1.0
        keys = np.minimum(np.floor((lat - low) / step), STRIPS - 1) * width + (lon - least)
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order], low, step, least, width

    def around(self, t: dict, inner: float, outer: float) -> np.ndarray:
        """Rows that hold all those between two distances (km) of a target, and few others."""
        rows, keys, low, step, least, width = self.strips
        slack = 1e-6
        a = (low + np.arange(STRIPS) * step - t["lat"]) * KM_DEGREE
        b = a + step * KM_DEGREE
        near, far = np.maximum(np.maximum(a, -b), 0.0) - slack, np.maximum(np.abs(a), np.abs(b)) + slack
        hold = np.flatnonzero(near <= outer + slack)
        near, far = np.maximum(near[hold], 0.0), far[hold]
        scale = max(KM_DEGREE * np.cos(np.radians(t["lat"])), 1e-12)
        reach = np.sqrt(np.maximum((outer + slack) ** 2 - near**2, 0.0)) / scale + slack
        gap = np.maximum(np.sqrt(np.maximum(max(inner - slack, 0.0) ** 2 - far**2, 0.0)) / scale - slack, 0.0)
        at = lambda lon, side: np.searchsorted(keys, hold * width + np.clip(lon - least, -0.25, width - 0.25), side)
        spans = [(at(t["lon"] - reach, "left"), at(t["lon"] - gap, "right")), (at(t["lon"] + gap, "left"), at(t["lon"] + reach, "right"))]
        spans[1] = np.maximum(spans[1][0], spans[0][1]), spans[1][1]  # the halves of a strip without a gap meet in the middle
        parts = [rows[i:j] for lows, highs in spans for i, j in zip(lows.tolist(), highs.tolist()) if i < j]
        return np.concatenate(parts) if parts else rows[:0]

    def bucket(self, name: str) -> np.ndarray:
        """The buckets of a column, which all targets share."""
        if name not in self.kept:
            self.kept[name] = bucket_of(self.log_unit if name == "log" else self.x[name])
        return self.kept[name]

    def signature(self, t: dict) -> tuple[tuple, np.ndarray]:
        """What a target asks of its candidates, and which rows have it: the same for all
        targets that use the same features."""
        key = ("rows", *(t[f] is not None for f in FEATURES), bool(t["use_place"]))
        if key not in self.kept:
            ok = self.x["unit"] > 0
            for f in AREAS:
                if t[f] is not None:
                    ok &= self.x[f] > 0
            if t["year"] is not None:
                ok &= self.year_ok
            self.kept[key] = ok & self.place_ok if t["use_place"] else ok
        return key, self.kept[key]

    def left_out(self, t: dict) -> np.ndarray | None:
        """The rows that a target leaves out: its own, its group's, those below its bound."""
        out = None
        for c, key in (("id", "exclude_id"), ("group", "exclude_group")):
            if t[key] is not None and not (c == "group" and t[key] == ""):
                kind = (c, t[key])
                if c == "id" or kind not in self.kept:
                    self.kept["last" if c == "id" else kind] = pc.fill_null(pc.equal(self.table.column(c), pa.scalar(t[key], self.table.schema.field(c).type)), False).to_numpy(zero_copy_only=False)
                own = self.kept["last" if c == "id" else kind]
                out = own if out is None else out | own
        if t.get("bound") is not None:
            low = self.x["unit"] < t["bound"]
            out = low if out is None else out | low
        return out

    def valid(self, t: dict, among: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the rows (`among` some) that are candidates of a target."""
        key, ok = self.signature(t)
        out = self.left_out(t)
        if among is not None:
            return among[ok[among] if out is None else ok[among] & ~out[among]]
        if (*key, "at") not in self.kept:
            self.kept[*key, "at"] = np.flatnonzero(ok)
        at = self.kept[*key, "at"]
        return at if out is None else at[~out[at]]

    def like(self, t: dict, mode: str, among: np.ndarray | None = None) -> np.ndarray:
        """A target's candidates (`among` some rows) within the range of a mode."""
        if among is None and t["use_place"]:
            among = self.around(t, 0.0, RANGES[mode][2])
        at = self.valid(t, among)
        return at[self.within(t, at, *RANGES[mode])]

    def counts(self, t: dict, f: str, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, rows) of a target's candidates by a feature: those of its signature,
        counted once, less those of the rows that it leaves out."""
        key, ok = self.signature(t)
        if (*key, f) not in self.kept:
            b = self.bucket(f)[ok]
            low = b.min() if len(b) else 0
            self.kept[*key, f] = (low, np.bincount(b - low)) if len(b) and b.max() - low < DENSE else (low, None)
        low, n = self.kept[*key, f]
        if n is None:
            kinds, n, _ = summed(self.bucket(f)[ok if out is None else ok & ~out])
            return kinds, n
        if out is not None:
            gone = self.bucket(f)[ok & out]
            n = n - np.bincount(gone - low, minlength=len(n))
        some = np.flatnonzero(n)
        return some + low, n[some]

    def in_bucket(self, name: str, k: int) -> np.ndarray:
        """The rows of a bucket of a column."""
        if ("order", name) not in self.kept:
            order = np.argsort(self.bucket(name), kind="stable")
            self.kept["order", name] = order, self.bucket(name)[order]
        order, b = self.kept["order", name]
        return order[np.searchsorted(b, k) : np.searchsorted(b, k, "right")]

    def singles(self, t: dict, f: str, out: np.ndarray | None, k: int) -> np.ndarray:
        """The values of a target's candidates in one bucket, found by the buckets' order."""
        at = self.in_bucket(f, k)
        _, ok = self.signature(t)
        return self.x[f][at[ok[at] if out is None else ok[at] & ~out[at]]]

    def km(self, t: dict, at: np.ndarray) -> np.ndarray:
        x = EARTH_KM * np.cos(np.radians(t["lat"])) * np.radians(self.x["lon"][at] - t["lon"])
        return np.hypot(x, EARTH_KM * np.radians(self.x["lat"][at] - t["lat"]))

    def dist(self, t: dict, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at))
        for f in FEATURES:
            if t[f] is not None:
                total += ((self.x[f][at] - t[f]) / t[f"{f}_scale"]) ** 2
        total *= t["physical"] / t["n_features"]
        if t["use_place"]:
            total += (1 - t["physical"]) * (self.km(t, at) / t["place_scale"]) ** 2
        return np.sqrt(total)

    def within(self, t: dict, at: np.ndarray, low: float, high: float, km: float) -> np.ndarray:
        """Which rows are like the target in every area, and near it."""
        ok = np.ones(len(at), bool)
        for f in AREAS:
            if t[f] is not None:
                ratio = self.x[f][at] / t[f]
                ok &= (ratio >= low) & (ratio <= high)
        return ok & (self.km(t, at) <= km) if t["use_place"] else ok

    def reference(self, t: dict, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, distances, weights) of a target's reference set, or of `among` those in it."""
        if t["mode"] in RANGES:
            at = self.like(t, t["mode"], among)
            d = self.dist(t, at)
        else:  # the nearest, up to the last of them
            at = self.valid(t, among)
            d = self.dist(t, at)
            far, last = t["reach"]
            keep = (d < far) | self.upto(at, d == far, last)
            at, d = at[keep], d[keep]
        if t["alike"]:
            return at, d, np.full(len(at), 1 / t["n_ref"])
        raw = (d + 0.25) ** -t["local"]["proximity_power"]
        least, last = t["last"] or (np.inf, None)
        capped = (raw > least) | self.upto(at, raw == least, last)
        return at, d, np.where(capped, t["cap"], raw * t["share"])

    def upto(self, at: np.ndarray, among: np.ndarray, last) -> np.ndarray:
        """Which of the rows `among` have an id up to `last`."""
        out = np.zeros(len(at), bool)
        if among.any():
            ids = self.table.column("id").take(pa.array(at[among]))
            out[among] = pc.less_equal(ids, pa.scalar(last, ids.type)).to_numpy(zero_copy_only=False)
        return out


def capped(raw: np.ndarray, cap: float) -> np.ndarray:
    """Weights of a few rows as robust.capped_weights() has them."""
    raw = np.where(raw > 0, raw, 0.0)
    raw = raw if raw.sum() > 0 else np.ones(len(raw))
    order = np.argsort(-raw, kind="stable")
    x, n, cap = raw[order], len(raw), min(1.0, max(cap, 1 / len(raw)))
    tail, m = np.cumsum(x[::-1])[::-1], np.arange(n)
    fits = np.flatnonzero((tail > 0) & ((1 - m * cap) * x <= (cap + 1e-15) * tail))
    at = int(fits[0]) if len(fits) else n
    share = np.where(m < at, cap, (1 - at * cap) * x / (tail[at] if at < n else 1.0))
    out = np.empty(n)
    out[order] = np.clip(share, 0.0, cap)
    return out / out.sum()


RANGES = {"strict": (0.5, 2.0, 5.0), "relaxed": (1 / 3, 3.0, 10.0)}


def bucket_of(v: np.ndarray) -> np.ndarray:
    """Buckets some 0.3 % wide, in the order of the values, from the bits of their
    magnitude; what is below a millionth, and nulls (NaN), are in bucket 0."""
    size = (np.maximum(np.abs(np.nan_to_num(v)), 1e-6).view(np.int64) >> BITS) - LEAST
    return np.where(v < 0, -size, size) if (v < 0).any() else size


BITS = 44  # of a double's 64, that a bucket leaves out
LEAST = int(np.float64(1e-6).view(np.int64) >> BITS)


def bucket_ends(b: int) -> tuple[float, float]:
    """What a bucket of positive values reaches from and to."""
    low, high = (np.array([b + LEAST + k]) << BITS for k in (0, 1))
    return 0.0 if b <= 0 else float(low.view(np.float64)[0]), float(high.view(np.float64)[0])


def summed(b: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, rows, weights), one entry a bucket."""
    if not len(b):
        return b, b, np.zeros(0)
    low, span = b.min(), b.max() - b.min()
    if span < DENSE:
        n = np.bincount(b - low)
        some = np.flatnonzero(n)
        return some + low, n[some], np.bincount(b - low, w)[some] if w is not None else n[some].astype(np.float64)
    kinds, back, n = np.unique(b, return_inverse=True, return_counts=True)
    return kinds, n, np.bincount(back, w) if w is not None else n.astype(np.float64)


def met(market: DataFrame, targets: list[dict], last_year: int, each: Callable, names: str, ids: bool = False) -> DataFrame:
    """What `each` (target, rows) yields as tuples of columns, for every chunk of rows of
    a purpose and every target of it: (t, *names), t being the target's number.  Only the
    columns that the targets use are read (ids: that `each` needs them)."""
    used = {f: any(t[f] is not None for t in targets) for f in FEATURES}
    used |= dict.fromkeys(("lat", "lon"), any(t["use_place"] for t in targets))
    used["id"] = ids or any(t["exclude_id"] is not None or (t.get("mode", "strict") not in RANGES or t.get("last") is not None) for t in targets)
    used["group"] = any(t["exclude_group"] not in (None, "") for t in targets)
    market = market.select("purpose", "unit", *(c for c, x in used.items() if x))
    by: dict = {}
    for t in targets:
        by.setdefault(t["purpose"], []).append(t)
    fields = [f.split(" ") for f in names.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from chunk(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from chunk(pa.Table.from_batches(held))

    def chunk(table):
        out, n = [], 0
        for purpose in pc.unique(table.column("purpose")).to_pylist():
            own = by.get(purpose)
            if not own:
                continue
            rows = Rows(table.filter(pc.equal(table.column("purpose"), purpose)).combine_chunks(), last_year)
            for t in own:
                for cols in each(t, rows):
                    size = next((len(c) for c in cols if isinstance(c, (np.ndarray, pa.Array, pa.ChunkedArray))), 1)
                    out.append([np.full(size, t["t"]), *(c if isinstance(c, (np.ndarray, pa.Array, pa.ChunkedArray)) else [c] * size for c in cols)])
                    n += size
                    if len(out) >= 4096 or n >= SENT:
                        yield packed(out)
                        out, n = [], 0
        if out:
            yield packed(out)

    def packed(out):
        def column(k, kind):
            parts = [o[k] for o in out]
            if all(isinstance(p, np.ndarray) for p in parts):
                return pa.array(np.concatenate(parts), kind)
            return pa.concat_arrays([pa.array(p, kind) if not isinstance(p, (pa.Array, pa.ChunkedArray)) else (p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p).cast(kind) for p in parts])

        return pa.RecordBatch.from_arrays([column(0, pa.int64()), *(column(k + 1, kinds[f[1]]) for k, f in enumerate(fields))], ["t", *(f[0] for f in fields)])

    return market.mapInArrow(run, f"t long, {names}")


def levels(market: DataFrame, targets: list[dict], last_year: int, values: Callable, at: list[float], weighted: bool = False) -> dict:
    """quantiles() of what values(target, rows) yields as (name, values, buckets,
    weights)."""
    def sums(t, rows):
        for name, _, b, w in values(t, rows):
            yield name, *summed(b, w)

    def singles(t, rows, wanted):
        for name, v, b, w in values(t, rows):
            for k in wanted.get(name, ()):
                some = np.flatnonzero(b == k)
                yield name, k, v[some], w if w is None else w[some]

    return quantiles(market, targets, last_year, sums, singles, at, weighted)


def quantiles(market: DataFrame, targets: list[dict], last_year: int, sums: Callable, singles: Callable, at: list[float], weighted: bool = False) -> dict:
    """{(target's number, name): (n, quantiles)}: a pass that sums by bucket, (name,
    buckets, rows, weights) from sums(target, rows); and one for the rows of the buckets
    that hold a wanted rank, (name, bucket, values, weights) from singles(target, rows,
    {name: buckets})."""
    keys = ["t", "name"]
    some_sums = lambda t, rows: (x for x in sums(t, rows) if len(x[1]))
    h = met(market, targets, last_year, some_sums, "name string, b long, n long, w double").groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.sum("w" if weighted else "n").alias("m"))
    hits = staged(wanted_buckets(h, keys, at, weighted))
    wanted: dict = {}
    for r in collected(hits.select(*keys, "b")):  # a few rows a target and name
        wanted.setdefault(r.t, {}).setdefault(r.name, []).append(r.b)

    def single(t, rows):
        if t["t"] in wanted:
            for name, k, v, w in singles(t, rows, wanted[t["t"]]):
                if len(v):
                    kinds, back, n = np.unique(v, return_inverse=True, return_counts=True)
                    yield name, k, kinds, n, np.bincount(back, w) if w is not None else n.astype(np.float64)

    alone = met(market, targets, last_year, single, "name string, b long, v double, n long, w double").groupBy(*keys, "b", "v").agg(F.sum("w" if weighted else "n").alias("m"))
    return {(r.t, r.name): (r.n, r.q) for r in collected(picked_values(alone, hits, keys, weighted))}


def scale_targets(market: DataFrame, targets: list[dict], last_year: int) -> None:
    """Gives the targets n_candidates, place_scale and a scale of each feature: the
    quartile range of their candidates, or 1.4826 * MAD, or the population deviation, or
    max(|median|, 1), each where those before are near zero.

    Features of the rows that targets of one kind share are counted once a chunk; what a
    target leaves out, itself, its group or what is below its bound, is taken off those
    counts, which shifts the ranks.  Only distances are counted for each target."""
    def sums(t, rows):
        out = rows.left_out(t)
        for f in FEATURES:
            if t[f] is not None:
                kinds, n = rows.counts(t, f, out)
                yield f, kinds, n, n.astype(np.float64)
        at = rows.valid(t)
        yield "all", np.zeros(1, np.int64), np.array([len(at)]), np.array([float(len(at))])
        if t["use_place"]:
            km = rows.km(t, at)
            yield "geo", *summed(bucket_of(km[km > 0]))

    def singles(t, rows, wanted):
        out = rows.left_out(t)
        for f in FEATURES:
            for k in wanted.get(f, ()):
                yield f, k, rows.singles(t, f, out, k), None
        for k in wanted.get("geo", ()):
            km = rows.km(t, rows.valid(t, rows.around(t, *bucket_ends(k))))
            km = km[km > 0]
            yield "geo", k, km[bucket_of(km) == k], None
        for k in wanted.get("all", ()):
            yield "all", k, np.zeros(len(rows.valid(t))), None

    found = quantiles(market, targets, last_year, sums, singles, [0.25, 0.5, 0.75])
    flat = {k: q for k, (_, q) in found.items() if k[1] in FEATURES and q[2] - q[0] <= 1e-12}

    def off(t, rows):
        at = rows.valid(t)
        for f in FEATURES:
            if (t["t"], f) in flat:
                v = np.abs(rows.x[f][at] - flat[t["t"], f][1])
                yield f, v, bucket_of(v), None

    def moments(t, rows):
        at = rows.valid(t)
        for f in FEATURES:
            if (t["t"], f) in flat:
                v = rows.x[f][at] - flat[t["t"], f][1]
                yield f, len(v), float(v.sum()), float((v * v).sum())

    some = [t for t in targets if any((t["t"], f) in flat for f in FEATURES)]
    mads = {k: q[0] for k, (_, q) in levels(market, some, last_year, off, [0.5]).items()} if some else {}
    sums = met(market, some, last_year, moments, "name string, n long, s double, ss double").groupBy("t", "name").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")) if some else None
    spread = {(r.t, r.name): max(0.0, r.ss / r.n - (r.s / r.n) ** 2) ** 0.5 for r in (collected(sums) if some else ())}
    for t in targets:
        t["n_candidates"] = found.get((t["t"], "all"), (0, None))[0]
        km = found.get((t["t"], "geo"), (0, [0, 0, 0]))[1][1]
        t["place_scale"] = min(20.0, max(0.25, km)) if km > 0 else 1.0
        for f in FEATURES:
            q = found.get((t["t"], f), (0, None))[1]
            options = () if q is None else (q[2] - q[0], 1.4826 * mads.get((t["t"], f), 0), spread.get((t["t"], f), 0))
            t[f"{f}_scale"] = next((o for o in options if o > 1e-12), max(abs(q[1]) if q else 0.0, 1.0))


def weigh_targets(market: DataFrame, targets: list[dict], last_year: int, cap: float = 0.25) -> list[dict]:
    """The targets that have a reference set (of candidates enough, 8 in the set), with its mode, size and what its capped weights follow from: no more
    than 1 / cap rows can be at the cap, so sums and the few largest raw weights tell
    all.  The nearest mode takes the target's first candidates in order of distance."""
    most = int(1 / cap) + 1
    out = []
    for t in targets:
        n = t["n_candidates"]
        if n >= max(t["min_k"] + 1, 8):
            out.append(t | {"n": n, "size": min(n, max(8, min(t["local"]["max_reference"], max(t["max_k"] * 2, 20))))})

    def each(t, rows):
        """By mode a chunk's sums, with the first of its rows, and those rows.  Where a
        chunk has 8 rows in the range of a mode, no later mode can be the target's."""
        for mode in (*RANGES, "nearest"):
            at = rows.like(t, mode) if mode in RANGES else rows.valid(t)
            d, want = rows.dist(t, at), most if mode in RANGES else t["size"]
            n, s = len(d), float(((d + 0.25) ** -t["local"]["proximity_power"]).sum()) if mode in RANGES else 0.0
            if n > want:
                keep = d <= np.partition(d, want - 1)[want - 1]
                at, d = at[keep], d[keep]
            if n:
                first = np.arange(len(d)) == 0
                yield mode, np.where(first, n, 0), np.where(first, s, 0.0), d, rows.table.column("id").take(pa.array(at))
            if n >= 8:
                break

    kind = market.schema["id"].dataType.simpleString().replace("bigint", "long")
    by = Window.partitionBy("t", "mode")
    near = met(market, out, last_year, each, f"mode string, n long, s double, d double, id {kind}", ids=True)
    near = near.withColumns({"k": F.row_number().over(by.orderBy("d", "id")), "n": F.sum("n").over(by), "s": F.sum("s").over(by)})
    near = near.where(F.col("k") <= F.when(F.col("mode") == "nearest", max((t["size"] for t in out), default=1)).otherwise(most))
    lists: dict = {}
    total: dict = {}
    for r in collected(near.orderBy("t", "k")) if out else ():  # some rows a target
        lists.setdefault((r.t, r.mode), []).append((r.d, r.id))
        total[r.t, r.mode] = r.n, r.s
    for t in out:
        t["mode"] = next((m for m in RANGES if total.get((t["t"], m), (0, 0))[0] >= 8), "nearest")
        t["n_ref"] = total[t["t"], t["mode"]][0] if t["mode"] in RANGES else t["size"]
        own = lists[t["t"], t["mode"]][: most if t["mode"] in RANGES else t["size"]]
        raws = [(d + 0.25) ** -t["local"]["proximity_power"] for d, _ in own]
        whole = total[t["t"], t["mode"]][1] if t["mode"] in RANGES else sum(raws)
        t["reach"], raws, own = own[-1], raws[:most], own[:most]
        t["cap"] = min(1.0, max(cap, 1 / t["n_ref"]))
        rest = [whole - sum(raws[:m]) for m in range(len(raws) + 1)]
        m = next((m for m in range(len(raws)) if rest[m] > 0 and (1 - m * t["cap"]) * raws[m] <= (t["cap"] + 1e-15) * rest[m]), len(raws))
        t["alike"] = whole <= 0 or m >= t["n_ref"]
        t["share"] = (1 - m * t["cap"]) / rest[m] if rest[m] > 0 else 0.0
        t["last"] = (raws[m - 1], own[m - 1][1]) if m else None
    return out


def reference_levels(market: DataFrame, targets: list[dict], last_year: int) -> None:
    """Gives the targets the weighted quartiles (q1, med, q3) of the logarithms of their
    reference sets' unit values, and the weighted median deviation (dev)."""
    def logs(t, rows):
        at, _, w = rows.reference(t)
        yield "x", *summed(rows.bucket("log")[at], w)

    def log_singles(t, rows, wanted):
        for k in wanted["x"]:
            at, _, w = rows.reference(t, rows.in_bucket("log", k))
            yield "x", k, rows.log_unit[at], w

    def off(t, rows):
        at, _, w = rows.reference(t)
        yield "x", *summed(bucket_of(np.abs(rows.log_unit[at] - t["med"])), w)

    def off_singles(t, rows, wanted):
        b = bucket_of(np.abs(rows.log_unit - t["med"]))
        for k in wanted["x"]:
            at, _, w = rows.reference(t, np.flatnonzero(b == k))
            yield "x", k, np.abs(rows.log_unit[at] - t["med"]), w

    found = quantiles(market, targets, last_year, logs, log_singles, [0.25, 0.5, 0.75], weighted=True)
    for t in targets:
        t["q1"], t["med"], t["q3"] = found[t["t"], "x"][1]
    found = quantiles(market, targets, last_year, off, off_singles, [0.5], weighted=True)
    for t in targets:
        t["dev"] = found[t["t"], "x"][1][0]


def gap_rows(market: DataFrame, targets: list[dict], last_year: int) -> DataFrame:
    """(t, b, low, high, n, w): a target's reference set by buckets of the logarithm half
    as wide as the least gap."""
    def sums(t, rows):
        at, _, w = rows.reference(t)
        u = rows.x["unit"][at]
        b = np.floor(np.log(u) / (np.log(t["local"]["gap_ratio"]) / 2)).astype(np.int64)
        kinds, back, n = np.unique(b, return_inverse=True, return_counts=True)
        low, high = np.full(len(kinds), np.inf), np.full(len(kinds), -np.inf)
        np.minimum.at(low, back, u)
        np.maximum.at(high, back, u)
        if len(kinds):
            yield kinds, low, high, n, np.bincount(back, w)

    out = met(market, targets, last_year, sums, "b long, low double, high double, n long, w double")
    return out.groupBy("t", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("w").alias("w"))


def side_distances(market: DataFrame, targets: list[dict], last_year: int, cuts: dict) -> dict:
    """{(target's number, value): (median distance up to the value, beyond)}."""
    def values(t, rows):
        at, d, _ = rows.reference(t)
        b, u = bucket_of(d), rows.x["unit"][at]
        for v in cuts[t["t"]]:
            for side, some in (("low", u <= v), ("high", u > v)):
                yield f"{side} {v!r}", d[some], b[some], None

    found = levels(market, [t for t in targets if t["t"] in cuts], last_year, values, [0.5])
    return {(n, v): tuple(found[n, f"{side} {v!r}"][1][0] for side in ("low", "high")) for n, own in cuts.items() for v in own}


def below(market: DataFrame, targets: list[dict], last_year: int, bounds: dict[int, tuple]) -> dict:
    """{target's number: how many of its candidates lie below each of its bounds}."""
    def counts(t, rows):
        u = rows.x["unit"][rows.valid(t)]
        for k, x in enumerate(bounds[t["t"]]):
            yield k, int((u < x).sum()) if x is not None else 0

    found = met(market, targets, last_year, counts, "k int, n long").groupBy("t", "k").agg(F.sum("n").alias("n"))
    out: dict = {}
    for r in collected(found):
        out.setdefault(r.t, {})[r.k] = r.n
    return out
