"""A street axis in shape files, read by ranges of records.

The driver reads headers only.  A task takes a range of records: their places from the
index (.shx), neighbouring shapes (.shp) in one read of up to BLOCK bytes, and their
attributes (.dbf), which lie at places that the record length gives.
"""
from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.geocode import street_index
from .files import open_file

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = (".shp", ".shx", ".dbf", ".prj")
HEADER = 100  # bytes, of .shp and .shx alike
LINES = (3, 13, 23)  # shape types: lines, with heights, with measures
BLOCK = 4 << 20  # bytes of neighbouring shapes that one read may take
SPLIT = 32 << 20  # bytes of shapes that a task gets, by the average shape
GEOMETRY = "points array<struct<x: double, y: double>>, parts array<int>"

# Attributes of the axis.
FIELDS = {"cdlog": "CDLOG", "name": "NMIDELOG", "short_name": "NMIDEABR", "even_from": "NRPARINI", "even_to": "NRPARFIN", "odd_from": "NRIMPINI", "odd_to": "NRIMPFIN"}


def _open(base: str, part: str):
    return open_file(base + part)


def _at(file, offset: int, length: int) -> bytes:
    data = file.read_at(length, offset)
    if len(data) < length:
        raise ValueError(f"{length} bytes at {offset} wanted, the file ends before")
    return data


def _attributes(base: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, header length, record length and (name, type, start, length) of fields;
    the type is long, double, boolean or string."""
    with _open(base, ".dbf") as f:
        n, head, size = struct.unpack("<IHH", _at(f, 4, 8))
        data, at, fields = _at(f, 32, head - 32), 1, []
    for k in range(0, len(data) - 31, 32):
        if data[k] == 0x0D:
            break
        kind, length, decimals = chr(data[k + 11]), data[k + 16], data[k + 17]
        number = "double" if decimals or kind == "F" or length > 18 else "long"
        fields.append((data[k : k + 11].split(b"\0")[0].decode("latin1"), number if kind in "NF" else "boolean" if kind == "L" else "string", at, length))
        at += length
    return n, head, size, fields


def _value(raw: bytes, kind: str):
    text = raw.decode("latin1").strip(" \0")
    if kind == "string":
        return text or None
    if kind == "boolean":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if not text or "*" in text:  # empty, or too wide for its field
        return None
    return float(text) if kind == "double" else int(float(text)) if "." in text else int(text)


def _line(shape: bytes) -> tuple[list | None, list | None]:
    """Points and starts of parts; null shapes have neither."""
    (kind,) = struct.unpack_from("<i", shape)
    if kind == 0:
        return None, None
    if kind not in LINES:
        raise ValueError(f"shapes of type {kind} are no lines")
    n_parts, n = struct.unpack_from("<ii", shape, 36)
    parts = list(struct.unpack_from(f"<{n_parts}i", shape, 44))
    xy = struct.unpack_from(f"<{2 * n}d", shape, 44 + 4 * n_parts)
    return [{"x": x, "y": y} for x, y in zip(xy[::2], xy[1::2])], parts


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class AxisSource(DataSource):
    """All records that aren't marked as deleted: ordinal (from 0), the attributes under
    their own names, points and parts.  Path: that of the files without their suffix."""

    @classmethod
    def name(cls):
        return "street_axis"

    def schema(self):
        return ", ".join(["ordinal long", *(f"`{name}` {kind}" for name, kind, _, _ in _attributes(self.options["path"])[3]), GEOMETRY])

    def reader(self, schema):
        return _AxisReader(self.options["path"], schema, int(self.options.get("split", SPLIT)))


class _AxisReader(DataSourceReader):
    def __init__(self, base: str, schema, split: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.base, self.split, self.schema = base, split, to_arrow_schema(schema)

    def partitions(self):
        with _open(self.base, ".shx") as f:
            n = (f.size() - HEADER) // 8
        with _open(self.base, ".shp") as f:
            size = f.size() - HEADER
        if n != (rows := _attributes(self.base)[0]):
            raise ValueError(f"{n} shapes, but attributes of {rows}")
        step = max(1, self.split * n // max(size, 1))
        return [_Range(a, min(n, a + step)) for a in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        n = partition.last - partition.first
        if n == 0:
            return
        _, head, size, fields = _attributes(self.base)
        with _open(self.base, ".shx") as x, _open(self.base, ".shp") as shp, _open(self.base, ".dbf") as dbf:
            words = struct.unpack(f">{2 * n}i", _at(x, HEADER + 8 * partition.first, 8 * n))
            places = [(2 * o + 8, 2 * length) for o, length in zip(words[::2], words[1::2])]  # after a record's own header
            at = 0
            while at < n:  # shapes that follow each other, up to BLOCK bytes
                end, start = at + 1, places[at][0]
                while end < n and places[end][0] == sum(places[end - 1]) + 8 and sum(places[end]) - start <= BLOCK:
                    end += 1
                shapes = _at(shp, start, sum(places[end - 1]) - start)
                rows = _at(dbf, head + size * (partition.first + at), size * (end - at))
                yield self._batch(partition.first + at, places[at:end], shapes, rows, size, fields)
                at = end

    def _batch(self, first: int, places: list, shapes: bytes, rows: bytes, size: int, fields: list) -> pa.RecordBatch:
        kept = [k for k in range(len(places)) if rows[k * size : k * size + 1] != b"*"]
        start = places[0][0]
        lines = [_line(shapes[places[k][0] - start : sum(places[k]) - start]) for k in kept]
        columns = [[first + k for k in kept]]
        columns += [[_value(rows[k * size + a : k * size + a + length], kind) for k in kept] for _, kind, a, length in fields]
        columns += [[points for points, _ in lines], [parts for _, parts in lines]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types)], schema=self.schema)


def read_axis(spark: SparkSession, base: str, **options) -> DataFrame:
    spark.dataSource.register(AxisSource)
    return spark.read.format("street_axis").options(**options).load(base)


def verify(spark: SparkSession, base: str, digests: dict[str, str]) -> None:
    """Raises where a part's SHA-256 isn't the one given by its suffix.  A part is hashed
    in a task of its own, block by block."""

    def hashed(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                h = hashlib.sha256()
                with _open(base, part) as f:
                    while data := f.read(BLOCK):
                        h.update(data)
                yield pa.RecordBatch.from_pydict({"part": [part], "sha256": [h.hexdigest()]})

    names = spark.createDataFrame([(p,) for p in digests], "part string").repartition(len(digests))
    wrong = sorted(r.part for r in names.mapInArrow(hashed, "part string, sha256 string").collect() if r.sha256 != digests[r.part].lower())
    if wrong:
        raise ValueError(f"parts with other contents: {', '.join(wrong)}")


def projection(base: str) -> dict[str, float] | None:
    """Arguments of transverse_mercator_inverse() from the .prj; None where coordinates
    are degrees already.  Other projections, units and meridians are an error."""
    with _open(base, ".prj") as f:
        text = f.read().decode("utf-8")
    value = lambda pattern: float(m[1]) if (m := re.search(pattern + r'"\s*,\s*([-+.\deE]+)', text, re.I)) else None
    if (value(r'PRIMEM\["[^"]*') or 0.0) != 0.0:
        raise ValueError("not from Greenwich")
    if not text.lstrip().upper().startswith("PROJCS"):
        return None
    kind = re.search(r'PROJECTION\["([^"]*)"', text, re.I)
    units = re.findall(r'UNIT\["[^"]*"\s*,\s*([-+.\deE]+)', text, re.I)
    if not kind or kind[1].lower() != "transverse_mercator" or float(units[-1]) != 1.0:
        raise ValueError("only transverse Mercator in metres is known")
    a, inverse = re.search(r'SPHEROID\["[^"]*"\s*,\s*([.\deE]+)\s*,\s*([.\deE]+)', text, re.I).groups()
    given = {name: value(rf'PARAMETER\["{key}') for name, key in (("lat0", "latitude_of_origin"), ("lon0", "central_meridian"), ("k0", "scale_factor"), ("fe", "false_easting"), ("fn", "false_northing"))}
    return {name: v if v is not None else 1.0 if name == "k0" else 0.0 for name, v in given.items()} | {"a": float(a), "f": 1 / float(inverse) if float(inverse) else 0.0}


def axis_tables(axis: DataFrame, fields: dict[str, str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(streets, segments) as the geocoder takes them; attributes are found by name in
    any case, those that lack are null."""
    have = {c.upper(): c for c in axis.columns}

    def field(role: str) -> Column:
        found, kind = have.get(fields[role].upper()), "long" if role == "cdlog" else "string" if "name" in role else "double"
        return (F.col(f"`{found}`") if found else F.lit(None)).cast(kind).alias(role)

    streets = street_index(axis.select("ordinal", *map(field, ("cdlog", "name", "short_name"))))
    segments = axis.select(field("cdlog"), "ordinal", *map(field, ("even_from", "even_to", "odd_from", "odd_to")), "points", "parts")
    return streets, segments.where("cdlog IS NOT NULL AND points IS NOT NULL")
