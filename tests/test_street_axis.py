"""A street axis written as shape files, read in several tasks and geocoded with."""
import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

from vicinity.operators import geocode
from vicinity.sources import street_axis

WKT = (
    'PROJCS["TM",GEOGCS["SIRGAS",DATUM["D",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],'
    'PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",300000.0],PARAMETER["False_Northing",5000000.0],PARAMETER["Central_Meridian",-51.0],'
    'PARAMETER["Scale_Factor",0.999995],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
)
COLUMNS = (("CDLOG", "N", 10, 0), ("NMIDELOG", "C", 30, 0), ("NMIDEABR", "C", 12, 0), ("NRPARINI", "N", 8, 0), ("NRPARFIN", "N", 8, 0), ("NRIMPINI", "N", 8, 0), ("NRIMPFIN", "N", 8, 0), ("LENGTH", "N", 12, 3), ("OPEN", "L", 1, 0))


def write_axis(base, rows):
    """rows: (attributes, parts of points or None, deleted)."""
    shapes, index, table, at = b"", b"", b"", 50
    for k, (values, parts, deleted) in enumerate(rows):
        if parts is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for part in parts for p in part]
            starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
            content = struct.pack("<i4dii", 3, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shapes += struct.pack(">ii", k + 1, len(content) // 2) + content
        index += struct.pack(">ii", at, len(content) // 2)
        at += 4 + len(content) // 2
        cells = (str(v if v is not None else "").encode("latin1") for v in values)
        table += (b"*" if deleted else b" ") + b"".join(c.ljust(n) if t == "C" else c.rjust(n) for c, (_, t, n, _) in zip(cells, COLUMNS))
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii", 1000, 3) + bytes(64)
    fields = b"".join(name.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([n, d]) + bytes(14) for name, t, n, d in COLUMNS)
    dbf = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + len(fields), 1 + sum(c[2] for c in COLUMNS)) + fields + b"\r" + table + b"\x1a"
    parts = {".shp": head(100 + len(shapes)) + shapes, ".shx": head(100 + len(index)) + index, ".dbf": dbf, ".prj": WKT.encode()}
    for suffix, data in parts.items():
        (base.parent / (base.name + suffix)).write_bytes(data)
    return {suffix: hashlib.sha256(data).hexdigest() for suffix, data in parts.items()}


def forward(lat, lon):
    """Transverse Mercator of WKT by Krüger's series, which the inverse doesn't use."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e, phi, lam = math.sqrt(f * (2 - f)), math.radians(lat), math.radians(lon + 51.0)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    east = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    north = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 300000.0 + 0.999995 * radius * east, 5000000.0 + 0.999995 * radius * north


@pytest.fixture
def axis(tmp_path):
    a, b = forward(-30.03, -51.23), forward(-30.04, -51.22)
    rows = [((10, "Rua João  Abott", "R Abott", 2, 100, 1, 99, "12.500", "T"), [[a, b]], False)]
    rows += [((11, "Avenida Ipiranga", "", 0, 0, 2 * k + 1, 2 * k + 1, "********", ""), [[a, b], [b, a]], False) for k in range(60)]
    rows += [((None, "Rua Sem Código", "", 2, 4, 1, 3, "", "F"), [[a, b]], False), ((12, "Rua Apagada", "", 2, 4, 1, 3, "", "F"), [[a, b]], True), ((13, "Rua Vazia", "", 2, 4, 1, 3, "1", "?"), None, False)]
    return tmp_path / "Eixos", write_axis(tmp_path / "Eixos", rows), a, b


def test_records_in_several_tasks(spark, axis):
    base, digests, a, b = axis
    street_axis.verify(spark, str(base), digests)
    df = street_axis.read_axis(spark, str(base), split=2000)
    assert df.rdd.getNumPartitions() > 2
    rows = {r.ordinal: r for r in df.collect()}
    assert sorted(rows) == [k for k in range(64) if k != 62]  # the deleted one is left out
    first = rows[0]
    assert (first.CDLOG, first.NMIDELOG, first.LENGTH, first.OPEN) == (10, "Rua João  Abott", 12.5, True)
    assert [(p.x, p.y) for p in first.points] == [a, b] and first.parts == [0]
    assert rows[1].parts == [0, 2] and len(rows[1].points) == 4 and rows[1].LENGTH is None and rows[1].OPEN is None
    assert rows[61].CDLOG is None and rows[63].points is None and rows[63].parts is None


def test_geocoding_with_the_axis(spark, axis):
    base, _, _, _ = axis
    streets, segments = street_axis.axis_tables(street_axis.read_axis(spark, f"file://{base}", split=2000))
    assert {(r.cdlog, r.name) for r in streets.collect()} == {(10, "RUA JOÃO ABOTT"), (10, "R ABOTT"), (11, "AVENIDA IPIRANGA"), (13, "RUA VAZIA")}
    q = spark.createDataFrame([("Rua Joao Abott, 2",), ("Rua Joao Abott, 99",), ("Rua Joao Abott, 51",), ("Rua Vazia, 2",)], "query string")
    got = {r.query: r for r in geocode.geocode(q, streets, segments, street_axis.projection(str(base))).collect()}
    at = lambda query: (got[query].lat, got[query].lon)
    assert at("Rua Joao Abott, 2") == pytest.approx((-30.03, -51.23), abs=1e-7)
    assert at("Rua Joao Abott, 99") == pytest.approx((-30.04, -51.22), abs=1e-7)
    middle = at("Rua Joao Abott, 51")
    assert -30.04 < middle[0] < -30.03 and middle[0] == pytest.approx(-30.03 - 0.01 * 50 / 98, abs=1e-5)
    assert got["Rua Vazia, 2"].lat is None and got["Rua Vazia, 2"].failure == "no segment holds the number"


def test_parts_that_changed(spark, axis):
    base, digests, _, _ = axis
    with pytest.raises(ValueError, match=".dbf"):
        street_axis.verify(spark, str(base), digests | {".dbf": "0" * 64})
    shx = base.parent / "Eixos.shx"
    shx.write_bytes(shx.read_bytes()[:-8])
    with pytest.raises(Exception, match="63 shapes, but attributes of 64"):
        street_axis.read_axis(spark, str(base)).count()


def test_projection_files(tmp_path):
    base = tmp_path / "x"
    write = (tmp_path / "x.prj").write_text
    write(WKT)
    p = street_axis.projection(str(base))
    assert (p["fe"], p["fn"], p["lon0"], p["lat0"], p["k0"], p["a"]) == (300000.0, 5000000.0, -51.0, 0.0, 0.999995, 6378137.0) and p["f"] == pytest.approx(1 / 298.257222101)
    write(WKT.split("GEOGCS")[0].replace("PROJCS", "GEOGCS") + 'DATUM["D",SPHEROID["G",6378137.0,298.25]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.017]]')
    assert street_axis.projection(str(base)) is None
    for wrong in (WKT.replace("Transverse_Mercator", "Lambert"), WKT.replace('"Meter",1.0', '"Foot",0.3048'), WKT.replace('"Greenwich",0.0', '"Paris",2.3')):
        write(wrong)
        with pytest.raises(ValueError):
            street_axis.projection(str(base))


def test_empty_axis(spark, tmp_path):
    write_axis(tmp_path / "e", [])
    df = street_axis.read_axis(spark, str(tmp_path / "e"))
    assert df.count() == 0 and "NMIDELOG" in df.columns
    assert street_axis.axis_tables(df)[0].agg(F.count("*")).first()[0] == 0
