"""The kept table of geocoded queries: only new and expired ones are asked."""
import datetime

from pyspark.sql import functions as F

from vicinity.sources import geocode_table as G

DAY = datetime.datetime(2024, 5, 1, 12)


def test_two_sources_and_expiry(spark, tmp_path):
    asked = {"axis": [], "service": []}

    def source(name, known):
        def ask(queries):
            own = sorted(r[0] for r in queries.collect())
            asked[name] += own
            rows = [(q, *known.get(q, (None, None)), f"street of {q}" if name == "axis" else None, 90.0, "no segment" if name == "axis" else None) for q in own]
            return spark.createDataFrame(rows, "query string, lat double, lon double, matched string, score double, failure string")

        return ask

    sources = [
        ("street axis", G.of_locality("Porto Alegre"), source("axis", {"Rua A, 10": (-30.0, -51.0)})),
        ("service", None, source("service", {"Rua B, 20": (-30.1, -51.1), "Rua C, 5, Centro, Canoas": (-29.9, -51.2)})),
    ]
    folder = f"file://{tmp_path}/geo"

    def run(queries, now, most=100):
        asked["axis"], asked["service"] = [], []
        df = spark.createDataFrame(list(enumerate(queries)), "id long, q string")
        out, counts = G.locate(df, F.col("q"), "id", folder, sources, now, most)
        return {r.id: (r._geo_lat, r._geo_method, r._geo_matched, r._geo_failure) for r in out.collect()}, counts

    queries = ["Rua A, 10", " Rua B, 20 ", "Rua C, 5, Centro, Canoas", "Rua D, 7", "", None, "Rua A, 10", "Rua E"]
    got, counts = run(queries, DAY)
    assert asked == {"axis": ["Rua A, 10", "Rua B, 20", "Rua D, 7"], "service": ["Rua B, 20", "Rua C, 5, Centro, Canoas", "Rua D, 7", "Rua E"]}
    assert got[0] == got[6] == (-30.0, "street axis", "street of Rua A, 10", "") and got[1] == (-30.1, "service", "street of Rua B, 20", "")
    assert got[3] == (None, G.NOT_FOUND, "street of Rua D, 7", "no segment") and got[7][3] == "Endereço não localizado" and got[4] == (None,) * 4
    assert counts == {"rows": 8, "unique_queries": 5, "geocoded_rows": 4, "axis_rows": 2, "second_source_rows": 2, "failed_rows": 2, "attempted_queries": 5, "not_attempted_queries": 0}

    got, counts = run([*queries, "Rua F, 1"], DAY + datetime.timedelta(days=29))  # only what is new
    assert asked == {"axis": ["Rua F, 1"], "service": ["Rua F, 1"]} and got[0][0] == -30.0
    got, counts = run([*queries, "Rua F, 1", "Rua G, 2"], DAY + datetime.timedelta(days=31), most=6)  # what is older than 30 days
    assert asked["service"] == ["Rua B, 20", "Rua C, 5, Centro, Canoas", "Rua D, 7", "Rua E"] and counts["not_attempted_queries"] == 1 and got[9] == (None,) * 4
    assert G.current(spark, folder).count() == 6 and len([p for p in (tmp_path / "geo").iterdir() if p.name.startswith("v-")]) == 2


def test_a_failed_run_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/geo"
    df = spark.createDataFrame([(1, "Rua A, 10")], "id long, q string")
    place = lambda q: q.withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0)})
    G.locate(df, F.col("q"), "id", folder, [("axis", None, place)], DAY)
    broken = lambda q: q.withColumns({"lat": F.raise_error(F.lit("as planned")).cast("double"), "lon": F.lit(2.0)})
    try:
        G.locate(df.withColumn("q", F.lit("Rua B, 1")), F.col("q"), "id", folder, [("axis", None, broken)], DAY)
        raise AssertionError("no failure")
    except Exception as e:
        assert "as planned" in str(e)
    assert [r.query for r in G.current(spark, folder).collect()] == ["Rua A, 10"]
