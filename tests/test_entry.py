import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ("info_type", "purpose_class", "conflict_level", "keep_latest_listing", "keep_latest_primary", "rule_filter", "robust_prefilter", "discount_by_purpose", "center_scales", "cap_weights", "estimate_batch", "street_range", "address_parse", "geocode_addresses", "attach_coordinates", "limited_queries", "street_names", "sorted_purposes", "prepared_market", "prepared_purposes", "purpose_rules", "purpose_confidence", "source_counts", "typed_text", "neighbour_report", "latest_events", "valuation")


def cells(rows):
    one = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = entry.queries()[name](spark, SF)
    columns = sorted(out.columns)
    found = con.sql(entry.oracle_sql()[name])
    assert columns == sorted(found.columns)
    assert cells(tuple(r) for r in out.select(*columns).collect()) == cells(found.select(*map('"{}"'.format, columns)).fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 25
