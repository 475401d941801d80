"""The star-schema tables seen as a market table, for queries and their oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import APARTMENT, HOUSE, LAND, OFFICE, PARKING, SHOP
from .stage import spread

CLASSES = {"ECONOMY": HOUSE, "LARGE": APARTMENT, "MEDIUM": OFFICE, "PROMO": SHOP, "SMALL": LAND, "STANDARD": PARKING}
LAST_YEAR = 2026


def market_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item.  The id is the text of its keys, of whatever size, so that
    it needs no order and no shuffle; part and orders join on their keys."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part = read("part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    orders = read("orders").select("o_orderkey", F.year("o_orderdate").cast("double").alias("year"))
    line = spread(read("lineitem")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sale, offer = F.col("l_returnflag") == "R", F.col("l_returnflag") == "N"
    kinds = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    degree = lambda a, b: F.pmod(F.col("l_suppkey") * a + F.col("l_partkey") * b, F.lit(1000)).cast("double")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(sale, "guia itbi").when(offer, "oferta").otherwise("oferta aluguel").alias("info_type"), sale.alias("is_sale"), offer.alias("is_offer"),
        kinds[F.col("p_type")].alias("purpose"),
        F.when(sale, F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(F.col("l_extendedprice")).alias("value"), F.col("l_quantity").alias("area"),
        F.col("l_quantity").alias("built_area"), F.lit(None).cast("double").alias("private_area"), F.col("p_retailprice").alias("lot_area"), F.col("p_size").cast("double").alias("frontage"), "year",
        (F.lit(-30.03) + (degree(37, 11) - 500) * 0.0002).alias("lat"), (F.lit(-51.23) + (degree(53, 7) - 500) * 0.0002).alias("lon"),
        F.concat(F.lit("g"), (F.col("l_suppkey") % 50).cast("string")).alias("group"), F.col("l_orderkey").alias("listing_id"), F.col("l_partkey").cast("string").alias("registration"), F.col("l_shipdate").alias("date"),
    )


#: The same rows in SQL.
MARKET_SQL = """
m AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    CASE l_returnflag WHEN 'R' THEN 'guia itbi' WHEN 'N' THEN 'oferta' ELSE 'oferta aluguel' END AS info_type,
    l_returnflag = 'R' AS is_sale, l_returnflag = 'N' AS is_offer,
    CASE p_type WHEN 'ECONOMY' THEN 'CASA / RESIDÊNCIA' WHEN 'LARGE' THEN 'APARTAMENTO' WHEN 'MEDIUM' THEN 'SALA COMERCIAL'
      WHEN 'PROMO' THEN 'LOJA' WHEN 'SMALL' THEN 'TERRENO' WHEN 'STANDARD' THEN 'GARAGEM / VAGA' END AS purpose,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END AS value,
    l_quantity AS area, l_quantity AS built_area, CAST(NULL AS DOUBLE) AS private_area, p_retailprice AS lot_area, CAST(p_size AS DOUBLE) AS frontage,
    CAST(year(o_orderdate) AS DOUBLE) AS year,
    CAST(-30.03 AS DOUBLE) + (CAST((l_suppkey * 37 + l_partkey * 11) % 1000 AS DOUBLE) - 500) * CAST(0.0002 AS DOUBLE) AS lat,
    CAST(-51.23 AS DOUBLE) + (CAST((l_suppkey * 53 + l_partkey * 7) % 1000 AS DOUBLE) - 500) * CAST(0.0002 AS DOUBLE) AS lon,
    'g' || CAST(l_suppkey % 50 AS VARCHAR) AS "group", l_orderkey AS listing_id, CAST(l_partkey AS VARCHAR) AS registration, l_shipdate AS "date"
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
