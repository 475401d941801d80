"""Registered queries over the market view, each with its SQL where SQL can say it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as T
from .functions.roles import ColumnMapping
from .operators import backtest as B
from .operators import dedup, enrich, geocode, knn, prefilter, report, robust
from .operators.discount import adjust, offer_discount
from .operators.robust import by_name, capped_weights, center_scale, quantiles, robust_mean
from .plans.params import FLOORS
from .plans.prepare import prepare, prepare_all
from .sources.market_view import LAST_YEAR, MARKET_SQL, market_rows
from .sources.stage import spread, staged, staged_wide
from .streaming.latest import current, latest_changes, written_changes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def r6(c):
    return F.round(c, 6)


def traded(spark, sf_dir) -> DataFrame:
    """Sales and offers."""
    return market_rows(spark, sf_dir).where("is_sale OR is_offer")


def priced(spark, sf_dir) -> DataFrame:
    """Rows that the deterministic rules keep, with discounted unit values as unit."""
    rows = prefilter.apply_rules(traded(spark, sf_dir), "purpose", F.col("is_sale")).where("_status = 'kept'")
    return adjust(rows, offer_discount(rows, ["purpose"]), ["purpose"]).withColumn("unit", F.col("adjusted_unit"))


def candidates(spark, sf_dir) -> DataFrame:
    """priced(), staged with the columns that valuations read."""
    return staged_wide(priced(spark, sf_dir).select("id", "purpose", "group", "is_sale", *knn.FEATURES, "lat", "lon", "unit"))


PURPOSES = ["CASA / RESIDÊNCIA", "APARTAMENTO", "SALA COMERCIAL", "LOJA", "TERRENO", "GARAGEM / VAGA"]


def nation_targets(spark, sf_dir) -> DataFrame:
    """A target for each nation; every sixth has no place."""
    k = F.col("n_nationkey")
    names = F.array(*map(F.lit, PURPOSES))
    return table(spark, sf_dir, "nation").select(
        k.cast("long").alias("target_id"), F.element_at(names, (k % 6 + 1).cast("int")).alias("purpose"), (k + 10).cast("double").alias("built_area"), F.when(k % 2 == 0, (1995 + k % 7).cast("double")).alias("year"),
        F.when(k % 6 != 5, F.lit(-30.03) + (k - 12) * F.lit(0.005)).alias("lat"), F.when(k % 6 != 5, F.lit(-51.23) + (k - 12) * F.lit(0.004)).alias("lon"),
    )


FLOOR_SQL = "CASE purpose " + " ".join(f"WHEN '{p}' THEN {FLOORS[f]}" for p, f in zip(PURPOSES, ("casa / residencia", "apartamento", "sala comercial", "loja", "terreno", "garagem / vaga"))) + " END"
RULED = f"""{MARKET_SQL},
u AS (SELECT *, value / nullif(area, 0) AS unit_value, CAST({FLOOR_SQL} AS DOUBLE) AS flr FROM m WHERE is_sale OR is_offer),
r AS (SELECT *, concat_ws('; ', CASE WHEN value IS NULL OR NOT value > 0 THEN 'valor ausente ou não positivo' END,
    CASE WHEN value > 0 AND value <= 1 THEN 'valor simbólico' END,
    CASE WHEN area IS NULL OR NOT area > 0 THEN 'área de referência ausente ou não positiva' END,
    CASE WHEN unit_value IS NULL OR NOT unit_value > 0 THEN 'valor unitário inválido' END,
    CASE WHEN unit_value > 0 AND unit_value < flr THEN 'valor unitário abaixo do piso da finalidade' END) AS reasons FROM u)"""
DISCOUNT = f"""{RULED},
kept AS MATERIALIZED (SELECT * FROM r WHERE reasons = ''),
cnt AS (SELECT purpose, count(*) FILTER (WHERE is_sale) AS n_sales, count(*) FILTER (WHERE is_offer) AS n_offers,
    list(unit_value) FILTER (is_sale) AS ls, list(unit_value) FILTER (is_offer) AS lo FROM kept GROUP BY purpose),
nq AS (SELECT *, CASE WHEN n_sales >= 2 AND n_offers >= 2 THEN greatest(5, least(19, n_sales, n_offers)) END AS n_quantiles FROM cnt),
lv AS (SELECT purpose, unnest(list_transform(range(CAST(n_quantiles AS BIGINT)), lambda i: 0.1::DOUBLE + 0.8::DOUBLE * i / (n_quantiles - 1))) AS q FROM nq WHERE n_quantiles IS NOT NULL),
sq AS (SELECT purpose, unit_value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY purpose) AS n FROM kept WHERE is_sale WINDOW w AS (PARTITION BY purpose ORDER BY unit_value)),
oq AS (SELECT purpose, unit_value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY purpose) AS n FROM kept WHERE is_offer WINDOW w AS (PARTITION BY purpose ORDER BY unit_value)),
qs AS (SELECT l.purpose, q, max(CASE WHEN i = floor(q * (n - 1)) + 1 THEN v END) AS a, max(CASE WHEN i = least(n, floor(q * (n - 1)) + 2) THEN v END) AS b, max(q * (n - 1) - floor(q * (n - 1))) AS f FROM lv l JOIN sq ON sq.purpose = l.purpose GROUP BY ALL),
qo AS (SELECT l.purpose, q, max(CASE WHEN i = floor(q * (n - 1)) + 1 THEN v END) AS a, max(CASE WHEN i = least(n, floor(q * (n - 1)) + 2) THEN v END) AS b, max(q * (n - 1) - floor(q * (n - 1))) AS f FROM lv l JOIN oq ON oq.purpose = l.purpose GROUP BY ALL),
dd AS (SELECT qs.purpose, median(1 - (qs.a + (qs.b - qs.a) * qs.f) / (qo.a + (qo.b - qo.a) * qo.f)) AS raw_median, avg(1 - (qs.a + (qs.b - qs.a) * qs.f) / (qo.a + (qo.b - qo.a) * qo.f)) AS raw_mean FROM qs JOIN qo ON qs.purpose = qo.purpose AND qs.q = qo.q GROUP BY 1),
disc AS (SELECT purpose, n_sales, n_offers, n_quantiles, raw_median, raw_mean,
    CASE WHEN n_sales = 0 AND n_offers > 0 THEN 0.1 WHEN raw_median IS NULL THEN 0.0 ELSE greatest(0.0, least(0.2, raw_median)) END::DOUBLE AS discount,
    CASE WHEN n_sales = 0 AND n_offers > 0 THEN 'offers_only_fallback' WHEN n_offers = 0 THEN 'no_offers' WHEN n_quantiles IS NULL THEN 'insufficient_mixed_sample' ELSE 'empirical_ratio' END AS source
  FROM nq LEFT JOIN dd USING (purpose))"""
PRICED = f"""{DISCOUNT},
p AS MATERIALIZED (SELECT k.*, unit_value * CASE WHEN is_offer THEN 1 - discount ELSE 1 END AS unit FROM kept k JOIN disc USING (purpose))"""
NATIONS = "tn AS (SELECT CAST(n_nationkey AS BIGINT) AS target_id, ([" + ", ".join(f"'{p}'" for p in PURPOSES) + """])[n_nationkey % 6 + 1] AS tp, CAST(n_nationkey + 10 AS DOUBLE) AS tb,
    CASE WHEN n_nationkey % 2 = 0 THEN CAST(1995 + n_nationkey % 7 AS DOUBLE) END AS ty,
    CASE WHEN n_nationkey % 6 <> 5 THEN CAST(-30.03 AS DOUBLE) + (n_nationkey - 12) * CAST(0.005 AS DOUBLE) END AS tlat,
    CASE WHEN n_nationkey % 6 <> 5 THEN CAST(-51.23 AS DOUBLE) + (n_nationkey - 12) * CAST(0.004 AS DOUBLE) END AS tlon,
    CAST(NULL AS DOUBLE) AS tl, CAST(NULL AS BIGINT) AS xid, '' AS xg FROM nation)"""
PARAMETERS = """t AS (SELECT *, CASE tp WHEN 'CASA / RESIDÊNCIA' THEN 5 WHEN 'SALA COMERCIAL' THEN 9 WHEN 'GARAGEM / VAGA' THEN 7 ELSE 12 END AS min_k,
    CASE tp WHEN 'CASA / RESIDÊNCIA' THEN 40 WHEN 'SALA COMERCIAL' THEN 20 WHEN 'GARAGEM / VAGA' THEN 30 ELSE 25 END AS max_k,
    CAST(CASE tp WHEN 'CASA / RESIDÊNCIA' THEN 5 WHEN 'SALA COMERCIAL' THEN 15 WHEN 'GARAGEM / VAGA' THEN 5 ELSE 11 END AS DOUBLE) AS goal,
    CASE WHEN tlat IS NULL THEN 1.0::DOUBLE ELSE CASE tp WHEN 'CASA / RESIDÊNCIA' THEN 0.85::DOUBLE WHEN 'SALA COMERCIAL' THEN 0.60::DOUBLE WHEN 'GARAGEM / VAGA' THEN 2::DOUBLE / 3 ELSE 0.45::DOUBLE END END AS phys,
    CASE tp WHEN 'CASA / RESIDÊNCIA' THEN 0.20::DOUBLE WHEN 'SALA COMERCIAL' THEN 0.25::DOUBLE ELSE 0.30::DOUBLE END AS cap,
    CASE tp WHEN 'CASA / RESIDÊNCIA' THEN 0.50::DOUBLE WHEN 'SALA COMERCIAL' THEN 0.65::DOUBLE WHEN 'GARAGEM / VAGA' THEN 1.00::DOUBLE ELSE 0.35::DOUBLE END AS pow_,
    CASE tp WHEN 'CASA / RESIDÊNCIA' THEN 2.0::DOUBLE WHEN 'SALA COMERCIAL' THEN 2.5::DOUBLE WHEN 'GARAGEM / VAGA' THEN 2.5::DOUBLE ELSE 1.25::DOUBLE END AS mad_t FROM tn)"""
PAIRS = f"""{PRICED}, {NATIONS}, {PARAMETERS},
pr0 AS (SELECT t.*, p.id, p.unit, p.built_area, p.lot_area, p.year,
    CASE WHEN tlat IS NOT NULL THEN sqrt(pow(6371.0088 * cos(radians(tlat)) * radians(p.lon - tlon), 2) + pow(6371.0088 * radians(p.lat - tlat), 2)) END AS geo
  FROM t JOIN p ON p.purpose = t.tp WHERE p.unit > 0 AND p.built_area > 0 AND (tl IS NULL OR p.lot_area > 0) AND (ty IS NULL OR (p.year BETWEEN 1500 AND 2026)) AND (xid IS NULL OR p.id <> xid) AND (xg = '' OR p."group" <> xg)),
sc AS (SELECT target_id, quantile_cont(built_area, 0.75) - quantile_cont(built_area, 0.25) AS sb, quantile_cont(year, 0.75) - quantile_cont(year, 0.25) AS sy, quantile_cont(lot_area, 0.75) - quantile_cont(lot_area, 0.25) AS sl, median(geo) FILTER (geo > 0) AS g, count(*) AS n FROM pr0 GROUP BY 1),
pr AS (SELECT pr0.*, n, (pow((built_area - tb) / sb, 2) + CASE WHEN ty IS NULL THEN 0 ELSE pow((pr0.year - ty) / sy, 2) END + CASE WHEN tl IS NULL THEN 0 ELSE pow((lot_area - tl) / sl, 2) END) / (1 + CASE WHEN ty IS NULL THEN 0 ELSE 1 END + CASE WHEN tl IS NULL THEN 0 ELSE 1 END) AS a2, coalesce(least(20.0, greatest(0.25, g)), 1.0)::DOUBLE AS gs FROM pr0 JOIN sc USING (target_id)),
ds AS MATERIALIZED (SELECT *, sqrt(phys * a2 + (1 - phys) * coalesce(pow(geo / gs, 2), 0)) AS dist FROM pr)"""
NEAR = f"""{PAIRS},
nk AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY dist, id) AS rk FROM ds QUALIFY rk <= max_k),
ks AS (SELECT *, pow(dist + 1e-9::DOUBLE, -pow_) * CASE WHEN geo * 1000 <= 30 THEN 2.0 WHEN geo * 1000 <= 50 THEN 1 + (50 - geo * 1000) / 20 ELSE 1.0 END AS raw, unnest(range(greatest(min_k, rk), max_k + 1)) AS k FROM nk),
kw AS (SELECT *, row_number() OVER o - 1 AS mm, sum(raw) OVER (PARTITION BY target_id, k ORDER BY raw DESC, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail, greatest(cap, 1.0::DOUBLE / k) AS cp FROM ks WINDOW o AS (PARTITION BY target_id, k ORDER BY raw DESC, rk)),
kc AS (SELECT *, coalesce(min(CASE WHEN (1 - mm * cp) * raw <= (cp + 1e-15) * tail THEN mm END) OVER (PARTITION BY target_id, k), k) AS nc FROM kw),
kr AS (SELECT *, max(CASE WHEN mm = nc THEN tail END) OVER (PARTITION BY target_id, k) AS rest FROM kc),
kv AS (SELECT *, greatest(0, least(cp, CASE WHEN mm < nc THEN cp ELSE (1 - nc * cp) * raw / rest END)) AS sh FROM kr),
kx AS (SELECT *, sh / sum(sh) OVER (PARTITION BY target_id, k) AS weight FROM kv),
ke AS (SELECT *, 1 / sum(weight * weight) OVER (PARTITION BY target_id, k) AS n_eff FROM kx),
kk AS (SELECT *, coalesce(min(CASE WHEN n_eff >= goal - 1e-9 THEN k END) OVER (PARTITION BY target_id), max_k) AS kb FROM ke),
nb AS MATERIALIZED (SELECT * FROM kk WHERE k = kb)"""
ESTIMATE = f"""{NEAR},
c1 AS (SELECT *, sum(weight) OVER (PARTITION BY target_id ORDER BY unit, id) AS cw FROM nb),
md AS (SELECT target_id, min(unit) AS med FROM (SELECT *, max(cw) OVER (PARTITION BY target_id) AS tw FROM c1) WHERE cw >= 0.5 * tw GROUP BY 1),
c2 AS (SELECT nb.*, med, abs(unit - med) AS dev FROM nb JOIN md USING (target_id)),
c3 AS (SELECT *, sum(weight) OVER (PARTITION BY target_id ORDER BY dev, id) AS cw FROM c2),
m2 AS (SELECT target_id, min(dev) AS mad FROM (SELECT *, max(cw) OVER (PARTITION BY target_id) AS tw FROM c3) WHERE cw >= 0.5 * tw GROUP BY 1),
cl AS (SELECT c2.*, CASE WHEN 1.4826 * mad > 1e-12 THEN least(greatest(unit, med - mad_t * 1.4826 * mad), med + mad_t * 1.4826 * mad) ELSE unit END AS clipped FROM c2 JOIN m2 USING (target_id)),
es AS (SELECT target_id, any_value(tp) AS purpose, max(k) AS k_used, max(n_eff) AS n_eff, max(n) AS n_candidates, sum(weight * clipped) AS unit_estimate, sum(weight * clipped) * any_value(tb) AS total_estimate,
    median(geo) AS geo_median_km, sum(CASE WHEN abs(unit - clipped) > 1e-8 + 1e-5 * abs(clipped) THEN weight ELSE 0 END) AS adjusted_weight, any_value(goal) AS goal FROM cl GROUP BY 1)"""


#: Parameters of the local filter, the reference sets and the bounds, over the pairs of `ds`.
CUTS = f"""{PAIRS},
lf AS (SELECT *, CASE tp WHEN 'SALA COMERCIAL' THEN 0.55::DOUBLE WHEN 'LOJA' THEN 0.50::DOUBLE ELSE 0.45::DOUBLE END AS fr, CASE tp WHEN 'SALA COMERCIAL' THEN 1.60::DOUBLE WHEN 'LOJA' THEN 1.65::DOUBLE ELSE 1.70::DOUBLE END AS gr,
    CASE tp WHEN 'SALA COMERCIAL' THEN 2.00::DOUBLE ELSE 2.20::DOUBLE END AS compact, built_area / tb BETWEEN 0.5 AND 2.0 AND coalesce(lot_area / tl BETWEEN 0.5 AND 2.0, true) AND coalesce(geo <= 5, true) AS st, built_area / tb BETWEEN 1.0::DOUBLE / 3 AND 3.0 AND coalesce(lot_area / tl BETWEEN 1.0::DOUBLE / 3 AND 3.0, true) AND coalesce(geo <= 10, true) AS rx FROM ds),
ls AS (SELECT *, count(*) FILTER (WHERE st) OVER (PARTITION BY target_id) AS ns, count(*) FILTER (WHERE rx) OVER (PARTITION BY target_id) AS nr, row_number() OVER (PARTITION BY target_id ORDER BY dist, id) AS near FROM lf),
lm AS (SELECT *, CASE WHEN ns >= 8 THEN 'strict' WHEN nr >= 8 THEN 'relaxed' ELSE 'nearest' END AS mode FROM ls WHERE n >= greatest(min_k + 1, 8)),
l0 AS (SELECT *, count(*) OVER (PARTITION BY target_id) AS n_ref, pow(dist + 0.25, -0.75) AS lraw, ln(unit) AS x FROM lm WHERE CASE mode WHEN 'strict' THEN st WHEN 'relaxed' THEN rx ELSE near <= least(n, greatest(8, least(60, greatest(max_k * 2, 20)))) END),
l1 AS (SELECT *, row_number() OVER w - 1 AS lm_, sum(lraw) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ltail FROM l0 WHERE n_ref >= 8 WINDOW w AS (PARTITION BY target_id ORDER BY lraw DESC, id)),
l2 AS (SELECT *, coalesce(min(CASE WHEN (1 - lm_ * 0.25) * lraw <= (0.25 + 1e-15) * ltail THEN lm_ END) OVER (PARTITION BY target_id), n_ref) AS lc FROM l1),
l3 AS (SELECT *, max(CASE WHEN lm_ = lc THEN ltail END) OVER (PARTITION BY target_id) AS lrest FROM l2),
lw AS MATERIALIZED (SELECT *, CASE WHEN lm_ < lc THEN 0.25::DOUBLE ELSE (1 - lc * 0.25) * lraw / lrest END AS lweight FROM l3),
l4 AS (SELECT *, sum(lweight) OVER (PARTITION BY target_id ORDER BY x, id) AS lcum, sum(lweight) OVER (PARTITION BY target_id) AS ltot FROM lw),
l5 AS (SELECT target_id, min(x) FILTER (lcum >= 0.5 * ltot) AS med, min(x) FILTER (lcum >= 0.25 * ltot) AS q1, min(x) FILTER (lcum >= 0.75 * ltot) AS q3 FROM l4 GROUP BY 1),
l6 AS MATERIALIZED (SELECT l4.*, med, q1, q3, sum(lweight) OVER (PARTITION BY target_id ORDER BY abs(x - med), id) AS dcum FROM l4 JOIN l5 USING (target_id)),
l7 AS (SELECT target_id, min(abs(x - med)) FILTER (dcum >= 0.5 * ltot) AS dev FROM l6 GROUP BY 1),
g0 AS MATERIALIZED (SELECT *, lead(unit) OVER w AS u, row_number() OVER w AS k, sum(lweight) OVER w AS lw_ FROM lw WINDOW w AS (PARTITION BY target_id ORDER BY unit, id)),
g1 AS (SELECT target_id, unit AS v, u, k, lw_, n_ref, min_k FROM g0 WHERE u / unit >= gr AND k / n_ref <= 0.30 AND lw_ <= 0.30 AND n_ref - k >= greatest(min_k, 8) AND n_ref >= greatest(min_k, 8) + 1),
g2 AS (SELECT g1.target_id, v, g1.u, g1.k, g1.lw_, median(dist) FILTER (unit <= v) AS dl, median(dist) FILTER (unit > v) AS du FROM g1 JOIN g0 ON g1.target_id = g0.target_id GROUP BY ALL),
g3 AS (SELECT *, u / v AS gap_ratio, sqrt(u * v) AS gap_cutoff, row_number() OVER (PARTITION BY target_id ORDER BY ln(u / v) * (1 - lw_) / greatest(du / greatest(dl, 1e-9), 0.5) DESC, k) AS best FROM g2 WHERE k <= 2 OR du / greatest(dl, 1e-9) <= 1.35),
h0 AS (SELECT target_id, any_value(mode) AS mode, any_value(n) AS n, any_value(min_k) AS min_k, any_value(n_ref) AS n_ref, any_value(med) AS med, any_value(q1) AS q1, any_value(q3) AS q3, any_value(fr) AS fr, any_value(compact) AS compact FROM l6 GROUP BY 1),
h1 AS (SELECT h0.*, dev, gap_ratio, gap_cutoff, greatest(CASE WHEN dev > 1e-12 THEN exp(med - 3.0 * dev / 0.6745) ELSE 0 END, CASE WHEN q3 - q1 > 1e-12 THEN exp(q1 - 2.0 * (q3 - q1)) ELSE 0 END) AS rb, exp(med) * fr AS fraction
  FROM h0 JOIN l7 USING (target_id) LEFT JOIN (SELECT * FROM g3 WHERE best = 1) USING (target_id)),
h2 AS (SELECT *, CASE WHEN rb > 0 THEN rb END AS b1, CASE WHEN exp(q3 - q1) <= compact OR gap_ratio IS NOT NULL THEN fraction END AS b2 FROM h1),
h3 AS (SELECT *, greatest(b1, b2, gap_cutoff) AS b0 FROM h2),
h4 AS (SELECT h3.target_id, count(*) FILTER (unit < b0) AS n_low, count(*) FILTER (unit < rb) AS n_rb FROM h3 JOIN ds USING (target_id) GROUP BY 1),
h5 AS (SELECT *, floor(n * 0.30) AS most, greatest(min_k, 2) AS least_ FROM h3 JOIN h4 USING (target_id)),
h6 AS (SELECT *, n_low > most AND rb > 0 AND n_rb <= most AND n - n_rb >= least_ AS again FROM h5),
cut AS MATERIALIZED (SELECT target_id, mode, n_ref AS n_reference, exp(med) AS median, gap_ratio, CASE WHEN again THEN rb ELSE b0 END AS bound, CASE WHEN again THEN 'robust after lock' WHEN b1 = b0 THEN 'robust' WHEN b2 = b0 THEN 'fraction' WHEN gap_cutoff = b0 THEN 'gap' END AS source,
    CASE WHEN b0 IS NULL THEN NULL WHEN n_low > most AND NOT again THEN 'over 30 % of candidates' WHEN n - CASE WHEN again THEN n_rb ELSE n_low END < least_ THEN 'too few left' END AS cancelled FROM h6)"""
#: The same valuation after the filter: pairs below their target's bound go, and scales are taken anew.
FILTERED_SQL = """{CUTS},
f0 AS (SELECT ds.* EXCLUDE (n, a2, gs, dist) FROM ds LEFT JOIN cut ON ds.target_id = cut.target_id AND cancelled IS NULL WHERE bound IS NULL OR unit >= bound),
fs AS (SELECT target_id, quantile_cont(built_area, 0.75) - quantile_cont(built_area, 0.25) AS sb, quantile_cont(year, 0.75) - quantile_cont(year, 0.25) AS sy, quantile_cont(lot_area, 0.75) - quantile_cont(lot_area, 0.25) AS sl, median(geo) FILTER (geo > 0) AS g, count(*) AS n FROM f0 GROUP BY 1),
f1 AS (SELECT f0.*, n, (pow((built_area - tb) / sb, 2) + CASE WHEN ty IS NULL THEN 0 ELSE pow((f0.year - ty) / sy, 2) END + CASE WHEN tl IS NULL THEN 0 ELSE pow((lot_area - tl) / sl, 2) END) / (1 + CASE WHEN ty IS NULL THEN 0 ELSE 1 END + CASE WHEN tl IS NULL THEN 0 ELSE 1 END) AS a2, coalesce(least(20.0, greatest(0.25, g)), 1.0)::DOUBLE AS gs FROM f0 JOIN fs USING (target_id)),
fd AS MATERIALIZED (SELECT *, sqrt(phys * a2 + (1 - phys) * coalesce(pow(geo / gs, 2), 0)) AS dist FROM f1)"""


def filtered(estimate: str, cuts: str) -> str:
    """An estimate's SQL with the local filter between its distances and its neighbours."""
    return estimate.replace("\nnk AS (", "\nnk AS (", 1).replace(PAIRS, FILTERED_SQL.replace("{CUTS}", cuts), 1).replace(" FROM ds QUALIFY rk <= max_k", " FROM fd QUALIFY rk <= max_k", 1)


@query("SELECT l_returnflag AS flag, CASE l_returnflag WHEN 'R' THEN 'Guia ITBI' WHEN 'N' THEN 'Oferta' ELSE 'Oferta Aluguel' END AS info_type, count(*) AS n FROM lineitem GROUP BY 1, 2")
def info_type(spark, sf_dir):
    flag = F.col("l_returnflag")
    messy = F.when(flag == "R", "  Transação ").when(flag == "N", "Anúncio de  VENDA").otherwise("Locação mensal (anúncio)")
    return table(spark, sf_dir, "lineitem").groupBy(flag.alias("flag"), T.information_type(messy).alias("info_type")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(floor(l_extendedprice) AS DOUBLE), 6) AS whole, round(l_extendedprice, 2) AS cents FROM lineitem")
def parse_number(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    brazilian = F.concat(F.lit("R$ "), F.translate(F.format_number(F.floor("l_extendedprice"), 0), ",", "."))
    fraction = F.concat(F.lit("R$ "), F.translate(F.format_number(F.floor(cents / 100), 0), ",", "."), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" por mês"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(N.parse_number(brazilian)).alias("whole"), F.round(N.parse_number(fraction), 2).alias("cents"))


@query("SELECT p_partkey, trim(regexp_replace('acao ' || lower(p_name) || ' ' || lower(p_type) || ' eo', '\\s+', ' ', 'g')) AS text FROM part")
def norm_text(spark, sf_dir):
    messy = F.concat(F.lit("  AÇÃO\t"), F.upper("p_name"), F.lit(" \n "), F.col("p_type"), F.lit("  ÉÕ "))
    return table(spark, sf_dir, "part").select("p_partkey", T.norm(messy).alias("text"))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'CASA / RESIDÊNCIA' WHEN 1 THEN 'APARTAMENTO' WHEN 2 THEN 'IMÓVEL COMERCIAL' WHEN 3 THEN 'LOJA EM SHOPPING'
  WHEN 4 THEN 'GLEBA' WHEN 5 THEN 'GARAGEM / VAGA RESIDENCIAL' WHEN 6 THEN '' ELSE 'SALA COMERCIAL' END AS purpose,
  CASE p_size % 8 WHEN 4 THEN 'terreno' WHEN 1 THEN 'privativa' WHEN 5 THEN 'privativa' WHEN 7 THEN 'privativa' WHEN 2 THEN 'privativa_ou_construida' WHEN 3 THEN 'privativa_ou_construida' ELSE 'construida' END AS area,
  CASE p_size % 8 WHEN 0 THEN 'RESIDENCIAL' WHEN 1 THEN 'RESIDENCIAL' WHEN 5 THEN 'RESIDENCIAL' WHEN 4 THEN 'TERRITORIAL' WHEN 6 THEN 'INDETERMINADA' ELSE 'NÃO RESIDENCIAL' END AS nature FROM part""")
def purpose_class(spark, sf_dir):
    texts = ["Casa de Condomínio", "Apto. cobertura sala", "Casa comercial", "Loja - Shopping", "Gleba", "Box / vaga residência", "Imóvel", "Conjunto Comercial"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_size") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.purpose_class(text).alias("purpose"), T.area_preference(T.purpose_class(text)).alias("area"), T.use_nature(T.purpose_class(text)).alias("nature"))


@query("""WITH k AS (SELECT p_partkey, (['APARTAMENTO', 'COBERTURA', 'GARAGEM / VAGA', 'GARAGEM / VAGA RESIDENCIAL', ''])[p_size % 5 + 1] AS a, (['APARTAMENTO', 'LOJA', 'GARAGEM / VAGA', 'GARAGEM / VAGA NÃO RESIDENCIAL'])[p_partkey % 4 + 1] AS b FROM part)
SELECT p_partkey, CASE WHEN a = '' THEN 'Não aplicável' WHEN a = b THEN 'Não' WHEN a LIKE 'GAR%' AND b LIKE 'GAR%' AND (a = 'GARAGEM / VAGA' OR b = 'GARAGEM / VAGA') THEN 'Não' WHEN a = 'COBERTURA' AND b = 'APARTAMENTO' THEN 'Moderado' ELSE 'Sim' END AS level FROM k""")
def conflict_level(spark, sf_dir):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    a = pick(["APARTAMENTO", "COBERTURA", "GARAGEM / VAGA", "GARAGEM / VAGA RESIDENCIAL", ""], F.col("p_size") % 5)
    b = pick(["APARTAMENTO", "LOJA", "GARAGEM / VAGA", "GARAGEM / VAGA NÃO RESIDENCIAL"], F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", T.combine_conflicts(T.comparison_level(a, b)).alias("level"))


@query(f"""WITH {MARKET_SQL}, k AS (SELECT is_sale, is_offer, purpose AS cad, CASE WHEN listing_id % 3 = 0 THEN '' ELSE 'APARTAMENTO' END AS lst, CASE WHEN listing_id % 7 = 0 THEN 'LOJA' ELSE '' END AS exp FROM m WHERE is_sale OR is_offer),
x AS (SELECT *, CASE WHEN exp <> '' THEN exp WHEN is_offer AND lst <> '' THEN lst ELSE cad END AS final, CASE WHEN exp <> '' THEN 'FINALIDADE_CRAWLER' WHEN is_offer AND lst <> '' THEN 'TIPO_CRAWLER' WHEN is_sale THEN 'SIAT' ELSE 'SIAT_FALLBACK' END AS source FROM k)
SELECT final AS purpose, source, count(*) AS n FROM x GROUP BY 1, 2""")
def purpose_cascade(spark, sf_dir):
    m = traded(spark, sf_dir)
    kind = F.when(F.col("is_sale"), T.SALE).otherwise(T.OFFER)
    out, _ = enrich.purpose_cascade(kind, F.when(F.col("listing_id") % 7 == 0, "LOJA").otherwise(""), F.col("purpose"), F.when(F.col("listing_id") % 3 == 0, "").otherwise("APARTAMENTO"))
    return m.groupBy(out["_purpose"].alias("purpose"), out["_purpose_source"].alias("source")).agg(F.count("*").alias("n"))


# A text for each rule of purpose_class(), in the rules' order, with its class.
RULE_TEXTS = (
    ("  Não   Informado ", ""), ("Apart-Hotel no centro", "FLAT / APART-HOTEL"), ("COBERTURA duplex", "COBERTURA"), ("Kitinete mobiliada", "APARTAMENTO"), ("Loja, Shopping norte", "LOJA EM SHOPPING"), ("Loja (galeria)", "LOJA EM GALERIA"),
    ("Sala de Cobertura", "SALA COMERCIAL"), ("Ponto Comercial", "LOJA"), ("Unidade de Serviço", "IMÓVEL COMERCIAL"), ("Pavilhão industrial", "GALPÃO / DEPÓSITO"), ("Construção em área projetada de gleba", "CONSTRUÇÃO EM ÁREA DE GLEBA"), ("gleba urbana", "GLEBA"),
    ("Sítio", "TERRENO"), ("Edifício garagem", "GARAGEM / VAGA NÃO RESIDENCIAL"), ("vaga, uso residencial", "GARAGEM / VAGA RESIDENCIAL"), ("Box coberto", "GARAGEM / VAGA"), ("Pousada", "HOTEL"), ("Sobrado geminado", "CASA / RESIDÊNCIA"), ("ESPECIAL", "IMÓVEL ESPECIAL"), ("torre de água", ""),
)
FAMILIES = {
    "RESIDENCIAL_MULTIFAMILIAR": T.MULTI_HOME, "RESIDENCIAL_UNIFAMILIAR": (T.HOUSE,), "COMERCIAL": T.TRADE, "INDUSTRIAL": (T.WAREHOUSE,), "TERRITORIAL": T.GROUND, "ESTACIONAMENTO_RESIDENCIAL": (T.PARKING_HOME,),
    "ESTACIONAMENTO_NAO_RESIDENCIAL": (T.PARKING_OTHER,), "ESTACIONAMENTO": (T.PARKING,), "HOSPEDAGEM": (T.HOTEL,), "ESPECIAL": (T.SPECIAL,),
}


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def sql_family(c: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains({sql_list(members)}, {c}) THEN '{name}'" for name, members in FAMILIES.items()) + " ELSE '' END"


def picked(items, k):
    """The item at a number, from 0."""
    return F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))


@query(f"""WITH k AS (SELECT p_partkey, {sql_list(c for _, c in RULE_TEXTS)}[p_partkey % {len(RULE_TEXTS)} + 1] AS purpose FROM part) SELECT p_partkey, purpose, {sql_family("purpose")} AS family,
  CASE WHEN purpose IN ('TERRENO', 'GLEBA', 'CONSTRUÇÃO EM ÁREA DE GLEBA') THEN 'terreno' WHEN purpose IN ('LOJA', 'LOJA EM GALERIA', 'LOJA EM SHOPPING', 'IMÓVEL COMERCIAL') THEN 'privativa_ou_construida'
    WHEN purpose IN ('APARTAMENTO', 'COBERTURA', 'FLAT / APART-HOTEL', 'SALA COMERCIAL') OR purpose LIKE 'GARAGEM%' THEN 'privativa' ELSE 'construida' END AS area FROM k""")
def purpose_rules(spark, sf_dir):
    """Every rule of the classes of use."""
    c = T.purpose_class(picked([t for t, _ in RULE_TEXTS], F.col("p_partkey") % len(RULE_TEXTS)))
    p = table(spark, sf_dir, "part").select("p_partkey", c.alias("purpose"))
    return p.select("p_partkey", "purpose", T.family(F.col("purpose")).alias("family"), T.area_preference(F.col("purpose")).alias("area"))


CADASTRAL = (T.APARTMENT, T.PARKING_HOME, T.PARKING_OTHER, T.SHOP, "", T.HOUSE)
EXPLICIT = ("", "", T.PARKING, T.OFFICE, T.PENTHOUSE)
LISTED = ("", T.PARKING, T.APARTMENT, T.SHOP, T.LAND, T.FLAT, T.PARKING_HOME)


def sql_level(a: str, b: str) -> str:
    """The conflict of two classes: 0 where one is missing, then none, moderate, full."""
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 1 WHEN {a} LIKE 'GARAGEM%' AND {b} LIKE 'GARAGEM%' THEN CASE WHEN 'GARAGEM / VAGA' IN ({a}, {b}) THEN 1 ELSE 3 END
    WHEN {sql_family(a)} = {sql_family(b)} THEN 2 ELSE 3 END"""


SOURCES_SQL = f"""{MARKET_SQL},
so0 AS (SELECT is_sale, is_offer, {sql_list(CADASTRAL)}[CAST(registration AS BIGINT) % {len(CADASTRAL)} + 1] AS cad, {sql_list(EXPLICIT)}[listing_id % {len(EXPLICIT)} + 1] AS exp, {sql_list(LISTED)}[CAST(area AS BIGINT) % {len(LISTED)} + 1] AS lst FROM m WHERE is_sale OR is_offer),
so1 AS (SELECT *, cad IN ('GARAGEM / VAGA RESIDENCIAL', 'GARAGEM / VAGA NÃO RESIDENCIAL') AND CASE WHEN exp <> '' THEN exp ELSE lst END = 'GARAGEM / VAGA' AND (exp <> '' OR is_offer) AS refined FROM so0),
so2 AS (SELECT *, CASE WHEN refined THEN cad WHEN exp <> '' THEN exp WHEN is_offer AND lst <> '' THEN lst ELSE cad END AS final,
    CASE WHEN exp <> '' THEN CASE WHEN refined THEN 'FINALIDADE_CRAWLER_REFINADA_SIAT' ELSE 'FINALIDADE_CRAWLER' END WHEN is_offer AND lst <> '' THEN CASE WHEN refined THEN 'TIPO_CRAWLER_REFINADO_SIAT' ELSE 'TIPO_CRAWLER' END
      WHEN cad = '' THEN '' WHEN is_sale THEN 'SIAT' ELSE 'SIAT_FALLBACK' END AS source FROM so1),
so3 AS (SELECT *, greatest({sql_level("final", "cad")}, {sql_level("final", "lst")}) AS lv, {sql_level("exp", "lst")} AS versus FROM so2),
so AS (SELECT *, ['Não aplicável', 'Não', 'Moderado', 'Sim'][lv + 1] AS conflict, CASE WHEN source LIKE '%REFINAD%' THEN 'Média' WHEN source = 'SIAT' THEN 'Alta' WHEN source = 'TIPO_CRAWLER' THEN CASE WHEN lv <= 1 THEN 'Alta' ELSE 'Média' END
    WHEN source = 'FINALIDADE_CRAWLER' THEN CASE versus WHEN 3 THEN 'Baixa' WHEN 1 THEN 'Alta' ELSE 'Média' END ELSE 'Baixa' END AS confidence FROM so3)"""


def _sourced(spark, sf_dir) -> DataFrame:
    """Sales and offers with purposes from three sources."""
    m = traded(spark, sf_dir)
    given = (picked(EXPLICIT, F.col("listing_id") % len(EXPLICIT)), picked(CADASTRAL, F.col("registration").cast("long") % len(CADASTRAL)), picked(LISTED, F.col("area").cast("long") % len(LISTED)))
    m = m.select("is_sale", "is_offer", F.when(F.col("is_sale"), T.SALE).otherwise(T.OFFER).alias("kind"), *(c.alias(name) for c, name in zip(given, ("exp", "cad", "lst"))))
    for columns in enrich.purpose_cascade(*map(F.col, ("kind", "exp", "cad", "lst"))):
        m = m.withColumns(columns)
    return m


@query(f"WITH {SOURCES_SQL} SELECT final AS purpose, source, conflict, confidence, count(*) AS n FROM so GROUP BY 1, 2, 3, 4")
def purpose_confidence(spark, sf_dir):
    """The whole cascade: parking refined by the cadastre, conflicts of all sources, confidence."""
    return _sourced(spark, sf_dir).groupBy(F.col("_purpose").alias("purpose"), F.col("_purpose_source").alias("source"), F.col("_purpose_conflict").alias("conflict"), F.col("_purpose_confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query(f"""WITH {SOURCES_SQL} SELECT final AS purpose, count(*) AS n_usable, count(*) FILTER (source = 'FINALIDADE_CRAWLER') AS n_explicit, count(*) FILTER (source = 'TIPO_CRAWLER') AS n_listed, count(*) FILTER (source = 'SIAT') AS n_cadastral,
  count(*) FILTER (source = 'SIAT_FALLBACK') AS n_fallback, count(*) FILTER (lv >= 2) AS n_conflict, count(*) FILTER (lv < 2) AS n_clean_usable FROM so GROUP BY 1""")
def source_counts(spark, sf_dir):
    """Coverage of each purpose by source and conflict."""
    return report.source_counts(_sourced(spark, sf_dir).withColumn("purpose", F.col("_purpose")), ["purpose"])


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 <> 0 THEN round(-30 - (o_orderkey % 1000) / 1000.0::DOUBLE, 6) END AS lat,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1250.5 WHEN 2 THEN 80.0 ELSE o_orderkey % 100 + 1 END::DOUBLE AS area FROM orders""")
def typed_text(spark, sf_dir):
    """Dates, coordinates and areas as sheets hold them: dates in five forms, decimal
    commas, the first positive area of the list that the information type has."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    forms = [F.date_format(day, f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy HH:mm")]
    forms.append(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
    text = reduce(lambda out, f: F.when(k % 5 == f[0], f[1]).otherwise(out), enumerate(forms), F.lit(None).cast("string"))
    lat = F.when(k % 7 == 0, "sem dado").otherwise(F.concat(F.lit(" -30,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    kind = picked([T.SALE, "  oferta ", T.OFFER, "Outra"], k % 4)
    listed = N.first_positive(N.parse_number(F.when(k % 4 == 1, "0 m²").otherwise("80 m²")), N.parse_number(F.lit("1.250,5 m²")))
    other = N.first_positive(N.parse_number(F.lit("-3")), N.number(k % 100 + 1, "bigint"))
    area = N.by_information_type(kind, listed, N.first_positive(), other)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.parse_date(text, "string").cast("date").alias("day"), F.round(N.coordinate(lat), 6).alias("lat"), area.alias("area"))


@query(f"""WITH {MARKET_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY listing_id, CASE WHEN listing_id = 0 THEN id END ORDER BY "date" DESC NULLS LAST, id DESC) AS rn FROM m WHERE is_offer)
SELECT purpose, count(*) AS n_kept, CAST(sum(listing_id * 7 + CAST(registration AS BIGINT)) AS BIGINT) AS id_sum FROM (SELECT purpose, listing_id, registration FROM o WHERE rn = 1 UNION ALL SELECT purpose, listing_id, registration FROM m WHERE is_sale) GROUP BY 1""")
def keep_latest_listing(spark, sf_dir):
    m = traded(spark, sf_dir)
    kept = dedup.keep_latest(m, T.listing_key([("listing_id", F.col("listing_id").cast("string"))]), F.col("date"), "id", F.col("is_offer"))
    return kept.groupBy("purpose").agg(F.count("*").alias("n_kept"), F.sum(F.col("listing_id") * 7 + F.col("registration").cast("long")).alias("id_sum"))


@query(f"""WITH {MARKET_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY info_type, registration, area, CASE WHEN registration = '0' THEN id END ORDER BY "date" DESC NULLS LAST, id DESC) AS rn FROM m WHERE is_sale OR is_offer)
SELECT purpose, count(*) AS n_kept, CAST(sum(listing_id * 7 + CAST(registration AS BIGINT)) AS BIGINT) AS id_sum FROM o WHERE rn = 1 GROUP BY 1""")
def keep_latest_primary(spark, sf_dir):
    m = traded(spark, sf_dir)
    kept = dedup.keep_latest(m, dedup.primary_key(F.col("info_type"), F.col("registration"), F.col("area")), F.col("date"), "id")
    return kept.groupBy("purpose").agg(F.count("*").alias("n_kept"), F.sum(F.col("listing_id") * 7 + F.col("registration").cast("long")).alias("id_sum"))


@query(f"WITH {RULED} SELECT purpose, is_sale, reasons, count(*) AS n, round(avg(unit_value), 6) AS mean_unit FROM r GROUP BY 1, 2, 3")
def rule_filter(spark, sf_dir):
    rows = prefilter.apply_rules(traded(spark, sf_dir), "purpose", F.col("is_sale"))
    return rows.groupBy("purpose", "is_sale", F.col("_reasons").alias("reasons")).agg(F.count("*").alias("n"), r6(F.avg("unit_value")).alias("mean_unit"))


ROBUST = f"""{RULED}, s AS (SELECT *, ln(unit_value) AS x FROM r WHERE reasons = '' AND is_sale), c AS (SELECT purpose, median(x) AS med, count(*) AS n_tested FROM s GROUP BY 1),
d AS (SELECT s.purpose, median(abs(x - med)) AS mad FROM s JOIN c USING (purpose) GROUP BY 1), z AS (SELECT s.*, n_tested, 0.6745 * (x - med) / mad AS score FROM s JOIN c USING (purpose) JOIN d USING (purpose))"""


@query(f"""WITH {ROBUST} SELECT purpose, max(n_tested) AS n_tested, count(*) FILTER (WHERE abs(score) > 3.5) AS n_excluded, count(*) FILTER (WHERE abs(score) > 2.5 AND abs(score) <= 3.5) AS n_flagged, round(min(score), 6) AS low, round(max(score), 6) AS high FROM z GROUP BY 1""")
def robust_prefilter(spark, sf_dir):
    rows = prefilter.robust_filter(prefilter.apply_rules(traded(spark, sf_dir), "purpose", F.col("is_sale")), ["purpose"], F.col("is_sale"))
    return rows.groupBy("purpose").agg(F.max("n_tested").alias("n_tested"), F.count_if(F.col("_stage") == prefilter.STAGE_ROBUST).alias("n_excluded"), F.count_if("_flagged").alias("n_flagged"), r6(F.min("_score")).alias("low"), r6(F.max("_score")).alias("high"))


@query(f"""WITH {ROBUST}, h AS (SELECT 'regra determinística' AS stage, reasons AS reason, count(*) AS n FROM r WHERE reasons <> '' GROUP BY 2
UNION ALL SELECT 'filtro robusto automático', 'valor unitário extremo na amostra de transações', count(*) FROM z WHERE abs(score) > 3.5
UNION ALL SELECT 'alerta robusto', 'valor unitário atípico na amostra de transações', count(*) FROM z WHERE abs(score) > 2.5 AND abs(score) <= 3.5) SELECT * FROM h WHERE n > 0""")
def exclusion_histogram(spark, sf_dir):
    rows = prefilter.robust_filter(prefilter.apply_rules(traded(spark, sf_dir), "purpose", F.col("is_sale")), ["purpose"], F.col("is_sale"))
    return prefilter.exclusion_histogram(rows).select(F.col("_stage").alias("stage"), "reason", F.col("rows").alias("n"))


@query(f"WITH {DISCOUNT} SELECT purpose, n_sales, n_offers, CAST(n_quantiles AS INT) AS n_quantiles, round(raw_median, 6) AS raw_median, round(raw_mean, 6) AS raw_mean, round(discount, 6) AS discount, source FROM disc")
def discount_by_purpose(spark, sf_dir):
    rows = prefilter.apply_rules(traded(spark, sf_dir), "purpose", F.col("is_sale")).where("_status = 'kept'")
    return offer_discount(rows, ["purpose"]).select("purpose", "n_sales", "n_offers", "n_quantiles", r6("raw_median").alias("raw_median"), r6("raw_mean").alias("raw_mean"), r6("discount").alias("discount"), "source")


@query(f"WITH {PRICED} SELECT purpose, is_offer, count(*) AS n, round(avg(unit), 6) AS mean_unit, round(median(unit), 6) AS median_unit FROM p GROUP BY 1, 2")
def adjusted_units(spark, sf_dir):
    rows, by = staged(priced(spark, sf_dir).select("purpose", "is_offer", "unit")), ["purpose", "is_offer"]
    middle = by_name(quantiles(rows, by, {"unit": F.col("unit")}, [0.5]), by, {"median": ("unit", 0)})
    return rows.groupBy(*by).agg(F.count("*").alias("n"), r6(F.avg("unit")).alias("mean_unit")).join(middle, by).select(*by, "n", "mean_unit", r6("median").alias("median_unit"))


@query(f"""WITH {PRICED} SELECT purpose, round(median(unit), 6) AS unit_center, round(quantile_cont(unit, 0.75) - quantile_cont(unit, 0.25), 6) AS unit_scale,
  round(median(year), 6) AS year_center, round(quantile_cont(year, 0.75) - quantile_cont(year, 0.25), 6) AS year_scale, round(median(lot_area), 6) AS lot_area_center, round(quantile_cont(lot_area, 0.75) - quantile_cont(lot_area, 0.25), 6) AS lot_area_scale FROM p GROUP BY 1""")
def center_scales(spark, sf_dir):
    out = center_scale(priced(spark, sf_dir), ["purpose"], ["unit", "year", "lot_area"])
    return out.select("purpose", *(r6(f"{c}_{s}").alias(f"{c}_{s}") for c in ("unit", "year", "lot_area") for s in ("center", "scale")))


@query(f"""WITH {PRICED}, c AS (SELECT *, sum(area) OVER (PARTITION BY purpose ORDER BY unit, id) AS cw, sum(area) OVER (PARTITION BY purpose) AS tw FROM p)
SELECT purpose, round(min(unit) FILTER (cw >= 0.25 * tw), 6) AS q25, round(min(unit) FILTER (cw >= 0.5 * tw), 6) AS q50, round(min(unit) FILTER (cw >= 0.75 * tw), 6) AS q75 FROM c GROUP BY 1""")
def weighted_quantiles(spark, sf_dir):
    out = robust.weighted_quantiles(priced(spark, sf_dir), ["purpose"], F.col("unit"), F.col("area"), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "id")
    return out.select("purpose", *(r6(c).alias(c) for c in ("q25", "q50", "q75")))


@query("""WITH w AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice AS raw FROM orders WHERE o_totalprice > 0),
a AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY raw DESC, id) - 1 AS m, sum(raw) OVER (PARTITION BY g ORDER BY raw DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail, greatest(0.3::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY g)) AS cap FROM w),
b AS (SELECT *, coalesce(min(CASE WHEN (1 - m * cap) * raw <= (cap + 1e-15) * tail THEN m END) OVER (PARTITION BY g), n) AS nc FROM a),
c AS (SELECT *, max(CASE WHEN m = nc THEN tail END) OVER (PARTITION BY g) AS rest FROM b),
d AS (SELECT *, CASE WHEN m < nc THEN cap ELSE (1 - nc * cap) * raw / rest END AS sh FROM c) SELECT g, id, round(sh / sum(sh) OVER (PARTITION BY g), 6) AS weight FROM d""")
def cap_weights(spark, sf_dir):
    """A customer's orders weighed by their totals, none above 0.3."""
    n = table(spark, sf_dir, "orders").where("o_totalprice > 0").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return capped_weights(n, ["g"], F.col("o_totalprice"), F.lit(0.3), "id").select("g", "id", r6("weight").alias("weight"))


@query(f"""WITH {MARKET_SQL} SELECT purpose, count(*) AS n_rows, count(*) FILTER (WHERE is_sale) AS n_sales, count(*) FILTER (WHERE is_offer) AS n_offers, count(*) FILTER (WHERE info_type LIKE '%aluguel%') AS n_rentals, count(*) FILTER (WHERE value > 0 AND area > 0) AS n_usable,
  count(*) FILTER (WHERE value > 0 AND area > 0 AND lot_area > 0) AS n_lot, count(*) FILTER (WHERE value > 0 AND area > 0 AND year BETWEEN 1500 AND 2026) AS n_year, count(*) FILTER (WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS n_placed, bool_or(private_area IS NOT NULL) AS has_private, count(DISTINCT "group") AS n_groups FROM m GROUP BY 1""")
def coverage_counts(spark, sf_dir):
    return report.coverage_counts(market_rows(spark, sf_dir), ["purpose"], LAST_YEAR)


@query("""WITH y AS (SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) + CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.01 WHEN 2 THEN 0.5 ELSE -600 END AS y FROM orders)
SELECT o_orderkey, abs(y - round_even(y, 0)) <= 1e-9 + 1e-5 * abs(round_even(y, 0)) AND round_even(y, 0) BETWEEN 1500 AND 2026 AS ok FROM y""")
def valid_years(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    y = F.year("o_orderdate").cast("double") + F.when(k == 0, 0.0).when(k == 1, 0.01).when(k == 2, 0.5).otherwise(-600.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.valid_year(y, LAST_YEAR).alias("ok"))


def _market_and_nations(spark, sf_dir):
    return candidates(spark, sf_dir), staged(knn.resolve_targets(nation_targets(spark, sf_dir), LAST_YEAR))


def _distances(spark, sf_dir):
    return knn.distances(*_market_and_nations(spark, sf_dir), LAST_YEAR)


@query(f"WITH {PAIRS} SELECT target_id, count(*) AS n, round(min(dist), 6) AS nearest, round(avg(dist), 6) AS mean, round(avg(sqrt(a2)), 6) AS mean_attr, round(avg(geo), 6) AS mean_km FROM ds GROUP BY 1")
def distance_profile(spark, sf_dir):
    return _distances(spark, sf_dir).groupBy("target_id").agg(F.count("*").alias("n"), r6(F.min("dist")).alias("nearest"), r6(F.avg("dist")).alias("mean"), r6(F.avg("attr")).alias("mean_attr"), r6(F.avg("geo_km")).alias("mean_km"))


@query(f"WITH {PAIRS} SELECT target_id, id, row_number() OVER (PARTITION BY target_id ORDER BY dist, id) AS rank, round(dist, 6) AS dist FROM ds QUALIFY rank <= 10")
def knn_top10(spark, sf_dir):
    return knn.nearest(*_market_and_nations(spark, sf_dir), LAST_YEAR, 10).select("target_id", "id", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


@query(f"WITH {NEAR} SELECT target_id, id, rk AS rank, round(weight, 6) AS weight, round(n_eff, 6) AS n_eff, k AS k_used FROM nb")
def knn_adaptive(spark, sf_dir):
    near = knn.adaptive(knn.nearest(*_market_and_nations(spark, sf_dir), LAST_YEAR))
    return near.select("target_id", "id", F.col("rank").cast("long").alias("rank"), r6("weight").alias("weight"), r6("n_eff").alias("n_eff"), F.col("k").cast("long").alias("k_used"))


@query(f"WITH {ESTIMATE} SELECT target_id, id, round(weight, 6) AS weight, round(ln(unit), 8) AS ln_unit, round(ln(clipped), 8) AS ln_clipped FROM cl")
def robust_means(spark, sf_dir):
    """By logarithms: sales have unit values of few decimals, at whose halves engines round apart."""
    near = knn.adaptive(knn.nearest(*_market_and_nations(spark, sf_dir), LAST_YEAR))
    return robust_mean(near, ["target_id"], "unit", "weight", F.col("mad"), "id").select("target_id", "id", r6("weight").alias("weight"), F.round(F.ln("unit"), 8).alias("ln_unit"), F.round(F.ln("clipped"), 8).alias("ln_clipped"))


@query(f"WITH {ESTIMATE} SELECT target_id, purpose, CAST(k_used AS INT) AS k_used, round(n_eff, 6) AS n_eff, n_candidates, round(unit_estimate, 4) AS unit_estimate, round(total_estimate, 2) AS total_estimate, round(adjusted_weight, 6) AS adjusted_weight, round(geo_median_km, 6) AS geo_median_km FROM es")
def estimate_batch(spark, sf_dir):
    out = knn.value_targets(candidates(spark, sf_dir), nation_targets(spark, sf_dir), LAST_YEAR, local_filter=False)
    return out.select("target_id", "purpose", "k_used", r6("n_eff").alias("n_eff"), "n_candidates", F.round("unit_estimate", 4).alias("unit_estimate"), F.round("total_estimate", 2).alias("total_estimate"), r6("adjusted_weight").alias("adjusted_weight"), r6("geo_median_km").alias("geo_median_km"))


@query(f"""WITH {ESTIMATE} SELECT cl.target_id, cl.id, info_type, cl.built_area, cl.year, round(lat, 6) AS lat, round(ln(unit_value), 8) AS ln_original, round(ln(cl.unit), 8) AS ln_adjusted, round(ln(clipped), 8) AS ln_robust,
  round(cl.geo, 6) AS distancia_geografica_km, round(weight, 6) AS peso_knn, round(weight * clipped, 4) AS contribuicao_valor_unitario, round((cl.unit - clipped) / cl.unit, 6) AS adjustment_share FROM cl JOIN p ON p.id = cl.id""")
def neighbour_report(spark, sf_dir):
    """Neighbours as reports show them, with what the robust step changed."""
    sheet = staged_wide(priced(spark, sf_dir).select("id", "purpose", "group", "info_type", "value", "unit_value", "unit", "built_area", "lot_area", "year", "lat", "lon"))
    near = knn.neighbours(sheet, staged(knn.resolve_targets(nation_targets(spark, sf_dir), LAST_YEAR)), LAST_YEAR, local_filter=False)
    out = report.neighbour_export(near, sheet, ("adjustment",))
    ln = lambda c: F.round(F.ln(c), 8)
    return out.select(
        "target_id", "id", "info_type", "built_area", "year", r6("lat").alias("lat"), ln("valor_unitario_original").alias("ln_original"), ln("valor_unitario_ajustado").alias("ln_adjusted"), ln("valor_unitario_robusto").alias("ln_robust"),
        r6("distancia_geografica_km").alias("distancia_geografica_km"), r6("peso_knn").alias("peso_knn"), F.round("contribuicao_valor_unitario", 4).alias("contribuicao_valor_unitario"), r6(F.col("adjustment") / F.col("valor_unitario_ajustado")).alias("adjustment_share"),
    )


@query(f"""WITH {filtered(ESTIMATE, CUTS)} SELECT t.target_id, tp AS purpose, CASE WHEN es.k_used IS NULL THEN 'fewer than 2 candidates' ELSE 'ok' END AS status, CAST(es.k_used AS INT) AS k_used, n_candidates, round(unit_estimate, 4) AS unit_estimate, round(total_estimate, 2) AS total_estimate, round(n_eff, 6) AS n_eff FROM t LEFT JOIN es ON es.target_id = t.target_id""")
def valuation(spark, sf_dir):
    """The flagship: every target valued, with the local filter."""
    out = knn.value_targets(candidates(spark, sf_dir), nation_targets(spark, sf_dir), LAST_YEAR)
    return out.select("target_id", "purpose", "status", "k_used", "n_candidates", F.round("unit_estimate", 4).alias("unit_estimate"), F.round("total_estimate", 2).alias("total_estimate"), r6("n_eff").alias("n_eff"))


@query(f"WITH {CUTS} SELECT target_id, mode, n_reference, round(median, 4) AS median, round(bound, 4) AS bound, source, round(gap_ratio, 6) AS gap_ratio, cancelled FROM cut")
def local_cutoffs(spark, sf_dir):
    c = knn.local_cutoffs(*_market_and_nations(spark, sf_dir), LAST_YEAR)
    return c.select("target_id", "mode", "n_reference", F.round("median", 4).alias("median"), F.round("bound", 4).alias("bound"), "source", r6("gap_ratio").alias("gap_ratio"), "cancelled")


@query(f"""WITH {CUTS} SELECT cut.target_id, id, 'filtro local adaptativo de cauda inferior' AS stage, round(unit / bound, 6) AS share_of_bound, round(median, 4) AS median, round(bound, 4) AS bound, source, round(gap_ratio, 6) AS gap_ratio
FROM cut JOIN ds ON ds.target_id = cut.target_id AND cancelled IS NULL AND unit < bound""")
def local_exclusions(spark, sf_dir):
    """The audit of the local filter."""
    market, targets = _market_and_nations(spark, sf_dir)
    out = knn.local_exclusions(knn.pairs(market, targets, LAST_YEAR), knn.local_cutoffs(market, targets, LAST_YEAR))
    return out.select("target_id", "id", "stage", r6(F.col("unit") / F.col("bound")).alias("share_of_bound"), F.round("median", 4).alias("median"), F.round("bound", 4).alias("bound"), "source", r6("gap_ratio").alias("gap_ratio"))


@query(f"""WITH {ESTIMATE}, cv AS (SELECT target_id, 'built_area' AS feature, any_value(tb) AS t, min(built_area) AS lo, max(built_area) AS hi, min(abs(built_area - tb)) AS gap FROM ds GROUP BY 1 UNION ALL SELECT target_id, 'year', any_value(ty), min(year), max(year), min(abs(year - ty)) FROM ds WHERE ty IS NOT NULL GROUP BY 1),
pt AS (SELECT target_id, sum(CASE WHEN t < lo OR t > hi THEN 3 WHEN feature = 'year' AND gap > 30 THEN 3 WHEN feature = 'year' AND gap > 20 THEN 2 WHEN feature = 'year' AND gap > 10 THEN 1 WHEN gap / t > 0.5 THEN 3 WHEN gap / t > 0.3 THEN 2 WHEN gap / t > 0.15 THEN 1 ELSE 0 END) AS p FROM cv GROUP BY 1),
q AS (SELECT target_id, CAST(p + CASE WHEN geo_median_km > 10 THEN 2 WHEN geo_median_km > 5 THEN 1 ELSE 0 END + CASE WHEN n_eff < goal - 1e-9 THEN 2 ELSE 0 END + CASE WHEN adjusted_weight > 0.30 THEN 1 ELSE 0 END AS INT) AS risk_points FROM es JOIN pt USING (target_id))
SELECT target_id, risk_points, CASE WHEN risk_points >= 5 THEN 'alto' WHEN risk_points >= 2 THEN 'moderado' ELSE 'baixo' END AS risk_level, CAST(greatest(20, least(100, 100 - 12 * risk_points)) AS INT) AS confidence FROM q""")
def risk_score(spark, sf_dir):
    market, targets = _market_and_nations(spark, sf_dir)
    near = knn.neighbours(market, targets, LAST_YEAR, local_filter=False)
    return knn.risk(knn.coverage(knn.pairs(market, targets, LAST_YEAR)), knn.estimates(near)).drop("reasons")


@query(f"""WITH {DISCOUNT} SELECT purpose, CASE source WHEN 'offers_only_fallback' THEN '10% convencional — somente ofertas' WHEN 'no_offers' THEN 'sem ofertas' WHEN 'insufficient_mixed_sample' THEN 'amostra mista insuficiente' ELSE
  CASE WHEN raw_median > 0.20 THEN 'razão empírica acima de 20%' WHEN discount > 0.15 THEN 'acima de 15% até 20%' WHEN discount > 0.10 THEN 'acima de 10% até 15%' WHEN discount > 0 THEN 'até 10%' ELSE '0% empírico' END END AS band,
  CASE WHEN n_sales = 0 AND n_offers > 0 THEN 'offers_only' WHEN n_offers = 0 THEN 'no_offers' WHEN least(n_sales, n_offers) < 2 THEN 'critical' WHEN least(n_sales, n_offers) < 10 THEN 'low' WHEN least(n_sales, n_offers) < 15 THEN 'limited'
  WHEN greatest(n_sales, n_offers) / least(n_sales, n_offers) > 5 THEN 'very_unbalanced' WHEN greatest(n_sales, n_offers) / least(n_sales, n_offers) > 3 THEN 'unbalanced' ELSE 'ok' END AS composition FROM disc""")
def alert_bands(spark, sf_dir):
    d = offer_discount(prefilter.apply_rules(traded(spark, sf_dir), "purpose", F.col("is_sale")).where("_status = 'kept'"), ["purpose"])
    return d.select("purpose", report.discount_alert(F.col("source"), F.col("raw_median"), F.col("discount")).alias("band"), report.composition_alert(F.col("n_sales"), F.col("n_offers")).alias("composition"))


@query("""WITH p AS (SELECT o_orderstatus AS status, o_totalprice AS actual, s AS predicted FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > 0),
m AS (SELECT status, median(predicted / actual) AS mr, avg(actual) AS ma FROM p GROUP BY 1)
SELECT status, count(*) AS n_tested, round(avg(abs(predicted - actual)), 2) AS mae, round(sqrt(avg(pow(predicted - actual, 2))), 2) AS rmse, round(median(abs(predicted - actual) / actual), 6) AS mdape, round(quantile_cont(abs(predicted - actual) / actual, 0.9), 6) AS p90_ape,
  round(1 - sum(pow(predicted - actual, 2)) / sum(pow(actual - ma, 2)), 6) AS r2, round(avg(abs(predicted / actual - mr)) / max(mr) * 100, 4) AS cod, round(avg(predicted / actual) / (sum(predicted) / sum(actual)), 6) AS prd, round(max(mr), 6) AS median_ratio FROM p JOIN m USING (status) GROUP BY 1""")
def ratio_metrics(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("predicted"))
    p = table(spark, sf_dir, "orders").where("o_totalprice > 0").join(s, "o_orderkey").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("actual"), "predicted")
    p = p.withColumns({"ratio": F.col("predicted") / F.col("actual"), "ape": F.abs(F.col("predicted") - F.col("actual")) / F.col("actual")})
    out = B.metrics(p, ["status"])
    return out.select("status", "n_tested", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), r6("mdape").alias("mdape"), r6("p90_ape").alias("p90_ape"), r6("r2").alias("r2"), F.round("cod", 4).alias("cod"), r6("prd").alias("prd"), r6("median_ratio").alias("median_ratio"))


#: Targets that leave out themselves and their group, in the place of the nations.
SAMPLE = """tn AS (SELECT id AS target_id, purpose AS tp, built_area AS tb, year AS ty, lat AS tlat, lon AS tlon, CASE WHEN lot_area > 0 THEN lot_area END AS tl, id AS xid, "group" AS xg, unit AS actual FROM p
  WHERE is_sale AND unit > 0 AND built_area > 0 AND year BETWEEN 1500 AND 2026 QUALIFY row_number() OVER (PARTITION BY purpose ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) <= 150)"""
BACKTEST = f"""{filtered(ESTIMATE, CUTS).replace(NATIONS, SAMPLE)},
bp AS (SELECT t.tp AS purpose, actual, unit_estimate AS predicted FROM t LEFT JOIN es ON es.target_id = t.target_id),
bm AS (SELECT purpose, median(predicted / actual) AS mr FROM bp GROUP BY 1)"""


@query(f"""WITH {BACKTEST} SELECT purpose, count(predicted) AS n_tested, count(*) FILTER (predicted IS NULL) AS n_failed, round(median(abs(predicted - actual) / actual), 6) AS mdape, round(avg(abs(predicted - actual) / actual), 6) AS mape,
  round(median(abs(predicted - actual)), 3) AS medae, round(median((predicted - actual) / actual), 6) AS median_bias, round(max(mr), 6) AS median_ratio, round(avg(abs(predicted / actual - mr)) / max(mr) * 100, 4) AS cod FROM bp JOIN bm USING (purpose) GROUP BY 1""")
def backtest_metrics(spark, sf_dir):
    """Leave-one/group-out backtest of 150 sales of each purpose (a sampling operator)."""
    market = candidates(spark, sf_dir)
    targets = staged(B.as_targets(B.sample(B.eligible(market, LAST_YEAR), 150, by=["purpose"])))
    out = B.metrics(B.backtest(market, targets, LAST_YEAR), ["purpose"])
    return out.select("purpose", "n_tested", "n_failed", r6("mdape").alias("mdape"), r6("mape").alias("mape"), F.round("medae", 3).alias("medae"), r6("median_bias").alias("median_bias"), r6("median_ratio").alias("median_ratio"), F.round("cod", 4).alias("cod"))


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 6 THEN 'Rua Nova' ELSE 'Rua ' || c_mktsegment END AS street, CASE WHEN c_custkey % 7 <> 2 THEN CAST(c_custkey % 900 + CASE WHEN c_custkey % 7 = 3 THEN 1000001 ELSE 1 END AS INT) END AS number FROM customer""")
def address_parse(spark, sf_dir):
    n = (F.col("c_custkey") % 900 + F.when(F.col("c_custkey") % 7 == 3, 1_000_001).otherwise(1)).cast("string")
    base = F.concat(F.lit("Rua "), F.col("c_mktsegment"))
    forms = (("", ", ", ", Porto Alegre"), ("  ", " ", ""), ("", ", Porto Alegre", None), ("", ", nº ", " apto 3"), ("", "  numero ", " - Centro"), ("", " - nro ", ", Centro"), ("Rua\tNova -", ", N. ", ""))
    texts = [F.concat(F.lit(a) if k == 6 else F.concat(F.lit(a), base), F.lit(b), *([] if c is None else [n, F.lit(c)])) for k, (a, b, c) in enumerate(forms)]
    street, number = T.street_and_number(F.element_at(F.array(*texts), (F.col("c_custkey") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", street.alias("street"), number.alias("number"))


def _streets(spark, sf_dir):
    """A street for each market segment, cut into segments of 100 numbers a supplier nation."""
    names = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("n")).agg(F.min("c_custkey").alias("cdlog"))
    streets = names.select("cdlog", F.concat(F.lit("RUA "), F.upper("n")).alias("name"))
    k = F.col("n_nationkey")
    at = lambda j: F.struct((F.col("cdlog") + k * 10.0 + j * 5.0).alias("x"), (k * 1.0 + j * j * 2.0).alias("y"))
    segments = names.join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey")), F.lit(True)).select(
        "cdlog", k.alias("ordinal"), (k * 100).cast("double").alias("even_from"), (k * 100 + 98).cast("double").alias("even_to"), (k * 100 + 99).cast("double").alias("odd_from"), (k * 100 + 1).cast("double").alias("odd_to"),
        F.array(at(0), at(1), at(2)).alias("points"), F.array(F.lit(0)).alias("parts"),
    )
    return streets, segments


@query("""WITH s AS (SELECT c_mktsegment AS n, min(c_custkey) AS cdlog FROM customer GROUP BY 1), a AS (SELECT c_custkey, cdlog, c_custkey % 2600 AS num FROM customer JOIN s ON n = c_mktsegment),
g AS (SELECT c_custkey, cdlog, num, num // 100 AS k FROM a WHERE num < 2500),
f AS (SELECT *, CASE WHEN num % 2 = 0 THEN (num - k * 100) / 98.0::DOUBLE ELSE (num - (k * 100 + 99)) / -98.0::DOUBLE END AS f FROM g),
d AS (SELECT *, sqrt(29.0::DOUBLE) AS d1, sqrt(61.0::DOUBLE) AS d2 FROM f), w AS (SELECT *, f * (d1 + d2) AS want FROM d)
SELECT c_custkey, CAST(k AS BIGINT) AS ordinal, round(f, 6) AS fraction, round(cdlog + k * 10 + CASE WHEN want <= d1 + 1e-12 THEN 5 * want / d1 ELSE 5 + 5 * (want - d1) / d2 END, 6) AS x, round(k + CASE WHEN want <= d1 + 1e-12 THEN 2 * want / d1 ELSE 2 + 6 * (want - d1) / d2 END, 6) AS y FROM w""")
def street_range(spark, sf_dir):
    streets, segments = _streets(spark, sf_dir)
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.concat(F.lit("Rua "), F.initcap("c_mktsegment")).alias("street"), (F.col("c_custkey") % 2600).cast("int").alias("number"))
    found = geocode.match_segments(geocode.match_streets(a, streets).select("query", "number", "cdlog"), segments)
    p = geocode.interpolate(F.col("points"), F.col("parts"), F.col("fraction"))
    found = found.select(F.col("query").alias("c_custkey"), F.col("ordinal").cast("long").alias("ordinal"), "fraction", p.alias("p"))
    return found.select("c_custkey", "ordinal", r6("fraction").alias("fraction"), r6("p.x").alias("x"), r6("p.y").alias("y"))


FOUND = """s AS (SELECT c_mktsegment AS n, min(c_custkey) AS cdlog FROM customer GROUP BY 1),
qy AS (SELECT DISTINCT 'Rua ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END || ', ' || (c_custkey % 2600) AS query, c_custkey % 2600 AS num, c_mktsegment AS n, lower('Rua ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END) AS street FROM customer),
qm AS (SELECT query, num, cdlog, lower('Rua ' || n) AS matched, 200.0::DOUBLE * length('Rua ' || n) / (length(street) + length('Rua ' || n)) AS score FROM qy JOIN s USING (n)),
qf AS (SELECT *, num // 100 AS k, CASE WHEN num >= 2500 THEN NULL WHEN num % 2 = 0 THEN (num - num // 100 * 100) / 98.0::DOUBLE ELSE (num - (num // 100 * 100 + 99)) / -98.0::DOUBLE END * (sqrt(29.0::DOUBLE) + sqrt(61.0::DOUBLE)) AS want FROM qm),
geo AS (SELECT query, k + CASE WHEN want <= sqrt(29.0::DOUBLE) + 1e-12 THEN 2 * want / sqrt(29.0::DOUBLE) ELSE 2 + 6 * (want - sqrt(29.0::DOUBLE)) / sqrt(61.0::DOUBLE) END AS lat, cdlog + k * 10 + CASE WHEN want <= sqrt(29.0::DOUBLE) + 1e-12 THEN 5 * want / sqrt(29.0::DOUBLE) ELSE 5 + 5 * (want - sqrt(29.0::DOUBLE)) / sqrt(61.0::DOUBLE) END AS lon, matched, score FROM qf)"""


def _axis_queries(spark, sf_dir):
    text = F.concat(F.lit("Rua "), F.initcap("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(""), F.lit(", "), (F.col("c_custkey") % 2600).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("query"))


@query(f"""WITH {FOUND} SELECT query, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN lat IS NOT NULL THEN 'street axis' END AS method, matched, round(score, 6) AS score, CASE WHEN lat IS NULL THEN 'no segment holds the number' END AS failure FROM geo""")
def geocode_addresses(spark, sf_dir):
    """Addresses with a letter too many in their street, matched by likeness."""
    streets, segments = _streets(spark, sf_dir)
    return geocode.geocode(_axis_queries(spark, sf_dir), streets, segments).select("query", r6("lat").alias("lat"), r6("lon").alias("lon"), "method", "matched", r6("score").alias("score"), "failure")


@query(f"""WITH {FOUND}, u AS (SELECT c_custkey, 'Rua ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END || ', ' || (c_custkey % 2600) AS query, CASE WHEN c_custkey % 5 = 0 THEN -30.0::DOUBLE WHEN c_custkey % 5 = 1 THEN 95.0::DOUBLE END AS own FROM customer)
SELECT c_custkey, round(CASE WHEN own = -30 THEN own ELSE geo.lat END, 6) AS lat, round(CASE WHEN own = -30 THEN -51.0::DOUBLE ELSE geo.lon END, 6) AS lon, CASE WHEN own = -30 THEN 'coordenadas da planilha' WHEN geo.lat IS NOT NULL THEN 'street axis' END AS method FROM u LEFT JOIN geo USING (query)""")
def attach_coordinates(spark, sf_dir):
    """Addresses built from components, coordinates by query; valid ones of the sheet come first."""
    k = F.col("c_custkey")
    sheet = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Rua "), F.initcap("c_mktsegment"), F.when(k % 2 == 0, "x").otherwise("")).alias("street"), (k % 2600).cast("double").cast("string").alias("number"), F.when(k % 5 == 0, -30.0).when(k % 5 == 1, 95.0).alias("lat"), F.lit(-51.0).alias("lon"))
    sheet = sheet.withColumn("query", geocode.address_queries(sheet, {"street": "street", "number": "number"}))
    streets, segments = _streets(spark, sf_dir)
    out = geocode.attach(sheet, F.col("query"), staged(geocode.geocode(sheet, streets, segments)), "lat", "lon")
    return out.select("c_custkey", r6("_geo_lat").alias("lat"), r6("_geo_lon").alias("lon"), F.col("_geo_method").alias("method"))


@query("""WITH u AS (SELECT min(c_custkey) AS first_at, 'Rua ' || c_mktsegment || ', ' || (c_custkey % 90) AS query FROM customer GROUP BY 2) SELECT query FROM u ORDER BY first_at, query LIMIT 100""")
def limited_queries(spark, sf_dir):
    """The first 100 distinct address queries of the table, for a service that limits them."""
    return geocode.first_queries(table(spark, sf_dir, "customer"), F.concat(F.lit(" Rua "), "c_mktsegment", F.lit(", "), (F.col("c_custkey") % 90).cast("string")), "c_custkey", 100)


@query("""WITH r AS (SELECT o_orderkey AS ordinal, o_custkey AS cdlog, 'RUA ' || upper(o_orderpriority) AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'R ' || (o_custkey % 50) END AS b FROM orders),
e AS (SELECT ordinal, 0 AS f, cdlog, a AS name FROM r UNION ALL SELECT ordinal, 1, cdlog, b FROM r WHERE b IS NOT NULL) SELECT name, max_by(cdlog, ordinal * 2 + f) AS cdlog FROM e GROUP BY 1""")
def street_names(spark, sf_dir):
    """A street axis' names, the last record of a name has it."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("cdlog"), F.concat(F.lit(" Rua  "), F.lower("o_orderpriority")).alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("r "), (F.col("o_custkey") % 50).cast("string"))).otherwise(" ").alias("short_name"))
    return geocode.street_index(r).select("name", "cdlog")


#: A sheet of one purpose with sources that conflict, repeated records, and transfers that aren't sales.
SHEET_SQL = f"""{MARKET_SQL},
sh AS (SELECT *, CASE listing_id % 9 WHEN 0 THEN 'doação' ELSE 'compra e venda' END AS nature, listing_id % 11 = 0 AS part, listing_id % 13 = 0 AS several, listing_id % 10 = 0 AS conflict FROM m WHERE purpose = 'LOJA' AND (is_sale OR is_offer)),
k1 AS (SELECT *, row_number() OVER (PARTITION BY info_type, registration, format('{{:.2f}}', value), CASE WHEN registration = '0' OR NOT value > 0 THEN id END ORDER BY "date" DESC, id DESC) AS r1 FROM sh WHERE NOT conflict),
k2 AS (SELECT *, row_number() OVER (PARTITION BY is_offer, CASE WHEN is_offer AND listing_id <> 0 THEN CAST(listing_id AS VARCHAR) ELSE 'row ' || id END ORDER BY "date" DESC, id DESC) AS r2 FROM k1 WHERE r1 = 1),
u0 AS (SELECT *, value / nullif(built_area, 0) AS uv FROM k2 WHERE r2 = 1),
u1 AS (SELECT *, concat_ws('; ', CASE WHEN NOT coalesce(value > 0, false) THEN 'valor ausente ou não positivo' END, CASE WHEN value > 0 AND value <= 1 THEN 'valor simbólico' END, CASE WHEN NOT coalesce(built_area > 0, false) THEN 'área de referência ausente ou não positiva' END,
    CASE WHEN NOT coalesce(uv > 0, false) THEN 'valor unitário inválido' END, CASE WHEN uv > 0 AND uv < 700 THEN 'valor unitário abaixo do piso da finalidade' END, CASE WHEN is_sale AND nature = 'doação' THEN 'natureza não mercadológica' END,
    CASE WHEN is_sale AND part THEN 'transmissão parcial' END, CASE WHEN is_sale AND several THEN 'transmissão de vários imóveis' END) AS reasons FROM u0),
c1 AS (SELECT median(ln(uv)) AS med, count(*) AS n FROM u1 WHERE reasons = '' AND is_sale), c2 AS (SELECT median(abs(ln(uv) - med)) AS mad FROM u1, c1 WHERE reasons = '' AND is_sale),
u2 AS (SELECT u1.*, CASE WHEN reasons = '' AND is_sale AND n >= 8 THEN abs(0.6745 * (ln(uv) - med) / mad) END AS z, n FROM u1, c1, c2),
done AS (SELECT id, listing_id, registration, CASE WHEN reasons <> '' OR (z > 3.5 AND n >= 15) THEN 'excluded' ELSE 'kept' END AS status, CASE WHEN reasons <> '' THEN 'regra determinística' WHEN z > 3.5 AND n >= 15 THEN 'filtro robusto automático' WHEN z > 2.5 THEN 'alerta robusto' END AS stage,
    CASE WHEN z > 3.5 AND n >= 15 THEN 'valor unitário extremo na amostra de transações' ELSE reasons END AS reasons, coalesce((z > 3.5 AND n < 15) OR (z > 2.5 AND z <= 3.5), false) AS flagged FROM u2
  UNION ALL SELECT id, listing_id, registration, 'excluded', 'política de conflito tipológico', 'fontes divergem sobre a finalidade', false FROM sh WHERE conflict)"""


def _sheet(m: DataFrame, conflict, *more) -> DataFrame:
    """The market as a sheet with its own headers."""
    sheet = m.select(
        F.col("id").alias("_row_id"), F.col("listing_id").alias("_order"), "info_type", F.col("purpose").alias("finalidade"), F.col("value").alias("valor"), F.col("built_area").alias("area"), F.col("date").alias("data_registro"), F.col("registration").alias("siat_inscricao"),
        F.when(F.col("is_offer"), F.col("listing_id")).alias("id_anuncio"), F.when(F.col("listing_id") % 9 == 0, " Doação ").otherwise("Compra e venda").alias("Natureza da transação"), F.when(F.col("listing_id") % 11 == 0, "1/2").otherwise("100%").alias("fracao_transmitida"),
        F.when(F.col("listing_id") % 13 == 0, 2).otherwise(1).alias("quantidade_imoveis"), F.when(conflict, "Sim").otherwise("Não").alias("_purpose_conflict"), *more,
    )
    return sheet.withColumn("info_type", F.when(F.col("info_type") == "guia itbi", T.SALE).when(F.col("info_type") == "oferta", " oferta ").otherwise(T.RENTAL))


@query(f"WITH {SHEET_SQL} SELECT status, stage, reasons, flagged, count(*) AS n, CAST(sum(listing_id * 7 + CAST(registration AS BIGINT)) AS BIGINT) AS id_sum FROM done GROUP BY 1, 2, 3, 4")
def prepared_market(spark, sf_dir):
    """The whole preparation of one purpose: conflict policy, duplicates, eight rules, robust filter."""
    sheet = _sheet(market_rows(spark, sf_dir), F.col("listing_id") % 10 == 0)
    done = prepare(sheet, ColumnMapping(info_type="info_type", purpose="finalidade", value="valor", built_area="area"), "Loja", minimum=1)
    return done.rows.groupBy(F.col("_status").alias("status"), F.col("_stage").alias("stage"), F.col("_reasons").alias("reasons"), F.col("_flagged").alias("flagged")).agg(F.count("*").alias("n"), F.sum(F.col("_order") * 7 + F.col("siat_inscricao").cast("long")).alias("id_sum"))


#: The sheet with every purpose: offices hardly have private areas, and nearly all flats conflict.
SHEETS_SQL = f"""{MARKET_SQL},
sh AS (SELECT id, info_type, is_sale, is_offer, purpose, value, "date", registration, listing_id, built_area AS total, CASE WHEN listing_id % 4 <> 0 AND (purpose <> 'SALA COMERCIAL' OR listing_id % 5000 = 0) THEN built_area * 0.8::DOUBLE END AS private, CASE WHEN listing_id % 3 <> 0 THEN lot_area / 50 END AS lot,
    listing_id % 9 = 0 AS gift, listing_id % 11 = 0 AS part, listing_id % 13 = 0 AS several, CASE WHEN purpose = 'APARTAMENTO' THEN listing_id % 3000 <> 0 WHEN purpose = 'LOJA' THEN listing_id % 10 = 0 ELSE false END AS conflict,
    CASE purpose WHEN 'CASA / RESIDÊNCIA' THEN 'construida' WHEN 'LOJA' THEN 'privativa_ou_construida' WHEN 'TERRENO' THEN 'terreno' ELSE 'privativa' END AS pref, CASE purpose WHEN 'CASA / RESIDÊNCIA' THEN 5 WHEN 'SALA COMERCIAL' THEN 9 WHEN 'GARAGEM / VAGA' THEN 7 ELSE 12 END AS min_k,
    CAST({FLOOR_SQL} AS DOUBLE) AS flr FROM m WHERE is_sale OR is_offer),
v AS (SELECT *, 'full' AS ch FROM sh UNION ALL SELECT *, 'clean' FROM sh WHERE NOT conflict),
k1 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY purpose, ch, info_type, registration, format('{{:.2f}}', value), CASE WHEN registration = '0' OR NOT value > 0 THEN id END ORDER BY "date" DESC, id DESC) = 1),
k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY purpose, ch, is_offer, CASE WHEN is_offer AND listing_id <> 0 THEN CAST(listing_id AS VARCHAR) ELSE 'row ' || id END ORDER BY "date" DESC, id DESC) = 1),
g AS (SELECT k2.*, rg, CASE rg WHEN 'lot' THEN lot WHEN 'total' THEN total ELSE private END AS area, CASE WHEN CASE rg WHEN 'lot' THEN pref = 'terreno' WHEN 'total' THEN pref <> 'privativa' ELSE pref <> 'construida' END THEN flr ELSE 0 END AS fl
  FROM k2 JOIN (VALUES ('private'), ('total'), ('lot')) AS x(rg) ON (rg = 'lot') = (pref = 'terreno')),
u0 AS (SELECT *, CASE WHEN area > 0 THEN value / area END AS uv FROM g),
u1 AS (SELECT *, concat_ws('; ', CASE WHEN NOT coalesce(value > 0, false) THEN 'valor ausente ou não positivo' END, CASE WHEN value > 0 AND value <= 1 THEN 'valor simbólico' END, CASE WHEN NOT coalesce(area > 0, false) THEN 'área de referência ausente ou não positiva' END,
    CASE WHEN NOT coalesce(uv > 0, false) THEN 'valor unitário inválido' END, CASE WHEN uv > 0 AND uv < fl THEN 'valor unitário abaixo do piso da finalidade' END, CASE WHEN is_sale AND gift THEN 'natureza não mercadológica' END,
    CASE WHEN is_sale AND part THEN 'transmissão parcial' END, CASE WHEN is_sale AND several THEN 'transmissão de vários imóveis' END) AS reasons FROM u0),
c1 AS (SELECT purpose, ch, rg, median(ln(uv)) AS med, count(*) AS n FROM u1 WHERE reasons = '' AND is_sale GROUP BY ALL),
c2 AS (SELECT purpose, ch, rg, median(abs(ln(uv) - med)) AS mad FROM u1 JOIN c1 USING (purpose, ch, rg) WHERE reasons = '' AND is_sale GROUP BY ALL),
u2 AS (SELECT u1.*, CASE WHEN reasons = '' AND is_sale AND n >= 8 THEN abs(0.6745 * (ln(uv) - med) / mad) END AS z, n FROM u1 LEFT JOIN c1 USING (purpose, ch, rg) LEFT JOIN c2 USING (purpose, ch, rg)),
u3 AS (SELECT *, reasons = '' AND NOT coalesce(z > 3.5 AND n >= 15, false) AS kept FROM u2),
land AS (SELECT purpose, any_value(pref) AS pref, any_value(min_k) AS min_k, purpose = 'CASA / RESIDÊNCIA' AND count(*) FILTER (lot > 0) >= any_value(min_k) AS use_land, count(*) FILTER (conflict) AS n_conflict FROM sh GROUP BY 1),
cn AS (SELECT l.*, rg, count(*) FILTER (ch = 'clean' AND kept) >= any_value(l.min_k) AS clean, count(*) FILTER (ch = 'clean' AND kept AND (NOT use_land OR lot > 0)) AS uc, count(*) FILTER (ch = 'full' AND kept AND (NOT use_land OR lot > 0)) AS uf FROM land l JOIN u3 ON u3.purpose = l.purpose GROUP BY ALL),
cu AS (SELECT *, CASE WHEN clean THEN uc ELSE uf END AS usable, CASE WHEN pref = 'terreno' THEN 'lot' WHEN pref = 'construida' THEN 'total' ELSE 'private' END AS want FROM cn),
pick AS (SELECT *, CASE WHEN rg = 'lot' THEN 'territorial' WHEN rg = want THEN 'preferred' ELSE 'alternative' END AS why FROM cu WHERE usable >= CASE WHEN rg = 'lot' THEN 2 ELSE min_k END QUALIFY row_number() OVER (PARTITION BY purpose ORDER BY rg = want DESC) = 1),
pol AS (SELECT *, CASE WHEN n_conflict = 0 THEN 'none' WHEN clean THEN 'excluded' ELSE 'included' END AS policy FROM pick),
done AS (SELECT p.purpose, p.rg AS regime, why, policy, CASE WHEN kept THEN 'kept' ELSE 'excluded' END AS status, CASE WHEN reasons <> '' THEN 'regra determinística' WHEN z > 3.5 AND n >= 15 THEN 'filtro robusto automático' WHEN z > 2.5 THEN 'alerta robusto' END AS stage,
    CASE WHEN z > 3.5 AND n >= 15 THEN 'valor unitário extremo na amostra de transações' ELSE reasons END AS reasons, coalesce((z > 3.5 AND n < 15) OR (z > 2.5 AND z <= 3.5), false) OR (conflict AND kept) AS flagged, listing_id, registration, uv
    FROM u3 JOIN pol p ON p.purpose = u3.purpose AND p.rg = u3.rg AND u3.ch = CASE WHEN p.clean THEN 'clean' ELSE 'full' END
  UNION ALL SELECT p.purpose, p.rg, why, policy, 'excluded', 'política de conflito tipológico', 'fontes divergem sobre a finalidade', false, listing_id, registration, value / nullif(CASE p.rg WHEN 'total' THEN total ELSE private END, 0) FROM sh JOIN pol p ON p.purpose = sh.purpose WHERE conflict AND policy = 'excluded'
  UNION ALL SELECT purpose, NULL, 'insufficient', CASE WHEN count(*) FILTER (conflict) OVER (PARTITION BY purpose) = 0 THEN 'none' END, 'excluded', 'regime de área', 'nenhum regime de área com dados suficientes', false, listing_id, registration, NULL FROM k2 WHERE ch = 'full' AND purpose NOT IN (SELECT purpose FROM pol))"""


@query(f"WITH {SHEETS_SQL} SELECT purpose, regime, why, policy, status, stage, reasons, flagged, count(*) AS n, CAST(sum(listing_id * 7 + CAST(registration AS BIGINT)) AS BIGINT) AS id_sum, round(avg(uv), 4) AS mean_unit FROM done GROUP BY ALL")
def prepared_purposes(spark, sf_dir):
    """The preparation of all purposes in one plan: regime of area and conflict policy of each."""
    purpose, k = F.col("purpose"), F.col("listing_id")
    conflict = F.when(purpose == T.APARTMENT, k % 3000 != 0).when(purpose == T.SHOP, k % 10 == 0).otherwise(False)
    private = F.when((k % 4 != 0) & ((purpose != T.OFFICE) | (k % 5000 == 0)), F.col("built_area") * 0.8)
    sheet = _sheet(market_rows(spark, sf_dir), conflict, private.alias("privativa"), F.when(k % 3 != 0, F.col("lot_area") / 50).alias("lote"))
    done = prepare_all(sheet, ColumnMapping(info_type="info_type", purpose="finalidade", value="valor", built_area="area", private_area="privativa", lot_area="lote"))
    rows = done.rows.drop("regime").join(done.choices.select("_p", "regime", "why", F.col("conflict_policy").alias("policy")), "_p")
    by = ("purpose", "regime", "why", "policy", F.col("_status").alias("status"), F.col("_stage").alias("stage"), F.col("_reasons").alias("reasons"), F.col("_flagged").alias("flagged"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_order") * 7 + F.col("siat_inscricao").cast("long")).alias("id_sum"), F.round(F.avg("unit_value"), 4).alias("mean_unit"))


@query(f"""WITH {MARKET_SQL}, v AS (SELECT purpose, median(lat) AS lat, median(lon) AS lon, greatest(max(lat) - min(lat), max(lon) - min(lon)) AS span, count(*) AS n_points FROM m WHERE is_sale OR is_offer GROUP BY 1)
SELECT purpose, round(lat, 6) AS lat, round(lon, 6) AS lon, n_points, CAST(CASE WHEN n_points = 1 THEN 15.0 WHEN span <= 0.002 THEN 15.5 WHEN span <= 0.005 THEN 14.5 WHEN span <= 0.01 THEN 13.8 WHEN span <= 0.03 THEN 12.5 WHEN span <= 0.08 THEN 11.3 WHEN span <= 0.2 THEN 10.2 WHEN span <= 0.5 THEN 9.0 ELSE 7.8 END AS DOUBLE) AS zoom FROM v""")
def map_view(spark, sf_dir):
    return report.map_view(traded(spark, sf_dir), ["purpose"]).select("purpose", r6("lat").alias("lat"), r6("lon").alias("lon"), "n_points", "zoom")


@query(f"""WITH {NEAR}, w AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY weight DESC, id) AS position, min(weight) OVER (PARTITION BY target_id) AS lo, max(weight) OVER (PARTITION BY target_id) AS hi FROM nb)
SELECT target_id, position, id, round(15 + 16 * CASE WHEN hi > lo THEN (weight - lo) / (hi - lo) ELSE 1 END, 6) AS marker_size, coalesce(translate(format('{{:,.3f}}', geo), ',.', '.,'), '—') AS distance_text, translate(format('{{:,.1f}}', weight * 100), ',.', '.,') || '%' AS weight_text FROM w""")
def map_table(spark, sf_dir):
    near = knn.adaptive(knn.nearest(*_market_and_nations(spark, sf_dir), LAST_YEAR))
    return report.map_table(near).select("target_id", F.col("position").cast("long").alias("position"), "id", r6("marker_size").alias("marker_size"), "distance_text", "weight_text")


@query(f"""WITH {NEAR}, pts AS (SELECT nb.target_id, CASE WHEN right(p.id, 1) <> '7' THEN p.lat END AS lat, p.lon, false AS own FROM nb JOIN p ON p.id = nb.id UNION ALL SELECT target_id, tlat, tlon, true FROM t),
v AS (SELECT target_id, median(lat) AS lat, median(lon) AS lon, greatest(max(lat) - min(lat), max(lon) - min(lon)) AS span, count(*) AS n_points FROM pts WHERE lat IS NOT NULL GROUP BY 1),
d AS (SELECT target_id, count(*) FILTER (NOT own AND lat IS NULL) AS n_discarded FROM pts GROUP BY 1)
SELECT target_id, round(lat, 6) AS lat, round(lon, 6) AS lon, n_points, n_discarded, CAST(CASE WHEN n_points = 1 THEN 15.0 WHEN span <= 0.002 THEN 15.5 WHEN span <= 0.005 THEN 14.5 WHEN span <= 0.01 THEN 13.8 WHEN span <= 0.03 THEN 12.5 WHEN span <= 0.08 THEN 11.3 WHEN span <= 0.2 THEN 10.2 WHEN span <= 0.5 THEN 9.0 ELSE 7.8 END AS DOUBLE) AS zoom FROM v JOIN d USING (target_id)""")
def map_extents(spark, sf_dir):
    """The view of each target with its neighbours, of which some lack a latitude."""
    market, targets = _market_and_nations(spark, sf_dir)
    near = knn.adaptive(knn.nearest(market, targets, LAST_YEAR)).withColumn("lat", F.when(~F.col("id").endswith("7"), F.col("lat")))
    return report.map_extents(near, targets).select("target_id", r6("lat").alias("lat"), r6("lon").alias("lon"), "n_points", "n_discarded", "zoom")


@query(f"""WITH {MARKET_SQL} SELECT purpose, row_number() OVER (ORDER BY purpose) AS position FROM m WHERE purpose <> '' GROUP BY 1""")
def sorted_purposes(spark, sf_dir):
    """The purposes of the market in order, as a list to choose from."""
    names = market_rows(spark, sf_dir).select(F.trim("purpose").alias("purpose")).where("purpose <> ''").distinct()
    return names.agg(F.array_sort(F.collect_set("purpose")).alias("p")).select(F.posexplode("p").alias("i", "purpose")).select("purpose", (F.col("i") + 1).cast("long").alias("position"))


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_events(spark, sf_dir):
    """The latest event of each user and type, from a stream of the events over keyed state."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern: streams take no single file
    log = written_changes(latest_changes(stream, F.concat_ws(":", "event_type", "user_id"), F.col("ts"), "event_id"))
    return current(log, "event_id").select("event_id", "user_id", "event_type", "value")
