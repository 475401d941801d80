"""From a raw sheet to an adjusted, audited market table."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import roles
from ..functions.numbers import coordinate, number, parse_date, valid_year
from ..functions.text import HOUSE, OFFER, SALE, WAREHOUSE, area_preference, norm, purpose_class
from ..operators import dedup, prefilter
from ..operators.discount import adjust, offer_discount
from ..plans.params import GLOBAL, PROFILES, by_purpose, floor_fits, floor_of, regime_choice
from ..sources.stage import removed, staged, staging_folder
from ..sources.tables import with_row_id

CONFLICTS = ("sim", "moderado")
STAGE_CONFLICT, STAGE_REGIME = "política de conflito tipológico", "regime de área"
REGIMES = {"lot_area": "lot", "built_area": "total", "private_area": "private"}


@dataclass
class Prepared:
    """One annotated table: kept, excluded and flagged are filters over it.

    choices has a row for each purpose: regime and why, whether rows that conflict were
    left out or included, and the counts behind both.  totals are counts over all rows,
    observed while they were written."""

    rows: DataFrame
    discount: DataFrame
    diagnostics: DataFrame
    choices: DataFrame
    totals: dict[str, int] = field(default_factory=dict)

    @property
    def conflict_used(self) -> bool:
        """Whether any purpose includes rows that conflict because others are too few."""
        return not self.choices.where("conflict_policy = 'included'").isEmpty()

    @property
    def kept(self) -> DataFrame:
        return self.rows.where("_status = 'kept'")

    @property
    def excluded(self) -> DataFrame:
        return self.rows.where("_status = 'excluded'")

    @property
    def flagged(self) -> DataFrame:
        return self.rows.where("_flagged")


def _select(df: DataFrame, mapping: roles.ColumnMapping, purpose: str | None) -> DataFrame:
    """Rows of the purpose (null: of any) that are sales or offers, with what removing
    duplicates reads; _typed() adds the rest, which isn't shuffled with them."""
    types = dict(df.dtypes)
    col = lambda name: F.col(f"`{name}`")
    out = df if "_row_id" in df.columns else with_row_id(df)
    kind = norm(col(mapping.info_type).cast("string"))
    out = out.withColumns({"is_offer": kind == norm(F.lit(OFFER)), "_kind": kind, "_p": norm(col(mapping.purpose).cast("string")), "value": number(col(mapping.value), types[mapping.value])})
    out = out.where(F.col("_kind").isin(norm(F.lit(SALE)), norm(F.lit(OFFER))))
    return out.where(F.col("_p") != "" if purpose is None else F.col("_p") == norm(F.lit(purpose)))


def _typed(out: DataFrame, mapping: roles.ColumnMapping, types: dict[str, str]) -> DataFrame:
    """Adds the typed roles to rows of _select(); types are those of the sheet."""
    col = lambda name: F.col(f"`{name}`")
    out = out.withColumns({"is_sale": F.col("_kind") == norm(F.lit(SALE)), "purpose": col(mapping.purpose).cast("string")})
    typed = {"lot_area": mapping.lot_area, "built_area": mapping.built_area, "private_area": mapping.private_area, "frontage": mapping.frontage, "year": mapping.year}
    new = {role: number(col(c), types[c]) if c else F.lit(None).cast("double") for role, c in typed.items()}
    for role, c in (("lat", mapping.latitude), ("lon", mapping.longitude)):
        new[role] = coordinate(col(c)) if c else F.lit(None).cast("double")
    return out.withColumns(new)


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _written(df: DataFrame, totals: dict[str, int], **metrics: Column) -> DataFrame:
    """staged(), with counts observed by the same job."""
    seen = Observation()
    out = staged(df.observe(seen, *(_count(c).alias(name) for name, c in metrics.items())))
    totals.update(seen.get)
    return out


def _prepare(df: DataFrame, mapping: roles.ColumnMapping, kind: str | None, purpose: str | None, fixed: str | None, minimum: Column | None, floor: Column | None, last_year: int | None) -> Prepared:
    """Both public forms: all purposes at once or one, the regime chosen or fixed.

    Rows are written once with what each choice of them keeps after duplicates; filters,
    by every choice and regime of a purpose, then read a few columns of it; the table of
    choices has a row for each purpose; last, rows are priced by what was chosen."""
    roles.validate_mapping(mapping, df.columns)
    original = [c for c in df.columns if not c.startswith("_")]
    kind = kind or roles.value_kind(mapping.value)
    totals: dict[str, int] = {}
    rows = _select(df, mapping, purpose)
    conflict = norm(F.col("_purpose_conflict")).isin(*CONFLICTS) if "_purpose_conflict" in df.columns else F.lit(False)
    rows = rows.withColumn("_conflict", conflict)
    types = dict(rows.dtypes)
    date_col, registration = roles.first_existing(original, roles.DEDUP_DATE), roles.first_existing(original, roles.REGISTRATION)
    date = parse_date(F.col(f"`{date_col}`"), types[date_col]) if date_col else F.lit(None).cast("timestamp")
    ids = [c for c in roles.LISTING_IDS if c in original]
    choices = {"_full": F.lit(True)} | ({"_clean": ~F.col("_conflict")} if minimum is not None else {})
    between = staging_folder(df.sparkSession)
    rows = dedup.deduplicate_choices(rows, choices, "_kind", date, F.col(f"`{registration}`").cast("string") if registration else None, F.col("value") if registration else None, ids, F.col("is_offer"), ["_p"], path=between)
    rows = _typed(rows, mapping, dict(df.dtypes))
    if minimum is None:
        rows = rows.withColumns({"_clean": F.lit(False), "_clean_by": F.lit(None).cast("int")})
    sheet = dict(zip(("_nature", "_fraction", "_several"), prefilter.sheet_predicates(rows.select(*original))))
    rows = _written(
        rows.withColumns(sheet), totals, n_rows=F.lit(True), conflict_rows=F.col("_conflict"), removed_by_registration=F.col("_full_by") == 1, removed_by_listing=F.col("_full_by") == 2,
        removed_by_registration_without_conflicts=F.col("_clean_by") == 1, removed_by_listing_without_conflicts=F.col("_clean_by") == 2,
    )
    removed(df.sparkSession, between)
    min_k = by_purpose(F.col("_p"), PROFILES, GLOBAL, "min_k")
    preference = area_preference(purpose_class(F.col("purpose")))
    some = F.any_value if fixed else F.min
    base = staged(rows.groupBy("_p").agg(some("purpose").alias("purpose"), F.count_if("_conflict").alias("n_conflict"), F.count_if(F.col("lot_area") > 0).alias("n_land")).withColumn("_both", F.lit(minimum is not None) & (F.col("n_conflict") > 0)).withColumns({
        "preference": preference, "min_k": min_k, "_set_floor": floor_of(F.col("_p")), "use_land": F.lit(fixed is None) & F.col("_p").isin(*(norm(F.lit(p)) for p in (HOUSE, WAREHOUSE))) & (F.col("n_land") >= min_k), "_minimum": F.lit(0) if minimum is None else minimum,
    }))

    # every regime and choice of a purpose, with the columns that filters read
    areas = {r: c for c, r in REGIMES.items() if getattr(mapping, c) and fixed in (None, r)}
    ground = F.col("preference") == "terreno"
    wanted = lambda r: F.lit(True) if fixed else ground if r == "lot" else ~ground
    each = [F.when(F.col(flag) & wanted(r) & (F.col("_both") if flag == "_clean" else F.lit(True)), F.struct(F.lit(r).alias("_regime"), F.lit(flag).alias("_choice"), F.col(c).alias("area"))) for r, c in areas.items() for flag in ("_full", "_clean")]
    floors = {r: floor if floor is not None else F.when(floor_fits(F.col("preference"), r), F.col("_set_floor")).otherwise(0.0) for r in REGIMES.values()}
    floor_now = F.when(F.col("_regime") == "lot", floors["lot"]).when(F.col("_regime") == "total", floors["total"]).otherwise(floors["private"])
    tests = tuple(map(F.col, sheet))
    sale, group = F.col("is_sale"), ["_p", "_regime", "_choice"]
    none = F.array().cast("array<struct<_regime: string, _choice: string, area: double>>")
    narrow = rows.join(base.select("_p", "preference", "_both", "use_land", "_set_floor"), "_p").select("_p", "preference", "use_land", "_set_floor", "is_sale", "value", "year", "lot_area", *sheet, F.inline(F.array_compact(F.array(*each)) if each else none))
    tried = prefilter.apply_rules(narrow, "_p", sale, kind, floor_now, tests)
    bounds = staged(prefilter.robust_bounds(tried, group, sale))
    kept = F.col("_status") == "kept"
    usable = kept & (~F.col("use_land") | (F.col("lot_area") > 0)) & (F.lit(True) if last_year is None else valid_year(F.col("year"), last_year))
    counts = prefilter.robust_filter(tried, group, sale, bounds).groupBy(*group).agg(_count(kept).alias("n"), _count(usable).alias("u"))
    of = lambda c, r, flag: F.max(F.when((F.col("_regime") == r) & (F.col("_choice") == flag), F.col(c)))
    counts = counts.groupBy("_p").agg(*(of(c, r, flag).alias(f"{c}_{r}{flag}") for c in "nu" for r in REGIMES.values() for flag in ("_full", "_clean")))
    t = base.join(counts, "_p", "left")
    used = {r: F.when(F.col("_both") & (F.coalesce(f"n_{r}_clean", F.lit(0)) >= F.col("_minimum")), "_clean").otherwise("_full") for r in REGIMES.values()}
    sample = {r: F.coalesce(F.when(used[r] == "_clean", F.col(f"u_{r}_clean")).otherwise(F.col(f"u_{r}_full")), F.lit(0)) for r in REGIMES.values()}
    available = lambda r: sample[r] if r in areas else F.lit(None).cast("long")
    regime, why = (F.lit(fixed), F.lit("manual")) if fixed else regime_choice(F.col("preference"), available("private"), available("total"), available("lot"), F.col("min_k"))
    by_regime = lambda values: F.when(F.col("regime") == "lot", values["lot"]).when(F.col("regime") == "total", values["total"]).when(F.col("regime") == "private", values["private"])
    t = t.withColumns({"regime": regime, "why": why, **{f"n_{r}": sample[r] for r in REGIMES.values()}}).withColumn("_used", by_regime(used))
    policy = F.when(F.col("n_conflict") == 0, "none").when(F.col("_used") == "_clean", "excluded").when(F.col("_used") == "_full", "included" if minimum is not None else "kept")
    chosen = staged(t.select("_p", "_set_floor", "purpose", "preference", "min_k", "use_land", "n_land", "n_conflict", "n_private", "n_total", "n_lot", "regime", "why", "_used", policy.alias("conflict_policy")))

    rows = rows.join(chosen.select("_p", "preference", "_set_floor", F.col("regime").alias("_regime"), "_used"), "_p")
    unpriced, left_out = F.col("_regime").isNull(), F.coalesce(F.col("_used") == "_clean", F.lit(False)) & F.col("_conflict")
    rows = rows.where(left_out | F.when(F.col("_used") == "_clean", F.col("_clean")).otherwise(F.col("_full")))
    area = {r: F.col(c) for c, r in REGIMES.items()}
    rows = rows.withColumn("area", F.when(F.col("_regime") == "lot", area["lot"]).when(F.col("_regime") == "total", area["total"]).when(F.col("_regime") == "private", area["private"]))
    rows = prefilter.apply_rules(rows, "_p", sale, kind, floor_now, tests)
    now = bounds.join(chosen.select("_p", F.col("regime").alias("_regime"), F.col("_used").alias("_choice")), group).drop("_regime", "_choice")
    rows = prefilter.robust_filter(rows, ["_p"], sale, now)
    both = F.col("_conflict") & ~left_out & (F.col("_status") == "kept")
    alert = F.when(both, F.concat_ws("; ", F.nullif("_alert", F.lit("")), F.lit("conflito tipológico"))).otherwise(F.col("_alert"))
    out = left_out | unpriced
    plain = lambda c, then: F.when(out, then).otherwise(c)
    rows = rows.withColumns({"_out": out, "_alert": plain(alert, ""), "_flagged": plain(F.col("_flagged") | both, False)}).withColumns({
        "_status": F.when(F.col("_out"), "excluded").otherwise(F.col("_status")), "_stage": F.when(left_out, STAGE_CONFLICT).when(unpriced, STAGE_REGIME).otherwise(F.col("_stage")),
        "_reasons": F.when(left_out, "fontes divergem sobre a finalidade").when(unpriced, "nenhum regime de área com dados suficientes").otherwise(F.col("_reasons")),
    })
    rows = rows.drop("_full", "_clean", "_full_by", "_clean_by", "preference", "_used", "_out", "_set_floor", *sheet)
    discount = offer_discount(rows.where("_status = 'kept'"), ["_p"])
    stage, gone = F.col("_stage"), F.col("_status") == "excluded"
    rows = _written(
        adjust(rows, discount, ["_p"]).withColumn("unit", F.col("adjusted_unit")).withColumnRenamed("_regime", "regime"), totals, excluded_by_conflict=gone & (stage == STAGE_CONFLICT), excluded_by_regime=gone & (stage == STAGE_REGIME),
        prefilter_input=~gone | ~stage.isin(STAGE_CONFLICT, STAGE_REGIME), deterministic_excluded=gone & (stage == prefilter.STAGE_RULE), statistical_excluded=gone & (stage == prefilter.STAGE_ROBUST), below_floor=F.col("_reasons").contains("piso"),
        flagged=F.col("_flagged"), sales_before=F.col("is_sale") & (~gone | ~stage.isin(STAGE_CONFLICT, STAGE_REGIME)), sales_after=F.col("is_sale") & ~gone, offers_after=F.col("is_offer") & ~gone, kept=~gone, conflict_rows_included=F.col("_conflict") & ~gone,
    )
    return Prepared(rows, discount, _diagnostics(rows, kind).join(chosen.drop("_used", "_set_floor", "purpose", "regime"), "_p", "left"), chosen.drop("_used", "_set_floor"), totals)


def prepare(df: DataFrame, mapping: roles.ColumnMapping, purpose: str, reference: str = "built_area", kind: str | None = None, minimum: int | None = None, floor: Column | None = None) -> Prepared:
    """The market of one purpose, priced by one area.  The purpose's floor applies where
    it was set for that area's unit values, unless one is given.

    Rows whose sources conflict about the purpose are left out if at least `minimum`
    rows are kept without them; else they are kept, and flagged."""
    return _prepare(df, mapping, kind, purpose, REGIMES[reference], None if minimum is None else F.lit(minimum), floor, None)


def prepare_all(df: DataFrame, mapping: roles.ColumnMapping, kind: str | None = None, last_year: int | None = None) -> Prepared:
    """The market of every purpose (rows without one are left out), each priced by the
    area that its candidates suffice for: territorial purposes by the lot from two on,
    others by the preferred one of private and total area, else the other one, from the
    profile's least number of neighbours on.  That number also decides about conflicts,
    for each area, as in prepare().

    A candidate counts if filters keep it, has a lot area where the purpose takes lots
    into account (houses and warehouses, if enough rows have one), and a valid year if
    last_year is given.  Rows of a purpose that no area suffices for are excluded, at a
    stage of their own."""
    return _prepare(df, mapping, kind, None, None, F.col("min_k"), None, last_year)


def _diagnostics(table: DataFrame, kind: str) -> DataFrame:
    """Counts by purpose."""
    kept = F.col("_status") == "kept"
    return table.groupBy("_p").agg(
        F.min("purpose").alias("purpose"), F.min("regime").alias("regime"), F.lit(kind).alias("value_kind"), F.count("*").alias("n_rows"), _count(kept).alias("n_kept"), _count(kept & F.col("is_sale")).alias("n_sale"),
        _count(kept & F.col("is_offer")).alias("n_offer"), _count(~kept).alias("n_excluded"), _count(F.col("_flagged")).alias("n_flagged"), _count(F.col("_reasons").contains("piso")).alias("n_below_floor"), F.max("_floor").alias("floor"), F.max("n_tested").alias("n_tested"),
    )
