"""Calibrated parameters by purpose, as Python values and as literal columns."""
from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.roles import plain
from ..functions.text import GROUND, HOTEL, HOUSE, MULTI_HOME, PARKINGS, SPECIAL, TRADE, WAREHOUSE, norm


@dataclass(frozen=True)
class Profile:
    """Neighbour query: counts, weight of physical distance, cap, power, clipping."""

    min_k: int = 12
    max_k: int = 25
    goal: float = 11.0
    physical: float = 0.45
    cap: float = 0.30
    power: float = 0.35
    mad: float = 1.25


@dataclass(frozen=True)
class LocalFilter:
    """Lower-tail filter around a target."""

    fraction: float = 0.45
    modified_z: float = 3.0
    iqr: float = 2.0
    gap_ratio: float = 1.70
    gap_share: float = 0.30
    max_excluded: float = 0.30
    compact: float = 2.20
    proximity_power: float = 0.75
    max_reference: int = 60


# Calibrated profiles, unit-value floors and filter overlays by purpose.
GLOBAL = Profile()
PROFILES = {
    "casa / residencia": Profile(5, 40, 5, 0.85, 0.20, 0.50, 2.00),
    "sala comercial": Profile(9, 20, 15, 0.60, 0.25, 0.65, 2.50),
    "garagem / vaga": Profile(7, 30, 5, 2 / 3, 0.30, 1.00, 2.50),
    "garagem / vaga residencial": Profile(7, 30, 5, 2 / 3, 0.30, 1.00, 2.50),
    "garagem / vaga nao residencial": Profile(7, 30, 5, 2 / 3, 0.30, 1.00, 2.50),
}
FLOORS = {
    "apartamento": 1200.0, "cobertura": 900.0, "flat / apart-hotel": 1200.0, "casa / residencia": 800.0, "loja": 700.0, "loja em galeria": 1000.0, "loja em shopping": 1200.0,
    "sala comercial": 900.0, "imovel comercial": 850.0, "galpao / deposito": 650.0, "terreno": 200.0, "gleba": 20.0, "construcao em area de gleba": 100.0, "garagem / vaga": 150.0,
    "garagem / vaga residencial": 200.0, "garagem / vaga nao residencial": 150.0, "hotel": 400.0, "imovel especial": 400.0,
}
LOCAL = LocalFilter()
LOCAL_FILTERS = {
    "sala comercial": replace(LOCAL, fraction=0.55, gap_ratio=1.60, compact=2.00),
    **{p: replace(LOCAL, fraction=0.50, gap_ratio=1.65) for p in ("loja", "loja em galeria", "loja em shopping", "imovel comercial")},
}
CLASSES = (HOUSE, *MULTI_HOME, *TRADE, WAREHOUSE, *GROUND, *PARKINGS, HOTEL, SPECIAL)
DISCOUNT_CAP, OFFERS_ONLY_DISCOUNT = 0.20, 0.10


def by_purpose(purpose: Column, table: dict, default, field: str | None = None) -> Column:
    """A value of the table for a (not normalised) purpose column: a look-up in a map by
    the classes as purpose_class() spells them, then one by the normalised purpose, which
    rows of these classes needn't be normalised for."""
    get = (lambda v: v) if field is None else (lambda v: asdict(v)[field])
    pairs = [F.lit(x) for key, value in table.items() for x in (key, get(value))]
    spelled = [F.lit(x) for c in CLASSES for x in (c, get(table.get(plain(c), default)))]
    return F.coalesce(F.try_element_at(F.create_map(*spelled), purpose), F.try_element_at(F.create_map(*pairs), norm(purpose)), F.lit(get(default)))


def floor_of(purpose: Column) -> Column:
    return by_purpose(purpose, FLOORS, 0.0)


def preferred_regime(preference: str) -> str:
    return "total" if preference == "construida" else "private"


def floor_fits(preference: Column, regime: str) -> Column:
    """Whether a purpose's floor was set for the unit values of this regime (lot, total
    or private), by the area that the purpose is priced by."""
    return {"lot": ~preference.isin("construida", "privativa", "privativa_ou_construida"), "total": preference != "privativa", "private": preference != "construida"}[regime]


def choose_regime(preference: str, counts: dict[str, int], min_k: int, manual: str | None = None) -> tuple[str, str]:
    """The area that unit values are taken by, and why, from the usable candidates of
    each available regime (lot, total, private)."""
    if preference == "terreno":
        if counts.get("lot", 0) < 2:
            raise ValueError("fewer than two candidates with a lot area")
        return "lot", "territorial"
    if manual is not None:
        if counts.get(manual, 0) < 2:
            raise ValueError(f"regime {manual} has {counts.get(manual, 0)} candidates")
        return manual, "manual"
    first = preferred_regime(preference)
    other = "private" if first == "total" else "total"
    need = max(min_k, 2)
    for regime, why in ((first, "preferred"), (other, "alternative")):
        if counts.get(regime, 0) >= need:
            return regime, why
    raise ValueError(f"too few candidates: {counts}, {need} needed")


def regime_choice(preference: Column, private: Column, total: Column, lot: Column, min_k: Column) -> tuple[Column, Column]:
    """choose_regime() over columns of counts (null: not available), without a manual
    choice: the regime and why; a null regime where too few candidates are left.  The
    area of the lot is the only one of territorial purposes, from two candidates on."""
    first = F.when(preference == "construida", "total").otherwise("private")
    other = F.when(first == "total", "private").otherwise("total")
    need = F.greatest(min_k, F.lit(2))
    enough = lambda r: F.coalesce(F.when(r == "total", total).otherwise(private), F.lit(0)) >= need
    ground = preference == "terreno"
    some = F.coalesce(lot, F.lit(0)) >= 2
    regime = F.when(ground, F.when(some, "lot")).when(enough(first), first).when(enough(other), other)
    why = F.when(ground, F.when(some, "territorial").otherwise("insufficient")).when(enough(first), "preferred").when(enough(other), "alternative").otherwise("insufficient")
    return regime, why
