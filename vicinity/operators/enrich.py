"""Schema enrichment: derived columns beside the original ones, in one projection."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import roles
from ..functions.numbers import by_information_type, first_positive, number
from ..functions.text import OFFER, PARKING, PARKING_HOME, PARKING_OTHER, SALE, combine_conflicts, comparison_level, information_type, purpose_class, use_nature


@dataclass(frozen=True)
class SchemaInfo:
    siri: bool
    added: tuple[str, ...]
    notes: tuple[str, ...]


def purpose_cascade(kind: Column, explicit: Column, cadastral: Column, listed: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Final class of use with its source, and then, for a second projection over the
    first, its conflict, confidence and nature.

    The classes given come from an explicit purpose, the cadastre and the listing's
    type.  A generic parking class is refined by the cadastre; then the first source
    that applies wins: explicit; for offers the listing, for sales the cadastre; for
    offers without a listing type the cadastre; else the cadastre.
    """
    refined = lambda c: (c == PARKING) & cadastral.isin(PARKING_HOME, PARKING_OTHER)
    use = lambda c: F.when(refined(c), cadastral).otherwise(c)
    offer, sale = kind == OFFER, kind == SALE
    cases = [
        (explicit != "", use(explicit), F.when(refined(explicit), "FINALIDADE_CRAWLER_REFINADA_SIAT").otherwise("FINALIDADE_CRAWLER")),
        (offer & (listed != ""), use(listed), F.when(refined(listed), "TIPO_CRAWLER_REFINADO_SIAT").otherwise("TIPO_CRAWLER")),
        (sale & (cadastral != ""), cadastral, F.lit("SIAT")),
        (offer & (listed == "") & (cadastral != ""), cadastral, F.lit("SIAT_FALLBACK")),
        (cadastral != "", cadastral, F.lit("SIAT")),
    ]
    final, source = F.lit(""), F.lit("")
    for when, value, name in reversed(cases):
        final, source = F.when(when, value).otherwise(final), F.when(when, name).otherwise(source)
    first = {"_purpose": final, "_purpose_source": source}
    final, source = F.col("_purpose"), F.col("_purpose_source")
    conflict = combine_conflicts(comparison_level(final, cadastral), comparison_level(final, listed))
    versus = comparison_level(explicit, listed)
    confidence = (
        F.when(source.endswith("REFINADA_SIAT") | source.endswith("REFINADO_SIAT"), "Média")
        .when(source == "SIAT_FALLBACK", "Baixa")
        .when(source == "SIAT", F.when(sale, "Alta").otherwise("Média"))
        .when(source == "TIPO_CRAWLER", F.when(conflict.isin("Não", "Não aplicável"), "Alta").otherwise("Média"))
        .when(source == "FINALIDADE_CRAWLER", F.when(versus == "Sim", "Baixa").when(versus == "Não", "Alta").otherwise("Média"))
        .otherwise("Baixa")
    )
    return first, {"_purpose_conflict": conflict, "_purpose_confidence": confidence, "_use_nature": use_nature(final)}


def enrich(df: DataFrame) -> tuple[DataFrame, SchemaInfo]:
    """Adds information type, purpose and effective areas; nothing given is changed.

    Tables without the municipal markers are taken as listings: a missing information
    type is an offer.  An area or frontage is added if its lists name any column.
    """
    names = df.columns
    siri = roles.is_siri(names)
    column = lambda aliases: (lambda n: None if n is None else F.col(f"`{n}`"))(roles.first_existing(names, aliases))
    notes = []
    source = column(roles.INFORMATION_TYPE)
    if source is None:
        kind = F.lit(OFFER)
        notes.append("no information type: all rows are taken as offers")
    else:
        kind = information_type(source)
        kind = kind if siri else F.when(F.trim(F.coalesce(kind, F.lit(""))) == "", OFFER).otherwise(kind)
        notes.append("information type normalised")
    out = df.withColumn("_info_type", kind)
    text = lambda c: F.lit("") if c is None else purpose_class(c.cast("string"))
    out = out.withColumns({"_purpose_explicit": text(column(roles.PURPOSE)), "_purpose_cadastral": text(column(roles.CADASTRAL_PURPOSE)), "_purpose_listed": text(column(roles.PROPERTY_TYPE))})
    for columns in purpose_cascade(F.col("_info_type"), F.col("_purpose_explicit"), F.col("_purpose_cadastral"), F.col("_purpose_listed")):
        out = out.withColumns(columns)
    types = dict(df.dtypes)
    added = {}
    for name, lists in (("_lot_area", roles.LOT), ("_built_area", roles.BUILT), ("_private_area", roles.PRIVATE), ("_frontage", roles.FRONTAGE)):
        found = {k: list(dict.fromkeys(c for a in v if (c := roles.first_existing(names, [a])))) for k, v in lists.items()}
        if any(found.values()):
            pick = {k: first_positive(*(number(F.col(f"`{c}`"), types[c]) for c in v)) for k, v in found.items()}
            added[name] = by_information_type(F.col("_info_type"), pick["offer"], pick["transaction"], pick["other"])
            notes.append(f"{name} combined by information type")
    out = out.withColumns(added) if added else out
    return out, SchemaInfo(siri, tuple(c for c in out.columns if c not in names), tuple(notes))
