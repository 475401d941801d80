import numpy as np
from pyspark.sql import functions as F

from vicinity.functions import numbers as N
from vicinity.functions import roles
from vicinity.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm_and_types(spark):
    assert column(spark, ["  AÇÃO  Nova ", None, "Straße"], T.norm) == ["acao nova", "", "strasse"]
    assert column(spark, ["Venda", "Guia de ITBI", "Transação", "Locação", " Permuta ", ""], T.information_type) == ["Oferta", "Guia ITBI", "Guia ITBI", "Oferta Aluguel", "Permuta", ""]


def test_purpose_order(spark):
    got = column(spark, ["Casa comercial", "Casa de condomínio", "Sobrado", "Residencial", "Vaga não residencial", "Construção em área projetada de gleba", "Apart-Hotel", None], T.purpose_class)
    assert got == [T.COMMERCIAL, T.HOUSE, T.HOUSE, "", T.PARKING_OTHER, T.TRACT_BUILT, T.FLAT, ""]


def test_parse_number(spark):
    texts = ["R$ 450.000,00", "120 m²", "1.234", "1,234.5", "12,5", "-30.031", "abc", None, "1.2.3,4,5"]
    got = column(spark, texts, N.parse_number)
    assert got[:7] == [450000.0, 120.0, 1234.0, 1234.5, 12.5, -30031.0, None] and got[7] is None
    assert column(spark, ["-30,031", " -51.2 ", "x"], N.coordinate) == [-30.031, -51.2, None]


def test_years(spark):
    assert column(spark, [2000.0, 1990.0, None, 1499.0, 2027.0, 2000.5, 2000.01], lambda c: N.valid_year(c, 2026), "double") == [True, True, False, False, False, False, True]


def test_shares_dates_keys(spark):
    assert column(spark, ["1/2", "50%", "0,25", "100"], lambda c: N.transmitted_share(c, "fracao")) == [0.5, 0.5, 0.25, 1.0]
    got = column(spark, ["31/12/2025", "2026-08-20", "45000", "nada"], lambda c: F.date_format(N.parse_date(c, "string"), "yyyy-MM-dd"))
    assert got == ["2025-12-31", "2026-08-20", "2023-03-15", None]
    assert column(spark, [2.675, 10.0, -1.0, None], T.money_key, "double") == ["2.67", "10.00", "", ""]


def test_addresses(spark):
    df = spark.createDataFrame([("Av. Borges de Medeiros, 2244, Porto Alegre",), ("Rua dos Andradas 1000",), ("Rua Sem Número",)], "a string")
    street, number = T.street_and_number(F.col("a"))
    assert [tuple(r) for r in df.select(street, number).collect()] == [("Av. Borges de Medeiros", 2244), ("Rua dos Andradas", 1000), ("Rua Sem Número", None)]


def test_roles():
    assert roles.first_existing(["Preço (R$)", "x"], ("preco",)) == "Preço (R$)"
    assert roles.first_existing(["Valor [a]", "Valor (b)"], ("valor",)) is None
    assert roles.unique_headers(["a", "A", "a"]) == ["a", "A_2", "a_3"]
    assert roles.matching_columns(["Natureza da Transação", "x"], roles.NATURE) == ["Natureza da Transação"]
    assert roles.value_kind("Valor unitário") == "unit"
    mapping, missing = roles.build_mapping(["_info_type", "_purpose", "Valor", "Latitude"])
    assert mapping.value == "Valor" and not missing
    assert np.isfinite(1.0)
