import zipfile

import pytest
from pyspark.sql import functions as F

from vicinity.functions import roles
from vicinity.functions import text as T
from vicinity.operators import geocode, report
from vicinity.sources import tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Valor</t></si><si><t>Rua </t><t>A</t></si></sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


def test_sheets(spark, tmp_path):
    first = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>valor</t></is></c><c r="D1"><v>7</v></c></row><row><c r="A2"><v>1.5</v></c><c r="B2" t="s"><v>1</v></c></row><row/><row><c r="D4"><v>9</v></c></row>'
    workbook(tmp_path / "b.xlsx", {"um": first, "dois": "<row><c><v>x</v></c></row>"})
    assert tables.sheet_names(f"file://{tmp_path}/b.xlsx") == ["um", "dois"]
    df = tables.read_sheet(spark, f"{tmp_path}/b.xlsx")
    assert df.columns == roles.unique_headers(["Valor", "valor", "column_3", "7"]) and [tuple(r) for r in df.collect()] == [("1.5", "Rua A", None, None), (None, None, None, "9")]
    with pytest.raises(ValueError):
        tables.read_sheet(spark, f"{tmp_path}/b.xlsx", sheet="dois")
    with pytest.raises(Exception, match="no sheet"):
        tables.read_sheet(spark, f"{tmp_path}/b.xlsx", sheet="outra")
    for kind in ("csv", "json", "parquet"):
        df.withColumnRenamed("7", "n").fillna("").write.mode("overwrite").format(kind).options(header="true").save(f"{tmp_path}/t.{kind}")
        assert tables.read_sheet(spark, f"{tmp_path}/t.{kind}").count() == 2


def test_report_and_ids(spark, tmp_path):
    near = spark.createDataFrame([(1, "a", ["x", "y"])], "id long, _status string, reasons array<string>")
    diagnostics = spark.createDataFrame([("LOJA", 3)], "purpose string, n_kept int")
    for kind in ("csv", "parquet"):
        tables.write_report(near, diagnostics, near.limit(0), report.audit_columns(near), f"{tmp_path}/{kind}", kind)
        back = lambda t: spark.read.format(kind).options(header="true").load(f"{tmp_path}/{kind}/{t}")  # noqa: B023, E731
        assert {tuple(r) for r in back("diagnostics").collect()} == {("purpose", "LOJA"), ("n_kept", "3")} and back("flagged").columns[0] == "_status" and back("comparables").count() == 1
    spark.createDataFrame([(b"same",)], "content binary").withColumn("path", F.lit("p")).transform(tables.content_id).first()
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(5)
    assert all(r._row_id == r.k + 1 for r in tables.with_row_id(df, ["k"]).collect())
    ids = [r._row_id for r in tables.with_row_id(df).collect()]
    assert len(set(ids)) == 1000


def test_names_and_formats(spark):
    assert roles.friendly_name("_purpose") == "Finalidade crawler utilizada pelo estimador" and roles.friendly_name("x") == "x"
    df = spark.createDataFrame([(1234.5, "Locação", 136.0, None, "Rua B"), (None, "venda", None, "Rua A, 5", "Rua B")], "v double, k string, n double, full string, s string")
    got = df.select(T.brazilian_money(F.col("v")), T.brazilian_percent(F.col("v") / 10000), T.is_rental(F.col("k")), geocode.address_queries(df, {"full": "full", "street": "s", "number": "n"}, "Porto Alegre")).collect()
    assert [tuple(r) for r in got] == [("R$ 1.234,50", "12,3%", True, "Rua B, 136, Porto Alegre"), ("—", "—", False, "Rua A, 5, Porto Alegre")]


def test_address_forms(spark):
    forms = {"Av. Borges de Medeiros, 2244, Porto Alegre": ("Av. Borges de Medeiros", 2244), "Rua A  nro 12": ("Rua A", 12), "Rua A, numero 1234567": ("Rua A", 1234567), "Rua dos Andradas 1000 - Centro": ("Rua dos Andradas", 1000), "Rua  B\t7": ("Rua B", 7), "Rua C -, nº 8": ("Rua C", 8), "": ("", None), "Rua D, fundos": ("Rua D", None)}
    df = spark.createDataFrame([(a,) for a in forms], "a string")
    street, number = T.street_and_number(F.col("a"))
    assert {r.a: (r.s, r.n) for r in df.select("a", street.alias("s"), number.alias("n")).collect()} == forms


def test_one_local_folder_per_application():
    from vicinity.sources.stage import _local_dir

    assert _local_dir("a") == _local_dir("a") != _local_dir("b")


def test_repeated_headers_of_text_files(spark, tmp_path):
    """The first column of a name keeps it, in every file of a folder."""
    (tmp_path / "t.csv").mkdir()
    for k in range(2):
        (tmp_path / "t.csv" / f"{k}.csv").write_text(f'Valor;valor;;Valor;"a;b"\n{k};2;3;4;5\n;;;;\n')
    df = tables.read_sheet(spark, f"{tmp_path}/t.csv", sep=";")
    assert df.columns == ["Valor", "valor_2", "column_3", "Valor_3", "a;b"]
    assert sorted(r[0] for r in df.where("valor_2 IS NOT NULL").select(tables.first_named(df, "Valor")).collect()) == ["0", "1"] and df.count() == 4
    missing = df.select(tables.first_named(df, "Lote").alias("x"))
    assert missing.dtypes == [("x", "double")] and missing.where("x IS NOT NULL").isEmpty()
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    for name in ("none", "head"):
        with pytest.raises(ValueError, match="no rows"):
            tables.read_sheet(spark, f"{tmp_path}/{name}.csv")


def test_address_columns():
    """Each part's column by its aliases; an address needs its full text or a street."""
    got = roles.address_columns(["CEP", "Número", "Bairro (portal)", "Rua", "valor"])
    assert got == {"full": None, "street": "Rua", "number": "Número", "neighborhood": "Bairro (portal)", "city": None, "state": None, "postal_code": "CEP"}
    assert roles.has_address(got) and not roles.has_address(got | {"street": None}) and roles.has_address({"full": "Endereço"})
    assert roles.unique_in_order(["b", None, "a", "b"]) == ["b", "a"]
