"""Golden rows for column functions."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import confidence as CF
from ledgerlens.functions import dates as DT
from ledgerlens.functions import money as M
from ledgerlens.functions import taxid as TI
from ledgerlens.functions import text as TX


def apply(spark, expr, values):
    """expr(Column) over single text values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_names(spark):
    got = apply(spark, TX.normalize_name, ["Suministros García, S.L.U.", "Pérez S.A.", "ACME SL", "", "S.L."])
    assert got == ["SUMINISTROS GARCIA", "PEREZ", "ACME", None, None]
    assert apply(spark, TX.normalize_for_side, ["Pérez-Gil (Sur), S.A."]) == ["PEREZ GIL SUR"]


def test_keywords_and_compatibility(spark):
    assert apply(spark, TX.normalize_keyword, ["Nº Factura:", "Descripción  €", "ｆｕｌｌ"]) == ["NO FACTURA", "DESCRIPCION", "FULL"]
    assert apply(spark, TX.nfkc, ["ﬁn…", "a b", "²"]) == ["fin...", "a b", "2"]
    assert apply(spark, TX.normalize_text, ["  a \t b\n\n\n\nc \n"]) == ["a b\n\nc"]


def test_amounts(spark):
    cases = {"1.234,56": 1234.56, "1,234.56": 1234.56, "12,5": 125.0, "12,50": 12.5, "−3,00 €": -3.0, "abc": 0.0, "": 0.0,
             "1.234.567,89": 1234567.89, "7": 7.0, "1.5": 1.5, "-12,30EUR": -12.3, "1,234,567": 1234567.0}
    assert apply(spark, M.parse_amount, list(cases)) == list(cases.values())


def test_dates(spark):
    cases = {"1/2/26": "2026-02-01", "31-02-2024": "2024-02-31", "15 de marzo de 2026": "2026-03-15", "32/01/2024": "", "x": "",
             "3 de Mayo 2020": "2020-05-03"}
    assert apply(spark, DT.parse_dmy, list(cases)) == list(cases.values())
    assert apply(spark, DT.real_date, ["2024-02-31"]) == [None]


@pytest.mark.parametrize("value,valid", [
    ("B00000018", True), ("B12345674", True), ("12345678Z", True), ("X1234567L", True), ("b-00.000018", False), ("b-00000018", True),
    ("B00000017", False), ("12345678A", False), ("X1234567A", False), ("", False), ("I1234567A", False), ("1234567", False)])
def test_tax_ids(spark, value, valid):
    assert apply(spark, TI.tax_id_valid, [value]) == [valid]


def test_scores(spark):
    df = spark.range(1)
    score = lambda *v: df.select(M.tax_score(*[F.lit(x).cast("double") for x in v])).first()[0]
    assert [score(100, 21, 21, 121), score(100, 21, None, 121), score(100, 0, None, 100), score(0, 21, 0, 0)] == [1.0, 0.0, 0.8, 0.0]
    infer = lambda *v: tuple(df.select(M.infer_missing(*[F.lit(x).cast("double") for x in v]).alias("x")).first()[0])[:4]
    assert infer(100, 21, None, None) == (100.0, 21.0, 21.0, 121.0)
    # the rate rule looks at the base as it was given
    assert infer(None, None, 21, 121) == (100.0, 0.0, 21.0, 121.0)


def test_milestones_codes_percent(spark):
    df = spark.createDataFrame([(0,), (50,), (100000,)], "p bigint")
    assert [r[0] for r in df.select(M.next_milestone(F.col("p"), (50, 100, 100000))).collect()] == [50, 100, 101000]
    c = spark.createDataFrame([(7, 1), (1234567, 1), (None, None)], "n bigint, i bigint")
    assert [r[0] for r in c.select(TX.document_code(F.col("n"), F.col("i"))).collect()] == ["DOC-000007", "DOC-1234567", "DOC-?????"]
    p = spark.createDataFrame([(0.845,), (84.5,), (1.0,)], "c double")
    assert [r[0] for r in p.select(M.as_percent(F.col("c"))).collect()] == [85, 85, 100]


def test_line_repair(spark):
    kind = "array<struct<descripcion:string,cantidad:double,precio_unitario:double,importe_total:double>>"
    df = spark.createDataFrame([([("a", 3.0, 2.0, 0.0), ("b", 1.0, 2.0, 6.0), ("c", 2.0, 2.5, 4.99)],)], f"l {kind}")
    got = df.select(M.repair_lines(F.col("l"))).first()[0]
    assert [(r.cantidad, r.importe_total) for r in got] == [(3.0, 6.0), (3.0, 6.0), (2.0, 4.99)]


def test_json_and_markdown(spark):
    assert apply(spark, TX.unfence_json, ['```json\n{"a":1}\n```', 'x {"a":2} y', '{"a":3}']) == ['{"a":1}', '{"a":2}', '{"a":3}']
    assert apply(spark, TX.id_list, ['["a", "b", ""]', "a, b,,", "[broken"]) == [["a", "b"], ["a", "b"], ["[broken"]]
    assert apply(spark, TX.clean_markdown, ["# T\n**b** [l](u)\n---\nz"]) == ["T\nb l\nz"]
    assert apply(spark, TX.table_cells, ["| a | b |\n|---|---|\nc"]) == ["a\nb\nc"]


def test_confidence(spark):
    df = spark.createDataFrame([({"total": 0.9, "fecha": 0.4, "lineas": 0.0},)], "c map<string,double>")
    c = F.col("c")
    row = df.select(CF.overall_absent_zero(c), CF.overall_absent_skipped(c), CF.missing_fields(c), CF.weak_fields(c)).first()
    assert row[0] == 0.21
    assert row[1] == round((0.9 * 1.8 + 0.4 * 1.5) / (1.5 + 1.5 + 1.8 + 1.5), 4)
    assert row[2] == ["lineas"] and row[3] == ["fecha"]
    tiers = spark.createDataFrame([(0.9,), (0.7,), (0.69,), (91.0,)], "c double").select(CF.confidence_tier(F.col("c"))).collect()
    assert [r[0] for r in tiers] == ["high", "medium", "low", "high"]
