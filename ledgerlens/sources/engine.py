"""Engine results derived from the orders: amounts that mostly agree, with faults at known keys.

``attempts`` are repeated extractions of the same orders, ``engine`` one result per order.  Everything is a
projection of ``orders``, so results grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import ENGINE_NUMBERS, ENGINE_TEXT
from .domain import Domain, make_cif, spread

LINE = "struct<descripcion:string,cantidad:double,precio_unitario:double,importe_total:double>"


def engine_cents(d: Domain) -> DataFrame:
    """Amounts in cents: base, tax, surcharge, withholding, total with its fault, lines."""
    o = spread(d.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("dt"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("t"),
    )
    e = F.expr
    o = o.withColumn("base", e("(t * 100 + 60) div 121")).withColumn("tax", e("t - (t * 100 + 60) div 121"))
    o = o.withColumn("ret", e("CASE WHEN k % 5 = 0 THEN (base * 15 + 50) div 100 ELSE 0 END")).withColumn(
        "rec", e("CASE WHEN k % 13 = 0 THEN 250 ELSE 0 END")
    )
    o = o.withColumn("total", e("t - ret + rec + CASE WHEN k % 7 = 0 THEN 5000 WHEN k % 11 = 0 THEN 5 ELSE 0 END"))
    return o.withColumn("l1", e("(base * 6) div 10")).withColumn("l2", e("base - l1 + CASE WHEN k % 9 = 0 THEN 30000 ELSE 0 END"))


def _engine_columns(o: DataFrame, d: Domain) -> DataFrame:
    k, cust = F.col("k"), F.col("cust")
    supp = k % 50
    issuer_ours = k % 3 == 0
    ours, theirs = make_cif("B", cust), make_cif("A", supp)
    our_name = F.concat(F.lit("Comercial "), cust.cast("string"), F.lit(", S.A."))
    their_name = F.concat(F.lit("Suministros "), supp.cast("string"), F.lit(" S.L."))
    c = lambda x: F.col(x) / 100
    text = {
        "numero_factura": F.when(k % 17 != 0, F.concat(F.lit("F-"), k.cast("string"))).otherwise(""),
        "fecha_emision": F.when(k % 19 != 0, F.date_format("dt", "yyyy-MM-dd")).otherwise(""),
        "tipo_factura": F.when(k % 8 == 0, "ticket").when(k % 8 == 1, "factura_rectificativa").otherwise("factura"),
        "emisor_nombre": F.when(issuer_ours, our_name).when(k % 29 == 1, "").otherwise(their_name),
        # at k % 12 = 1 the ids of the two parties are swapped
        "emisor_nif": F.when(issuer_ours | (k % 12 == 1), ours).when(k % 6 == 2, "12345").when(k % 6 == 4, "").otherwise(theirs),
        "receptor_nombre": F.when(issuer_ours, their_name).otherwise(our_name),
        "receptor_nif": F.when(issuer_ours | (k % 12 == 1), theirs).when(k % 10 == 5, "").otherwise(ours),
        "regimen_fiscal": F.when(k % 2 == 0, "IVA").otherwise("IGIC"),
        "moneda": F.lit("EUR"),
    }
    numbers = {
        "base_imponible": F.when(k % 23 != 0, c("base")), "iva_porcentaje": F.when(k % 4 != 0, 21.0), "iva_cuota": c("tax"),
        "retencion_porcentaje": F.when(F.col("ret") > 0, 15.0), "retencion_importe": F.when(F.col("ret") > 0, c("ret")),
        "recargo_importe": F.when(F.col("rec") > 0, c("rec")), "total_factura": c("total"),
    }
    half = lambda x: F.expr(f"{x} div 2") / 100
    rest = lambda x: F.expr(f"{x} - {x} div 2") / 100
    tranche = lambda b, r, t: F.struct(b.alias("base_imponible"), F.lit(r).alias("tipo_porcentaje"), t.alias("cuota"))
    tranches = (
        F.when(k % 4 == 0, F.array(tranche(half("base"), 10.0, half("tax")), tranche(rest("base"), 21.0, rest("tax"))))
        .when(k % 4 != 1, F.array(tranche(c("base"), 21.0, c("tax")))).otherwise(F.array())
    ).cast("array<struct<base_imponible:double,tipo_porcentaje:double,cuota:double>>")
    line = lambda n, q, p, a: F.struct(F.lit(n).alias("descripcion"), q.alias("cantidad"), p.alias("precio_unitario"), a.alias("importe_total"))
    one = F.lit(1.0)
    lines = F.when(k % 6 == 0, F.array()).otherwise(
        F.array(line("Servicio", one, c("l1"), c("l1")), line("Material", one, c("l2"), c("l2")))
    ).cast(f"array<{LINE}>")
    blank = F.lit("")
    return o.select(
        k.alias("doc_id"), cust.alias("cliente_id"),
        *[text.get(n, blank).alias(n) for n in ENGINE_TEXT],
        *[numbers.get(n, F.lit(None)).cast("double").alias(n) for n in ENGINE_NUMBERS],
        tranches.alias("desglose_impuestos"), lines.alias("lineas"),
        F.when(k % 10 == 0, 9000).otherwise(4000).alias("prompt_tokens"),
        our_name.alias("company_name"), ours.alias("company_tax_id"),
    )


def engine(d: Domain) -> DataFrame:
    return _engine_columns(engine_cents(d), d)


def attempts(d: Domain) -> DataFrame:
    """First attempt, a retry about totals that repairs every other fault, a retry about lines that repairs
    two of three."""
    e = F.expr
    first = engine(d).withColumn("attempt", F.lit(0)).withColumn("kind", F.lit("first"))
    cents = engine_cents(d)
    fixed = cents.withColumn("total", e("CASE WHEN k % 2 = 0 THEN base + tax + rec - ret ELSE total END"))
    totals = _engine_columns(fixed, d).withColumn("attempt", F.lit(1)).withColumn("kind", F.lit("totals"))
    relined = cents.withColumn("l2", e("CASE WHEN k % 27 <> 0 THEN base - l1 ELSE l2 END"))
    lines = _engine_columns(relined, d).withColumn("attempt", F.lit(2)).withColumn("kind", F.lit("lines"))
    return first.unionByName(totals).unionByName(lines)
