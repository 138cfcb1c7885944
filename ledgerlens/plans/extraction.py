"""Extraction over rendered invoices, checked against the tables the texts were rendered from.

The oracle never sees a text: it knows what was written from the order tables and computes what a reader
must find, the amount choice by trying every pair.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import clean_markdown, page_with_margins, table_cells
from ..operators import uploads as U
from ..operators.extraction import amounts as AM
from ..operators.extraction import assemble as X
from ..operators.extraction import fields as FI
from ..operators.extraction import items as IT
from ..operators.extraction import lines as LI
from ..operators.extraction import taxids as TI
from ..sources.render import invoice_text
from .prelude import control, with_views
from .registry import query

_MONTHS = "['" + "','".join(K.MONTHS_ES) + "']"
_P = "lpad({}::VARCHAR,7,'0')"
# what each text says, in cents
INV = f"""SELECT o_orderkey AS doc_id, o_custkey AS cust, o_orderkey % (SELECT count(*) FROM supplier) AS supp, o_orderdate AS dt,
  coalesce(n,0) AS n, base, rate, regime, tax, ret, base+tax-ret AS total, o_orderkey%4 AS layout,
  8 + 1 + (CASE WHEN o_orderkey%4=3 THEN 2+coalesce(n,0) ELSE 4+4*coalesce(n,0) END) AS foot
  FROM (SELECT *, (base*rate+50)//100 AS tax, CASE WHEN o_orderkey%5=0 THEN (base*15+50)//100 ELSE 0 END AS ret FROM (
    SELECT o.*, n, coalesce(s, round(o_totalprice*100)::BIGINT) AS base, ([4,10,21,3,7,15])[(o_custkey%6+1)::INT]::BIGINT AS rate,
    CASE WHEN o_custkey%6<3 THEN 'IVA' ELSE 'IGIC' END AS regime
    FROM orders o LEFT JOIN (SELECT factura_id, count(*) AS n, sum(importe_c)::BIGINT AS s FROM lineas GROUP BY 1) l ON l.factura_id=o.o_orderkey))"""
# every number with two decimals that a text contains
VALS = """SELECT DISTINCT doc_id, v FROM (
  SELECT i.doc_id, unnest(CASE WHEN layout=3 THEN [importe_c] ELSE [precio_c, importe_c] END) AS v FROM inv i JOIN lineas l ON l.factura_id=i.doc_id
  UNION ALL SELECT doc_id, unnest([base, tax, ret, total]) FROM inv) WHERE v>0"""
# all pairs under all rates of the text: score in tenths, first maximum
RATES = "SELECT doc_id, rate, 0 AS ro FROM inv UNION ALL SELECT doc_id, 15, 1 FROM inv WHERE ret>0 AND rate<>15"
PAIRS = """SELECT doc_id, v1, v2, rate, ro, reading, score FROM (
  SELECT a.doc_id, a.v AS v1, b.v AS v2, r.rate, ro, unnest([0,1]) AS reading,
  unnest([ (CASE WHEN (b.v*r.rate+50)//100=0 THEN 3 ELSE 0 END) + (CASE WHEN (a.v-b.v)*50<=greatest(500,a.v) THEN 5 ELSE 0 END),
           5 + (CASE WHEN (a.v*r.rate+50)//100>0 AND abs((a.v*r.rate+50)//100-b.v)*50<=greatest(500,(a.v*r.rate+50)//100) THEN 5 ELSE 0 END) ]) AS score
  FROM vals a JOIN vals b ON a.doc_id=b.doc_id AND a.v>b.v JOIN rates r ON r.doc_id=a.doc_id JOIN inv i ON i.doc_id=a.doc_id AND i.ret>0)"""
BEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, v1 DESC, v2 DESC, ro, reading) AS rn FROM pairs) WHERE rn=1"""
MONEY = """SELECT i.doc_id, i.n, i.layout, CASE WHEN ret=0 THEN i.base WHEN b.reading=1 THEN v1 ELSE v2 END AS base, CASE WHEN ret=0 THEN i.rate ELSE b.rate END AS rate,
  CASE WHEN ret=0 THEN i.tax WHEN b.reading=1 THEN v2 ELSE v1-v2 END AS tax, CASE WHEN ret=0 THEN i.total WHEN b.reading=1 THEN v1+v2 ELSE v1 END AS total,
  CASE WHEN ret=0 THEN 10 ELSE b.score END AS score, CASE WHEN ret>0 THEN CASE WHEN i.rate IN (7,15,21) THEN i.rate ELSE 15 END END AS ret_rate,
  CASE WHEN ret>0 THEN ret END AS ret FROM inv i LEFT JOIN best b ON b.doc_id=i.doc_id"""
ITEMS = """SELECT i.doc_id, l.orden-1 AS item, 'Producto '||producto_id AS descripcion, CASE WHEN layout=3 THEN 1.0 ELSE cantidad END AS cantidad,
  (CASE WHEN layout=3 THEN importe_c ELSE precio_c END)/100 AS precio_unitario, importe_c/100 AS importe, importe_c,
  layout=3 OR abs(cantidad::BIGINT*precio_c-importe_c)<=2 AS exact FROM inv i JOIN lineas l ON l.factura_id=i.doc_id"""
_CTES = dict(inv=INV, vals=VALS, rates=RATES, pairs=PAIRS, best=BEST, money=MONEY, items=ITEMS)


def _sql(sql: str, *upto: str) -> str:
    order = list(_CTES)
    last = max(order.index(u) for u in upto)
    return with_views(sql, "lineas", **{k: _CTES[k] for k in order[: last + 1]})


_SUPPLIER, _CLIENT = "'Suministros '||supp||' S.L.'", "'Comercial '||cust||' S.A.'"
_CIF_A = f"'A'||{_P.format('supp')}||{control(_P.format('supp'))}"
_CIF_B = f"'B'||{_P.format('cust')}||{control(_P.format('cust'))}"
_ISO = "strftime(dt,'%Y-%m-%d')"
_NUM = "'FI2026'||lpad(doc_id::VARCHAR,8,'0')"
_LONG = f"CASE WHEN doc_id%3=0 THEN day(dt)||' de '||{_MONTHS}[month(dt)::INT]||' de '||year(dt) ELSE strftime(dt,'%d/%m/%Y') END"


def _scan(d):
    return LI.scan_lines(invoice_text(d))


@query("extract_line_counts", _sql("SELECT doc_id, foot + 3 + (ret>0)::INT AS n_lines FROM inv", "inv"))
def extract_line_counts(d):
    return LI.line_rows(_scan(d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("extract_lines", """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i)-1) AS line_index, line FROM (
  SELECT doc_id, i, trim(regexp_replace(regexp_replace(raw,'[ \\t]+',' ','g'),'^\\s+|\\s+$','','g')) AS line FROM (
  SELECT doc_id, unnest(string_split(text,chr(10))) AS raw, generate_subscripts(string_split(text,chr(10)),1) AS i FROM documents)) WHERE line<>''""")
def extract_lines(d):
    """Every line of the document corpus."""
    return LI.line_rows(LI.scan_lines(d.table("documents"))).select("doc_id", F.col("line_index").cast("bigint").alias("line_index"), "line")


@query("extract_fields", _sql(
    f"""SELECT doc_id, 'CIF' AS label, {_CIF_A} AS value, 2 AS line_index, 'inline' AS source FROM inv UNION ALL SELECT doc_id, 'Cliente', {_CLIENT}, 3, 'next_line' FROM inv
    UNION ALL SELECT doc_id, 'CIF', {_CIF_B}, 6, 'inline' FROM inv UNION ALL SELECT doc_id, 'Factura No', {_NUM}, 7, 'inline' FROM inv
    UNION ALL SELECT doc_id, 'Fecha', {_LONG}, 8, 'inline' FROM inv
    UNION ALL SELECT doc_id, 'Importe', CASE WHEN layout=3 AND n>0 THEN (SELECT 'Producto '||producto_id||' '||fmt FROM firsts WHERE firsts.doc_id=inv.doc_id)
       WHEN n>0 THEN (SELECT 'Producto '||producto_id FROM firsts WHERE firsts.doc_id=inv.doc_id)
       ELSE 'Base imponible '||(SELECT fmt FROM bases WHERE bases.doc_id=inv.doc_id) END, CASE WHEN layout=3 THEN 10 ELSE 12 END, 'next_line' FROM inv""", "inv")
    .replace("\nSELECT doc_id, 'CIF'", """,
    firsts AS (SELECT factura_id AS doc_id, producto_id, replace(format('{:,}', importe_c//100), ',', '.')||','||lpad((importe_c%100)::VARCHAR,2,'0') AS fmt FROM lineas WHERE orden=1),
    bases AS (SELECT doc_id, replace(format('{:,}', base//100), ',', '.')||','||lpad((base%100)::VARCHAR,2,'0') AS fmt FROM inv)
SELECT doc_id, 'CIF'""", 1))
def extract_fields(d):
    """``Importe`` alone on its header line takes the line below it as value."""
    return FI.field_rows(FI.with_fields(_scan(d))).withColumn("line_index", F.col("line_index").cast("int"))


@query("extract_tax_ids", _sql(
    f"""SELECT doc_id, {_CIF_A} AS tax_id, 2 AS line_index, {_SUPPLIER} AS nearby_name FROM inv UNION ALL SELECT doc_id, {_CIF_B}, 6, {_CLIENT} FROM inv""", "inv"))
def extract_tax_ids(d):
    return TI.tax_id_rows(TI.with_tax_ids(_scan(d)))


@query("near_lines", _sql("SELECT doc_id, 17 AS n_near, 3 AS n_plausible FROM inv", "inv"))
def near_lines(d):
    """Lines around the two ids of each text: the first has two lines above and five below it, the second
    five and five.  The first sees both company names, the second only its own."""
    near = TI.near_line_rows(TI.with_hits(_scan(d)))
    return near.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_near"),
        F.count_if(F.col("plausible") & F.col("name").rlike("^(Suministros|Comercial) ")).cast("int").alias("n_plausible"))


@query("extract_identity", _sql(f"SELECT doc_id, {_NUM} AS numero_factura, {_ISO} AS fecha, '' AS rectified_invoice_number FROM inv", "inv"))
def extract_identity(d):
    return FI.identity(FI.with_fields(_scan(d))).select("doc_id", "numero_factura", "fecha", "rectified_invoice_number")


@query("extract_parties", _sql(
    f"SELECT doc_id, {_SUPPLIER} AS proveedor, {_CIF_A} AS cif_proveedor, {_CLIENT} AS cliente, {_CIF_B} AS cif_cliente, 0.8::DOUBLE AS role_conf FROM inv", "inv"))
def extract_parties(d):
    return TI.parties(TI.with_tax_ids(_scan(d))).select("doc_id", "proveedor", "cif_proveedor", "cliente", "cif_cliente", "role_conf")


@query("extract_amount_rows", _sql(
    """SELECT doc_id, 'amount' AS kind, label, count(*) AS n, sum(c)::BIGINT AS cents FROM (
    SELECT i.doc_id, CASE WHEN layout=3 THEN 'Producto '||producto_id ELSE '' END AS label, unnest(CASE WHEN layout=3 THEN [importe_c] ELSE [precio_c,importe_c] END) AS c FROM inv i JOIN lineas l ON l.factura_id=i.doc_id
    UNION ALL SELECT doc_id, 'Base imponible', base FROM inv UNION ALL SELECT doc_id, regime||' '||rate||'%', tax FROM inv
    UNION ALL SELECT doc_id, 'Retención IRPF 15%', ret FROM inv UNION ALL SELECT doc_id, 'Total factura', total FROM inv) WHERE c<>0 GROUP BY ALL
    UNION ALL SELECT doc_id, 'percent', regime, 1, rate*100 FROM inv UNION ALL SELECT doc_id, 'percent', 'Retención IRPF', 1, 1500 FROM inv WHERE ret>0""", "inv"))
def extract_amount_rows(d):
    rows = AM.line_amount_rows(_scan(d))
    return rows.groupBy("doc_id", "kind", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("extract_amounts", _sql(
    """SELECT doc_id, base/100 AS base_imponible, rate::DOUBLE AS iva_porcentaje, tax/100 AS iva, total/100 AS total,
    ret_rate::DOUBLE AS retencion_porcentaje, ret/100 AS retencion, score/10 AS math_score FROM money""", "money"))
def extract_amounts(d):
    return AM.line_money_rows(_scan(d))


@query("table_zones", _sql(
    """SELECT doc_id, CASE WHEN n>0 THEN foot-(CASE WHEN layout=3 THEN n ELSE 4*n END) ELSE NULL END AS start, CASE WHEN n>0 THEN foot END AS "end" FROM inv""", "inv"))
def table_zones(d):
    """The zone of every text; none where there are no items."""
    zones = IT.zone_rows(IT.with_zone(_scan(d))).filter(F.col("end") > F.col("start")).select("doc_id", F.col("start").cast("bigint"), F.col("end").cast("bigint"))
    return d.table("orders").select(F.col("o_orderkey").alias("doc_id")).join(zones, "doc_id", "left")


@query("table_runs", _sql(
    """SELECT doc_id, CASE WHEN n=0 THEN 0 ELSE CASE layout WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 2*n END END AS runs, CASE WHEN layout=3 THEN 0 ELSE 3*n END AS numbers FROM inv""", "inv"))
def table_runs(d):
    """Runs of lines inside the zone of every text, and how many of their lines are numbers."""
    rows = IT.run_rows(IT.with_runs(IT.with_zone(_scan(d)))).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.when(F.col("number"), F.col("length")).otherwise(0)).cast("bigint").alias("numbers"))
    every = d.table("orders").select(F.col("o_orderkey").alias("doc_id"))
    return every.join(rows, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("runs", "numbers")])


@query("extract_items", _sql("SELECT doc_id, item, descripcion, cantidad, precio_unitario, importe FROM items", "items"))
def extract_items(d):
    return IT.item_rows(IT.with_items(_scan(d))).withColumn("item", F.col("item").cast("bigint"))


_SCORES = """SELECT m.doc_id, least(0.98, 0.5 + score*0.05)::DECIMAL(6,4) AS am,
  CASE WHEN coalesce(k,0)=0 THEN 0 ELSE least(95, 60 + CASE WHEN abs(s-base)<=10 THEN 35 WHEN abs(s-base)<=100 THEN 15 ELSE 0 END + CASE WHEN allx THEN 10 ELSE 0 END) END AS li
  FROM money m LEFT JOIN (SELECT doc_id, count(*) AS k, sum(importe_c) AS s, bool_and(exact) AS allx FROM items GROUP BY 1) x ON x.doc_id=m.doc_id"""


@query("extract_invoices", _sql(
    f"""SELECT i.doc_id, {_NUM.replace('doc_id', 'i.doc_id')} AS numero_factura, {_ISO} AS fecha, 'factura' AS tipo_factura, lower(regime) AS tax_regime,
    {_CIF_A} AS cif_proveedor, {_SUPPLIER} AS proveedor, {_CIF_B} AS cif_cliente, {_CLIENT} AS cliente, 'compra' AS operation_side,
    m.base/100 AS base_imponible, m.rate::DOUBLE AS iva_porcentaje, m.tax/100 AS iva, coalesce(m.ret,0)/100 AS retencion, coalesce(ret_rate,0)::DOUBLE AS retencion_porcentaje, m.total/100 AS total,
    i.n AS n_lineas, li/100 AS conf_lineas, round((0.95*0.12*2 + 0.9*0.15 + 0.51*am + 0.8*0.10)::DECIMAL(12,6),2)::DOUBLE AS confianza, true AS useful
    FROM inv i JOIN money m ON m.doc_id=i.doc_id JOIN (""" + _SCORES + ") c ON c.doc_id=i.doc_id", "items"))
def extract_invoices(d):
    """Text in, structured invoice out: the whole extraction over every rendered invoice."""
    x = X.extract_invoices(invoice_text(d))
    return x.select(
        "doc_id", "numero_factura", "fecha", "tipo_factura", "tax_regime", "cif_proveedor", "proveedor", "cif_cliente", "cliente",
        "operation_side", "base_imponible", "iva_porcentaje", "iva", "retencion", "retencion_porcentaje", "total",
        F.size("lineas").cast("bigint").alias("n_lineas"), F.col("field_confidence")["lineas"].alias("conf_lineas"), "confianza",
        X.has_content(x).alias("useful"))


@query("extract_regimes", _sql("SELECT doc_id, lower(regime) AS tax_regime, 'factura' AS document_type FROM inv", "inv"))
def extract_regimes(d):
    from ..functions.text import document_type

    s = _scan(d).select("doc_id", F.lower("text").alias("lowered"))
    return s.select("doc_id", X.tax_regime(F.col("lowered"), F.lit(None).cast("double")).alias("tax_regime"), document_type(F.col("lowered")).alias("document_type"))


@query("extract_documents_corpus", """SELECT doc_id, text IS NOT NULL AND regexp_matches(text,'\\S') AS has_lines FROM documents""")
def extract_documents_corpus(d):
    """The whole extraction over prose: every document comes back, blank ones as empty results."""
    x = X.extract_invoices(d.table("documents").select("doc_id", "text"))
    return x.select("doc_id", (F.col("method") != "none").alias("has_lines"))


@query("corpus_findings")
def corpus_findings(d):
    """What the extraction finds in prose and web pages: counts per corpus."""
    pages = d.table("pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    docs = d.table("documents").select("doc_id", "text")
    out = []
    for name, corpus in (("documents", docs), ("pages", pages)):
        x = X.extract_invoices(corpus)
        out.append(x.agg(
            F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("n"), F.count_if(F.size("entities") > 0).alias("with_tax_id"),
            F.count_if(F.col("numero_factura") != "").alias("with_number"), F.count_if(F.col("fecha") != "").alias("with_date"),
            F.count_if(F.col("total") > 0).alias("with_total"), F.count_if(F.size("lineas") > 0).alias("with_lines"),
            F.round(F.avg("confianza"), 4).alias("mean_confidence")))
    return out[0].unionByName(out[1])


@query("route_text", """SELECT doc_id, pages, mean_chars>50 AND chars>50 AS is_digital, CASE WHEN mean_chars>50 AND chars>50 THEN 'pdf' ELSE 'ocr' END AS source, chars<20 AS weak_read FROM (
    SELECT conv_id AS doc_id, count(*) AS pages, avg(length(regexp_replace(text,'[ \\n]','','g'))) AS mean_chars, sum(length(regexp_replace(text,'^\\s+|\\s+$','','g'))) AS chars FROM conversations GROUP BY 1)""")
def route_text(d):
    pages = d.table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return U.route_text(pages)


@query("assemble_text", """SELECT doc_id, string_agg(t, chr(10)||chr(10) ORDER BY page) AS text FROM (SELECT conv_id AS doc_id, turn//2 AS page, string_agg(trim(text), chr(10) ORDER BY round((7919*turn%100)/3,1), round((31*conv_id%50)/7,1), trim(text)) AS t
    FROM conversations WHERE trim(text)<>'' AND turn//2 < 8 GROUP BY 1,2) GROUP BY 1""")
def assemble_text(d):
    """Turns of a conversation as positioned blocks, two to a page."""
    blocks = d.table("conversations").select(
        F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("page"), (F.col("turn") * 7919 % 100 / 3).alias("y"),
        (F.col("conv_id") * 31 % 50 / 7).alias("x"), "text")
    return U.assemble_text(blocks)


@query("page_limit", """WITH b AS (SELECT conv_id//3 AS doc_id, (conv_id%3)*8+turn AS page, trim(text) AS t FROM conversations),
    p AS (SELECT doc_id, max(page)+1 AS pages FROM b GROUP BY 1),
    x AS (SELECT doc_id, string_agg(t, chr(10)||chr(10) ORDER BY page) AS text FROM b WHERE page<8 AND t<>'' GROUP BY 1)
    SELECT doc_id, pages, least(pages, 8) AS "read", CASE WHEN pages>8 THEN 'only the first 8 pages are read' END AS reason, text FROM p LEFT JOIN x USING (doc_id)""")
def page_limit(d):
    """Three conversations to a document, a turn to a page: documents on both sides of the limit, and what is read of them."""
    blocks = d.table("conversations").select(
        F.floor(F.col("conv_id") / 3).alias("doc_id"), (F.col("conv_id") % 3 * 8 + F.col("turn")).alias("page"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), "text")
    return U.page_report(blocks).join(U.assemble_text(blocks), "doc_id", "left")


@query("clean_markdown", """SELECT doc_id, source||chr(10)||lang||' de '||source||chr(10)||source AS text, lang||chr(10)||source||chr(10)||'x' AS cells, source||chr(10)||'Pie '||lang AS page FROM documents""")
def clean_markdown_query(d):
    t = d.table("documents")
    md = F.concat(F.lit("## **"), "source", F.lit("**\n---\n*"), "lang", F.lit("* de ["), "source", F.lit("](http://x/y)\n![img](a.png)"), "source")
    table = F.concat(F.lit("| "), "lang", F.lit(" | "), "source", F.lit(" |\n|---|:---:|\n\nx"))
    page = page_with_margins(F.upper("source"), F.col("source"), F.concat(F.lit("Pie "), "lang"))
    # links are rewritten before images, so an image leaves its mark and text behind
    return t.select("doc_id", F.regexp_replace(clean_markdown(md), "!img", "").alias("text"), table_cells(table).alias("cells"), page.alias("page"))
