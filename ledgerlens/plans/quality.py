"""Coherence, confidence and review rules over engine results derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence as CF
from ..functions import constants as K
from ..functions import money as M
from ..operators import dashboard as D
from ..operators import normalize as NZ
from ..operators import quality as Q
from ..operators.business import side_by_ids_and_names
from ..sources.engine import attempts, engine
from .prelude import control, with_views
from .registry import query

_P = "lpad({}::VARCHAR,7,'0')"
_OURS = f"'B'||{_P.format('cust')}||{control(_P.format('cust'))}"
_THEIRS = f"'A'||{_P.format('(k%50)')}||{control(_P.format('(k%50)'))}"
CENTS = """SELECT *, (base*6)//10 AS l1, base-(base*6)//10 + CASE WHEN k%9=0 THEN 30000 ELSE 0 END AS l2,
    t - ret + rec + CASE WHEN k%7=0 THEN 5000 WHEN k%11=0 THEN 5 ELSE 0 END AS total FROM (
    SELECT *, t-base AS tax, CASE WHEN k%5=0 THEN (base*15+50)//100 ELSE 0 END AS ret, CASE WHEN k%13=0 THEN 250 ELSE 0 END AS rec FROM (
    SELECT o_orderkey AS k, o_custkey AS cust, o_orderdate AS dt, round(o_totalprice*100)::BIGINT AS t, (round(o_totalprice*100)::BIGINT*100+60)//121 AS base FROM orders))"""
# b is the base as read: absent for every 23rd
ENG = f"""SELECT *, CASE WHEN k%23<>0 THEN base END AS b, CASE k%4 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS tranches, CASE WHEN k%6=0 THEN 0 ELSE 2 END AS n_lines,
    CASE WHEN k%6=0 THEN 0 ELSE l1+l2 END AS ls, CASE WHEN k%17<>0 THEN 'F-'||k ELSE '' END AS numero, CASE WHEN k%19<>0 THEN strftime(dt,'%Y-%m-%d') ELSE '' END AS fecha,
    CASE k%8 WHEN 0 THEN 'ticket' WHEN 1 THEN 'factura_rectificativa' ELSE 'factura' END AS tipo,
    CASE WHEN k%3=0 THEN 'Comercial '||cust||', S.A.' WHEN k%29=1 THEN '' ELSE 'Suministros '||(k%50)||' S.L.' END AS emisor,
    CASE WHEN k%3=0 OR k%12=1 THEN {_OURS} WHEN k%6=2 THEN '12345' WHEN k%6=4 THEN '' ELSE {_THEIRS} END AS emisor_nif,
    CASE WHEN k%3=0 THEN 'Suministros '||(k%50)||' S.L.' ELSE 'Comercial '||cust||', S.A.' END AS receptor,
    CASE WHEN k%3=0 OR k%12=1 THEN {_THEIRS} WHEN k%10=5 THEN '' ELSE {_OURS} END AS receptor_nif FROM cents"""
_GAP = "abs(coalesce(b,0)+tax+rec-ret-total)"
CONF = f"""SELECT k, unnest(['numero_factura','fecha','proveedor','cif_proveedor','cliente','cif_cliente','base_imponible','iva_porcentaje','iva','total','lineas']) AS field, unnest(v) AS raw,
    CASE WHEN k%10=0 THEN true ELSE false END AS retried FROM (SELECT k, [CASE WHEN numero<>'' THEN 0.92 ELSE 0 END, CASE WHEN fecha<>'' THEN 0.92 ELSE 0 END, CASE WHEN emisor<>'' THEN 0.92 ELSE 0 END,
    CASE WHEN emisor_nif='' THEN 0 WHEN emisor_nif='12345' THEN 0.70 ELSE 0.94 END, 0.92, CASE WHEN receptor_nif='' THEN 0 ELSE 0.94 END,
    CASE WHEN {_GAP}>10 THEN greatest(0.5, (CASE WHEN b IS NOT NULL THEN 0.92 ELSE 0 END) - least(0.3, {_GAP}/total)*0.7) ELSE CASE WHEN b IS NOT NULL THEN 0.92 ELSE 0 END END,
    CASE WHEN k%4<>0 THEN 0.90 ELSE 0 END, CASE WHEN {_GAP}>10 THEN greatest(0.5, 0.92 - least(0.3, {_GAP}/total)*0.7) ELSE 0.92 END,
    CASE WHEN {_GAP}>10 THEN greatest(0.5, 0.92 - least(0.3, {_GAP}/total)) ELSE 0.92 END,
    CASE WHEN n_lines>0 AND coalesce(b,0)>0 AND abs(ls-b)>greatest(b*0.05,200) THEN greatest(0.55, 0.7) WHEN n_lines>0 THEN 0.90 ELSE 0 END]::DOUBLE[] AS v FROM eng)"""
CONF2 = "SELECT k, field, round(CASE WHEN retried AND raw>0 THEN greatest(0.5, raw-0.05) ELSE raw END, 6) AS conf FROM conf0"
SIDE = """CASE WHEN k%12=1 AND k%3<>0 AND emisor<>'' THEN 'compra' WHEN k%12=1 AND k%3<>0 THEN 'compra' WHEN k%3=0 THEN 'venta' WHEN receptor_nif<>'' THEN 'compra' ELSE 'unknown' END"""


def _sql(sql: str) -> str:
    return with_views(sql, cents=CENTS, eng=ENG, conf0=CONF, conf=CONF2)


def _confidences(d):
    e = engine(d)
    cols = {c: F.col(c) for c in (*NZ.ENGINE_TEXT, *NZ.ENGINE_NUMBERS)}
    conf = CF.field_confidence(cols, F.size("lineas"), Q.lines_sum(F.col("lineas")), F.col("prompt_tokens"))
    return e.select("doc_id", "tipo_factura", conf.alias("conf"))


@query("coherence_totals", _sql(
    f"SELECT k AS doc_id, {_GAP}/100 AS diff, total=0 OR {_GAP}<10 AS totals_ok, total<>0 AND tax>0 AND tranches=0 AS missing_breakdown FROM eng"))
def coherence_totals(d):
    return Q.check_totals(engine(d)).select("doc_id", F.round("diff", 2).alias("diff"), "totals_ok", "missing_breakdown")


@query("coherence_lines", _sql(
    "SELECT k AS doc_id, abs(ls-coalesce(b,0))/100 AS line_diff, n_lines=0 OR b IS NULL OR abs(ls-b)<=greatest(b*0.05,200) AS lines_ok FROM eng"))
def coherence_lines(d):
    return Q.check_lines(engine(d)).select("doc_id", F.round("line_diff", 2).alias("line_diff"), "lines_ok")


@query("line_sums", with_views("SELECT factura_id, sum(importe_c)/100 AS line_sum, count(*) AS n FROM lineas GROUP BY 1", "lineas"))
def line_sums(d):
    exact = F.sum(F.col("importe").cast("decimal(18,2)")).cast("double")
    return d.lineas.groupBy("factura_id").agg(exact.alias("line_sum"), F.count(F.lit(1)).alias("n"))


@query("choose_attempt", _sql(
    """SELECT k AS doc_id, CASE WHEN n_lines>0 AND abs(l1+l2a-coalesce(b,0)) < abs(ls-coalesce(b,0)) THEN 2
    WHEN k%2=0 AND abs(coalesce(b,0)-base) < """ + _GAP + """ THEN 1 ELSE 0 END AS attempt FROM (SELECT *, CASE WHEN k%27<>0 THEN base-l1 ELSE l2 END AS l2a FROM eng)"""))
def choose_attempt(d):
    """Better of three extractions of every order."""
    return Q.choose_attempt(attempts(d)).select("doc_id", "attempt")


@query("token_cost", _sql("SELECT k AS doc_id, 3*(CASE WHEN k%10=0 THEN 9000 ELSE 4000 END)::BIGINT AS prompt_tokens, 4500::BIGINT AS completion_tokens, round((3*(CASE WHEN k%10=0 THEN 9000 ELSE 4000 END)*0.25+4500*2.00)/1000000,6)::DOUBLE AS cost FROM eng"))
def token_cost(d):
    return D.token_cost(attempts(d).select("doc_id", "prompt_tokens", F.lit(1500).alias("completion_tokens")))


@query("tax_breakdown_totals", _sql(
    """SELECT k AS doc_id, (CASE WHEN tranches>1 THEN base ELSE coalesce(b,0) END)/100 AS base_imponible, tax/100 AS iva, CASE WHEN tranches>1 THEN NULL WHEN k%4<>0 THEN 21.0 ELSE 0.0 END::DOUBLE AS iva_porcentaje FROM eng"""))
def tax_breakdown_totals(d):
    return NZ.breakdown_totals(engine(d)).select(
        "doc_id", F.round("base_total", 2).alias("base_imponible"), F.round("tax_total", 2).alias("iva"), F.col("rate").alias("iva_porcentaje"))


@query("line_repair", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e, CASE WHEN kind=2 AND q0>=1 THEN q::DOUBLE ELSE qin END AS cantidad, (CASE WHEN kind=0 THEN q*p WHEN kind=3 THEN q*p+1 ELSE q*p END)/100 AS importe_total FROM (
    SELECT *, l_partkey%4 AS kind, CASE WHEN l_partkey%4=2 THEN q0 ELSE q END::DOUBLE AS qin FROM (
    SELECT *, l_quantity::BIGINT AS q, l_quantity::BIGINT+3 AS q0, round(l_discount*100)::BIGINT*100+1037 AS p, l_extendedprice AS e FROM lineitem))""")
def line_repair(d):
    """Missing amounts, a wrong quantity, a cent of rounding, and sound lines."""
    q, kind = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 4
    p = F.round(F.col("l_discount") * 100).cast("bigint") * 100 + 1037
    line = F.struct(
        F.lit("x").alias("descripcion"), F.when(kind == 2, q + 3).otherwise(q).cast("double").alias("cantidad"), (p / 100).alias("precio_unitario"),
        F.when(kind == 0, F.lit(None)).when(kind == 3, (q * p + 1) / 100).otherwise(q * p / 100).cast("double").alias("importe_total"))
    fixed = F.get(M.repair_lines(F.array(line)), F.lit(0))
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("e"),
                                      fixed["cantidad"].alias("cantidad"), F.round(fixed["importe_total"], 2).alias("importe_total"))


@query("map_lines", _sql("SELECT k AS doc_id, i AS pos, CASE i WHEN 0 THEN 'Servicio' ELSE 'Material' END AS descripcion, (CASE i WHEN 0 THEN l1 ELSE l2 END)/100 AS importe FROM eng, (SELECT unnest([0,1]) AS i) WHERE n_lines>0"))
def map_lines(d):
    padded = F.concat("lineas", F.array(F.lit(None).cast("struct<descripcion:string,cantidad:double,precio_unitario:double,importe_total:double>")))
    mapped = F.transform(M.map_lines(F.filter(padded, lambda x: x.isNotNull())), lambda x: x)
    blank = F.struct(F.lit(" ").alias("descripcion"), *[F.lit(None).cast("double").alias(c) for c in ("cantidad", "precio_unitario", "importe")])
    kept = M.drop_empty_lines(F.concat(mapped, F.array(blank)))
    return engine(d).select("doc_id", F.posexplode(kept).alias("pos", "l")).select("doc_id", "pos", "l.descripcion", F.round("l.importe", 2).alias("importe"))


@query("withholdings", _sql("SELECT k AS doc_id, 'IRPF' AS withholding_type, 15.0::DOUBLE AS rate, coalesce(b,0)/100 AS taxable_base, ret/100 AS amount FROM eng WHERE ret>0"))
def withholdings(d):
    w = M.withholdings(F.col("retencion_porcentaje"), F.col("base_imponible"), F.col("retencion_importe"))
    return engine(d).select("doc_id", F.inline(w))


@query("field_confidence", _sql("SELECT k AS doc_id, field, round(conf,4) AS conf FROM conf"))
def field_confidence(d):
    return _confidences(d).select("doc_id", F.explode("conf").alias("field", "conf")).withColumn("conf", F.round("conf", 4))


_W = "(" + ",".join(f"('{f}',{w})" for f, w in K.WEIGHTS_ABSENT_SKIPPED.items()) + ")"
_WZ = "(" + ",".join(f"('{f}',{w})" for f, w in K.WEIGHTS_ABSENT_ZERO.items()) + ")"


@query("overall_confidence_absent_skipped", _sql(
    f"""SELECT k AS doc_id, least(0.97, ((2*v + w*100)//(w*200))/10000) AS confianza FROM (SELECT k, sum(CASE WHEN counts THEN c*w10 ELSE 0 END)::BIGINT AS v, sum(CASE WHEN counts THEN w10 ELSE 0 END)::BIGINT AS w FROM (
    SELECT k, round(conf*1000000)::BIGINT AS c, (w*10)::BIGINT AS w10, conf>0 OR field IN ('numero_factura','fecha','total','base_imponible') AS counts FROM conf JOIN (VALUES {_W[1:-1]}) w(f,w) ON f=field) GROUP BY 1)"""))
def overall_confidence_absent_skipped(d):
    return _confidences(d).select("doc_id", CF.overall_absent_skipped(F.col("conf")).alias("confianza"))


@query("overall_confidence_absent_zero", _sql(
    f"SELECT k AS doc_id, round(sum(conf::DECIMAL(10,6)*w),2)::DOUBLE AS confianza FROM conf JOIN (VALUES {_WZ[1:-1]}) w(f,w) ON f=field GROUP BY 1"))
def overall_confidence_absent_zero(d):
    return _confidences(d).select("doc_id", CF.overall_absent_zero(F.col("conf")).alias("confianza"))


@query("field_flags", _sql(
    """SELECT k AS doc_id, coalesce(string_agg(CASE WHEN conf=0 THEN field END, ',' ORDER BY field),'') AS missing, coalesce(string_agg(CASE WHEN conf<>0 AND conf<0.8 THEN field END, ',' ORDER BY field),'') AS inferred,
    coalesce(string_agg(CASE WHEN conf<0.5 AND field<>'lineas' THEN field END, ',' ORDER BY field),'') AS weak, count(*) FILTER (conf<0.8) AS n_warnings FROM conf GROUP BY 1"""))
def field_flags(d):
    c = F.col("conf")
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return _confidences(d).select("doc_id", text(CF.missing_fields(c)).alias("missing"), text(CF.inferred_fields(c)).alias("inferred"),
                                  text(CF.weak_fields(c)).alias("weak"), F.size(CF.flag_warnings(c)).cast("bigint").alias("n_warnings"))


@query("weakest_fields", _sql(
    """SELECT k AS doc_id, coalesce(string_agg(replace(field,'_',' '), ',' ORDER BY p) FILTER (rn<=5),'') AS fields FROM (SELECT e.k, field, p, row_number() OVER (PARTITION BY e.k ORDER BY p) AS rn FROM eng e LEFT JOIN
    (SELECT k, field, list_position(['numero_factura','fecha','proveedor','cif_proveedor','cliente','cif_cliente','base_imponible','iva_porcentaje','iva','total','lineas'], field) AS p, conf FROM conf) c
    ON c.k=e.k AND conf<0.7 AND NOT (tipo='ticket' AND field IN ('cliente','cif_cliente','base_imponible','iva_porcentaje','iva'))) GROUP BY 1"""))
def weakest_fields(d):
    return _confidences(d).select("doc_id", F.array_join(CF.weakest_fields(F.col("conf"), F.col("tipo_factura")), ",").alias("fields"))


@query("merge_confidences", _sql("SELECT k AS doc_id, field, CASE WHEN field='total' THEN 0.11 ELSE round(conf,4) END AS conf FROM conf UNION ALL SELECT k, 'extra', 0.5 FROM eng"))
def merge_confidences(d):
    later = F.create_map(F.lit("total"), F.lit(0.11), F.lit("extra"), F.lit(0.5), F.lit("fecha"), F.lit(None).cast("double"))
    merged = CF.merge_maps(F.col("conf"), later)
    return _confidences(d).select("doc_id", F.explode(merged).alias("field", "conf")).withColumn("conf", F.round("conf", 4))


@query("confidence_tiers", with_views(
    """SELECT id, CASE WHEN confianza_ia*100>=90 THEN 'high' WHEN confianza_ia*100>=70 THEN 'medium' ELSE 'low' END AS tier, confianza_ia<0.85 AS suspicious, round(confianza_ia*100)::BIGINT AS pct FROM facturas""", "facturas"))
def confidence_tiers(d):
    c = F.col("confianza_ia")
    return d.facturas.select("id", CF.confidence_tier(c).alias("tier"), CF.suspicious(c).alias("suspicious"), M.as_percent(F.round(c, 2)).alias("pct"))


def _reviewed(d):
    """Flat invoices for review: engine results with warning codes, flags and job errors at known keys."""
    k = F.col("doc_id")
    flat = NZ.normalize_vision(engine(d), F.lit("compra"))
    flag = F.struct(F.lit("Revisar serie").alias("message"), F.when(k % 28 == 0, "error").otherwise("info").alias("severity"), (k % 14 == 0).alias("requires_review"))
    codes = F.when(k % 3 == 0, F.array(F.lit("discrepancia_total"))).when(k % 3 == 1, F.array(F.lit("iva_x"), F.lit("doc_ai_fallback"))).when(
        k % 6 == 2, F.array(F.lit("doc_ai_fallback_error"))).otherwise(F.array())
    return flat.select(
        "doc_id", "numero_factura", "fecha", "proveedor", F.col("normalized_document.issuer.name").alias("issuer_name"), "cif_proveedor",
        F.when(k % 23 != 0, F.col("base_imponible")).alias("base_imponible"), "iva", "total", "tax_regime", F.col("tipo_factura").alias("document_type"),
        codes.cast("array<string>").alias("warnings"),
        F.when(k % 7 == 0, F.array(flag)).alias("decision_flags"), F.when(k % 31 == 0, "fallo").alias("job_error"), "lineas")


_f = lambda c: f"(({c})/100)::DECIMAL(18,2)::VARCHAR"
_SUM = "CASE WHEN k%6=0 THEN 0 ELSE l1+l2 END"
WARN = f"""SELECT k, p, tone, text FROM (
  SELECT k, 0 AS p, CASE WHEN k%28=0 THEN 'error' WHEN k%14=0 THEN 'warning' ELSE 'info' END AS tone, 'Revisar serie' AS text, k%7=0 AS c FROM eng
  UNION ALL SELECT k,1,'error','{K.MSG_JOB_ERROR}fallo', k%31=0 FROM eng UNION ALL SELECT k,2,'warning','{K.MSG_FALLBACK}', k%3=1 FROM eng
  UNION ALL SELECT k,3,'warning','{K.MSG_FALLBACK_ERROR}', k%6=2 FROM eng
  UNION ALL SELECT k,4,'warning','{K.MSG_NO_NUMBER}', numero='' FROM eng UNION ALL SELECT k,5,'warning','{K.MSG_NO_DATE}', fecha='' FROM eng
  UNION ALL SELECT k,6,'warning','{K.MSG_NO_PARTY}', emisor='' FROM eng UNION ALL SELECT k,7,'info','{K.MSG_NO_TAX_ID}', emisor_nif='' FROM eng
  UNION ALL SELECT k,8,'warning','{K.MSG_BAD_TAX_ID}'.replace('%s','12345'), emisor_nif='12345' FROM eng
  UNION ALL SELECT k,9,'warning','{K.MSG_TOTALS.split('%s')[0]}'||{_f('b')}||'{K.MSG_TOTALS.split('%s')[1]}'||CASE WHEN k%2=0 THEN 'IVA' ELSE 'IGIC' END||'{K.MSG_TOTALS.split('%s')[2]}'||{_f('tax')}||'{K.MSG_TOTALS.split('%s')[3]}'||{_f('total')}||'{K.MSG_TOTALS.split('%s')[4]}', coalesce(abs(b+tax-total)>2,false) FROM eng
  UNION ALL SELECT k,10,'warning','{K.MSG_LINES.split('%s')[0]}'||{_f(_SUM)}||'{K.MSG_LINES.split('%s')[1]}'||{_f('b')}||'{K.MSG_LINES.split('%s')[2]}', coalesce(tipo<>'ticket' AND n_lines>0 AND abs({_SUM}-b)>2,false) FROM eng
  UNION ALL SELECT k,11,'info','{K.MSG_NO_LINES}', n_lines=0 FROM eng UNION ALL SELECT k,12,'info','{K.MSG_RECONCILED}', coalesce(abs(b+tax-total)<=2 AND k%3=0,false) FROM eng
  UNION ALL SELECT k,13,'info','{K.MSG_ADJUSTED}', coalesce(n_lines>0 AND abs({_SUM}-b)<=2 AND k%3=1,false) FROM eng UNION ALL SELECT k,14,'info','{K.MSG_TICKET}', tipo='ticket' FROM eng) WHERE c"""


@query("review_warnings", with_views("SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY p)-1 AS pos, tone, text FROM warn", cents=CENTS, eng=ENG, warn=WARN))
def review_warnings(d):
    r = _reviewed(d)
    return r.select("doc_id", F.posexplode(Q.review_warnings(r)).alias("pos", "w")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "w.tone", "w.text")


@query("panel_tones", with_views(
    "SELECT e.k AS doc_id, CASE WHEN bool_or(tone='error') THEN 'error' WHEN bool_or(tone='warning') THEN 'warning' WHEN count(tone)>0 THEN 'info' ELSE 'success' END AS tone FROM eng e LEFT JOIN warn w ON w.k=e.k GROUP BY 1", cents=CENTS, eng=ENG, warn=WARN))
def panel_tones(d):
    r = _reviewed(d)
    return r.select("doc_id", Q.review_warnings(r).alias("w")).select("doc_id", Q.panel_tone(F.col("w")).alias("tone"))


_RULES = ["decision_flag", "job_error", "fallback", "fallback_error", "no_number", "no_date", "no_party", "no_tax_id", "bad_tax_id", "totals", "lines", "no_lines", "reconciled", "adjusted", "ticket"]


@query("warning_counts", with_views(
    f"SELECT tone, ({_RULES})[p+1] AS rule, count(*) AS n FROM warn GROUP BY 1,2", cents=CENTS, eng=ENG, warn=WARN))
def warning_counts(d):
    """How often each rule warns."""
    r = _reviewed(d)
    return r.select(F.inline(Q.review_warnings(r))).groupBy("tone", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("suspicious_flags", _sql(
    """SELECT k AS doc_id, concat_ws(',', CASE WHEN numero='' THEN 'sin_numero' END, CASE WHEN fecha='' THEN 'sin_fecha' END, CASE WHEN total=0 THEN 'total_cero' END, CASE WHEN tranches=0 THEN 'sin_desglose' END, CASE WHEN n_lines=0 THEN 'sin_lineas' END) AS flags FROM eng"""))
def suspicious_flags(d):
    e = engine(d).withColumnRenamed("fecha_emision", "fecha").withColumnRenamed("total_factura", "total").withColumnRenamed("desglose_impuestos", "tax_breakdown")
    return e.select("doc_id", F.array_join(Q.suspicious_flags(e), ",").alias("flags"))


@query("extraction_report", _sql(
    f"""SELECT count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok AND k%10=0) AS ai_used, round(avg(CASE WHEN ok THEN c END),2) AS avg_conf,
    count(*) FILTER (ok AND side='compra') AS compra, count(*) FILTER (ok AND side='venta') AS venta, count(*) FILTER (ok AND side='unknown') AS "unknown", round(sum(k%7),1)::DOUBLE AS seconds, round(avg(k%7),1) AS avg_seconds
    FROM (SELECT k, k%37<>0 AS ok, (k%100)/100 AS c, {SIDE} AS side FROM eng)"""))
def extraction_report(d):
    e = engine(d)
    side = side_by_ids_and_names(*[F.col(c) for c in ("emisor_nif", "receptor_nif", "emisor_nombre", "receptor_nombre", "company_tax_id", "company_name")])
    runs = e.select((F.col("doc_id") % 37 != 0).alias("ok"), (F.col("prompt_tokens") > 8000).alias("ai_used"), ((F.col("doc_id") % 100) / 100).alias("confianza"),
                    side.alias("side"), (F.col("doc_id") % 7).cast("double").alias("seconds"))
    return D.extraction_report(runs)


@query("engine_comparison", _sql(
    """SELECT count(*) AS n, round(avg(o),4) AS avg_old, round(avg(w),4) AS avg_new, count(*) FILTER (d>1) AS improved, count(*) FILTER (abs(d)<=1) AS same, count(*) FILTER (d<-1) AS worse
    FROM (SELECT k%90 - k%70 AS d, (k%70)/100 AS o, (k%90)/100 AS w FROM eng)"""))
def engine_comparison(d):
    k = F.col("o_orderkey")
    old = d.table("orders").select(k.alias("id"), ((k % 70) / 100).alias("confianza"))
    new = d.table("orders").select(k.alias("id"), ((k % 90) / 100).alias("confianza"))
    return D.compare_engines(old, new)
