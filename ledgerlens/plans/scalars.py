"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import money as M
from ..functions import text as TX
from ..functions.dates import parse_dmy, real_date
from ..functions.taxid import clean_tax_id, loose_format_ok, tax_id_format, tax_id_valid
from .prelude import control, with_views
from .registry import query

_key = lambda: F.col("c_custkey")
_str = lambda c: c.cast("string")
_lit = lambda *xs: F.array(*[F.lit(x) for x in xs])


def _names(d):
    k = _str(_key())
    return d.table("customer").select(
        "c_custkey",
        F.when(_key() % 4 == 0, F.concat(F.lit("Suministros García "), k, F.lit(", S.L.U.")))
        .when(_key() % 4 == 1, F.concat(F.lit(" Pérez  Ü"), k, F.lit(" S.A.")))
        .when(_key() % 4 == 2, F.concat(F.lit("Ñandú; (\""), k, F.lit("\") C.B.")))
        .otherwise("S.L.").alias("name"))


_NAMES = """SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'Suministros García '||c_custkey||', S.L.U.' WHEN 1 THEN ' Pérez  Ü'||c_custkey||' S.A.'
    WHEN 2 THEN 'Ñandú; ("'||c_custkey||'") C.B.' ELSE 'S.L.' END AS name FROM customer"""
_BARE = "regexp_replace(upper(strip_accents(name)),'\\b(?:S\\.?L\\.?U?\\.?|S\\.?A\\.?U?\\.?|S\\.?C\\.?|C\\.?B\\.?)\\b','','g')"


@query("normalize_names", with_views(
    f"""SELECT c_custkey, nullif(trim(regexp_replace(regexp_replace({_BARE},'[.,;:''"]','','g'),'\\s+',' ','g')),'') AS norm,
    trim(regexp_replace(regexp_replace({_BARE},'[.,;:''"()-]',' ','g'),'\\s+',' ','g')) AS side_norm,
    trim(regexp_replace(upper(strip_accents(name)),'[^A-Z0-9]+',' ','g')) AS keyword FROM names""", names=_NAMES))
def normalize_names(d):
    return _names(d).select(
        "c_custkey", TX.normalize_name(F.col("name")).alias("norm"), TX.normalize_for_side(F.col("name")).alias("side_norm"),
        TX.normalize_keyword(F.col("name")).alias("keyword"))


@query("normalize_text", """SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,'[ \\t]+',' ','g'),'\\n{3,}',chr(10)||chr(10),'g'),'^\\s+|\\s+$','','g') AS t FROM documents)""")
def normalize_text(d):
    t = d.table("documents").select("doc_id", TX.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


_C7 = "lpad(c_custkey::VARCHAR,7,'0')"
_C8 = "lpad((c_custkey*7919%100000000)::VARCHAR,8,'0')"
_LET = f"'{K.NIF_LETTERS}'"


@query("taxid_checksum", f"""SELECT c_custkey, shape, f AS format, ok AS valid, loose FROM (
    SELECT c_custkey, unnest(['cif','cif_letter','cif_wrong','nif','nif_wrong','nie','garbage']) AS shape, unnest(['CIF','CIF','CIF','NIF','NIF','NIE',NULL]) AS f,
    unnest([true,true,false,true,false,true,false]) AS ok, unnest([true,true,true,false,false,true,false]) AS loose FROM customer)""")
def taxid_checksum(d):
    """Right and wrong ids of every kind made from the client keys."""
    from ..sources.domain import control_digit

    digits = F.lpad(_str(_key()), 7, "0")
    check = control_digit(digits)
    nif = F.lpad(_str(_key() * 7919 % 100000000), 8, "0")
    letter = lambda n, shift: F.substring(F.lit(K.NIF_LETTERS), ((n + shift) % 23).cast("int") + 1, F.lit(1))
    ids = {
        "cif": F.concat(F.lit("b-"), digits, F.lit(" "), _str(check)),
        "cif_letter": F.concat(F.lit("A"), digits, F.substring(F.lit(K.CIF_CONTROL_LETTERS), check + 1, F.lit(1))),
        "cif_wrong": F.concat(F.lit("B"), digits, _str((check + 1) % 10)),
        "nif": F.concat(nif, letter(nif.cast("bigint"), 0)),
        "nif_wrong": F.concat(nif, letter(nif.cast("bigint"), 5)),
        "nie": F.concat(F.lit("Y"), digits, letter(F.concat(F.lit("1"), digits).cast("bigint"), 0)),
        "garbage": F.concat(F.lit("I"), digits),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("shape"), c.alias("id")) for n, c in ids.items()])
    rows = d.table("customer").select("c_custkey", F.inline(entries))
    return rows.select("c_custkey", "shape", tax_id_format(F.col("id")).alias("format"), tax_id_valid(F.col("id")).alias("valid"),
                       loose_format_ok(clean_tax_id(F.col("id"))).alias("loose"))


def _eu(c: str, thousands: str, point: str) -> str:
    return f"replace(format('{{:,}}', {c}//100), ',', '{thousands}')||'{point}'||lpad(({c}%100)::VARCHAR,2,'0')"


@query("parse_amounts", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c, l_quantity::BIGINT AS q,
    CASE l_partkey%6 WHEN 0 THEN c/100 WHEN 1 THEN c/100 WHEN 2 THEN -c/100 WHEN 3 THEN (c//10)::DOUBLE WHEN 4 THEN 0.0 ELSE c/100 END AS value
    FROM (SELECT *, round(l_extendedprice*100)::BIGINT AS c FROM lineitem)""")
def parse_amounts(d):
    """Every line price written in six ways and read back."""
    from ..sources.render import money_text

    c = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    li = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), c.alias("c"))
    eu = money_text(F.col("c"))
    us = F.translate(eu, ".,", ",.")
    tenths = F.expr("c div 10")
    written = (
        F.when(F.col("l_partkey") % 6 == 0, eu).when(F.col("l_partkey") % 6 == 1, us)
        .when(F.col("l_partkey") % 6 == 2, F.concat(F.lit(" −"), eu, F.lit(" €")))
        .when(F.col("l_partkey") % 6 == 3, F.concat(_str(F.expr("(c div 10) div 10")), F.lit(","), _str(tenths % 10)))
        .when(F.col("l_partkey") % 6 == 4, F.lit("abc")).otherwise(F.concat(F.replace(eu, F.lit("."), F.lit("")), F.lit("EUR"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c", "q", M.parse_amount(written).alias("value"))


_MONTHS = "['" + "','".join(K.MONTHS_ES) + "']"


@query("parse_dates", f"""SELECT o_orderkey, CASE WHEN o_orderkey%5=4 THEN '' WHEN o_orderkey%5=2 THEN '20'||strftime(o_orderdate,'%y-%m-%d') ELSE strftime(o_orderdate,'%Y-%m-%d') END AS iso,
    CASE WHEN o_orderkey%5=4 THEN NULL WHEN o_orderkey%5=2 THEN '20'||strftime(o_orderdate,'%y-%m-%d') ELSE strftime(o_orderdate,'%Y-%m-%d') END AS calendar FROM orders""")
def parse_dates(d):
    dt = F.col("o_orderdate")
    day, month, year = (_str(f(dt)) for f in (F.dayofmonth, F.month, F.year))
    name = F.element_at(_lit(*K.MONTHS_ES), F.month(dt))
    k = F.col("o_orderkey") % 5
    written = (
        F.when(k == 0, F.concat_ws("/", day, month, year)).when(k == 1, F.concat_ws("-", day, month, year))
        .when(k == 2, F.concat_ws(".", day, month, F.substring(year, 3, 2)))
        .when(k == 3, F.concat(F.lit("Madrid, a "), day, F.lit(" de "), F.upper(name), F.lit(" de "), year)).otherwise("32/01/2024"))
    iso = parse_dmy(written)
    # a two-digit year is of this century; 29 February may then not exist
    return d.table("orders").select("o_orderkey", iso.alias("iso"), _str(real_date(F.nullif(iso, F.lit("")))).alias("calendar"))


_TAX = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, b, ([0,4,7,10,21])[(l_partkey%5+1)::INT] AS r,
    CASE l_suppkey%4 WHEN 0 THEN 0 WHEN 1 THEN (b*21+50)//100 WHEN 2 THEN (b*7+50)//100 ELSE (b*([0,4,7,10,21])[(l_partkey%5+1)::INT]+50)//100 END AS t, l_suppkey%3 AS m
    FROM (SELECT *, CASE WHEN l_linenumber=7 THEN 0 ELSE round(l_extendedprice*100)::BIGINT END AS b FROM lineitem)"""
_TAX2 = "SELECT *, CASE WHEN m=0 THEN 0 WHEN m=1 THEN b+t ELSE b+t+(b//10) END AS tot FROM tax0"


def _tax_rows(d):
    b = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.round(F.col("l_extendedprice") * 100)).cast("bigint")
    base = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), b.alias("b"))
    base = base.withColumn("r", F.element_at(_lit(0, 4, 7, 10, 21), (F.col("l_partkey") % 5 + 1).cast("int")).cast("bigint"))
    share = lambda r: F.expr(f"(b * {r} + 50) div 100")
    kind = F.col("l_suppkey") % 4
    base = base.withColumn("t", F.when(kind == 0, 0).when(kind == 1, share("21")).when(kind == 2, share("7")).otherwise(share("r")))
    m = F.col("l_suppkey") % 3
    return base.withColumn("tot", F.when(m == 0, 0).when(m == 1, F.col("b") + F.col("t")).otherwise(F.expr("b + t + (b div 10)")))


@query("tax_score", with_views(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, round(CASE WHEN b<=0 AND tot<=0 THEN 0.0 ELSE
    CASE WHEN t<>0 AND e<>0 AND abs(e-t)*50<=greatest(500,e) THEN 0.5 WHEN t=0 AND e=0 THEN 0.3 ELSE 0.0 END
    + CASE WHEN tot<>0 AND abs(b+t-tot)*50<=greatest(500,tot) THEN 0.5 WHEN tot=0 THEN 0.1 ELSE 0.0 END END::DOUBLE, 2) AS score
    FROM (SELECT *, (b*r+50)//100 AS e FROM tax1)""", tax0=_TAX, tax1=_TAX2))
def tax_score(d):
    e = lambda c: F.col(c) / 100
    return _tax_rows(d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", M.tax_score(e("b"), F.col("r"), e("t"), e("tot")).alias("score"))


@query("infer_missing", with_views(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, (CASE WHEN b=0 AND tot<>0 AND t2<>0 THEN tot-t2 ELSE b END)/100 AS base,
    CASE WHEN r=0 AND t2<>0 AND b>1 THEN round(t2/b*100,2) ELSE r::DOUBLE END AS rate, t2/100 AS tax, (CASE WHEN tot=0 AND (b<>0 OR t2<>0) THEN b+t2 ELSE tot END)/100 AS total
    FROM (SELECT *, CASE WHEN t=0 AND b<>0 AND r<>0 THEN (b*r+50)//100 ELSE t END AS t2 FROM tax1)""", tax0=_TAX, tax1=_TAX2))
def infer_missing(d):
    e = lambda c: F.col(c) / 100
    got = _tax_rows(d).withColumn("x", M.infer_missing(e("b"), F.col("r"), e("t"), e("tot")))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "x.base", "x.rate", "x.tax", "x.total")


@query("clamp_and_round", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, CASE WHEN abs(l_extendedprice*l_quantity)<=999999 THEN round(l_extendedprice*l_quantity,2) END AS stored,
    abs(l_extendedprice - floor(l_extendedprice)) <= 0.5 AS near FROM lineitem""")
def clamp_and_round(d):
    x = F.col("l_extendedprice") * F.col("l_quantity")
    return d.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"),
        M.round2(M.clamp(x, 999999)).cast("double").alias("stored"), M.approx_eq(F.col("l_extendedprice"), F.floor("l_extendedprice"), 0.5).alias("near"))


@query("percent_and_milestone", """SELECT o_orderkey, floor((o_orderkey%101)+0.5)::BIGINT AS pct, coalesce((SELECT min(m) FROM (SELECT unnest([50,100,250,500,1000,2500,5000,10000,25000,50000,100000]) AS m) WHERE m>o_orderkey*9), greatest(100000,(o_orderkey*9//1000+1)*1000))::BIGINT AS next FROM orders""")
def percent_and_milestone(d):
    k = F.col("o_orderkey")
    return d.table("orders").select("o_orderkey", M.as_percent((k % 101) / 100.0).alias("pct"), M.next_milestone(k * 9, K.BILLING_MILESTONES).alias("next"))


_CODES = {0: "linea_3_importe", 1: "doc_ai_fallback_error_x", 2: "doc_ai_fallback", 3: "discrepancia_total", 4: "region_hint_rescue_applied", 5: "familia_ticket_1",
          6: "familia_rectificativa_2", 7: "lineas_sumadas", 8: "iva_corregido", 9: "retencion_vista", 10: "proveedor_nif", 11: "cif_cliente_no_valido", 12: "cif_x", 13: "numero_factura_leido", 14: "otro", 15: " "}
_GROUPS = {0: "line_item_adjustment", 1: "doc_ai_fallback_error", 2: "doc_ai_fallback", 3: "source_discrepancy", 4: "region_rescue", 5: "ticket_interpretation",
           6: "document_role_adjustment", 7: "line_item_adjustment", 8: "amount_adjustment", 9: "withholding_adjustment", 10: "party_adjustment", 11: "tax_id_validation", 12: "party_adjustment",
           13: "identity_adjustment", 14: "otro", 15: ""}
_PICKS = ("event_id%16", "(event_id*7+3)%16", "user_id%16", "event_id%16")


_GROUP_SQL = ",".join("([" + ",".join(f"'{g}'" for g in _GROUPS.values()) + f"])[({p}+1)::INT]" for p in _PICKS)


@query("warning_groups", f"""SELECT e.event_id, coalesce(groups,'') AS groups FROM events e LEFT JOIN (
    SELECT event_id, string_agg(','||g, '' ORDER BY p) AS groups FROM (SELECT event_id, g, min(p) AS p FROM (
    SELECT event_id, unnest([{_GROUP_SQL}]) AS g, unnest([1,2,3,4]) AS p FROM events) WHERE g<>'' GROUP BY 1,2) GROUP BY 1) x USING (event_id)""")
def warning_groups(d):
    pick = lambda e: F.element_at(_lit(*_CODES.values()), (F.expr(e) + 1).cast("int"))
    codes = F.array(*[pick(p) for p in _PICKS])
    return d.table("events").select("event_id", F.concat_ws("", F.transform(TX.warning_groups(codes), lambda g: F.concat(F.lit(","), g))).alias("groups"))


@query("invoice_numbers", """SELECT o_orderkey, k, valid, CASE WHEN valid THEN clean END AS clean FROM (SELECT o_orderkey, unnest(range(7)) AS k, unnest([true,true,false,false,false,false,false]) AS valid,
    unnest(['FI-'||o_orderkey||' A', o_orderkey||'/2026', NULL, NULL, NULL, NULL, NULL]) AS clean FROM orders) WHERE k<>1 OR o_orderkey>=0""")
def invoice_numbers(d):
    k = _str(F.col("o_orderkey"))
    forms = F.array(
        F.concat(F.lit(" FI-"), k, F.lit("  A. ")), F.concat(k, F.lit("/2026 FECHA")), F.lit("SIN NUMERO"), F.concat(F.lit("B-"), F.lpad(k, 7, "0"), F.lit("1")),
        F.concat(F.lit("TOTAL "), k), F.concat(F.lit("Página "), k, F.lit(" de 9")), F.rpad(k, 31, "0"))
    rows = d.table("orders").select("o_orderkey", F.posexplode(forms).alias("k", "v"))
    ok = TX.invoice_number_valid(F.trim("v"))
    return rows.select("o_orderkey", F.col("k").cast("bigint").alias("k"), ok.alias("valid"), F.when(ok, TX.clean_invoice_number(F.col("v"))).alias("clean"))


@query("json_replies", """SELECT event_id, event_id%3<>2 AS readable, CASE WHEN event_id%3<>2 THEN (props::JSON->>'k')::BIGINT END AS k FROM events""")
def json_replies(d):
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Aqui va:\n```json\n"), F.col("props"), F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("Resultado "), F.col("props"), F.lit(" fin"))).otherwise("nada")
    parsed = F.try_parse_json(TX.unfence_json(fenced))
    return d.table("events").select("event_id", parsed.isNotNull().alias("readable"), F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query("id_lists", """SELECT c_custkey, CASE WHEN c_custkey%3=2 THEN 'x' ELSE 'B'||c_custkey||'|A'||c_custkey END AS ids FROM customer""")
def id_lists(d):
    k = _str(_key())
    raw = F.when(_key() % 3 == 0, F.concat(F.lit('["B'), k, F.lit('", "A'), k, F.lit('", ""]'))).when(
        _key() % 3 == 1, F.concat(F.lit(" B"), k, F.lit(" ,, A"), k)).otherwise("x,")
    return d.table("customer").select("c_custkey", F.array_join(TX.id_list(raw), "|").alias("ids"))


@query("rate_sets", """SELECT o_orderkey, rate, rate IN (4,10,21) AS is_iva, rate IN (0,3,5,7,9.5,15) AND rate NOT IN (4,10,21) AS igic_only FROM (SELECT o_orderkey, ([0,3,4,5,7,9.5,10,15,21,22])[(o_orderkey%10+1)::INT]::DOUBLE AS rate FROM orders)
    WHERE rate IN (0,3,4,5,7,9.5,10,15,21)""")
def rate_sets(d):
    """Known rates of the union, and which of them only the second regime has."""
    iva, igic = _lit(*K.IVA_RATES), _lit(*K.IGIC_RATES)
    rate = F.element_at(_lit(0.0, 3.0, 4.0, 5.0, 7.0, 9.5, 10.0, 15.0, 21.0, 22.0), (F.col("o_orderkey") % 10 + 1).cast("int"))
    r = d.table("orders").select("o_orderkey", rate.alias("rate"))
    return r.filter(F.array_contains(F.array_union(iva, igic), F.col("rate"))).select(
        "o_orderkey", "rate", F.array_contains(iva, F.col("rate")).alias("is_iva"), F.array_contains(F.array_except(igic, iva), F.col("rate")).alias("igic_only"))


@query("document_rates", """SELECT o_orderkey, string_agg(r::VARCHAR, ',' ORDER BY p) AS rates FROM (SELECT o_orderkey, r, min(p) AS p FROM (SELECT o_orderkey, unnest([a,b,a]) AS r, unnest([1,2,3]) AS p FROM
    (SELECT o_orderkey, ([3,4,7,10,21])[(o_orderkey%5+1)::INT] AS a, ([5,15,99,21])[(o_custkey%4+1)::INT] AS b FROM orders)) WHERE r<>99 GROUP BY 1,2) GROUP BY 1""")
def document_rates(d):
    from ..operators.extraction.amounts import document_rates as rates

    a = F.element_at(_lit(3, 4, 7, 10, 21), (F.col("o_orderkey") % 5 + 1).cast("int"))
    b = F.element_at(_lit(5, 15, 99, 21), (F.col("o_custkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("IVA "), _str(a), F.lit("%\nIRPF "), _str(b), F.lit(",00 %\notra vez "), _str(a), F.lit(" %"))
    got = d.table("orders").select("o_orderkey", text.alias("text"))
    return got.select("o_orderkey", F.array_join(F.transform(rates(), lambda r: _str(r.cast("int"))), ",").alias("rates"))
