"""Rules that ordinary rows of the tables do not reach: limits, scopes, broken rows, rare kinds of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.forms import nfc, nfd, nfkc
from ..functions.text import clean_markdown, document_type, normalize_text
from ..operators import audit as A
from ..operators import checks as C
from ..operators import invoices as I
from ..operators import parties as P
from ..operators import uploads as U
from ..operators.extraction import assemble as X
from ..operators.extraction.common import pin
from ..operators.extraction import fields as FI
from ..operators.extraction import lines as LI
from .lists import JOINED, LATEST_DOC
from ..sources.domain import spread
from .prelude import with_views
from .registry import duck_ts, query, ts


@query("request_limits", with_views(
    f"""SELECT doc_id, k AS request, n AS n_files, n<={K.MAX_FILES_PER_REQUEST} AS request_ok, coalesce(tamano_bytes>0 AND tamano_bytes*10<={K.MAX_ENGINE_BYTES}, false) AS engine_ok FROM (
    SELECT *, count(*) OVER (PARTITION BY k) AS n FROM (SELECT *, batch_id||'-'||(CASE WHEN doc_id//20%4=0 THEN 0 ELSE 1 END)::VARCHAR AS k FROM uploads))""", "uploads"))
def request_limits(d):
    """A quarter of a batch's files against the rest of them, as two requests; sizes times ten against the engine."""
    part = F.when(F.floor(F.col("doc_id") / 20) % 4 == 0, "0").otherwise("1")
    files = d.uploads.select("doc_id", F.concat_ws("-", "batch_id", part).alias("request"), (F.col("tamano_bytes") * 10).alias("tamano_bytes"))
    return U.engine_admits(U.admit_requests(files, "request")).select("doc_id", "request", "n_files", "request_ok", "engine_ok")


@query("audit_trail_of_one", with_views(
    f"""SELECT a.id, u.nombre AS usuario_nombre, a.accion, {duck_ts('a.created_at')} AS created_at, row_number() OVER (ORDER BY a.created_at DESC, a.id DESC) AS posicion
    FROM auditoria a LEFT JOIN usuarios u ON a.usuario_id=u.id WHERE a.factura_id=3""", "auditoria", "usuarios"))
def audit_trail_of_one(d):
    return A.audit_trail(d.auditoria, d.usuarios, 3).select("id", "usuario_nombre", "accion", ts("created_at").alias("created_at"), "posicion")


@query("audit_trail_long", with_views(
    "SELECT id, factura_id%5 AS factura_id, row_number() OVER (PARTITION BY factura_id%5 ORDER BY created_at DESC, id DESC) AS posicion FROM auditoria", "auditoria"))
def audit_trail_long(d):
    """The whole log as five trails: positions run over many days of each."""
    folded = d.auditoria.withColumn("factura_id", F.col("factura_id") % 5)
    return A.audit_trail(folded, d.usuarios).select("id", "factura_id", "posicion")


@query("invoices_of_batch", with_views(
    "SELECT id, cliente_id, documento_batch_id AS batch_id FROM joined WHERE cliente_id%10=7 AND documento_batch_id='src1'",
    "facturas_p", "clientes", "documentos", ld=LATEST_DOC, joined=JOINED))
def invoices_of_batch(d):
    """Filters by client and batch; ten clients share one key, so that the client filter finds some."""
    folded = d.facturas_con_proveedor.withColumn("_own", F.col("cliente_id"))
    found = I.InvoiceQuery(batch="src1").matching(folded, d.clientes, d.documentos)
    some = I.filter_invoices(found.withColumn("cliente_id", F.col("_own") % 10), company=7)
    return some.select("id", F.col("_own").alias("cliente_id"), F.col("documento_batch_id").alias("batch_id"))


@query("invoices_of_users", with_views(
    """SELECT 'empresa' AS quien, f.id FROM facturas f JOIN clientes c ON c.id=f.cliente_id WHERE f.cliente_id=(SELECT min(cliente_id) FROM facturas)
    UNION ALL SELECT 'asesoria', f.id FROM facturas f JOIN clientes c ON c.id=f.cliente_id WHERE c.asesoria_id=7 UNION ALL SELECT 'ajena', f.id FROM facturas f WHERE false""",
    "facturas", "clientes"))
def invoices_of_users(d):
    """Rows a company user, a firm user and a user of a company of another firm may see."""
    rows = I.with_client(d.facturas, d.clientes)
    first = d.facturas.agg(F.min("cliente_id").alias("m")).first()["m"]
    firm = d.clientes.filter(F.col("id") == first).select("asesoria_id").first()["asesoria_id"]
    seen = {"empresa": I.scope_to_user(rows, "EMPRESA", firm, first), "asesoria": I.scope_to_user(rows, "ASESORIA", 7, None),
            "ajena": I.scope_to_user(rows, "EMPRESA", firm + 1, first)}
    out = [df.select(F.lit(who).alias("quien"), "id") for who, df in seen.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_BROKEN = {
    "bf": "SELECT id, CASE WHEN id%107=0 THEN -1 ELSE cliente_id END AS cliente_id, CASE WHEN id%101=0 THEN 'XX' ELSE estado END AS estado FROM facturas",
    "bc": "SELECT id, CASE WHEN id%17=0 THEN NULL ELSE estado END AS estado FROM clientes",
    "bu": "SELECT id, CASE WHEN id%8=0 THEN 'XX' ELSE rol END AS rol, tipo_usuario, CASE WHEN id%15=4 THEN NULL ELSE cliente_id END AS cliente_id FROM usuarios",
    "bd": "SELECT id, CASE WHEN id%23=0 THEN -1 ELSE factura_id END AS factura_id, CASE WHEN id%19=0 THEN 'fax' ELSE canal_entrada END AS canal FROM documentos",
    "bj": "SELECT id, CASE WHEN id%29=0 THEN -1 ELSE factura_id END AS factura_id, CASE WHEN id%103=0 THEN 'XX' ELSE estado END AS estado FROM jobs",
    "ba": "SELECT id, CASE WHEN id%31=0 THEN -1 ELSE usuario_id END AS usuario_id FROM auditoria",
}


@query("schema_checks", with_views(
    """SELECT 'facturas' AS tabla, 'estado' AS regla, (SELECT count(*) FROM bf WHERE estado='XX') AS n_bad
    UNION ALL SELECT 'processing_jobs','estado',(SELECT count(*) FROM bj WHERE estado='XX')
    UNION ALL SELECT 'clientes','estado',(SELECT count(*) FROM bc WHERE estado IS NULL)
    UNION ALL SELECT 'documentos_subidos','canal',(SELECT count(*) FROM bd WHERE canal='fax')
    UNION ALL SELECT 'usuarios','empresa_cliente',(SELECT count(*) FROM bu WHERE tipo_usuario='EMPRESA' AND cliente_id IS NULL)
    UNION ALL SELECT 'usuarios','rol',(SELECT count(*) FROM bu WHERE rol='XX')
    UNION ALL SELECT 'facturas','fk_cliente',(SELECT count(*) FROM bf WHERE cliente_id NOT IN (SELECT id FROM bc))
    UNION ALL SELECT 'documentos_subidos','fk_factura',(SELECT count(*) FROM bd WHERE factura_id NOT IN (SELECT id FROM bf))
    UNION ALL SELECT 'processing_jobs','fk_factura',(SELECT count(*) FROM bj WHERE factura_id NOT IN (SELECT id FROM bf))
    UNION ALL SELECT 'auditoria','fk_usuario',(SELECT count(*) FROM ba WHERE usuario_id NOT IN (SELECT id FROM bu))
    UNION ALL SELECT 'usuarios','fk_cliente',(SELECT count(*) FROM bu WHERE cliente_id IS NOT NULL AND cliente_id NOT IN (SELECT id FROM bc WHERE id%3<>0))""",
    "facturas", "clientes", "usuarios", "documentos", "jobs", "auditoria", **_BROKEN))
def schema_checks(d):
    """All eleven rules over tables with broken rows at known keys."""
    key = F.col("id")

    def broken(df, **at):
        return df.withColumns({c: F.when(key % n == r, F.lit(v)).otherwise(F.col(c)) for c, (n, r, v) in at.items()})

    users = broken(d.usuarios, rol=(8, 0, "XX"), cliente_id=(15, 4, None))
    args = (broken(d.facturas, estado=(101, 0, "XX"), cliente_id=(107, 0, -1)), broken(d.clientes, estado=(17, 0, None)), users,
            broken(d.documentos, factura_id=(23, 0, -1), canal_entrada=(19, 0, "fax")), broken(d.jobs, factura_id=(29, 0, -1), estado=(103, 0, "XX")),
            broken(d.auditoria, usuario_id=(31, 0, -1)))
    bad = C.schema_report(*args)
    # users are checked against a client table with a third missing, so that orphans exist
    thin = C.schema_report(args[0], d.clientes.filter("id % 3 <> 0"), *args[2:])
    last = (F.col("tabla") == "usuarios") & (F.col("regla") == "fk_cliente")
    return bad.filter(~last).unionByName(thin.filter(last))


_KNOWN = "SELECT id, nombre, CASE WHEN id%3<>0 THEN cif END AS cif, cif AS whole FROM proveedores"


def _filled(d):
    """Suppliers of which a third has no cif, and parties that name each with its cif."""
    known = d.proveedores.select("id", "nombre", F.when(F.col("id") % 3 != 0, F.col("cif")).alias("cif"))
    named = d.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("id")).join(d.proveedores, "id")
    parties = named.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), "nombre", "cif")
    return P.resolve_suppliers(parties, known)


@query("supplier_fill", with_views(
    "SELECT id, nombre, CASE WHEN id IN (SELECT l_suppkey FROM lineitem) THEN whole ELSE cif END AS cif FROM known", "proveedores", known=_KNOWN))
def supplier_fill(d):
    """A match by name fills the missing cif."""
    return _filled(d)[1]


@query("supplier_mapping", with_views(
    "SELECT DISTINCT nombre, whole AS cif, id AS proveedor_id, false AS is_new FROM known WHERE id IN (SELECT l_suppkey FROM lineitem)", "proveedores", known=_KNOWN))
def supplier_mapping(d):
    return _filled(d)[0].select("nombre", "cif", "proveedor_id", "is_new")


_KIND = "CASE o_orderkey%4 WHEN 0 THEN 'rectificativa' WHEN 1 THEN 'ticket' ELSE 'factura' END"


def _kinds(d):
    """Short texts of every kind: corrections that name what they correct, tickets, regimes named or told by the rate."""
    key = F.col("o_orderkey")
    number = F.lpad(key.cast("string"), 8, "0")
    head = F.when(key % 4 == 0, F.concat(F.lit("FACTURA RECTIFICATIVA\nRectifica a la factura: FO2025"), number)).when(key % 4 == 1, F.lit("TICKET DE COMPRA")).otherwise(F.lit("FACTURA"))
    tax = F.when(key % 3 == 0, "IVA 21%").when(key % 3 == 1, "IGIC 7%").otherwise("Cuota")
    return spread(d.table("orders").select("o_orderkey"), "o_orderkey").select(key.alias("doc_id"), F.concat_ws("\n", head, F.concat(F.lit("Factura Nº: FR2026"), number), tax).alias("text"),
                                    F.element_at(F.array(*[F.lit(float(r)) for r in (21, 7, 3, 0, 99)]), (key % 5 + 1).cast("int")).alias("rate"))


@query("document_kinds", f"""SELECT o_orderkey AS doc_id, {_KIND} AS document_type, CASE o_orderkey%3 WHEN 0 THEN 'iva' WHEN 1 THEN 'igic'
    ELSE (['iva','igic','igic','zero','unknown'])[(o_orderkey%5+1)::INT] END AS tax_regime FROM orders""".replace("'zero'", "CASE WHEN 0 IN ({}) AND 0 NOT IN ({}) THEN 'igic' WHEN 0 IN ({}) THEN 'iva' ELSE 'unknown' END".format(
        ",".join(map(str, K.IGIC_RATES)), ",".join(map(str, K.IVA_RATES)), ",".join(map(str, K.IVA_RATES)))))
def document_kinds(d):
    t = _kinds(d).withColumn("lowered", F.lower("text"))
    return t.select("doc_id", document_type(F.col("lowered")).alias("document_type"), X.tax_regime(F.col("lowered"), F.col("rate")).alias("tax_regime"))


@query("rectified_numbers", """SELECT o_orderkey AS doc_id, 'FR2026'||lpad(o_orderkey::VARCHAR,8,'0') AS numero_factura,
    CASE WHEN o_orderkey%4=0 THEN 'FO2025'||lpad(o_orderkey::VARCHAR,8,'0') ELSE '' END AS rectified_invoice_number FROM orders""")
def rectified_numbers(d):
    found = FI.identity(FI.with_fields(LI.scan_lines(_kinds(d).select("doc_id", "text"))))
    return found.select("doc_id", "numero_factura", "rectified_invoice_number")


@query("normalize_forms", """SELECT doc_id, md5(nfc_normalize(text)) AS composed, length(nfc_normalize(text)) AS n, md5(nfc_normalize(text)) AS folded FROM documents""")
def normalize_forms(d):
    """Every text taken apart into letters and marks, then put together as it is, and with wide vowels and ligatures in it."""
    apart = pin(d.table("documents").select("doc_id", "text"), apart=nfd(F.col("text")))
    wide = F.translate(F.replace("apart", F.lit("st"), F.lit("\ufb06")), "aeiouAEIOU", "".join(chr(ord(c) + 0xFEE0) for c in "aeiouAEIOU"))
    told = pin(pin(apart, wide=wide), whole=nfc(F.col("apart")), folded=nfkc(F.col("wide")))
    return told.select("doc_id", F.md5(F.col("whole").cast("binary")).alias("composed"), F.length("whole").cast("bigint").alias("n"), F.md5(F.col("folded").cast("binary")).alias("folded"))


def _cleaned_sql(c: str) -> str:
    """The marks taken out one kind after the other, then the rules between lines."""
    for pattern, kept in ((r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}(.+?)\*{1,3}", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[[^\]]*\]\([^)]+\)", "")):
        c = f"regexp_replace({c}, '{pattern}', '{kept}', 'g')"
    return rf"array_to_string([x FOR x IN string_split({c}, chr(10)) IF NOT regexp_matches(x, '^[-*_]{{3,}}\s*$')], chr(10))"


@query("clean_pages", f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {_cleaned_sql('html')} AS t FROM pages)")
def clean_pages(d):
    """Marks in the whole text of every page."""
    t = pin(d.table("pages").select("page_id", "html"), t=clean_markdown(F.col("html")))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


_MARKED = "'## '||replace(replace(text, ' the ', ' **the** '), ' de ', ' [de](http://x/y) ')||chr(10)||'---'||chr(10)||'*'||source||'* ![img](a.png) '||lang"


@query("clean_documents", f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_cleaned_sql(_MARKED)} AS t FROM documents)")
def clean_documents(d):
    """Whole documents with marks put into their texts, lines and margins."""
    docs = d.table("documents").select("doc_id", F.expr(_MARKED.replace("chr(10)", "'\n'")).alias("md"))
    t = pin(docs, t=clean_markdown(F.col("md")))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))