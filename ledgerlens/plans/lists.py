"""Invoice list, search, detail, audit and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import audit as A
from ..operators import dashboard as D
from ..operators import invoices as I
from ..operators import latency as L
from ..streaming.core import shared_folder
from .prelude import with_views
from .registry import duck_ts, query, ts

LATEST_JOB = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factura_id ORDER BY created_at DESC, id DESC) rn FROM jobs) WHERE rn=1"""
LATEST_DOC = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factura_id ORDER BY fecha_subida DESC, id DESC) rn FROM documentos) WHERE rn=1"""
JOINED = """SELECT f.*, c.nombre AS cliente_nombre, c.cif AS cliente_cif, c.asesoria_id,
    d.id AS documento_id, d.batch_id AS documento_batch_id, d.canal_entrada AS documento_canal_entrada,
    d.fecha_subida AS documento_fecha_subida, d.nombre_archivo AS documento_nombre_archivo
    FROM facturas_p f LEFT JOIN clientes c ON f.cliente_id=c.id LEFT JOIN ld d ON d.factura_id=f.id"""

PAGE_COLS = ["id", "cliente_id", "estado", "numero_factura", "proveedor_nombre", "total", "cliente_nombre", "cliente_cif",
             "documento_id", "documento_nombre_archivo", "job_id", "job_estado", "job_retry_count"]


def _page(d, q):
    """A page that neither filters nor sorts by supplier: supplier names are looked up for its rows."""
    page = q.run(_blank(d.facturas), d.clientes, d.documentos, d.jobs)
    suppliers = d.supplier_of_first_line(I.rows_of_page(d.table("lineitem"), page, "l_orderkey"))
    df = page.join(suppliers, "id", "left")
    return df.select(*PAGE_COLS, ts("created_at").alias("created_at"), ts("job_created_at").alias("job_created_at"))


def _page_sql(where: str, order: str, limit: str) -> str:
    cols = "id, cliente_id, estado, numero_factura, proveedor_nombre, total, cliente_nombre, cliente_cif, documento_id, documento_nombre_archivo"
    return with_views(
        f"""SELECT p.*, j.id AS job_id, j.estado AS job_estado, j.retry_count AS job_retry_count,
        {duck_ts('j.created_at')} AS job_created_at FROM (
        SELECT {cols}, {duck_ts('created_at')} AS created_at FROM joined WHERE {where} ORDER BY {order} {limit}) p
        LEFT JOIN lj j ON j.factura_id=p.id""",
        "facturas_p", "clientes", "documentos", "jobs", ld=LATEST_DOC, joined=JOINED, lj=LATEST_JOB)


def _blank(invoices):
    return invoices.withColumn("numero_correlativo", F.lit(None).cast("bigint")).withColumn(
        "fecha_procesado", F.lit(None).cast("timestamp_ntz"))


def _listed(d):
    return _blank(d.facturas_con_proveedor), d.clientes, d.documentos, d.jobs


@query("invoice_page", _page_sql("asesoria_id=7", "created_at DESC, id DESC", "LIMIT 20"))
def invoice_page(d):
    return _page(d, I.InvoiceQuery(asesoria=7))


@query("invoice_page_by_total", _page_sql("asesoria_id=7 AND estado='VALIDADA'", "total ASC NULLS LAST, created_at DESC, id DESC", "LIMIT 20 OFFSET 20"))
def invoice_page_by_total(d):
    return _page(d, I.InvoiceQuery(asesoria=7, estado="VALIDADA", sort_by="total", sort_dir="asc", page=2))


@query("invoice_page_by_channel", _page_sql("documento_canal_entrada='mobile_camera'", "documento_fecha_subida DESC NULLS FIRST, created_at DESC, id DESC", "LIMIT 50"))
def invoice_page_by_channel(d):
    return _page(d, I.InvoiceQuery(channel="mobile_camera", sort_by="fecha_subida", limit=50))


@query("invoice_page_seek", _page_sql("asesoria_id=7", "created_at DESC NULLS FIRST, id DESC", "LIMIT 20 OFFSET 40"))
def invoice_page_seek(d):
    """The third page, sought behind the last row of the second."""
    listed = I.InvoiceQuery(asesoria=7).matching(_blank(d.facturas), d.clientes, d.documentos)
    last = None
    for _ in range(2):  # what a reader of the list has seen: twenty rows at a time
        last = (I.seek_page(listed, last).select("id", "created_at").tail(1) or [last])[0]
    return _page(d, I.InvoiceQuery(asesoria=7, after=last))


@query("invoice_page_seek_by_total", _page_sql("asesoria_id=7 AND estado='VALIDADA'", "total ASC NULLS LAST, created_at DESC NULLS FIRST, id DESC", "LIMIT 10 OFFSET 10"))
def invoice_page_seek_by_total(d):
    kw = dict(asesoria=7, estado="VALIDADA", sort_by="total", sort_dir="asc", limit=10)
    listed = I.InvoiceQuery(**kw).matching(_blank(d.facturas), d.clientes, d.documentos)
    last = I.seek_page(listed, None, "total", "asc", 10).select("id", "created_at", "total").tail(1)
    return _page(d, I.InvoiceQuery(**kw, after=last[0] if last else None))


@query("invoice_page_total", with_views(
    "SELECT count(*) AS total FROM joined WHERE asesoria_id=7 AND estado='VALIDADA'",
    "facturas_p", "clientes", "documentos", ld=LATEST_DOC, joined=JOINED))
def invoice_page_total(d):
    inv, cli, doc = d.facturas, d.clientes, d.documentos
    return I.page_total(I.InvoiceQuery(asesoria=7, estado="VALIDADA").matching(inv, cli, doc))


_TEXT = """(coalesce(numero_factura,'') ILIKE '%{t}%' OR coalesce(proveedor_nombre,'') ILIKE '%{t}%'
    OR coalesce(cliente_nombre,'') ILIKE '%{t}%' OR coalesce(documento_nombre_archivo,'') ILIKE '%{t}%')"""


@query("invoice_search_text", with_views(
    "SELECT id, numero_factura, proveedor_nombre, cliente_nombre, documento_nombre_archivo FROM joined WHERE " + _TEXT.format(t="er#0000000_7"),
    "facturas_p", "clientes", "documentos", ld=LATEST_DOC, joined=JOINED))
def invoice_search_text(d):
    """Every match, whole table; ``_`` is a wildcard as in the pattern language."""
    inv, cli, doc, _ = _listed(d)
    return I.InvoiceQuery(search="er#0000000_7").matching(inv, cli, doc).select(
        "id", "numero_factura", "proveedor_nombre", "cliente_nombre", "documento_nombre_archivo")


@query("invoice_search_code", with_views(
    """SELECT j.id, n.numero_correlativo FROM joined j JOIN (SELECT id, row_number() OVER (PARTITION BY cliente_id ORDER BY created_at, id) AS numero_correlativo
       FROM facturas) n USING (id) WHERE numero_correlativo=7 OR id=7 OR """ + _TEXT.format(t="DOC-000007"),
    "facturas_p", "clientes", "documentos", ld=LATEST_DOC, joined=JOINED))
def invoice_search_code(d):
    from ..operators.numbering import backfill_correlative

    inv = backfill_correlative(d.facturas_con_proveedor)
    return I.InvoiceQuery(search="DOC-000007").matching(inv, d.clientes, d.documentos).select("id", "numero_correlativo")


@query("invoice_detail", with_views(
    f"""SELECT f.id, f.estado, f.confianza_ia, f.validado_por, u.nombre AS validado_por_nombre, {duck_ts('f.created_at')} AS created_at,
    f.cliente_id AS empresa_id, c.nombre AS empresa_nombre, c.cif AS empresa_cif, c.asesoria_id
    FROM facturas f LEFT JOIN clientes c ON f.cliente_id=c.id LEFT JOIN usuarios u ON f.validado_por=u.id""",
    "facturas", "clientes", "usuarios"))
def invoice_detail(d):
    detail = I.invoice_detail(I.with_reviewer(d.facturas, d.clientes, d.usuarios))
    return detail.select(
        "id", "estado", "confianza_ia", "validado_por", "validado_por_nombre", ts("created_at").alias("created_at"),
        F.col("empresa_asociada.id").alias("empresa_id"), F.col("empresa_asociada.nombre").alias("empresa_nombre"),
        F.col("empresa_asociada.cif").alias("empresa_cif"), "asesoria_id")


@query("latest_job", with_views(
    f"""SELECT f.id, j.id AS job_id, j.estado AS job_estado, {duck_ts('j.created_at')} AS job_created_at,
    j.id IS NOT NULL AS has_job FROM facturas f LEFT JOIN lj j ON j.factura_id=f.id""", "facturas", "jobs", lj=LATEST_JOB))
def latest_job(d):
    from ..operators.invoices import nest_latest, with_latest_document, with_latest_job

    nested = nest_latest(with_latest_document(with_latest_job(d.facturas, d.jobs), d.documentos))
    return nested.select(
        "id", F.col("job.id").alias("job_id"), F.col("job.estado").alias("job_estado"),
        ts("job.created_at").alias("job_created_at"), F.col("job").isNotNull().alias("has_job"))


@query("latest_document", with_views(
    """SELECT f.id, d.id AS documento_id, d.batch_id, d.canal_entrada, d.nombre_archivo FROM facturas f LEFT JOIN ld d ON d.factura_id=f.id""",
    "facturas", "documentos", ld=LATEST_DOC))
def latest_document(d):
    return I.with_latest_document(d.facturas, d.documentos).select(
        "id", "documento_id", F.col("documento_batch_id").alias("batch_id"),
        F.col("documento_canal_entrada").alias("canal_entrada"), F.col("documento_nombre_archivo").alias("nombre_archivo"))


@query("user_scope", with_views(
    """SELECT u.id AS usuario_id, count(*) AS visible FROM usuarios u JOIN (SELECT f.cliente_id, c.asesoria_id FROM facturas f JOIN clientes c ON f.cliente_id=c.id) x
    ON (u.tipo_usuario='EMPRESA' AND u.cliente_id IS NOT NULL AND x.cliente_id=u.cliente_id AND x.asesoria_id=u.asesoria_id)
    OR (NOT (u.tipo_usuario='EMPRESA' AND u.cliente_id IS NOT NULL) AND x.asesoria_id=u.asesoria_id) GROUP BY 1""",
    "usuarios", "facturas", "clientes"))
def user_scope(d):
    return I.visible_counts(d.facturas, d.clientes, d.usuarios)


@query("action_violations", with_views(
    """SELECT a.id AS audit_id, a.usuario_id, a.accion, u.rol FROM auditoria a JOIN usuarios u ON a.usuario_id=u.id
    WHERE (accion='SUBIDA' AND rol NOT IN ('ADMIN','CONTABILIDAD','EMPRESA_UPLOAD'))
    OR (accion IN ('EDITADA','VALIDADA','RECHAZADA','REPROCESO_SOLICITADO') AND (rol NOT IN ('ADMIN','CONTABILIDAD','REVISOR') OR tipo_usuario='EMPRESA'))""",
    "auditoria", "usuarios"))
def action_violations(d):
    return A.action_violations(d.auditoria, d.usuarios)


@query("state_eligibility", with_views(
    """SELECT id, estado IN ('PENDIENTE_REVISION','PROCESADA_IA') AS can_act, estado IN ('PENDIENTE_REVISION','PROCESADA_IA','RECHAZADA') AS can_edit,
    estado IN ('PENDIENTE_REVISION','PROCESADA_IA','ERROR_PROCESAMIENTO','RECHAZADA') AS can_reprocess,
    estado NOT IN ('SUBIDA','EN_PROCESO','VALIDADA','SINCRONIZADA') AS can_reprocess_list, estado IN ('SUBIDA','EN_PROCESO') AS is_processing FROM facturas""",
    "facturas"))
def state_eligibility(d):
    return I.with_eligibility(d.facturas).select(
        "id", "can_act", "can_edit", "can_reprocess", "can_reprocess_list", "is_processing")


@query("state_domain_flags", """SELECT event_id AS id, event_type IN ('view','click') AS estado_ok,
    CASE event_id%4 WHEN 0 THEN true ELSE false END AS json_ok FROM events""")
def state_domain_flags(d):
    e = d.table("events")
    blob = (F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, "[1,2]")
            .when(F.col("event_id") % 4 == 2, "{broken").otherwise("null"))
    state = F.when(F.col("event_type") == "view", "SUBIDA").when(F.col("event_type") == "click", "VALIDADA").otherwise("OTRA")
    return I.state_domain_flags(e.select(F.col("event_id").alias("id"), state.alias("estado"), blob.alias("documento_json"))).select(
        "id", "estado_ok", "json_ok")


@query("project_json", with_views(
    "SELECT id, numero_factura, fecha, proveedor_nombre AS proveedor, total::DECIMAL(12,2)::DOUBLE AS total FROM facturas_p", "facturas_p"))
def project_json(d):
    fields = {"numero_factura": "string", "fecha": "string", "proveedor": "string", "total": "decimal(12,2)"}
    return I.project_json(d.facturas_json, fields).select("id", "numero_factura", "fecha", "proveedor", F.col("total").cast("double"))


@query("client_list", with_views("SELECT asesoria_id, id, nombre, cif, estado FROM clientes ORDER BY asesoria_id, nombre, id", "clientes"))
def client_list(d):
    return d.clientes.select("asesoria_id", "id", "nombre", "cif", "estado").orderBy("asesoria_id", "nombre", "id")


@query("dimension_scans", with_views("""SELECT 'proveedor' AS tabla, id, nombre FROM proveedores UNION ALL SELECT 'producto', id, descripcion FROM productos""",
    "proveedores", "productos"))
def dimension_scans(d):
    s = I.dimension_scan(d.proveedores, "nombre").select(F.lit("proveedor").alias("tabla"), "id", "nombre")
    p = I.dimension_scan(d.productos, "descripcion").select(F.lit("producto").alias("tabla"), "id", F.col("descripcion").alias("nombre"))
    return s.unionByName(p)


@query("lookup_client_by_cif", with_views("SELECT id, asesoria_id, nombre, cif FROM clientes WHERE cif='B0000042'||" + "(SELECT substr(cif,9,1) FROM clientes WHERE id=42)", "clientes"))
def lookup_client_by_cif(d):
    from ..sources.domain import make_cif

    return I.lookup(d.clientes, F.col("cif") == make_cif("B", F.lit(42))).select("id", "asesoria_id", "nombre", "cif")


@query("audit_trail", with_views(
    f"""SELECT a.id, a.factura_id, a.usuario_id, u.nombre AS usuario_nombre, a.accion, a.detalle_json, {duck_ts('a.created_at')} AS created_at,
    row_number() OVER (PARTITION BY a.factura_id ORDER BY a.created_at DESC, a.id DESC) AS posicion FROM auditoria a LEFT JOIN usuarios u ON a.usuario_id=u.id""",
    "auditoria", "usuarios"))
def audit_trail(d):
    return A.audit_trail(d.auditoria, d.usuarios).select(
        "id", "factura_id", "usuario_id", "usuario_nombre", "accion", "detalle_json", ts("created_at").alias("created_at"), "posicion")


@query("latest_audit_by_action", with_views(
    f"""SELECT a.factura_id, a.accion, a.id, u.nombre AS usuario_nombre FROM (SELECT *, row_number() OVER (PARTITION BY factura_id, accion ORDER BY created_at DESC, id DESC) rn FROM auditoria) a
    LEFT JOIN usuarios u ON a.usuario_id=u.id WHERE rn=1""", "auditoria", "usuarios"))
def latest_audit_by_action(d):
    return A.latest_audit(d.auditoria, d.usuarios).select("factura_id", "accion", "id", "usuario_nombre")


@query("recent_audit", with_views(
    f"""SELECT a.id, a.factura_id, a.accion, u.nombre AS usuario_nombre, f.numero_factura, {duck_ts('a.created_at')} AS created_at FROM auditoria a
    LEFT JOIN usuarios u ON a.usuario_id=u.id LEFT JOIN facturas f ON a.factura_id=f.id LEFT JOIN clientes c ON f.cliente_id=c.id
    WHERE c.asesoria_id=7 ORDER BY a.created_at DESC, a.id DESC LIMIT 10""", "auditoria", "usuarios", "facturas", "clientes"))
def recent_audit(d):
    return A.recent_activity(d.auditoria, d.usuarios, d.facturas, d.clientes, 10, asesoria_id=7).select(
        "id", "factura_id", "accion", "usuario_nombre", "numero_factura", ts("created_at").alias("created_at"))


@query("recent_audit_per_firm", with_views(
    """SELECT asesoria_id, pos, id, usuario_nombre, numero_factura FROM (SELECT c.asesoria_id, a.id, u.nombre AS usuario_nombre, f.numero_factura,
    row_number() OVER (PARTITION BY c.asesoria_id ORDER BY a.created_at DESC, a.id DESC) AS pos FROM auditoria a
    LEFT JOIN usuarios u ON a.usuario_id=u.id JOIN facturas f ON a.factura_id=f.id JOIN clientes c ON f.cliente_id=c.id) WHERE pos<=10""",
    "auditoria", "usuarios", "facturas", "clientes"))
def recent_audit_per_firm(d):
    return A.recent_activity_per_firm(d.auditoria, d.usuarios, d.facturas, d.clientes, 10).select(
        "asesoria_id", F.col("pos").cast("bigint").alias("pos"), "id", "usuario_nombre", "numero_factura")


@query("users_with_firm", with_views(
    """SELECT u.id, u.nombre, u.rol, u.tipo_usuario, a.id AS asesoria_id, a.nombre AS asesoria_nombre, c.nombre AS cliente_nombre, c.cif AS cliente_cif
    FROM usuarios u JOIN asesorias a ON a.id=u.asesoria_id LEFT JOIN clientes c ON c.id=u.cliente_id WHERE u.activo AND a.estado='ACTIVA'""",
    "usuarios", "asesorias", "clientes"))
def users_with_firm(d):
    return A.users_with_firm(d.usuarios, d.asesorias, d.clientes).select(
        "id", "nombre", "rol", "tipo_usuario", "asesoria_id", "asesoria_nombre", "cliente_nombre", "cliente_cif")


_COUNTS = "SELECT c.asesoria_id, f.estado, count(*) AS count FROM facturas f JOIN clientes c ON f.cliente_id=c.id GROUP BY 1,2"
_BOARD = """SELECT asesoria_id, sum(count)::BIGINT AS total, coalesce(sum(count) FILTER (estado='PROCESADA_IA'),0)::BIGINT AS procesadas_ia,
    coalesce(sum(count) FILTER (estado IN ('PENDIENTE_REVISION','PROCESADA_IA')),0)::BIGINT AS pendientes_revision,
    coalesce(sum(count) FILTER (estado='VALIDADA'),0)::BIGINT AS validadas, coalesce(sum(count) FILTER (estado='ERROR_PROCESAMIENTO'),0)::BIGINT AS errores
    FROM counts GROUP BY 1"""


@query("count_by_state", with_views("SELECT * FROM counts", "facturas", "clientes", counts=_COUNTS))
def count_by_state(d):
    return D.count_by_state(d.facturas, d.clientes)


@query("owned_invoices", with_views("SELECT f.id, f.cliente_id, c.asesoria_id FROM facturas f JOIN clientes c ON f.cliente_id=c.id", "facturas", "clientes"))
def owned_invoices(d):
    return D.owned_invoices(d.facturas, d.clientes).select("id", "cliente_id", "asesoria_id")


@query("dashboard_rollup", with_views("SELECT * FROM board", "facturas", "clientes", counts=_COUNTS, board=_BOARD))
def dashboard_rollup(d):
    return D.dashboard(d.facturas, d.clientes)


@query("milestone_progress", with_views(
    """SELECT asesoria_id, processed, next_milestone, least(100, floor(processed*100.0/next_milestone+0.5))::BIGINT AS pct FROM (
    SELECT asesoria_id, processed, coalesce((SELECT min(m) FROM (SELECT unnest([50,100,250,500,1000,2500,5000,10000,25000,50000,100000]) AS m) WHERE m>processed),
      greatest(100000, (processed//1000+1)*1000))::BIGINT AS next_milestone
    FROM (SELECT asesoria_id, pendientes_revision+validadas+errores AS processed FROM board))""",
    "facturas", "clientes", counts=_COUNTS, board=_BOARD))
def milestone_progress(d):
    return D.milestone_progress(D.dashboard(d.facturas, d.clientes)).select("asesoria_id", "processed", "next_milestone", "pct")


@query("state_share", with_views(
    """SELECT asesoria_id, estado, count, (sum(count) OVER (PARTITION BY asesoria_id))::BIGINT AS total,
    floor(count*100.0/(max(count) OVER (PARTITION BY asesoria_id))+0.5)::BIGINT AS pct_of_max FROM counts WHERE count>0""",
    "facturas", "clientes", counts=_COUNTS))
def state_share(d):
    return D.state_share(D.count_by_state(d.facturas, d.clientes))


@query("job_latency_p95", with_views(
    """SELECT count(*) AS n, round(avg(s),6) AS avg_s, round(quantile_cont(s,0.95),6) AS p95_s FROM (
    SELECT date_diff('second', started_at, finished_at) AS s FROM jobs WHERE finished_at IS NOT NULL AND started_at IS NOT NULL)""", "jobs"))
def job_latency_p95(d):
    return D.job_latency(d.jobs, exact=True)


@query("latency_by_firm", with_views(
    """SELECT c.asesoria_id, count(*) AS n, true AS within_one_percent FROM jobs j JOIN facturas f ON f.id=j.factura_id JOIN clientes c ON c.id=f.cliente_id
    WHERE finished_at IS NOT NULL AND started_at IS NOT NULL GROUP BY 1""", "jobs", "facturas", "clientes"))
def latency_by_firm(d):
    """95th percentile from stored sketches: its exact rank among all jobs is within one percent."""
    firms = d.facturas.join(d.clientes.select(F.col("id").alias("cliente_id"), "asesoria_id"), "cliente_id").select(F.col("id").alias("factura_id"), "asesoria_id")
    finished = L.finished_per_firm(d.jobs, firms)
    stored = shared_folder(d.spark, "latency")
    L.latency_sketches(finished).write.parquet(stored)
    told = L.latency_of_span(d.spark.read.parquet(stored))
    per_second = finished.groupBy("asesoria_id", "s").agg(F.count(F.lit(1)).alias("k"))
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("k"))), F.lit(0)) / F.sum("k")
    ranks = per_second.join(told, "asesoria_id").groupBy("asesoria_id", "n").agg(
        count(F.col("s") < F.col("quantile")).alias("below"), count(F.col("s") <= F.col("quantile")).alias("upto"))
    return ranks.select("asesoria_id", "n", ((F.col("below") <= 0.96) & (F.col("upto") >= 0.94)).alias("within_one_percent"))


@query("document_codes", with_views(
    """SELECT id, CASE WHEN length(id::VARCHAR)>=6 THEN 'DOC-'||id ELSE 'DOC-'||lpad(id::VARCHAR,6,'0') END AS codigo,
       CASE WHEN length((id*1000)::VARCHAR)>=6 THEN 'DOC-'||(id*1000) ELSE 'DOC-'||lpad((id*1000)::VARCHAR,6,'0') END AS codigo_largo FROM facturas""", "facturas"))
def document_codes(d):
    from ..functions.text import document_code

    return d.facturas.select("id", document_code(F.lit(None).cast("bigint"), F.col("id")).alias("codigo"),
                             document_code(F.col("id") * 1000, F.col("id")).alias("codigo_largo"))
