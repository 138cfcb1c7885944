"""Numbering, job recovery, patches, uploads, entity resolution, table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.dates import stale_cutoff
from ..functions.taxid import clean_tax_id
from ..operators import checks as C
from ..operators import jobs as J
from ..operators import numbering as N
from ..operators import parties as P
from ..operators import patch as T
from ..operators import uploads as U
from ..session import cut_lineage
from ..sources.buckets import read_buckets, update_buckets, write_buckets
from ..streaming.core import shared_folder
from .prelude import with_views
from .registry import duck_ts, query, ts

NUMBERED = "SELECT *, row_number() OVER (PARTITION BY cliente_id ORDER BY created_at, id) AS numero_correlativo FROM facturas"
NOW = lambda: F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
# half of the log's month counts as stuck
CUT = lambda: F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")


_PARTLY = """SELECT id, CASE WHEN id%11<>0 THEN cliente_id END AS cliente_id, CASE WHEN id%13<>0 THEN created_at END AS created_at,
    CASE WHEN id%7=0 THEN 100000+id END AS numero_correlativo FROM facturas"""


@query("correlative_backfill", with_views(
    """SELECT p.id, p.cliente_id, coalesce(p.numero_correlativo, x.k) AS numero_correlativo FROM partly p LEFT JOIN (
    SELECT id, row_number() OVER (PARTITION BY cliente_id ORDER BY created_at ASC NULLS LAST, id) AS k FROM partly
    WHERE numero_correlativo IS NULL AND cliente_id IS NOT NULL) x ON x.id=p.id""", "facturas", partly=_PARTLY))
def correlative_backfill(d):
    """Some invoices are numbered, some have no client, some no date."""
    key = F.col("id")
    partly = d.facturas.select(
        "id", F.when(key % 11 != 0, F.col("cliente_id")).alias("cliente_id"), F.when(key % 13 != 0, F.col("created_at")).alias("created_at"),
        F.when(key % 7 == 0, key + 100000).alias("numero_correlativo"))
    return N.backfill_correlative(partly).select("id", "cliente_id", "numero_correlativo")


@query("correlative_counters", with_views(
    """SELECT c.id AS cliente_id, greatest(CASE WHEN c.id%3=0 THEN 12 END, m) AS ultimo_correlativo FROM clientes c LEFT JOIN
    (SELECT cliente_id, max(numero_correlativo) AS m FROM n GROUP BY 1) x ON x.cliente_id=c.id WHERE c.id%3=0 OR m IS NOT NULL""",
    "facturas", "clientes", n=NUMBERED))
def correlative_counters(d):
    stored = d.clientes.filter("id % 3 = 0").select(F.col("id").alias("cliente_id"), F.lit(12).cast("bigint").alias("ultimo_correlativo"))
    return N.seed_counters(N.backfill_correlative(d.facturas), stored)


@query("correlative_continue", with_views(
    """SELECT f.id, f.cliente_id, CASE WHEN f.id%17<>0 THEN coalesce(c.start,0) + row_number() OVER (PARTITION BY f.cliente_id, f.id%17<>0 ORDER BY f.created_at, f.id) END AS numero_correlativo
    FROM facturas f LEFT JOIN (SELECT id, CASE WHEN id%2=0 THEN id%100 END AS start FROM clientes) c ON c.id=f.cliente_id""", "facturas", "clientes"))
def correlative_continue(d):
    """Invoices without a client keep no number."""
    counters = d.clientes.filter("id % 2 = 0").select(F.col("id").alias("cliente_id"), (F.col("id") % 100).alias("ultimo_correlativo"))
    new = d.facturas.select("id", F.when(F.col("id") % 17 != 0, F.col("cliente_id")).alias("cliente_id"), "created_at", F.col("cliente_id").alias("_owner"))
    numbered, _ = N.assign_correlative(new, counters)
    return numbered.select("id", F.col("_owner").alias("cliente_id"), "numero_correlativo")


@query("counter_upsert", with_views(
    """SELECT coalesce(c.cliente_id, n.cliente_id) AS cliente_id, coalesce(ultimo,0)+coalesce(k,0) AS ultimo_correlativo FROM
    (SELECT id AS cliente_id, id%100 AS ultimo FROM clientes WHERE id%2=0) c FULL JOIN (SELECT cliente_id, count(*) AS k FROM facturas GROUP BY 1) n ON c.cliente_id=n.cliente_id""",
    "facturas", "clientes"))
def counter_upsert(d):
    counters = d.clientes.filter("id % 2 = 0").select(F.col("id").alias("cliente_id"), (F.col("id") % 100).alias("ultimo_correlativo"))
    return N.bump_counters(counters, d.facturas.groupBy("cliente_id").agg(F.count(F.lit(1)).alias("n")))


@query("numbering_gaps", with_views(
    """SELECT cliente_id, count(*) AS n, min(k) AS low, max(k) AS high FROM (SELECT cliente_id, numero_correlativo + CASE WHEN cliente_id%100=7 AND numero_correlativo>2 THEN 1 ELSE 0 END AS k FROM n)
    GROUP BY 1 HAVING min(k)<>1 OR max(k)<>count(*) OR sum(k)*2<>count(*)*(count(*)+1)""", "facturas", n=NUMBERED))
def numbering_gaps(d):
    """Audit of a numbering in which some clients were given a gap."""
    gap = F.when((F.col("cliente_id") % 100 == 7) & (F.col("numero_correlativo") > 2), 1).otherwise(0)
    broken = N.backfill_correlative(d.facturas).withColumn("numero_correlativo", F.col("numero_correlativo") + gap)
    return N.numbering_gaps(broken).select("cliente_id", "n", "low", "high")


_REQUEUED = f"""SELECT *, estado='EN_PROCESO' AND started_at IS NOT NULL AND started_at < TIMESTAMP '2024-01-16 00:00:00' AS recovered, retry_count+1>=2 AS give_up FROM jobs"""


@query("requeue_stale_jobs", with_views(
    f"""SELECT id, factura_id, CASE WHEN recovered THEN CASE WHEN give_up THEN 'ERROR' ELSE 'PENDIENTE' END ELSE estado END AS estado,
    {duck_ts("CASE WHEN recovered AND NOT give_up THEN NULL ELSE started_at END")} AS started_at,
    {duck_ts(f"CASE WHEN recovered THEN CASE WHEN give_up THEN {NOW_SQL} END ELSE finished_at END")} AS finished_at,
    CASE WHEN recovered THEN retry_count+1 ELSE retry_count END AS retry_count,
    CASE WHEN recovered THEN concat_ws(' | ', nullif(error_message,''), CASE WHEN give_up THEN '{K.GIVE_UP_MESSAGE}' ELSE '{K.REQUEUE_MESSAGE}' END) ELSE error_message END AS error_message,
    recovered FROM r""", "jobs", r=_REQUEUED))
def requeue_stale_jobs(d):
    after, _ = J.requeue_stale(d.jobs, d.facturas, NOW(), CUT())
    return after.select("id", "factura_id", "estado", ts("started_at").alias("started_at"), ts("finished_at").alias("finished_at"),
                        "retry_count", "error_message", "recovered")


@query("requeue_stale_invoices", with_views(
    """SELECT f.id, CASE WHEN estado='EN_PROCESO' AND q THEN 'SUBIDA' WHEN estado='EN_PROCESO' AND e THEN 'ERROR_PROCESAMIENTO' ELSE estado END AS estado
    FROM facturas f LEFT JOIN (SELECT factura_id, bool_or(NOT give_up) AS q, bool_or(give_up) AS e FROM r WHERE recovered GROUP BY 1) x ON x.factura_id=f.id""",
    "jobs", "facturas", r=_REQUEUED))
def requeue_stale_invoices(d):
    _, invoices = J.requeue_stale(d.jobs, d.facturas, NOW(), CUT())
    return invoices.select("id", "estado")


@query("stale_jobs_per_cutoff", with_views(
    """SELECT id, started_at < created_at + INTERVAL 20 MINUTE - INTERVAL 15 MINUTE AS stale FROM jobs WHERE estado='EN_PROCESO'""", "jobs"))
def stale_jobs_per_cutoff(d):
    now = F.col("created_at") + F.expr("INTERVAL 20 MINUTES")
    return d.jobs.filter(F.col("estado") == "EN_PROCESO").select("id", (F.col("started_at") < stale_cutoff(now)).alias("stale"))


@query("pending_queue", with_views(
    f"SELECT id, factura_id, {duck_ts('created_at')} AS created_at FROM jobs WHERE estado='PENDIENTE' ORDER BY jobs.created_at, id LIMIT 100", "jobs"))
def pending_queue(d):
    return J.pending_queue(d.jobs, 100).select("id", "factura_id", ts("created_at").alias("created_at"))


_MOVE = """CASE accion WHEN 'SUBIDA' THEN 'SUBIDA' WHEN 'PROCESAMIENTO_INICIADO' THEN 'EN_PROCESO' WHEN 'ERROR_PROCESAMIENTO' THEN 'ERROR_PROCESAMIENTO' WHEN 'VALIDADA' THEN 'VALIDADA' END"""


@query("state_replay", with_views(
    f"""SELECT factura_id, estado, {duck_ts('created_at')} AS since FROM (SELECT *, {_MOVE} AS estado, row_number() OVER (PARTITION BY factura_id ORDER BY created_at DESC, id DESC) rn
    FROM auditoria WHERE accion<>'EDITADA') WHERE rn=1""", "auditoria"))
def state_replay(d):
    return J.replay_states(d.auditoria).select("factura_id", "estado", ts("since").alias("since"))


@query("illegal_reviews", with_views(
    f"""SELECT id, factura_id, accion, estado_previo FROM (SELECT *, last_value({_MOVE} IGNORE NULLS) OVER (PARTITION BY grupo ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS estado_previo
    FROM (SELECT id, factura_id%100 AS factura_id, factura_id%100 AS grupo, accion, created_at FROM auditoria)) WHERE accion IN ('VALIDADA','RECHAZADA') AND coalesce(estado_previo NOT IN ('PENDIENTE_REVISION','PROCESADA_IA'), true)""",
    "auditoria"))
def illegal_reviews(d):
    """Folded onto a hundred invoices so that each has a long history."""
    return J.illegal_reviews(d.auditoria.withColumn("factura_id", F.col("factura_id") % 100))


@query("apply_patch", with_views(
    """SELECT id, cliente_id, CASE WHEN id%3=0 THEN 'VALIDADA' ELSE estado END AS estado, CASE WHEN id%5=0 THEN NULL ELSE confianza_ia END AS confianza_ia, total FROM facturas""", "facturas"))
def apply_patch(d):
    """``estado`` and ``confianza_ia`` may change (also to NULL); ``total`` is not in the whitelist."""
    patch = d.facturas.select(
        "id", F.lit("VALIDADA").alias("estado"), F.lit(None).cast("double").alias("confianza_ia"), F.lit(0.0).alias("total"),
        (F.col("id") % 3 == 0).alias("set_estado"), (F.col("id") % 5 == 0).alias("set_confianza_ia"), F.lit(True).alias("set_total"))
    return T.apply_patch(d.facturas, patch, "id", ["estado", "confianza_ia", "validado_por", "fecha_procesado"]).select(
        "id", "cliente_id", "estado", "confianza_ia", "total")


@query("patch_in_buckets", with_views(
    f"""SELECT id, cliente_id, CASE WHEN total>300000 THEN 'VALIDADA' ELSE estado END AS estado, total,
    CASE WHEN total>300000 THEN {duck_ts(NOW_SQL)} END AS updated_at, proveedor_nombre FROM facturas_p""", "facturas_p"))
def patch_in_buckets(d):
    """Large invoices validated and stamped, then supplier names taken from another table; both rewrite only touched buckets."""
    path = shared_folder(d.spark, "invoices")
    start = d.facturas.select("id", "cliente_id", "estado", "total", F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("string").alias("proveedor_nombre"))
    write_buckets(start, path, "id")
    patch = d.facturas.where("total > 300000").select(
        "id", F.lit("VALIDADA").alias("estado"), NOW().alias("updated_at"), F.lit(True).alias("set_estado"), F.lit(True).alias("set_updated_at"))
    update_buckets(d.spark, path, "id", patch, lambda rows, p: T.apply_patch(rows, p, "id", ["estado", "updated_at"]))
    names = d.facturas_con_proveedor.where("proveedor_nombre is not null").select("id", "proveedor_nombre")
    update_buckets(d.spark, path, "id", names, lambda rows, p: T.update_from(rows, p, "id", ["proveedor_nombre"]))
    return read_buckets(d.spark, path).withColumn("updated_at", ts("updated_at"))


@query("update_from", with_views(
    """SELECT f.id, f.cliente_id, n.numero_correlativo, f.estado FROM facturas f LEFT JOIN n ON n.id=f.id""", "facturas", n=NUMBERED))
def update_from(d):
    blank = d.facturas.withColumn("numero_correlativo", F.lit(None).cast("bigint"))
    numbered = N.backfill_correlative(d.facturas)
    return T.update_from(blank, numbered, "id", ["numero_correlativo"]).select("id", "cliente_id", "numero_correlativo", "estado")


@query("apply_results", with_views(
    f"""SELECT f.id, CASE WHEN j.id IS NOT NULL THEN 'PENDIENTE_REVISION' ELSE f.estado END AS estado,
    CASE WHEN j.id IS NOT NULL THEN round(((j.id%97)*0.0103)::DOUBLE,2) ELSE confianza_ia END AS confianza_ia,
    CASE WHEN j.id IS NOT NULL THEN {duck_ts(NOW_SQL)} END AS fecha_procesado, j.props AS documento_json
    FROM facturas f LEFT JOIN (SELECT factura_id, max(a.id) AS id, max(e.props ORDER BY a.id) AS dummy, arg_max(e.props, a.id) AS props FROM jobs a JOIN events e ON e.event_id=a.id WHERE a.estado='COMPLETADO' GROUP BY 1) j ON j.factura_id=f.id""",
    "facturas", "jobs"))
def apply_results(d):
    done = d.jobs.filter(F.col("estado") == "COMPLETADO").join(
        d.table("events").select(F.col("event_id").alias("id"), "props"), "id")
    results = done.groupBy("factura_id").agg(F.max(F.struct("id", "props")).alias("m")).select(
        F.col("factura_id").alias("id"), F.col("m.props").alias("documento_json"), ((F.col("m.id") % 97) * 0.0103).cast("double").alias("confianza"))
    out = T.apply_results(d.facturas, results, NOW())
    return out.select("id", "estado", "confianza_ia", ts("fecha_procesado").alias("fecha_procesado"), "documento_json")


@query("stamp_updated", with_views(
    f"SELECT id, CASE WHEN estado='SUBIDA' THEN {duck_ts(NOW_SQL)} END AS updated_at FROM facturas", "facturas"))
def stamp_updated(d):
    return T.stamp_updated(d.facturas, F.col("estado") == "SUBIDA", NOW()).select("id", ts("updated_at").alias("updated_at"))


@query("json_migration_round_trip", with_views("SELECT factura_id, orden, producto_id, cantidad, precio_unitario, importe FROM lineas", "lineas"))
def json_migration_round_trip(d):
    """Columns and lines into JSON documents and the lines back out of them."""
    return T.from_documents(T.to_documents(d.facturas_con_proveedor, d.lineas))


_UP_REASON = """CASE WHEN lower(regexp_extract(nombre_archivo,'\\.([^.]+)$',1)) NOT IN ('pdf','png','jpg','jpeg','tiff','tif','webp') THEN 'extension'
    WHEN tipo_mime NOT IN ('application/pdf','image/jpeg','image/png','image/tiff','image/webp') THEN 'mime' WHEN tamano_bytes>10485760 THEN 'size' END"""


@query("admit_files", with_views(f"SELECT doc_id, {_UP_REASON} IS NULL AS accepted, {_UP_REASON} AS reason FROM uploads", "uploads"))
def admit_files(d):
    return U.admit_files(d.uploads).select("doc_id", "accepted", "reason")


@query("file_limits", with_views(
    "SELECT doc_id, tipo_mime IN ('application/pdf','image/jpeg','image/png','image/tiff','image/webp') AS type_ok, tamano_bytes<=10485760 AS size_ok FROM uploads", "uploads"))
def file_limits(d):
    return U.file_limits(d.uploads).select("doc_id", "type_ok", "size_ok")


_ADMITTED = f"""SELECT u.*, CASE WHEN c.id IS NULL THEN 'client' ELSE {_UP_REASON} END AS error FROM (SELECT * EXCLUDE asesoria_id, CASE WHEN doc_id%4=1 THEN doc_id%25 ELSE (SELECT c_nationkey FROM customer WHERE c_custkey=cliente_id) END AS asesoria_id FROM uploads) u
    LEFT JOIN clientes c ON c.id=u.cliente_id AND c.asesoria_id=u.asesoria_id"""


def _uploads_of_firms(d):
    """Uploads whose firm is the client's own for three quarters of the files."""
    firm = d.clientes.select(F.col("id").alias("cliente_id"), F.col("asesoria_id").alias("_firm"))
    u = d.uploads.join(firm, "cliente_id", "left")
    return u.withColumn("asesoria_id", F.when(F.col("doc_id") % 4 == 1, F.col("doc_id") % 25).otherwise(F.col("_firm"))).drop("_firm")


@query("admit_batch", with_views(
    "SELECT doc_id, batch_id, CASE WHEN error IS NULL THEN 'queued' ELSE 'failed' END AS status, error FROM a", "uploads", "clientes", a=_ADMITTED))
def admit_batch(d):
    return U.admit_batch(_uploads_of_firms(d), d.clientes).select("doc_id", "batch_id", "status", "error")


@query("upload_batch_summary", with_views(
    """SELECT batch_id, count(*) AS total, count(*) FILTER (error IS NULL) AS accepted, count(*) FILTER (error IS NOT NULL) AS failed,
    count(*) FILTER (error IS NULL)=0 AND count(*) FILTER (error IS NOT NULL)>0 AS rejected FROM a GROUP BY 1""", "uploads", "clientes", a=_ADMITTED))
def upload_batch_summary(d):
    return U.batch_summary(U.admit_batch(_uploads_of_firms(d), d.clientes))


@query("upload_duplicates", with_views(
    "SELECT id, hash_archivo, n, first_id FROM (SELECT id, hash_archivo, count(*) OVER (PARTITION BY hash_archivo) AS n, min(id) OVER (PARTITION BY hash_archivo) AS first_id FROM documentos) WHERE n>1", "documentos"))
def upload_duplicates(d):
    return U.duplicate_documents(d.documentos)


@query("upload_already_stored", with_views(
    "SELECT doc_id, hash_archivo FROM uploads WHERE doc_id%2=1 AND hash_archivo IN (SELECT hash_archivo FROM uploads WHERE doc_id%2=0)", "uploads"))
def upload_already_stored(d):
    """The odd half of the files arrives after the even half."""
    u = cut_lineage(d.uploads.select("doc_id", "hash_archivo"))
    return U.already_stored(u.filter("doc_id % 2 = 1"), u.filter("doc_id % 2 = 0")).select("doc_id", "hash_archivo")


@query("distinct_uploads", """SELECT min(doc_id) AS doc_id, source||'-'||(doc_id%10)::VARCHAR AS nombre_archivo, length(text)//500*500 AS tamano_bytes FROM documents GROUP BY 2,3, lang""")
def distinct_uploads(d):
    files = d.table("documents").select(
        "doc_id", F.concat_ws("-", "source", (F.col("doc_id") % 10).cast("string")).alias("nombre_archivo"),
        (F.floor(F.length("text") / 500) * 500).cast("bigint").alias("tamano_bytes"), F.col("lang").alias("modificado"))
    return U.distinct_files(files).select("doc_id", "nombre_archivo", "tamano_bytes")


@query("upload_manifest", with_views(
    f"""SELECT doc_id, 'upl_'||strftime(fecha_subida,'%Y%m%d%H%M%S')||'_'||substr(sha256(batch_id),1,8) AS batch_id, hash_archivo,
    json_object('archivo', nombre_archivo, 'tamano', tamano_bytes)::VARCHAR AS detalle_json FROM uploads""", "uploads"))
def upload_manifest(d):
    from ..functions.dates import batch_id
    from ..sources.files import upload_rows

    rows = d.uploads.withColumn("factura_id", F.col("doc_id"))
    audit = upload_rows(rows, 1, "127.0.0.1", NOW(), "doc_id", "fecha_subida", "batch_id", "hash_archivo")["audit"]
    return audit.select("doc_id", batch_id(F.col("fecha_subida"), F.col("batch_id")).alias("batch_id"), "hash_archivo", "detalle_json")


@query("audit_append", "SELECT user_id AS usuario_id, event_id AS factura_id, upper(event_type) AS accion, json_object('valor', value, 'tipo', event_type)::VARCHAR AS detalle_json FROM events")
def audit_append(d):
    from ..operators.audit import audit_rows

    e = d.table("events").select(
        F.col("user_id").alias("usuario_id"), F.col("event_id").alias("factura_id"), F.upper("event_type").alias("accion"),
        F.col("value").alias("valor"), F.col("event_type").alias("tipo"), F.lit("127.0.0.1").alias("ip_address"), F.col("ts").alias("created_at"))
    return audit_rows(e, ["valor", "tipo"]).select("usuario_id", "factura_id", "accion", "detalle_json")


@query("uniqueness_checks", with_views(
    """SELECT 'cliente_cif' AS regla, asesoria_id::VARCHAR||'/'||substr(cif,2,4) AS clave, count(*) AS n FROM clientes WHERE cif IS NOT NULL GROUP BY 2 HAVING count(*)>1
    UNION ALL SELECT 'correlativo', cliente_id::VARCHAR||'/'||numero_correlativo::VARCHAR, count(*) FROM n GROUP BY 2 HAVING count(*)>1
    UNION ALL SELECT 'linea', l_orderkey::VARCHAR||'/'||l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2 HAVING count(*)>1""",
    "clientes", "facturas", n=NUMBERED))
def uniqueness_checks(d):
    """Client cif (shortened, so that clashes exist) per firm, number per client, line number per order."""
    clients = d.clientes.withColumn("corto", F.substring("cif", 2, 4))
    lines = d.table("lineitem").select("l_orderkey", "l_linenumber")
    out = []
    for rule, df, keys in (("cliente_cif", clients, ["asesoria_id", "corto"]),
                           ("correlativo", N.backfill_correlative(d.facturas), ["cliente_id", "numero_correlativo"]),
                           ("linea", lines, ["l_orderkey", "l_linenumber"])):
        v = C.uniqueness_violations(df, keys)
        out.append(v.select(F.lit(rule).alias("regla"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("clave"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


_PARTIES = """SELECT o_orderkey AS seq, c_nationkey::BIGINT AS asesoria_id,
    CASE o_orderkey%4 WHEN 0 THEN 'Otra razon '||(c_custkey%30) WHEN 1 THEN lower(c_name)||', S.L.' WHEN 2 THEN 'Nuevo '||(c_custkey%40) ELSE 'NUEVO '||(c_custkey%60)||' S.A.' END AS nombre,
    CASE o_orderkey%4 WHEN 0 THEN cif WHEN 2 THEN 'B9'||lpad((c_custkey%50)::VARCHAR,7,'0') END AS cif
    FROM orders JOIN customer ON o_custkey=c_custkey JOIN clientes ON clientes.id=c_custkey"""
_NORM = """nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper({c}),'\\b(?:S\\.?L\\.?U?\\.?|S\\.?A\\.?U?\\.?|S\\.?C\\.?|C\\.?B\\.?)\\b','','g'),'[.,;:''\"]','','g'),'\\s+',' ','g')),'')"""


def _parties(d):
    c = d.clientes.select(F.col("id").alias("cliente_id"), "asesoria_id", "nombre", "cif")
    key, cust = F.col("id"), F.col("cliente_id")
    kind = key % 4
    return d.facturas.select("id", "cliente_id").join(c, "cliente_id").select(
        key.alias("seq"), "asesoria_id",
        F.when(kind == 0, F.concat(F.lit("Otra razon "), (cust % 30).cast("string")))
        .when(kind == 1, F.concat(F.lower("nombre"), F.lit(", S.L.")))
        .when(kind == 2, F.concat(F.lit("Nuevo "), (cust % 40).cast("string")))
        .otherwise(F.concat(F.lit("NUEVO "), (cust % 60).cast("string"), F.lit(" S.A."))).alias("nombre"),
        F.when(kind == 0, F.col("cif")).when(kind == 2, F.concat(F.lit("B9"), F.lpad((cust % 50).cast("string"), 7, "0"))).alias("cif"))


@query("party_resolution", with_views(
    f"""SELECT asesoria_id, nombre, cif, coalesce(found, (SELECT max(id) FROM clientes) + dense_rank() OVER (PARTITION BY found IS NULL ORDER BY substr(md5(k),1,3), k)) AS cliente_id, found IS NULL AS is_new FROM (
    SELECT m.*, m.asesoria_id||'|'||coalesce(min(CASE WHEN cif IS NOT NULL AND found IS NULL THEN norm END) OVER (PARTITION BY m.asesoria_id, cif, found IS NULL), norm, 'cif:'||cif, '?') AS k FROM (
    SELECT p.asesoria_id, p.nombre, p.cif, p.norm, coalesce((SELECT min(id) FROM clientes c WHERE c.asesoria_id=p.asesoria_id AND c.cif=p.cif),
      (SELECT min(id) FROM clientes c WHERE c.asesoria_id=p.asesoria_id AND {_NORM.format(c='c.nombre')}=p.norm)) AS found
    FROM (SELECT DISTINCT asesoria_id, nombre, cif, {_NORM.format(c='nombre')} AS norm FROM p) p) m)""", "clientes", p=_PARTIES))
def party_resolution(d):
    return P.resolve_clients(_parties(d), d.clientes)


_SUP_PARTIES = """SELECT l_orderkey*100 + l_linenumber AS seq, CASE WHEN l_linenumber=1 THEN s_name||' Renombrada' WHEN l_linenumber=2 THEN s_name ELSE 'Tercero '||(l_partkey%70) END AS nombre,
    CASE WHEN l_linenumber=1 THEN cif WHEN l_linenumber=2 THEN NULL ELSE NULL END AS cif FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN proveedores ON proveedores.id=s_suppkey"""


def _supplier_parties(d):
    line = F.col("l_linenumber")
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("id")).join(d.proveedores, "id").select(
        (F.col("l_orderkey") * 100 + line).alias("seq"),
        F.when(line == 1, F.concat("nombre", F.lit(" Renombrada"))).when(line == 2, F.col("nombre"))
        .otherwise(F.concat(F.lit("Tercero "), (F.col("l_partkey") % 70).cast("string"))).alias("nombre"),
        F.when(line == 1, F.col("cif")).alias("cif"))


@query("supplier_resolution", with_views(
    """SELECT id, CASE WHEN id IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber=1) THEN nombre||' Renombrada' ELSE nombre END AS nombre, cif FROM proveedores
    UNION ALL SELECT (SELECT max(id) FROM proveedores) + row_number() OVER (ORDER BY substr(md5(k),1,3), k), nombre, NULL FROM (SELECT DISTINCT upper(nombre) AS k, nombre FROM p WHERE nombre LIKE 'Tercero%')""",
    "proveedores", p=_SUP_PARTIES))
def supplier_resolution(d):
    _, suppliers = P.resolve_suppliers(_supplier_parties(d), d.proveedores)
    return suppliers


@query("company_match", with_views(
    f"""SELECT f.id AS doc_id, role, CASE WHEN role='issuer' THEN f.id%3=0 AND c.cif IS NOT NULL ELSE f.id%2=0 END AS matched
    FROM facturas f JOIN clientes c ON f.cliente_id=c.id, (SELECT unnest(['issuer','recipient']) AS role)""", "facturas", "clientes"))
def company_match(d):
    base = d.facturas.select(F.col("id").alias("doc_id"), "cliente_id").join(
        d.clientes.select(F.col("id").alias("cliente_id"), F.col("nombre").alias("cliente_nombre"), F.col("cif").alias("cliente_cif")), "cliente_id")
    odd_id = F.concat(F.substring("cliente_cif", 1, 1), F.lit("-"), F.substring("cliente_cif", 2, 20))
    issuer = base.select("doc_id", F.lit("issuer").alias("role"), F.lit("Otro").alias("name"),
                         F.when(F.col("doc_id") % 3 == 0, F.lower(odd_id)).otherwise("B00000000").alias("tax_id"))
    recipient = base.select("doc_id", F.lit("recipient").alias("role"),
                            F.when(F.col("doc_id") % 2 == 0, F.concat(F.lower("cliente_nombre"), F.lit(" S.L.U."))).otherwise("Nadie").alias("name"),
                            F.lit(None).cast("string").alias("tax_id"))
    return P.match_company(issuer.unionByName(recipient), base)


@query("own_tax_ids", with_views("SELECT id AS cliente_id, CASE WHEN cif IS NULL THEN '' ELSE cif||',' END||'B12345674,B99999997' AS tax_ids FROM clientes", "clientes"))
def own_tax_ids(d):
    return P.own_tax_ids(d.clientes, ["B12345674", "B99999997", "B12345674"]).select("cliente_id", F.array_join("tax_ids", ",").alias("tax_ids"))
