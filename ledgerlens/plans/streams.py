"""Streams drained over the whole tables; results equal the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..streaming import dashboard as B
from ..streaming import operations as S
from ..streaming.core import drain, shared_folder, table_stream
from ..streaming.jobs import track_jobs
from .prelude import with_views
from .registry import duck_ts, query, ts
from .tables import _MOVE


def _events(d):
    # event time with a zone: watermarks need it
    return table_stream(d.spark, d.dir, "events", d.files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def _audit(d):
    kind = F.col("event_type")
    accion = (
        F.when(kind == "signup", "SUBIDA").when(kind == "view", "PROCESAMIENTO_INICIADO")
        .when(kind == "click", "EDITADA").when(kind == "purchase", "VALIDADA").otherwise("ERROR_PROCESAMIENTO"))
    return _events(d).select(F.col("event_id").alias("id"), (F.col("event_id") % d.n_orders).alias("factura_id"), accion.alias("accion"), "user_id", "ts")


@query("throughput_per_minute", f"SELECT {duck_ts('minute')} AS minute, count(*) AS n, count(*)>1 AS over_limit FROM (SELECT date_trunc('minute', ts) AS minute FROM events) GROUP BY minute")
def throughput_per_minute(d):
    return S.throughput(_events(d), limit=1).select(ts("minute").alias("minute"), "n", "over_limit")


@query("upload_rate_limit", f"""SELECT user_id, {duck_ts('start')} AS start, n FROM (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * i AS start, count(*) AS n
    FROM events, (SELECT unnest(range(12)) AS i) GROUP BY 1,2) WHERE n>1""")
def upload_rate_limit(d):
    return S.rate_limits(_events(d), 1, 60, 5).select("user_id", ts("start").alias("start"), "n")


@query("dedup_stream", "SELECT sha256(text) AS hash_archivo FROM documents GROUP BY 1")
def dedup_stream(d):
    docs = table_stream(d.spark, d.dir, "documents", d.files_per_trigger).select(
        F.sha2("text", 256).alias("hash_archivo"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"))
    return S.dedup_uploads(docs).table().select("hash_archivo")


@query("live_counts_stream", with_views(
    f"""SELECT estado, count(*) AS count FROM (SELECT {_MOVE} AS estado, row_number() OVER (PARTITION BY factura_id ORDER BY created_at DESC, id DESC) rn FROM auditoria WHERE accion<>'EDITADA') WHERE rn=1 GROUP BY 1""", "auditoria"))
def live_counts_stream(d):
    table, _ = drain(S.last_states(_audit(d)), "counts")
    return S.live_counts(table)


@query("activity_feed_stream", with_views(f"SELECT id, factura_id, accion, {duck_ts('created_at')} AS ts FROM auditoria ORDER BY created_at DESC, id DESC LIMIT 20", "auditoria"))
def activity_feed_stream(d):
    table, _ = drain(_audit(d), "feed", mode="append", shape=lambda b: S.newest_rows(b, 20))
    return S.newest_rows(table, 20).select("id", "factura_id", "accion", ts("ts").alias("ts"))


@query("jobs_stateful_stream", f"""WITH e AS (SELECT user_id AS factura_id, epoch_us(ts)//1000 AS ms, CASE event_type WHEN 'view' THEN 'PENDIENTE' WHEN 'click' THEN 'EN_PROCESO' WHEN 'error' THEN 'ERROR' ELSE 'COMPLETADO' END AS estado FROM events),
    f AS (SELECT *, estado='EN_PROCESO' AND (lead(ms) OVER w > ms+900000 OR (lead(ms) OVER w IS NULL AND ms+900000 <= (SELECT max(ms) FROM e)-600000)) AS stuck,
      count(*) FILTER (estado IN ('COMPLETADO','ERROR')) OVER (PARTITION BY factura_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS seg FROM e WINDOW w AS (PARTITION BY factura_id ORDER BY ms)),
    g AS (SELECT *, count(*) FILTER (stuck) OVER (PARTITION BY factura_id, seg ORDER BY ms ROWS UNBOUNDED PRECEDING) AS nth FROM f)
    SELECT factura_id, estado, ms, false AS recovered FROM g WHERE estado IN ('COMPLETADO','ERROR') UNION ALL
    SELECT factura_id, CASE WHEN nth%2=0 THEN 'ERROR' ELSE 'PENDIENTE' END, ms+900000, true FROM g WHERE stuck""")
def jobs_stateful_stream(d):
    """The events of a user stand for those of one job."""
    kind = F.col("event_type")
    estado = F.when(kind == "view", "PENDIENTE").when(kind == "click", "EN_PROCESO").when(kind == "error", "ERROR").otherwise("COMPLETADO")
    return track_jobs(_events(d).select(F.col("user_id").alias("factura_id"), estado.alias("estado"), F.unix_millis("ts").alias("ms")))


@query("late_rows_stream", """WITH e AS (SELECT epoch_us(ts) AS u FROM events), m AS (SELECT max(u) AS newest, (min(u)//1000000 + max(u)//1000000)/2 AS middle FROM e)
    SELECT (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM e, m WHERE u//1000000<=middle AND (u//60000000+1)*60000000 <= newest-600000000) AS late""")
def late_rows_stream(d):
    """Rows that come too late when the older half of the log arrives after the newer half."""
    folder = shared_folder(d.spark, "halves")
    log = d.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = log.agg((F.unix_seconds(F.min("ts")) + F.unix_seconds(F.max("ts"))) / 2).scalar()
    newer = F.unix_seconds("ts") > middle
    log.filter(newer).write.parquet(f"{folder}/a")
    files = len(d.spark.read.parquet(f"{folder}/a").inputFiles())
    log.filter(~newer).write.parquet(f"{folder}/b")
    # the newer half is one batch, however many files it has; the older half follows in as many files at a time
    stream = d.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)
    return S.late_rows(stream).agg(F.sum("rows").alias("n"), F.sum("late").alias("late"))


@query("late_rows_none", "SELECT count(*) AS n, 0::BIGINT AS late FROM events")
def late_rows_none(d):
    """The log in one batch: there is no watermark yet, so nothing is late."""
    return S.late_rows(table_stream(d.spark, d.dir, "events", 10**9).withColumn("ts", F.col("ts").cast("timestamp"))).agg(
        F.sum("rows").alias("n"), F.sum("late").alias("late"))


@query("throughput_over_50", f"""SELECT {duck_ts('minute')} AS minute, count(*) AS n, count(*)>50 AS over_limit FROM (
    SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * floor(sqrt((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01'))//60000000))::BIGINT AS minute FROM events) GROUP BY minute""")
def throughput_over_50(d):
    """The documented limit of fifty a minute.  Time runs as its square root, so that minutes fill up."""
    start = 1704067200
    squeezed = F.timestamp_seconds(F.lit(start) + 60 * F.floor(F.sqrt(F.floor((F.unix_micros("ts") - start * 1_000_000) / 60_000_000))))
    return S.throughput(_events(d).withColumn("ts", squeezed)).select(ts("minute").alias("minute"), "n", "over_limit")


def _limited(d, n, minutes, scale):
    """User actions with time run faster by ``scale``, so that users go over the limit."""
    log = _events(d)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    fast = F.timestamp_micros((F.unix_micros(start) + F.floor((F.unix_micros("ts") - F.unix_micros(start)) / scale)).cast("long"))
    return S.rate_limits(log.withColumn("ts", fast), n, minutes, minutes).select("user_id", ts("start").alias("start"), "n")


def _limited_sql(n, minutes, scale):
    return f"""SELECT user_id, {duck_ts('start')} AS start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL {minutes} MINUTE,
        make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01'))//{scale})) AS start FROM events) GROUP BY 1,2 HAVING count(*)>{n}"""


@query("uploads_per_hour", _limited_sql(K.UPLOADS_PER_HOUR, 60, 400))
def uploads_per_hour(d):
    return _limited(d, K.UPLOADS_PER_HOUR, 60, 400)


@query("logins_per_15_min", _limited_sql(K.LOGINS_PER_15_MIN, 15, 400))
def logins_per_15_min(d):
    return _limited(d, K.LOGINS_PER_15_MIN, 15, 400)


_SINCE = f"""SELECT c.asesoria_id, m.estado, m.since_day FROM (SELECT factura_id, {_MOVE} AS estado, strftime(created_at, '%Y-%m-%d') AS since_day,
    row_number() OVER (PARTITION BY factura_id ORDER BY created_at DESC, id DESC) rn FROM auditoria WHERE accion<>'EDITADA') m
    JOIN facturas f ON f.id=m.factura_id JOIN clientes c ON c.id=f.cliente_id WHERE rn=1"""


def _rollup(d):
    firms = d.facturas.join(d.clientes.select(F.col("id").alias("cliente_id"), "asesoria_id"), "cliente_id").select(F.col("id").alias("factura_id"), "asesoria_id")
    return B.state_rollup(_audit(d), firms)


@query("state_rollup_stream", with_views("SELECT asesoria_id, estado, since_day, count(*) AS n FROM since GROUP BY ALL", "auditoria", "facturas", "clientes", since=_SINCE))
def state_rollup_stream(d):
    return B.rollup_rows(_rollup(d))


@query("state_counts_from_deltas", with_views("SELECT asesoria_id, estado, count(*) AS count FROM since GROUP BY ALL", "auditoria", "facturas", "clientes", since=_SINCE))
def state_counts_from_deltas(d):
    return B.rollup_by_state(_rollup(d))
