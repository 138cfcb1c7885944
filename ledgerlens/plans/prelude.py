"""The domain views once more, as DuckDB common table expressions for the oracle."""

from __future__ import annotations

_ODD = "(CASE WHEN substr({d},{i},1)::INT >= 5 THEN substr({d},{i},1)::INT*2-9 ELSE substr({d},{i},1)::INT*2 END)"


def control(d: str) -> str:
    odd = "+".join(_ODD.format(d=d, i=i) for i in (1, 3, 5, 7))
    even = "+".join(f"substr({d},{i},1)::INT" for i in (2, 4, 6))
    return f"((10 - ({odd}+{even}) % 10) % 10)"


_C = "lpad(c_custkey::VARCHAR,7,'0')"
_S = "lpad(s_suppkey::VARCHAR,7,'0')"

VIEWS = {
    "asesorias": """SELECT n_nationkey::BIGINT AS id, n_name AS nombre,
        CASE WHEN n_regionkey=0 THEN 'INACTIVA' ELSE 'ACTIVA' END AS estado FROM nation""",
    "clientes": f"""SELECT c_custkey AS id, c_nationkey::BIGINT AS asesoria_id, c_name AS nombre,
        CASE WHEN c_custkey%11<>0 THEN 'B'||{_C}||{control(_C)}::VARCHAR END AS cif,
        CASE WHEN c_acctbal<0 THEN 'INACTIVA' ELSE 'ACTIVA' END AS estado FROM customer""",
    "proveedores": f"""SELECT s_suppkey AS id, s_name AS nombre,
        'A'||{_S}||(({control(_S)} + CASE WHEN s_suppkey%7=0 THEN 1 ELSE 0 END)%10)::VARCHAR AS cif FROM supplier""",
    "productos": "SELECT p_partkey AS id, p_name AS descripcion, p_retailprice AS precio FROM part",
    "usuarios": """SELECT user_id AS id, user_id%25 AS asesoria_id, 'Usuario '||user_id::VARCHAR AS nombre,
        (['ADMIN','CONTABILIDAD','REVISOR','LECTURA','EMPRESA_UPLOAD'])[(user_id%5+1)::INT] AS rol,
        CASE WHEN user_id%5=4 THEN 'EMPRESA' ELSE 'ASESORIA' END AS tipo_usuario,
        CASE WHEN user_id%5=4 THEN user_id END AS cliente_id, user_id%9<>0 AS activo
        FROM (SELECT DISTINCT user_id FROM events)""",
    "facturas": """SELECT o_orderkey AS id, o_custkey AS cliente_id,
        CASE WHEN o_orderstatus='F' THEN CASE WHEN o_orderkey%4=0 THEN 'RECHAZADA' ELSE 'VALIDADA' END
             WHEN o_orderstatus='P' THEN CASE WHEN o_orderkey%3=0 THEN 'PROCESADA_IA' ELSE 'PENDIENTE_REVISION' END
             WHEN o_orderkey%5=0 THEN 'ERROR_PROCESAMIENTO' WHEN o_orderkey%5=1 THEN 'EN_PROCESO' ELSE 'SUBIDA' END AS estado,
        o_orderdate AS created_at, (o_orderkey%100)/100.0::DOUBLE AS confianza_ia,
        CASE WHEN o_orderstatus='F' THEN o_orderkey%50 END AS validado_por,
        CASE WHEN o_orderkey%13<>0 THEN 'FI2026'||lpad(o_orderkey::VARCHAR,8,'0') END AS numero_factura,
        strftime(o_orderdate,'%Y-%m-%d') AS fecha, o_totalprice AS total FROM orders""",
    "first_supplier": """SELECT l_orderkey AS id, l_suppkey AS proveedor_id, s_name AS proveedor_nombre FROM (
        SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS rn FROM lineitem)
        LEFT JOIN supplier ON l_suppkey=s_suppkey WHERE rn=1""",
    "facturas_p": "SELECT f.*, p.proveedor_id, p.proveedor_nombre FROM facturas f LEFT JOIN first_supplier p USING (id)",
    "lineas": """SELECT factura_id, orden, producto_id, proveedor_id, cantidad, precio_c/100 AS precio_unitario, importe_c/100 AS importe, precio_c, importe_c FROM (
        SELECT *, (2*importe_c + cantidad::BIGINT)//(2*cantidad::BIGINT) AS precio_c FROM (
        SELECT l_orderkey AS factura_id, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_discount) AS orden,
        l_partkey AS producto_id, l_suppkey AS proveedor_id, l_quantity AS cantidad,
        (round(l_extendedprice*100)::BIGINT * round((1-l_discount)*100)::BIGINT + 50)//100 AS importe_c FROM lineitem))""",
    "documentos": """SELECT doc_id AS id, doc_id % (SELECT count(*) FROM orders) AS factura_id, source AS batch_id,
        (['web','mobile_camera','mobile_gallery'])[(doc_id%3+1)::INT] AS canal_entrada,
        'doc_'||doc_id::VARCHAR||CASE doc_id%4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.PNG' ELSE '.docx' END AS nombre_archivo,
        n_chars AS tamano_bytes, sha256(text) AS hash_archivo,
        TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id AS fecha_subida FROM documents""",
    "jobs": """SELECT event_id AS id, event_id % (SELECT count(*) FROM orders) AS factura_id,
        CASE event_type WHEN 'view' THEN 'PENDIENTE' WHEN 'click' THEN 'EN_PROCESO' WHEN 'error' THEN 'ERROR' ELSE 'COMPLETADO' END AS estado,
        CASE WHEN event_type<>'view' THEN ts END AS started_at,
        CASE WHEN event_type IN ('purchase','signup','error') THEN ts + INTERVAL 1 SECOND * floor(value)::BIGINT END AS finished_at,
        CASE WHEN event_type='error' THEN 'fallo' END AS error_message, user_id%3 AS retry_count, ts AS created_at FROM events""",
    "auditoria": """SELECT event_id AS id, user_id AS usuario_id, event_id % (SELECT count(*) FROM orders) AS factura_id,
        CASE event_type WHEN 'signup' THEN 'SUBIDA' WHEN 'view' THEN 'PROCESAMIENTO_INICIADO' WHEN 'click' THEN 'EDITADA'
          WHEN 'purchase' THEN 'VALIDADA' ELSE 'ERROR_PROCESAMIENTO' END AS accion, props AS detalle_json, ts AS created_at FROM events""",
    "uploads": """SELECT id AS doc_id, batch_id, canal_entrada, nombre_archivo, hash_archivo, fecha_subida,
        tamano_bytes*1000 AS tamano_bytes,
        CASE id%4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' ELSE 'application/msword' END AS tipo_mime,
        id%31 AS usuario_id, id%1700 AS cliente_id, id%25 AS asesoria_id FROM documentos""",
}
_NEEDS = {
    "facturas_p": ("facturas", "first_supplier"), "uploads": ("documentos",),
}


def with_views(sql: str, *names: str, **extra: str) -> str:
    """``WITH`` clause of the named views (and what they need) in front of a query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql if parts else sql
