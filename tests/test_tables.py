"""Properties of table operators, with keys that hold most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import invoices as I
from ledgerlens.operators import jobs as J
from ledgerlens.operators import numbering as N
from ledgerlens.operators import parties as P
from ledgerlens.operators import uploads as U
from ledgerlens.operators.windows import first_per, join_summary, last_before, number_rows, number_within
from ledgerlens.sources.files import manifest, read_files, read_text_corpus, write_results


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 40), rng.randint(0, 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, k bigint, day bigint").repartition(7)


def test_number_within_equals_sorting(spark):
    rows, df = skewed(spark)
    got = {r.id: r.n for r in number_within(df, ["k"], [F.col("day"), F.col("id")], [F.col("day")], "n").collect()}
    want, seen = {}, {}
    for i, k, day in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_number_rows_is_dense(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    got = sorted(r.n for r in number_rows(df, "key", 10, "n").collect())
    assert got == list(range(11, 5011))


def test_last_before_equals_scan(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 2), rng.randint(0, 9), rng.choice([None, "a", "b"])) for i in range(800)]
    df = spark.createDataFrame(rows, "id bigint, k int, day int, v string").repartition(5)
    got = {r.id: r.out for r in last_before(df, ["k"], ["day", "id"], F.col("day"), "v", "out").collect()}
    last, want = {}, {}
    for i, k, day, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want


def test_join_summary_covers_each_row_once(spark):
    rows, df = skewed(spark)
    s = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_summary(df, s, "k", "n", share=10).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)


def test_first_per_is_stable_under_repartition(spark):
    _, df = skewed(spark)
    one = {(r.k, r.id) for r in first_per(df, ["k"], [F.col("day"), F.col("id")]).collect()}
    two = {(r.k, r.id) for r in first_per(df.repartition(3), ["k"], [F.col("day"), F.col("id")]).collect()}
    assert one == two


def test_numbers_continue_without_gaps(spark):
    _, df = skewed(spark)
    inv = df.select("id", F.col("k").alias("cliente_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(day as int))").alias("created_at"))
    counters = spark.createDataFrame([(1, 5)], "cliente_id bigint, ultimo_correlativo bigint")
    numbered, after = N.assign_correlative(inv, counters)
    ones = sorted(r.numero_correlativo for r in numbered.filter("cliente_id = 1").collect())
    assert ones == list(range(6, 6 + len(ones)))
    assert after.filter("cliente_id = 1").first().ultimo_correlativo == 5 + len(ones)
    assert N.numbering_gaps(N.backfill_correlative(inv)).count() == 0


def test_requeue_rules(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, 1L, 'EN_PROCESO', timestamp_ntz'2024-01-01 00:00:00', null, '', 0L), (2L, 2L, 'EN_PROCESO', timestamp_ntz'2024-01-01 00:00:00', null, 'x', 1L),
      (3L, 3L, 'EN_PROCESO', timestamp_ntz'2024-01-02 00:00:00', null, null, 0L) AS t(id, factura_id, estado, started_at, finished_at, error_message, retry_count)""").withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
    inv = spark.createDataFrame([(1, "EN_PROCESO"), (2, "EN_PROCESO"), (3, "EN_PROCESO")], "id bigint, estado string")
    now = F.lit("2024-01-03").cast("timestamp_ntz")
    jobs, invoices = J.requeue_stale(df, inv, now, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    got = {r.id: (r.estado, r.retry_count, r.started_at is None) for r in jobs.collect()}
    assert got == {1: ("PENDIENTE", 1, True), 2: ("ERROR", 2, False), 3: ("EN_PROCESO", 0, False)}
    assert jobs.filter("id = 2").first().error_message.startswith("x | ")
    assert {r.id: r.estado for r in invoices.collect()} == {1: "SUBIDA", 2: "ERROR_PROCESAMIENTO", 3: "EN_PROCESO"}


def test_supplier_gets_missing_cif(spark):
    known = spark.createDataFrame([(1, "Casa Sol S.L.", None), (2, "Viejo", "A1")], "id bigint, nombre string, cif string")
    new = spark.createDataFrame([(1, "CASA SOL", "B9"), (2, "Nuevo Nombre", "A1"), (3, "Tercero", None), (4, "TERCERO, S.A.", None)], "seq bigint, nombre string, cif string")
    mapping, after = P.resolve_suppliers(new, known)
    assert {r.nombre: r.proveedor_id for r in mapping.collect()} == {"CASA SOL": 1, "Nuevo Nombre": 2, "Tercero": 3, "TERCERO, S.A.": 3}
    assert {(r.id, r.nombre, r.cif) for r in after.collect()} == {(1, "Casa Sol S.L.", "B9"), (2, "Nuevo Nombre", "A1"), (3, "Tercero", None)}


def test_duplicates_point_at_the_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, hash_archivo string")
    assert {(r.id, r.first_id) for r in U.duplicate_documents(df).collect()} == {(1, 1), (3, 1)}


def test_files_in_and_results_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "in" / "b.txt").write_text("hola\nmundo")
    files = read_files(spark, str(tmp_path / "in"))
    admitted = {r.nombre_archivo: r.accepted for r in U.admit_files(files.drop("content")).collect()}
    assert admitted == {"a.pdf": True, "b.txt": False}
    m = manifest(files, F.lit("upl_1")).collect()
    assert {len(r.hash_archivo) for r in m} == {64}
    assert read_text_corpus(spark, str(tmp_path / "in" / "b.txt")).first().text == "hola\nmundo"
    out = str(tmp_path / "out")
    write_results(spark.createDataFrame([(1, "2026-03-01"), (2, "")], "cliente_id bigint, fecha string"), out)
    assert {r.mes for r in spark.read.parquet(out).collect()} == {"2026-03", "unknown"}


def test_plans_stay_native(spark, sf_dir):
    import __spark_entry__ as entry

    for name, plan in entry.queries().items():
        if name.endswith("_stream") or name in ("throughput_per_minute", "upload_rate_limit"):
            continue
        text = plan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "PythonUDF" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text, name


@pytest.mark.parametrize("sort_by, sort_dir", [("created_at", "desc"), ("created_at", "asc"), ("total", "desc"), ("total", "asc"), ("cliente", "asc"), ("cliente", "desc")])
def test_seeking_equals_offsets(spark, sort_by, sort_dir):
    rng = random.Random(3)
    day = lambda: None if rng.random() < 0.2 else dt.datetime(2024, 1, rng.randint(1, 3))
    rows = [(k, day(), rng.choice([None, 1.0, 2.5, 2.5, 7.0]), rng.choice([None, "a", "b"])) for k in range(137)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, total double, cliente_nombre string").repartition(5)
    last, page = None, 1
    while True:
        sought = I.seek_page(df, last, sort_by, sort_dir, 10).collect()
        assert sought == I.invoice_page(df, sort_by, sort_dir, page, 10).collect()
        if not sought:
            break
        last, page = sought[-1], page + 1
    assert page == 15


def test_deep_page_is_bounded_at_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as id", "o_orderdate as created_at", "o_totalprice as total")
    deep = orders.orderBy(F.col("total").asc(), F.col("created_at").desc(), F.col("id").desc()).offset(1000).limit(1).first()
    plan = I.seek_page(orders, deep, "total", "asc")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice,GreaterThanOrEqual" in plan.replace(" ", "") or "GreaterThanOrEqual(o_totalprice" in plan
    assert "TakeOrderedAndProject" in plan


def test_rules_scan_each_table_once(spark, tmp_path):
    from ledgerlens.operators.checks import schema_report

    shapes = {
        "invoices": "id long, estado string, cliente_id long", "clients": "id long, estado string", "users": "id long, tipo_usuario string, cliente_id long, rol string",
        "documents": "id long, canal_entrada string, factura_id long", "jobs": "id long, estado string, factura_id long", "audit": "id long, usuario_id long",
    }
    rows = {
        "invoices": [(1, "SUBIDA", 7), (2, None, 8), (2, "XX", None)], "clients": [(7, "ACTIVA"), (None, "ACTIVA")],
        "users": [(5, "EMPRESA", None, "LECTURA"), (6, "ASESORIA", 9, "ROOT")], "documents": [(1, "web", 1), (2, "fax", 3)],
        "jobs": [(1, "ERROR", 2)] * 50, "audit": [(1, 5), (2, 4), (3, 4), (4, None)],
    }
    for name, shape in shapes.items():
        spark.createDataFrame(rows[name], shape).write.parquet(f"{tmp_path}/{name}")
    report = schema_report(*[spark.read.parquet(f"{tmp_path}/{n}") for n in shapes])
    got = {(r.tabla, r.regla): r.n_bad for r in report.collect()}
    assert got == {
        ("facturas", "estado"): 2, ("facturas", "fk_cliente"): 1, ("clientes", "estado"): 0, ("usuarios", "empresa_cliente"): 1, ("usuarios", "rol"): 1,
        ("usuarios", "fk_cliente"): 1, ("documentos_subidos", "canal"): 1, ("documentos_subidos", "fk_factura"): 1, ("processing_jobs", "estado"): 0,
        ("processing_jobs", "fk_factura"): 0, ("auditoria", "fk_usuario"): 2,
    }
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 6
