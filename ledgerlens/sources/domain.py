"""Domain relations (firms, clients, invoices, jobs, audit, ...) as views over the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.windows import number_within


def control_digit(digits: Column) -> Column:
    """CIF control digit from seven digits."""
    def d(i):
        return F.substring(digits, i, 1).cast("int")

    odd = sum((d(i) * 2 - F.when(d(i) >= 5, 9).otherwise(0) for i in (1, 3, 5, 7)), F.lit(0))
    return (F.lit(10) - (odd + d(2) + d(4) + d(6)) % 10) % 10


def make_cif(letter: str, key: Column) -> Column:
    digits = F.lpad(key.cast("string"), 7, "0")
    return F.concat(F.lit(letter), digits, control_digit(digits).cast("string"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Even out rows by key before work that is bound by the processor.

    Pattern matching takes about a millisecond per document and moving the document once takes microseconds,
    so the number of tasks should not hang on how the input files happen to be cut.  The partition count is
    the session's and, being explicit, is not coalesced by size afterwards.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)


#: Order of the lines inside an invoice.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")


def with_line_cents(lines: DataFrame) -> DataFrame:
    """``_c`` amount and ``_p`` unit price in whole cents, ``_q`` whole quantity: exact halves on every engine."""
    amount = F.expr("(cast(round(l_extendedprice * 100) as bigint) * cast(round((1 - l_discount) * 100) as bigint) + 50) div 100")
    counted = lines.withColumn("_c", amount).withColumn("_q", F.col("l_quantity").cast("bigint"))
    return counted.withColumn("_p", F.expr("(2 * _c + _q) div (2 * _q)"))


class Domain:
    """Each property is a lazy DataFrame; nothing is read before a query needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.files_per_trigger: int | None = None  # for streams over the tables; None: the streams' own

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def asesorias(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("nombre"),
            F.when(F.col("n_regionkey") == 0, "INACTIVA").otherwise("ACTIVA").alias("estado"),
        )

    @cached_property
    def clientes(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"),
            F.col("c_nationkey").cast("bigint").alias("asesoria_id"),
            F.col("c_name").alias("nombre"),
            F.when(key % 11 != 0, make_cif("B", key)).alias("cif"),
            F.when(F.col("c_acctbal") < 0, "INACTIVA").otherwise("ACTIVA").alias("estado"),
        )

    @cached_property
    def proveedores(self) -> DataFrame:
        key = F.col("s_suppkey")
        digits = F.lpad(key.cast("string"), 7, "0")
        wrong = (control_digit(digits) + F.when(key % 7 == 0, 1).otherwise(0)) % 10
        return self.table("supplier").select(
            key.alias("id"),
            F.col("s_name").alias("nombre"),
            F.concat(F.lit("A"), digits, wrong.cast("string")).alias("cif"),
        )

    @cached_property
    def productos(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("descripcion"), F.col("p_retailprice").alias("precio")
        )

    @cached_property
    def usuarios(self) -> DataFrame:
        user = F.col("user_id")
        roles = F.array(*[F.lit(r) for r in K.USER_ROLES])
        rol = F.element_at(roles, (user % 5 + 1).cast("int"))
        return (
            self.table("events").groupBy("user_id").agg(F.lit(1).alias("_")).select(
                user.alias("id"),
                (user % 25).alias("asesoria_id"),
                F.concat(F.lit("Usuario "), user.cast("string")).alias("nombre"),
                rol.alias("rol"),
                F.when(user % 5 == 4, "EMPRESA").otherwise("ASESORIA").alias("tipo_usuario"),
                F.when(user % 5 == 4, user).alias("cliente_id"),
                (user % 9 != 0).alias("activo"),
            )
        )

    @cached_property
    def facturas(self) -> DataFrame:
        """Invoices without the supplier of their first line."""
        key, st = F.col("o_orderkey"), F.col("o_orderstatus")
        estado = (
            F.when(st == "F", F.when(key % 4 == 0, "RECHAZADA").otherwise("VALIDADA"))
            .when(st == "P", F.when(key % 3 == 0, "PROCESADA_IA").otherwise("PENDIENTE_REVISION"))
            .when(key % 5 == 0, "ERROR_PROCESAMIENTO")
            .when(key % 5 == 1, "EN_PROCESO")
            .otherwise("SUBIDA")
        )
        return self.table("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("cliente_id"),
            estado.alias("estado"),
            F.col("o_orderdate").alias("created_at"),
            ((key % 100) / 100).cast("double").alias("confianza_ia"),
            F.when(st == "F", key % 50).alias("validado_por"),
            F.when(key % 13 != 0, F.concat(F.lit("FI2026"), F.lpad(key.cast("string"), 8, "0"))).alias("numero_factura"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"),
            F.col("o_totalprice").alias("total"),
        )

    def supplier_of_first_line(self, lines: DataFrame) -> DataFrame:
        """Supplier of the first line of each invoice; a map-side minimum, not a sort of the lines."""
        order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        first = lines.groupBy("l_orderkey").agg(F.min(order).alias("first"))
        suppliers = self.table("supplier").select("s_suppkey", F.col("s_name").alias("proveedor_nombre"))
        return first.select(
            F.col("l_orderkey").alias("id"), F.col("first.l_suppkey").alias("s_suppkey")
        ).join(suppliers, "s_suppkey", "left").select("id", F.col("s_suppkey").alias("proveedor_id"), "proveedor_nombre")

    @cached_property
    def first_supplier(self) -> DataFrame:
        return self.supplier_of_first_line(self.table("lineitem"))

    @cached_property
    def facturas_con_proveedor(self) -> DataFrame:
        return self.facturas.join(self.first_supplier, "id", "left")

    @cached_property
    def facturas_json(self) -> DataFrame:
        """Invoices as stored after the JSON migration: state columns plus one JSON document."""
        f = self.facturas_con_proveedor
        blob = F.to_json(
            F.struct("numero_factura", "fecha", F.col("proveedor_nombre").alias("proveedor"), "total")
        )
        return f.select(
            "id", "cliente_id", "estado", "created_at", "confianza_ia", "validado_por", blob.alias("documento_json")
        )

    @cached_property
    def lineas(self) -> DataFrame:
        raw = self.table("lineitem").select("l_orderkey", *LINE_ORDER)
        numbered = number_within(
            raw, ["l_orderkey"], [F.col(c) for c in LINE_ORDER], [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 65536)], "orden"
        )
        return with_line_cents(numbered).select(
            F.col("l_orderkey").alias("factura_id"),
            "orden",
            F.col("l_partkey").alias("producto_id"),
            F.col("l_suppkey").alias("proveedor_id"),
            F.col("l_quantity").alias("cantidad"),
            (F.col("_p") / 100).alias("precio_unitario"),
            (F.col("_c") / 100).alias("importe"),
        )

    @cached_property
    def n_orders(self) -> Column:
        """Number of invoices as a scalar subquery column (one parquet-footer count)."""
        return self.table("orders").agg(F.count(F.lit(1)).alias("n")).scalar()

    @cached_property
    def documentos(self) -> DataFrame:
        doc = F.col("doc_id")
        channels = F.array(*[F.lit(c) for c in K.CHANNELS])
        return self.table("documents").select(
            doc.alias("id"),
            (doc % self.n_orders).alias("factura_id"),
            F.col("source").alias("batch_id"),
            F.element_at(channels, (doc % 3 + 1).cast("int")).alias("canal_entrada"),
            F.concat(F.lit("doc_"), doc.cast("string"), F.when(doc % 4 == 0, ".pdf").when(doc % 4 == 1, ".jpg")
                     .when(doc % 4 == 2, ".PNG").otherwise(".docx")).alias("nombre_archivo"),
            F.col("n_chars").alias("tamano_bytes"),
            F.sha2("text", 256).alias("hash_archivo"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 60)").alias("fecha_subida"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        kind = F.col("event_type")
        estado = (
            F.when(kind == "view", "PENDIENTE").when(kind == "click", "EN_PROCESO")
            .when(kind == "error", "ERROR").otherwise("COMPLETADO")
        )
        # whole seconds keep timestamp arithmetic equal on every engine
        seconds = F.floor(F.col("value")).cast("bigint")
        done = kind.isin("purchase", "signup", "error")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            (F.col("event_id") % self.n_orders).alias("factura_id"),
            estado.alias("estado"),
            F.when(kind != "view", F.col("ts")).alias("started_at"),
            F.when(done, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("finished_at"),
            F.when(kind == "error", F.lit("fallo")).alias("error_message"),
            (F.col("user_id") % 3).alias("retry_count"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def auditoria(self) -> DataFrame:
        kind = F.col("event_type")
        accion = (
            F.when(kind == "signup", "SUBIDA").when(kind == "view", "PROCESAMIENTO_INICIADO")
            .when(kind == "click", "EDITADA").when(kind == "purchase", "VALIDADA").otherwise("ERROR_PROCESAMIENTO")
        )
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("usuario_id"),
            (F.col("event_id") % self.n_orders).alias("factura_id"),
            accion.alias("accion"),
            F.col("props").alias("detalle_json"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def uploads(self) -> DataFrame:
        """Files as they arrive at the upload endpoint: three of four kinds, sizes up to 12.5 MB."""
        doc = F.col("doc_id")
        mime = (
            F.when(doc % 4 == 0, "application/pdf").when(doc % 4 == 1, "image/jpeg")
            .when(doc % 4 == 2, "image/png").otherwise("application/msword")
        )
        return self.documentos.select(
            F.col("id").alias("doc_id"), "batch_id", "canal_entrada", "nombre_archivo", "hash_archivo", "fecha_subida",
            (F.col("tamano_bytes") * 1000).alias("tamano_bytes"),
        ).select(
            "*", mime.alias("tipo_mime"), (doc % 31).alias("usuario_id"), (doc % 1700).alias("cliente_id"),
            (doc % 25).alias("asesoria_id"),
        )
