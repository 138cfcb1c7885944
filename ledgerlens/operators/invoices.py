"""Invoice list, search, detail: filters, joins, projections, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import document_code
from .windows import first_per

# sort keys a caller may use; anything else sorts by creation time
SORT_KEYS = {
    "created_at": "created_at",
    "fecha_procesado": "fecha_procesado",
    "fecha_factura": "fecha",
    "total": "total",
    "proveedor": "proveedor_nombre",
    "cliente": "cliente_nombre",
    "fecha_subida": "documento_fecha_subida",
}


def dimension_scan(df: DataFrame, order_by: str) -> DataFrame:
    return df.orderBy(F.col(order_by).asc_nulls_last(), F.col("id"))


def lookup(df: DataFrame, key: Column) -> DataFrame:
    """Rows for a key predicate; the predicate reaches the Parquet row groups."""
    return df.filter(key)


def with_client(invoices: DataFrame, clients: DataFrame) -> DataFrame:
    side = clients.select(
        F.col("id").alias("cliente_id"),
        F.col("nombre").alias("cliente_nombre"),
        F.col("cif").alias("cliente_cif"),
        "asesoria_id",
    )
    return invoices.join(side, "cliente_id", "left")


def latest_job(jobs: DataFrame) -> DataFrame:
    return first_per(jobs, ["factura_id"], [F.col("created_at").desc_nulls_first(), F.col("id").desc()])


def latest_document(documents: DataFrame) -> DataFrame:
    return first_per(documents, ["factura_id"], [F.col("fecha_subida").desc_nulls_first(), F.col("id").desc()])


def with_latest_job(invoices: DataFrame, jobs: DataFrame) -> DataFrame:
    cols = ["id", "estado", "started_at", "finished_at", "error_message", "retry_count", "created_at"]
    side = latest_job(jobs).select(
        F.col("factura_id").alias("_fid"), *[F.col(c).alias(f"job_{c}") for c in cols]
    )
    return invoices.join(side, invoices["id"] == side["_fid"], "left").drop("_fid")


def with_latest_document(invoices: DataFrame, documents: DataFrame) -> DataFrame:
    cols = ["id", "batch_id", "canal_entrada", "fecha_subida", "nombre_archivo"]
    side = latest_document(documents).select(
        F.col("factura_id").alias("_fid"), *[F.col(c).alias(f"documento_{c}") for c in cols]
    )
    return invoices.join(side, invoices["id"] == side["_fid"], "left").drop("_fid")


def with_reviewer(invoices: DataFrame, clients: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("id").alias("validado_por"), F.col("nombre").alias("validado_por_nombre"))
    return with_client(invoices, clients).join(names, "validado_por", "left")


def filter_invoices(
    df: DataFrame, asesoria=None, estado=None, company=None, channel=None, batch=None
) -> DataFrame:
    """Conjunction of the filters that were given."""
    wanted = {
        "asesoria_id": asesoria, "estado": estado, "cliente_id": company,
        "documento_canal_entrada": channel, "documento_batch_id": batch,
    }
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def text_predicate(term: str) -> Column:
    """Case-insensitive containment over number, supplier, client and file name.  ``%`` and ``_`` in the
    term keep their wildcard meaning."""
    hit = F.lit(False)
    for name in ("numero_factura", "proveedor_nombre", "cliente_nombre", "documento_nombre_archivo"):
        hit = hit | F.coalesce(F.col(name), F.lit("")).ilike(f"%{term}%")
    return hit


def code_of(term: str) -> int | None:
    """Number behind ``DOC-000123`` or ``123``; None when the term is not a number."""
    bare = re.sub(r"^DOC-?", "", term.strip().upper()).lstrip("0")
    return int(bare) if re.fullmatch(r"[0-9]+", bare) else None


def search(df: DataFrame, term: str | None) -> DataFrame:
    """Keyword search; a term that is a document code also matches correlative and id."""
    if not term:
        return df
    predicate, number = text_predicate(term), code_of(term)
    if number is not None:
        predicate = predicate | F.coalesce(F.col("numero_correlativo") == number, F.lit(False)) | (F.col("id") == number)
    return df.filter(predicate)


def visible_counts(invoices: DataFrame, clients: DataFrame, users: DataFrame) -> DataFrame:
    """How many invoices each user may open: company users those of their own client if it belongs to their firm, firm
    users those of their firm.

    Invoices are counted per client before users are joined, so (user, invoice) pairs never materialise.
    """
    per_client = invoices.groupBy("cliente_id").agg(F.count(F.lit(1)).alias("n"))
    own = per_client.join(clients.select(F.col("id").alias("cliente_id"), "asesoria_id"), "cliente_id")
    company = (F.col("tipo_usuario") == "EMPRESA") & F.col("cliente_id").isNotNull()
    by_company = users.filter(company).select(F.col("id").alias("usuario_id"), F.col("asesoria_id").alias("_firm"), "cliente_id")
    same_firm = F.col("asesoria_id").isNull() | F.col("_firm").isNull() | (F.col("asesoria_id") == F.col("_firm"))
    by_firm = users.filter(~F.coalesce(company, F.lit(False))).select(F.col("id").alias("usuario_id"), "asesoria_id")
    seen = own.join(by_company, "cliente_id").filter(same_firm).select("usuario_id", "n").unionByName(
        own.groupBy("asesoria_id").agg(F.sum("n").alias("n")).join(by_firm, "asesoria_id").select("usuario_id", "n")
    )
    return seen.groupBy("usuario_id").agg(F.sum("n").alias("visible"))


def scope_to_user(df: DataFrame, tipo_usuario: str, asesoria_id: int | None, cliente_id: int | None) -> DataFrame:
    """The rows one user may see, as plain predicates."""
    if tipo_usuario == "EMPRESA" and cliente_id is not None:
        df = df.filter(F.col("cliente_id") == cliente_id)
    if asesoria_id is not None:
        df = df.filter(F.col("asesoria_id").isNull() | (F.col("asesoria_id") == asesoria_id))
    return df


def with_eligibility(df: DataFrame) -> DataFrame:
    """What may be done in each state; the review screen and the list use different reprocess rules."""
    st = F.col("estado")
    return df.select(
        "*",
        st.isin(*K.ACTIONABLE_STATES).alias("can_act"),
        st.isin(*K.EDITABLE_STATES).alias("can_edit"),
        st.isin(*K.REPROCESSABLE_STATES).alias("can_reprocess"),
        (~st.isin(*K.LIST_NOT_REPROCESSABLE)).alias("can_reprocess_list"),
        st.isin(*K.ACTIVE_STATES).alias("is_processing"),
    )


def state_domain_flags(df: DataFrame, state: str = "estado", blob: str = "documento_json") -> DataFrame:
    kind = F.schema_of_variant(F.try_parse_json(F.col(blob)))
    return df.select(
        "*",
        F.coalesce(F.col(state).isin(*K.INVOICE_STATES), F.lit(False)).alias("estado_ok"),
        F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("json_ok"),
    )


def sort_columns(sort_by: str = "created_at", sort_dir: str = "desc") -> list[Column]:
    """Order by a whitelisted key; NULLs last when ascending and first when descending; newest first and
    then the id break ties."""
    key = F.col(SORT_KEYS.get(sort_by, "created_at"))
    lead = key.asc_nulls_last() if str(sort_dir).upper() == "ASC" else key.desc_nulls_first()
    return [lead, F.col("created_at").desc_nulls_first(), F.col("id").desc()]


def invoice_page(df: DataFrame, sort_by="created_at", sort_dir="desc", page: int = 1, limit: int = 20) -> DataFrame:
    """One page; planned as a top-n per task followed by a merge."""
    ordered = df.orderBy(*sort_columns(sort_by, sort_dir))
    return (ordered.offset((page - 1) * limit) if page > 1 else ordered).limit(limit)


def _beyond(key: Column, value: Column, ascending: bool) -> Column:
    """Rows whose key comes strictly after a value in the list's order, NULLs included (last if ascending, else first)."""
    if ascending:
        return F.coalesce((key > value) | (key.isNull() & value.isNotNull()), F.lit(False))
    return F.coalesce((key < value) | (key.isNotNull() & value.isNull()), F.lit(False))


def after_row(last: Row, sort_by: str = "created_at", sort_dir: str = "desc") -> Column:
    """Predicate for the rows behind ``last`` (a row of the page before) in the order of ``sort_columns``.

    The literals of the row are compared with plain columns, so the bound on the leading key reaches the scan.
    """
    ascending, lead = str(sort_dir).upper() == "ASC", SORT_KEYS.get(sort_by, "created_at")
    steps = [(lead, ascending), ("created_at", False), ("id", False)]
    found, equal = F.lit(False), F.lit(True)
    for name, up in steps:
        kind = {"id": "long"}.get(name)
        value = F.lit(last[name]) if kind is None else F.lit(last[name]).cast(kind)
        found = found | (equal & _beyond(F.col(name), value, up))
        equal = equal & F.col(name).eqNullSafe(value)
    if last[lead] is None:
        # ascending: only NULLs are left; descending: they come first, so anything may follow
        return (F.col(lead).isNull() & found) if ascending else found
    bound = F.col(lead) >= F.lit(last[lead]) if ascending else F.col(lead) <= F.lit(last[lead])
    return (bound | F.col(lead).isNull() if ascending else bound) & found


def seek_page(df: DataFrame, last: Row | None, sort_by="created_at", sort_dir="desc", limit: int = 20) -> DataFrame:
    """The page behind a row, at the cost of a first page however deep it lies; with None the first page.

    Nothing before the row is sorted or kept: a top-n of ``limit`` rows per task over what the bound lets pass.
    """
    rest = df if last is None else df.filter(after_row(last, sort_by, sort_dir))
    return rest.orderBy(*sort_columns(sort_by, sort_dir)).limit(limit)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def project_json(df: DataFrame, fields: dict[str, str], blob: str = "documento_json") -> DataFrame:
    """Typed fields of a JSON column, parsed once per row; what does not fit its type is NULL."""
    struct = ", ".join(f"{name} string" for name in fields)
    parsed = df.withColumn("_doc", F.from_json(F.col(blob), struct))
    return parsed.select(
        *df.columns,
        *[(F.col(f"_doc.{n}") if t == "string" else F.col(f"_doc.{n}").try_cast(t)).alias(n) for n, t in fields.items()],
    )


def nest_latest(df: DataFrame) -> DataFrame:
    """``job_*`` and ``documento_*`` columns as one struct each, NULL when there was no match."""
    plain = [c for c in df.columns if not c.startswith(("job_", "documento_")) or c == "documento_json"]
    job = [c for c in df.columns if c.startswith("job_")]
    doc = [c for c in df.columns if c.startswith("documento_") and c != "documento_json"]
    return df.select(
        *plain,
        F.when(F.col("job_id").isNotNull(), F.struct(*[F.col(c).alias(c[4:]) for c in job])).alias("job"),
        F.when(F.col("documento_id").isNotNull(), F.struct(*[F.col(c).alias(c[10:]) for c in doc])).alias("documento"),
    )


def invoice_detail(df: DataFrame) -> DataFrame:
    company = F.struct(
        F.col("cliente_id").alias("id"), F.col("cliente_nombre").alias("nombre"), F.col("cliente_cif").alias("cif")
    )
    return df.withColumn("empresa_asociada", F.when(F.col("cliente_id").isNotNull(), company)).drop(
        "cliente_nombre", "cliente_cif"
    )


def with_document_code(df: DataFrame) -> DataFrame:
    return df.withColumn("codigo", document_code(F.col("numero_correlativo"), F.col("id")))


@dataclass(frozen=True)
class InvoiceQuery:
    """Parameters of the invoice list; absent ones do not filter.  ``after``: the last row of the page before, in place of ``page``."""

    asesoria: int | None = None
    estado: str | None = None
    company: int | None = None
    channel: str | None = None
    batch: str | None = None
    search: str | None = None
    sort_by: str = "created_at"
    sort_dir: str = "desc"
    page: int = 1
    limit: int = 20
    after: Row | None = None

    def _needs_documents(self) -> bool:
        """Whether the latest document decides which rows are listed or how they are ordered."""
        return bool(self.channel or self.batch or self.search or self.sort_by == "fecha_subida")

    def matching(self, invoices: DataFrame, clients: DataFrame, documents: DataFrame) -> DataFrame:
        """Rows of the list before paging.  Filters on invoice columns run before the joins, and documents
        are joined only where a filter or the order reads them."""
        own = with_client(filter_invoices(invoices, estado=self.estado, company=self.company), clients)
        scoped = filter_invoices(own, asesoria=self.asesoria)
        if not self._needs_documents():
            return scoped
        joined = with_latest_document(scoped, documents)
        return search(filter_invoices(joined, channel=self.channel, batch=self.batch), self.search)

    def run(self, invoices: DataFrame, clients: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
        """The page is cut first: what only decorates it is then looked up for its few rows."""
        listed = self.matching(invoices, clients, documents)
        if self.after is None:
            page = invoice_page(listed, self.sort_by, self.sort_dir, self.page, self.limit)
        else:
            page = seek_page(listed, self.after, self.sort_by, self.sort_dir, self.limit)
        out = page
        if not self._needs_documents():
            out = with_latest_document(out, rows_of_page(documents, page))
        return with_latest_job(out, rows_of_page(jobs, page)).orderBy(*sort_columns(self.sort_by, self.sort_dir))


def rows_of_page(rows: DataFrame, page: DataFrame, key: str = "factura_id") -> DataFrame:
    """Rows that belong to the invoices of a page.  A limit tells the planner the size of its ids, so that those of a usual
    page are broadcast and those of a very large one are not."""
    return rows.join(page.select(F.col("id").alias(key)), key, "left_semi")
