"""Audit log: trails, latest entries, recent activity, permission checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .windows import first_per, number_within, top_per


def audit_rows(events: DataFrame, detail: list[str]) -> DataFrame:
    """Audit rows for appending, the named columns as JSON detail."""
    return events.select(
        "usuario_id", "factura_id", "accion", F.to_json(F.struct(*detail)).alias("detalle_json"), "ip_address", "created_at"
    )


def with_user_name(audit: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("id").alias("usuario_id"), F.col("nombre").alias("usuario_nombre"))
    return audit.join(names, "usuario_id", "left")


def audit_trail(audit: DataFrame, users: DataFrame, factura_id: int | None = None) -> DataFrame:
    """Entries with user name and ``posicion`` in the trail of their invoice, the newest being 1.

    With ``factura_id`` the trail of one invoice, newest first.  Days split a long trail, undated entries come last.
    """
    rows = audit if factura_id is None else audit.filter(F.col("factura_id") == factura_id)
    back = F.datediff(F.lit("9999-12-31").cast("date"), F.to_date("created_at"))
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    trail = with_user_name(number_within(rows, ["factura_id"], order, [back], "posicion"), users)
    return trail if factura_id is None else trail.orderBy("posicion")


def latest_audit(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Newest entry per (invoice, action)."""
    latest = first_per(audit, ["factura_id", "accion"], [F.col("created_at").desc(), F.col("id").desc()])
    return with_user_name(latest, users)


def recent_activity(
    audit: DataFrame, users: DataFrame, invoices: DataFrame, clients: DataFrame, n: int, asesoria_id: int | None = None
) -> DataFrame:
    """The ``n`` newest entries; names and invoice numbers are joined after the limit."""
    if asesoria_id is None:
        newest = audit.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
        own = newest
    else:
        owned = invoices.select(F.col("id").alias("factura_id"), "cliente_id").join(
            clients.filter(F.col("asesoria_id") == asesoria_id).select(F.col("id").alias("cliente_id")), "cliente_id", "left_semi"
        )
        own = audit.join(owned.select("factura_id"), "factura_id", "left_semi").orderBy(
            F.col("created_at").desc(), F.col("id").desc()
        ).limit(n)
    numbers = invoices.select(F.col("id").alias("factura_id"), "numero_factura")
    return with_user_name(own, users).join(numbers, "factura_id", "left")


def recent_activity_per_firm(
    audit: DataFrame, users: DataFrame, invoices: DataFrame, clients: DataFrame, n: int
) -> DataFrame:
    """The ``n`` newest entries of every firm, with their position."""
    owner = invoices.select(F.col("id").alias("factura_id"), "cliente_id", "numero_factura").join(
        clients.select(F.col("id").alias("cliente_id"), "asesoria_id"), "cliente_id"
    )
    joined = audit.join(owner, "factura_id")
    newest = top_per(joined, ["asesoria_id"], [F.col("created_at").desc(), F.col("id").desc()], n)
    return with_user_name(newest, users)


def allowed(accion: Column, rol: Column, tipo_usuario: Column) -> Column:
    """Whether a role may do an action; actions without a rule are open."""
    ok = F.lit(True)
    rule = None
    for action, (roles, firm_only) in K.ACTION_PERMISSIONS.items():
        may = rol.isin(*roles) & (F.lit(True) if not firm_only else tipo_usuario != "EMPRESA")
        rule = F.when(accion == action, may) if rule is None else rule.when(accion == action, may)
    return rule.otherwise(ok)


def action_violations(audit: DataFrame, users: DataFrame) -> DataFrame:
    who = users.select(F.col("id").alias("usuario_id"), "rol", "tipo_usuario")
    joined = audit.join(who, "usuario_id")
    return joined.filter(~allowed(F.col("accion"), F.col("rol"), F.col("tipo_usuario"))).select(
        F.col("id").alias("audit_id"), "usuario_id", "accion", "rol"
    )


def users_with_firm(users: DataFrame, firms: DataFrame, clients: DataFrame, active_only: bool = True) -> DataFrame:
    f = firms.select(
        F.col("id").alias("asesoria_id"), F.col("nombre").alias("asesoria_nombre"), F.col("estado").alias("asesoria_estado")
    )
    c = clients.select(
        F.col("id").alias("cliente_id"), F.col("nombre").alias("cliente_nombre"), F.col("cif").alias("cliente_cif")
    )
    joined = users.join(f, "asesoria_id").join(c, "cliente_id", "left")
    return joined.filter(F.col("activo") & (F.col("asesoria_estado") == "ACTIVA")) if active_only else joined
