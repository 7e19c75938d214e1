"""Labels for people: days, periods, methods and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import MONTHS

# What methods and states are called: fixed values. Other methods lose their underscores.
METHODS = {
    "transferencia_recibida": "transferencia recibida",
    "transferencia_enviada": "transferencia enviada",
    "credito_inmediato": "crédito inmediato",
    "pago_movil": "pago móvil",
    "comision_pago_movil": "comisión pago móvil",
    "comision_credito_inmediato": "comisión crédito inmediato",
    "comision": "comisión",
    "punto_de_venta": "punto de venta",
    "tarjeta_debito": "tarjeta de débito",
    "pago_terceros": "pago a terceros",
    "pago_servicios": "pago de servicios",
    "mantenimiento": "mantenimiento",
    "emision_estado": "emisión de estado",
    "impuesto": "impuesto",
    "cheque": "cheque",
    "otro": "otro",
}
STATES = {"CUADRA": "cuadra al céntimo", "DIFERENCIAS": "con diferencias", "REVISAR": "revisar", "procesando": "procesando", "error": "error"}
NONE = "—"


def _named(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def method_label(method: Column) -> Column:
    return F.coalesce(_named(METHODS, method), F.replace(method, F.lit("_"), F.lit(" ")))


def status_label(status: Column) -> Column:
    return F.coalesce(_named(STATES, status), status)


def date_label(day: Column) -> Column:
    """dd/mm/yy; a dash for null."""
    return F.coalesce(F.date_format(day, "dd/MM/yy"), F.lit(NONE))


def day_month_label(day: Column) -> Column:
    """dd/mm; empty for null."""
    return F.coalesce(F.date_format(day, "dd/MM"), F.lit(""))


def period_label(period: Column) -> Column:
    """Month and year of a day text dd-mm-yy or dd-mm-yyyy; other texts as they are, a dash for none."""
    parts = F.split(period, "-")
    month, year = parts[1], parts[2]
    name = F.coalesce(F.get(F.array(*[F.lit(m) for m in MONTHS]), month.try_cast("int") - 1), month)
    full = F.concat(name, F.lit(" "), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))
    return F.when(F.coalesce(period, F.lit("")) == "", NONE).when(F.size(parts) == 3, full).otherwise(period)


def period_short(period: Column) -> Column:
    """The first three letters of period_label."""
    return F.substring(period_label(period), 1, 3)
