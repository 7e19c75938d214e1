"""Dates of statements: periods, day texts, names of months and weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish names: fixed values.
MONTHS = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]
WEEKDAYS = ["Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado"]


def named(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), number.cast("int"))


def month_name(day: Column) -> Column:
    return named(MONTHS, F.month(day))


def weekday_number(day: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(day) - 1).cast("int")


def weekday_name(day: Column) -> Column:
    return named(WEEKDAYS, F.dayofweek(day))


def period_date(text: Column) -> Column:
    """dd-mm-yy to a date of this century; null if there is no such day."""
    return F.try_to_date(F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), F.regexp_replace(text, r"^(\d{1,2})-(\d{1,2})-(\d{2})$", "20$3-$2-$1")), "yyyy-M-d")


def period_month(start: Column, end: Column) -> tuple[Column, Column]:
    """Year and month that a statement's day texts (dd-mm-yy or dd-mm-yyyy) name, also where there is no such day; 2000 and 1 if they can't be read."""
    text = F.coalesce(F.nullif(end, F.lit("")), start)
    number = lambda i: F.regexp_extract(text, r"^\s*\d{1,4}\s*-\s*(\d{1,4})\s*-\s*(\d{1,4})\s*$", i).try_cast("int")
    year = F.when(number(2) < 100, number(2) + 2000).otherwise(F.nullif(number(2), F.lit(0)))
    return F.coalesce(year, F.lit(2000)), F.coalesce(F.nullif(number(1), F.lit(0)), F.lit(1))


def resolve_date(day_month: Column, year: Column, month: Column) -> Column:
    """dd/mm in a statement of (year, month): December rows of a January statement lie in the year before, and the converse. No such day: null."""
    m = F.when(day_month.rlike(r"^\d{2}/\d{2}$"), F.substring(day_month, 4, 2).cast("int"))
    y = F.when((month == 1) & (m == 12), year - 1).when((month == 12) & (m == 1), year + 1).otherwise(year)
    return F.try_to_date(F.format_string("%04d-%02d-%s", y, m, F.substring(day_month, 1, 2)), "yyyy-MM-dd")


def eta_seconds(elapsed: Column, percent: Column) -> Column:
    """Rest of a job by its progress; null outside 5 to 99 per cent."""
    return F.when(percent.between(5, 99), elapsed * (100 - percent) / percent)


def money_short(value: Column) -> Column:
    """Millions with two decimals as MM, thousands with one as M, with a point; less in full with a comma; a dash for null."""
    size, value = F.abs(value), value.cast("double")
    short = F.when(size >= 1_000_000, F.format_string("%.2f MM", value / 1_000_000)).when(size >= 1_000, F.format_string("%.1f M", value / 1_000))
    return F.when(value.isNull(), "—").otherwise(F.coalesce(short, F.translate(F.format_number(value, 2), ",.", ".,")))
