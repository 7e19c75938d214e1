"""The dashboard from partial sums: days and labels of each load, merged when read.

`days` has a row for each day, payment method and category of a load, `labels` one for each counterpart and concept. Both
are sums, counts, maxima and last values, so partial rows of several loads merge to the sums of all
their operations. Distinct days are the days of the merged rows. Every part equals the one that
`stats.summary` makes from the operations; the tests compare them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import weekday_name, weekday_number
from . import stats
from .stats import COST_METHODS, NO_DATA, money

SUMS = ["n", "cargo", "abono", "igtf", "amount", "n_amount", "n_igtf"]


def days(ops: DataFrame) -> DataFrame:
    """Partial sums by day, method and category (schemas.DAYS)."""
    known = F.col("balance_computed").isNotNull()
    last = F.max(F.when(known, F.struct("statement_id", "seq", F.col("balance_computed").alias("balance")))).alias("last")
    return ops.groupBy("date_iso", "method", "category").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("cargo", "abono", "igtf", "amount")], F.count("amount").alias("n_amount"), F.count_if(F.col("igtf") > 0).alias("n_igtf"),
        F.max("cargo").alias("max_cargo"), F.max("abono").alias("max_abono"), last,
    )


def labels(ops: DataFrame) -> DataFrame:
    """Partial sums by counterpart and by concept (schemas.LABELS), of operations with an amount on a side."""
    parts = []
    for kind in ("counterpart", "concept"):
        side = lambda c: [F.sum(F.when(F.col(c) > 0, F.col(c))).alias(c), F.count_if(F.col(c) > 0).alias(f"n_{c}")]
        rows = ops.filter(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("label")).agg(*side("cargo"), *side("abono"))
        parts.append(rows.select(F.lit(kind).alias("kind"), "label", "cargo", "n_cargo", "abono", "n_abono"))
    return reduce(DataFrame.unionByName, parts)


def _sum(name: str):
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def totals(days: DataFrame) -> DataFrame:
    return days.agg(_sum("cargo"), _sum("abono"), _sum("igtf"), _sum("n")).withColumn("net", F.col("abono") - F.col("cargo") - F.col("igtf")).select(*money("cargo", "abono", "igtf", "net"), "n")


def grouped(days: DataFrame, column: str, limit: int = 50) -> DataFrame:
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(NO_DATA)).alias("label")
    return days.groupBy(label).agg(_sum("n"), _sum("cargo"), _sum("abono")).orderBy(F.desc("n"), "label").limit(limit).select("label", "n", *money("cargo", "abono"))


def daily_flow(days: DataFrame) -> DataFrame:
    out = days.filter("date_iso is not null").groupBy("date_iso").agg(F.sum("cargo").alias("cargo"), F.sum("abono").alias("abono"), F.sum("n").alias("n"), F.max("last").alias("last"))
    return out.select("date_iso", *money("cargo", "abono"), F.col("last.balance").cast("double").alias("balance"), "n")


def bank_costs(days: DataFrame) -> DataFrame:
    rows = days.filter(F.col("method").isin(COST_METHODS)).groupBy("method").agg(F.sum("cargo").alias("amount"), F.sum("n").alias("n"))
    tax = days.agg(F.coalesce(F.sum("igtf"), F.lit(0)).alias("amount"), F.coalesce(F.sum("n_igtf"), F.lit(0)).alias("n")).select(F.lit("igtf").alias("method"), "amount", "n")
    return rows.unionByName(tax).select("method", *money("amount"), "n")


def averages(days: DataFrame) -> DataFrame:
    sums = days.agg(F.sum("amount").alias("s"), F.sum("n_amount").alias("k"), F.max("max_cargo").alias("max_cargo"), F.max("max_abono").alias("max_abono"), F.countDistinct("date_iso").alias("active_days"), _sum("cargo"), _sum("abono"))
    per_day = lambda x: F.when(F.col("active_days") > 0, F.col(x).cast("double") / F.col("active_days")).otherwise(F.lit(0.0))
    return sums.select(
        F.round(F.coalesce(F.col("s").cast("double") / F.nullif(F.col("k"), F.lit(0)), F.lit(0.0)), 2).alias("mean_amount"),
        *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in ("max_cargo", "max_abono")], "active_days", F.round(per_day("cargo"), 2).alias("daily_cargo"), F.round(per_day("abono"), 2).alias("daily_abono"),
    )


def by_weekday(days: DataFrame) -> DataFrame:
    out = days.filter("date_iso is not null").groupBy(weekday_number(F.col("date_iso")).alias("weekday"), weekday_name(F.col("date_iso")).alias("name"))
    return out.agg(F.sum("n").alias("n"), F.sum("cargo").alias("cargo"), F.sum("abono").alias("abono")).select("weekday", "name", "n", *money("cargo", "abono"))


def top_days(days: DataFrame, limit: int = 5) -> DataFrame:
    rows = days.filter("date_iso is not null").groupBy("date_iso").agg(F.sum("cargo").alias("cargo"), F.sum("n").alias("n"))
    return rows.orderBy(F.desc("cargo"), "date_iso").limit(limit).select("date_iso", *money("cargo"), "n")


def top_labels(labels: DataFrame, kind: str, side: str, limit: int = 8) -> DataFrame:
    rows = labels.filter((F.col("kind") == kind) & (F.col(f"n_{side}") > 0)).groupBy("label").agg(F.sum(side).alias("amount"), F.sum(f"n_{side}").alias("n"))
    return rows.orderBy(F.desc("amount"), "label").limit(limit).select("label", *money("amount"), "n")


def summary(days: DataFrame, labels: DataFrame, monthly: DataFrame | None = None, adjustments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every part of the dashboard from merged partial sums; monthly and adjustments are handed through."""
    whole = totals(days)
    savings = whole.select("net", "abono", F.when(F.col("abono") > 0, F.round(F.col("net") / F.col("abono") * 100, 4)).otherwise(F.lit(0.0)).alias("savings_rate"))
    out = {
        "totals": whole, "by_method": grouped(days, "method"), "by_category": grouped(days, "category"), "daily": daily_flow(days), "costs": bank_costs(days), "averages": averages(days), "weekdays": by_weekday(days),
        "top_days": top_days(days), "categories": stats.top_and_rest(days), "savings": savings,
    }
    out |= {f"top_{k}_{s}": top_labels(labels, k, s) for k in ("counterpart", "concept") for s in ("cargo", "abono")}
    if monthly is not None:
        out["monthly"] = monthly
    if adjustments is not None:
        out["adjustments"] = stats.adjustment_totals(adjustments)
    return out
