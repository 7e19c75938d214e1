"""Running balances, and the places where printed balances depart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 0.005


def start_balances(covers: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """statement_id, start: the cover's opening balance, or the first printed one."""
    printed = checkpoints.filter("kind = 'inicio' and printed_balance is not null").groupBy("statement_id").agg(F.min_by("printed_balance", "ord").alias("printed"))
    return covers.select("statement_id", "saldo_inicio").join(printed, "statement_id", "left").select("statement_id", F.coalesce("saldo_inicio", "printed").alias("start"))


def running_balance(ops: DataFrame, starts: DataFrame) -> DataFrame:
    """ops with balance_computed: start plus all signed amounts up to the row, in ledger order; null without a start.

    A window's partition is one statement: the rows of one printed document.
    """
    flow = F.sum(F.col("abono") - F.col("cargo") - F.col("igtf")).over(W.partitionBy("statement_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return ops.join(starts, "statement_id", "left").withColumn("balance_computed", (F.col("start") + flow).cast("decimal(18,2)")).drop("start")


def computed_checkpoints(checkpoints: DataFrame, balanced: DataFrame, starts: DataFrame) -> DataFrame:
    """checkpoints with computed_balance: the start, the last balance, or that of the row they stand in."""
    ends = balanced.groupBy("statement_id").agg(F.max_by("balance_computed", "seq").alias("end"))
    rows = balanced.select("statement_id", "seq", F.col("balance_computed").alias("at"))
    out = checkpoints.drop("computed_balance").join(starts, "statement_id", "left").join(ends, "statement_id", "left").join(rows, ["statement_id", "seq"], "left")
    value = F.when(F.col("kind") == "inicio", F.col("start")).when(F.col("kind") == "final", F.coalesce("end", "start")).otherwise(F.col("at"))
    return out.withColumn("computed_balance", value).drop("start", "end", "at")


def compared(checkpoints: DataFrame) -> DataFrame:
    """Printed against computed balances: column difference."""
    return checkpoints.filter("printed_balance is not null").withColumn("difference", (F.col("computed_balance") - F.col("printed_balance")).cast("decimal(18,2)"))


def missing_rows(comparisons: DataFrame) -> DataFrame:
    """Steps of the difference between successive checkpoints: a row that the bank left out lies between the two pages.

    A positive step is a missing debit, a negative one a missing credit.
    """
    order = W.partitionBy("statement_id").orderBy("ord")
    rows = comparisons.filter("difference is not null")
    rows = rows.withColumn("step", F.col("difference") - F.coalesce(F.lag("difference").over(order), F.lit(0).cast("decimal(18,2)"))).withColumn("page_before", F.lag("page").over(order))
    rows = rows.filter(F.abs("step") > TOLERANCE)
    return rows.select("statement_id", "ord", "page_before", "page", F.col("step").cast("decimal(18,2)").alias("step"), F.when(F.col("step") > 0, "debit").otherwise("credit").alias("side"))
