"""Analytics over a ledger of operations (see schemas.OPERATIONS). Each function is one lazy aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import period_date, weekday_name, weekday_number

NO_DATA = "Sin dato"
# Methods that count as costs of the bank: fixed values.
COST_METHODS = ["comision", "comision_pago_movil", "comision_credito_inmediato", "mantenimiento", "emision_estado", "mensajeria", "impuesto"]


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def money(*names: str) -> list[Column]:
    """Money leaves an aggregate as double."""
    return [F.col(x).cast("double").alias(x) for x in names]


def scoped(ops: DataFrame, statement_id: int | None = None) -> DataFrame:
    """One statement's operations; without one, or with 0, all."""
    return ops.filter(F.col("statement_id") == statement_id) if statement_id else ops


def ledger_totals(ops: DataFrame) -> DataFrame:
    sums = ops.agg(total("cargo").alias("cargo"), total("abono").alias("abono"), total("igtf").alias("igtf"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("net", F.col("abono") - F.col("cargo") - F.col("igtf")).select(*money("cargo", "abono", "igtf", "net"), "n")


def grouped(ops: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """Count and sums by a label column, most operations first."""
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(NO_DATA)).alias("label")
    out = ops.groupBy(label).agg(F.count(F.lit(1)).alias("n"), total("cargo").alias("cargo"), total("abono").alias("abono"))
    return out.orderBy(F.desc("n"), "label").limit(limit).select("label", "n", *money("cargo", "abono"))


def top_labels(ops: DataFrame, column: str, side: str, limit: int = 8) -> DataFrame:
    """Labels with the largest sum on one side, of operations with an amount there."""
    rows = ops.filter(F.col(column).isNotNull() & (F.col(side) > 0))
    return rows.groupBy(F.col(column).alias("label")).agg(F.sum(side).alias("amount"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("amount"), "label").limit(limit).select("label", *money("amount"), "n")


def adjustment_totals(adjustments: DataFrame) -> DataFrame:
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).alias(d)
    return adjustments.agg(side("cargo"), side("abono"), F.count(F.lit(1)).alias("n")).select(*money("cargo", "abono"), "n")


def daily_flow(ops: DataFrame) -> DataFrame:
    """Sums and count by day, and the last computed balance of the day."""
    last = F.max_by(F.when(F.col("balance_computed").isNotNull(), F.col("balance_computed")), F.when(F.col("balance_computed").isNotNull(), F.struct("statement_id", "seq")))
    out = ops.filter("date_iso is not null").groupBy("date_iso").agg(F.sum("cargo").alias("cargo"), F.sum("abono").alias("abono"), F.count(F.lit(1)).alias("n"), last.alias("balance"))
    return out.select("date_iso", *money("cargo", "abono", "balance"), "n")


def bank_costs(ops: DataFrame) -> DataFrame:
    """Cost by method; the tax column's total is a row of its own, so that the sum is the total cost."""
    rows = ops.filter(F.col("method").isin(COST_METHODS)).groupBy("method").agg(F.sum("cargo").alias("amount"), F.count(F.lit(1)).alias("n"))
    tax = ops.agg(total("igtf").alias("amount"), F.count_if(F.col("igtf") > 0).alias("n")).select(F.lit("igtf").alias("method"), "amount", "n")
    return rows.unionByName(tax).select("method", *money("amount"), "n")


def averages(ops: DataFrame) -> DataFrame:
    sums = ops.agg(F.sum("amount").alias("s"), F.count("amount").alias("k"), F.max("cargo").alias("max_cargo"), F.max("abono").alias("max_abono"), F.countDistinct("date_iso").alias("active_days"), total("cargo").alias("c"), total("abono").alias("a"))
    per_day = lambda x: F.when(F.col("active_days") > 0, F.col(x).cast("double") / F.col("active_days")).otherwise(F.lit(0.0))
    return sums.select(
        F.round(F.coalesce(F.col("s").cast("double") / F.nullif(F.col("k"), F.lit(0)), F.lit(0.0)), 2).alias("mean_amount"),
        *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in ("max_cargo", "max_abono")], "active_days", F.round(per_day("c"), 2).alias("daily_cargo"), F.round(per_day("a"), 2).alias("daily_abono"),
    )


def by_weekday(ops: DataFrame) -> DataFrame:
    rows = ops.filter("date_iso is not null")
    out = rows.groupBy(weekday_number(F.col("date_iso")).alias("weekday"), weekday_name(F.col("date_iso")).alias("name"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("cargo").alias("cargo"), F.sum("abono").alias("abono")).select("weekday", "name", "n", *money("cargo", "abono"))


def top_days(ops: DataFrame, limit: int = 5) -> DataFrame:
    rows = ops.filter("date_iso is not null").groupBy("date_iso").agg(F.sum("cargo").alias("cargo"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("cargo"), "date_iso").limit(limit).select("date_iso", *money("cargo"), "n")


#: Keys in a block whose rows are ranked by one task.
BLOCK = 1 << 16


def positions(rows: DataFrame, day: str, key: str = "id", newest: bool = False) -> DataFrame:
    """rows with position from 1 in order of a day (null last), then a whole-numbered key: oldest first, or newest with the largest key first.

    Counts by day and block of keys, and ranks within a block: no task orders all rows, nor all of a day, such as the first of
    a month on which every statement begins.
    """
    way = (lambda c: F.col(c).desc_nulls_last()) if newest else (lambda c: F.col(c).asc_nulls_last())
    dealt = rows.withColumn("block_", F.floor(F.col(key) / BLOCK))
    blocks = dealt.groupBy(F.col(day).alias("day_"), F.col("block_").alias("in_")).agg(F.count(F.lit(1)).alias("n_"))
    before = blocks.select("day_", "in_", F.coalesce(F.sum("n_").over(W.orderBy(way("day_"), way("in_")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    ranked = dealt.withColumn("rank_", F.row_number().over(W.partitionBy(day, "block_").orderBy(way(key))))
    out = ranked.join(before, F.col(day).eqNullSafe(F.col("day_")) & F.col("block_").eqNullSafe(F.col("in_")))
    return out.withColumn("position", (F.col("before_") + F.col("rank_")).cast("int")).drop("day_", "in_", "block_", "before_", "rank_")


def latest(statements: DataFrame, limit: int | None = 8) -> DataFrame:
    """Statements (id, period_start), the newest period first, then the largest id, those without a readable period last."""
    rows = statements.orderBy(period_date(F.col("period_start")).desc_nulls_last(), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def monthly(ops: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """Sums by statement, numbered in order of its period (or its first day), with change against the statement before.

    The statement before is found by its number, in a join: no task sees all statements.
    """
    rows = ops.groupBy("statement_id").agg(F.sum("cargo").alias("cargo"), F.sum("abono").alias("abono"), F.sum("igtf").alias("igtf"), F.count(F.lit(1)).alias("n"), F.min("date_iso").alias("first_day"))
    if statements is not None:
        rows = rows.join(statements.select(F.col("id").alias("statement_id"), period_date(F.col("period_start")).alias("start")), "statement_id", "left")
        rows = rows.withColumn("first_day", F.coalesce("start", "first_day"))
    return monthly_of(rows)


def monthly_of(rows: DataFrame) -> DataFrame:
    """monthly() from sums by statement: statement_id, cargo, abono, igtf, n, first_day."""
    rows = positions(rows, "first_day", "statement_id").withColumn("net", F.col("abono") - F.col("cargo") - F.col("igtf"))
    last = rows.select((F.col("position") + 1).alias("position"), *[F.col(x).alias(f"{x}_before") for x in ("cargo", "abono", "net")])
    rows = rows.join(last, "position", "left")
    change = lambda x: percent_change(F.col(x).cast("double"), F.col(f"{x}_before").cast("double")).alias(f"{x}_change")
    return rows.select("statement_id", "position", *money("cargo", "abono", "igtf", "net"), "n", change("cargo"), change("abono"), change("net"))


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before.isNotNull() & (before != 0), F.round((now - before) / F.abs(before) * 100, 4))


def top_and_rest(ops: DataFrame, column: str = "category", keep: int = 6, rest: str = "Otras") -> DataFrame:
    """The labels with the largest debits, the others as one where they hold anything, and shares of the whole."""
    rows = ops.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(NO_DATA)).alias("label")).agg(F.sum("cargo").alias("cargo"))
    top = rows.orderBy(F.desc("cargo"), "label").limit(keep)
    # the rest is the whole less the top; a label may have the rest's own name
    others = rows.agg(F.sum("cargo").alias("cargo")).unionByName(top.select((-F.col("cargo")).alias("cargo"))).agg(F.sum("cargo").alias("cargo"))
    rows = top.unionByName(others.select(F.lit(rest).alias("label"), "cargo")).groupBy("label").agg(F.sum("cargo").alias("cargo")).filter(f"cargo > 0 or label <> '{rest}'")
    # at most keep + 1 rows are left
    whole = F.sum(F.col("cargo")).over(W.partitionBy())
    return rows.select("label", F.col("cargo").cast("double").alias("cargo"), F.when(whole > 0, F.round(F.col("cargo").cast("double") / whole.cast("double") * 100, 4)).otherwise(F.lit(0.0)).alias("share"))


def savings_rate(ops: DataFrame) -> DataFrame:
    t = ledger_totals(ops)
    return t.select("net", "abono", F.when(F.col("abono") > 0, F.round(F.col("net") / F.col("abono") * 100, 4)).otherwise(F.lit(0.0)).alias("savings_rate"))


def biggest(ops: DataFrame, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 50:
        raise ValueError("limit must lie between 1 and 50")
    return ops.orderBy(F.desc("amount"), "id").limit(limit).select("id", "statement_id", "date_iso", "method", *money("amount"), "direction")


GROUP = ["amount", "date_iso", "direction", "reference", "counterpart_account"]
#: Members that a group's array shows; duplicate_members has all.
SHOWN = 500


def _with_group(ops: DataFrame) -> DataFrame:
    return ops.withColumns({c: F.coalesce(c, F.lit("")) for c in ("reference", "counterpart_account")})


def ranked_duplicates(ops: DataFrame, limit: int | None = 50) -> DataFrame:
    """Groups of operations that several statements print, ranked by statements, then members: the group's columns, n, statements. No members are gathered.

    Statements are counted by group and statement first, so a group of any size is summed by many tasks.
    """
    pairs = _with_group(ops).groupBy(*GROUP, "statement_id").agg(F.count(F.lit(1)).alias("k"))
    groups = pairs.groupBy(*GROUP).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("statements")).filter("statements > 1")
    return groups if limit is None else groups.orderBy(F.desc("statements"), F.desc("n"), *GROUP).limit(limit)


def duplicate_members(ops: DataFrame, limit: int | None = 50) -> DataFrame:
    """One row for each member of the ranked groups: the group's columns, n, statements, position (from 1, by statement and row), statement_id, seq, id.

    Positions come from counts by group and statement and ranks within a statement, dealt by group and block of statements, so that no
    task orders a large group's members and no array holds them.
    """
    groups = ranked_duplicates(ops, limit).withColumnsRenamed({c: f"_{c}" for c in GROUP})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in GROUP]
    members = _with_group(ops).join(groups, same).select(*GROUP, "n", "statements", "statement_id", "seq", "id")
    own = members.groupBy(*GROUP, "statement_id").agg(F.count(F.lit(1)).alias("k")).withColumn("block", F.floor(F.col("statement_id") / 1024))
    blocks = own.groupBy(*GROUP, "block").agg(F.sum("k").alias("in_block"))
    before = F.coalesce(F.sum("in_block").over(W.partitionBy(*GROUP).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).drop("in_block").withColumnsRenamed({c: f"_{c}" for c in GROUP} | {"block": "_block"})
    within = F.coalesce(F.sum("k").over(W.partitionBy(*GROUP, "block").orderBy("statement_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = own.withColumn("within", within).join(blocks, [*same, F.col("block") == F.col("_block")]).select(*[F.col(c).alias(f"_{c}") for c in GROUP], F.col("statement_id").alias("_statement"), (F.col("before") + F.col("within")).alias("start"))
    rank = F.row_number().over(W.partitionBy(*GROUP, "statement_id").orderBy("seq", "id"))
    out = members.withColumn("rank", rank).join(starts, [*same, F.col("statement_id").eqNullSafe(F.col("_statement"))])
    return out.select(*GROUP, "n", "statements", (F.col("start") + F.col("rank")).alias("position"), "statement_id", "seq", "id")


def duplicate_groups(ops: DataFrame, limit: int | None = 50, shown: int = SHOWN) -> DataFrame:
    """The ranked groups with their first `shown` members as an array ordered by statement and row."""
    rows = duplicate_members(ops, limit).filter(F.col("position") <= shown)
    out = rows.groupBy(*GROUP, "n", "statements").agg(F.sort_array(F.collect_list(F.struct("statement_id", "seq", "id"))).alias("members"))
    return out if limit is None else out.orderBy(F.desc("statements"), F.desc("n"), *GROUP)


def series_scale(daily: DataFrame) -> DataFrame:
    """Least and largest value of a daily series' debits and credits, and the step of a scale of five lines that holds them."""
    out = daily.agg(F.least(F.min("cargo"), F.min("abono")).alias("low"), F.greatest(F.max("cargo"), F.max("abono")).alias("high"))
    return out.select(*[F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in ("low", "high")]).withColumn("step", F.greatest(F.col("high"), F.lit(1.0)) / 4)


def summary(ops: DataFrame, adjustments: DataFrame | None = None, statement_id: int | None = None) -> dict[str, DataFrame]:
    """Every part of the dashboard, each a lazy frame over one scope. The monthly series always spans all statements."""
    rows = scoped(ops, statement_id)
    out = {
        "totals": ledger_totals(rows), "by_method": grouped(rows, "method"), "by_category": grouped(rows, "category"), "daily": daily_flow(rows), "costs": bank_costs(rows),
        "averages": averages(rows), "weekdays": by_weekday(rows), "top_days": top_days(rows), "monthly": monthly(ops), "categories": top_and_rest(rows), "savings": savings_rate(rows),
    }
    out |= {f"top_{c}_{s}": top_labels(rows, c, s) for c in ("counterpart", "concept") for s in ("cargo", "abono")}
    if adjustments is not None:
        out["adjustments"] = adjustment_totals(scoped(adjustments, statement_id))
    return out
