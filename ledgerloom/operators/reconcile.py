"""Reconciliation of statements against their official totals, printed balances and annexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period_date
from ..functions.text import format_amount
from .balance import TOLERANCE, compared, missing_rows

MONEY = "decimal(18,2)"


def _issue(kind: str, detail: Column | str, expected: Column | None = None, parsed: Column | None = None) -> list[Column]:
    value = lambda x: (F.lit(None) if x is None else x).cast(MONEY)
    return [F.col("statement_id"), F.lit(kind).alias("kind"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), value(expected).alias("expected"), value(parsed).alias("parsed")]


def totals(ops: DataFrame) -> DataFrame:
    s = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast(MONEY).alias(f"total_{x}")
    return ops.groupBy("statement_id").agg(s("cargo"), s("abono"), s("igtf"), F.count(F.lit(1)).alias("n"))


def unmatched(annex: DataFrame, ops: DataFrame) -> DataFrame:
    """By statement, how many annex amounts exceed their count in the ledger (multiset difference). Amounts of zero don't count."""
    count = lambda df, name: df.filter("amount is not null and amount <> 0").groupBy("statement_id", F.col("amount").cast(MONEY).alias("amount")).agg(F.count(F.lit(1)).alias(name))
    both = count(annex, "wanted").join(count(ops, "there"), ["statement_id", "amount"], "left")
    return both.groupBy("statement_id").agg(F.sum(F.greatest(F.col("wanted") - F.coalesce("there", F.lit(0)), F.lit(0))).alias("unmatched"))


def total_checks(covers: DataFrame, ops: DataFrame) -> DataFrame:
    """One row a statement: parsed and expected debits, credits and net; an expected value is null where its parts are not all known.

    The net check takes the ledger's tax off and adds the cover's, as the printed balances do.
    """
    rows = covers.join(totals(ops), "statement_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0).cast(MONEY))
    rows = rows.withColumns({f"total_{x}": zero(f"total_{x}") for x in ("cargo", "abono", "igtf")})
    return rows.select(
        "statement_id", "total_cargo", "total_abono", "total_igtf", F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("cheques") + F.col("otros_debitos")).cast(MONEY).alias("expected_cargo"), (F.col("depositos") + F.col("otros_creditos")).cast(MONEY).alias("expected_abono"),
        (F.col("total_abono") - F.col("total_cargo") - F.col("total_igtf")).cast(MONEY).alias("net"), (F.col("saldo_final") - F.col("saldo_inicio") + zero("igtf")).cast(MONEY).alias("expected_net"),
    )


def _periods(statements: DataFrame) -> DataFrame:
    rows = statements.select("id", "account_number", period_date(F.col("period_start")).alias("start"), period_date(F.col("period_end")).alias("end"))
    return rows.filter("account_number is not null and start <= end")


def overlaps_with(new: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a new statement and another of its account, known (which may hold new ones too), whose periods share a day: statement_id, other_id.

    Periods are dealt to the years that they touch and meet by account and year, so work follows the new statements and their years,
    not an account's whole past. Two periods that share several years meet in the first of them alone. What is shuffled are days as they are
    and a row a year; the pairs are not shuffled.
    """
    dealt = lambda df: df.withColumn("bin", F.explode(F.sequence(F.year("start"), F.year("end"))))
    mine = dealt(_periods(new)).select(F.col("id").alias("statement_id"), "account_number", "bin", "start", "end")
    other = dealt(_periods(known)).select(F.col("id").alias("other_id"), "account_number", "bin", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    hit = (F.col("start") <= F.col("other_end")) & (F.col("other_start") <= F.col("end")) & (F.col("statement_id") != F.col("other_id"))
    first = F.col("bin") == F.year(F.greatest("start", "other_start"))
    return mine.join(other, ["account_number", "bin"]).filter(hit & first).select("statement_id", "other_id")


def overlaps(statements: DataFrame) -> DataFrame:
    """Pairs of statements of one account whose periods share a day, each in both orders."""
    return overlaps_with(statements, statements)


def issues(covers: DataFrame, ops: DataFrame, checkpoints: DataFrame, annex: DataFrame | None = None, pos: DataFrame | None = None, fidelity: DataFrame | None = None) -> DataFrame:
    """All findings: kinds cargo, abono, neto, saldo_intermedio (differences), fila_omitida (missing rows), advertencia (warnings)."""
    checks, cmp = total_checks(covers, ops), compared(checkpoints)
    apart = lambda a, b: F.abs(F.col(a) - F.col(b)) > TOLERANCE
    parts = [
        checks.filter(apart("total_cargo", "expected_cargo")).select(_issue("cargo", "Debits of the ledger differ from the official ones", F.col("expected_cargo"), F.col("total_cargo"))),
        checks.filter(apart("total_abono", "expected_abono")).select(_issue("abono", "Credits of the ledger differ from the official ones", F.col("expected_abono"), F.col("total_abono"))),
        checks.filter(apart("net", "expected_net")).select(_issue("neto", "Net change differs from that of the official balances", F.col("expected_net"), F.col("net"))),
        checks.filter("expected_net is null").select(_issue("advertencia", "No opening or closing balance: the net can't be checked")),
        cmp.filter((F.abs("difference") > TOLERANCE) & ~F.col("kind").isin("inicio", "final")).select(_issue("saldo_intermedio", F.concat(F.lit("Printed balance on page "), F.col("page"), F.lit(" differs")), F.col("printed_balance"), F.col("computed_balance"))),
        missing_rows(cmp).select(_issue("fila_omitida", F.concat(F.lit("p"), F.coalesce(F.col("page_before").cast("string"), F.lit("start")), F.lit("-p"), F.col("page"), F.when(F.col("side") == "debit", F.lit(": missing debits of ")).otherwise(F.lit(": missing credits of ")), format_amount(F.abs("step"))), F.col("step"))),
    ]
    for name, table in (("annex", annex), ("points of sale", pos)):
        if table is not None:
            parts.append(unmatched(table, ops).filter("unmatched > 0").select(_issue("advertencia", F.concat(F.col("unmatched"), F.lit(f" rows of the {name} have no match in the ledger")))))
    if fidelity is not None:
        parts.append(fidelity.select(_issue("advertencia", F.col("detail"))))
    return reduce(DataFrame.unionByName, parts)


def statuses(covers: DataFrame, found: DataFrame) -> DataFrame:
    """statement_id, status: DIFERENCIAS with any difference, else REVISAR with any warning, else CUADRA. Missing rows alone change nothing."""
    n = found.groupBy("statement_id").agg(F.count_if(F.col("kind").isin("cargo", "abono", "neto", "saldo_intermedio")).alias("d"), F.count_if(F.col("kind") == "advertencia").alias("w"))
    return covers.select("statement_id").join(n, "statement_id", "left").select("statement_id", F.when(F.col("d") > 0, "DIFERENCIAS").when(F.col("w") > 0, "REVISAR").otherwise("CUADRA").alias("status"))


def validation_rows(covers: DataFrame, ops: DataFrame, found: DataFrame) -> DataFrame:
    """One row a statement: rows, debits, credits, status, and what explains it: the differences as kind:delta in order, or the number of warnings."""
    delta = F.col("parsed") - F.col("expected")
    apart = F.when(~F.col("kind").isin("fila_omitida", "advertencia", "fecha_invalida") & delta.isNotNull(), F.struct("kind", "detail", F.concat("kind", F.lit(":"), format_amount(delta)).alias("text")))
    notes = found.groupBy("statement_id").agg(F.transform(F.array_sort(F.collect_list(apart)), lambda x: x["text"]).alias("deltas"), F.count_if(F.col("kind") == "advertencia").alias("warnings"))
    rows = statuses(covers, found).join(totals(ops).withColumnRenamed("n", "rows"), "statement_id", "left").join(notes, "statement_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return rows.select(
        "statement_id", zero("rows").cast("long").alias("rows"), zero("total_cargo").cast(MONEY).alias("total_cargo"), zero("total_abono").cast(MONEY).alias("total_abono"), "status",
        F.coalesce(F.array_join("deltas", ", "), F.lit("")).alias("deltas"), zero("warnings").cast("long").alias("warnings"),
    )


def validation_matrix(found_statuses: DataFrame) -> DataFrame:
    return found_statuses.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def issue_counts(found: DataFrame) -> DataFrame:
    """By statement: missing rows, warnings, and differences."""
    kind = F.col("kind")
    return found.groupBy("statement_id").agg(F.count_if(kind == "fila_omitida").alias("missing"), F.count_if(kind == "advertencia").alias("warnings"), F.count_if(~kind.isin("fila_omitida", "advertencia")).alias("differences"))
