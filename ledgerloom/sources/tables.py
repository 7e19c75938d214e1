"""Reading and writing the stored tables; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import MONTHS, period_month
from ..operators.balance import TOLERANCE
from ..operators.reconcile import total_checks


def read(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A table in parquet, json or csv (with header), by an explicit schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def with_defaults(table: DataFrame, schema: str) -> DataFrame:
    """Additive migration: columns that an older table lacks are null, and the order is the schema's."""
    target = table.sparkSession.createDataFrame([], schema).schema
    return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def migrated(statements: DataFrame, schema: str = schemas.STATEMENTS) -> DataFrame:
    """Statements of an older table with the columns that came later, filled as if they had been there: progress begins at 0 in the queue, and those that are done are at 100."""
    out = with_defaults(statements, schema)
    unset = F.coalesce("progress_percent", F.lit(0)) == 0
    done = (F.col("status") != "procesando") & unset
    return out.withColumns({
        "progress_stage": F.when(done, F.lit("listo")).otherwise(F.coalesce("progress_stage", F.lit("en cola"))),
        "progress_percent": F.when(done, F.lit(100)).otherwise(F.coalesce("progress_percent", F.lit(0))),
    })


def overwrite_statements(table: DataFrame, path: str) -> None:
    """Replaces the rows of the statements that table holds, and leaves the others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("statement_id").parquet(path)


def write_csv(rows: DataFrame, path: str, separator: str = ";", single: bool = True) -> None:
    """Export rows in their order. One file is for people: rows reach it through one task, so filter first, or write many parts."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("sep", separator).option("emptyValue", "").csv(path)


def write_joined_csv(rows: DataFrame, path: str, separator: str = ";") -> int:
    """Rows in their order as one file with one header, equal to write_csv's single one; returns its number of parts.

    Tasks write numbered parts of a total order (rows.orderBy deals ranges), and the file system's streams put them one after
    another: no task sees all rows.
    """
    from . import store

    spark, parts = rows.sparkSession, f"{path}.parts"
    rows.write.mode("overwrite").option("header", False).option("sep", separator).option("emptyValue", "").csv(parts)
    target, system = store._path(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray((separator.join(rows.columns) + "\n").encode()))
        found = [n for n in store.names(spark, parts) if n.startswith("part-")]
        for name in found:
            source = system.open(store._path(spark, f"{parts}/{name}")[0])
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
    finally:
        out.close()
    store.delete(spark, parts)
    return len(found)


RAW_FIELDS = ["page", "seq", "date", "number", "description", "cargo", "abono", "igtf", "method", "counterpart", "counterpart_account", "counterpart_bank", "reference", "concept", "balance_computed"]


def raw_rows(operations: DataFrame) -> DataFrame:
    """The fifteen raw fields of the command line's CSV."""
    return operations.orderBy("statement_id", "seq").select(*RAW_FIELDS)


def documents(parsed, found: DataFrame, statuses: DataFrame) -> DataFrame:
    """One JSON document a statement: cover, status, issues, operations, annex, points of sale."""
    nest = lambda df, name, order: df.groupBy("statement_id").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c not in ("statement_id", order)]))).alias(name))
    out = parsed.covers.select("statement_id", F.struct(*[c for c in parsed.covers.columns if c != "statement_id"]).alias("cover")).join(statuses, "statement_id", "left")
    for df, name, order in ((found, "issues", "kind"), (parsed.operations, "operations", "seq"), (parsed.annex, "annex", "ord"), (parsed.pos, "pos", "ord"), (parsed.checkpoints, "checkpoints", "ord")):
        out = out.join(nest(df, name, order), "statement_id", "left")
    return out.select("statement_id", F.to_json(F.struct("cover", "status", "issues", "operations", "annex", "pos", "checkpoints")).alias("document"))


REPORT = (
    "status string, year int, month int, month_name string, expected_cargo decimal(18,2), expected_abono decimal(18,2), expected_net decimal(18,2), computed_net decimal(18,2), "
    "differences array<struct<kind: string, detail: string, expected: decimal(18,2), parsed: decimal(18,2)>>, missing_rows array<struct<detail: string, amount: decimal(18,2)>>, warnings array<string>, "
    "checkpoints array<struct<ord: int, page: int, kind: string, printed: decimal(18,2), computed: decimal(18,2), difference: decimal(18,2)>>"
)


def reports(covers: DataFrame, ops: DataFrame, checkpoints: DataFrame, found: DataFrame, statuses: DataFrame) -> DataFrame:
    """statement_id, report: one JSON document of schema REPORT for each statement (read it with read_reports)."""
    year, month = period_month(F.col("period_start"), F.col("period_end"))
    gather = lambda cond, *fields: F.array_sort(F.collect_list(F.when(cond, F.struct(*fields))))
    kind = F.col("kind")
    notes = found.groupBy("statement_id").agg(
        gather(~kind.isin("fila_omitida", "advertencia", "fecha_invalida"), "kind", "detail", "expected", "parsed").alias("differences"),
        gather(kind == "fila_omitida", "detail", F.col("expected").alias("amount")).alias("missing_rows"),
        F.array_sort(F.collect_list(F.when(kind.isin("advertencia", "fecha_invalida"), F.col("detail")))).alias("warnings"),
    )
    point = [F.col("ord"), F.col("page"), kind, F.col("printed_balance").alias("printed"), F.col("computed_balance").alias("computed"), (F.col("computed_balance") - F.col("printed_balance")).cast("decimal(18,2)").alias("difference")]
    points = checkpoints.groupBy("statement_id").agg(gather(F.lit(True), *point).alias("checkpoints"))
    out = total_checks(covers, ops).withColumnRenamed("net", "computed_net").join(covers.select("statement_id", year.alias("year"), month.alias("month")), "statement_id")
    for part in (statuses, notes, points):
        out = out.join(part, "statement_id", "left")
    out = out.withColumn("month_name", F.coalesce(F.get(F.array(*[F.lit(m) for m in MONTHS]), F.col("month") - 1), F.lit("")))
    out = out.withColumns({c: F.coalesce(c, F.array()) for c in ("differences", "missing_rows", "warnings", "checkpoints")})
    names = [f.name for f in covers.sparkSession.createDataFrame([], REPORT).schema]
    return out.select("statement_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("report"))


def read_reports(rows: DataFrame) -> DataFrame:
    """reports() with the document as columns again."""
    return rows.select("statement_id", F.from_json("report", REPORT).alias("r")).select("statement_id", "r.*")


def report(statement_id: int, covers: DataFrame, ops: DataFrame, checkpoints: DataFrame, found: DataFrame, statuses: DataFrame, annex: DataFrame | None = None, pos: DataFrame | None = None) -> str:
    """A text report on one statement: cover, counts, totals, findings, printed balances, status. Its findings and checkpoints are few and come to the driver."""
    mine = lambda df: df.filter(F.col("statement_id") == statement_id)
    cover = mine(covers).first()
    if cover is None:
        raise KeyError(f"no statement {statement_id}")
    r = read_reports(reports(*[mine(x) for x in (covers, ops, checkpoints, found, statuses)])).first()
    total = total_checks(mine(covers), mine(ops)).first()
    money = lambda x: "-" if x is None else f"{x:,.2f}".translate(str.maketrans(",.", ".,"))
    c, rule = cover.asDict(), "-" * 60
    lines = [f"Statement {statement_id}", f"Holder   {c.get('holder') or '-'}", f"Account  {c.get('account_number') or '-'}", f"Period   {c.get('period_start') or '-'} to {c.get('period_end') or '-'}", rule, f"Ledger rows    {total.n}"]
    lines += [f"{name:<14} {mine(df).count()}" for name, df in (("Annex rows", annex), ("Points of sale", pos)) if df is not None]
    lines += [rule, f"Debits   {money(total.total_cargo)}", f"Credits  {money(total.total_abono)}", f"Tax      {money(total.total_igtf)}", f"Net      {money(r.computed_net)}"]
    lines += [f"Official {name} {money(value)}" for name, value in (("debits", r.expected_cargo), ("credits", r.expected_abono), ("net", r.expected_net)) if value is not None]
    if r.differences:
        lines += [rule, "Differences"] + [f"  {d.detail}" + ("" if None in (d.expected, d.parsed) else f" (expected {money(d.expected)}, found {money(d.parsed)}, delta {money(d.parsed - d.expected)})") for d in r.differences]
    lines += [rule, "Rows left out by the bank"] + [f"  {m.detail}" for m in r.missing_rows] if r.missing_rows else []
    lines += [rule, "Warnings"] + [f"  {w}" for w in r.warnings] if r.warnings else []
    printed = [p for p in r.checkpoints if p.printed is not None]
    mark = lambda p: "ok" if p.difference is not None and abs(p.difference) <= TOLERANCE else "??"
    lines += [rule, "Printed balances"] + [f"  p{p.page} {p.kind} printed {money(p.printed)} computed {money(p.computed)} {mark(p)}" for p in printed] if printed else []
    return "\n".join([*lines, rule, f"Status   {r.status or 'unknown'}"])


def add_adjustment(adjustments: DataFrame, statement_id: int, date: str, description: str, amount: float, direction: str, note: str = "") -> DataFrame:
    """adjustments with one more row, after validation of its fields."""
    import re

    if not re.fullmatch(r"\d{2}/\d{2}(/\d{2}|/\d{4})?", date):
        raise ValueError("date must be dd/mm, dd/mm/yy or dd/mm/yyyy")
    if amount <= 0 or direction not in ("cargo", "abono"):
        raise ValueError("amount must be positive and direction cargo or abono")
    spark = adjustments.sparkSession
    last = adjustments.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = spark.createDataFrame([(last + 1, statement_id, date, description, direction, note, str(amount))], "id long, statement_id long, date string, description string, direction string, note string, amount string")
    row = row.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))
    return with_defaults(adjustments, schemas.ADJUSTMENTS).unionByName(with_defaults(row, schemas.ADJUSTMENTS))


def remove_adjustment(adjustments: DataFrame, statement_id: int, adjustment_id: int) -> DataFrame:
    """adjustments without the row, if it belongs to the statement."""
    return adjustments.filter(~((F.col("id") == adjustment_id) & (F.col("statement_id") == statement_id)))
