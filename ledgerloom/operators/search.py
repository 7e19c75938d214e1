"""Search over a ledger: filters, text match, order, pages, export rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

SORTS = {"date": "date_iso", "amount": "amount", "description": "description", "method": "method", "category": "category"}
EXPORT_COLUMNS = ["Fecha", "Descripción", "Método", "Categoría", "Contraparte", "Cuenta", "Banco", "Referencia", "Concepto", "Cargo", "Abono", "IGTF", "Saldo", "Archivo"]


def _bound(value: float | Decimal) -> Column:
    """A bound as it was written, not rounded to cents."""
    return F.lit(Decimal(format(Decimal(str(value)), "f")))


@dataclass
class Filters:
    statement_id: int | None = None
    date_from: date | None = None
    date_to: date | None = None
    direction: str | None = None
    method: str | None = None
    category: str | None = None
    amount_min: float | None = None
    amount_max: float | None = None
    text: str | None = None

    def conditions(self) -> list[Column]:
        """All that were asked for. A direction other than cargo or abono is no filter; 0 is an amount but no statement."""
        c, out = F.col, []
        if self.statement_id:
            out.append(c("statement_id") == self.statement_id)
        if self.date_from:
            out.append(c("date_iso") >= F.lit(self.date_from))
        if self.date_to:
            out.append(c("date_iso") <= F.lit(self.date_to))
        if self.direction in ("cargo", "abono"):
            out.append(c("direction") == self.direction)
        if self.method:
            out.append(c("method") == self.method)
        if self.category:
            out.append(c("category") == self.category)
        if self.amount_min is not None:
            out.append(c("amount") >= _bound(self.amount_min))
        if self.amount_max is not None:
            out.append(c("amount") <= _bound(self.amount_max))
        if self.text and (key := normalize_text(self.text)):
            # the text is matched literally: % and _ have no meaning of their own
            out.append(c("search_key").contains(key) | F.lower("description").contains(self.text.lower()))
        return out


def search(ops: DataFrame, filters: Filters) -> DataFrame:
    return reduce(lambda df, cond: df.filter(cond), filters.conditions(), ops)


#: Letters in a part of a key, and how many parts of a text are looked up.
LETTERS, MOST_PARTS = 3, 4


def grams(ops: DataFrame) -> DataFrame:
    """ops (id, search_key, date_iso) to gram, id, month: every LETTERS letters in a row of a search key, each once, and the shorter ones at its end."""
    key = F.col("search_key")
    parts = F.when(F.length(key) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.substring(key, i, F.lit(LETTERS)))))
    month = F.coalesce(F.year("date_iso") * 100 + F.month("date_iso"), F.lit(0)).cast("int")
    return ops.select(F.explode(parts).alias("gram"), "id", month.alias("month"))


def candidates(grams: DataFrame, text: str) -> DataFrame | None:
    """The rows of grams (gram, id, ...), one for each id, whose operation may hold a text: null if the text has no letter, so that any may.

    A text of LETTERS or more is in a key only where all its parts are; the rarest MOST_PARTS of them are looked up and met.
    A shorter one is the beginning of a part. What is found must be verified by the filter itself.
    """
    key = normalize_text(text)
    if not key:
        return None
    others = [c for c in grams.columns if c not in ("gram", "id")]
    if len(key) < LETTERS:
        return grams.filter(F.col("gram").startswith(key)).select("id", *others).distinct()
    parts = sorted({key[i : i + LETTERS] for i in range(len(key) - LETTERS + 1)})
    some = grams.filter(F.col("gram").isin(parts))
    if len(parts) > MOST_PARTS:
        counts = {r.gram: r.n for r in some.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = sorted(parts, key=lambda g: (counts.get(g, 0), g))[:MOST_PARTS]
        some = grams.filter(F.col("gram").isin(parts))
    return some.groupBy("id", *others).agg(F.countDistinct("gram").alias("k")).filter(F.col("k") == len(parts)).drop("k")


def total(ops: DataFrame, filters: Filters) -> int:
    """How many operations pass the filters: the number behind a list's page count."""
    return search(ops, filters).count()


def counted(ops: DataFrame, filters: Filters) -> DataFrame:
    """total() as a frame of one row."""
    return search(ops, filters).agg(F.count(F.lit(1)).alias("total"))


LISTED = [
    "id", "statement_id", "seq", "date", "date_iso", "number", "description", "cargo", "abono", "igtf", "amount", "direction", "method", "category", "counterpart", "counterpart_account", "counterpart_bank",
    "reference", "concept", "occurred_at", "phone", "balance_computed",
]


def listed(ops: DataFrame) -> DataFrame:
    """The 22 columns of a list of operations, the day as ISO text."""
    return ops.withColumn("date_iso", F.date_format("date_iso", "yyyy-MM-dd")).select(*LISTED)


def ordered(ops: DataFrame, sort: str = "date", descending: bool = True) -> DataFrame:
    """By a listed column, nulls last either way, then by id in the same direction."""
    c = F.col(SORTS.get(sort, "date_iso"))
    return ops.orderBy(c.desc_nulls_last(), F.desc("id")) if descending else ops.orderBy(c.asc_nulls_last(), F.asc("id"))


def page(ops: DataFrame, number: int = 1, size: int = 50, sort: str = "date", descending: bool = True) -> DataFrame:
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and hold 1 to 500 rows")
    return ordered(ops, sort, descending).offset((number - 1) * size).limit(size)


#: Rows among which a page's first row is looked up by order; steps of a histogram.
FEW, STEPS = 10_000, 1024


def after(ops: DataFrame, value, key: int, sort: str = "date", descending: bool = True, itself: bool = False) -> DataFrame:
    """The rows that follow a row (its sorted value and id) in the order of a list; with itself, that row too. A list's next page is after(...).limit(size) in order."""
    column, i = F.col(SORTS.get(sort, "date_iso")), F.col("id")
    beyond = (i < key) if descending else (i > key)
    beyond = beyond | (i == key) if itself else beyond
    if value is None:
        return ops.filter(column.isNull() & beyond)
    v = F.lit(value)
    return ops.filter(column.isNull() | ((column < v) if descending else (column > v)) | ((column == v) & beyond))


def _narrowed(rows: DataFrame, column: Column, offset: int, descending: bool) -> tuple[DataFrame, int, bool]:
    """The part of rows (by steps of a numeric column) that holds the one at an offset in its order, the offset there, and whether the part is more than FEW rows of one value."""
    while True:
        low, high, n = rows.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        if n <= FEW or low == high:
            return rows, offset, n > FEW
        step = F.least(F.floor((column - low) / (high - low) * STEPS), F.lit(STEPS - 1))
        counts = sorted((tuple(r) for r in rows.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=descending)
        for s, k in counts:
            if offset < k:
                break
            offset -= k
        rows = rows.filter(step == s)
        if len(counts) == 1:
            return rows, offset, True


def _narrowed_text(rows: DataFrame, column: Column, offset: int, descending: bool) -> tuple[DataFrame, int, bool]:
    """The same by the beginnings of texts, two letters more at each step."""
    known = 0
    while True:
        if rows.limit(FEW + 1).count() <= FEW:
            return rows, offset, False
        counts = sorted((tuple(r) for r in rows.groupBy(F.substring(column, F.lit(1), F.lit(known + 2)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: x[0].encode(), reverse=descending)
        for s, k in counts:
            if offset < k:
                break
            offset -= k
        rows, known = rows.filter(F.substring(column, F.lit(1), F.lit(known + 2)) == s), known + 2
        if len(s) < known:
            return rows, offset, True


def seek(ops: DataFrame, offset: int, sort: str = "date", descending: bool = True) -> tuple | None:
    """Sorted value and id of the row at an offset of a list; none beyond its end. Histograms narrow the rows down, so nothing is sorted but FEW of them."""
    name = SORTS.get(sort, "date_iso")
    rows, column = ops.select(name, "id"), F.col(name)
    kind = dict(rows.dtypes)[name]
    there, whole = rows.agg(F.count(column), F.count(F.lit(1))).first()
    if offset >= whole:
        return None
    if offset < there:
        rows = rows.filter(column.isNotNull())
        if kind == "string":
            rows, offset, same = _narrowed_text(rows, column, offset, descending)
        else:
            rows, offset, same = _narrowed(rows, F.unix_date(column).cast("double") if kind == "date" else column.cast("double"), offset, descending)
    else:
        rows, offset, same = rows.filter(column.isNull()), offset - there, True
    if same:
        rows, offset, _ = _narrowed(rows, F.col("id"), offset, descending)
    found = ordered(rows, sort, descending).offset(offset).limit(1).collect()
    return tuple(found[0]) if found else None


def page_at(ops: DataFrame, number: int = 1, size: int = 50, sort: str = "date", descending: bool = True) -> DataFrame:
    """page() at any depth: the page's first row is found by histograms, and the page is the first rows from there on. Rows must not change meanwhile."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and hold 1 to 500 rows")
    if number == 1:
        return page(ops, 1, size, sort, descending)
    first = seek(ops, (number - 1) * size, sort, descending)
    return ops.limit(0) if first is None else ordered(after(ops, *first, sort, descending, True), sort, descending).limit(size)


def page_count(total: int, size: int = 50) -> int:
    return max(1, -(-total // size))


def by_id(table: DataFrame, key: int) -> DataFrame:
    """The row with an id; none if there is none."""
    return table.filter(F.col("id") == key)


def detail(ops: DataFrame, statements: DataFrame, key: int) -> DataFrame:
    """One operation with its file's name, null where the statement is missing."""
    names = statements.select(F.col("id").alias("statement_id"), "file_name")
    return by_id(ops, key).join(names, "statement_id", "left")


def export_rows(ops: DataFrame, statements: DataFrame) -> DataFrame:
    """The rows of the CSV export: amounts with decimal comma, empty for null, in order of day and id (unknown days first)."""
    comma = lambda x: F.coalesce(F.translate(F.col(x).cast("decimal(18,2)").cast("string"), ".", ","), F.lit(""))
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    day = F.coalesce(F.date_format("date_iso", "yyyy-MM-dd"), text("date"))
    values = [day, *[text(x) for x in ("description", "method", "category", "counterpart", "counterpart_account", "counterpart_bank", "reference", "concept")], *[comma(x) for x in ("cargo", "abono", "igtf", "balance_computed")], text("file_name")]
    rows = ops.join(statements.select(F.col("id").alias("statement_id"), "file_name"), "statement_id", "left")
    return rows.orderBy(F.col("date_iso").asc_nulls_first(), "id").select(*[v.alias(n) for v, n in zip(values, EXPORT_COLUMNS, strict=True)])
