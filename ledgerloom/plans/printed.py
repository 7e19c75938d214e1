"""Queries that run the segmentation of printed statements whole, and their SQL twins over the orders themselves.

Every customer is a statement. Its orders are printed on ledger pages, twenty rows a page, as positioned words, below a header on the
first page alone, so that anchors are carried from page to page. A row has a second line; in some it holds an amount, which is not summed but warned of. A last
page lists some orders as annex, each followed by the line of its time. The twins never see a word: they say what the pages must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import segment
from ..schemas import WORDS

#: Pages are so wide that no word stands in their middle: they have one column.
WIDTH, ROWS = 2000.0, 20
#: Right edges of the amount columns.
EDGES = {"CARGOS": 196.0, "ABONOS": 236.0, "IMPUESTO": 274.0, "SALDO": 312.0}
MONTO = 288.0


#: Words that may be printed for an order: left edge, right edge (one follows from the other, letters three wide), text (None: of the order).
LEDGER = [(10, None, None), (40, 58, None), (65, None, "PAGO"), (80, 150, None), (None, None, None), (65, None, "ORDEN"), (90, 130, None), (None, EDGES["CARGOS"], "1,00")]
ANNEX = [(10, None, None), (40, None, None), (90, 140, None), (None, MONTO, None), (70, None, "EL"), (80, None, None), (110, None, "A"), (116, None, "LAS"), (128, None, "10:00:00")]
#: Titles of every page, which set how far descriptions reach; the ledger's header on the first; the annex's on the last.
TITLES = [(50, None, "MOVIMIENTOS"), (100, None, "DE"), (110, 188, "CUENTA")]
HEADER = [(10, None, "FECHA"), (65, None, "DESCRIPCION")] + [(None, x, n) for n, x in EDGES.items()]
END = [(10, None, "FECHA"), (30, None, "TR."), (45, None, "OPERACION"), (None, MONTO - 2, "MONTO")]
PARTS = [LEDGER, ANNEX, TITLES, HEADER, END]


def printed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their place among those of their customer, dealt by customer: so many parts as are set, since Spark would merge parts by the size of orders, not of pages."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1  # the orders of one customer
    return o.select(
        F.col("o_custkey").alias("statement_id"), "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), (F.col("o_orderstatus") == "F").alias("debit"), place.alias("i"),
    )


def printed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all statements: each order with the numbers of its words in PARTS, then each word by its number."""
    rows, everything = printed_orders(spark, sf_dir), [w for part in PARTS for w in part]
    first = [sum(map(len, PARTS[:n])) for n in range(len(PARTS) + 1)]
    numbers = lambda low, high: F.array(*map(F.lit, range(low, high)))
    some = lambda hit, low, high: F.when(hit, numbers(low, high)).otherwise(F.array().cast("array<int>"))
    slot, key = F.col("i") % ROWS, F.col("o_orderkey")
    rows = rows.withColumn("last", (F.floor(F.max("i").over(W.partitionBy("statement_id")) / ROWS) + 2).cast("int"))
    # the first order of a page brings its titles, the first of all the headers
    words = rows.withColumn("k", F.explode(F.concat(numbers(0, 7), some(key % 7 == 0, 7, 8), some(key % 3 == 0, first[1], first[2]), some(slot == 0, first[2], first[3]), some(F.col("i") == 0, first[3], first[5]))))
    k, a = F.col("k"), first[1]
    known = lambda n, kind: F.get(F.array(*[F.lit(w[n]).cast(kind) for w in everything]), k)
    day, money = lambda form: F.date_format("day", form), F.translate(F.format_number("price", 2), ",.", ".,")
    text = F.when(k.isin(0, a, a + 1), day("dd/MM")).when(k == 1, (key + 10_000).cast("string")).when(k == 3, F.concat(F.lit("CLIENTE-"), "statement_id")).when(k.isin(4, a + 3), money).when(k == 6, F.concat(F.lit("N"), key)).when(k == a + 2, F.concat(F.lit("CARGO-"), key)).when(k == a + 5, day("dd-MM-yy")).otherwise(known(2, "string"))
    page = F.when((k < a) | k.between(first[2], first[3] - 1), (F.floor(F.col("i") / ROWS) + 1).cast("int")).when(k.between(first[3], first[4] - 1), 1).otherwise(F.col("last"))
    # a row and its second line; the annex, a line for the row and one for its time; a page of any height
    row, down = 80.0 + slot * 24.0, 100.0 + F.col("i") * 24.0
    y = F.when(k < 5, row).when(k < a, row + 10).when(k < a + 4, down).when(k < first[2], down + 10).when(k < first[3], 40.0).otherwise(60.0)
    right = F.when(k == 4, F.when(F.col("debit"), EDGES["CARGOS"]).otherwise(EDGES["ABONOS"])).otherwise(known(1, "double"))
    words = words.select("statement_id", page.alias("page"), known(0, "double").alias("left"), right.alias("right"), y.alias("y0"), text.alias("text"))
    size = 3.0 * F.length("text")
    words = words.select("statement_id", "page", F.lit(WIDTH).alias("page_width"), F.coalesce("left", F.col("right") - size).alias("x0"), "y0", F.coalesce("right", F.col("left") + size).alias("x1"), (F.col("y0") + 5.5).alias("y1"), "text")
    return words.select(*[f.split(" ")[0] for f in WORDS.split(", ")])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.marked(printed_words(spark, sf_dir))


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = segment.ledger(lines(spark, sf_dir))
    return rows.select("statement_id", "seq", "page", "date", "number", "description", F.col("cargo").cast("double").alias("cargo"), F.col("abono").cast("double").alias("abono"), "direction")


def ledger_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.ledger(lines(spark, sf_dir))[2].groupBy("statement_id", "detail").agg(F.count(F.lit(1)).alias("n"))


def annex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.listed(lines(spark, sf_dir), "ANNEX", 80)
    return rows.select("statement_id", F.col("ord").cast("long").alias("ord"), "page", "date_tr", "date_op", "description", F.col("amount").cast("double").alias("amount"), "timestamp")


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("statement_id", "section", "page").distinct()


_ORDERS = f"o AS (SELECT o_custkey AS statement_id, o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus = 'F' AS debit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), p AS (SELECT *, CAST(i // {ROWS} + 1 AS INTEGER) AS page, CAST(max(i) OVER (PARTITION BY statement_id) // {ROWS} + 2 AS INTEGER) AS last FROM o)"
QUERIES = {"ledger_rows": ledger_rows, "ledger_warnings": ledger_warnings, "annex_rows": annex_rows, "section_pages": section_pages}
ORACLES = {
    "ledger_rows": f"WITH {_ORDERS} SELECT statement_id, CAST(i + 1 AS INTEGER) AS seq, page, strftime(day, '%d/%m') AS date, CAST(o_orderkey + 10000 AS VARCHAR) AS number, 'PAGO CLIENTE-' || statement_id || ' ORDEN N' || o_orderkey AS description, CAST(CASE WHEN debit THEN price ELSE 0 END AS DOUBLE) AS cargo, CAST(CASE WHEN debit THEN 0 ELSE price END AS DOUBLE) AS abono, CASE WHEN debit THEN 'cargo' ELSE 'abono' END AS direction FROM p",
    "ledger_warnings": f"WITH {_ORDERS} SELECT statement_id, 'p' || page || ': amount in a continuation line: 1,00' AS detail, count(*) AS n FROM p WHERE o_orderkey % 7 = 0 GROUP BY ALL",
    "annex_rows": f"WITH {_ORDERS} SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY i) AS ord, last AS page, strftime(day, '%d/%m') AS date_tr, strftime(day, '%d/%m') AS date_op, 'CARGO-' || o_orderkey AS description, CAST(price AS DOUBLE) AS amount, strftime(day, '%d-%m-%y') || ' 10:00:00' AS timestamp FROM p WHERE o_orderkey % 3 = 0",
    "section_pages": f"WITH {_ORDERS} SELECT DISTINCT statement_id, 'LEDGER' AS section, page FROM p UNION ALL SELECT DISTINCT statement_id, 'ANNEX', last FROM p",
}
