"""From words to reconciled statements."""

import math
import random
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import layout, reconcile, segment
from ledgerloom.plans import catalog, printed
from ledgerloom.sources import fixtures as fx


@pytest.fixture(scope="module")
def parsed(spark):
    words = fx.words(spark, [fx.statement(1), fx.statement(2, 123.45), fx.statement(3, tax=5.0)]).repartition(2, "statement_id").cache()
    p = segment.parse(words)
    issues = reconcile.issues(p.covers, p.operations, p.checkpoints, p.annex, p.pos, p.fidelity).cache()
    return words, p, issues


def test_operations(parsed):
    rows = {(r.statement_id, r.seq): r for r in parsed[1].operations.collect()}
    assert len(rows) == 12
    first = rows[1, 1]
    assert "A LA CUENTA DE ELENA VARGAS" in first.description and first.number == "00041170"
    assert (first.method, first.counterpart, first.counterpart_account) == ("transferencia_enviada", "Elena Vargas", "4471")
    assert first.occurred_at == "03-01-24 09:15:30"
    assert [rows[1, i].balance_computed for i in (1, 2, 3, 4)] == [D("179.50"), D("1429.50"), D(1340), D(1750)]
    assert rows[3, 3].igtf == D(5) and rows[1, 4].number == "00041173"
    assert rows[1, 3].balance_printed == D(1340)


def test_cover_annex_pos(parsed):
    p = parsed[1]
    cover = {r.statement_id: r for r in p.covers.collect()}[1]
    assert (cover.holder, cover.account_number, cover.period_start) == ("ROMERO CARLA", "1702345678", "01-01-24")
    assert (cover.saldo_inicio, cover.otros_creditos, cover.otros_debitos, cover.saldo_final) == (D(500), D(1660), D(410), D(1750))
    annex = [r for r in p.annex.orderBy("ord").collect() if r.statement_id == 1]
    assert [r.amount for r in annex] == [D("320.50"), D(1250)] and annex[0].timestamp == "03-01-24 11:40:00"
    pos = [r for r in p.pos.collect() if r.statement_id == 1]
    assert len(pos) == 1 and pos[0].amount == D("89.50") and pos[0].date == "15/01"


def test_statuses(parsed):
    _, p, issues = parsed
    status = {r.statement_id: r.status for r in reconcile.statuses(p.covers, issues).collect()}
    found = issues.collect()
    assert status[1] == "CUADRA", found
    assert status[2] == "DIFERENCIAS"
    two = [r for r in found if r.statement_id == 2]
    assert [r.parsed - r.expected for r in two if r.kind == "cargo"] == [D("-123.45")]
    missing = [r for r in two if r.kind == "fila_omitida"]
    assert len(missing) == 1 and "123,45" in missing[0].detail
    # the printed balances hold the tax, the cover's tax field doesn't: the net still agrees
    assert status[3] == "CUADRA", [r for r in found if r.statement_id == 3]


def test_detect(parsed):
    assert all(r.supported for r in segment.detect(parsed[0]).collect())


def test_split_and_cluster(spark):
    word = lambda x, y=0.0, w=792.0: (1, 1, w, float(x), y, float(x) + 30, y + 6, "t")
    schema = segment_schema()
    wide = spark.createDataFrame([word(10), word(60), word(500)], schema)
    assert 90 < layout.column_split(wide).first().split < 500
    narrow = spark.createDataFrame([word(10, w=600.0), word(20, w=600.0), word(30, w=600.0)], schema)
    assert layout.column_split(narrow).first().split == 601
    lines = layout.page_lines(spark.createDataFrame([word(10, 100.0), word(10, 103.0), word(10, 106.0)], schema))
    assert sorted(len(r.tokens) for r in lines.collect()) == [1, 2]


def segment_schema():
    from ledgerloom.schemas import WORDS

    return WORDS


def test_lines_are_a_fold(spark):
    """Lines against the plain fold, with heights that are missing, no number, equal or chained, and words beyond the page."""
    r, rows = random.Random(4), []
    for statement in range(6):
        for page in range(3):
            for i in range(r.randrange(1, 40)):
                y = r.choice([None, float("nan"), float("inf"), 0.0]) if statement == 5 and r.random() < 0.2 else r.randrange(120) / (2 if statement % 2 else 1)
                rows.append((statement, page, 600.0, float(r.randrange(-10, 640)), y, float(r.randrange(700)), 0.0, f"t{i % 7}"))
    words = spark.createDataFrame(rows, segment_schema()).repartition(3)
    splits = {(x.statement_id, x.page): x.split for x in layout.column_split(words).collect()}
    want, key = {}, lambda x: (x is not None, x)
    for (s, p), split in splits.items():
        for side, low, high in (("L", 0, split), ("R", split, 601)):
            mine = [w for w in rows if w[:2] == (s, p) and low <= w[3] < high]
            number, base = 0, None
            for y in sorted({w[4] for w in mine if w[4] is not None and w[4] == w[4]}) + [w[4] for w in mine if w[4] is not None and w[4] != w[4]][:1]:
                if base is None or not y - base <= 3.5:
                    number, base = number + 1, y
                for w in mine:
                    if repr(w[4]) == repr(y):
                        want.setdefault((s, p, side, number), []).append(w)
            if none := [w for w in mine if w[4] is None]:
                want[s, p, side, 0] = none
    order = lambda w: (w[3], key(w[4]) if w[4] == w[4] else (True, math.inf, 1), w[5], w[7])
    got = {(x.statement_id, x.page, x.side, x.line_no): x for x in layout.page_lines(words).collect()}
    assert set(got) == set(want) and any(k[2] == "R" for k in want)
    for k, x in got.items():
        assert x.words == [w[7] for w in sorted(want[k], key=order)] and len(x.tokens) == len(want[k])
    one = {(x.statement_id, x.page, x.line_no, repr(x.y), len(x.tokens)) for x in layout.cluster_lines(layout.sided(words, None)).collect()}
    assert sum(x[-1] for x in one) == len(rows)


def test_pages_are_read_once(spark, tmp_path):
    """Printed statements: one scan, one shuffle, no join, however much of a page's lines a result needs."""
    spark.createDataFrame([(k, k % 3, "F", 2.5, datetime(2024, 1, 2), "5-LOW") for k in range(90)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    for query in (printed.ledger_rows, printed.ledger_warnings):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_sides_without_anchors_are_warned_of_once(spark):
    """A page before any header: one warning a side, no rows; later pages carry the header on."""
    words = [(1, 1, 2000.0, 10.0, 50.0, 20.0, 55.0, "01/02"), (1, 1, 2000.0, 10.0, 80.0, 20.0, 85.0, "02/02")]
    words += [(1, 2, 2000.0, x, 50.0, x + 20, 55.0, t) for x, t in ((10.0, "DESCRIPCION"), (200.0, "CARGOS"), (240.0, "ABONOS"))] + [(1, 3, 2000.0, x, 90.0, x + 20, 95.0, t) for x, t in ((10.0, "03/02"), (60.0, "PAGO"), (202.0, "7,00"))]
    rows, _, warnings = segment.ledger(segment.marked(spark.createDataFrame(words, segment_schema())))
    assert [(r.date, r.cargo, r.page, r.seq) for r in rows.collect()] == [("03/02", D(7), 3, 1)]
    assert [r.detail for r in warnings.collect()] == ["p1: no column anchors on side L"]


def test_pages_of_documents_are_shuffled_as_text(spark, tmp_path):
    """Lines of documents, with texts that are missing, empty, long or of one doc_id, as from their words one by one; what is shuffled has no word's place."""
    texts = [(1, "a b  c"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(450)) + " "), (5, "x " * 30), (5, "y z"), (5, "x " * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["line_cluster"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "y0" not in plan.split("Exchange")[1]
    words = layout.cluster_lines(layout.sided(catalog.page_words(spark, str(tmp_path)), None))
    assert layout.column_lines(catalog.page_columns(spark, str(tmp_path))).select(*words.columns).exceptAll(words).isEmpty()
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, words.select("statement_id", "page", "line_no", "y", F.size("tokens").alias("n")).collect())) and sum(r[-1] for r in rows) == 4 + 1 + 1 + 451 + 31 + 2 + 31
