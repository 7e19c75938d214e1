"""Operators over ledgers on small tables."""

import random
import unicodedata
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, labels, text
from ledgerloom.functions.enrich import enrich
from ledgerloom.operators import balance, categories, reconcile, search, stats
from ledgerloom.schemas import RULES
from ledgerloom.sources import tables

OPS = "id long, statement_id long, seq int, date_iso date, cargo decimal(18,2), abono decimal(18,2), igtf decimal(18,2), amount decimal(18,2), direction string, method string, category string, counterpart string, concept string, description string, search_key string, balance_computed decimal(18,2), reference string, counterpart_account string"


def op(i, statement=1, day=date(2024, 1, 2), cargo=0, abono=0, igtf=0, method="cheque", category="Cheques", counterpart=None, description="x", key="x", bal=None):
    return (i, statement, i, day, D(cargo), D(abono), D(igtf), D(abono or cargo), "abono" if abono else "cargo", method, category, counterpart, None, description, key, bal, None, None)


@pytest.fixture(scope="module")
def ops(spark):
    rows = [
        op(1, cargo=100, counterpart="Ana", description="PAGO 100%", key="pago100", bal=D(900)),
        op(2, abono=50, igtf=1, method="impuesto", category="", description="Água_x", key="aguax", bal=D(949)),
        op(3, statement=2, day=date(2024, 2, 4), cargo=30, method="comision", category=None, counterpart="Ana", bal=None),
        op(4, statement=2, day=None, cargo=7),
        op(5, statement=3, day=date(2024, 1, 2), cargo=100, counterpart="Eva"),
    ]
    return spark.createDataFrame(rows, OPS).cache()


def test_totals_and_groups(ops):
    t = stats.ledger_totals(ops).first()
    assert (t.cargo, t.abono, t.igtf, t.net, t.n) == (237.0, 50.0, 1.0, -188.0, 5)
    assert stats.ledger_totals(stats.scoped(ops, 2)).first().n == 2 and stats.scoped(ops, 0).count() == 5
    groups = {r.label: r.n for r in stats.grouped(ops, "category").collect()}
    assert groups == {"Cheques": 3, "Sin dato": 2}
    assert [(r.label, r.amount) for r in stats.top_labels(ops, "counterpart", "cargo").collect()] == [("Ana", 130.0), ("Eva", 100.0)]
    costs = {r.method: r.amount for r in stats.bank_costs(ops).collect()}
    assert costs == {"comision": 30.0, "impuesto": 0.0, "igtf": 1.0}


def test_series(ops):
    daily = {r.date_iso: r for r in stats.daily_flow(ops).collect()}
    assert daily[date(2024, 1, 2)].balance == 949.0 and daily[date(2024, 2, 4)].balance is None and len(daily) == 2
    months = {r.statement_id: r for r in stats.monthly(ops).collect()}
    assert months[1].cargo_change is None and months[1].position == 1 and months[3].position == 2
    assert months[2].cargo_change == round((37 - 100) / 100 * 100, 4)
    assert [r.weekday for r in stats.by_weekday(ops).orderBy("weekday").collect()] == [0, 2]
    assert stats.averages(ops).first().active_days == 2
    assert stats.averages(ops.limit(0)).first().mean_amount == 0
    rest = {r.label: r.cargo for r in stats.top_and_rest(ops, "counterpart", 1).collect()}
    assert rest == {"Ana": 130.0, "Otras": 107.0}
    parts = stats.summary(ops)
    assert parts["monthly"].count() == 3 and {"top_concept_abono", "savings"} <= parts.keys()


def test_duplicates(ops):
    g = stats.duplicate_groups(ops).collect()
    assert len(g) == 1 and g[0].statements == 2 and [m.id for m in g[0].members] == [1, 5]


def test_search(ops):
    ids = lambda **k: sorted(r.id for r in search.search(ops, search.Filters(**k)).collect())
    assert ids(text="PAGO 100%") == [1] and ids(text="água_") == [2] and ids(text="100_") == [1] and ids(text="%") == [1, 2, 3, 4, 5]
    assert ids(amount_min=0, amount_max=30) == [3, 4] and ids(direction="none") == [1, 2, 3, 4, 5] and ids(statement_id=0, direction="abono") == [2]
    assert ids(date_from=date(2024, 1, 2), date_to=date(2024, 1, 31)) == [1, 2, 5]
    assert [r.id for r in search.page(ops, 1, 5, "date", False).collect()] == [1, 2, 5, 3, 4]
    assert [r.id for r in search.page(ops, 2, 2, "date", True).collect()] == [2, 1]
    assert search.page_count(0) == 1 and search.page_count(101) == 3
    with pytest.raises(ValueError):
        search.page(ops, 0)


def test_export(spark, ops):
    names = spark.createDataFrame([(1, "a.pdf")], "id long, file_name string")
    full = ops.withColumns({c: F.lit(None).cast("string") for c in ("date", "counterpart_bank")})
    rows = search.export_rows(full, names).collect()
    assert rows[0]["Fecha"] == "" and rows[1]["Cargo"] == "100,00" and rows[1]["Archivo"] == "a.pdf" and rows[0]["Saldo"] == ""


def test_categories(spark, ops):
    rules = [(2, "pa go", "A", 5), (1, "pago", "B", 5), (3, "", "C", 0), (4, "agua", "D", None)]
    df = spark.createDataFrame(rules, "id long, pattern string, category string, priority int")
    want = {1: "B", 2: "D", 3: "Comisiones", 4: "Cheques", 5: "Cheques"}
    assert {r.id: r.category for r in categories.categorize(ops, df).collect()} == want
    many = df.unionByName(spark.range(1000, 1300).select("id", F.concat(F.lit("zz"), F.col("id")).alias("pattern"), F.lit("Z").alias("category"), F.lit(1).alias("priority")))
    assert {r.id: r.category for r in categories.categorize(ops, many).collect()} == want
    assert {r.id: r.category for r in categories.categorize(ops, df.limit(0)).collect()}[3] == "Comisiones"


def test_running_balance_is_a_fold(spark):
    r = random.Random(1)
    rows = [(s, i, D(r.randrange(10000)) / 100, D(r.randrange(10000)) / 100, D(r.randrange(100)) / 100) for s in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "statement_id long, seq int, cargo decimal(18,2), abono decimal(18,2), igtf decimal(18,2)").repartition(3)
    starts = spark.createDataFrame([(1, D("10.00")), (2, None)], "statement_id long, start decimal(18,2)")
    got = {(x.statement_id, x.seq): x.balance_computed for x in balance.running_balance(df, starts).collect()}
    now = D("10.00")
    for s, i, c, a, t in rows:
        if s == 1:
            now += a - c - t
            assert got[1, i] == now
        else:
            assert got[2, i] is None


COVER = "statement_id long, saldo_inicio decimal(18,2), depositos decimal(18,2), otros_creditos decimal(18,2), cheques decimal(18,2), otros_debitos decimal(18,2), igtf decimal(18,2), saldo_final decimal(18,2)"
POINT = "statement_id long, ord int, page int, kind string, label string, printed_balance decimal(18,2), seq int, computed_balance decimal(18,2)"


def reconciled(spark, debits=150, final=150, annex=(), tax_cover=0, tax_rows=0):
    covers = spark.createDataFrame([(1, D(100), D(0), D(200), D(0), D(debits), D(tax_cover), D(final))], COVER)
    rows = spark.createDataFrame([(1, 1, D(0), D(200), D(tax_rows), D(200)), (1, 2, D(150), D(0), D(0), D(150))], "statement_id long, seq int, cargo decimal(18,2), abono decimal(18,2), igtf decimal(18,2), amount decimal(18,2)")
    points = spark.createDataFrame([(1, 1, 1, "inicio", "", D(100), None, D(100)), (1, 2, 1, "intermedio", "", D(final), 2, D(150)), (1, 3, 2, "final", "", D(final), None, D(150))], POINT)
    more = spark.createDataFrame([(1, D(a)) for a in annex], "statement_id long, amount decimal(18,2)")
    found = reconcile.issues(covers, rows, points, more)
    return reconcile.statuses(covers, found).first().status, found.collect()


def test_reconcile(spark):
    assert reconciled(spark, annex=(200, 150)) == ("CUADRA", [])
    status, found = reconciled(spark, debits=180, final=120)
    assert status == "DIFERENCIAS" and [r.expected for r in found if r.kind == "fila_omitida"] == [D(30)] and "cargo" in {r.kind for r in found}
    status, found = reconciled(spark, annex=(999, 200, 200))
    assert status == "REVISAR" and found[0].detail.startswith("2 rows")
    # the ledger's tax is taken off, the cover's added: equal taxes leave a net difference of twice the tax
    status, found = reconciled(spark, tax_cover=5, tax_rows=5)
    assert [(r.expected, r.parsed) for r in found if r.kind == "neto"] == [(D(55), D(45))]


def test_fidelity_warnings_join_the_findings(spark):
    covers = spark.createDataFrame([(i, D(100), D(0), D(0), D(0), D(0), D(0), D(100)) for i in (1, 2, 3)], COVER)
    rows = spark.createDataFrame([(1, 1, D(0), D(9), D(0), D(9))], "statement_id long, seq int, cargo decimal(18,2), abono decimal(18,2), igtf decimal(18,2), amount decimal(18,2)")
    points = spark.createDataFrame([], POINT)
    warned = spark.createDataFrame([(1, "a row has no day"), (2, "two words were not read"), (2, "a page has no header")], "statement_id long, detail string")
    found = reconcile.issues(covers, rows, points, fidelity=warned)
    told = sorted((r.statement_id, r.detail) for r in found.collect() if r.kind == "advertencia")
    assert told == [(1, "a row has no day"), (2, "a page has no header"), (2, "two words were not read")]
    # a difference weighs more than a warning, a warning more than nothing
    assert {r.statement_id: r.status for r in reconcile.statuses(covers, found).collect()} == {1: "DIFERENCIAS", 2: "REVISAR", 3: "CUADRA"}
    assert reconcile.issues(covers, rows, points, fidelity=warned.limit(0)).filter("kind = 'advertencia'").isEmpty()


def test_reports(spark):
    covers = spark.createDataFrame([(1, D(100), D(0), D(200), D(0), D(180), D(0), D(120), "01-01-24", "31-01-24"), (2, D(0), D(0), D(0), D(0), D(0), D(0), D(0), None, None)], f"{COVER}, period_start string, period_end string")
    rows = spark.createDataFrame([(1, 1, D(0), D(200), D(0), D(200)), (1, 2, D(150), D(0), D(0), D(150))], "statement_id long, seq int, cargo decimal(18,2), abono decimal(18,2), igtf decimal(18,2), amount decimal(18,2)")
    points = spark.createDataFrame([(1, 1, 1, "inicio", "", D(100), None, D(100)), (1, 3, 2, "final", "", D(120), None, D(150))], POINT)
    annex = spark.createDataFrame([(1, D(7))], "statement_id long, amount decimal(18,2)")
    found = reconcile.issues(covers, rows, points, annex)
    status = reconcile.statuses(covers, found)
    got = {r.statement_id: r for r in tables.read_reports(tables.reports(covers, rows, points, found, status)).collect()}
    assert (got[1].status, got[1].year, got[1].month, got[1].month_name, got[1].expected_cargo, got[1].computed_net) == ("DIFERENCIAS", 2024, 1, "Enero", D(180), D(50))
    assert [d.kind for d in got[1].differences] == ["cargo", "neto"] and [m.amount for m in got[1].missing_rows] == [D(30)] and len(got[1].warnings) == 1
    assert [c.difference for c in got[1].checkpoints] == [D(0), D(30)]
    assert (got[2].status, got[2].differences, got[2].checkpoints, got[2].year) == ("CUADRA", [], [], 2000)
    said = tables.report(1, covers, rows, points, found, status, annex)
    for part in ("Account  -", "Ledger rows    2", "Annex rows     1", "Debits   150,00", "Official debits 180,00", "delta -30,00", "p2 final printed 120,00 computed 150,00 ??", "p1 inicio printed 100,00 computed 100,00 ok", "Status   DIFERENCIAS"):
        assert part in said, (part, said)
    with pytest.raises(KeyError):
        tables.report(9, covers, rows, points, found, status)
    matrix = {r.statement_id: r for r in reconcile.validation_rows(covers, rows, found).collect()}
    assert (matrix[1].rows, matrix[1].deltas, matrix[1].warnings, matrix[2].deltas, matrix[2].rows) == (2, "cargo:-30,00, neto:30,00", 1, "", 0)


def test_overlaps(spark):
    rows = [(1, "a", "01-01-24", "31-01-24"), (2, "a", "31-01-24", "28-02-24"), (3, "b", "01-01-24", "31-01-24"), (4, "a", "31-02-24", "31-03-24"), (5, None, "01-01-24", "31-01-24")]
    df = spark.createDataFrame(rows, "id long, account_number string, period_start string, period_end string")
    assert sorted(tuple(r) for r in reconcile.overlaps(df).collect()) == [(1, 2), (2, 1)]


def test_dates_and_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    day = lambda d, y, m: one(dates.resolve_date(F.lit(d), F.lit(y), F.lit(m)))
    assert day("31/12", 2024, 1) == date(2023, 12, 31) and day("01/01", 2024, 12) == date(2025, 1, 1) and day("30/02", 2024, 2) is None and day("x", 2024, 2) is None
    assert one(dates.period_date(F.lit("31-02-24"))) is None and one(dates.period_date(F.lit("01-03-24"))) == date(2024, 3, 1)
    assert one(text.parse_amount(F.lit("1.234.567,89"))) == D("1234567.89") and one(text.parse_amount(F.lit("12,3"))) is None
    assert one(text.format_amount(F.lit(D("1234567.80")))) == "1.234.567,80" and one(text.format_amount(F.lit(None).cast("decimal(18,2)"))) == "-"
    for t in ("CU ENTA ñandú", "ﬁn ² ½ ß", "", "Ünï-cödé"):
        assert one(text.normalize_key(F.lit(t))) == text.normalize_text(t)
    assert one(text.title_case(F.lit("MARIA-JOSE D'ARCO"))) == "Maria-Jose D'Arco"
    assert one(dates.money_short(F.lit(2_500_000.0))) == "2.50 MM"
    short = {1500: "1.5 M", -2_340_000_000: "-2340.00 MM", 999.5: "999,50", 0: "0,00"}
    assert {v: one(dates.money_short(F.lit(float(v)))) for v in short} == short and one(dates.money_short(F.lit(None).cast("double"))) == "—"


def test_periods_name_months_that_days_do_not_reach(spark):
    rows = [("01-01-24", "31-02-24", 2024, 2), ("01-03-2023", "", 2023, 3), ("01-03-23", None, 2023, 3), (None, None, 2000, 1), ("x", "1-2", 2000, 1), ("01-00-00", None, 2000, 1)]
    df = spark.createDataFrame(rows, "a string, b string, y int, m int")
    assert [tuple(r) for r in df.select(*dates.period_month(F.col("a"), F.col("b"))).collect()] == [r[2:] for r in rows]


def test_search_keys_fold_as_nfkd(spark):
    """Every character that has a decomposition, alone and inside a word, against the standard library."""
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if c.isascii() and c.isalnum()).lower()
    chars = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.decomposition(c) and fold(c)]
    assert len(chars) > 1500 and {"Ⅳ", "㎏", "𝐀", "¼"} <= set(chars)
    df = spark.createDataFrame([(c, f"A-{c}1") for c in chars], "a string, b string")
    for r in df.select("a", text.normalize_key(F.col("a")).alias("x"), text.normalize_key(F.col("b")).alias("y")).collect():
        assert (r.x, r.y) == (fold(r.a), fold(f"A-{r.a}1")) == (text.normalize_text(r.a), text.normalize_text(f"A-{r.a}1")), r.a


def test_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    day = F.lit(date(2024, 3, 9))
    assert (one(labels.date_label(day)), one(labels.day_month_label(day))) == ("09/03/24", "09/03")
    assert (one(labels.date_label(F.lit(None).cast("date"))), one(labels.day_month_label(F.lit(None).cast("date")))) == ("—", "")
    periods = {"31-01-24": "Enero 2024", "31-12-2023": "Diciembre 2023", "31-13-24": "13 2024", "2024": "2024", "": "—"}
    assert {p: one(labels.period_label(F.lit(p))) for p in periods} == periods and one(labels.period_short(F.lit("01-09-24"))) == "Sep"
    assert one(labels.method_label(F.lit("pago_movil"))) == "pago móvil" and one(labels.method_label(F.lit("x_y_z"))) == "x y z"
    assert one(labels.status_label(F.lit("CUADRA"))) == "cuadra al céntimo" and one(labels.status_label(F.lit("z"))) == "z"


def test_rules(spark, ops):
    rules = categories.add_rule(categories.add_rule(spark.createDataFrame([], RULES), "agua", "Agua", 7), "PAGO 1", "Pagos")
    assert [(r.id, r.category) for r in categories.listed_rules(rules).collect()] == [(1, "Agua"), (2, "Pagos")]
    found = lambda rules: {r.id: r.category for r in categories.categorize(ops, rules).collect()}
    assert (found(rules)[1], found(rules)[2]) == ("Pagos", "Agua")
    assert found(categories.remove_rule(rules, 2))[1] == "Cheques"
    with pytest.raises(KeyError):
        categories.remove_rule(rules, 9)
    for bad in (("", "A", 1), ("a", "", 1), ("a", "A", 1000)):
        with pytest.raises(ValueError):
            categories.add_rule(rules, *bad)


def test_latest(spark):
    df = spark.createDataFrame([(1, "01-01-24"), (2, "x"), (3, "01-02-24"), (4, "01-01-24"), (5, None)], "id long, period_start string")
    assert [r.id for r in stats.latest(df).collect()] == [3, 4, 1, 5, 2] and stats.latest(df, 2).count() == 2


def test_enrich(spark):
    rows = [
        (1, "OPERACION DE CREDITO INMEDIATO ORDENADA POR V12345678 MARIA-JOSE LUNA A LA CUENTA 01050000000000001234 DE BANCO NORTE, C.A.", "abono"),
        (2, "PAGO MOVIL A UN MOVIL 0414-1234567 EN BANESCO BANCO UNIVERSAL S.A.C.A. CON REFERENCIA: 987654 POR CONCEPTO DE N/A EL 02-01-24", "cargo"),
        (3, "ENVIO A LA CUENTA DE NOMBRE-BENEFICIARIO ***5555", "cargo"),
        (4, "PAGO DESDE LA CUENTA NUMERO 11111111 A LA CUENTA NUMERO 22222222", "abono"),
        (5, "PAGO DESDE LA CUENTA NUMERO 11111111 A LA CUENTA NUMERO 22222222", "cargo"),
        (6, "A PEDRO ROJAS POR LA CANTIDAD DE UNO", "cargo"),
        (7, "ENVIADO POR ANA SOL DESDE EL BANCO", "abono"),
        (8, "MERCANTIL EN LINEA PERSONAS", None),
        (9, None, None),
        (10, "COMISION DATO ERRADO", "cargo"),
    ]
    got = {r.id: r for r in enrich(spark.createDataFrame(rows, "id int, description string, direction string")).collect()}
    assert (got[1].method, got[1].counterpart, got[1].counterpart_account, got[1].counterpart_bank) == ("credito_inmediato", "Maria-Jose Luna", "01050000000000001234", "Banco Norte")
    assert (got[2].phone, got[2].reference, got[2].concept, got[2].counterpart_bank) == ("414-1234567", "987654", None, "Banesco Banco Universal")
    assert (got[3].counterpart, got[3].counterpart_account) == (None, "5555")
    assert (got[4].counterpart_account, got[5].counterpart_account) == ("11111111", "22222222")
    assert got[6].counterpart == "Pedro Rojas" and got[7].counterpart == "Ana Sol" and got[8].counterpart_bank == "Mercantil"
    assert got[9].method == "otro" and got[9].counterpart is None and got[10].method == "comision"


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "id long, bank string")
    from ledgerloom import schemas

    assert tables.with_defaults(old, schemas.STATEMENTS).first().holder is None
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "statement_id long, x int")
    path = f"{tmp_path}/t"
    tables.overwrite_statements(rows, path)
    tables.overwrite_statements(rows.filter("statement_id = 1"), path)
    assert spark.read.parquet(path).count() == 3
    adjustments = tables.add_adjustment(spark.createDataFrame([], schemas.ADJUSTMENTS), 1, "02/01", "d", 5.5, "cargo")
    assert adjustments.first().amount == D("5.50") and stats.adjustment_totals(adjustments).first().cargo == 5.5
    assert tables.remove_adjustment(adjustments, 2, 1).count() == 1 and tables.remove_adjustment(adjustments, 1, 1).count() == 0
    with pytest.raises(ValueError):
        tables.add_adjustment(adjustments, 1, "2024", "d", 5, "cargo")


def test_periods_hold_all_operations(spark):
    """Periods and their overlaps against brute force; every operation counts, whatever its id and year."""
    from ledgerloom.plans import catalog

    rows = [(i, 1 + 300 * (i % 3), date(1993 + i % 4, 1 + i // 5 % 12, 1 + i * 7 % 28)) for i in range(1, 60)]
    got = reconcile.overlaps(catalog._periods(spark.createDataFrame(rows, "id long, account long, date_iso date"))).collect()
    periods = {}
    for i, account, day in rows:
        periods.setdefault((account, day.year), []).append((day, i))
    found = [(min(i for _, i in x), min(x)[0], max(x)[0]) for x in periods.values()]
    want = [(x[0], y[0]) for x in found for y in found if x[0] != y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert want and sorted(tuple(r) for r in got) == sorted(want)


def test_migrated(spark):
    """An older table gets the columns that came later, with defaults, and statements that are done are at 100."""
    old = spark.createDataFrame([(1, "CUADRA"), (2, "procesando"), (3, None)], "id long, status string")
    assert [(r.id, r.progress_stage, r.progress_percent, r.started_at) for r in tables.migrated(old).orderBy("id").collect()] == [(1, "listo", 100, None), (2, "en cola", 0, None), (3, "en cola", 0, None)]
    newer = spark.createDataFrame([(1, "procesando", "leyendo", 40), (2, "error", "leyendo", 0)], "id long, status string, progress_stage string, progress_percent int")
    assert [(r.progress_stage, r.progress_percent) for r in tables.migrated(newer).orderBy("id").collect()] == [("leyendo", 40), ("listo", 100)]


def test_positions_of_many_on_one_day(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 7)
    r = random.Random(2)
    rows = [(i, r.choice([None, date(2024, 1, 1), date(2024, 2, 1)])) for i in r.sample(range(1000), 90)]
    df = spark.createDataFrame(rows, "id long, day date").repartition(4)
    last = date(9999, 1, 1)
    want = [i for i, _ in sorted(rows, key=lambda x: (x[1] or last, x[0]))]
    assert [x.id for x in sorted(stats.positions(df, "day").collect(), key=lambda x: x.position)] == want
    newest = [i for i, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or last, x[0]), reverse=True)]
    got = sorted(stats.positions(df, "day", newest=True).collect(), key=lambda x: x.position)
    assert [x.id for x in got] == newest and [x.position for x in got] == list(range(1, 91))


def test_sides_and_second_opening_balance(spark):
    """Without the cover's opening balance the first printed one counts."""
    covers = spark.createDataFrame([(1, None), (2, D(5)), (3, None)], "statement_id long, saldo_inicio decimal(18,2)")
    points = spark.createDataFrame([(1, 2, "inicio", D(9)), (1, 1, "inicio", D(7)), (1, 0, "final", D(1)), (2, 1, "inicio", D(8))], "statement_id long, ord int, kind string, printed_balance decimal(18,2)")
    assert {x.statement_id: x.start for x in balance.start_balances(covers, points).collect()} == {1: D(7), 2: D(5), 3: None}


def test_documents_and_raw_rows(spark, tmp_path):
    """The command line's CSV and JSON document of a statement."""
    import json

    from ledgerloom.operators import segment
    from ledgerloom.sources import fixtures as fx

    p = segment.parse(fx.words(spark, [fx.statement(1)]))
    raw = tables.raw_rows(p.operations)
    assert raw.columns == tables.RAW_FIELDS and [x.seq for x in raw.collect()] == [1, 2, 3, 4]
    tables.write_csv(raw, f"{tmp_path}/raw", ",")
    lines = next((tmp_path / "raw").glob("part-*")).read_text().splitlines()
    assert lines[0] == ",".join(tables.RAW_FIELDS) and len(lines) == 5
    found = reconcile.issues(p.covers, p.operations, p.checkpoints, p.annex, p.pos, p.fidelity)
    row = tables.documents(p, found, reconcile.statuses(p.covers, found)).first()
    document = json.loads(row.document)
    assert document["status"] == "CUADRA" and document["cover"]["holder"] == "ROMERO CARLA" and [x["seq"] for x in document["operations"]] == [1, 2, 3, 4]
    assert len(document["annex"]) == 2 and len(document["pos"]) == 1 and "issues" not in document
    warned = p.fidelity.unionByName(spark.createDataFrame([(1, "p1: odd")], p.fidelity.schema))
    found = reconcile.issues(p.covers, p.operations, p.checkpoints, p.annex, p.pos, warned)
    assert [(x.kind, x.detail) for x in found.collect()] == [("advertencia", "p1: odd")] and reconcile.statuses(p.covers, found).first().status == "REVISAR"
