"""What must not gather a list: rules, duplicates, pages, exports; each against the plain way."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import categories, reconcile, search, stats
from ledgerloom.sources import tables

OPS = "id long, statement_id long, seq int, date_iso date, cargo decimal(18,2), abono decimal(18,2), amount decimal(18,2), direction string, method string, category string, description string, search_key string, reference string, counterpart_account string"


@pytest.fixture(scope="module")
def ops(spark):
    r, rows = random.Random(3), []
    for i in range(600):
        text = " ".join(r.choice(["pago", "luz", "agua", "renta", "ab", "x", "zz"]) for _ in range(r.randrange(4)))
        day = None if i % 19 == 0 else date(2024, 1, 1) + timedelta(r.randrange(40))
        amount = D(r.randrange(1, 2000)) / 4
        rows.append((i, i % 23, i // 23, day, amount, D(0), amount, "cargo", r.choice(["cheque", "comision", None]), r.choice(["A", "B", None]), text, text.replace(" ", ""), None, r.choice([None, "", "7"])))
    rows += [(1000 + i, i // 2, 50 + i % 2, date(2024, 5, 5), D(9), D(0), D(9), "cargo", "cheque", "A", "fee", "fee", "R", "1") for i in range(3000)]  # one fee on all statements, twice each
    return spark.createDataFrame(rows, OPS).repartition(5).cache()


@pytest.mark.parametrize("n", [0, 5, 3000])
def test_rules_of_any_number(spark, ops, n):
    r = random.Random(n)
    words = ["pago", "luz", "agua", "renta", "ab", "x", "zz", "Págo", "fee", "ee"]
    rules = [(i, r.choice(words) + (r.choice(words) if r.random() < 0.5 else "") + ("q" * (i % 7) if n > 5 else ""), f"c{i}", r.choice([1, 2, None])) for i in range(n)] + ([(n, " ", "none", 0), (n + 1, "x", "X", 3)] if n else [])
    df = spark.createDataFrame(rules, "id long, pattern string, category string, priority int")
    got = {x.id: x.category for x in categories.categorize(ops, df).collect()}
    order = sorted((100 if p is None else p, i, c, k) for i, t, c, p in rules if (k := search.normalize_text(t)))
    for x in ops.select("id", "search_key", "method").collect():
        want = next((c for _, _, c, k in order if k in x.search_key), None) or categories.DEFAULT_CATEGORIES.get(x.method, "Otros")
        assert got[x.id] == want, (x, want)
    assert len(got) == ops.count()
    plan = categories.categorize(ops, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most", [0, categories.BROADCAST])
def test_rules_broadcast_no_operations(spark, ops, tmp_path, monkeypatch, most):
    """However small Spark takes the operations to be, none of their letters is gathered on the driver; patterns end, begin and nest anywhere."""
    monkeypatch.setattr(categories, "BROADCAST", most)
    ops.select("id", "search_key", "method").write.parquet(f"{tmp_path}/ops")
    rows = spark.read.parquet(f"{tmp_path}/ops")
    rules = [(1, "luz", "light", 9), (2, "Luz ag", "both", 8), (3, "z", "last", 10), (4, "ab", "ab", 3), (5, "pago pago", "twice", 2), (6, "q" * 200, "long", 1), (7, "luz", "again", 9)]
    out = categories.categorize(rows, spark.createDataFrame(rules, "id long, pattern string, category string, priority int"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == (2 if most else 1) and "NestedLoop" not in plan
    order = sorted((p, i, c, search.normalize_text(t)) for i, t, c, p in rules)
    got = {r.id: r.category for r in out.collect()}
    for r in rows.collect():
        assert got[r.id] == (next((c for _, _, c, k in order if k in r.search_key), None) or categories.DEFAULT_CATEGORIES.get(r.method, "Otros"))
    assert set(got.values()) >= {"light", "both", "last", "ab", "twice"} and len(got) == 3600


def test_duplicates_without_large_arrays(ops):
    groups = {}
    for x in ops.collect():
        groups.setdefault((x.amount, x.date_iso, x.direction, x.reference or "", x.counterpart_account or ""), []).append((x.statement_id, x.seq, x.id))
    want = {k: sorted(v) for k, v in groups.items() if len({s for s, *_ in v}) > 1}
    rows = {}
    for x in stats.duplicate_members(ops, None).collect():
        key = (x.amount, x.date_iso, x.direction, x.reference, x.counterpart_account)
        rows.setdefault(key, []).append((x.position, (x.statement_id, x.seq, x.id)))
        assert (x.n, x.statements) == (len(want[key]), len({s for s, *_ in want[key]}))
    assert {k: sorted(v) for k, v in rows.items()} == {k: list(enumerate(v, 1)) for k, v in want.items()}
    top = stats.duplicate_groups(ops, 2, shown=7).collect()
    assert len(top) == 2 and top[0].n == 3000 and top[0].statements == 1500 and [tuple(m) for m in top[0].members] == want[next(k for k in want if k[0] == 9 and k[3] == "R")][:7]


@pytest.mark.parametrize("sort", ["date", "amount", "description", "category"])
@pytest.mark.parametrize("descending", [True, False])
def test_pages_at_any_depth(ops, monkeypatch, sort, descending):
    monkeypatch.setattr(search, "FEW", 20)
    monkeypatch.setattr(search, "STEPS", 8)
    whole = [r.id for r in search.ordered(ops, sort, descending).select("id").collect()]
    for number in (1, 37, 73):
        assert [r.id for r in search.page_at(ops, number, 50, sort, descending).collect()] == whole[(number - 1) * 50 : number * 50]
    value, key = search.seek(ops, 49, sort, descending)
    assert key == whole[49] and [r.id for r in search.ordered(search.after(ops, value, key, sort, descending), sort, descending).limit(5).collect()] == whole[50:55]


def test_export_is_the_single_file(spark, ops, tmp_path):
    names = spark.range(30).select("id", F.concat(F.lit("s"), "id", F.lit('";.pdf')).alias("file_name"))
    full = ops.withColumns({c: F.lit(None).cast("string") for c in ("date", "counterpart", "counterpart_bank", "concept")} | {"igtf": F.lit(0).cast("decimal(18,2)"), "balance_computed": F.lit(None).cast("decimal(18,2)")})
    rows = search.export_rows(full, names)
    tables.write_csv(rows, f"{tmp_path}/single")
    assert tables.write_joined_csv(rows.hint("none"), f"{tmp_path}/joined.csv") >= 1
    single = next((tmp_path / "single").glob("part-*")).read_bytes()
    assert (tmp_path / "joined.csv").read_bytes() == single and single.count(b"\n") == 3601
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tables.write_joined_csv(search.export_rows(full, names), f"{tmp_path}/joined.csv") > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (tmp_path / "joined.csv").read_bytes() == single and not (tmp_path / "joined.csv.parts").exists()


def test_overlaps_follow_the_new_statements(spark):
    """Against brute force, with long periods, ties and null accounts; known pairs don't come back."""
    r, rows = random.Random(5), []
    for i in range(200):
        a = date(2020, 1, 1) + timedelta(r.randrange(500))
        b = a + timedelta(r.choice([0, 5, 30, 30, 400]))
        rows.append((i, r.choice(["a", "b", None]), a.strftime("%d-%m-%y"), b.strftime("%d-%m-%y"), a, b))
    schema = "id long, account_number string, period_start string, period_end string, a date, b date"
    new, known = rows[:20], rows[20:]
    got = reconcile.overlaps_with(spark.createDataFrame(new, schema), spark.createDataFrame(rows, schema)).collect()
    want = [(x[0], y[0]) for x in new for y in rows if x[0] != y[0] and x[1] and x[1] == y[1] and x[4] <= y[5] and y[4] <= x[5]]
    assert sorted(map(tuple, got)) == sorted(want) and want and len(known) == 180


def test_overlaps_are_dealt_by_year(spark):
    """A period of a year is shuffled as a row or two, not as one a month; periods over many years still meet once."""
    rows = [(1, "a", "01-01-20", "31-12-20"), (2, "a", "31-12-20", "01-01-24"), (3, "a", "01-06-19", "30-06-25"), (4, "a", "02-01-24", "03-01-24"), (5, "b", "01-01-20", "31-12-20")]
    df = spark.createDataFrame(rows, "id long, account_number string, period_start string, period_end string")
    out = reconcile.overlaps(df)
    assert "month(" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted((a, b) for x, y in [(1, 2), (1, 3), (2, 3), (3, 4)] for a, b in [(x, y), (y, x)])
