"""Ingest: files, dedupe, queue, and reruns that leave each row once."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import adapters, categories, search, segment, stats
from ledgerloom.schemas import RULES, WORDS
from ledgerloom.sources import fixtures as fx
from ledgerloom.streaming import ingest


def test_files_and_queue(spark, tmp_path):
    for name, content in (("b.pdf", b"one"), ("a.pdf", b"one"), ("c.pdf", b"two"), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    found = ingest.files(spark, str(tmp_path))
    assert [r.file_name for r in found.collect()] == ["a.pdf", "b.pdf", "c.pdf"]
    known = found.filter("file_name = 'c.pdf'").select("file_hash")
    assert [r.file_name for r in ingest.fresh(found, known).collect()] == ["a.pdf"]
    t = lambda m: datetime(2024, 1, 1, 10, m)
    rows = [(1, "procesando", t(5), None), (2, "procesando", t(1), None), (3, "CUADRA", t(0), None), (4, "error", t(0), None), (5, "procesando", t(0), t(2))]
    jobs = spark.createDataFrame(rows, "id long, status string, uploaded_at timestamp_ntz, started_at timestamp_ntz")
    assert {r.id: r.position for r in ingest.queue_positions(jobs).collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: None}
    now = F.lit(t(33)).cast("timestamp_ntz")
    assert sorted(r.id for r in ingest.retryable(jobs, now).collect()) == [2, 4, 5]


def test_stream_is_idempotent(spark, tmp_path):
    source, root = f"{tmp_path}/words", f"{tmp_path}/tables"
    fx.words(spark, [fx.statement(1), fx.statement(2, 50.0)]).coalesce(1).write.parquet(source)
    count = lambda name: ingest.table(spark, root, name).count()
    sizes = []
    for checkpoint in ("one", "one", "two"):  # a second run, and a reprocess from the start
        ingest.stream_words(spark, source, WORDS, root, f"{tmp_path}/{checkpoint}")
        sizes.append([count(n) for n in ("operations", "annex", "pos", "issues")] + [ingest.statements(spark, root).count()])
    assert sizes[0] == sizes[1] == sizes[2] and sizes[0][:3] == [8, 4, 2] and sizes[0][-1] == 2
    done = ingest.progress(spark, root).collect()
    assert sorted((r.statement_id, r.stage, r.percent, r.eta) for r in done) == [(1, "listo", 100, None), (2, "listo", 100, None)] and all(r.elapsed > 0 for r in done)
    assert ingest.progress(spark, f"{tmp_path}/nowhere").count() == 0
    rules = categories.add_rule(spark.createDataFrame([], RULES), "a", "Todo")
    assert {r.category for r in ingest.operations(spark, root, rules).filter("search_key like '%a%'").collect()} == {"Todo"}
    assert "Todo" not in {r.category for r in ingest.operations(spark, root).collect()}
    ingest.delete_statement(spark, root, 2)
    assert count("operations") == 4 and ingest.statements(spark, root).count() == 1
    ingest.compact(spark, root, f"{tmp_path}/small")
    assert ingest.table(spark, f"{tmp_path}/small", "operations").count() == 4 and ingest.log(spark, f"{tmp_path}/small").count() == 1


def test_from_stream_to_analytics(spark, tmp_path):
    """Two streamed statements of one account, then search, pages, statistics, duplicates and export on what was stored."""
    root, source = f"{tmp_path}/tables", f"{tmp_path}/words"
    spoiled = [(7, *w[1:]) for w in fx.statement(7, month=3)]
    other = [(8, 0, 780.0, 10.0, 10.0, 40.0, 16.0, "Invoice"), (8, 1, 780.0, 10.0, 10.0, 40.0, 16.0, "Total")]
    copy = [(9, *w[1:]) for w in fx.statement(1)]
    fx.words(spark, [fx.statement(1), fx.statement(2, 50.0), spoiled, other, copy]).coalesce(1).write.parquet(source)

    def parse(words, keep=None):
        if not words.filter("statement_id = 7").isEmpty():
            raise ValueError("unreadable")
        return segment.parse(words, keep)

    registry = [adapters.Adapter("one", "One bank", segment.detect, parse)]
    rules = spark.createDataFrame([(1, "elena vargas", "Familia", 1)], "id long, pattern string, category string, priority int")
    ingest.stream_words(spark, source, WORDS, root, f"{tmp_path}/check", registry, rules)
    rows = {r.statement_id: r for r in ingest.statements(spark, root).collect()}
    assert {i: r.status for i, r in rows.items()} == {1: "CUADRA", 2: "DIFERENCIAS", 7: "error", 8: "error", 9: "duplicado"}
    assert "unreadable" in rows[7].error and rows[8].error == ingest.UNSUPPORTED and rows[9].error.endswith("statement 1")
    assert rows[1].transaction_count == 4 and rows[1].annex_count == 2 and rows[1].pos_count == 1 and rows[1].total_cargo == 410 and rows[1].holder == "ROMERO CARLA"
    issues = ingest.table(spark, root, "issues").collect()
    # the failing statement split the batch: of two that overlap, the one stored later is warned at least
    shared = {(r.statement_id, r.detail) for r in issues if "shares days" in r.detail}
    assert shared and shared <= {(1, "Period shares days with statement 2"), (2, "Period shares days with statement 1")}
    ops = ingest.table(spark, root, "operations").cache()
    found = search.page(search.search(ops, search.Filters(text="elena  várgas")), 1, 10).collect()
    assert [(r.statement_id, r.category, str(r.date_iso)) for r in found] == [(2, "Familia", "2024-01-03"), (1, "Familia", "2024-01-03")]
    daily = {str(r.date_iso): r for r in stats.daily_flow(ops).collect()}
    assert daily["2024-01-21"].abono == 820.0 and daily["2024-01-21"].balance == 1750.0
    groups = stats.duplicate_groups(ops).collect()
    assert len(groups) == 4 and all(g.statements == 2 and [m.statement_id for m in g.members] == [1, 2] for g in groups)
    assert {r.label: r.n for r in stats.grouped(ops, "category").collect()}["Familia"] == 2
    names = ingest.statements(spark, root).select(F.col("statement_id").alias("id"), F.concat(F.lit("s"), F.col("statement_id")).alias("file_name"))
    assert search.export_rows(ops, names).count() == 8
    ops.unpersist()  # a cached frame knows nothing of files that come later
    # read again without the rule, one statement alone
    ingest.reprocess(fx.words(spark, [fx.statement(1), fx.statement(2, 50.0)]), root, 1)
    again = {r.statement_id: r.category for r in ingest.table(spark, root, "operations").filter("seq = 1").collect()}
    assert again == {1: "Transferencias", 2: "Familia"}
