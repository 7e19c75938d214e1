"""The store and ingest when things go wrong: full disks, bad words, torn statements, crashes; pruning, compaction, partial sums, the text index."""

from datetime import date

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import adapters, dashboard, search, segment, stats
from ledgerloom.schemas import WORDS
from ledgerloom.sources import fixtures as fx
from ledgerloom.sources import store
from ledgerloom.streaming import ingest


def registry(parse):
    return [adapters.Adapter("one", "One bank", segment.detect, parse)]


def put(spark, path, *printed):
    fx.words(spark, list(printed)).coalesce(1).write.mode("append").parquet(path)


def statuses(spark, root):
    return {r.statement_id: r.status for r in ingest.statements(spark, root).collect()}


def frames_equal(one, two):
    key = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(one.columns) == sorted(two.columns) and key(one) == key(two)


def test_a_full_disk_loses_nothing(spark, tmp_path):
    """The disk fails once: the run ends with the exception and the checkpoint stays; the next run stores every statement. A bad statement is named and costs no second parse of halves."""
    source, root, calls = f"{tmp_path}/words", f"{tmp_path}/tables", []
    put(spark, source, fx.statement(1), fx.statement(2, 50.0), fx.statement(3, month=3))

    def parse(words, keep=None):
        calls.append(sorted(r[0] for r in words.select("statement_id").distinct().collect()))
        if len(calls) == 1:
            raise OSError("No space left on device")
        if 3 in calls[-1]:
            raise adapters.BadStatement("no such layout", (3,))
        return segment.parse(words, keep)

    with pytest.raises(StreamingQueryException, match="No space left"):
        ingest.stream_words(spark, source, WORDS, root, f"{tmp_path}/check", registry(parse))
    assert statuses(spark, root) == {1: "procesando", 2: "procesando", 3: "procesando"} and calls == [[1, 2, 3]]
    ingest.stream_words(spark, source, WORDS, root, f"{tmp_path}/check", registry(parse))
    assert statuses(spark, root) == {1: "CUADRA", 2: "DIFERENCIAS", 3: "error"} and calls[1:] == [[1, 2, 3], [1, 2]]
    assert ingest.table(spark, root, "operations").count() == 8
    # a later adapter reads the failed statement, by itself, from the file that it came from
    before = {r.statement_id: r.load for r in ingest.statements(spark, root).collect()}
    left = ingest.retry(spark, root, registry=registry(lambda words, keep=None: calls.append([r[0] for r in words.select("statement_id").distinct().collect()]) or segment.parse(words, keep)))
    assert left.count() == 0 and calls[-1] == [3] and statuses(spark, root)[3] == "CUADRA"
    after = {r.statement_id: r.load for r in ingest.statements(spark, root).collect()}
    assert after[1] == before[1] and after[3] > before[3] and ingest.table(spark, root, "operations").count() == 12
    # a writer that died while it worked: recovery reads what it had begun
    row = ingest.statements(spark, root).filter("statement_id = 2").withColumns({"status": F.lit("procesando"), "started_at": ingest.now()})
    ingest.log_rows(row, root)
    assert ingest.table(spark, root, "operations").count() == 8 and ingest.retry(spark, root).count() == 0 and statuses(spark, root)[2] == "procesando"
    assert ingest.recover(spark, root).count() == 0 and statuses(spark, root)[2] == "DIFERENCIAS" and ingest.table(spark, root, "operations").count() == 12


@pytest.mark.parametrize(("problem", "is_data"), [(ValueError("x"), True), (KeyError("x"), True), (ZeroDivisionError(), True), (OSError("disk"), False), (RuntimeError("bug"), False), (adapters.BadStatement("x"), True)])
def test_python_errors_are_told_apart(problem, is_data):
    assert ingest.is_data_error(problem) == is_data


def test_spark_errors_are_told_apart(spark, tmp_path):
    for query, is_data in (("select cast(concat('a', id) as int) as x from range(1)", True), ("select id / (id - id) as x from range(1, 2)", True), ("select raise_error('boom') as x from range(1)", False)):
        with pytest.raises(Exception) as found:  # noqa: PT011
            spark.sql(query).write.mode("overwrite").parquet(f"{tmp_path}/x")
        assert ingest.is_data_error(found.value) == is_data, query
    with pytest.raises(Exception) as found:  # noqa: PT011
        spark.read.parquet(f"{tmp_path}/nowhere").collect()
    assert not ingest.is_data_error(found.value)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three months in two loads, one with words that can't be read, and a part of a statement in another file."""
    top = tmp_path_factory.mktemp("store")
    source, root, calls = f"{top}/words", f"{top}/tables", []
    wild = [(5, *w[1:]) for w in fx.statement(5, month=5)]
    wild[3] = (*wild[3][:3], float("nan"), *wild[3][4:])
    wild[8] = (*wild[8][:7], "999.999.999.999.999.999,00")
    put(spark, source, fx.statement(1), fx.statement(2, 50.0), wild)
    parse = lambda words, keep=None: calls.append(1) or segment.parse(words, keep)
    ingest.stream_words(spark, source, WORDS, root, f"{top}/check", registry(parse))
    torn = [w for w in fx.statement(1) if w[1] < 2]
    put(spark, source, fx.statement(3, month=3), fx.statement(4, month=4), torn)
    ingest.stream_words(spark, source, WORDS, root, f"{top}/check", registry(parse))
    return root, calls


def test_words_that_cannot_be_read(spark, stored):
    root, calls = stored
    assert statuses(spark, root) == {1: "CUADRA", 2: "DIFERENCIAS", 3: "CUADRA", 4: "CUADRA", 5: "error"} and len(calls) == 2
    found = ingest.table(spark, root, "quarantine").collect()
    assert sorted((r.statement_id, r.reason) for r in found) == [(1, "words of the statement lie in several files"), (5, "amount out of range"), (5, "no number: x0")]
    assert all(r.source_path for r in found)
    assert "2 words can't be read" in ingest.statements(spark, root).filter("statement_id = 5").first().error
    assert ingest.table(spark, root, "operations", statement_id=1).count() == 4


def test_a_month_reads_its_own_files(spark, stored):
    root, _ = stored
    whole = ingest.operations(spark, root)
    march = ingest.operations(spark, root, first=date(2024, 3, 1), last=date(2024, 3, 31))
    flow = stats.daily_flow(march)
    assert flow.count() == 4 and march.inputFiles() and all("month=202403" in f for f in march.inputFiles()) and len(whole.inputFiles()) > len(march.inputFiles())
    assert len({f.split("load=")[1].split("/")[0] for f in march.inputFiles()}) == 1  # the other load has no such month
    one = ingest.table(spark, root, "annex", statement_id=4)
    assert one.count() == 2 and len({f.split("load=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    frames_equal(flow, stats.daily_flow(whole.filter("month(date_iso) = 3")))


def test_an_empty_store_has_all_columns(spark, tmp_path):
    root = f"{tmp_path}/nowhere"
    for name, schema in schemas.TABLES.items():
        assert ingest.table(spark, root, name).columns == spark.createDataFrame([], schema).columns
    assert stats.daily_flow(ingest.operations(spark, root)).count() == 0 and ingest.summary(spark, root)["totals"].first().n == 0
    assert ingest.find(spark, root, search.Filters(text="vargas")).count() == 0 and ingest.statements(spark, root).count() == 0


def test_find_reads_candidates_alone(spark, stored):
    root, _ = stored
    whole = ingest.operations(spark, root)
    for filters in (search.Filters(text="Elena  Várgas"), search.Filters(text="4"), search.Filters(text="nothing of the kind"), search.Filters(text="recibida desde", date_from=date(2024, 3, 1)), search.Filters(direction="abono"), search.Filters(text="%"), search.Filters(text="vargas", statement_id=3), search.Filters(amount_min=409.999, amount_max=410.001)):
        frames_equal(ingest.find(spark, root, filters), search.search(whole, filters))
    none = search.candidates(store.scan(spark, root, "grams"), "zzzzqx")
    assert none.count() == 0
    hits = search.candidates(store.scan(spark, root, "grams"), "elena vargas")
    assert {r.id for r in hits.collect()} == {r.id for r in whole.filter("search_key like '%elenavargas%'").collect()}
    assert search.candidates(store.scan(spark, root, "grams"), " -- ") is None


def test_summary_from_partial_sums(spark, stored):
    root, _ = stored
    days, labels = ingest.partials(spark, root)
    assert "days" in days.inputFiles()[0] and not any("operations" in f for f in days.inputFiles())
    want = stats.summary(ingest.operations(spark, root))
    got = ingest.summary(spark, root)
    for name in want:
        frames_equal(got[name], want[name])
    one, two = dashboard.summary(*ingest.partials(spark, root)), stats.summary(ingest.operations(spark, root, statement_id=2), statement_id=2)
    assert set(two) - set(one) == {"monthly"} and two["totals"].first().n == 4


def test_deleted_and_compacted(spark, stored, tmp_path):
    """A statement that goes leaves no trace in rows, sums or finds; compaction keeps what counts, in the same folder; vacuum removes the rest."""
    root, _ = stored
    ingest.delete_statement(spark, root, 2)
    rest = ingest.operations(spark, root)
    assert {r.statement_id for r in rest.select("statement_id").distinct().collect()} == {1, 3, 4}
    want = {k: v.collect() for k, v in stats.summary(rest).items()}
    after = ingest.summary(spark, root)
    assert {k: sorted(after[k].collect(), key=repr) for k in want} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert {r.statement_id for r in ingest.find(spark, root, search.Filters(text="vargas")).collect()} == {1, 3, 4}
    n = {name: ingest.table(spark, root, name).count() for name in store.KEYED}
    ingest.compact(spark, root)
    snapshot = store.current(spark, root)
    assert len(snapshot.loads) == 1 and not snapshot.hidden and {name: ingest.table(spark, root, name).count() for name in store.KEYED} == n
    assert store.vacuum(spark, root, minutes=0) > 0 and len(store.names(spark, f"{root}/operations")) == 1
    after = ingest.summary(spark, root)
    assert {k: sorted(after[k].collect(), key=repr) for k in want} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert ingest.progress(spark, root).filter("statement_id = 3").first().stage == "listo"
    with pytest.raises(store.Conflict):
        store.publish(spark, root, store.Snapshot(snapshot.version, {}, []))
    assert store.current(spark, root) == snapshot
