"""Ingest of statements as a file stream: hash, dedupe, adapter, parse, reconcile, store; queue views beside it.

One streaming query with one checkpoint is the only writer of a store (sources/store.py). A batch first commits its
statements as being processed, then writes their rows as one load and commits that: the load's rows show at once and
hide those of earlier loads. So a repeated batch, a retry or a reprocess leaves each statement's rows
once, annex and issues too, and a batch that dies halfway shows nothing but statements being processed.

Errors are of two kinds. What a statement's own data cause is its own: words that can't be read are found row
by row before anything is parsed and go to the table `quarantine`, their statement gets status error and the others go on; the
same holds for a format that no adapter reads, and for what an adapter says of a statement (adapters.BadStatement). An exception that Spark
or Python types as one of data (SQLSTATE class 22, ValueError, LookupError, ArithmeticError) and that nobody foresaw is
narrowed down by halves. Every other exception (a full disk, a lost cluster, a fault in code) ends the batch: it
reaches the caller, the checkpoint stays where it was, nothing is logged as bad, and the next run reads the batch again.
`retry` reads statements again that failed, or whose processing was begun long ago, from the files that they came from.
"""

from __future__ import annotations

import json
import time
from datetime import date, datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import period_month, resolve_date
from ..functions.text import is_amount, normalize_key, parse_amount
from ..operators import adapters, categories, dashboard, reconcile, search, segment, stats
from ..sources import store
from ..sources.store import Load, delete, exists
from .progress import with_eta

PENDING, FAILED, REPEATED = "procesando", "error", "duplicado"
#: Not a status: such a statement keeps the rows that it has.
TORN = "torn"
UNSUPPORTED = "no adapter supports this format"
#: Statement ids are below 2^43; a row's id is its statement's and its number.
ROW_BITS = 20
STALE_MINUTES = 30
#: Files whose failed statements are read again in one batch.
RETRY_FILES = 1000


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a path in order of name, each once, with the SHA-256 of their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.sha2("content", 256).alias("file_hash"), "content").dropDuplicates(["path"]).orderBy("file_name")


def fresh(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content no statement has yet: the first by name of equal ones."""
    first = incoming.groupBy("file_hash").agg(F.min("path").alias("path"))
    return incoming.join(first, ["file_hash", "path"], "left_semi").join(known.select("file_hash"), "file_hash", "left_anti")


def is_stale(now: Column, minutes: int = STALE_MINUTES) -> Column:
    return (F.col("status") == PENDING) & (F.coalesce("started_at", "uploaded_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def retryable(statements: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Statements that failed, or have been processing for too long."""
    return statements.filter((F.col("status") == FAILED) | is_stale(now, minutes))


def queue_positions(statements: DataFrame) -> DataFrame:
    """statements with position: the rank of those that wait by time of upload and id, null for the others.

    Ranks come from counts by hour and ranks within an hour, so no task orders the whole queue.
    """
    waiting = statements.filter((F.col("status") == PENDING) & F.col("started_at").isNull()).select("id", "uploaded_at", F.date_trunc("hour", "uploaded_at").alias("hour"))
    hours = waiting.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    before = hours.select("hour", F.coalesce(F.sum("n").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = waiting.withColumn("rank", F.row_number().over(W.partitionBy("hour").orderBy("uploaded_at", "id"))).join(before, "hour")
    return statements.join(ranked.select("id", (F.col("before") + F.col("rank")).cast("int").alias("position")), "id", "left")


def log(spark: SparkSession, root: str) -> DataFrame:
    """The statements of every load that counts, hidden ones too."""
    snapshot = store.current(spark, root)
    return store._scan(spark, root, "statements", sorted(k for k, e in snapshot.loads.items() if "statements" in e.tables))


def statements(spark: SparkSession, root: str) -> DataFrame:
    """The current row of each statement that is not deleted."""
    return store.scan(spark, root, "statements")


def table(spark: SparkSession, root: str, name: str, first: date | None = None, last: date | None = None, statement_id: int | None = None) -> DataFrame:
    """The current rows of a table, with all its columns also where nothing was stored yet.

    With first or last, operations of those days' months alone are read (rows of other days in them stay: filter them); with a
    statement, its load alone.
    """
    return store.scan(spark, root, name, first, last, statement_id).drop("load", *(["month"] if name == "operations" else []))


def operations(spark: SparkSession, root: str, rules: DataFrame | None = None, first: date | None = None, last: date | None = None, statement_id: int | None = None) -> DataFrame:
    """The current operations from first to last, of one statement, or all; with rules, their categories are derived anew, so that a rule made or removed counts for all of them."""
    rows = table(spark, root, "operations", first, last, statement_id)
    for bound, keep in ((first, F.col("date_iso") >= F.lit(first)), (last, F.col("date_iso") <= F.lit(last))):
        rows = rows.filter(keep) if bound else rows
    return rows if rules is None else categories.categorize(rows, rules)


def find(spark: SparkSession, root: str, filters: search.Filters, rules: DataFrame | None = None) -> DataFrame:
    """search.search over the stored operations, reading what may match alone.

    A text is looked up in the letters' index first: only the months and loads of its candidates are read, and of those rows only the
    candidates are tested. Days and statements narrow the files likewise.
    """
    rows = store.scan(spark, root, "operations", filters.date_from, filters.date_to, filters.statement_id)
    hits = search.candidates(store.scan(spark, root, "grams"), filters.text) if filters.text else None
    if hits is not None:
        places = [tuple(r) for r in hits.select("load", "month").distinct().collect()]  # folders, not rows
        rows = rows.filter(F.col("load").isin(sorted({p[0] for p in places})) & F.col("month").isin(sorted({p[1] for p in places})))
        rows = rows.join(hits.select("id", "load"), ["id", "load"], "left_semi")
    rows = rows.drop("load", "month")
    return search.search(rows if rules is None else categories.categorize(rows, rules), filters)


def partials(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """days and labels of all that counts: stored sums of loads without hidden statements; for the others the sums of what still shows."""
    snapshot = store.current(spark, root)
    dirty = store.dirty_loads(snapshot, "operations")
    rows = store.scan(spark, root, "operations", snapshot=snapshot)
    rows = rows.filter(F.col("load").isin(dirty))
    out = []
    for name, make in (("days", dashboard.days), ("labels", dashboard.labels)):
        stored = store._scan(spark, root, name, store.clean_loads(snapshot, name)).drop("load")
        out.append(stored.unionByName(make(rows)) if dirty else stored)
    return out[0], out[1]


def summary(spark: SparkSession, root: str, adjustments: DataFrame | None = None, statement_id: int | None = None) -> dict[str, DataFrame]:
    """The dashboard of the store: from partial sums, or from the operations of one statement. The monthly series comes from the statements' own sums."""
    read = statements(spark, root).filter("transaction_count > 0")
    months = stats.monthly_of(read.select("statement_id", F.col("total_cargo").alias("cargo"), F.col("total_abono").alias("abono"), F.col("total_igtf").alias("igtf"), F.col("transaction_count").alias("n"), "first_day"))
    if statement_id:
        out = stats.summary(operations(spark, root, statement_id=statement_id), adjustments, statement_id)
        return out | {"monthly": months}
    days, labels = partials(spark, root)
    return dashboard.summary(days, labels, months, adjustments)


def note(spark: SparkSession, load: int, stage: str, percent: int, root: str) -> None:
    """One line of progress for all statements of a load."""
    said = {"load": load, "stage": stage, "percent": percent, "noted_at": datetime.now().isoformat(timespec="microseconds")}
    store.write_text(spark, f"{root}/progress/notes/{load}-{percent}.json", json.dumps(said))


def progress(spark: SparkSession, root: str) -> DataFrame:
    """How far the last load of each statement has come: statement_id, load, stage, percent, elapsed (seconds since its first note) and eta."""
    if not exists(spark, f"{root}/progress/notes"):
        return with_eta(spark.createDataFrame([], "statement_id long, load long, stage string, percent int, elapsed double, progress_percent int")).drop("progress_percent", "load")
    notes = spark.read.schema("load long, stage string, percent int, noted_at timestamp_ntz").json(f"{root}/progress/notes")
    members = spark.read.schema("statement_id long, load long").option("basePath", f"{root}/progress/members").parquet(f"{root}/progress/members")
    rows = members.join(notes, "load")
    loads = rows.groupBy("statement_id", "load").agg(F.max_by(F.struct("stage", "percent", "noted_at"), "percent").alias("now"), F.min("noted_at").alias("began"))
    last = loads.groupBy("statement_id").agg(F.max_by(F.struct("load", "now", "began"), "load").alias("r"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    out = last.select("statement_id", "r.load", "r.now.stage", F.col("r.now.percent").alias("percent"), (seconds("r.now.noted_at") - seconds("r.began")).alias("elapsed"))
    return with_eta(out.withColumn("progress_percent", F.col("percent"))).drop("progress_percent")


def content_hashes(words: DataFrame) -> DataFrame:
    """statement_id, file_hash, pages, source_path: SHA-256 over a statement's words in a fixed order. A group is one printed document."""
    source = F.min("source_path") if "source_path" in words.columns else F.lit(None).cast("string")
    word = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page", "x0", "y0", "x1", "y1", "text")])
    return words.groupBy("statement_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(word)), "\n"), 256).alias("file_hash"), F.countDistinct("page").alias("pages"), source.alias("source_path"))


def stored_operations(operations: DataFrame, covers: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Operations with all that search and statistics need: id, date_iso, search_key, category."""
    year, month = period_month(F.col("period_start"), F.col("period_end"))
    periods = covers.select("statement_id", year.alias("year"), month.alias("month"))
    rows = operations.join(periods, "statement_id", "left").withColumn("date_iso", resolve_date(F.col("date"), F.col("year"), F.col("month"))).drop("year", "month")
    rows = rows.withColumns({"id": F.shiftleft("statement_id", ROW_BITS) + F.col("seq"), "search_key": normalize_key(F.col("description"))})
    rules = rows.sparkSession.createDataFrame([], schemas.RULES) if rules is None else rules
    return categories.categorize(rows, rules)


def overlap_issues(covers: DataFrame, known: DataFrame) -> DataFrame:
    """A warning for each statement at hand whose period shares days with another one's of its account: of those at hand, or of those known."""
    columns = [F.col("statement_id").alias("id"), "account_number", "period_start", "period_end"]
    others = known.join(covers.select("statement_id"), "statement_id", "left_anti").select(*columns)
    found = reconcile.overlaps_with(covers.select(*columns), others.unionByName(covers.select(*columns)))
    detail = F.concat(F.lit("Period shares days with statement "), F.col("other_id"))
    return found.select("statement_id", F.lit("advertencia").alias("kind"), detail.alias("detail"), F.lit(None).cast("decimal(18,2)").alias("expected"), F.lit(None).cast("decimal(18,2)").alias("parsed"))


def no_such_day(operations: DataFrame) -> DataFrame:
    detail = F.concat(F.lit("Row "), F.col("seq"), F.lit(": no such day: "), F.col("date"))
    return operations.filter("date_iso is null").select("statement_id", F.lit("fecha_invalida").alias("kind"), detail.alias("detail"), F.lit(None).cast("decimal(18,2)").alias("expected"), F.lit(None).cast("decimal(18,2)").alias("parsed"))


def write_parsed(spark: SparkSession, adapter: adapters.Adapter, words: DataFrame, facts: DataFrame, root: str, rules: DataFrame | None) -> None:
    """Parses statements and writes their rows as one load; they count when it is committed, last."""
    load = Load(spark, root)
    stage = f"{root}/stage/{load.id}"

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    try:
        facts.select("statement_id").write.parquet(f"{root}/progress/members/load={load.id}")
        note(spark, load.id, "leyendo", 5, root)
        parsed = adapter.parse(keep("words", words), keep)
        covers = load.put("covers", parsed.covers)
        operations = load.put("operations", stored_operations(parsed.operations, covers, rules))
        note(spark, load.id, "guardando", 60, root)
        for name, rows in (("days", dashboard.days(operations)), ("labels", dashboard.labels(operations)), ("grams", search.grams(operations))):
            load.put(name, rows)
        checkpoints, annex, pos = load.put("checkpoints", parsed.checkpoints), load.put("annex", parsed.annex), load.put("pos", parsed.pos)
        load.put("sections", parsed.sections)
        found = keep("findings", reconcile.issues(covers, operations, checkpoints, annex, pos, parsed.fidelity))
        note(spark, load.id, "conciliando", 85, root)
        status = reconcile.statuses(covers, found)
        load.put("issues", found.unionByName(no_such_day(operations)).unionByName(overlap_issues(covers, statements(spark, root))))
        count = lambda df, name: df.groupBy("statement_id").agg(F.count(F.lit(1)).alias(name))
        rows = covers.join(facts, "statement_id").join(status, "statement_id", "left").join(reconcile.totals(operations).withColumnRenamed("n", "transaction_count"), "statement_id", "left")
        rows = rows.join(count(annex, "annex_count"), "statement_id", "left").join(count(pos, "pos_count"), "statement_id", "left").fillna(0, ["transaction_count", "annex_count", "pos_count"])
        rows = rows.join(operations.groupBy("statement_id").agg(F.min("date_iso").alias("first_day")), "statement_id", "left")
        load.put("statements", rows.withColumns({"bank": F.lit(adapter.display_name), "progress_stage": F.lit("listo"), "progress_percent": F.lit(100), "finished_at": now()}))
    finally:
        delete(spark, stage)
    load.commit()
    note(spark, load.id, "listo", 100, root)


def now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def log_rows(rows: DataFrame, root: str, quarantine: DataFrame | None = None) -> None:
    """A load of statements alone, without rows of other tables: those being processed, refused or failed; and why, in quarantine."""
    load = Load(rows.sparkSession, root)
    if quarantine is not None:
        load.put("quarantine", quarantine)
    load.put("statements", rows)
    load.commit()


def reason_of(problem: Exception) -> str:
    """An error's first line and its innermost cause, short enough for a column."""
    lines = str(problem).splitlines() or [type(problem).__name__]
    causes, cause = [], getattr(problem, "_origin", None)
    while cause is not None:
        causes.append(str(cause.getMessage()))
        cause = cause.getCause()
    return "; ".join(dict.fromkeys(x.splitlines()[0][:250] for x in [lines[0], *causes[-1:]] if x))


def is_data_error(problem: Exception) -> bool:
    """Whether an exception is one of a statement's data: by its type in Python, by its SQLSTATE (class 22) in Spark, at any depth."""
    if isinstance(problem, adapters.BadStatement):
        return True
    if not isinstance(problem, PySparkException):
        return isinstance(problem, (ValueError, LookupError, ArithmeticError))
    if "BadStatement" in str(problem) or (problem.getSqlState() or "").startswith("22"):
        return True
    cause = getattr(problem, "_origin", None)
    while cause is not None:
        try:
            state = cause.getSqlState()
        except Exception:  # not every throwable has one
            state = None
        if state and state.startswith("22"):
            return True
        cause = cause.getCause()
    return False


def failed(facts: DataFrame, bank: str, error: Column) -> DataFrame:
    return facts.withColumns({"bank": F.lit(bank), "status": F.lit(FAILED), "error": error, "finished_at": now()})


def attempt(spark: SparkSession, adapter: adapters.Adapter, words: DataFrame, facts: DataFrame, root: str, rules: DataFrame | None, depth: int = 0) -> None:
    """write_parsed. Statements that their adapter names as bad fail, and the others are read without them; an unforeseen error of data is narrowed down by halves; any other exception is the caller's."""
    try:
        write_parsed(spark, adapter, words, facts, root, rules)
        return
    except Exception as problem:
        if not is_data_error(problem):
            raise
        named, said = getattr(problem, "statement_ids", None), reason_of(problem)
    if named:
        mine = F.col("statement_id").isin(list(named))
        log_rows(failed(facts.filter(mine), adapter.display_name, F.lit(said)), root)
        words, facts = words.filter(~mine), facts.filter(~mine)
        if not facts.isEmpty():
            attempt(spark, adapter, words, facts, root, rules, depth)
        return
    if len(facts.select("statement_id").limit(2).collect()) < 2:
        log_rows(failed(facts, adapter.display_name, F.lit(said)), root)
        return
    for half in (0, 1):
        mine = F.pmod(F.shiftright(F.xxhash64("statement_id"), depth), F.lit(2)) == half
        part = facts.filter(mine)
        if not part.isEmpty():
            attempt(spark, adapter, words.filter(mine), part, root, rules, depth + 1)


def screened(words: DataFrame) -> DataFrame:
    """Words that can't be read: statement_id, page, text, reason, source_path."""
    numbers = ["page_width", "x0", "y0", "x1", "y1"]
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("page", *numbers, "text")])
    wild = F.concat_ws(", ", *[F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(c)) for c in numbers])
    reason = F.when(missing != "", F.concat(F.lit("no "), missing)).when(wild != "", F.concat(F.lit("no number: "), wild)).when(is_amount(F.col("text")) & parse_amount(F.col("text")).isNull(), F.lit("amount out of range"))
    return words.select("statement_id", "page", "text", reason.alias("reason"), "source_path").filter("reason is not null")


def ingest_batch(words: DataFrame, root: str, registry: list[adapters.Adapter] | None = None, rules: DataFrame | None = None) -> None:
    """A batch of whole statements: content that another statement has is refused, formats that nothing reads and words that can't be read too, the rest is parsed and stored."""
    spark = words.sparkSession
    registry = adapters.REGISTRY if registry is None else registry
    words = (words if "source_path" in words.columns else words.withColumn("source_path", F.lit(None).cast("string"))).persist()
    held = [words]
    try:
        bad = screened(words).filter("statement_id is not null").persist()
        held.append(bad)
        spoiled = bad.groupBy("statement_id").agg(F.count(F.lit(1)).alias("bad_words"), F.min("reason").alias("bad_reason"))
        facts = content_hashes(words).filter("statement_id is not null").join(adapters.assigned(words, registry), "statement_id").join(spoiled, "statement_id", "left").persist()
        held.append(facts)
        before = statements(spark, root)
        known = before.filter(~F.col("status").isin(FAILED, REPEATED) & ~is_stale(now()))
        taken = known.select("file_hash", F.col("statement_id").alias("holder_id"))
        stored = known.filter(F.col("status") != PENDING).select("statement_id", F.col("file_hash").alias("old_hash"), F.col("source_path").alias("old_path"))
        first = facts.groupBy("file_hash").agg(F.min("statement_id").alias("first_id"))
        judged = facts.join(first, "file_hash").join(taken.groupBy("file_hash").agg(F.min("holder_id").alias("holder_id")), "file_hash", "left").join(stored, "statement_id", "left")
        # the same statement with other words in another file: one of the two is a part of it
        torn = F.coalesce((F.col("old_hash") != F.col("file_hash")) & (F.col("old_path") != F.col("source_path")), F.lit(False))
        repeated = F.coalesce(F.col("holder_id") != F.col("statement_id"), F.lit(False)) | (F.col("first_id") != F.col("statement_id"))
        status = F.when(torn, TORN).when(F.col("bad_words") > 0, FAILED).when(repeated, REPEATED).when(F.col("adapter").isNull(), FAILED)
        error = F.when(F.col("bad_words") > 0, F.concat("bad_words", F.lit(" words can't be read: "), "bad_reason"))
        error = error.when(repeated, F.concat(F.lit("same content as statement "), F.coalesce("holder_id", "first_id"))).otherwise(F.lit(UNSUPPORTED))
        judged = judged.select("statement_id", "file_hash", "pages", "source_path", "adapter", status.alias("status"), F.when(status.isNotNull(), error).alias("error")).persist()
        held.append(judged)
        rows = judged.filter(F.coalesce("status", F.lit("")) != TORN).select("statement_id", "file_hash", "pages", "source_path", F.coalesce("status", F.lit(PENDING)).alias("status"), "error")
        rows = rows.withColumns({"uploaded_at": now(), "started_at": F.when(F.col("status") == PENDING, now()), "finished_at": F.when(F.col("status") != PENDING, now())})
        parts = judged.filter(F.col("status") == TORN).select("statement_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), F.lit("words of the statement lie in several files").alias("reason"), "source_path")
        log_rows(rows, root, bad.unionByName(parts))
        for adapter in registry:
            mine = judged.filter(F.col("status").isNull() & (F.col("adapter") == adapter.name)).select("statement_id", "file_hash", "pages", "source_path").withColumns({"uploaded_at": now(), "started_at": now()})
            if not mine.isEmpty():
                attempt(spark, adapter, words.drop("source_path").join(mine.select("statement_id"), "statement_id", "left_semi"), mine, root, rules)
    finally:
        for df in reversed(held):
            df.unpersist()


def stream_words(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, registry: list[adapters.Adapter] | None = None, rules: DataFrame | None = None):
    """Runs all word files that have arrived since the last run; returns the ended query. An exception that isn't one of data is raised, and the checkpoint stays.

    A batch holds whole files; a statement's words must lie in one file: a part that comes in another file later is refused and noted in quarantine. With a new checkpoint all files are read again.
    """
    words = spark.readStream.schema(schema).parquet(source).withColumn("source_path", F.col("_metadata.file_path"))
    return run_stream(words, root, checkpoint, registry, rules)


def run_stream(words: DataFrame, root: str, checkpoint: str, registry: list[adapters.Adapter] | None = None, rules: DataFrame | None = None):
    """The same for any streaming frame of words, such as one of a page source (sources/pages.py)."""
    query = words.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ingest_batch(batch, root, registry, rules)).start()
    query.awaitTermination()
    return query


def retry(spark: SparkSession, root: str, schema: str = schemas.WORDS, registry: list[adapters.Adapter] | None = None, rules: DataFrame | None = None, minutes: int = STALE_MINUTES, read=None) -> DataFrame:
    """Reads statements again that failed, or whose processing began more than `minutes` ago, from the files that they came from.

    read makes words of a list of paths (Parquet by default). Returns what is left: statements that failed again or name no file.
    """
    read = read or (lambda paths: spark.read.schema(schema).parquet(*paths).withColumn("source_path", F.col("_metadata.file_path")))
    due = retryable(statements(spark, root), now(), minutes).select("statement_id", "source_path")
    paths, batch = [r.source_path for r in due.filter("source_path is not null").select("source_path").distinct().orderBy("source_path").toLocalIterator()], []
    for i, path in enumerate(paths):
        batch.append(path)
        if len(batch) == RETRY_FILES or i == len(paths) - 1:
            ids = retryable(statements(spark, root), now(), minutes).filter(F.col("source_path").isin(batch)).select("statement_id")
            ingest_batch(read(batch).join(ids, "statement_id", "left_semi"), root, registry, rules)
            batch = []
    return retryable(statements(spark, root), now(), minutes)


def recover(spark: SparkSession, root: str, **more) -> DataFrame:
    """After a crash, with no other writer at work: every statement that was being processed is read again, however short ago it was begun."""
    return retry(spark, root, minutes=0, **more)


def reprocess(words: DataFrame, root: str, statement_id: int | None = None, registry: list[adapters.Adapter] | None = None, rules: DataFrame | None = None) -> None:
    """Reads one statement again, or all; each one's rows are there once afterwards."""
    ingest_batch(words if statement_id is None else words.filter(F.col("statement_id") == statement_id), root, registry, rules)


def delete_statement(spark: SparkSession, root: str, statement_id: int) -> None:
    """Hides a statement and all its rows; compact() leaves them out and vacuum() removes them."""
    Load(spark, root).commit(spark.createDataFrame([(statement_id,)], "statement_id long"))


def compact(spark: SparkSession, root: str, target: str | None = None) -> None:
    """Writes what is current as one load, here or in another folder."""
    store.compact(spark, root, target)
