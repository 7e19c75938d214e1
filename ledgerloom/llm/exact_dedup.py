"""Exact dedup by stateful streaming: keyed state on disk, without expiry, and full bytes compared on hits.

Every document becomes one compact row (digest, stable identifier, length, content locator). A
Structured Streaming aggregation keyed by the digest keeps, in RocksDB state that never expires,
how many rows it has seen and the identifier and locator of the best one. The state is then
joined to the rows. Where a digest was hit more than once, the whole normalised texts behind it
are compared; should they differ (a digest collision), that digest is regrouped by full text.

With a folder for the state, a later call adds its documents to what earlier ones left there and
finds their copies too; `known` are the earlier documents, for the comparison of whole texts, and a call
that finds earlier rows in the folder must be given them. A call's name (`run`) makes it repeatable: one that died is called again by
its name and counts its documents once. A verdict holds for what had come by then: a row that an earlier call kept
loses to a longer one of a later call, whose result says so only for the later call's own rows.

Defined cases: null text is the empty text; all empty texts form one group; a null doc_id loses
every tie; rows that repeat a doc_id count as rows of their own and share its verdict; texts of any
length are compared whole; an empty table gives an empty result; further columns, whatever their
names, are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import SPACES, Work, documents, joined_by_size, listed, packed, text_or_empty

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: str | Column) -> Column:
    """The text without white space."""
    return F.translate(text_or_empty(text), SPACES, "")


def keyed_rows(docs: DataFrame, digest, locator: Column | None = None) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(normalised("text")).alias("digest"),
        F.char_length(text_or_empty("text")).cast("long").alias("points"),
        (F.col("doc_id").cast("string") if locator is None else locator).alias("locator"),
    )


def run_state(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Streams new rows below the folder into the keyed state there; the state as a table: digest, group_size, keep_id, keep_at."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # each partition's store would set aside megabytes for its logs
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("order"), "locator"))
    state = session.readStream.schema(schema).parquet(f"{folder}/rows").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    out = f"{folder}/groups"
    query = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .start()
    )
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # an empty table starts no batch
        return spark.createDataFrame([], "digest binary, group_size long, keep_id long, keep_at string")
    groups = spark.read.schema("digest binary, group_size long, best struct<points: long, order: long, locator: string>, batch long").parquet(out)
    if query.lastProgress is None or query.lastProgress["batchId"] > 0:
        # counts and maxima only grow, so the last row of a key is its largest
        groups = groups.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("best").alias("best"))
    return groups.select("digest", "group_size", F.bitwise_not("best.order").alias("keep_id"), F.col("best.locator").alias("keep_at"))


def exact_dedup(docs: DataFrame, digest=None, locator: Column | None = None, state: str | None = None, known: DataFrame | None = None, run: str | None = None) -> DataFrame:
    """docs (doc_id, text) to one row each: doc_id, keep_id, group_size, kept, text_sha256, keep_at.

    digest maps a normalised text to the key of the state (SHA-256, as bytes). locator says where
    a row's content lies (its doc_id). state is a folder that outlives the call; known (doc_id, text)
    are the documents of earlier calls with that folder. run is the call's name there (a new one by default).
    """
    spark, own = docs.sparkSession, digest is None
    digest = digest or (lambda text: F.unhex(F.sha2(text, 256)))
    work = Work(spark, "exact-dedup")
    folder = state.rstrip("/") if state else work.root
    run = run or uuid.uuid4().hex
    if state and known is None and any(name != f"run={run}" for name in listed(spark, f"{folder}/rows")):
        raise ValueError("the state holds rows of earlier calls: known must be their documents, or their texts can't be compared")
    rows = keyed_rows(docs, digest, locator)
    if "_SUCCESS" not in listed(spark, f"{folder}/rows/run={run}"):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/rows/run={run}")
    groups = run_state(spark, folder, StructType([*rows.schema.fields, StructField("run", StringType())]))
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows/run={run}")
    out = joined_by_size(rows, groups, "digest", "group_size")
    # the hits: members of groups of several rows, with their whole texts
    whole = docs.select("doc_id", "text") if known is None else docs.select("doc_id", "text").unionByName(known.select("doc_id", "text"))
    every = out
    if known is not None:
        every = spark.read.schema(rows.schema).parquet(f"{folder}/rows").join(groups.select("digest", "group_size"), "digest")
        every = every.join(rows.select("digest").distinct(), "digest", "left_semi")
    hits = every.filter("group_size > 1").select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit")).distinct()
    norm = normalised("text")
    texts = whole.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), digest(norm).alias("digest"))
    texts = texts.join(hits, (F.col("digest") == F.col("hit")) & F.col("doc_id").eqNullSafe(F.col("hit_id")))
    differ = texts.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differs")).filter("differs").select("digest")
    differ = work.table(differ, "collisions")
    if differ.isEmpty():
        out = out.select("doc_id", "keep_id", "group_size", "digest", "keep_at")
    else:
        of = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.char_length(text_or_empty("text")).cast("long").alias("points")).withColumn("digest", digest(F.col("norm"))).join(differ, "digest")
        best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("order")))
        apart = of(whole).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        apart = of(docs).select("doc_id", "digest", "norm").join(apart, ["digest", "norm"])
        apart = apart.select("doc_id", F.bitwise_not("best.order").alias("keep_id"), "group_size", "digest", F.bitwise_not("best.order").cast("string").alias("keep_at"))
        out = out.join(differ, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "digest", "keep_at").unionByName(apart)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    if own:
        return out.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"), "keep_at")
    sums = docs.select(F.col("doc_id").cast("long").alias("sum_id"), F.sha2(norm, 256).alias("text_sha256"), digest(norm).alias("sum_digest")).distinct()
    return out.join(sums, F.col("doc_id").eqNullSafe(F.col("sum_id")) & (F.col("digest") == F.col("sum_digest"))).select("doc_id", "keep_id", "group_size", kept, "text_sha256", "keep_at")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row that stays, with the columns of docs, whatever their names.

    A row stays by its identifier and its text, since an identifier may be null or stand for several
    texts; of several rows with the same identifier and text the longest stays, once.
    """
    rows = packed(docs)
    kept = exact_dedup(rows.select("doc_id", "text")).filter("kept").groupBy(F.col("doc_id").alias("kept_id"), "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    kept = Work(spark, "exact-dedup-kept").table(kept, "kept")
    out = rows.withColumn("sum", F.sha2(normalised("text"), 256)).join(kept, (F.col("sum") == F.col("text_sha256")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    single = out.filter("times = 1").select("row")
    if kept.filter("times > 1").isEmpty():
        return single.select("row.*")
    longest = F.max_by("row", F.struct(F.char_length(text_or_empty("text")), text_or_empty("text")))
    repeats = out.filter("times > 1").groupBy("kept_id", "sum").agg(longest.alias("row")).select("row")
    return single.unionByName(repeats).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact_dedup(docs, locator=F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))).drop("keep_at")


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS s,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       s AS text_sha256
FROM d
"""
