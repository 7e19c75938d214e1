"""What the operators of this folder share: the shared work folder, text rules, small helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a temporary one in local mode; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Work:
    """Tables written to the shared folder, so that a lost executor costs no more than a reread.

    A result may read them until it is written itself; then `sweep` removes them.
    """

    made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        Work.made.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: the lineage ends here."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            delete(self.spark, self.path(name))


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def listed(spark: SparkSession, name: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes the work folders made after the first `since` ones: what read them must have been written."""
    for root in Work.made[since:]:
        delete(spark, root)
    del Work.made[since:]


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for the actions inside; put back afterwards."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words between white space; null counts as none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS))).cast("long")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (with column n) from the least count on for which they are `most` at the most.

    The count is found in a histogram by logarithm, of a few thousand steps at any size, so nothing
    is sorted and no task sends its own best rows to the driver.
    """
    step = F.floor(F.log(F.col("n").cast("double")) * 100).cast("int")
    left = most
    least = None
    for s, k in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect():
        left -= k
        if left < 0:
            break
        least = s
    return counts.filter(step >= least) if least is not None else counts.limit(0)


#: A key is hot from one in so many rows on, so fewer keys than that are.
HOT = 1000


def joined_by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """rows joined to groups, which has one row for each key and, in the column size, its number of rows.

    Hot keys are fewer than HOT at any size of the tables: they are broadcast and their rows stay where
    they are. The others meet by a shuffle, in which a key holds at most one in HOT of the rows. Rows
    whose key is null are left out, as are those without a group. total is the sum of the sizes, or
    a number above it, where the caller knows one.
    """
    if total is None:
        total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    is_hot = F.col(size) * HOT > total
    hot = groups.filter(is_hot)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


#: Bits of the filter of maybe_among, a multiple of the 32,768 of one bitmap.
FILTER = 1 << 25


def maybe_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is among keys, and few others: before a join that would otherwise shuffle all rows to keep some.

    The filter is one bit for each hash, 4 MB at any size of keys; beyond some ten million keys it lets
    most rows pass, and the join does the rest.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER)) + 1
    numbered = lambda df, *more: df.select(*more, F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).cast("int").alias("position"))
    bitmaps = numbered(keys).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.expr("shiftleft(1, position % 8)")) != 0
    named = numbered(rows, F.struct("*").alias("row"))
    return named.join(F.broadcast(bitmaps), "bucket").filter(set_).select("row.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column, row, so that no name of theirs meets one of ours; beside it doc_id, text and source."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))


def keyed(docs: DataFrame, work: Work) -> DataFrame:
    """packed(docs) with a key for each row, in the order of doc_id (null last).

    The key is doc_id where that names single rows. Otherwise the rows are put in order of doc_id and
    text, numbered, and written once, so that the key is the same whenever it is read.
    """
    rows = packed(docs)
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if several.isEmpty():
        return rows.withColumn("key", F.col("doc_id"))
    rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.sha2(text_or_empty("text"), 256))
    return work.table(rows.withColumn("key", F.monotonically_increasing_id()), "keyed")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application: their Python need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / f"ledgerloom-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
