"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size. Within a source the
documents stand in order of size (then a hash of their identifier, then the identifier), the
expected copies are summed along that order from one random offset, and a document is emitted
once for each integer boundary that its sum crosses. In order of size, the words taken differ
from the target by less than the longest document.

The running sum needs each document's rank in its source. No task sees a source whole: ranks come
from counts of (source, size), then of hash ranges within a size, then from the few rows within
one hash range. Sums are kept in whole steps of 2^-24 copies, so reruns agree to the last copy.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a
source without words has target 0; repeated rows count each; a null doc_id hashes as the empty
text and comes last in its range; a text of any length counts its words whole; an empty table
gives an empty result; further columns are ignored by mix() and kept by stage().

Assumption: sources are a list that one task can order (thousands, not one for each document),
since targets depend on one another. Documents have no such bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Work, documents, keyed, word_count

STEP = 1 << 24
#: Hex digits of the hash that part the documents of one size.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """sizes (source, source_size) to each source's target.

    Shares fill like water: in order of limit over weight, a source is held at its limit while the
    level at which it fills lies below the level that the rest would get. One row for each source:
    the ordered windows below run over the list of sources, not over documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weigh).withColumn("top", F.col("source_size") * limit).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    by_level = W.orderBy((F.col("top") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("held_before", F.coalesce(F.sum("top").over(before), F.lit(0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("rest", share * F.col("total") - F.col("held_before"))
    held = F.col("top") * F.col("weight_left") <= F.col("rest") * F.col("weight")
    rows = rows.withColumn("held", held)
    level = F.min(F.when(~F.col("held"), F.struct(F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source"), (F.col("rest") / F.col("weight_left")).alias("level")))).over(W.partitionBy())
    rows = rows.withColumn("level", level["level"])
    return rows.select("source", "source_size", F.when(F.col("held"), F.col("top").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def offset(source, seed: str):
    """A source's random offset in whole steps."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("")))), 1, 6), 16, 10).cast("long")


def joined(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Inner join on columns that may be null; the columns of a and what b adds."""
    b = b.withColumnsRenamed({x: f"_{x}" for x in names})
    return a.join(b, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in names]).drop(*[f"_{x}" for x in names])


def ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, h, key) with each one's rank in its source by size, h, doc_id, key, from 1."""
    source, size = F.col("source"), F.col("size")
    part = F.substring("h", 1, RANGE_DIGITS)
    cells = rows.groupBy("source", "size", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("source", "size", F.coalesce(F.sum("n").over(upto(W.partitionBy("source").orderBy("size"))), F.lit(0)).alias("below"))
    cells = cells.select("source", "size", "part", F.coalesce(F.sum("n").over(upto(W.partitionBy("source", "size").orderBy("part"))), F.lit(0)).alias("within"))
    starts = joined(cells, sizes, "source", "size").select("source", "size", "part", (F.col("below") + F.col("within")).alias("start"))
    rows = rows.withColumn("part", part)
    inner = F.row_number().over(W.partitionBy(source, size, F.col("part")).orderBy("h", F.col("doc_id").asc_nulls_last(), "key"))
    rows = rows.withColumn("inner", inner)
    return joined(rows, starts, "source", "size", "part").select("doc_id", "source", "size", "key", (F.col("start") + F.col("inner")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: str = "mix", key: str | None = None) -> DataFrame:
    """docs (doc_id, text, source) to one row each: doc_id, source, size, source_size, target, copies, and the column key if one is named."""
    spark = docs.sparkSession
    own = F.lit(None).cast("long") if key is None else F.col(key)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), own.alias("key"))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = Work(spark, "mixing").table(rows, "sizes")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    per_source = per_source.withColumn("each", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * STEP)).otherwise(F.lit(0)).cast("long"))
    per_source = per_source.withColumn("offset", offset(F.col("source"), seed))
    crossed = lambda rank: F.expr(f"div(offset + ({rank}) * each, {STEP})")
    named = [] if key is None else [F.col("key").alias(key)]
    return joined(ranked(rows), per_source, "source").select("doc_id", "source", "size", "source_size", "target", *named, (crossed("rank") - crossed("rank - 1")).cast("long").alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, with the columns of docs, whatever their names."""
    rows = keyed(docs, Work(spark, "mixing-keyed"))
    copies = mix(rows, key="key").filter("copies > 0").select("key", "copies")
    out = rows.select("row", "key").join(copies, "key")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sql(docs: str) -> str:
    """DuckDB SQL for mix() over a relation (doc_id, text, source): the same columns."""
    return f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS top, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight,
         sum(source_size) OVER () AS total FROM s),
o AS (
  SELECT *, coalesce(sum(top) OVER before, 0) AS held_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM w WINDOW before AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(1.5 AS DOUBLE) * total - held_before AS rest, top * weight_left <= (CAST(1.5 AS DOUBLE) * total - held_before) * weight AS held FROM o),
g AS (SELECT CAST(first(rest ORDER BY top / weight, source NULLS LAST) AS DOUBLE) / CAST(first(weight_left ORDER BY top / weight, source NULLS LAST) AS DOUBLE) AS level FROM f WHERE NOT held),
t AS (
  SELECT source, source_size, CASE WHEN held THEN CAST(top AS DOUBLE) ELSE level * weight END AS target,
         CAST('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 6) AS BIGINT) AS off FROM f, g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {STEP}) AS BIGINT) ELSE 0 END AS each FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id NULLS LAST) AS rank FROM d)
SELECT r.doc_id, r.source, r.size, e.source_size, e.target,
       (e.off + r.rank * e.each) // {STEP} - (e.off + (r.rank - 1) * e.each) // {STEP} AS copies
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""


ORACLE = f"SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM ({mix_sql('documents')})"
