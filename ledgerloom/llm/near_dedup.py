"""MinHash near-dedup with min-max signatures.

1. Each text's set of word shingles gets a signature: for every permutation both the smallest and
   the largest value are kept, so n values need n/2 evaluations. Runs of values form bands.
2. Texts with equal sets form one class; only its smallest doc_id goes on.
3. Classes that share a band meet in a bucket. Each is compared with the smallest of its bucket
   over the full sets, recomputed from the whole texts. The links found join into components.
4. Where a smallest text still has members of several components around it, each member is
   written as its difference from that text (what it lacks and what it adds). The difference
   gives the exact overlap of any two members: |C| - |lacks x| - |lacks y| + |both lack| +
   |both add|. A link between members of different components needs a known number of shingles
   common to their differences. So members meet by the rarest shingles of their differences, in a
   join with prefix, position and size bounds, and candidates are confirmed. Components are formed
   again. So every pair of a bucket is compared, ruled out by a bound, or connected already.

A link at the threshold itself shares no band with a probability under `MISS`; above it, less.
Equality of sets and of shingles is that of 128-bit digests and 64-bit hashes.

Defined cases: null and blank texts have no shingles and are linked with nothing; texts shorter
than a shingle are linked if equal word for word; rows that repeat a doc_id are one node, linked
if any of them is; rows with a null doc_id are nodes of their own, linked as any other, with a null
doc_id in the result and a null component where no member has one, of which one row is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import HOT, Work, documents, joined_by_size, keyed, maybe_among, settings, ship
from .shingles import mixed, portions, shingle_sets

MISS = 1e-7
MOST_BANDS = 32
#: Members that share a shingle and meet in one group at the most; more are dealt over blocks.
BLOCK = 1000
#: Pairs around one text in a block at the least.
PAIRS = 200
#: Rows in a batch sent to Python where a row carries sets.
BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": "200"}
TEXT_BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2000"}


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Values in a band, as many as leave MOST_BANDS bands enough, and bands."""
    need = lambda r: math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** r)))
    rows = max((r for r in range(1, 11) if need(r) <= MOST_BANDS), default=1)
    return rows, need(rows)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(7919)
    draw = lambda: r.randint(0, 2**62, n).astype(np.uint64) * np.uint64(4) + r.randint(0, 4, n).astype(np.uint64)
    return draw() | np.uint64(1), draw()


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest values under all permutations, then the largest ones."""
    low = high = None
    for at in range(0, len(hashes), 4096):
        with np.errstate(over="ignore"):
            values = a[:, None] * hashes[None, at : at + 4096] + b[:, None]
        x, y = values.min(axis=1), values.max(axis=1)
        low = x if low is None else np.minimum(low, x)
        high = y if high is None else np.maximum(high, y)
    return np.concatenate([low, high])


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs (doc_id, text) to doc_id, n, set (digest of the shingle set, null without one), bands."""
    rows, bands = banding(percent)
    a, b = permutations(-(-rows * bands // 2))
    spread = mixed(np.arange(1, rows * bands + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, sets, keys = [], [], []
            for part in portions(texts):
                for hashes in shingle_sets(texts[part], words):
                    n.append(len(hashes))
                    if not len(hashes):
                        sets.append(None)
                        keys.append(None)
                        continue
                    sets.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    with np.errstate(over="ignore"):
                        values = mixed(signature(hashes, a, b)[: rows * bands] * spread)
                        keys.append(mixed(values.reshape(bands, rows).sum(axis=1, dtype=np.uint64)).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "set": pa.array(sets, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, n long, set binary, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The sorted shingle hashes, as bytes, of the documents whose id is in ids, with the further columns (first, other) of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in portions(texts):
                found = [h.tobytes() for h in shingle_sets(texts[part], words)]
                doc_id, first, other = (batch.column(c).slice(part.start, part.stop - part.start) for c in (0, 2, 3))
                yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "first": first, "other": other, "hashes": pa.array(found, pa.large_binary()).cast(pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # texts of no bucket are most of the corpus and stay where they are
    texts = maybe_among(texts, ids, "doc_id").join(ids, "doc_id").select("doc_id", "text", "first", "other")
    return texts.mapInArrow(run, "doc_id long, first boolean, other boolean, hashes binary")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the sets of b (y) and a (x): those that are first in a bucket, and those that are not.

    A text b with more than one in HOT of the pairs, so one of fewer than HOT texts, is copied to as many blocks as keep each
    within that share, or to PAIRS pairs, and its pairs are dealt over them by a: no task gets all pairs around one text.
    """
    sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = F.broadcast(sizes.filter(F.col("size") * HOT > total).select("b", F.ceil(F.col("size") / max(total / HOT, PAIRS)).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = pairs.join(hot, "b", "left").withColumn("block", F.pmod(F.xxhash64("a"), blocks).cast("int")).drop("blocks")
    copied = sets.filter("first").select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")).join(hot, "b", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    return dealt.join(copied, ["b", "block"]).drop("block").join(sets.filter("other").select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the sizes of intersection and union of their sets, that of b's set, what a lacks of it and what it adds.

    Both uses of the sets are served at once, so that they are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, total, size, lacks, adds = [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = y[at] == x
                rest = np.ones(len(y), bool)
                rest[at[both]] = False
                k = int(both.sum())
                shared.append(k)
                total.append(len(x) + len(y) - k)
                size.append(len(y))
                lacks.append(y[rest].view(np.int64))
                adds.append(x[~both].view(np.int64))
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (shared, total, size)), pa.array(lacks, longs), pa.array(adds, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shared", "total", "size", "lacks", "adds"])

    schema = "a long, b long, shared long, total long, size long, lacks array<long>, adds array<long>"
    return with_sets(pairs, sets).select("a", "b", "x", "y").mapInArrow(run, schema)


def linked_apart(apart: DataFrame, percent: int, work: Work) -> DataFrame:
    """Links (a, b) between members of different components around the same text.

    With w = 100 |lacks| + percent |adds|, two members are linked if their differences have at least
    (w1 + w2 - (100 - percent) size) / (100 + percent) shingles in common. That is above zero unless
    both are linked with the text itself, and then they are in one component. So members meet in the
    first places alone of what their differences share with any other, rarest first.
    """
    limit, one = (100 - percent) * F.col("size"), 100 + percent
    needed = lambda sum_: F.greatest(F.ceil((sum_ - F.col("limit")) / one), F.lit(1)).cast("int")
    members = apart.select("b", "a", "part", limit.alias("limit"), (100 * F.size("lacks") + percent * F.size("adds")).alias("w"), F.concat("lacks", "adds").alias("unlike"))
    bounds = members.groupBy("b").agg(F.count(F.lit(1)).alias("size"), F.min("w").alias("least"), F.min(F.when(F.col("w") > F.col("limit"), F.col("w"))).alias("far"))
    shingles = members.select("b", "a", F.explode("unlike").alias("shingle"))
    shared = shingles.groupBy("b", "shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    ranked = shingles.join(shared, ["b", "shingle"]).groupBy("b", "a").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("ranked"))
    rows = joined_by_size(members.drop("unlike"), bounds, "b", "size").filter("far is not null").join(ranked, ["b", "a"])
    rows = rows.withColumns({"n": F.size("ranked"), "as_less": needed(F.col("w") + F.greatest("w", "far")), "as_more": needed(F.col("w") + F.col("least"))})
    rows = work.table(rows, "ranked")

    def side(rows: DataFrame, need: str, s: str) -> DataFrame:
        """One row for each of a member's first places; left counts the places from there on."""
        first = F.slice("ranked", F.lit(1), F.greatest(F.col("n") - F.col(need) + 1, F.lit(0)))
        places = rows.select("b", "limit", "n", *[F.col(c).alias(f"{c}{s}") for c in ("a", "part", "w")], F.posexplode(first).alias("at", "place"))
        blocks = F.ceil(F.col("place.times") / BLOCK).cast("int")
        return places.select("b", F.col("place.shingle").alias("shingle"), blocks.alias("blocks"), "limit", f"a{s}", f"part{s}", f"w{s}", (F.col("n") - F.col("at")).alias(f"left{s}"))

    # a shingle of many members is dealt over blocks on one side and copied to each on the other
    less = side(rows, "as_less", "1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    more = side(rows.filter("w > limit"), "as_more", "2").withColumn("block", F.pmod(F.xxhash64("a2"), F.col("blocks")).cast("int")).drop("blocks", "limit")
    order = F.struct("w1", "a1") < F.struct("w2", "a2")
    enough = one * F.least("left1", "left2") >= F.col("w1") + F.col("w2") - F.col("limit")
    pairs = less.join(more, ["b", "shingle", "block"]).filter((F.col("part1") != F.col("part2")) & order & enough)
    pairs = pairs.select("b", "a1", "a2", (F.col("w1") + F.col("w2") - F.col("limit")).alias("need")).distinct()
    pairs = work.table(pairs, "pairs")

    unlike = lambda s: members.select("b", F.col("a").alias(f"a{s}"), F.col("unlike").alias(f"unlike{s}"))
    both = pairs.join(unlike("1"), ["b", "a1"]).join(unlike("2"), ["b", "a2"])
    found = both.filter(one * F.size(F.array_intersect("unlike1", "unlike2")) >= F.col("need"))
    return found.select(F.col("a1").alias("a"), F.col("a2").alias("b")).distinct()


def named(docs: DataFrame, work: Work) -> tuple[DataFrame, int | None]:
    """docs (doc_id, text) where rows without a doc_id have numbers beyond all others, and the last doc_id of the rest (null if no row lacks one).

    The numbers are in order of the texts' digests and written once, so that they are the same whenever they are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if rows.filter("doc_id is null").isEmpty():
        return rows, None
    last = rows.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    others = rows.filter("doc_id is null").orderBy(F.sha2(F.coalesce("text", F.lit("")), 256)).select((F.monotonically_increasing_id() + last + 1).alias("doc_id"), "text")
    return rows.filter("doc_id is not null").unionByName(work.table(others, "named")), last


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "near-dedup")
    docs, last = named(docs, work)
    with settings(spark, **TEXT_BATCH):
        rows = work.table(signatures(docs, words, percent), "signatures")
    classes = rows.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("size"))
    firsts = rows.join(classes, (rows["set"] == classes["set"]) & (F.col("doc_id") == F.col("class")), "left_semi")
    members = work.table(firsts.select("doc_id", "bands"), "firsts").select("doc_id", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    buckets = work.table(buckets, "buckets")
    members = work.table(joined_by_size(members, buckets, "band", "size").select("doc_id", "first"), "members")
    star = members.filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    star = work.table(star, "star")

    is_first = F.col("doc_id") == F.col("first")
    ids = work.table(members.groupBy("doc_id").agg(F.bool_or(is_first).alias("first"), F.bool_or(~is_first).alias("other")), "ids")
    work.drop("firsts", "buckets", "members")
    with settings(spark, **BATCH):
        sets = work.table(sets_of(docs, ids, words), "sets")
        seen = work.table(compared(star, sets), "seen")
    work.drop("sets", "star")
    linked = f"100 * shared >= {percent} * total"
    found = components(seen.filter(linked).select("a", "b"), work, "first")

    # what the first comparison left open
    part = found.withColumnRenamed("id", "a").withColumnRenamed("component", "part_a")
    root = found.withColumnRenamed("id", "b").withColumnRenamed("component", "part_b")
    roots = seen.groupBy("b").agg(F.count(F.lit(1)).alias("size")).join(root, "b", "left")
    placed = joined_by_size(seen.select("a", "b").join(part, "a", "left"), roots, "b", "size")
    placed = work.table(placed.select("a", "b", F.coalesce("part_a", "a").alias("part_a"), F.coalesce("part_b", "b").alias("part_b")), "placed")
    low, high = F.least(F.min("part_a"), F.min("part_b")), F.greatest(F.max("part_a"), F.max("part_b"))
    still = placed.groupBy("b").agg(F.count(F.lit(1)).alias("size"), (low < high).alias("open"))
    apart = joined_by_size(placed, still, "b", "size").filter("open").select("a", "b", F.col("part_a").alias("part")).distinct()
    apart = work.table(apart.join(seen.select("a", "b", "size", "lacks", "adds"), ["a", "b"]), "apart")
    more = work.table(linked_apart(apart, percent, work), "more")
    if not more.isEmpty():
        found = components(seen.filter(linked).select("a", "b").unionByName(more), work, "second")
    # one row for each set, then by set to the rows: those of one set are never gathered
    classes = work.table(classes.join(found.withColumnRenamed("id", "class"), "class", "left"), "classes")
    work.drop("ids", "seen", "placed", "apart", "ranked", "pairs")

    rows = rows.select("doc_id", "n", "set")
    out = joined_by_size(rows.filter("n > 0"), classes, "set", "size").select("doc_id", "n", F.coalesce("component", "class", "doc_id").alias("component_id"))
    out = out.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    given = lambda c: F.col(c) if last is None else F.when(F.col(c) <= last, F.col(c))
    return out.select(given("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), given("component_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates, with the columns of docs, whatever their names.

    Rows are decided each for itself, also where they have no doc_id or share one.
    """
    rows = keyed(docs, Work(spark, "near-dedup-keyed"))
    kept = near_dedup(rows.select(F.col("key").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("key"))
    return rows.join(kept, "key", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=3, percent=85)
