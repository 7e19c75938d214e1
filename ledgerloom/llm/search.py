"""Ranked lexical search of many queries: hybrid of term-at-a-time and document-at-a-time.

Queries are read in blocks of at most BLOCK_BYTES of distinct terms. For each block:

* An index of the documents is written to the shared folder: one row for each shard (some SHARD_BYTES of whole texts),
  with the lengths of its documents and, for each term of the block, the documents that hold it and how often.
* Statistics come from it by grouped sums: documents with a term, their length, and for each term the
  documents that hold it.
* A task goes through its shards and keeps the best rows of each query so far. In a shard a query's terms meet so: the
  short lists are summed term at a time into accumulators, which then stand as ONE list, ordered by document and
  bounded by its largest sum, beside the long lists. Over these lists the search goes document at a time, in runs of
  RUN documents: lists whose bounds together can't reach the query's k-th best score bring no documents of their own; they are
  only looked into (skipping by binary search), from the largest bound down, for documents that can still reach it.
* The best of all tasks are ranked.

The k-th best score is carried from shard to shard, so later shards skip more. A task's memory is a shard and k rows a
query; the driver's is a block's terms with their counts. Nothing is dropped: a document that is skipped has too low a bound.

Defined cases: null or empty texts hold no term and don't count; queries without terms get no rows; each row of
queries is a query of its own, repeated identifiers too; each document row is a document, rows without doc_id come last among
equal scores and have a null doc_id; texts of any length are read whole, in stretches; scores of 0 are left out; empty
tables give empty results; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Work, documents, ship

TOP = 50
BLOCK_BYTES = 16 << 20
SHARD_BYTES, STRETCH = 8 << 20, 1 << 20
#: A list of at most one in SHORT of a shard's documents is summed into accumulators.
SHORT, RUN = 32, 1024
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes(0x20 if c in _SEPARATORS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Stands for a missing doc_id: larger than any other in order.
NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in stretches: letters and digits, and all that isn't ASCII; A-Z lower-cased."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + STRETCH) if at + STRETCH < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


@dataclass
class Block:
    """Queries: places of their rows, identifiers, and the numbers of their terms in the block's vocabulary."""

    vocabulary: list[bytes]
    places: list[int]
    ids: list[int | None]
    queries: list[list[int]]


def query_blocks(queries: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of queries (item_id, text), each of at most `most` bytes of terms, or of one query."""
    rows = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary")).orderBy("item_id", "text")
    number, held, block = {}, 0, Block([], [], [], [])
    for place, (item, text) in enumerate(rows.toLocalIterator()):
        own = dict.fromkeys(t for part in terms(bytes(text or b"")) for t in part)
        if not own:
            continue
        size = sum(map(len, own)) + 8 * len(own)
        if block.places and held + size > most:
            block.vocabulary = list(number)
            yield block
            number, held, block = {}, 0, Block([], [], [], [])
        held += size
        block.places.append(place)
        block.ids.append(item)
        block.queries.append([number.setdefault(t, len(number)) for t in own])
    if block.places:
        block.vocabulary = list(number)
        yield block


INDEX = "documents long, with_terms long, length long, ids binary, lengths binary, terms binary, starts binary, docs binary, times binary"


def index(docs: DataFrame, vocabulary: list[bytes], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (doc_id, text) to shards: documents, those with a term, the length of all, and postings of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        get, most = number.get, max(len(number), 1)
        ids, lengths, keys, held, all_length, with_terms = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
            # key: document * vocabulary + term; postings go by term, then document
            doc, term = key // most, key % most
            order = np.argsort(term, kind="stable")
            doc, term, times = doc[order], term[order], times[order]
            there, starts = np.unique(term, return_index=True)
            parts = [np.array(ids, np.int64), np.array(lengths, np.int64), there.astype(np.int64), np.append(starts, len(term)).astype(np.int64), doc.astype(np.int32), times.astype(np.int64)]
            names = ["documents", "with_terms", "length", "ids", "lengths", "terms", "starts", "docs", "times"]
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([with_terms], pa.int64()), pa.array([all_length], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py() or b""
                n, found = 0, []
                for part in terms(data):
                    n += len(part)
                    found.append(np.array([i for i in map(get, part) if i is not None], np.int64))
                own = np.concatenate(found) if found else np.empty(0, np.int64)
                all_length, with_terms, held = all_length + n, with_terms + (n > 0), held + len(data)
                if len(own):
                    keys.append(own + len(ids) * most)
                    ids.append(NO_ID if doc_id is None else doc_id)
                    lengths.append(n)
                if held >= shard_bytes:
                    yield shard()
                    ids, lengths, keys, held, all_length, with_terms = [], [], [], 0, 0, 0
        if held or with_terms:
            yield shard()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, INDEX)


def document_counts(shards: DataFrame, size: int) -> list[int]:
    """For each of the vocabulary's `size` terms the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for there, starts in zip(batch.column(0), batch.column(1), strict=True):
                total[np.frombuffer(there.as_py(), np.int64)] += np.diff(np.frombuffer(starts.as_py(), np.int64))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "df"])

    out = [0] * size
    for term, df in shards.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        out[term] = df
    return out


def shares(times: np.ndarray, lengths: np.ndarray, n_documents: int, all_length: int) -> np.ndarray:
    """A posting's share of its term's weight: (1000000000 tf) div (1000 tf + 20 m), in 64 bits, or in whole numbers of any length where those might not do."""
    big = 50 * int(lengths.max()) * n_documents >= 2**63 or 10**9 * int(times.max()) >= 2**63
    times, lengths = (times.astype(object), lengths.astype(object)) if big else (times, lengths)
    m = 50 + 50 * lengths * n_documents // all_length
    return (10**9 * times // (1000 * times + 20 * m)).astype(np.int64)


class Best:
    """The k best (score, doc_id) rows of a query so far; least is the score that a row must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search_shard(lists: list[tuple[np.ndarray, np.ndarray]], n: int, ids: np.ndarray, best: Best) -> int:
    """Adds a shard's best documents for one query; returns how many documents were scored.

    lists: for each term its documents (ascending) and what they score; n: documents in the shard.
    """
    short, long = [x for x in lists if len(x[0]) * SHORT <= n], [x for x in lists if len(x[0]) * SHORT > n]
    if short:  # term at a time
        docs, place = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, place, np.concatenate([x[1] for x in short]))
        long.append((docs, sums))
        if len(sums) >= best.k:  # k documents score that much at least
            best.least = max(best.least, int(np.partition(sums, -best.k)[-best.k]))
    iterators = sorted(((int(s.max()), d, s) for d, s in long), key=lambda x: x[0])
    bounds = np.cumsum([0, *(x[0] for x in iterators)])  # of all lists before each
    at, scored = 0, 0
    while at < n:
        # document at a time: only lists beyond `first` can bring a document that reaches the k-th best
        first = int(np.searchsorted(bounds, best.least, side="left")) - 1
        if first >= len(iterators):
            break
        parts = [(d, s, int(np.searchsorted(d, at))) for _, d, s in iterators[first:]]
        heads = [d[i : i + RUN] for d, _, i in parts]
        if not any(len(h) for h in heads):
            break
        # the run ends where the first of the lists has shown RUN documents
        end = min((int(h[-1]) + 1 for h in heads if len(h) == RUN), default=n)
        some = [(d[i:j], s[i:j]) for d, s, i in parts for j in [int(np.searchsorted(d, end))]]
        candidates, place = np.unique(np.concatenate([d for d, _ in some]), return_inverse=True)
        scores = np.zeros(len(candidates), np.int64)
        np.add.at(scores, place, np.concatenate([s for _, s in some]))
        for i in range(first - 1, -1, -1):  # the others are looked into, the largest bound first
            alive = scores + bounds[i + 1] >= best.least
            candidates, scores = candidates[alive], scores[alive]
            if not len(candidates):
                break
            _, d, s = iterators[i]
            there = np.minimum(np.searchsorted(d, candidates), len(d) - 1)
            scores = scores + np.where(d[there] == candidates, s[there], 0)
        reach = scores >= best.least
        scored += len(candidates)
        if reach.any():
            best.add(scores[reach], ids[candidates[reach]])
        at = end
    return scored


def rank_block(shards: DataFrame, block: Block, k: int = TOP) -> DataFrame:
    """The k best of each task for each query of a block: place, item_id, doc_id, score."""
    total = shards.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    n_documents, all_length = int(total[0]), int(total[1])
    counts = document_counts(shards, len(block.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) if df else 0 for df in counts], np.int64)
    shared = shards.sparkSession.sparkContext.broadcast((block.places, block.ids, block.queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, items, queries, weights = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for row in range(len(batch)):
                ids, lengths, there, starts, docs, times = [np.frombuffer(batch.column(i)[row].as_buffer(), t) if len(batch.column(i)[row].as_buffer()) else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.int64, np.int64, np.int32, np.int64))]
                if not len(docs):
                    continue
                gains = shares(times, lengths[docs], n_documents, all_length) * np.repeat(weights[there], np.diff(starts))
                place = {t: i for i, t in enumerate(there.tolist()) if weights[t] > 0}
                for q, own in enumerate(queries):
                    lists = [(docs[starts[i] : starts[i + 1]], gains[starts[i] : starts[i + 1]]) for i in map(place.get, own) if i is not None]
                    if lists:
                        search_shard(lists, len(ids), ids, best[q])
        for q, b in enumerate(best):
            if len(b.ids):
                n = len(b.ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, places[q], np.int64)), pa.array([items[q]] * n, pa.int64()), pa.array(b.ids, mask=b.ids == NO_ID), pa.array(b.scores)], names=["place", "item_id", "doc_id", "score"])

    return shards.select("ids", "lengths", "terms", "starts", "docs", "times").mapInArrow(run, "place long, item_id long, doc_id long, score long")


SCHEMA = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (doc_id, text) and queries (item_id, text) to item_id, rank, doc_id, score: the k best documents of each query."""
    spark = docs.sparkSession
    ship(spark)
    work, out = Work(spark, "search"), None
    for i, block in enumerate(query_blocks(queries, block_bytes)):
        shards = work.table(index(docs, block.vocabulary, shard_bytes), f"index-{i}")
        found = rank_block(shards, block, k)
        # each task's best, then the best of all: the first limit is taken before rows are shuffled
        order = W.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = work.table(found, f"found-{i}")
        work.drop(f"index-{i}")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS w FROM documents),
nl AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
post AS (SELECT r, doc_id, n_terms, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n_terms, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT row_number() OVER () AS p, item_id, list_distinct({_TERMS.format("text")}) AS w FROM benchmark),
qt AS (SELECT p, item_id, unnest(w) AS term FROM q),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nl.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, nl GROUP BY term),
s AS (
  SELECT p, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n_terms * nl.n) // nl.l)))) AS BIGINT) AS score
  FROM qt JOIN wt USING (term) JOIN post USING (term), nl GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY p ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
