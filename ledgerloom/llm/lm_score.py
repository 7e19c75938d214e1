"""LM scoring by context-tree weighting over bytes.

A text is its tokens: each word followed by a space, then one line end. A byte is eight binary
decisions; every decision (the bits of the byte so far) has a context tree of its own over the
last bytes, at most `DEPTH` of them. In each node the zeros and ones seen in training give a
Krichevsky-Trofimov estimate, and the node's weighted probability is half its own block
probability plus half the product of its children's. What a text costs is the mixture of the
estimates of all depths along its path, with the weights that training left; below the deepest
node that training has seen, that node's estimate stands for the rest of the weight.

The tree holds every context of every training text; nothing is cut, and it grows with the corpus.
It never lies in one place:

1. Texts are dealt into parts of about `PART` characters. A part asks for the distinct runs of
   DEPTH + 1 bytes that stand in it, with their counts in training; texts travel beside them as
   compressed Arrow batches. Counts are summed by run.
2. Runs are dealt by the last `SHARD` bytes of their context, so a task holds whole subtrees. It sends the
   sums of their nodes' weighted probabilities one level up; those of contexts of SHARD - 1 bytes
   make the top of the tree on the driver: a row for each context and beginning of a byte, at most 65,536 x 255 = 16.7
   million rows whatever the size of the corpus (600 MB; a corpus of 16,384 contexts over 128 byte values sends 2 million).
3. With the top at hand each subtree gives the cost of each of its runs.
4. Runs and costs meet in a join, come back to the parts that asked, and each part's texts add up.
   The runs that most parts ask for, a bounded list, are broadcast with their costs instead.

The largest subtree holds the distinct runs that follow one string of SHARD bytes (under one in a
hundred of all runs in the test data). Words count without a bound: the most frequent ones, a bounded list, are
broadcast; the others reach their documents through a join.

Defined cases: null text is the empty text (one end token); a null doc_id counts as the text ""
in crc32; repeated rows count and score each; a text of any length is scored whole, in a part of
its own if it is longer than one; an empty table gives an empty result; without training texts
every byte costs eight bits. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Work, documents, most_frequent, settings, ship
from .shingles import portions

DEPTH = 6
#: Bytes of context by which subtrees are dealt; words and runs that are broadcast.
SHARD, TOP_WORDS, TOP_RUNS = 3, 1 << 17, 1 << 21
#: Characters in a part, and handled at once; runs sorted at once.
PART, PORTION, SORTED = 48 << 20, 2 << 20, 6 << 20
#: Words a task holds before it passes partial counts on; bytes of words counted at once; runs that a task turns into nodes at once.
HELD, COUNTED, CHUNK = 400_000, 32 << 20, 200_000
TEXT_BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1000"}
NUMBER_BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": "50000"}
END = b""


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    """Words; the end token is not in the list."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def runs_of(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text (and its end) the run that ends there, as a number with the byte lowest; the bytes of each text."""
    spelled = [b" ".join(w) + b" \n" if w else b"\n" for w in texts]
    raw = bytes(7) + bytes(depth).join([b"", *spelled])
    codes = np.ndarray(len(raw) - 7, ">i8", raw, strides=(1,)).astype(np.int64)  # the eight bytes that end at each place
    codes &= (1 << 8 * (depth + 1)) - 1
    n = np.fromiter(map(len, spelled), np.int64, len(spelled))
    inside = np.ones(len(codes), bool)
    starts = np.cumsum(n + depth) - n - depth
    inside[(starts[:, None] + np.arange(depth)).ravel()] = False
    return codes[inside], n


def first_of(x: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c = c[order]  # one after the other: a part's arrays are large
    n = n[order]
    first = first_of(c)
    return c[first], np.add.reduceat(n, first) if len(first) else n


# parts: what stands in the texts

PARTS = pa.schema([("part", pa.int64()), ("texts", pa.binary()), ("word", pa.binary()), ("run", pa.int64()), ("n", pa.int64())])
PARTS_SQL = "part long, texts binary, word binary, run long, n long"


def rows_of(**columns) -> pa.RecordBatch:
    """A batch of PARTS; columns left out are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in PARTS], schema=PARTS)


def tallied(words: list[pa.Array], before: pa.Table | None) -> pa.Table:
    """The distinct words of some arrays with their counts, added to a table of such counts."""
    found = pa.chunked_array(words, pa.binary()).value_counts()
    table = pa.table({"word": found.field(0), "n": found.field(1)})
    if before is None:
        return table
    return pa.concat_tables([before, table]).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def packed(ids: pa.Array, texts: pa.Array) -> bytes:
    """Identifiers and texts as one compressed Arrow batch."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> tuple[list, list]:
    table = pa.ipc.open_stream(raw).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def parted(docs: DataFrame, depth: int, part_size: int = PART) -> DataFrame:
    """Rows of three kinds: a part's texts; its distinct runs with their counts in training; training words with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, size = TaskContext.get().partitionId() << 32, 0
        words: list[pa.Array] = []  # training words not yet counted
        tally: pa.Table | None = None
        none = np.empty(0, np.int64)
        codes, counts = [none], [none]
        raw: dict[bool, list[np.ndarray]] = {False: [], True: []}  # runs not yet counted, of training texts and of the others

        def count_raw() -> None:
            for out, held in raw.items():
                if held:
                    c = np.concatenate(held)
                    held.clear()
                    c.sort()
                    first = first_of(c)
                    codes.append(c[first])
                    counts.append(np.zeros(len(first), np.int64) if out else np.diff(first, append=len(c)))

        def asked() -> Iterator[pa.RecordBatch]:
            count_raw()
            c, n = merged(codes, counts)
            for at in range(0, len(c), 50_000):
                x = c[at : at + 50_000]
                yield rows_of(part=np.full(len(x), part), run=x, n=n[at : at + 50_000])

        def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for some in table.to_batches(50_000):
                yield rows_of(word=some.column(0), n=some.column(1))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for p in portions(texts, PORTION):
                here, split = ids[p], [tokens(t) for t in texts[p]]
                yield rows_of(part=[part], texts=[packed(batch.column(0).slice(p.start, len(here)), batch.column(1).slice(p.start, len(here)))])
                out = [held_out(i) for i in here]
                learned = [w for w, o in zip(split, out, strict=True) if not o]
                words.append(pa.array([*chain.from_iterable(learned), *[END] * len(learned)], pa.binary()))
                for held, some in ((False, learned), (True, [w for w, o in zip(split, out, strict=True) if o])):
                    if some:
                        raw[held].append(runs_of(some, depth)[0])
                if sum(map(len, raw[False])) + sum(map(len, raw[True])) > SORTED:
                    count_raw()
                if len(codes) > 6:
                    c, n = merged(codes, counts)
                    codes[:], counts[:] = [c], [n]
                size += sum(len(t or "") for t in texts[p])
                if size >= part_size:
                    yield from asked()
                    part, size = part + 1, 0
                    codes[:], counts[:] = [none], [none]
                if sum(w.nbytes for w in words) > COUNTED:
                    tally, words = tallied(words, tally), []
                    if tally.num_rows > HELD or tally.nbytes > 4 * COUNTED:
                        yield from counted(tally)
                        tally = None
        yield from asked()
        yield from counted(tallied(words, tally))

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows_in.mapInArrow(run, PARTS_SQL)


# the tree

_SMALL = 1 << 14


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series at x + 8."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    p = np.log(x)
    for k in range(1, 8):
        p = p + np.log(x + k)
    return s - p


_HALVES, _WHOLES = lgamma(np.arange(_SMALL) + 0.5), lgamma(np.arange(_SMALL) + 1.0)


def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a zeros and b ones."""
    n = a + b
    low = np.minimum(n, _SMALL - 1)
    out = _HALVES[np.minimum(a, low)] + _HALVES[np.minimum(b, low)] - _WHOLES[low] - math.log(math.pi)
    many = np.flatnonzero(n >= _SMALL)
    if len(many):
        out[many] = lgamma(a[many] + 0.5) + lgamma(b[many] + 0.5) - lgamma(n[many] + 1.0) - math.log(math.pi)
    return out


def mask(depth: int, bit: int) -> int:
    """The bits of a node's key: its context, then the bits so far."""
    return (1 << (8 * depth + bit)) - 1


class Subtree:
    """The nodes of one bit below whole contexts of `low` bytes, down to `depth`: keys, zeros, ones, weights; all levels sorted by key."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], low: int, depth: int, bit: int):
        self.keys, self.zeros, self.ones, self.parents = [], [], [], [None]
        for codes, n in levels:
            whole = codes >> (8 - bit)
            first = first_of(whole)
            total, ones = np.add.reduceat(n, first), np.add.reduceat(n * ((codes >> (7 - bit)) & 1), first)
            self.keys.append(whole[first])
            self.zeros.append(total - ones)
            self.ones.append(ones)
        for d in range(low + 1, depth + 1):
            self.parents.append(np.searchsorted(self.keys[d - low - 1], self.keys[d - low] & mask(d - 1, bit)))
        self.weighted, self.stay = [None] * len(levels), [None] * len(levels)
        for i in range(len(levels) - 1, -1, -1):
            own = block(self.zeros[i], self.ones[i])
            if i == len(levels) - 1:
                self.weighted[i], self.stay[i] = own, np.ones(len(own))
            else:
                below = np.bincount(self.parents[i + 1], weights=self.weighted[i + 1], minlength=len(own))
                self.weighted[i], self.stay[i] = weigh(own, below)

    def descend(self, i: int, given: np.ndarray, rest: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What level i adds to the parts given so far, the weight left, and the deepest estimate; each at its nodes."""
        return mixed(self.zeros[i], self.ones[i], self.stay[i], given, rest, last)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted probability (ln) from its own block's and its children's, and the own block's share of it."""
    weighted = np.logaddexp(own, below) - math.log(2)
    return weighted, np.exp(own - math.log(2) - weighted)


def mixed(zeros: np.ndarray, ones: np.ndarray, stay: np.ndarray, given: np.ndarray, rest: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen = zeros + ones > 0
    estimate = np.where(seen, (ones + 0.5) / (zeros + ones + 1), last)
    here = np.where(seen, stay, 0.0)
    return given + rest * here * estimate, rest * (1 - here), estimate


def levels_of(runs: np.ndarray, counts: np.ndarray, low: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct runs of low + 1 to depth + 1 bytes with their counts."""
    out = [merged([runs], [counts])]
    for d in range(depth - 1, low - 1, -1):
        out.append(merged([out[-1][0] & ((1 << 8 * (d + 1)) - 1)], [out[-1][1]]))
    return out[::-1]


def upward(runs: np.ndarray, counts: np.ndarray, low: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit: keys of the nodes above depth `low`, with the zeros, ones and weighted probabilities that these runs send them."""
    levels = levels_of(runs, counts, low, depth)
    for bit in range(8):
        t = Subtree(levels, low, depth, bit)
        keys, back = np.unique(t.keys[0] & mask(low - 1, bit), return_inverse=True)
        add = lambda x: np.bincount(back, weights=x, minlength=len(keys))  # noqa: E731, B023
        yield bit, keys, add(t.zeros[0]).astype(np.int64), add(t.ones[0]).astype(np.int64), add(t.weighted[0])


Top = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def top_of(sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], depth: int) -> Top:
    """sums by bit (keys, zeros, ones, weighted children) at a depth to what the root and the levels down to it give there: keys, given, rest, estimate."""
    top: Top = {}
    for bit, (keys, zeros, ones, below) in sums.items():
        order = np.argsort(keys)
        level = [(keys[order], zeros[order], ones[order], below[order])]
        parents, weighed = [], []
        for d in range(depth, -1, -1):
            k, a, b, w = level[0]
            weighed.insert(0, weigh(block(a, b), w))
            if d:
                up, back = np.unique(k & mask(d - 1, bit), return_inverse=True)
                add = lambda x: np.bincount(back, weights=x, minlength=len(up))  # noqa: E731, B023
                level.insert(0, (up, add(a).astype(np.int64), add(b).astype(np.int64), add(weighed[0][0])))
                parents.insert(0, back)
        given, rest, last = np.zeros(len(level[0][0])), np.ones(len(level[0][0])), np.full(len(level[0][0]), 0.5)
        for d in range(depth + 1):
            if d:
                given, rest, last = (x[parents[d - 1]] for x in (given, rest, last))
            given, rest, last = mixed(level[d][1], level[d][2], weighed[d][1], given, rest, last)
        top[bit] = level[depth][0], given, rest, last
    return top


def downward(runs: np.ndarray, counts: np.ndarray, low: int, depth: int, top: Top) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs and ln of the probability of each one's last byte."""
    levels = levels_of(runs, counts, low, depth)
    deepest = levels[-1][0]
    cost = np.zeros(len(deepest))
    for bit in range(8):
        t = Subtree(levels, low, depth, bit)
        keys, given, rest, last = top[bit]
        at = np.searchsorted(keys, t.keys[0] & mask(low - 1, bit))
        given, rest, last = given[at], rest[at], last[at]
        for i in range(len(levels)):
            if i:
                given, rest, last = (x[t.parents[i]] for x in (given, rest, last))
            given, rest, last = t.descend(i, given, rest, last)
        p = (given + rest * last)[np.searchsorted(t.keys[-1], deepest >> (8 - bit))]
        cost += np.log(np.where((deepest >> (7 - bit)) & 1, p, 1 - p))
    return deepest, cost


def dealt(runs: DataFrame, low: int) -> DataFrame:
    """runs (run, n) so that those with the same last `low` bytes of context follow one another in one task."""
    context = F.shiftright("run", 8).bitwiseAND((1 << 8 * low) - 1)
    return runs.select(context.alias("context"), "run", "n").repartition("context").sortWithinPartitions("context")


def whole_contexts(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs and counts of dealt(), some whole contexts at a time."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= most:
            context, runs, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.searchsorted(context, context[-1])) if (np.diff(context) >= 0).all() else int(first_of(context)[-1])
            if end:
                yield runs[:end], counts[:end]
            held, size = [[context[end:], runs[end:], counts[end:]]], len(context) - end
    if size:
        _, runs, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        yield runs, counts


def run_costs(runs: DataFrame, depth: int, work: Work) -> DataFrame:
    """runs (run, n), each once, to run, cost: ln of the probability of its last byte."""
    low, spark = min(SHARD, depth), runs.sparkSession

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, n in whole_contexts(batches):
            for bit, keys, zeros, ones, below in upward(r, n, low, depth):
                yield pa.RecordBatch.from_pydict({"bit": np.full(len(keys), bit, np.int32), "node": keys, "zeros": zeros, "ones": ones, "below": below})

    with settings(spark, **NUMBER_BATCH):
        sums = dealt(runs, low).mapInArrow(up, "bit int, node long, zeros long, ones long, below double").groupBy("bit", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
        got = sums.toArrow()  # a row for each context of low - 1 bytes and beginning of a byte: 256^(low - 1) x 255 at the most
    columns = [got.column(c).to_numpy() for c in ("bit", "node", "zeros", "ones", "below")]
    top = spark.sparkContext.broadcast(top_of({bit: tuple(c[columns[0] == bit] for c in columns[1:]) for bit in range(8)}, low - 1))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, n in whole_contexts(batches):
            codes, cost = downward(r, n, low, depth, top.value)
            for at in range(0, len(codes), 50_000):
                yield pa.RecordBatch.from_pydict({"run": codes[at : at + 50_000], "cost": cost[at : at + 50_000].astype(np.float32)})

    with settings(spark, **NUMBER_BATCH):
        return work.table(dealt(runs, low).mapInArrow(down, "run long, cost float"), "costs")


# texts and their costs

SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_bytes long, score double, known long, base double, others array<struct<word: binary, k: int>>"


def looked_up(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of numbers in a sorted array, and whether they stand there."""
    at = np.searchsorted(keys, sought)
    at[at == len(keys)] = 0
    return at, keys[at] == sought if len(keys) else np.zeros(len(sought), bool)


Values = tuple[pa.Array, np.ndarray]


def valued(common: dict[bytes, float]) -> Values:
    """Words, and their values in the same order."""
    return pa.array(list(common), pa.binary()), np.fromiter(common.values(), float, len(common))


def word_sums(split: list[list[bytes]], common: dict[bytes, float] | Values) -> tuple[list[int], list[float], pa.Array]:
    """For each text the number of its tokens that are common, the sum of their values, and its other words with their counts.

    Each distinct word of the texts is looked up once, all of them together: this is a large part of the operator's time.
    """
    words, values = common if isinstance(common, tuple) else valued(common)
    coded = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode()
    sought = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
    found = np.append(values, np.nan)[pc.index_in(sought, value_set=words).fill_null(-1).to_numpy()]
    ids, end = coded.indices.to_numpy(), found[-1]
    text, each = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split))), found[ids]
    rare = np.isnan(each)
    n_known = np.bincount(text[~rare], minlength=len(split)) + (0 if np.isnan(end) else 1)
    base = np.bincount(text, np.where(rare, 0.0, each), len(split)) + (0.0 if np.isnan(end) else end)
    pairs, times = np.unique(text[rare] * len(found) + ids[rare], return_counts=True)
    at_text, at_word = np.divmod(pairs, len(found))
    others = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(at_word)), pa.array(times, pa.int32())], ["word", "k"])
    ends = np.searchsorted(at_text, np.arange(len(split) + 1))
    return n_known.tolist(), base.tolist(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others)


def scored(parts: DataFrame, costs: DataFrame, top: Values, often: tuple[np.ndarray, np.ndarray], depth: int) -> DataFrame:
    """One row for each text: key, doc_id, held_out, n_tokens, n_bytes, score, frequent words' part of the base, and the other words.

    often: the runs that are broadcast, in order, and their costs.
    """
    spark = parts.sparkSession
    known = spark.sparkContext.broadcast(often)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~looked_up(known.value[0], batch.column(1).to_numpy())[1]))

    texts = parts.filter("texts is not null").select("part", "texts", F.lit(None).cast("long").alias("run"), F.lit(None).cast("float").alias("cost"))
    asked = parts.filter("run is not null").select("part", "run").mapInArrow(others, "part long, run long")
    asked = asked.join(costs, "run").select("part", F.lit(None).cast("binary").alias("texts"), "run", "cost")
    together = texts.unionByName(asked).repartition("part").sortWithinPartitions("part", F.col("run").asc_nulls_last())
    frequent = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, random = frequent.value, np.random.default_rng()
        part, runs, values = None, [], []
        for batch in batches:
            parts_, blobs = batch.column(0).to_numpy(), batch.column(1)
            edges = np.concatenate([first_of(parts_), [len(parts_)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if parts_[a] != part:
                    part, runs, values = parts_[a], [], []
                plain = b - a - (blobs.slice(a, b - a).null_count)  # the texts stand last
                if b - plain > a:
                    runs.append(batch.column(2).slice(a, b - a - plain).to_numpy())
                    values.append(batch.column(3).slice(a, b - a - plain).to_numpy())
                for i in range(b - plain, b):
                    if len(runs) != 1:
                        runs, values = [np.concatenate([np.empty(0, np.int64), *runs])], [np.concatenate([np.empty(0, np.float32), *values])]
                    yield scores(*unpacked(blobs[i].as_buffer()), runs[0], values[0], common, random)

    def scores(ids: list, texts_: list, known_runs: np.ndarray, values: np.ndarray, common: Values, random: np.random.Generator) -> pa.RecordBatch:
        split = [tokens(t) for t in texts_]
        score, n_bytes = np.empty(len(split)), np.empty(len(split), np.int64)
        for at_text in range(0, len(split), 256):
            part = slice(at_text, at_text + 256)
            codes, n = runs_of(split[part], depth)
            # a run has 56 bits: the text's number within these few goes below it, and one sort brings equal runs together
            order = codes.view(np.uint64)
            order <<= np.uint64(8)
            order |= np.repeat(np.arange(len(n), dtype=np.uint64), n)
            order.sort()
            runs = (order >> np.uint64(8)).view(np.int64)
            first = first_of(runs)
            found = runs[first]
            at, ok = looked_up(known.value[0], found)
            each = np.empty(len(found))
            each[ok] = known.value[1][at[ok]]
            each[~ok] = values[np.searchsorted(known_runs, found[~ok])]
            times = np.diff(np.append(first, len(runs)))
            score[part] = np.bincount((order & np.uint64(255)).astype(np.int64), weights=np.repeat(each, times), minlength=len(n)) / math.log(10)
            n_bytes[part] = n
        n_known, base, rare = word_sums(split, common)
        columns = [
            pa.array(random.integers(0, 2**63 - 1, len(ids))), pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array([len(w) + 1 for w in split], pa.int64()),
            pa.array(n_bytes), pa.array(score, pa.float64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), rare,
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "held_out", "n_tokens", "n_bytes", "score", "known", "base", "others"])

    return together.mapInArrow(run, SCORED)


def lm_score(docs: DataFrame, depth: int = DEPTH, top: int = TOP_WORDS, part_size: int = PART, top_runs: int = TOP_RUNS) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    if not 1 <= depth <= 6:
        raise ValueError("a run of depth + 1 bytes must leave a byte of 64 bits free")
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "lm-score")
    with settings(spark, **TEXT_BATCH):
        parts = work.table(parted(docs, depth, part_size), "parts")
    words = parts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = work.table(words, "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = most_frequent(words, top).toArrow().to_pydict()
    frequent = valued({w: math.log10(c + 1) for w, c in zip(frequent["word"], frequent["n"], strict=True)})
    # a task's parts have few runs in common: rows are dealt as they are and summed where they meet
    dealt_runs = parts.filter("run is not null").select("run", "n").repartition("run")
    runs = work.table(dealt_runs.groupBy("run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("asked")), "runs")
    costs = run_costs(runs, depth, work)
    often = most_frequent(runs.select("run", F.col("asked").alias("n")).filter("n > 1"), top_runs).select("run")
    got = costs.join(often, "run").toArrow()
    order = np.argsort(got.column("run").to_numpy())
    with settings(spark, **NUMBER_BATCH):
        rows = work.table(scored(parts, costs, frequent, (got.column("run").to_numpy()[order], got.column("cost").to_numpy()[order]), depth), "scored")
    work.drop("runs")
    work.drop("parts", "costs")
    others = rows.select("key", F.explode("others").alias("o")).select("key", "o.word", "o.k")
    # words are distinct, a task's share of them is a small table: the others needn't be sorted
    found = others.join(words.hint("shuffle_hash"), "word").groupBy("key").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_base"))
    out = rows.drop("others").join(found, "key", "left")
    n = F.col("n_tokens")
    return out.select(
        "doc_id", "held_out", n, (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - n * math.log10(total + distinct + 1)).alias("base_score"),
        "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))
