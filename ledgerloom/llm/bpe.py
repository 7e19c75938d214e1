"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

1. Frequent words (pieces of the pre-tokenisation) are counted over all texts: each task keeps a
   mergeable Misra-Gries summary, which loses no piece above its error bound, and the summaries
   are summed. The summary bounds memory alone; ids never depend on what it holds.
2. The driver compiles the most frequent ones, a bounded list, into a minimal acyclic automaton
   (shared prefixes and suffixes). Arcs carry numbers whose sum along a word is the word's index,
   and the index points to its ids. The arrays go into one file that Spark hands to each executor.
3. Executors memory-map the file. Pieces of a batch walk the automaton together; a piece that it
   doesn't hold is merged exactly, lowest rank first.

Results equal the tokenizers library's, special tokens in a text included. Decoding maps ids back
to bytes and the bytes to text.

Defined cases: null text is empty and has no tokens; repeated rows give repeated rows; a null
doc_id stays null; an empty table gives an empty result and an empty lexicon; further columns are
ignored. Texts may be of any length: long pieces are merged with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Work, documents, most_frequent, ship
from .shingles import portions

LEXICON_WORDS = 1 << 16
SUMMARY = 150_000
#: Characters of pieces, ids and decoded texts remembered by a worker beside the lexicon; characters of texts handled at once.
MEMORY, PORTION = 32 << 20, 4 << 20

# Letters, numbers and white space below U+0250, written out: there every table of Unicode agrees.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
PIECES = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile("[^\x00-ɏ]")


def pieces(text: str) -> list[str]:
    """The pre-tokenisation of one text without special tokens."""
    if BEYOND.search(text) is None:
        return PIECES.findall(text)
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
    return [text[a:b] for _, (a, b) in cut]


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as letters: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and bytes of a byte-level BPE vocabulary."""

    def __init__(self, spelled: dict[str, int], merges: list, special: dict[str, int]):
        letters = byte_letters()
        self.special, self._table = special, None
        self.by_id = {i: bytes(letters[c] for c in t) for t, i in spelled.items()} | {i: t.encode() for t, i in special.items()}
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = spelled[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((spelled[a], spelled[b]), (rank, spelled[a + b]))

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        return cls(j["model"]["vocab"], j["model"]["merges"], {t["content"]: t["id"] for t in j["added_tokens"]})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is merged first, the left one of equals."""
        ids = [self.first[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many short pieces at once: each round merges one pair in every piece that has one."""
        if self._table is None:
            pairs = sorted((a << 20 | b, r, m) for (a, b), (r, m) in self.merges.items())
            self._table = [np.array([p[i] for p in pairs] or [0], np.int64) for i in range(3)]
        keys, ranks, made = self._table
        n = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.array(self.first, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        done_ids, done_word, none = [], [], np.int64(1 << 40)
        while len(ids):
            key = np.append(ids[:-1] << 20 | ids[1:], -1)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            rank = np.where((keys[at] == key) & np.append(word[:-1] == word[1:], False), ranks[at], none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            open_ = least < none
            done_ids.append(ids[~open_])
            done_word.append(word[~open_])
            hit = np.flatnonzero(open_ & (rank == least))
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])] if len(hit) else hit
            ids[hit] = made[at[hit]]
            open_[hit + 1] = False
            ids, word = ids[open_], word[open_]
        word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        ids = np.concatenate(done_ids)[order].tolist() if done_ids else []
        ends = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, m[1], ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x, live in zip(ids, alive, strict=True) if live]


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Arcs, ends and root of the minimal acyclic automaton of sorted distinct words, built word by word."""
    arcs: list[dict[int, int]] = [{}]
    ends = [False]
    known: dict[tuple, int] = {}
    open_states, last = [0], b""

    def close(down_to: int) -> None:
        while len(open_states) > down_to + 1:
            state = open_states.pop()
            key = (ends[state], *arcs[state].items())
            same = known.setdefault(key, state)
            if same != state:
                arcs[open_states[-1]][last[len(open_states) - 1]] = same
                arcs[state] = {}

    for word in words:
        common = 0
        for a, b in zip(word, last, strict=False):
            if a != b:
                break
            common += 1
        close(common)
        for c in word[common:]:
            arcs.append({})
            ends.append(False)
            arcs[open_states[-1]][c] = len(arcs) - 1
            open_states.append(len(arcs) - 1)
        ends[open_states[-1]] = True
        last = word
    close(0)
    return arcs, ends, 0


class Lexicon:
    """The transducer as arrays in one memory-mapped file, with the vocabulary behind it."""

    NAMES = ("keys", "next", "skip", "end", "at", "ids", "pairs", "bytes_at", "bytes", "first")

    @staticmethod
    def write(path: str, words: Iterable[bytes], vocabulary: Vocabulary) -> None:
        words = sorted(set(words))
        arcs, ends, root = minimal_automaton(words)
        below: dict[int, int] = {}
        stack = [root]
        while stack:  # words that end at or below each state
            state = stack[-1]
            todo = [t for t in arcs[state].values() if t not in below]
            if todo:
                stack.extend(todo)
            else:
                below[state] = ends[state] + sum(below[t] for t in arcs[state].values())
                stack.pop()
        number = {s: i for i, s in enumerate([root, *(s for s in below if s != root)])}
        rows = []
        for s, i in number.items():
            skip = int(ends[s])
            for c in sorted(arcs[s]):
                rows.append((i << 8 | c, number[arcs[s][c]], skip))
                skip += below[arcs[s][c]]
        rows.sort()
        ids = [vocabulary.merge(w) for w in words]
        top = max(vocabulary.by_id, default=-1) + 1
        spelled = [vocabulary.by_id.get(i, b"") for i in range(top)]
        arrays = {
            "keys": np.array([r[0] for r in rows], np.int64), "next": np.array([r[1] for r in rows], np.int32), "skip": np.array([r[2] for r in rows], np.int32),
            "end": np.array([ends[s] for s in number], np.uint8), "at": np.cumsum([0, *map(len, ids)]).astype(np.int64), "ids": np.array([x for y in ids for x in y], np.int32),
            "pairs": np.array([(a, b, r, m) for (a, b), (r, m) in vocabulary.merges.items()], np.int32).reshape(-1), "bytes_at": np.cumsum([0, *map(len, spelled)]).astype(np.int64),
            "bytes": np.frombuffer(b"".join(spelled), np.uint8), "first": np.array(vocabulary.first, np.int32),
        }
        head, place = {"special": vocabulary.special}, 0
        for name in Lexicon.NAMES:
            head[name] = [place, len(arrays[name]), arrays[name].dtype.str]
            place += -(-arrays[name].nbytes // 64) * 64
        raw = json.dumps(head).encode()
        with open(path, "wb") as f:
            f.write(len(raw).to_bytes(8, "little") + raw)
            base = -(-f.tell() // 64) * 64
            for name in Lexicon.NAMES:
                f.seek(base + head[name][0])
                f.write(arrays[name].tobytes())

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        base = -(-(8 + n) // 64) * 64
        mapped = np.memmap(path, np.uint8, "r")
        for name in self.NAMES:
            place, count, kind = head[name]
            size = count * np.dtype(kind).itemsize
            setattr(self, name, mapped[base + place : base + place + size].view(kind))
        self.special = head["special"]
        v = self.vocabulary = Vocabulary.__new__(Vocabulary)
        spelled, at = self.bytes.tobytes(), self.bytes_at.tolist()
        v.by_id = {i: spelled[at[i] : at[i + 1]] for i in range(len(at) - 1)}
        v.first, v.special, v._table = self.first.tolist(), self.special, None
        v.merges = {(a, b): (r, m) for a, b, r, m in self.pairs.reshape(-1, 4).tolist()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # by piece: its ids as text, and what they decode to
        self.spelled: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.held = 0

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word in the lexicon, or -1: all walk the automaton together, a byte at a time."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        text, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        state, index = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        live, step = np.flatnonzero(n > 0), 0
        while len(live):
            key = state[live] << 8 | text[start[live] + step]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            ok = self.keys[arc] == key
            state[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            state[live] = self.next[arc]
            index[live] += self.skip[arc]
            step += 1
            live = live[n[live] > step]
        found = (state >= 0) & (n > 0)
        found[found] = self.end[state[found]] > 0
        return np.where(found, index, -1)

    def learn(self, words: set[str]) -> None:
        """Enters pieces in the tables: from the lexicon, or merged."""
        todo = list(words)
        raw = [w.encode() for w in todo]
        found = self.find(raw).tolist()
        unseen = [i for i, at in enumerate(found) if at < 0]
        short = [i for i in unseen if len(raw[i]) <= 48]
        ids: list = [None] * len(todo)
        for i, x in zip(short, self.vocabulary.merge_many([raw[i] for i in short]), strict=True):
            ids[i] = x
        for i, (w, at) in enumerate(zip(todo, found, strict=True)):
            x = ids[i]
            if x is None:
                x = self.ids[self.at[at] : self.at[at + 1]].tolist() if at >= 0 else self.vocabulary.merge(raw[i])
            self.spelled[w] = ",".join(map(str, x))
            self.decoded[w] = self.decode(x)
            self.held += 2 * len(w) + len(self.spelled[w]) + 100

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.by_id.__getitem__, ids)).decode("utf-8", "replace")

    def cut_up(self, texts: list[str]) -> list[list[str]]:
        """Pieces and special tokens of each text in order; all of them are keys of the tables afterwards."""
        cut = []
        for text in texts:
            if self.cut is None or not any(s in text for s in self.special):
                cut.append(pieces(text))
            else:
                parts = self.cut.split(text)
                cut.append([w for p in parts for w in ([p] if p in self.special else pieces(p))])
        if self.held > MEMORY:
            self.spelled.clear()
            self.decoded.clear()
            self.held = 0
        new = set().union(*cut).difference(self.spelled)
        self.learn(new)
        for s in new & self.special.keys():
            self.spelled[s], self.decoded[s] = str(self.special[s]), s
        return cut


_open: dict[str, Lexicon] = {}


def lexicon(name: str) -> Lexicon:
    """The file that Spark brought here, mapped once a worker."""
    if name not in _open:
        from pyspark import SparkFiles

        _open.clear()
        _open[name] = Lexicon(SparkFiles.get(name))
    return _open[name]


def summed(counts: Counter, room: int) -> Counter:
    """Misra-Gries: over room, the count of the first that has no place is taken off all."""
    if len(counts) <= room:
        return counts
    least = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - room - 1)[len(counts) - room - 1])
    return Counter({w: c - least for w, c in counts.items() if c > least})


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent pieces over all texts, at most `words` of them."""

    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(pieces(text or ""))
                if len(counts) > 2 * SUMMARY:
                    counts = summed(counts, SUMMARY)
        top = summed(counts, SUMMARY)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(top), pa.string()), "n": pa.array(list(top.values()), pa.int64())})

    work = Work(docs.sparkSession, "bpe")
    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = work.table(counts.filter("n > 1"), "pieces")
    return [r.piece.encode() for r in most_frequent(counts, words).select("piece").collect()]


def compile_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """Counts, compiles and hands the lexicon to the executors; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    Lexicon.write(path, frequent_words(docs, words), Vocabulary.from_file(tokenizer))
    docs.sparkSession.sparkContext.addFile(path)
    return name


def public_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, tokenizer: str | None = None, words: int = LEXICON_WORDS, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    ship(docs.sparkSession)
    name = compile_lexicon(docs, tokenizer or public_file(), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, sha = lexicon(name), hashlib.sha256
        for whole in batches:
            texts = [t or "" for t in whole.column(1).to_pylist()]
            for part in portions(texts, PORTION):
                batch = whole.slice(part.start, part.stop - part.start)
                n, ids, sums, back = [], [], [], []
                for cut in lex.cut_up(texts[part]):
                    said = ",".join(map(lex.spelled.__getitem__, cut))
                    n.append(said.count(",") + 1 if said else 0)
                    sums.append(sha(said.encode()).hexdigest())
                    back.append(sha("".join(map(lex.decoded.__getitem__, cut)).encode()).hexdigest())
                    if with_ids:
                        ids.append(np.fromstring(said, np.int32, sep=",") if said else np.empty(0, np.int32))
                columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) to doc_id, text."""
    ship(encoded.sparkSession)
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    Lexicon.write(path, [], Vocabulary.from_file(tokenizer or public_file()))
    encoded.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(name)
        for batch in batches:
            texts = [lex.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of docs encoded."""
    return encode(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), with_ids=False)
