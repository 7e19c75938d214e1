"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_random = np.random.RandomState(20240229)
_BYTE = _random.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8: its powers differ in all but two bits
_PLACE = _random.randint(1, 2**63 - 1, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the number of words before each text (and in all)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    text = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[text]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    after = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    bounds = np.searchsorted(begins, starts)
    if not len(begins):
        return np.empty(0, np.uint64), bounds
    n = after - begins
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(n.max()), _STEP), dtype=np.uint64)
        letters = np.flatnonzero(~space)
        place = letters - np.repeat(begins, n)
        sums = np.add.reduceat(_BYTE[text[letters]] * powers[place], np.cumsum(n) - n)
        return mixed(sums ^ mixed(n.astype(np.uint64))), bounds


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words, of the whole sequence; without any, none."""
    hashes, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = len(hashes) - words + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(words):
            rolled += hashes[k : k + len(rolled)] * _PLACE[k]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield mixed((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[-(b - a)])
            else:
                yield rolled[:0]


def portions(texts: list[str | None], most: int = 4 << 20) -> Iterator[slice]:
    """Runs of texts of about `most` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))
