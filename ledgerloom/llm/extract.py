"""HTML extraction by a tree-structured graphical model over the DOM.

Every block element and every run of text between block boundaries is a node with two states:
main text (or holding some) and other. The model is a tree of conditional tables: a prior for the
root, parent-child potentials P(child and its kind | parent) (the kind is an element's tag, or a
text's enclosing tag and share of link text), and what a state lets one see of a node besides
(words of class, id and role; whether a text is long). All tables are smoothed counts over
labelled pages. Sum-product messages run from the leaves to the root and back and give each node's marginal
exactly; texts with a marginal of one half or more are the page's text.

The number of labelled pages is a parameter of training; every page is extracted whole, however
deep or long: messages pass along arrays, not by recursion.

Defined cases: null and empty html give the empty text; repeated rows give repeated rows; a null
page_id or url stays null; an empty table gives an empty result; further columns are ignored.
Broken markup is read as browsers do in the main: unknown end tags are skipped, open elements end
with their parents, a tag cut off by the end of the page is dropped. Options, buttons, embedded
objects and the like are never main text; one without an end tag ends with its parent, too. Only
scripts, styles, text areas and titles run to the end of the page where they are not closed.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages
from .shared import ship

# Element names of the HTML standard: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object head title textarea select option button".split())
#: Elements of RAW whose content is text alone in any place.
TEXT_ALONE = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
#: An element of the first kind ends open ones of the second, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Page:
    """Nodes in page order, parents first: parent, features, text (elements: None), label.

    Beside the open elements stand the places of each tag and of the blocks among them, so that
    neither text nor end tags look through all that is open.
    """

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.features: list[tuple] = [("tag=#page",)]
        self.text: list[str | None] = [None]
        self.label: list[bool | None] = [None]
        self._open: list[tuple[str, int, bool | None]] = [("#page", 0, None)]
        self._places: dict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = [0]
        self._fences: list[int] = []  # elements of RAW, options apart
        self._run: list[str] = []
        self._linked = self._in_link = self._muted = 0
        self._unclosed: set[str] = set()
        self._read(source)

    def _flush(self) -> None:
        if not self._run:
            return
        text = " ".join("".join(self._run).split())
        self._run = []
        if text:
            tag, node, label = self._open[self._blocks[-1]]
            links = min(1.0, self._linked / len(text))
            self.parent.append(node)
            linked = 0 if links == 0 else 1 if links < 0.3 else 2 if links < 0.8 else 3
            self.features.append((f"in={tag} {linked}", f"long={len(text) > 200}"))
            self.text.append(text)
            self.label.append(label)
        self._linked = 0

    def _say(self, text: str) -> None:
        if text and not self._muted:
            self._run.append(text)
            if self._in_link:
                self._linked += len(text.strip())

    def _start(self, tag: str, attributes: str) -> None:
        label, names = self._open[-1][2], set()
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                if key.lower() == "data-label":
                    label = value == "content"
                else:
                    names.update(NAME_WORD.findall(value.lower()))
        self._places[tag].append(len(self._open))
        if tag in RAW and tag != "option":
            self._fences.append(len(self._open))
        if tag in BLOCK and not self._muted:
            self._flush()
            self.parent.append(self._open[self._blocks[-1]][1])
            self.features.append((f"tag={tag}{'' if names else ' alone'}", *(f"name={x}" for x in names)))
            self.text.append(None)
            self.label.append(label)
            self._blocks.append(len(self._open))
            self._open.append((tag, len(self.parent) - 1, label))
        else:
            self._in_link += tag == "a"
            self._muted += tag in RAW
            self._open.append((tag, -1, label))

    def _pop_to(self, depth: int) -> None:
        """Ends all open elements from a place on, outer ones first."""
        for tag, node, _ in self._open[depth:]:
            if node >= 0:
                self._flush()
            self._in_link -= tag == "a"
            self._muted -= tag in RAW
        for tag, _, _ in reversed(self._open[depth:]):
            self._places[tag].pop()
        while self._blocks[-1] >= depth:
            self._blocks.pop()
        while self._fences and self._fences[-1] >= depth:
            self._fences.pop()
        del self._open[depth:]

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self._places.get(t))), default=0)

    def _end_open(self, kinds: Iterable[str], fence: Iterable[str]) -> None:
        """Ends open elements of some kinds up to the nearest of fence; embedded objects and the like are fences, too."""
        while at := self._last(kinds):
            if at < max(self._last(fence), self._fences[-1] if self._fences and self._open[self._fences[-1]][0] not in kinds else 0):
                return
            self._pop_to(at)

    def _end_of(self, tag: str, source: str, at: int) -> re.Match | None:
        """The next end tag; none is looked for again where there was none."""
        if tag in self._unclosed:
            return None
        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
        if end is None:
            self._unclosed.add(tag)
        return end

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self._say(entities.unescape(source[at:]))
                break
            if m.start() > at:
                self._say(entities.unescape(source[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                depth = self._last(HEADINGS if tag in HEADINGS else (tag,))
                if depth:
                    self._pop_to(depth)
                continue
            if tag in RAW:
                if tag not in ("option", "button", "select"):
                    self._say(" ")
                if m[3].endswith("/"):
                    continue
                end = self._end_of(tag, source, at) if tag in TEXT_ALONE or tag in ("head", "iframe", "noscript") else None
                if end:
                    at = end.end()
                elif tag in TEXT_ALONE:
                    at = n
                elif tag == "head":
                    end = re.compile(r"<body\b", re.I).search(source, at)
                    at = end.start() if end else at
                else:
                    if tag in ENDS:
                        self._end_open(*ENDS[tag])
                    self._start(tag, m[3])
                continue
            if tag in VOID:
                self._say(" ")
                if tag == "hr" and not self._muted:
                    self._flush()
                continue
            if tag in CLOSES_P:
                self._end_open({"p"}, {"td", "th", "table", "button"})
            if tag in ENDS:
                self._end_open(*ENDS[tag])
            if tag == "a" and self._in_link:
                self._end_open({"a"}, BLOCK)
            self._start(tag, m[3])
        self._flush()


class Model:
    """Tables of log probabilities; index 1: main text."""

    def __init__(self, pages: Iterable[str], smooth: float = 0.5):
        seen = [Counter(), Counter()]
        totals: list[Counter] = [Counter(), Counter()]
        steps: dict[str, list[list[float]]] = {}
        names: set[str] = set()
        number = [0, 0]
        for source in pages:
            page = Page(source)
            state = [bool(x) if page.text[i] is not None else False for i, x in enumerate(page.label)]
            for i in range(len(state) - 1, 0, -1):  # an element is main text if it holds some
                if state[i]:
                    state[page.parent[i]] = True
            for i, s in enumerate(state):
                if i:
                    for kind in (page.features[i][0], page.features[i][0].partition("=")[0]):
                        steps.setdefault(kind, [[0.0, 0.0], [0.0, 0.0]])[state[page.parent[i]]][s] += 1
                number[s] += page.text[i] is None
                for f in page.features[i][1:]:
                    kind = f.partition("=")[0]
                    seen[s][f] += 1
                    totals[s][kind] += 1
                    if kind == "name":
                        names.add(f)
        values = Counter(f.partition("=")[0] for f in {*seen[0], *seen[1]})
        self.odds: dict[str, float] = {}
        for f in {*seen[0], *seen[1]}:
            kind = f.partition("=")[0]
            if kind == "name":  # present or not in an element of each state
                p = [(seen[s][f] + smooth) / (number[s] + 2 * smooth) for s in (0, 1)]
            else:
                p = [(seen[s][f] + smooth) / (totals[s][kind] + smooth * (values[kind] + 1)) for s in (0, 1)]
            self.odds[f] = math.log(p[1] / p[0])
        kinds = Counter(kind.partition("=")[0] for kind in steps if "=" in kind)
        general = {kind: [[(x + smooth) / (sum(row) + 2 * smooth) for x in row] for row in steps.get(kind, [[0.0, 0.0], [0.0, 0.0]])] for kind in ("tag", "in")}
        self.steps = dict(general)
        for kind, table in steps.items():
            if "=" in kind:
                family = kind.partition("=")[0]
                whole = [sum(row) + smooth * (kinds[family] + 1) for row in steps[family]]
                self.steps[kind] = [[(table[s][x] + smooth * general[family][s][x]) / whole[s] for x in (0, 1)] for s in (0, 1)]

    def step(self, features: tuple) -> list[list[float]]:
        """P(child and its kind | parent); of a kind that training hasn't seen, P(child | parent)."""
        return self.steps.get(features[0]) or self.steps[features[0].partition("=")[0]]

    def marginals(self, page: Page) -> list[float]:
        """P(main text) of each node: messages up, then down."""
        n, parent = len(page.parent), page.parent
        up = [[1.0, 1.0] for _ in range(n)]  # evidence at and below a node, for each of its states
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, -1, -1):
            o = sum(self.odds.get(f, 0.0) for f in page.features[i][1:])
            o = max(-30.0, min(30.0, o))
            x, y = up[i][0], up[i][1] * math.exp(o)
            total = x + y
            up[i] = [x / total, y / total]
            if i:
                t = self.step(page.features[i])
                a = t[0][0] * up[i][0] + t[0][1] * up[i][1]
                b = t[1][0] * up[i][0] + t[1][1] * up[i][1]
                sent[i] = (a, b)
                p = up[parent[i]]
                p[0] *= a
                p[1] *= b
                if p[0] + p[1] < 1e-100:
                    p[0], p[1] = p[0] * 1e100, p[1] * 1e100
        out = [up[0][1]] * n
        full = [up[0]] + [None] * (n - 1)
        for i in range(1, n):
            x, y = full[parent[i]]
            a, b = x / max(sent[i][0], 1e-300), y / max(sent[i][1], 1e-300)
            t = self.step(page.features[i])
            p, q = up[i][0] * (a * t[0][0] + b * t[1][0]), up[i][1] * (a * t[0][1] + b * t[1][1])
            total = p + q
            full[i] = [p / total, q / total]
            out[i] = full[i][1]
        return out

    def extract(self, source: str | None) -> list[str]:
        """The blocks of main text, in page order."""
        if not source:
            return []
        page = Page(source)
        return [t for t, p in zip(page.text, self.marginals(page), strict=True) if t is not None and p >= 0.5]


@lru_cache(maxsize=2)
def default_model(n: int = 600) -> Model:
    return Model(labelled_pages(n))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text, n_chars, blocks."""
    ship(pages.sparkSession)
    found = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [found.extract(h) for h in batch.column(2).to_pylist()]
            text = ["\n\n".join(b) for b in blocks]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array(list(map(len, text)), pa.int64()), "blocks": pa.array(blocks, pa.list_(pa.string()))})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, blocks array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("blocks")
