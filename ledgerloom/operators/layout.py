"""From positioned words to logical lines: column split, line clustering, header anchors.

Everything is grouped by page, so pages are laid out independently of one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["statement_id", "page"]
LEAST_GAP, WIDE_PAGE, LINE_TOLERANCE, COLUMN_TOLERANCE = 22.0, 640.0, 3.5, 16.0
# Column headers of the report: fixed values.
HEADERS = ["CARGOS", "ABONOS", "SALDO", "IMPUESTO", "MONTO"]


def _split(xs: Column, width: Column) -> Column:
    """Where a page of a width parts, whose words start at the sorted xs."""
    inner = lambda x: (x >= width * 0.25) & (x <= width * 0.75)
    best = F.aggregate(
        F.filter(xs, inner), F.struct(F.lit(0.0).alias("gap"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("last")),
        lambda s, x: F.when(x - s["last"] > s["gap"], F.struct((x - s["last"]).alias("gap"), ((s["last"] + x) / 2).alias("at"), x.alias("last"))).otherwise(F.struct(s["gap"].alias("gap"), s["at"].alias("at"), x.alias("last"))),
    )
    by_width = F.when((width > WIDE_PAGE) & (F.size(xs) >= 2), width / 2).otherwise(width + 1)
    return F.aggregate(F.array(best), F.lit(None).cast("double"), lambda _, g: F.when(g["gap"] >= LEAST_GAP, g["at"]).otherwise(by_width))


def column_split(words: DataFrame) -> DataFrame:
    """statement_id, page, width, split: the middle of the widest gap between starts of words in the page's middle half.

    A gap under LEAST_GAP doesn't count: then wide pages are halved and narrow ones stay whole (a split beyond the width).
    """
    pages = words.groupBy(*PAGE).agg(F.max("page_width").alias("width"), F.sort_array(F.collect_list("x0")).alias("xs"))
    return pages.select(*PAGE, "width", _split(F.col("xs"), F.col("width")).alias("split"))


def sided(words: DataFrame, splits: DataFrame | None) -> DataFrame:
    """words with side (L or R) and side_x0; without splits all are left. Words beyond the page are dropped."""
    if splits is None:
        return words.withColumn("side", F.lit("L")).withColumn("side_x0", F.lit(0.0))
    x = F.col("x0")
    out = words.join(splits, PAGE).withColumn("side", F.when((x >= 0) & (x < F.col("split")), "L").when((x >= F.col("split")) & (x < F.col("width") + 1), "R"))
    return out.filter("side is not null").withColumn("side_x0", F.when(F.col("side") == "R", F.col("split")).otherwise(F.lit(0.0)))


#: Fields of a word as it is gathered, by height; and of what words of a line are ordered by.
GATHERED, BY_EDGE = ["y0", "x0", "x1", "y1", "text"], ["x0", "y0", "x1", "y1", "text"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.aggregate(F.array(F.lit(0)), value, lambda a, _: a, use)


def line_starts(ys: Column) -> Column:
    """Heights at which lines begin, of heights in order: a word belongs to a line within the tolerance of its FIRST word. A missing height is a line's."""
    return F.aggregate(ys, F.array().cast("array<double>"), lambda s, y: F.when((F.size(s) == 0) | F.get(s, F.size(s) - 1).isNull() | (y - F.get(s, F.size(s) - 1) > LINE_TOLERANCE), F.concat(s, F.array(y))).otherwise(s))


def folded(tokens: Column) -> Column:
    """Words (fields as in GATHERED) to lines, in order: array of (line_no, y, tokens), tokens by left edge. Words without a height make line 0.

    Words are sorted by height, distinct heights are folded into line starts, and each line is cut out. A line of one height is in order already.
    """
    fields = lambda t, names: F.struct(*[t[x].alias(x) for x in names])
    resorted = lambda line: F.transform(F.sort_array(F.transform(line, lambda t: fields(t, BY_EDGE))), lambda t: fields(t, GATHERED))
    level = lambda line: F.get(line, F.lit(0))["y0"].eqNullSafe(F.get(line, F.size(line) - 1)["y0"])
    ordered = lambda line: F.when(level(line), line).otherwise(resorted(line))

    def cut(words: Column, ys: Column, starts: Column, at: Column) -> Column:
        line = lambda a, i: F.slice(words, a, F.coalesce(F.get(at, i + 1), F.size(ys) + 1).cast("int") - a)
        return F.transform(at, lambda a, i: F.struct((i + F.when(F.get(starts, F.lit(0)).isNull(), 0).otherwise(1)).alias("line_no"), F.get(starts, i).alias("y"), _let(line(a.cast("int"), i), ordered).alias("tokens")))

    places = lambda words, ys, starts: _let(F.transform(starts, lambda y: F.coalesce(F.array_position(ys, y), F.lit(1).cast("long"))), lambda at: cut(words, ys, starts, at))
    return _let(F.sort_array(tokens), lambda words: _let(words["y0"], lambda ys: _let(line_starts(F.array_distinct(ys)), lambda starts: places(words, ys, starts))))


def worded(lines: DataFrame) -> DataFrame:
    """lines with words and text."""
    return lines.withColumn("words", F.col("tokens.text")).withColumn("text", F.array_join("words", " "))


def column_lines(columns: DataFrame) -> DataFrame:
    """Columns of pages (statement_id, page, side, side_x0, tokens as in GATHERED) to lines, each where it lies: nothing is shuffled."""
    each = columns.select(*PAGE, "side", "side_x0", F.explode(folded(F.col("tokens"))).alias("line"))
    return worded(each.select(*PAGE, "side", "line.line_no", "line.y", "side_x0", "line.tokens"))


def cluster_lines(words: DataFrame) -> DataFrame:
    """words (with side) to lines: statement_id, page, side, line_no, y, side_x0, tokens by x0, words, text.

    A column's words are gathered once and folded into lines where they lie. The words are shuffled once.
    """
    return column_lines(words.groupBy(*PAGE, "side").agg(F.first("side_x0").alias("side_x0"), F.collect_list(F.struct(*GATHERED)).alias("tokens")))


def paged(words: DataFrame) -> DataFrame:
    """Words to pages: statement_id, page, width, split, and the lines of both columns (left, right: as folded). Words beyond the page are dropped.

    A page's words are gathered once, and not shuffled at all if they come dealt by statement; all else is done where they lie.
    """
    pages = words.dropna(subset=PAGE).groupBy(*PAGE).agg(F.max("page_width").alias("width"), F.collect_list(F.struct(*GATHERED)).alias("tokens"))
    pages = pages.withColumn("split", _split(F.sort_array(F.array_compact("tokens.x0")), F.col("width")))
    left, right = (lambda t: (t["x0"] >= 0) & (t["x0"] < F.col("split"))), (lambda t: (t["x0"] >= F.col("split")) & (t["x0"] < F.col("width") + 1))
    return pages.select(*PAGE, "width", "split", folded(F.filter("tokens", left)).alias("left"), folded(F.filter("tokens", right)).alias("right"))


def page_lines(words: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(s).alias("side"), x.cast("double").alias("side_x0"), F.col(name).alias("lines")) for s, x, name in (("L", F.lit(0.0), "left"), ("R", F.col("split"), "right"))])
    each = paged(words).select(*PAGE, F.inline(sides)).select(*PAGE, "side", "side_x0", F.explode("lines").alias("line"))
    return worded(each.select(*PAGE, "side", "line.line_no", "line.y", "side_x0", "line.tokens"))


def has(*names: str, words: Column | str = "words") -> Column:
    out = F.lit(True)
    for name in names:
        out = out & F.array_contains(words, name)
    return out


def anchors(tokens: Column) -> Column:
    """Right edges of header words, in order: array of (name, x)."""
    return F.transform(F.filter(tokens, lambda t: t["text"].isin(HEADERS)), lambda t: F.struct(t["text"].alias("name"), (t["x1"] + 2.0).alias("x")))


def anchor(found: Column, name: str) -> Column:
    return F.get(F.reverse(F.filter(found, lambda a: a["name"] == name)), F.lit(0))["x"]


def nearest(found: Column, x: Column) -> Column:
    """Name of the anchor closest to x, within the tolerance; the first of equals."""
    near = F.filter(F.transform(found, lambda a, i: F.struct(F.abs(x - a["x"]).alias("far"), i.alias("i"), a["name"].alias("name"))), lambda a: a["far"] < COLUMN_TOLERANCE)
    return F.array_min(near)["name"]
