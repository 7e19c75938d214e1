"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base rules are fixed. The method adds cutoffs on further measures, chosen for each stratum from
labelled documents of good quality, the holdout. All cutoffs stand on one path fixed beforehand,
from lenient to strict; a document falls at the first step that rejects it, so what a longer path
rejects holds what a shorter one does. Step by step an exact binomial test asks whether the path so far,
all its rules together, rejects at most `risk` of the good documents of the stratum; the first
failure ends the path (fixed sequence: no further correction is needed within a stratum), and the
strata share the error `delta` (Bonferroni). A stratum gets its first step from
ln(delta / strata) / ln(1 - risk) good labels on; with fewer it keeps what passes the base rules.

Measures of a text are computed once, written, and read back; the tests depend on counts for
(stratum, step), a table whose size is the number of strata times the fixed list.

Defined cases: a null text has no words and fails the base rules; a null language is a stratum
of its own; documents without a label or with a null label do not count in the holdout; a
document labelled more than once counts once for each label; repeated rows count and are judged
each; a text of any length is measured whole; empty tables give empty results; further columns,
whatever their names, are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, SPACES, Work, documents, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Words in a window, and base limits.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Rules: name, measure, side (1: reject above the cutoff, -1: reject below it).
RULES = {
    "symbols": ("symbols_per_word", 1),
    "long_words": ("mean_word", 1),
    "short_words": ("mean_word", -1),
    "dup_lines": ("dup_lines_share", 1),
    "repeats": ("repeat_share", 1),
}
#: The path: rule and cutoff of each step.
PATH = [
    ("symbols", 2.0), ("long_words", 12.0), ("short_words", 1.5), ("dup_lines", 0.95),
    ("symbols", 1.0), ("long_words", 11.0), ("short_words", 2.0), ("dup_lines", 0.9),
    ("symbols", 0.5), ("long_words", 10.0), ("short_words", 2.5), ("dup_lines", 0.8),
    ("symbols", 0.3), ("long_words", 9.5), ("short_words", 3.0), ("dup_lines", 0.7),
    ("symbols", 0.2), ("long_words", 9.0), ("short_words", 3.25), ("dup_lines", 0.6),
    ("symbols", 0.1), ("long_words", 8.5), ("short_words", 3.5), ("dup_lines", 0.5), ("repeats", 0.19),
    ("long_words", 8.0), ("dup_lines", 0.4), ("repeats", 0.18), ("long_words", 7.5), ("repeats", 0.17), ("long_words", 7.0), ("repeats", 0.16),
]
RISK, DELTA = 0.02, 0.05


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five found twice or more.

    Windows are hashed to 64 bits. Texts without an equal pair, nearly all, need no more than that;
    in the others windows are ordered by hash, those with an equal neighbour give their places, and
    the places' stretches are summed without overlap.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda x, j: F.get(p, j)["h"].eqNullSafe(x["h"])
            hit = F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def length(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

        return bound(bound(pairs, places), length)

    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(
        bound(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def measured(docs: DataFrame) -> DataFrame:
    """docs with column _m: the measures of the whole text."""
    text = text_or_empty("text")
    word_chars = F.char_length(F.translate(text, SPACES, "")).cast("long")
    symbols = (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
    counts = bound(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    out = docs.withColumns({"_c": counts, "_l": duplicate_lines(text), "_wc": word_chars, "_sy": symbols})
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, repeat = F.col("_c.n_words"), F.col("_c.n_repeat_words")
    m = F.struct(
        n.alias("n_words"), F.col("_wc").alias("word_chars"), F.col("_sy").alias("n_symbols"), F.col("_l.dup").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)).alias("base_failed"),
        share(F.col("_sy"), n).alias("symbols_per_word"), share(F.col("_wc"), n).alias("mean_word"),
        share(F.col("_l.dup"), F.col("_l.lines")).alias("dup_lines_share"), share(repeat, n).alias("repeat_share"),
    )
    return out.withColumn("_m", m).drop("_c", "_l", "_wc", "_sy")


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) of Binomial(n, risk), summed in logarithms; 1 from the mean on, where no test can pass."""
    import math

    start = F.struct((n * math.log1p(-risk)).cast("double").alias("l"), F.exp(n * math.log1p(-risk)).alias("s"))
    odds = math.log(risk) - math.log1p(-risk)

    def add(acc: Column, i: Column) -> Column:
        term = acc["l"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("l"), (acc["s"] + F.exp(term)).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.aggregate(steps, start, add)["s"])


def first_step(m: Column) -> Column:
    """The first step of the path that rejects a document with measures m; null if none does."""
    out = None
    for i, (rule, cutoff) in enumerate(PATH):
        measure, side = RULES[rule]
        hit = F.lit(side) * (m[measure] - F.lit(cutoff)) > 0
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def admitted(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """measures (doc_id, stratum, _m) and labels (doc_id, quality) to the last admitted step of each stratum that has one: stratum, step, n, k.

    n good documents of the holdout pass the base rules; the path up to step rejects k of them.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    good = measures.join(good, "doc_id").filter(~F.col("_m.base_failed")).select("stratum", first_step(F.col("_m")).alias("first"))
    counts = good.groupBy("stratum", "first").agg(F.count(F.lit(1)).alias("c"))
    own = counts.groupBy("stratum").agg(F.sum("c").alias("n"), F.collect_list(F.struct("first", "c")).alias("falls"))
    own = own.withColumn("strata", F.count(F.lit(1)).over(W.partitionBy()))  # one row for each stratum
    steps = own.select("stratum", "n", "strata", "falls", F.explode(F.sequence(F.lit(0), F.lit(len(PATH) - 1))).alias("step"))
    k = F.aggregate(F.filter("falls", lambda x: x["first"] <= F.col("step")), F.lit(0).cast("long"), lambda s, x: s + x["c"])
    steps = steps.withColumn("k", k).withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk))
    passing = steps.withColumn("passing", F.min(F.col("p") <= delta / F.col("strata")).over(W.partitionBy("stratum").orderBy("step")))
    return passing.filter("passing").groupBy("stratum").agg(F.max(F.struct("step", "n", "k")).alias("last")).select("stratum", "last.*")


def judged(measures: DataFrame, found: DataFrame) -> DataFrame:
    """measures with column kept. found has at most one row for each stratum."""
    last = found.select(F.col("stratum").alias("_s"), F.col("step").alias("_step"))
    out = measures.join(last, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    failed = F.col("_m.base_failed") | F.coalesce(first_step(F.col("_m")) <= F.col("_step"), F.lit(False))
    return out.withColumn("kept", ~failed).drop("_s", "_step")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that pass, with the columns of docs, whatever their names."""
    work = Work(spark, "quality-stage")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = work.table(measured(docs.select(row, "text", F.col("doc_id").cast("long").alias("doc_id"), lang.alias("stratum"))).drop("text"), "measured")
    found = work.table(admitted(rows.select("doc_id", "stratum", "_m"), label_rows(spark, sf_dir)), "admitted")
    return judged(rows, found).filter("kept").select("row.*")


def rate(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs (doc_id, text, lang) to doc_id, _m, kept."""
    work = Work(docs.sparkSession, "quality")
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), "text")).drop("text")
    rows = work.table(rows, "measures")
    found = work.table(admitted(rows, labels, risk, delta), "admitted")
    return judged(rows, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate(documents(spark, sf_dir), label_rows(spark, sf_dir))
    return out.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", "_m.base_failed", "kept")


def _first_sql() -> str:
    return "CASE " + " ".join(f"WHEN {RULES[rule][1]} * ({RULES[rule][0]} - CAST({cutoff} AS DOUBLE)) > 0 THEN {i}" for i, (rule, cutoff) in enumerate(PATH)) + " END"


def kept_sql(docs: str, labels: str = "labels") -> str:
    """DuckDB SQL for rate() over a relation (doc_id, text, lang)."""
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"
    return rf"""
WITH d AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS r
  FROM {docs}),
wi AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, key) AS c
  FROM (SELECT r, i, list_slice(w, i, i + 4) AS key FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, unnest(range(0, 5)) AS k FROM wi WHERE c > 1) GROUP BY r),
m0 AS (
  SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {share("n_symbols", "n_words")} AS symbols_per_word,
         {share("word_chars", "n_words")} AS mean_word, {share("n_dup_lines", "lines")} AS dup_lines_share, {share("n_repeat_words", "n_words")} AS repeat_share
  FROM m0),
f AS (SELECT *, {_first_sql()} AS first_step FROM m),
g AS (SELECT stratum, first_step FROM f JOIN {labels} USING (doc_id) WHERE quality = 1 AND NOT base_failed),
n AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM g GROUP BY stratum),
c AS (
  SELECT n.stratum, n.n, n.strata, step, (SELECT count(*) FROM g WHERE g.stratum IS NOT DISTINCT FROM n.stratum AND first_step <= step) AS k
  FROM n, range({len(PATH)}) AS s(step)),
p AS (
  SELECT *, CASE WHEN k >= n * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) END AS p FROM c),
a AS (SELECT *, bool_and(p <= {DELTA} / strata) OVER (PARTITION BY stratum ORDER BY step) AS admitted FROM p),
best AS (SELECT stratum, max(step) AS step FROM a WHERE admitted GROUP BY stratum)
SELECT f.*, NOT (base_failed OR coalesce(first_step <= best.step, false)) AS kept
FROM f LEFT JOIN best ON f.stratum IS NOT DISTINCT FROM best.stratum
"""


ORACLE = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({kept_sql('documents')})"
