"""Language ID by Bayesian evidence fusion.

For each page the posterior over languages is proportional to
P(text | language) x P(declared | language) x P(suffix | language) x P(language | host).

* Text: byte trigrams, naive Bayes. Counts come from labelled texts, at most TRAIN_ROWS of them,
  chosen by a hash of their identifiers (a documented bound on labelled rows).
  Trigrams of a text depend on one another, so its evidence is raised to a power below one.
* Declared markup language and address suffix (a language code in the path, or the domain's last
  label): tables of soft counts over all pages, by grouped aggregation of text posteriors.
* Host: soft counts of the host, shrunk to those of its domain, and those to all pages
  (hierarchical smoothing). A page's own part is taken out of its host's counts.

Grouped sums have partial aggregation, so a host with a third of all pages costs no single task,
and its join may be split.

Defined cases: null or empty html, unknown or missing declarations and addresses give no evidence
of their kind; a page without any evidence gets the commonest language; repeated rows give
repeated rows; a null page_id stays null; without labelled texts the result is empty of languages
(null) with probability 0; texts of any length are read whole; of languages with the same
posterior the first by name counts; empty tables give empty results; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Work, documents, ship

TRAIN_ROWS = 4_000
#: Trigrams are numbers below this one.
EMPTY = 1 << 16
POWER = 0.25
#: Pseudo-counts of a table's cell, a domain against all pages, a host against its domain.
CELL, TO_ALL, TO_DOMAIN = 1.0, 5.0, 5.0
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)|&#?\w+;", re.S | re.I)
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def trigrams(text: str) -> np.ndarray:
    """Numbers below 2^16 of the byte trigrams of lower-cased letters; all else is one space."""
    b = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((b[:-2] * 2_654_435_761 ^ b[1:-1] * 40_503 * 257 ^ b[2:] * 97) * np.uint32(2_246_822_519)) >> 16 if len(b) > 2 else np.empty(0, np.uint32)


class Letters:
    """Naive Bayes tables: languages, ln P(trigram | language), from texts (language, text)."""

    def __init__(self, rows: list[tuple[str, str]]):
        self._fill([(lang, int(t), 1) for lang, text in rows for t in [EMPTY, *trigrams(text)]])

    @classmethod
    def of_counts(cls, found: list[tuple[str, int, int]]) -> Letters:
        """From counts (language, trigram, n); the trigram EMPTY stands for a text, which may have none."""
        out = cls([])
        out._fill(found)
        return out

    def _fill(self, found: list[tuple[str, int, int]]) -> None:
        self.languages = sorted({lang for lang, *_ in found})
        number = {lang: i for i, lang in enumerate(self.languages)}
        counts = np.full((len(self.languages), EMPTY + 1), 0.5)
        for lang, trigram, n in found:
            counts[number[lang], trigram] += n
        counts = counts[:, :EMPTY]
        self.table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).T.copy() if self.languages else np.zeros((EMPTY, 0), np.float32)

    def score(self, text: str) -> np.ndarray:
        return self.table[trigrams(text)].sum(axis=0, dtype=np.float64)


def sample(labelled: DataFrame, rows: int, total: int) -> DataFrame:
    """About nine tenths of `rows` of `total` labelled texts, chosen by a hash of identifier and text, and never more than `rows`."""
    place = F.xxhash64("doc_id", "text").cast("double") / 2.0**64 + 0.5  # evenly from 0 to 1
    return labelled.filter(place < 0.9 * rows / total).limit(rows)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Letters:
    """labelled (doc_id, text, lang): fits on about `rows` labelled texts, and no more, chosen by hash.

    The share is set by a count of labels (which reads no text). Tasks count the sample's trigrams, so the driver sees 65,536 numbers a language
    at the most, however long the texts.
    """
    some = labelled.filter("lang is not null")
    n = some.count()
    if n > rows:
        some = sample(some, rows, n)
    ship(labelled.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(trigrams(text), minlength=EMPTY)
                sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, counts in sums.items():
            met = np.append(np.flatnonzero(counts), EMPTY)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met)), pa.array(met.astype(np.int32)), pa.array(np.append(counts, 1)[met])], names=["lang", "trigram", "n"])

    found = some.filter("text is not null").select(F.lower("lang").alias("lang"), F.col("text").cast("string")).mapInArrow(counted, "lang string, trigram int, n long")
    found = found.groupBy("lang", "trigram").agg(F.sum("n").alias("n")).collect()
    if n > rows and not found:
        raise ValueError(f"none of {n} labelled rows was drawn with a text: train on rows that have one")
    return Letters.of_counts([tuple(r) for r in found])


def suffix_of(url: Column) -> Column:
    path = F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1)), F.lit(""))
    return F.coalesce(path, F.nullif(F.element_at(F.split(host_of(url), r"\."), -1), F.lit("")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def language_id(pages: DataFrame, letters: Letters, power: float = POWER) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, host, declared, suffix, lang, probability, text_lang."""
    spark = pages.sparkSession
    ship(spark)
    languages = letters.languages
    if not languages:
        return pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [letters.score(MARKUP.sub(" ", h or "")) for h in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tolist() for s in scores], pa.list_(pa.float64()))], names=["page_id", "url", "declared", "score"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.nullif(F.lower(F.regexp_extract("html", DECLARED, 1)), F.lit("")).alias("declared"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(run, "page_id long, url string, declared string, score array<double>")
    host = host_of(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("suffix", suffix_of(F.col("url")))
    rows = rows.withColumn("domain", F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), "."))
    # the text's own posterior, under equal priors
    soft = F.transform("score", lambda x: F.exp(power * (x - F.array_max("score"))))
    rows = rows.withColumn("soft", soft).withColumn("soft", F.transform("soft", lambda x: x / F.aggregate("soft", F.lit(0.0), lambda s, y: s + y)))
    rows = Work(spark, "language-id").table(rows, "scored")

    each = range(len(languages))
    sums = [F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in each]
    as_array = F.array(*[F.col(f"s{i}") for i in each])
    whole = rows.agg(*sums).select(as_array.alias("all")).first()["all"] or [0.0] * len(languages)
    prior = [(x if x is not None else 0.0) + CELL for x in whole]
    prior = [x / sum(prior) for x in prior]
    known = [(x or 0.0) for x in whole]

    def likelihood(column: str) -> DataFrame:
        """ln P(value | language) for the values of a column; values are few, but the join does not rely on it."""
        counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(*sums)
        total = rows.filter(F.col(column).isNotNull()).select(column).distinct().count() + 1
        return counts.select(column, F.array(*[F.log((F.col(f"s{i}") + CELL) / (known[i] + CELL * total)) for i in each]).alias(f"{column}_l"))

    domains = rows.groupBy("domain").agg(*sums).select("domain", as_array.alias("domain_n"))
    hosts = rows.groupBy("host").agg(*sums).select("host", as_array.alias("host_n"))
    out = rows.join(hosts, "host").join(domains, "domain").join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
    total_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    less = lambda a: F.zip_with(a, "soft", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    out = out.withColumn("domain_n", less(F.col("domain_n"))).withColumn("host_n", less(F.col("host_n")))
    base = F.array(*[F.lit(p) for p in prior])
    out = out.withColumn("domain_p", F.zip_with("domain_n", base, lambda n, p: (n + TO_ALL * p) / (total_of(F.col("domain_n")) + TO_ALL)))
    out = out.withColumn("host_p", F.zip_with("host_n", "domain_p", lambda n, p: (n + TO_DOMAIN * p) / (total_of(F.col("host_n")) + TO_DOMAIN)))
    part = lambda name, i: F.coalesce(F.get(name, F.lit(i)), F.lit(0.0))
    logs = F.array(*[power * F.get("score", F.lit(i)) + part("declared_l", i) + part("suffix_l", i) + F.log(F.get("host_p", F.lit(i))) for i in each])
    out = out.withColumn("logs", logs).withColumn("p", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    out = out.withColumn("p", F.transform("p", lambda x: x / total_of(F.col("p"))))
    name = lambda a: F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(a, F.array_max(a)).cast("int"))
    return out.select("page_id", "url", "host", "declared", "suffix", name(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), name(F.col("score")).alias("text_lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(documents(spark, sf_dir)))
