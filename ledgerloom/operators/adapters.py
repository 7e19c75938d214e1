"""Adapters of report layouts: each says which statements it can read, and reads them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segment


class BadStatement(ValueError):
    """What an adapter raises for statements that it can't read; with their ids, the others are read without them."""

    def __init__(self, reason: str, statement_ids: tuple[int, ...] = ()):
        super().__init__(reason)
        self.statement_ids = tuple(statement_ids)


@dataclass(frozen=True)
class Adapter:
    name: str
    display_name: str
    detect: Callable[[DataFrame], DataFrame]  # words to (statement_id, supported)
    parse: Callable[..., segment.Parsed]  # words, and how to keep frames that are read several times (see segment.parse)


REGISTRY: list[Adapter] = [Adapter("mercantil-corriente", "Mercantil - Cuenta Corriente", segment.detect, segment.parse)]


def banks(registry: list[Adapter] | None = None) -> list[dict[str, str]]:
    """Name and title of each layout that can be read."""
    return [{"name": a.name, "title": a.display_name} for a in (REGISTRY if registry is None else registry)]


def assigned(words: DataFrame, registry: list[Adapter] | None = None) -> DataFrame:
    """statement_id, adapter: the first that supports the statement; null for unsupported ones."""
    adapters = REGISTRY if registry is None else registry
    out = words.select("statement_id").distinct().withColumn("adapter", F.lit(None).cast("string"))
    for a in adapters:
        hit = a.detect(words).filter("supported").select("statement_id", F.lit(a.name).alias("_a"))
        out = out.join(hit, "statement_id", "left").withColumn("adapter", F.coalesce("adapter", "_a")).drop("_a")
    return out


def parse_all(words: DataFrame, registry: list[Adapter] | None = None) -> tuple[dict[str, segment.Parsed], DataFrame]:
    """Each adapter's statements parsed, and the ids of those that none supports (status error, not an exception)."""
    adapters = REGISTRY if registry is None else registry
    found = assigned(words, adapters)
    parsed = {a.name: a.parse(words.join(found.filter(F.col("adapter") == a.name).select("statement_id"), "statement_id", "left_semi")) for a in adapters}
    return parsed, found.filter("adapter is null").select("statement_id", F.lit("error").alias("status"), F.lit("unsupported format").alias("error"))
