"""Stored tables: loads of files, and snapshots that say which of them count.

    root/<table>/load=<id>/                   a load's rows; of operations in folders by month, in files sorted by day
    root/hidden/load=<id>/                    (load, statement_id): earlier rows of the statements that load <id> replaced or removed
    root/snapshots/<version>.json             the loads that count, their tables and months, how many of their statements are hidden

A load is written first and counts from the moment when its snapshot gets its name, which a rename does at
once or not at all: a writer that dies leaves files that nobody reads (`vacuum` removes them), and a
second writer that was as fast is told so. Readers take the list of loads from one snapshot. A frame for some
months lists the loads that have them and reads those folders alone; for one statement, its load
alone. Only loads with hidden statements are joined to the hidden ones; a load all of whose statements are
hidden leaves the list. `compact` writes what counts as one load, in the same folder.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from .tables import with_defaults

KEYED = [name for name, schema in TABLES.items() if schema.startswith("statement_id")]


class Conflict(RuntimeError):
    """Another writer made the next snapshot first."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, system = _path(spark, name)
    return system.exists(path)


def delete(spark: SparkSession, name: str) -> None:
    path, system = _path(spark, name)
    system.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    path, system = _path(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []


def write_text(spark: SparkSession, name: str, text: str) -> None:
    path, system = _path(spark, name)
    out = system.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, name: str) -> str:
    path, system = _path(spark, name)
    source = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


@dataclass
class Entry:
    """A load in a snapshot."""

    tables: list[str] = field(default_factory=list)
    months: list[int] = field(default_factory=list)
    statements: int = 0
    hidden: int = 0


@dataclass
class Snapshot:
    version: int = 0
    loads: dict[int, Entry] = field(default_factory=dict)
    hidden: list[int] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps({"loads": {str(k): vars(e) for k, e in self.loads.items()}, "hidden": self.hidden})


def current(spark: SparkSession, root: str) -> Snapshot:
    """The last snapshot; an empty one where nothing was stored yet."""
    versions = [int(n[:-5]) for n in names(spark, f"{root}/snapshots") if n.endswith(".json") and n[:-5].isdigit()]
    if not versions:
        return Snapshot()
    found = json.loads(read_text(spark, f"{root}/snapshots/{max(versions):012d}.json"))
    return Snapshot(max(versions), {int(k): Entry(**e) for k, e in found["loads"].items()}, found["hidden"])


def publish(spark: SparkSession, root: str, snapshot: Snapshot) -> None:
    """Makes the snapshot the current one, if its version is still free."""
    name = f"{root}/snapshots/{snapshot.version:012d}.json"
    draft = f"{root}/snapshots/_{snapshot.version:012d}-{time.time_ns()}"
    write_text(spark, draft, snapshot.text())
    source, system = _path(spark, draft)
    target, _ = _path(spark, name)
    if system.exists(target) or not system.rename(source, target):
        system.delete(source, False)
        raise Conflict(f"snapshot {snapshot.version} of {root} was made by another writer")


def month_of(day: Column) -> Column:
    """yyyymm, 0 for an unknown day."""
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(0)).cast("int")


def months_between(first: date | None, last: date | None, there: Iterable[int]) -> list[int]:
    """Those of the months there that hold a day from first to last."""
    low = first.year * 100 + first.month if first else 1
    high = last.year * 100 + last.month if last else 999_999
    return sorted(m for m in set(there) if low <= m <= high)


def _scan(spark: SparkSession, root: str, name: str, loads: list[int], months: dict[int, list[int]] | None = None) -> DataFrame:
    """A table's rows in some loads, hidden ones too; months: for each load those whose folders are read."""
    schema = f"{TABLES[name]}, load long" + (", month int" if name == "operations" else "")
    folders = [f"load={x}" for x in loads] if months is None else [f"load={x}/month={m}" for x in loads for m in months[x]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/{f}" for f in folders])


def hidden(spark: SparkSession, root: str, snapshot: Snapshot, loads: list[int]) -> DataFrame:
    """(load, statement_id) of the hidden rows of some loads."""
    rows = spark.read.schema("of_load long, statement_id long, load long").option("basePath", f"{root}/hidden").parquet(*[f"{root}/hidden/load={x}" for x in snapshot.hidden])
    return rows.filter(F.col("of_load").isin(loads)).select(F.col("of_load").alias("load"), "statement_id")


def scan(spark: SparkSession, root: str, name: str, first: date | None = None, last: date | None = None, statement_id: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
    """The rows of a table that count, with their load (operations with their month): of some months, or of one statement, or all.

    days, labels and grams have no statements: `clean` and `dirty` tell which loads they stand for whole.
    """
    snapshot = snapshot or current(spark, root)
    loads = sorted(k for k, e in snapshot.loads.items() if name in e.tables)
    months = None
    if name == "operations" and (first or last):
        months = {k: months_between(first, last, snapshot.loads[k].months) for k in loads}
        loads = [k for k in loads if months[k]]
    if statement_id is not None and name != "statements":
        found = scan(spark, root, "statements", statement_id=statement_id, snapshot=snapshot).select("load").first()
        loads = [found.load] if found is not None and found.load in loads else []
    rows = _scan(spark, root, name, loads, months)
    if statement_id is not None:
        rows = rows.filter(F.col("statement_id") == statement_id)
    dirty = [k for k in loads if snapshot.loads[k].hidden]
    if name not in KEYED or not dirty:
        return rows
    clean = [k for k in loads if not snapshot.loads[k].hidden]
    shown = rows.filter(F.col("load").isin(dirty)).join(hidden(spark, root, snapshot, dirty), ["load", "statement_id"], "left_anti").select(*rows.columns)
    return rows.filter(F.col("load").isin(clean)).unionByName(shown) if clean else shown


def clean_loads(snapshot: Snapshot, name: str) -> list[int]:
    """Loads whose sums of a table stand for all their statements."""
    return sorted(k for k, e in snapshot.loads.items() if name in e.tables and not e.hidden)


def dirty_loads(snapshot: Snapshot, name: str) -> list[int]:
    """Loads some of whose statements are hidden: what such a table would say must be made from their rows."""
    return sorted(k for k, e in snapshot.loads.items() if name in e.tables and e.hidden)


class Load:
    """Rows on their way into the store: put tables, then commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.id = spark, root, time.time_ns()
        self.entry = Entry()

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table's rows of this load and reads them back: what follows starts from there."""
        rows, path = with_defaults(df, TABLES[name]), f"{self.root}/{name}/load={self.id}"
        if name == "operations":
            # files of one month or two, sorted by day; a month of any size is split among tasks
            rows = rows.withColumn("month", month_of(F.col("date_iso"))).repartitionByRange("month", "date_iso", "id").sortWithinPartitions("month", "date_iso", "id")
            rows.write.mode("overwrite").partitionBy("month").parquet(path)
            self.entry.months = sorted(int(n[6:]) for n in names(self.spark, path) if n.startswith("month="))
        elif name == "grams":
            rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)
        self.entry.tables.append(name)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return _scan(self.spark, self.root, name, [self.id]).select(*[c for c in self.spark.createDataFrame([], TABLES[name]).columns])

    def commit(self, removed: DataFrame | None = None) -> Snapshot:
        """Makes the load count. Earlier rows of its statements, and of those removed (statement_id), are hidden."""
        spark, before = self.spark, current(self.spark, self.root)
        mine = self.read("statements").select("statement_id") if "statements" in self.entry.tables else None
        self.entry.statements = mine.count() if mine is not None else 0
        ids = [x for x in (mine, removed.select(F.col("statement_id").cast("long")) if removed is not None else None) if x is not None]
        after = Snapshot(before.version + 1, {k: Entry(**vars(e)) for k, e in before.loads.items()}, list(before.hidden))
        if ids and before.loads:
            gone = scan(spark, self.root, "statements", snapshot=before).select(F.col("load").alias("of_load"), "statement_id").join(reduce(DataFrame.unionByName, ids).distinct(), "statement_id", "left_semi")
            gone.select("of_load", "statement_id").write.mode("overwrite").parquet(f"{self.root}/hidden/load={self.id}")
            gone = spark.read.schema("of_load long, statement_id long").parquet(f"{self.root}/hidden/load={self.id}")
            for load, n in gone.groupBy("of_load").agg(F.count(F.lit(1))).collect():
                after.loads[load].hidden += n
                if after.loads[load].hidden >= after.loads[load].statements and "quarantine" not in after.loads[load].tables:
                    del after.loads[load]
            after.hidden.append(self.id)
        if self.entry.tables:
            after.loads[self.id] = self.entry
        if not any(e.hidden for e in after.loads.values()):
            after.hidden = []
        publish(spark, self.root, after)
        return after


def compact(spark: SparkSession, root: str, target: str | None = None) -> Snapshot:
    """Writes all that counts as one load, in this folder or in another; sums are made anew where statements were hidden."""
    from ..operators import dashboard, search

    snapshot = current(spark, root)
    load = Load(spark, target or root)
    for name in KEYED:
        if any(name in e.tables for e in snapshot.loads.values()):
            load.put(name, scan(spark, root, name, snapshot=snapshot))
    if "operations" in load.entry.tables:
        rows = load.read("operations")
        load.put("days", dashboard.days(rows))
        load.put("labels", dashboard.labels(rows))
        load.put("grams", search.grams(rows))
    load.entry.statements = load.read("statements").count() if "statements" in load.entry.tables else 0
    base = current(spark, target or root)
    if target is None and base.version != snapshot.version:
        raise Conflict(f"{root} changed while it was compacted")
    after = Snapshot(base.version + 1, {load.id: load.entry} if load.entry.tables else {}, [])
    publish(spark, target or root, after)
    return after


def vacuum(spark: SparkSession, root: str, minutes: int = 60) -> int:
    """Deletes folders of loads that the current snapshot doesn't hold and that are older than `minutes`, and older snapshots; returns how many folders went.

    Frames made from an older snapshot must have been read by then, and no writer be at work longer than that.
    """
    snapshot, gone, limit = current(spark, root), 0, time.time_ns() - minutes * 60 * 10**9
    for name in [*TABLES, "hidden"]:
        keep = snapshot.hidden if name == "hidden" else snapshot.loads
        for folder in names(spark, f"{root}/{name}"):
            if folder.startswith("load=") and int(folder[5:]) not in keep and int(folder[5:]) < limit:
                delete(spark, f"{root}/{name}/{folder}")
                gone += 1
    for n in names(spark, f"{root}/snapshots"):
        if n < f"{snapshot.version:012d}.json" and not n.startswith("_"):
            delete(spark, f"{root}/snapshots/{n}")
    return gone
