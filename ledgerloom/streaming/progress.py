"""Progress of jobs: stages as a table, counts of a batch, and a listener for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.dates import eta_seconds


class Progress(StreamingQueryListener):
    """Keeps the last progress of each query: batch and rows."""

    def __init__(self) -> None:
        self.last: dict[str, tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = (-1, 0)

    def onQueryProgress(self, event) -> None:
        self.last[str(event.progress.id)] = (event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def with_eta(jobs: DataFrame) -> DataFrame:
    """jobs (elapsed seconds, progress_percent) with eta."""
    return jobs.withColumn("eta", eta_seconds(F.col("elapsed"), F.col("progress_percent")))


def batch_counts(jobs: DataFrame) -> DataFrame:
    """How many files of a batch are processing, repeated, failed and done."""
    is_ = lambda s: F.col("status") == s
    return jobs.agg(F.count_if(is_("procesando")).alias("processing"), F.count_if(is_("duplicado")).alias("duplicates"), F.count_if(is_("error")).alias("errors"), F.count_if(~F.col("status").isin("procesando", "duplicado", "error")).alias("done"))
