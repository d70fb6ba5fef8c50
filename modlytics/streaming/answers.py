"""Verdicts on outside labels as the answers arrive.

A scan of a creator is sent to a labeller in batches. It is labelled from outside if every batch is answered in time
and well, else by the rules. This is decided as soon as it can be: at the first broken answer, at the last missing
one, or when time is up. State holds one entry per answered batch of an open scan and goes when the scan is decided;
comments and labels never pass through it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels with its tasks by value, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: State is in a store on disk, so a creator with very many batches does not have to fit into memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEY = ["profile_url", "scan"]
VERDICT = "profile_url STRING, scan STRING, scan_ok BOOLEAN, reason STRING"
COMPLETE, BROKEN, LATE = "complete", "broken", "late"


class ScanVerdict(StatefulProcessor):
    """Rows of one scan: an announcement (how many batches) and answers (batch, whether it is ok), with their times."""

    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answered = handle.getMapState("answered", "batch_id LONG", "ok BOOLEAN, at LONG")
        self.scan = handle.getValueState("scan", "batches LONG, deadline LONG, good LONG, decided BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batches, deadline, good, decided = self.scan.get() if self.scan.exists() else (None, None, 0, False)
        reason = None
        for row in rows:
            if decided or reason:
                continue
            if row.batches is not None:
                if batches is None:
                    batches, deadline = row.batches, row.at_ms + self.patience
                    self.handle.registerTimer(deadline)
                    early = [(k[0], *v) for k, v in self.answered.iterator()]
                    good, reason = self._weighed(early, batches, deadline, good)
            elif not self.answered.containsKey((row.batch_id,)):
                self.answered.updateValue((row.batch_id,), (row.ok, row.at_ms))
                if batches is not None:
                    good, reason = self._weighed([(row.batch_id, row.ok, row.at_ms)], batches, deadline, good)
            if reason is None and batches is not None and good == batches:
                reason = COMPLETE
        if decided:
            return
        yield from self._noted(key, batches, deadline, good, reason)

    def _weighed(self, answers: list[tuple[int, bool, int]], batches: int, deadline: int, good: int) -> tuple[int, str | None]:
        """Good answers counted on, and the reason if one is bad. Answers to batches that were not sent are nobody's, and those
        after the deadline are missing."""
        own = [ok for batch, ok, at in answers if 0 <= batch < batches and at <= deadline]
        return good + sum(own), None if all(own) else BROKEN

    def _noted(self, key, batches, deadline, good, reason: str | None) -> Iterator[Row]:
        self.scan.update((batches, deadline, good, reason is not None))
        if reason is not None:
            self.answered.clear()
            if reason != LATE and deadline is not None:
                self.handle.deleteTimer(deadline)
            yield Row(profile_url=key[0], scan=key[1], scan_ok=reason == COMPLETE, reason=reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        batches, deadline, good, decided = self.scan.get()
        if not decided:
            yield from self._noted(key, batches, deadline, good, LATE)

    def close(self) -> None:
        pass


def scan_verdicts(sent: DataFrame, answers: DataFrame, patience_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Streams (profile_url, scan, batches, at) and (profile_url, scan, batch_id, ok, at) -> (profile_url, scan, scan_ok, reason).

    ``at`` is when a row was sent or came in. A scan has ``patience_seconds`` from its announcement on; an answer after that is
    missing, whichever order the rows are read in. ``lateness`` is how far behind
    the latest one read a row may be; one that is further behind is not looked at. Of several answers to a batch the first
    one read counts. Each scan is decided once.
    """
    columns = [*KEY, "batches", "batch_id", "ok", "at", F.unix_millis("at").alias("at_ms")]
    announced = sent.withColumns({"batch_id": F.lit(None).cast("bigint"), "ok": F.lit(None).cast("boolean"), "batches": F.col("batches").cast("bigint")})
    given = answers.withColumns({"batches": F.lit(None).cast("bigint"), "batch_id": F.col("batch_id").cast("bigint")})
    both = announced.select(*columns).unionByName(given.select(*columns)).withWatermark("at", lateness)
    return both.groupBy(*KEY).transformWithState(ScanVerdict(1000 * patience_seconds), VERDICT, "Append", "EventTime")


def drain_verdicts(
    sent: DataFrame, answers: DataFrame, path: str, progress: str, patience_seconds: int, lateness: str = "0 seconds"
) -> DataFrame:
    """Decides what can be decided by what has come in so far, adds it to the table at ``path`` and stops. ``progress`` is a folder in
    shared storage, from which the next call goes on. Returns all verdicts so far."""
    spark = sent.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        verdicts = scan_verdicts(sent, answers, patience_seconds, lateness)
        writer = verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(VERDICT).parquet(path)
