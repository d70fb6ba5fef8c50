"""Tables kept by a stream of landed payloads.

Each micro-batch is one generation of the store. Payloads are kept as they land, by stream and micro-batch; a
micro-batch then scans anew the links that it has payloads of, from all payloads of their latest scan, whichever
micro-batches brought them. So the pages of a scan may come apart, twice or after a later scan, and the tables end up
as if everything had landed at once; only that a link whose latest scan brings no comments keeps those of the scan before, as
an empty scan is never stored. A generation notes the micro-batch it is of: one that is repeated after
a failure overwrites what it left, and one that is already in the store changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics import schemas
from modlytics.functions.dictionary import PLATFORMS
from modlytics.functions.links import platform_of
from modlytics.operators import generations
from modlytics.plans.scan import scan_into
from modlytics.sources.landed import read_landed

#: The platform whose payloads are threads; all others are pages of comments.
THREAD_PLATFORM = PLATFORMS[0][0]


def _landed(spark: SparkSession, store: str, stream: str, batches: list[int]) -> DataFrame:
    root = f"{store}/landed/stream={stream}"
    schema = f"{schemas.LANDED_PAGE}, batch BIGINT"
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/batch={b}" for b in batches])


def _kept_batches(spark: SparkSession, store: str, stream: str, upto: int) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/landed/stream={stream}/batch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    numbers = [int(str(s.getPath()).rsplit("batch=", 1)[1].split("/")[0]) for s in found]
    return sorted(n for n in numbers if n <= upto)


def settle(spark: SparkSession, store: str, landed: DataFrame, batch: int, ingest_time: str, stream: str = "landed") -> int | None:
    """One micro-batch of (profile_url, landed_at, page, payload) into the store. Returns its generation; None if the store
    already has it.

    Payloads of links without a platform of threads are read as comment pages. Those without a link are kept but belong
    to no creator.
    """
    if batch <= generations.applied(spark, store, stream):
        return None
    columns = [c.split()[0] for c in schemas.LANDED_PAGE.split(", ")]
    landed.select(*columns).write.mode("overwrite").parquet(f"{store}/landed/stream={stream}/batch={batch}")
    batches = _kept_batches(spark, store, stream, batch)
    # Links and times only; no payload is read for these.
    keys = _landed(spark, store, stream, batches).select("profile_url", "landed_at", "batch").distinct()
    new = keys.filter(F.col("batch") == batch).select("profile_url").distinct()
    order = F.max(F.struct("landed_at"))  # as a struct, an unknown time is before all known ones
    last = keys.join(new, "profile_url", "left_semi").groupBy("profile_url").agg(order.alias("last")).select(
        F.col("profile_url").alias("last_url"), F.col("last.landed_at").alias("last_at")
    )
    latest = (F.col("profile_url") == F.col("last_url")) & F.col("landed_at").eqNullSafe(F.col("last_at"))
    of_last = keys.join(last, latest)
    # A link whose latest scan has nothing new here stays as it is.
    due = of_last.filter(F.col("batch") == batch).select("last_url", "last_at").distinct()
    needed = keys.join(due, latest, "left_semi").select("batch").distinct()
    opened = sorted(r["batch"] for r in needed.collect())
    payloads = _landed(spark, store, stream, opened).join(due, latest, "left_semi").drop("batch")
    is_thread = platform_of(F.col("profile_url")) == THREAD_PLATFORM
    return scan_into(spark, store, payloads.filter(is_thread), payloads.filter(~is_thread), ingest_time, batch=(stream, batch))


def keep_tables(
    landed: DataFrame, store: str, progress: str, ingest_time: str | Callable[[int], str], stream: str = "landed"
) -> None:
    """Brings a store up to date with a stream of landed payloads and stops. ``progress`` is a folder in shared storage: the
    next call goes on from there. ``ingest_time`` may depend on the micro-batch."""

    def each(rows: DataFrame, batch: int) -> None:
        time = ingest_time if isinstance(ingest_time, str) else ingest_time(batch)
        settle(rows.sparkSession, store, rows, batch, time, stream)

    query = landed.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_folder(
    spark: SparkSession, folder: str, store: str, progress: str, ingest_time: str | Callable[[int], str], stream: str = "landed"
) -> None:
    """From a folder of landed payload files to the tables: what is new in it goes into the store."""
    keep_tables(read_landed(spark, folder, stream=True), store, progress, ingest_time, stream)
