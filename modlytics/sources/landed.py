"""Payloads as they land: several pages of a link, and several scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A comment's position is its page's number in the upper bits and its place on the page in these.
PAGE_BITS = 32


def with_landing(payloads: DataFrame) -> DataFrame:
    """Payloads with landed_at (null if not known) and page (0 if not known)."""
    missing = {}
    if "landed_at" not in payloads.columns:
        missing["landed_at"] = F.lit(None).cast("timestamp")
    page = F.coalesce("page", F.lit(0)) if "page" in payloads.columns else F.lit(0)
    return payloads.withColumns({**missing, "page": page.cast("bigint")})


def latest_scans(payloads: DataFrame) -> DataFrame:
    """The payloads of each link's latest scan; of one page landed twice in it, the greater text.

    landed_at is the time of the scan, the same for all of its pages. Payloads of unknown time are one scan,
    before all known ones. Links, times and pages decide; payloads meet the one time of their link, so Spark may split a
    link with many pages, and only those of pages that landed twice are compared. A payload without a link is nobody's.
    """
    landed = with_landing(payloads)
    if "landed_at" not in payloads.columns:
        return landed
    keys = ["profile_url", "landed_at", "page"]
    last = landed.groupBy(F.col("profile_url").alias("last_url")).agg(F.max("landed_at").alias("last_at"))
    latest = (F.col("profile_url") == F.col("last_url")) & F.col("landed_at").eqNullSafe(F.col("last_at"))
    kept = landed.join(last, latest, "left_semi")
    twice = landed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = twice.select(*[F.col(k).alias(f"{k}_again") for k in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_again"))
    once = kept.join(again, same, "left_anti")
    others = [c for c in landed.columns if c not in keys]
    one_of_many = kept.join(again, same, "left_semi").groupBy(*keys).agg(*[F.max(c).alias(c) for c in others])
    return once.unionByName(one_of_many)


def read_landed(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """A folder of JSON payload files -> (profile_url, landed_at, page, payload), as a table or as a stream of new files.

    Files are laid out as ``scan=<encoded time>/link=<encoded link>/<page>.json``, one folder per scan; the
    time is the folder's, whenever its files were written. Without a scan folder there is one scan and its
    time is null; a folder that names no time is an error. Each file is one payload, read whole.
    """
    reader = spark.readStream if stream else spark.read
    files = reader.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    scan = F.url_decode(F.url_decode(F.regexp_extract(path, "/scan=([^/]+)/link=", 1)))
    time = F.try_to_timestamp(scan)
    unknown = F.raise_error(F.concat(F.lit("no time in the scan folder of "), path)).cast("timestamp")
    return files.select(
        F.url_decode(F.url_decode(F.regexp_extract(path, "/link=([^/]+)/", 1))).alias("profile_url"),
        F.when(scan != "", F.coalesce(time, unknown)).alias("landed_at"),
        F.regexp_extract(path, r"/([0-9]+)\.json$", 1).cast("bigint").alias("page"),
        F.col("value").alias("payload"),
    )
