"""Creators and comments by generation: a scan adds its own rows and rewrites no others.

A store is a folder in shared storage:

``comments/generation=g/buckets=n/bucket=b``   the comments of scan g, by a hash of their creator
``tallies/generation=g``                       their counts by creator, author and class
``creators/generation=g``                      the creators that g changed, each with ``held``, the generation
                                               that holds its comments (null: deleted)
``snapshots/generation=g``                     in place of the former after a compaction: all creators
``progress/generation=g``                      the last micro-batch of each stream up to g, if g is of a stream

A generation counts once its creators (or snapshot) have been written whole; these come last, so a job that
dies before leaves nothing that a reader sees, and its number is used again. A link's comments are those of the
generation that it holds now. A reader opens the generations that some link holds, and only where links
of a generation have moved on does it join against those (link, generation) pairs. The number of buckets is part of
the path, so a reader never has to know it.

There is one writer at a time. A list of generations may be given in place of all that count; a reader then
sees the store as if there were no others.

Defined cases: rows without a link are left out; a store without generations is empty; a scan without
creators changes nothing; deleting unknown links changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from modlytics import schemas
from modlytics.operators.analytics import author_tallies
from modlytics.operators.tables import upsert_creators, with_defaults
from modlytics.sources.tables import BUCKETS, bucket_of

#: A generation has a bucket for each link up to BUCKETS of them, and for more links one for so many.
LINKS_PER_BUCKET = 256
MOST_BUCKETS = 4096
LINK = f"{schemas.CREATOR}, held INT"
_COMMENT = f"{schemas.MODERATED_COMMENT}, buckets INT, bucket INT"
TALLY = "profile_url STRING, author STRING, classification STRING, n BIGINT"
PROGRESS = "stream STRING, batch BIGINT"


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders by a pattern; only names are listed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return [str(status.getPath()) for status in found]


def _written(spark: SparkSession, path: str, part: str) -> list[int]:
    """Generations whose part has been written whole."""
    marks = _folders(spark, f"{path}/{part}/generation=*/_SUCCESS")
    return sorted(int(m.rsplit("generation=", 1)[1].split("/")[0]) for m in marks)


def generations(spark: SparkSession, path: str) -> list[int]:
    """The generations that count, in order."""
    return sorted({*_written(spark, path, "creators"), *_written(spark, path, "snapshots")})


def _read(spark: SparkSession, path: str, part: str, schema: str, of: list[int]) -> DataFrame:
    """Some generations of a part, with their number."""
    there = {int(f.rsplit("=", 1)[1]) for f in _folders(spark, f"{path}/{part}/generation=*")}
    folders = [f"{path}/{part}/generation={g}" for g in of if g in there]
    if not folders:
        return spark.createDataFrame([], f"{schema}, generation INT")
    return spark.read.schema(f"{schema}, generation INT").option("basePath", f"{path}/{part}").parquet(*folders)


@dataclass(frozen=True)
class State:
    """What a reader has to know: every (link, generation) pair that was ever held since the last snapshot, the latest
    row of each link, and the generations that links hold."""

    spark: SparkSession
    path: str
    latest: DataFrame
    gone: DataFrame
    clean: list[int]
    mixed: list[int]

    def rows(self, part: str, schema: str) -> DataFrame:
        """The rows of the links' present generations."""
        whole = _read(self.spark, self.path, part, schema, self.clean)
        if not self.mixed:
            return whole
        some = _read(self.spark, self.path, part, schema, self.mixed)
        pair = (some["profile_url"] == self.gone["gone_url"]) & (some["generation"] == self.gone["gone_held"])
        return whole.unionByName(some.join(self.gone, pair, "left_anti"))

    def creators(self) -> DataFrame:
        return _present(self.latest)

    def comments(self) -> DataFrame:
        return self.rows("comments", _COMMENT).drop("generation", "buckets", "bucket")

    def tallies(self) -> DataFrame:
        """(profile_url, author, classification, n), which all reports can be made from; no comment is read."""
        return self.rows("tallies", TALLY).drop("generation")


def _changes(spark: SparkSession, path: str, of: list[int] | None) -> DataFrame:
    """Every row about a link since the last snapshot."""
    wanted = generations(spark, path) if of is None else sorted(of)
    based = [g for g in _written(spark, path, "snapshots") if g in wanted][-1:]
    changes = [g for g in wanted if g not in based and (not based or g > based[-1])]
    if not based:
        return _read(spark, path, "creators", LINK, changes)
    base = _read(spark, path, "snapshots", LINK, based)
    return base.unionByName(_read(spark, path, "creators", LINK, changes)) if changes else base


def _latest(links: DataFrame) -> DataFrame:
    fields = F.struct(*[c for c in links.columns if c != "profile_url"])
    return links.groupBy("profile_url").agg(F.max_by(fields, "generation").alias("last")).select("profile_url", "last.*")


def _present(latest: DataFrame) -> DataFrame:
    return latest.filter("held is not null").drop("held", "generation")


def state(spark: SparkSession, path: str, of: list[int] | None = None) -> State:
    """One row per generation reaches the driver, as many as since the last compaction."""
    links = _changes(spark, path, of)
    fields = F.struct(*[c for c in links.columns if c != "profile_url"])
    # A link was held by as many generations as it was scanned in since the last snapshot.
    known = links.groupBy("profile_url").agg(F.max_by(fields, "generation").alias("last"), F.collect_set("held").alias("helds"))
    latest = known.select("profile_url", "last.*")
    pairs = known.select("profile_url", F.col("last.held").alias("now"), F.explode("helds").alias("held"))
    gone = pairs.filter(~F.col("held").eqNullSafe(F.col("now"))).select(F.col("profile_url").alias("gone_url"), F.col("held").alias("gone_held"))
    here = F.col("held").eqNullSafe(F.col("now"))
    counted = pairs.groupBy("held").agg(F.count_if(here).alias("n"), F.count_if(~here).alias("lost")).filter("n > 0")
    held = {r["held"]: r["lost"] for r in counted.collect()}
    clean, mixed = (sorted(g for g, lost in held.items() if bool(lost) == some) for some in (False, True))
    return State(spark, path, latest, gone, clean, mixed)


def current_creators(spark: SparkSession, path: str, of: list[int] | None = None) -> DataFrame:
    return _present(_latest(_changes(spark, path, of)))


def current_comments(spark: SparkSession, path: str, of: list[int] | None = None) -> DataFrame:
    return state(spark, path, of).comments()


def current_tallies(spark: SparkSession, path: str, of: list[int] | None = None) -> DataFrame:
    return state(spark, path, of).tallies()


def comments_of(spark: SparkSession, path: str, profile_url: str, of: list[int] | None = None) -> DataFrame:
    """One creator's comments: of its generation, one bucket is opened."""
    wanted = generations(spark, path) if of is None else of
    changed = _read(spark, path, "creators", LINK, wanted).unionByName(_read(spark, path, "snapshots", LINK, wanted))
    last = changed.filter(F.col("profile_url") == profile_url).orderBy(F.desc("generation")).first()
    held = [last["held"]] if last and last["held"] is not None else []
    rows = _read(spark, path, "comments", _COMMENT, held)
    own = (F.col("profile_url") == profile_url) & (F.col("bucket") == bucket_of(F.lit(profile_url), F.col("buckets")))
    return rows.filter(own).drop("generation", "buckets", "bucket")


def _conform(table: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its types; those that are missing are null."""
    fields = StructType.fromDDL(schema)
    return table.select(
        *[(F.col(f"`{f.name}`") if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


@dataclass(frozen=True)
class Staged:
    """Comments that are written but don't count yet."""

    generation: int
    comments: DataFrame


def stage(spark: SparkSession, path: str, comments: DataFrame, ingest_time: str, links: int | None = None) -> Staged:
    """Writes a scan's comments as the next generation. ``links`` is how many creators there are about, where that is known."""
    generation = max(generations(spark, path), default=-1) + 1
    rows = _conform(with_defaults(comments, ingest_time), schemas.MODERATED_COMMENT).filter("profile_url is not null")
    if links is None:
        links = comments.select("profile_url").distinct().count()
    return Staged(generation, _write_comments(spark, path, generation, rows, links))


def _write_comments(spark: SparkSession, path: str, generation: int, rows: DataFrame, links: int) -> DataFrame:
    buckets = max(1, min(MOST_BUCKETS, max(min(links, BUCKETS), links // LINKS_PER_BUCKET)))
    placed = rows.withColumns({"buckets": F.lit(buckets), "bucket": bucket_of(F.col("profile_url"), F.lit(buckets))})
    # A bucket with a hot creator is split over several tasks and files, small ones are put together.
    ordered = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "profile_url", F.desc("timestamp"))
    ordered.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(f"{path}/comments/generation={generation}")
    written = _read(spark, path, "comments", _COMMENT, [generation])
    tallies = author_tallies(written)
    tallies.write.mode("overwrite").parquet(f"{path}/tallies/generation={generation}")
    return written.drop("generation", "buckets", "bucket")


def _commit(spark: SparkSession, path: str, part: str, generation: int, links: DataFrame, batch: tuple[str, int] | None) -> int:
    if batch is not None:
        _note_progress(spark, path, generation, batch)
    links.sortWithinPartitions("profile_url").write.mode("overwrite").parquet(f"{path}/{part}/generation={generation}")
    return generation


def commit(
    spark: SparkSession, path: str, staged: Staged, creators: DataFrame, batch: tuple[str, int] | None = None,
    of: list[int] | None = None,
) -> int:
    """Makes staged comments those of their creators. ``creators`` has every creator with staged comments; one that it has and
    that has none staged is left without comments. Known creators keep their platform."""
    new = _conform(creators, schemas.CREATOR).filter("profile_url is not null")
    old = current_creators(spark, path, of).join(new.select("profile_url").distinct(), "profile_url", "left_semi")
    links = upsert_creators(old, new).withColumn("held", F.lit(staged.generation))
    return _commit(spark, path, "creators", staged.generation, _conform(links, LINK), batch)


def append_scan(
    spark: SparkSession, path: str, creators: DataFrame, comments: DataFrame, ingest_time: str,
    batch: tuple[str, int] | None = None, of: list[int] | None = None,
) -> int:
    """The comments of all scanned creators replaced, as replace_comments and upsert_creators do, by writing the new ones
    only. Returns the generation."""
    staged = stage(spark, path, comments, ingest_time, creators.select("profile_url").distinct().count())
    return commit(spark, path, staged, creators, batch, of)


def delete(
    spark: SparkSession, path: str, doomed: DataFrame, batch: tuple[str, int] | None = None, of: list[int] | None = None
) -> int:
    """Deletes creators with their comments: one row each is written. Returns the generation."""
    generation = max(generations(spark, path), default=-1) + 1
    gone = current_creators(spark, path, of).join(doomed.select("profile_url").distinct(), "profile_url", "left_semi")
    return _commit(spark, path, "creators", generation, _conform(gone, LINK), batch)


# --- streams ---


def applied(spark: SparkSession, path: str, stream: str) -> int:
    """The last micro-batch of a stream that the store contains; -1 if none."""
    last = _progress(spark, path).filter(F.col("stream") == stream).agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def _progress(spark: SparkSession, path: str) -> DataFrame:
    """The last noted progress has that of all streams."""
    counted = generations(spark, path)
    noted = [g for g in _written(spark, path, "progress") if g in counted]
    return _read(spark, path, "progress", PROGRESS, noted[-1:]).drop("generation")


def _note_progress(spark: SparkSession, path: str, generation: int, batch: tuple[str, int]) -> None:
    noted = _progress(spark, path).unionByName(spark.createDataFrame([batch], PROGRESS))
    last = noted.groupBy("stream").agg(F.max("batch").alias("batch")).coalesce(1)
    last.write.mode("overwrite").parquet(f"{path}/progress/generation={generation}")


# --- upkeep ---


def compact(spark: SparkSession, path: str, whole: bool = False) -> int | None:
    """Rewrites the generations that links have moved on from (with ``whole``, all) as one, and puts a snapshot in place of the
    changes. Afterwards no reader has to join. Returns the generation, or None if there was nothing to do."""
    now = state(spark, path)
    moved = [*now.clean, *now.mixed] if whole else now.mixed
    live = now.latest.filter("held is not null")
    if not moved:
        return None
    generation = generations(spark, path)[-1] + 1
    chosen = State(spark, path, now.latest, now.gone, [g for g in now.clean if g in moved], now.mixed)
    links = live.filter(F.col("held").isin(moved)).count()
    _write_comments(spark, path, generation, chosen.rows("comments", _COMMENT).drop("generation", "buckets", "bucket"), links)
    held = F.when(F.col("held").isin(moved), F.lit(generation)).otherwise(F.col("held"))
    return _commit(spark, path, "snapshots", generation, _conform(live.withColumn("held", held), LINK), None)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes folders that no reader of the whole store needs: rows that no link holds, and changes before the last snapshot.
    Call it when no reader of an earlier state is left. Returns the folders."""
    now = state(spark, path)
    counted, based = generations(spark, path), _written(spark, path, "snapshots")
    noted = [g for g in _written(spark, path, "progress") if g in counted]
    needed = {"comments": {*now.clean, *now.mixed}, "tallies": {*now.clean, *now.mixed}, "progress": {*noted[-1:]}}
    needed |= {"creators": {g for g in counted if not based or g > based[-1]}, "snapshots": {*based[-1:]}}
    doomed = []
    for part, kept in needed.items():
        for folder in _folders(spark, f"{path}/{part}/generation=*"):
            number = int(folder.rsplit("=", 1)[1])
            if number not in kept and number <= max(counted, default=-1):
                doomed.append(folder)
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in doomed:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    return doomed
