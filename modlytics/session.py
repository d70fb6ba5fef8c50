"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "modlytics", **settings: str) -> SparkSession:
    """A session with the settings the jobs count on. Sizes and the master are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor sees.

    Where the setting is missing, a folder in the warehouse takes its place, since all executors share
    that too.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
        _delete_at_exit(spark, context.getCheckpointDir())
    return folder


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Has a folder deleted when the session's JVM ends; it is made if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


_roots: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; never one that is being read. It goes when the session's JVM ends."""
    application = spark.sparkContext.applicationId
    if application not in _roots:
        root = f"{shared_dir(spark).rstrip('/')}/modlytics-{uuid.uuid4().hex}"
        _delete_at_exit(spark, root)
        _roots[application] = root
    return f"{_roots[application]}/{name}-{uuid.uuid4().hex}"
