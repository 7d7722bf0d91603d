"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "lakework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution, where nothing else is set.

    ``conf`` is the caller's and always holds; what the cluster or an open session sets
    stays as it is.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    active = SparkSession.getActiveSession()
    given = active.sparkContext.getConf() if active else _cluster_settings()
    for key, value in SETTINGS.items():
        if key not in conf and not given.contains(key):
            builder = builder.config(key, value)
    return builder.getOrCreate()


def _cluster_settings():
    """What spark-submit and its defaults file have set, before a context is there."""
    SparkContext._ensure_initialized()
    return SparkConf()


_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, under the folder the cluster shares."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drop at the end all scratch folders that were made within.

    Frames are lazy, so what is built within has to be written or collected within as well.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_scratch(spark, path)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or else one in the session's warehouse.

    By default the warehouse is a folder of the machine, which the machines of a cluster do not
    share; there the setting is asked for.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        if _machine_local(spark, root):
            raise ValueError(f"{root} is a folder of one machine: set {_CHECKPOINT_DIR} to one that the cluster shares")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def _machine_local(spark: SparkSession, path: str) -> bool:
    """Whether a path is on the machine's own disk while the session runs on a cluster."""
    if spark.sparkContext.master.startswith("local"):
        return False
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`scratch_dir` gave, once its operator is through."""
    if not path.startswith(checkpoint_root(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is no scratch folder")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df, eager: bool = True):
    """Materialise ``df`` in the shared folder, so that lost executors cannot force a long replay."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)
