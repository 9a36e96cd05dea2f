"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver by application, with what removes them also after their session was stopped.
_FOLDERS: dict[str, tuple[tuple, str]] = {}
#: Tables of the scopes that are open, innermost last.
_SCOPE: contextvars.ContextVar[list | None] = contextvars.ContextVar("scope", default=None)


def _handles(spark: SparkSession) -> tuple:
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which every executor can reach.

    Where the setting is absent, a machine of its own (tests) takes a temporary folder and a cluster
    an error. All folders of an application lie in one, which is removed when the driver ends, also
    if its session was stopped before.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tessel-")
        _FOLDERS[app] = (_handles(spark), f"{base.rstrip('/')}/tessel-{uuid.uuid4().hex}")
    return f"{_FOLDERS[app][1]}/{uuid.uuid4().hex}"


def written(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """The rows of `df` as a Parquet table in the shared folder: they are the same whenever they are read, and lineage ends here.

    `instead`: an earlier such table that nothing needs once this one is written, as in a loop; it is removed.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    mine = _SCOPE.get()
    if mine is not None:
        mine.append((df.sparkSession, path))
    # The schema is known, so no job looks for it.
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    discard(instead)
    return out


def written_by(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """`written`, dealt out by a key into buckets as many as Spark's shuffle partitions: later joins by the key don't move these rows again.

    `dealt`: the rows lie so already. The catalog's entry is dropped at once; the files stay as those of `written`.
    """
    spark, path, name = df.sparkSession, shared_dir(df.sparkSession), f"tessel_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    mine = _SCOPE.get()
    if mine is not None:
        mine.append((spark, path))
    out = spark.table(name)
    out.schema  # noqa: B018  (the plan knows its files from here on)
    spark.sql(f"DROP TABLE {name}")
    out._written_to = path
    return out


def discard(table: DataFrame | None) -> None:
    """Remove a table that `written` gave, if it is one, before its time."""
    if table is not None and getattr(table, "_written_to", None):
        drop_shared(table.sparkSession, table._written_to)


@contextlib.contextmanager
def scope():
    """Tables that `written` makes inside are removed at the end: for work whose results have left Spark by then."""
    mine: list = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for spark, path in mine:
            with contextlib.suppress(Exception):
                drop_shared(spark, path)


def scoped(f):
    """A function that returns plain values, not tables: what it writes goes when it returns."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        with scope():
            return f(*args, **kwargs)

    return run


def _drop(handles: tuple, path: str) -> None:
    jvm, conf = handles
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system."""
    _drop(_handles(spark), path)


@atexit.register
def _clear() -> None:
    for handles, path in _FOLDERS.values():
        # Where the JVM has gone nothing can be removed any more.
        with contextlib.suppress(Exception):
            _drop(handles, path)
