"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("annalist")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process makes a temporary folder of
    its own, which goes at exit; on a cluster that is an error, as no other
    machine would see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        made = tempfile.mkdtemp(prefix="annalist-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own_folders[context.applicationId] = "file://" + made
    return _own_folders[context.applicationId]


_own_folders: dict[str, str] = {}


class Scratch:
    """The tables written while it is the innermost one; see ``scratch``."""

    def __init__(self, outer: Scratch | None):
        self.outer = outer
        self.frames: list[DataFrame] = []

    def keep(self, frame: DataFrame) -> DataFrame:
        """Leave a table to the scope around this one."""
        self.frames = [f for f in self.frames if f is not frame]
        if self.outer is not None:
            self.outer.frames.append(frame)
        return frame


_scope: ContextVar[Scratch | None] = ContextVar("annalist_scratch", default=None)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Delete, at the end of the block, all tables that operators wrote in it and nothing has discarded.

    Operators return frames that read what they have written, so only the
    caller knows when a result has been used. Tables outside of any block are
    deleted when the application ends.
    """
    own = Scratch(_scope.get())
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        discard(*own.frames)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the application ends."""
    path = f"{shared_folder(spark)}/annalist/{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back.

    Lineage ends here, a lost executor costs no more than its running tasks,
    and the shuffle files behind the frame go once the write has ended.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    same = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(_writer(spark), df._jdf.queryExecution().analyzed())
    same.write().option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._annalist_path = path
    if _scope.get() is not None:
        _scope.get().frames.append(written)
    return written


_writers: dict[str, object] = {}


def _writer(spark: SparkSession):
    """A clone of the session, with its settings of the moment, whose queries drop their shuffle files when they end.

    To drop them is a setting of a whole session, and other threads' queries should not inherit it.
    """
    own = spark._jsparkSession
    key = own.sessionUUID()
    if key not in _writers:
        _writers[key] = own.cloneSession()
    settings = spark._jvm.java.util.Properties()
    entries = own.sessionState().conf().getAllConfs().iterator()
    while entries.hasNext():
        entry = entries.next()
        settings.setProperty(entry._1(), entry._2())
    settings.setProperty("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    conf = _writers[key].sessionState().conf()
    conf.clear()
    conf.setConf(settings)
    return _writers[key]


def discard(*frames: DataFrame) -> None:
    """Delete materialized frames that nothing reads any more; other frames are left alone."""
    for frame in frames:
        path = getattr(frame, "_annalist_path", None)
        if path:
            place, files = _place(frame.sparkSession, path)
            files.delete(place, True)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
