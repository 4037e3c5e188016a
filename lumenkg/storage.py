"""Tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where nothing is set and all runs in one process (tests), a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lumenkg-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_own = threading.local()


def _open() -> list[list[str]]:
    """The paths that the functions under way in this thread have stored, the innermost last."""
    if not hasattr(_own, "open"):
        _own.open = []
    return _own.open


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: what follows survives lost executors without computing df again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open():
        _open()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """run, with its result stored as one table, and the tables that it has stored on the way deleted."""

    @wraps(run)
    def tidied(*args, **options) -> DataFrame:
        _open().append([])
        try:
            out = run(*args, **options)
            mark = len(_open()[-1])
            out = stored(out, run.__name__)
            gone, kept = _open()[-1][:mark], _open()[-1][mark:]
        finally:
            _open().pop()
        jvm, conf = out.sparkSession._jvm, out.sparkSession._jsc.hadoopConfiguration()
        for path in gone:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        if _open():
            _open()[-1].extend(kept)
        return out

    return tidied
