"""Session, table access and durable intermediate tables.

Intermediate results that cut lineage are Parquet tables in the shared folder that the
cluster names in ``spark.checkpoint.dir``; every executor can read them, so a lost executor
costs a re-read and nothing else.  A machine-local folder is used only where that setting is
absent and the master is local, as in tests; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def get_spark(app: str = "trellis", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    return builder.config(map=base | conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, for tables that cut lineage."""
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="trellis-")
        atexit.register(_remove_local)
    return f"file://{_LOCAL_DIR}"


def _remove_local() -> None:
    import shutil

    if _LOCAL_DIR and os.path.isdir(_LOCAL_DIR):
        shutil.rmtree(_LOCAL_DIR, ignore_errors=True)


#: Removes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OPEN: dict[str, "Workspace"] = {}


#: Whether rows parted by some of a join's keys are shuffled again by all of them.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def shuffles_removed(spark: SparkSession):
    """Writes inside remove their shuffle files at their end; what they wrote must be all that is used later."""
    return _setting(spark, _CLEANUP, "true")


def joined_in_place(spark: SparkSession):
    """Joins that are run inside leave both sides where they are, if some of the join's keys part them alike."""
    return _setting(spark, _ALL_KEYS, "false")


class Workspace:
    """Names the tables of one job inside the shared folder and removes them again.

    Tables that a result still reads live on until ``clear``, ``clear_all`` or the end of the
    Python process, whichever comes first.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/trellis-{label}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back, with no lineage before it.

        The shuffle files of the write go with it, as the table takes their place.
        """
        _OPEN[self.root] = self
        self._n += 1
        path = f"{self.root}/{self._n}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._trellis_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._trellis_path)

    def clear(self) -> None:
        _OPEN.pop(self.root, None)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(target, True)


def clear_all(spark: SparkSession) -> None:
    """Remove every table that this process has written to the shared folder; their results can't be read any more."""
    for ws in list(_OPEN.values()):
        if ws.spark is spark:
            ws.clear()


def _clear_open() -> None:
    for ws in list(_OPEN.values()):
        try:
            if ws.spark.sparkContext._jsc is not None:
                ws.clear()
        except Exception:  # the JVM is gone; nothing can be told it any more
            return


atexit.register(_clear_open)
