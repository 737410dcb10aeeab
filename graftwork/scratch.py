"""Tables written between the steps of iterative operators.

Every table goes to the folder that the session names in ``spark.checkpoint.dir`` (or was given by ``setCheckpointDir``), which
all executors share, so a lost executor never loses a step. Only where neither is set (tests,
a local shell) a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder, else one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="graftwork-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. Results may read from it until the application ends; then it is deleted."""
    path = f"{shared_dir(spark)}/graftwork-{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session is gone, or the folder is
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Writes tables under the shared folder and deletes them when they are replaced.

    ``keep`` writes a frame and returns the frame that reads it back; the lineage ends there.
    ``drop`` deletes a table that no frame reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: dict[int, tuple[DataFrame, str]] = {}  # holds the frames, so that no id is used twice
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = out, path
        return out

    def drop(self, df: DataFrame | None) -> None:
        _, path = self.kept.pop(id(df), (None, None))
        if path:
            delete(self.spark, path)

    def clear(self) -> None:
        delete(self.spark, self.root)
        self.kept.clear()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
