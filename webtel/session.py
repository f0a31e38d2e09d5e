"""Session building, package shipping and shared work folders."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "webtel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that all operators assume (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_webtel_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="webtel-"), "webtel_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._webtel_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="webtel-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Stages:
    """Tables written to the shared folder in order to cut lineage.

    A lost executor then costs only the tasks it was running: the rows
    written before are read again from the shared folder.
    """

    #: Those made since the innermost `released` of this thread began, and the folders of all of an application.
    _inner: ClassVar[threading.local] = threading.local()
    _roots: ClassVar[dict[str, set[str]]] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/webtel-{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        Stages._roots.setdefault(spark.sparkContext.applicationId, set()).add(self.root)
        if open_blocks := getattr(Stages._inner, "blocks", None):
            open_blocks[-1].append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete these tables; nothing that is still to be computed may read them."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.remove(name)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[n for n in self.names if n not in names])

    @classmethod
    @contextmanager
    def released(cls):
        """Tables that operators write in this block are deleted at its end, once what reads them has been written."""
        if not hasattr(cls._inner, "blocks"):
            cls._inner.blocks = []
        cls._inner.blocks.append([])
        try:
            yield
        finally:
            for s in cls._inner.blocks.pop():
                s.keep_only()

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        """Delete all work folders of this application; for when its results have been written.

        Operators are lazy, so none can tell when its tables have been read for the last time.
        """
        for root in cls._roots.pop(spark.sparkContext.applicationId, set()):
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
