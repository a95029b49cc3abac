"""Session helpers: reading tables, cutting lineage, sizing broadcasts."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables up to this many bytes on disk may be broadcast when their size is known.
BROADCAST_BYTES = 8 << 20

_scratch: dict[str, str] = {}


def _own_folder(key: str) -> str:
    """A folder of this process, removed at exit."""
    if key not in _scratch:
        _scratch[key] = tempfile.mkdtemp(prefix="strataline-")
        atexit.register(shutil.rmtree, _scratch[key], True)
    return "file://" + _scratch[key]


def local_session(app: str = "strataline", cpus: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STRATALINE_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", os.environ.get("STRATALINE_SHARED_DIR") or _own_folder("session"))
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    box = os.path.join(tempfile.mkdtemp(prefix="strataline-code-"), "strataline.zip")
    with zipfile.ZipFile(box, "w") as z:
        for root, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.join("strataline", os.path.relpath(full, here)))
    sc.addPyFile(box)
    atexit.register(shutil.rmtree, os.path.dirname(box), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``.

    ``local_session`` always sets it. Where another session does not, a local master, whose
    driver and executors are one process, gets a folder of its own; on a cluster a missing
    setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(sc.applicationId)


_live: dict[str, Stored] = {}


@contextmanager
def scope() -> Iterator[None]:
    """Drop all tables stored inside, at the end: around a query whose result has been taken.

    Without it stored tables last until the process ends, as results are read lazily.
    """
    before = set(_live)
    yield
    for path in set(_live) - before:
        if not _live[path].kept:
            _live[path].drop()


class Stored:
    """A table written to the shared folder: its lineage is cut there, it outlives
    a lost executor, and its size is known to the planner."""

    def __init__(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = (), kept: bool = False, counted: bool = False):
        spark = df.sparkSession
        seen = Observation() if counted else None  # rows, counted while they are written; more if a task ran twice
        if seen:
            df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        self.kept = kept  # outlives the scope it was made in
        ship(spark)
        self.path = f"{shared_dir(spark)}/strataline/{label}-{uuid.uuid4().hex}"
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path)
        self._spark = spark
        self._schema = df.schema
        self.rows = seen.get["n"] if seen else None
        _live[self.path] = self

    def read(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self.path)

    def bytes(self) -> int:
        """Size of the written files."""
        fs, p = self._fs()
        return int(fs.getContentSummary(p).getLength())

    def count(self) -> int:
        """Number of rows, from the Parquet footers."""
        return self.read().count()

    def drop(self) -> None:
        """Remove the files. Called at exit, at the end of a scope, and by loops that have moved on."""
        if _live.pop(self.path, None) is not None:
            fs, p = self._fs()
            fs.delete(p, True)

    def _fs(self):
        jvm = self._spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), p


@atexit.register
def _drop_all() -> None:
    from py4j.protocol import Py4JError, Py4JNetworkError

    for t in list(_live.values()):
        try:
            t.drop()
        except (Py4JError, Py4JNetworkError, OSError, AttributeError):  # the JVM is gone: a local folder goes with the process
            return


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of the files below ``paths``: the state of some tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for x in paths:
        p = jvm.org.apache.hadoop.fs.Path(x)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            seen += sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(p))
    return hashlib.md5("|".join(seen).encode()).hexdigest()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files whose plans are no longer referenced.

    Iterative operators call this after each stored round; otherwise the files of
    all rounds stay on the executors' disks until the driver happens to collect.
    """
    import gc
    import time

    for _ in range(2):  # objects let go of by Python are released in the JVM a moment later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # the cleaner works beside this thread


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
