"""Watching source directories: every micro-batch of changed files is indexed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataline.functions import text as fx
from strataline.session import shared_dir, ship
from strataline.sources.discovery import LANGUAGES, SKIP_DIRS, TEST_PATH

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, index: Callable[[DataFrame, int], None], interval: str = "500 milliseconds", checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Start indexing what appears or changes under ``root``.

    ``index(files, batch)`` gets (path, language, is_test, content_hash, content) of each
    batch, the newest state of every path, and must be idempotent by batch number. Batches
    run one after the other; changes during a batch are in the next one, none is lost.
    Deletions do not appear in a file stream: ``follow`` sees them.
    """
    ship(spark)
    names = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    x = stream.withColumn("language", F.element_at(names, fx.extension(F.col("path")))).where(F.col("language").isNotNull() & ~F.col("path").rlike("(^|/)(" + "|".join(SKIP_DIRS).replace(".", r"\.") + ")/"))
    rows = x.select("path", "language", F.col("path").rlike(TEST_PATH).alias("is_test"), "modificationTime", F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("content"))

    def batch(df: DataFrame, number: int) -> None:
        newest = df.groupBy("path").agg(F.max_by(F.struct("language", "is_test", "content_hash", "content"), "modificationTime").alias("r")).select("path", "r.*")
        index(newest, number)

    out = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or _checkpoint(spark, "watch", root))
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()


def _checkpoint(spark: SparkSession, use: str, root: str) -> str:
    """A folder of its own for each watched directory."""
    return f"{shared_dir(spark)}/{use}-{hashlib.md5(root.encode()).hexdigest()}"


def listing(spark: SparkSession, root: str) -> str:
    """Hash of names, sizes and times of all files under ``root``; no content is read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = x.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def follow(spark: SparkSession, root: str, out: str, now_ms: Callable[[], int], interval: str = "2 seconds", done: Callable[[DataFrame], None] | None = None, **kw) -> StreamingQuery:
    """Keep the index ``out`` of the directory ``root`` up to date, deletions and renames included.

    A clock stream gives the beat. On each beat the directory is listed; if anything differs
    from the last time, ``index.update`` runs and ``done`` gets its (path, change, old_path).
    Beats do not overlap and an update compares contents, so a beat that is run again, or
    a restart, does no harm. The index must have been built before.
    """
    from strataline.sources import index

    ship(spark)
    last: list[str] = []

    def beat(_: DataFrame, number: int) -> None:
        state = listing(spark, root)
        if last != [state]:
            changed = index.update(spark, root, out, now_ms(), **kw)
            last[:] = [state]
            if done:
                done(changed)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(beat).option("checkpointLocation", _checkpoint(spark, "follow", root + out)).trigger(processingTime=interval).start()
