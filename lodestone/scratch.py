"""Intermediate tables in a folder that all executors share, and joins that leave hot keys where they are."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder of its own;
    on a cluster that is an error, as executors don't see each other's disks."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("lodestone.scratch.dir", "")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("lodestone.scratch.dir", root)
    return root.rstrip("/")


#: Bytes of an Arrow batch. Spark's own bound of 64 MB is held several times over on both sides of a worker's pipe.
BATCH_BYTES = 2_000_000


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session hands Python workers batches of about BATCH_BYTES, however long single texts are; a setting that isn't Spark's default stays."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864"
    if spark.conf.get(key, default) in (default, default + "b"):
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{scratch_root(spark)}/t-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: A key is hot with more than 1 / HOT of all rows, so there are fewer than HOT hot keys.
HOT = 512


def met(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row for each key and in `size` how many rows have it (of `total`).

    Facts of hot keys (fewer than HOT) are broadcast, so rows of a hot key stay where they are; the others meet in a shuffle.
    """
    hot = facts.where(F.col(size) > total // HOT)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(size) <= total // HOT), key, how)
    return near.unionByName(far)
