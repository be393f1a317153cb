"""Helpers shared by the training-data operators: shared-folder tables and blocks."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: seconds that a step takes at least if it leaves shuffle files worth a call of the cleaner
CLEAN_S = 1.0


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests, bench) gets a folder that goes with the
    process; on a cluster no local folder would do, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loghelm-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder; `drop` frees one that later steps no longer read.

    A written table cuts lineage and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loghelm-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        began = time.monotonic()
        df.write.option("compression", "zstd").parquet(path)
        if time.monotonic() - began > CLEAN_S:
            free_shuffles(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loghelm_path = path
        return out

    def together(self, *frames: DataFrame) -> DataFrame:
        """Kept tables of one shape as one."""
        if len(frames) == 1:
            return frames[0]
        paths = [p for df in frames for p in _paths(df)]
        out = self.spark.read.schema(frames[0].schema).parquet(*paths)
        out._loghelm_path = paths
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for name in (p for df in frames for p in _paths(df)):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _paths(kept: DataFrame) -> list[str]:
    found = kept._loghelm_path
    return found if isinstance(found, list) else [found]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no column of theirs can clash with a new one."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def train_fold(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves a remainder other than 2 modulo 4.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2
