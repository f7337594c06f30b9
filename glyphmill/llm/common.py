"""What the operators of this subpackage share: the shared folder, materialised tables and joins that bear hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have at most when only its row count is known.
BROADCAST_ROWS = 500_000
#: A key is hot when it holds more than one in HOT_SHARE rows, so there are fewer hot keys than HOT_SHARE.
HOT_SHARE = 512


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, local mode (tests) sets a folder of this machine; a cluster, where others couldn't read it, fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.glyphmill.shared.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.glyphmill.shared.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_root(spark)}/glyphmill/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a table without vectored reads, which keep native memory of a column chunk's size for each reading thread."""
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables from the shared folder, none of others'; results not yet read are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def size_of(df: DataFrame) -> int:
    """Bytes of ``df`` as the planner estimates them from its files, without a job; 0 where it can't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def hot_key_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``left`` left-join ``right`` on ``keys``, which are unique in ``right``; right's ``weight`` counts the left rows of a key.

    Keys with more than total / HOT_SHARE left rows, fewer than HOT_SHARE of them, are joined by a
    broadcast, so a key that holds a third of all rows never meets in one task. The rest is shuffled.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(weight) > limit))
    cold = right.where(F.col(weight) <= limit)
    return left.join(hot, keys, "inner").unionByName(left.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left"))


def semi_join(left: DataFrame, right: DataFrame, keys: list[str], right_rows: int) -> DataFrame:
    """Semi join; broadcasts ``right`` only when its counted rows are at most BROADCAST_ROWS."""
    right = right.select(*keys)
    return left.join(F.broadcast(right) if right_rows <= BROADCAST_ROWS else right, keys, "left_semi")


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file: in the folder GLYPHMILL_TOKENIZERS, else as the public_tokenizers package has it."""
    if folder := os.environ.get("GLYPHMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
