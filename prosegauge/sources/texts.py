"""Text files as documents."""

from __future__ import annotations

import sys
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, *paths: str, stdin=None) -> DataFrame:
    """(doc_id, text): one row for each file, named by its path; ``-`` is the standard input.

    Paths may be folders or patterns, in any store that Spark reads. A file
    is one row, so its bytes must fit a task; bytes that are not UTF-8 raise.
    """
    files = [p for p in paths if p != "-"]
    out = spark.createDataFrame([("-", (stdin or sys.stdin).read())] if "-" in paths else [], "doc_id string, text string")
    if not files:
        return out
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files)
    text = F.expr("validate_utf8(cast(content AS STRING))")
    found = raw.select(one_slash(F.col("path")).alias("doc_id"), text.alias("text"))
    # Spark reads no row from an empty file, but lists it.
    listed = spark.createDataFrame([(unquote(f),) for f in raw.inputFiles()], "name string").select(one_slash(F.col("name")).alias("doc_id"))
    return out.unionByName(listed.join(found, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def one_slash(path: Column) -> Column:
    """A path whose scheme is followed by one slash, however it was written."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+(?=/)", "$1:")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder that the cluster shares, and read back.

    All its readers see the same rows, read only the columns they ask for, and
    lose nothing with an executor; what was written goes when the driver ends,
    or by ``discard``.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/written/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    Folder(df.sparkSession, path).delete_at_end()
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def delete_at_end(self) -> None:
        self.store.deleteOnExit(self.path)

    def delete(self) -> None:
        self.store.delete(self.path, True)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``, which must be what it returned."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        Folder(df.sparkSession, file).delete()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one is set where there is none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def settled(docs: DataFrame) -> DataFrame:
    """docs with doc_row, the number of each row, written: whatever the rows came from and however often they are computed, a row keeps its number."""
    return written(docs.withColumn("doc_row", F.monotonically_increasing_id()))


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt over all cores where the input has fewer partitions than these, as a file of one row group has; else as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_row") if docs.rdd.getNumPartitions() < cores else docs
