"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words wherever a contract says ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a
    local master gets a temporary folder and a cluster a folder under the
    warehouse, which its machines share.
    """
    sc = spark.sparkContext
    own = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if own:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(own)
        return own
    if sc.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="prosegauge-")
        delete_at_end(spark, own)
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_prosegauge"
    sc.setCheckpointDir(own)
    return own


#: What a Python worker keeps from task to task: one object, by the name of what it serves.
HELD: dict[str, object] = {}


def held(name: str, make=lambda: None):
    """The object of that name, made once in a worker; one of another name goes, so that operators do not add up."""
    if name not in HELD:
        HELD.clear()
        HELD[name] = make()
    return HELD[name]


def small(batches, rows: int = 1000):
    """The batches cut into pieces, so that a Python worker holds the objects of few texts at a time, and sends small batches back."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder of the shared store when it ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def delete_now(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Where the caller of this thread collects the folders of what is written, to delete them when it is done with them; the rest go when the driver ends.
COLLECTED: ContextVar[list[str] | None] = ContextVar("collected", default=None)


@contextmanager
def collecting():
    """The folders of the tables that are written inside, by this thread and no other."""
    folders: list[str] = []
    token = COLLECTED.set(folders)
    try:
        yield folders
    finally:
        COLLECTED.reset(token)


LONG_STEP = 1.0  # seconds


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.option("compression", compression).parquet(path)
    delete_at_end(spark, path)
    if (folders := COLLECTED.get()) is not None:
        folders.append(path)
    if time.monotonic() - began > LONG_STEP:
        # Spark deletes the shuffle files of a finished step when its driver collects garbage, and has no other
        # call for it; after a long step, whose files may be large, that is worth a collection of the driver's heap.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges(a long, b long)`` with the smallest node that it reaches.

    Minimum labels spread along edges and then jump through the label's own
    label, so the number of rounds is about the logarithm of the longest path.
    Every round is one aggregation and joins that Spark can split at hot keys;
    labels are checkpointed, never collected. Returns (node, root); nodes of
    no edge do not appear. Raises if ``max_rounds`` do not suffice.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        up = labels.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        new = step.join(up, step.mid == up.up_node, "left").select("node", "was", F.least("mid", "up_root").alias("root"))
        new = checkpoint(new)
        if new.where("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def one_text_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, and the columns of ``wanted``): the documents that ``wanted`` names by doc_id; of several rows of an id, the text with the least hash.

    So a bounded number of ids gives a bounded number of rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    more = [c for c in wanted.columns if c != "doc_id"]
    return rows.groupBy("doc_id", *more).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def labelled_sample(labels: DataFrame, outcome: str, rows: int) -> DataFrame:
    """(doc_id, outcome) of at most ``rows`` labelled documents, the same in each run.

    Null ids and outcomes are left out; an id labelled more than once gets its
    smallest outcome.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(outcome).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(outcome).cast("int").alias("outcome"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
