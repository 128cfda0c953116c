"""Helpers shared by the operators: scratch tables, Python paths, bounded batches and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Words of 64 bits in the filter of `passing`: 16 MB of keys and bits at most are broadcast, good for some 10 million keys.
FILTER_WORDS = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package. Settings of the session stay as the caller has them."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """For entry points, whose session it is: batches to Python of `size` bytes at most (a longer row alone).

    Operators leave the setting as it is (64 MB unless set), so a caller with larger executors may take larger batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"\d+", spark.conf.get(key, f"{64 << 20}b"))[0])
    if now > size:
        spark.conf.set(key, f"{size}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_known_id(docs: DataFrame, *columns: Column) -> DataFrame:
    """doc_id as long, 0 for null, and `known`, false for null: pandas has no exact column of integers with nulls."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), doc_id.isNotNull().alias("known"), *columns)


def known_id() -> Column:
    """doc_id as it was before with_known_id."""
    return F.when(F.col("known"), F.col("doc_id")).alias("doc_id")


def pieces(batches: Iterable[pd.DataFrame], column: str = "text", rows: int = 500, size: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """The rows of batches in runs of at most `rows` rows and about `size` characters in `column` (a longer text alone).

    Spark bounds a batch in bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set); what is made of its
    rows is bounded here.
    """
    for batch in batches:
        at = held = 0
        for i, text in enumerate(batch[column]):
            held += len(text) if text is not None else 0
            if held > size and i > at or i - at >= rows:
                yield batch.iloc[at:i]
                at, held = i, len(text) if text is not None else 0
        if at < len(batch):
            yield batch.iloc[at:]


def sampled(rows: DataFrame, share: Column) -> DataFrame:
    """(doc_id, fp, text, ...) of the rows whose hash of doc_id and text lies below share, equal rows once.

    Which rows these are depends on nothing but the rows. Equal rows are folded before they move, so a hot one is one.
    """
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)
    other = [c for c in rows.columns if c != "text"]
    return rows.where(part).withColumn("fp", F.xxhash64("text")).groupBy("fp", *other).agg(F.first("text").alias("text"))


#: What operators remember in a Python worker, by their names.
_remembered: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Register how to forget what an operator holds in this process beyond a task."""
    _remembered[operator] = forget


def at_work(operator: str = "") -> None:
    """Called in a worker for each batch: what other operators remember goes. Workers are reused by the next stage, so
    without this its memory would come on top."""
    others = [n for n in _remembered if n != operator]
    for name in others:
        _remembered.pop(name)()
    if others and sys.platform == "linux":  # hand free memory back to the system, where the C library can
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset.

    A temporary folder of this machine serves only where master is local, that is, one process; on a cluster
    without the setting the warehouse folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="parchment-")
            atexit.register(_remove_tree, found[7:])
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_parchment_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there goes when the session's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def spent(*tables: DataFrame) -> None:
    """Remove tables of `written` that no plan reads any more."""
    for df in tables:
        if path := _places.pop(df, None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def passing(rows: DataFrame, wanted: DataFrame, keys: list[str], keep: bool = True) -> DataFrame:
    """The rows whose keys may be in wanted (with keep), or those whose keys surely are not; rows keep their order.

    A blocked Bloom filter: each key sets four bits of one of at most FILTER_WORDS words of 64, which are broadcast.
    So the broadcast is bounded whatever the size of wanted. A full filter lets more rows pass, and what follows is
    exact all the same: callers join what passes.
    """
    at, bits = F.pmod(F.xxhash64(*keys), F.lit(FILTER_WORDS)), F.xxhash64(*keys, F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftright(bits, 6 * k).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    words = wanted.select(at.alias("__at"), mask.alias("__mask")).groupBy("__at").agg(F.bit_or("__mask").alias("__word"))
    there = F.coalesce(F.col("__word").bitwiseAND(mask) == mask, F.lit(False))
    return rows.withColumn("__at", at).join(F.broadcast(words), "__at", "left").where(there if keep else ~there).select(rows.columns)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b, both long): (node, root), root the smallest node reached.

    Alternating large-star and small-star contraction; every round is written to the shared folder. A row per edge
    is moved in a round, and the rounds grow with the logarithm of the longest path. Edge with a null end: left out.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), total).first()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), label)
        spent(before)
        next_seen = now.agg(F.count("*"), total).first()
        if next_seen == seen:
            break
        seen = next_seen
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
