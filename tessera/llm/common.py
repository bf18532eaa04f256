"""Helpers shared by the corpus operators: tables, hashing, checkpoints, component labelling."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separator class of the corpus contracts: space and the five ASCII control spaces.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of spark.checkpoint.dir; one of our own only on a local master that names none, as in tests."""
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"{tempfile.gettempdir()}/tessera-checkpoints")
    return sc.getCheckpointDir().get()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions within delete their shuffle files as they end; only for plans that nothing runs again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder (survives lost executors)."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    drop_unused(df.sparkSession)
    return out


def drop_unused(spark: SparkSession) -> None:
    """Let the driver find shuffles and checkpoints that nothing refers to any more, and delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Return freed native memory of the driver's JVM to the system: hundreds of threads plan and run queries there, and
    what they allocate outside the heap stays with the process.  False on JVMs that have no such command."""
    sc = spark.sparkContext
    server = sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    args = sc._gateway.new_array(sc._jvm.java.lang.Object, 4)
    args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by the interface's method: the server's own class is not open to callers
    invoke = next(m for m in sc._jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


#: Folders of ours that are still there.
_STORED: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: compressed, and cut from its lineage.

    The shuffles that made it go at once.  discard() deletes the table; what a returned result still reads
    stays until the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    removed_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed_at_exit(spark: SparkSession, path: str) -> None:
    _STORED[path] = spark


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _STORED.pop(path, None)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_STORED.items()):
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, their partitioning by long keys hidden from the planner.

    A join right above an aggregation by its own keys can't be split by adaptive execution, because the
    aggregation needs a key's rows together.  Hidden, the (small) aggregated side is dealt once more and
    the join may split keys that very many rows share.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(1)).bitwiseXOR(F.lit(1)) for k in keys})


def text_key(text) -> list:
    """Two 64-bit halves of the MD5 of a text (null counts as empty): the identity of a text."""
    digest = F.md5(F.coalesce(text, F.lit("")))
    half = lambda at: F.coalesce(F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint"), F.lit(0))
    return [half(1).alias("r1"), half(17).alias("r2")]


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (int64, one more than rows) of a string array; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most_bytes together (one row at least)."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        end = min(rows, max(at + 1, end))
        yield at, end
        at = end


def small_batches(batches, col: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of one string column (one row at least)."""
    for batch in batches:
        _, offsets = string_buffers(batch.column(col))
        for at, end in row_slices(offsets, most_bytes):
            yield batch.slice(at, end - at)


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers are kept, and with them what large arrays have left."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such function outside glibc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges(a, b).

    Alternates the large-star and small-star steps on canonical edges until they are stars around
    their minimum; each round is two shuffles of the edge list, and the number of rounds grows with
    the logarithm of the longest chain.  Each round goes through the shared checkpoint folder.
    No node's neighbours are ever gathered in one row: a step takes the minimum per node with
    map-side combination, then joins it back to the edges.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (now := (row[0], row[1])) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
