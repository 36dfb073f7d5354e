"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch on its way to a Python worker. Texts are of any length, so that a count of rows bounds no memory.
BATCH_BYTES = 4_000_000

#: Scratch tables are read by the run that wrote them, which knows that they are whole: they need no marker file.
_UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_memos: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Have this session cut Arrow batches at BATCH_BYTES; the setting holds for all that it runs later, and only memory depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Memo(dict):
    """A worker's cache of at most `limit` entries. Workers outlive a query: the first use of another memo empties this one, so that caches of several operators never add up."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self) -> None:
        if len(self) >= self.limit:
            self.clear()


@lru_cache(maxsize=1)
def thrift() -> None:
    """Have this process give large arrays back to the system as soon as they are freed, where its C library can: memory of one stage is not held through the next."""
    pa.set_memory_pool(pa.system_memory_pool())
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        for what, value in ((-3, 1 << 18), (-1, 1 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            option(what, value)


def use(memo: object) -> None:
    """The calling task works with this memo, a Memo or what else has clear() and a length: all others of the worker are emptied, and what they held goes back to the system."""
    thrift()
    if not any(m is memo for m in _memos):
        _memos.append(memo)
    stale = [m for m in _memos if m is not memo and len(m)]
    if stale:
        for m in stale:
            m.clear()
        release()


def release() -> None:
    """Give memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def column(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, each followed by as many underscores as make it differ from every column of docs in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_whole_rows(docs: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """docs.mapInArrow(run, schema) for columns of any names: run sees them by place."""
    bounded_batches(docs.sparkSession)
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id bigint, text string): other columns, whatever their names, stay outside; null text becomes empty."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of our own in a local session, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            root = sc.getCheckpointDir()
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone: the folder's own retention then applies
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back, so that a lost executor costs a re-read and not a recomputation.

    narrow: df holds ids and numbers only, and so is written by an eighth of the shuffle's tasks, each into one file, instead of many tiny ones.
    """
    path = scratch_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(1, tasks(df.sparkSession) // 8))
    df.write.options(compression="zstd", **_UNMARKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """materialize(df), laid out by key: a join on key with as many shuffle partitions reads it where it lies. The table's entry in the catalog goes when the driver ends."""
    spark, table_name = df.sparkSession, f"graphloom_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").options(compression="none", path=scratch_path(spark, name), **_UNMARKED).bucketBy(buckets, key).saveAsTable(table_name)
    atexit.register(_forget, spark, table_name)
    return spark.table(table_name)


def _forget(spark: SparkSession, table_name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
    except Exception:  # the session may be gone, and its catalog with it
        return


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most buckets - 1 ascending split points of a bigint key, from an approximate percentile over all rows (key column only)."""
    if buckets < 2:
        return []
    steps = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, steps, 20 * buckets).alias("p")).first()
    return sorted({int(x) for x in (row.p or [])})


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """Number of the range that holds key: 0 up to len(bounds); rows equal to a bound lie in the upper range; null keys in range 0.

    Two steps over the ascending bounds, by every step-th bound and then within one step, so that a row costs twice the root of their number.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    below = lambda values: F.coalesce(F.size(F.filter(values, lambda b: b <= key)), F.lit(0))
    ends = bounds[step - 1 :: step]
    full = below(literal(ends)) * step if ends else F.lit(0)
    return (full + below(F.slice(literal(bounds), full + 1, F.lit(step)))).cast("int")


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each pair, one after another."""
    full = sizes > 0
    starts, sizes = starts[full].astype(np.int64), sizes[full].astype(np.int64)
    if not len(sizes):
        return flat[:0]
    at = np.ones(int(sizes.sum()), np.int64)
    first = np.cumsum(sizes) - sizes
    at[first] = starts
    at[first[1:]] -= (starts + sizes - 1)[:-1]
    return flat[np.cumsum(at)]


def expand(ends: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[start:end] of each code, runs being told by their ends; also the ends of the concatenated runs."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    sizes = (ends - starts)[codes]
    return gather(flat, starts[codes], sizes), np.cumsum(sizes)
