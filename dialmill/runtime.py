"""Session helpers: shared storage for intermediate tables, size-checked joins, column hygiene."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and measured to stay within both bounds.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Inputs below this many bytes may be dealt to all cores after the scan.
SMALL_INPUT = 128 << 20
_stashed: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temp folder where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="dialmill-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of Python operators hold 500 rows or 4 MB at most, unless the session has own values.

    Workers then need the same memory whatever the lengths of texts, and so does the JVM, whose buffers outside the heap
    double while a batch grows and aren't given back; the settings don't change results.
    """
    for key, default, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")):
        if spark.conf.get(key) == default:
            spark.conf.set(key, own)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives its memory back to the system when its task ends; workers are used again by later stages."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clean`` deletes what is there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _stashed.append(path)
    return path


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the intermediate tables of this driver so far; call it once results are written. Their number."""
    n = 0
    while _stashed:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stashed.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a stashed table is within the broadcast bounds; counts rows and the characters of its string columns."""
    text = [c for c, t in df.dtypes if t in ("string", "binary")]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(8 * len(df.columns)))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def lookup_join(left: DataFrame, right: DataFrame, key: str, salt_from: Column, salts: int = 32) -> DataFrame:
    """Left join of many rows to a stashed table with one row per key (nulls match nulls).

    The table is broadcast when it fits; otherwise the left side is salted by ``salt_from`` and the table is
    replicated once per salt, so that a key that holds a third of the rows is spread over ``salts`` tasks.
    """
    r = right.withColumnRenamed(key, "__key")
    if fits_broadcast(right):
        return left.join(F.broadcast(r), left[key].eqNullSafe(r["__key"]), "left").drop("__key")
    r = r.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("__s", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    return left.join(r, left[key].eqNullSafe(r["__key"]) & (left["__s"] == r["__salt"]), "left").drop("__key", "__s", "__salt")


def placed(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """df with ``__place``, from 0 in the given order within each class, and ``__size``, the class's rows.

    Rows are sorted over all tasks by range, so no task holds a class: a place is the row's offset in its part plus the
    rows of the class in the parts before. Only that table, of as many rows as parts and classes, meets a window.
    """
    keys = [f"__by{i}" for i in range(len(by))]
    marked = df.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)})
    line = [*keys, *order] or [F.lit(0)]
    spread = marked.repartitionByRange(*line).sortWithinPartitions(*line)
    at = F.monotonically_increasing_id()
    rows = stash(spread.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at), "placed")
    parts = rows.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).withColumn("__size", F.sum("__n").over(Window.partitionBy(*keys)))
    parts = parts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__part").alias("__part_"), "__first", "__before", "__size")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col("__part") == F.col("__part_"))
    out = rows.join(F.broadcast(parts), same)  # as many rows as parts and classes together
    return out.withColumn("__place", F.col("__at") - F.col("__first") + F.col("__before")).select(*df.columns, "__place", "__size")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less every column whose name equals one of names, whatever its case: operators own their output names."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is a small input of fewer files than cores, whose one row group a single task would read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_INPUT and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
