"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python worker gets at once; long texts make batches of some tens of MB at most.
BATCH_ROWS = 2048
BATCH_BYTES = 32 << 20
#: What is broadcast takes so many bytes at most; executors hold a few times as many for its hash table.
MOST_BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets a new
    one; on a cluster that is an error, as no folder of the driver's machine would be seen by the others."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.vellum_path = path
    return out


def arrow(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows and BATCH_BYTES bytes at most for Python workers; columns may pass 2 GB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")


def release() -> None:
    """Gives memory that Python and Arrow no longer use back to the system. A Python worker outlives its task; without this,
    what one operator's models took would stay beside the next operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Asks the executors' JVMs to collect their garbage, upon which they return heap that they don't use. A JVM lets its heap
    grow to its bound before it collects; where it shares a container with Python workers, a stage of large Python workers
    behind stages that ran in the JVM would find no room left."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def by_batch(df: DataFrame, f: Callable, schema, rows: int = BATCH_ROWS, make: Callable | None = None) -> DataFrame:
    """mapInArrow of one batch at a time, in slices of so many rows: f(batch) gives a batch, several, or None. make() builds
    what all batches of a task share (a model, a tokenizer); f(made, batch) gets it, and it goes when the task ends."""
    arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    if make is None:
                        out = f(part)
                    else:
                        made = make() if made is None else made
                        out = f(made, part)
                    if isinstance(out, pa.RecordBatch):
                        yield out
                    elif out is not None:
                        yield from out
        finally:
            batch = part = out = made = None
            if make is not None:  # models may hold themselves; a search for such is dearer than a small task without one
                gc.collect()
            release()

    return df.mapInArrow(run, schema)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row, however often f names it."""
    return F.transform(F.array(value), f)[0]


def broadcast_below(df: DataFrame, most: int, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes, else as it is (joins then shuffle). Both are
    measured, no further than the bound on rows."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + 16 + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 + 16 * F.greatest(F.size(field.name), F.lit(0))
        else:
            size = size + 8
    n, total = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if n <= most and (total or 0) <= most_bytes else df
