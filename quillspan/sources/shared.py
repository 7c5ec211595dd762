"""Tables and the one folder that driver and executors share."""

from __future__ import annotations

import atexit
import io
import tempfile
import time
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (single-machine runs and tests).
LOCAL_FALLBACK = "file:///tmp/checkpoints/quillspan"


#: Rows and bytes of an Arrow batch, whichever is reached first (one longer row is a batch of its own).
ARROW_ROWS, ARROW_BYTES = 1000, "32m"

#: Share of the driver's largest heap from which it is collected between tables, and the least seconds between two looks at it.
HEAP_SHARE, HEAP_SECONDS = 0.5, 5.0
#: Least and largest percentage of the driver's heap that a collection leaves free (the JVM's own are 40 and 70).
HEAP_FREE = {"MinHeapFreeRatio": 20, "MaxHeapFreeRatio": 40}
_looked = 0.0


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application; executors fetch it from the driver.

    Texts are long, so Arrow batches are held to ``ARROW_ROWS`` rows and ``ARROW_BYTES``.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if getattr(context, "_quillspan_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    path = Path(tempfile.mkdtemp()) / "quillspan.zip"
    path.write_bytes(held.getvalue())
    context.addPyFile(str(path))
    context._quillspan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder, read by Spark alone (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fallback is set only where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)


def _manage(spark: SparkSession, bean: str, operation: str, *texts: str) -> None:
    """Call a management operation of the driver's JVM; a JVM that lacks it stays as it is."""
    gateway, java = spark.sparkContext._gateway, spark.sparkContext._jvm.java.lang

    def array(kind: object, items: Sequence) -> object:
        out = gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            out[k] = item
        return out

    try:
        # The server's class is not public, so the call goes by its interface.
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, [java.Class.forName(k) for k in kinds]))
        name = spark.sparkContext._jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(java.Object, [name, operation, array(java.Object, texts), array(java.String, [kinds[1]] * len(texts))]))
    except Py4JError:
        pass


def shrink_driver(spark: SparkSession) -> bool:
    """Hand back memory that the driver's JVM holds without need; says whether its heap was collected.

    The heap is collected if it has grown beyond ``HEAP_SHARE`` of its bound: plans and jobs leave garbage that the JVM would
    sooner grow for than collect. That gives all but ``HEAP_FREE`` back to the system, and frees the shuffle files and
    broadcast blocks of frames that nothing refers to any more. What was freed outside the heap (by the compiler and by
    hundreds of threads) the C library keeps in pools of its own until it is told to trim them.
    """
    global _looked
    if time.monotonic() - _looked < HEAP_SECONDS:
        return False
    context, system = spark.sparkContext, spark.sparkContext._jvm.java.lang
    if not getattr(context, "_quillspan_heap_free", False):
        for name, percent in HEAP_FREE.items():
            _manage(spark, "HotSpotDiagnostic", "setVMOption", name, str(percent))
        context._quillspan_heap_free = True
    runtime = system.Runtime.getRuntime()
    over = runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory()
    if over:
        system.System.gc()
    _manage(spark, "DiagnosticCommand", "systemTrimNativeHeap")
    _looked = time.monotonic()
    return over


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts lineage in a way that survives lost executors: Spark's committer publishes whole files only,
    and every executor can read them. The files go with ``discard``, or
    when the driver ends.
    """
    path = f"{shared_dir(spark)}/quillspan-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    shrink_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspan_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that nothing will read again (other frames are left alone)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        if path := getattr(df, "_quillspan_path", None):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def small_enough(df: DataFrame, limit_rows: int) -> bool:
    """Whether ``df`` has at most ``limit_rows`` rows; stops counting soon after."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def sized_broadcast(df: DataFrame, limit_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit_rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, limit_rows) else df


#: Bits of one row of a bit map, bits for each key, and the most bits of all (128 MB; more keys pass more rows).
MAP_ROW, KEY_BITS, MOST_BITS = 32_768, 32, 1 << 30


def among(rows: DataFrame, keys: DataFrame, on: str, limit_rows: int, exact: bool = True) -> DataFrame:
    """``rows`` whose ``on`` is in ``keys``; if not ``exact``, with a few others (for an exact join that follows).

    More than ``limit_rows`` keys are broadcast as bits of their hashes, so that rows without a key drop out before the
    join shuffles them.
    """
    keys = keys.select(on)
    if small_enough(keys, limit_rows):
        return rows.join(F.broadcast(keys), on, "left_semi")
    bits = min(MOST_BITS, -(-keys.count() * KEY_BITS // MAP_ROW) * MAP_ROW)
    place = F.pmod(F.xxhash64(on), F.lit(bits))
    maps = keys.select(place.alias("_place")).groupBy(F.expr(f"_place div {MAP_ROW}").alias("_row")).agg(F.bitmap_construct_agg(F.expr(f"_place % {MAP_ROW}")).alias("_bits"))
    met = rows.withColumn("_place", place).join(F.broadcast(maps), F.expr(f"_place div {MAP_ROW}") == F.col("_row"))
    byte = f"CAST(conv(hex(substring(_bits, CAST(_place % {MAP_ROW} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    likely = met.where(f"shiftright({byte}, CAST(_place % 8 AS INT)) & 1 = 1").select(*rows.columns)
    return likely.join(keys, on, "left_semi") if exact else likely


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
