"""What the operators of this subpackage share: tables, words, and written intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's and RE2's dialects: anything but the six ASCII blanks. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="envlattice-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clear
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/envlattice-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Removes a query's shuffle files when it ends: once its result is written, nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, is computed once, and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes a table made by ``written`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def n_words(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns what this process has freed to the system: Python workers outlive their tasks, and count as their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def give_back_driver(spark: SparkSession) -> bool:
    """The same for the driver's JVM, if it can: each query's short-lived threads leave what they freed in pools of their own."""
    jvm = spark._jvm
    try:
        # by the interface's method: the class of the beans' server is not open to other modules
        beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in beans.getMethods() if m.getName() == "invoke")
        told = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        told[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        told[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), told)
    except Exception:  # noqa: BLE001  other JVMs have no such command, and nothing depends on it
        return False
    return True


def returning(run: Callable, *ends: Callable) -> Callable:
    """A function for ``mapInArrow`` that calls ``ends`` and gives back memory when its task is done."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for end in ends:
                end()
            give_back()

    return all_of
