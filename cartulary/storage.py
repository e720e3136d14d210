"""Working tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cartulary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/cartulary-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs that nothing refers to any more, and give freed memory back.

    The driver's JVM would keep 70 % of its heap free after a collection, and its
    C library what compilers, buffers and plans have freed: hundreds of MB in a
    long session.  Both go back here; the JVM's setting is as before afterwards.
    """
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass
    option, before = "MaxHeapFreeRatio", None
    try:
        before, least = (_managed(spark, "HotSpotDiagnostic", "getVMOption", x).get("value") for x in (option, "MinHeapFreeRatio"))
        _managed(spark, "HotSpotDiagnostic", "setVMOption", option, least)
    except Py4JError:  # another kind of JVM
        pass
    try:
        spark.sparkContext._jvm.System.gc()
    finally:
        if before is not None:
            with contextlib.suppress(Py4JError):
                _managed(spark, "HotSpotDiagnostic", "setVMOption", option, before)
    with contextlib.suppress(Py4JError):  # JVMs since 17.0.9 with glibc have it
        _managed(spark, "DiagnosticCommand", "systemTrimNativeHeap")


def _managed(spark: SparkSession, bean: str, operation: str, *args: str):
    """What an operation of the driver's JVM returns; called by its interface, since the class behind it is not open to Py4J."""
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java
    given = gateway.new_array(java.lang.Object, len(args))
    kinds = gateway.new_array(java.lang.String, len(args))
    for k, x in enumerate(args):
        given[k], kinds[k] = x, "java.lang.String"
    call = gateway.new_array(java.lang.Object, 4)
    call[0], call[1], call[2], call[3] = gateway.jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation, given, kinds
    method = next(m for m in java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    return method.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
