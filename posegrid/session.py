"""Session helpers: sends the package to the executors' Python workers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the Python path of all tasks, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="posegrid-ship-")
    atexit.register(shutil.rmtree, folder, True)
    shutil.make_archive(os.path.join(folder, here.name), "zip", here.parent, here.name)
    context.addPyFile(os.path.join(folder, f"{here.name}.zip"))
    _SENT.add(context.applicationId)


_LOCAL: list[str] = []
_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share (spark.checkpoint.dir); it goes at the end.

    Where the setting is missing, only a local master may use a folder of its own: on a cluster each executor would
    write to its own disk.
    """
    ship(spark)
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        app = spark.sparkContext.applicationId
        if app not in _ROOTS:
            _ROOTS[app] = f"{set_by_cluster.rstrip('/')}/posegrid-{app}-{uuid.uuid4().hex[:8]}"
            atexit.register(_remove, spark, _ROOTS[app])
        return _ROOTS[app]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="posegrid-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before us
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Steps between two calls of ``tidy``.
TIDY_EVERY = 3
_STEPS = [0]


def tidy(spark: SparkSession) -> None:
    """Collect garbage on the driver. Spark's cleaner drops the shuffles and broadcasts of finished steps, here and on
    the executors, only once the JVM has collected their handles, which by itself it does on a full heap or every half hour.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Give the driver's freed native memory back to the system, as ``jcmd PID System.trim_native_heap`` does.

    The C library keeps what the JVM's compiler threads free in arenas of their own. False where the JVM has no such command.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # The server's own class is not open to reflection, its interface is.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = new(jvm.java.lang.Object, 4)
    args[0], args[1], args[2], args[3] = named, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
    try:
        call.invoke(server, args)
    except Py4JError:
        return False
    return True


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage of an iteration and survives lost executors."""
    _STEPS[0] += 1
    if _STEPS[0] % TIDY_EVERY == 0:
        tidy(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what ``settle`` wrote, once nothing reads it any more; other tables are left alone."""
    for df in tables:
        if path := df.__dict__.pop("settled_at", None):
            _remove(df.sparkSession, path)
