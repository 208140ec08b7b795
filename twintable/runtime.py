"""Session-level helpers: reading tables, cutting lineage, and cleaning up after it."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import twintable
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this package travel to the executors by value, so these need no copy of it.
cloudpickle.register_pickle_by_value(twintable)

_scopes = threading.local()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _is_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's folder below the shared ``spark.checkpoint.dir``.

    Where none is named, a session that runs in one process gets a private folder; on a cluster that is an
    error, as executors could not read what others wrote. The folder goes when the program ends.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not _is_one_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="twintable-"))
        found = sc._jsc.sc().getCheckpointDir()
        atexit.register(_delete, spark, found.get())
    return found.get()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already
        pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end. A result that outlives it is cut with ``keep=True``."""
    outer = getattr(_scopes, "path", None)
    _scopes.path = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        _delete(spark, _scopes.path)
        _scopes.path = outer


def _write(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table into the shared checkpoint folder and read it back, without its lineage.

    The copy survives the loss of executors and, unlike a checkpointed RDD, has true size statistics and
    prunes columns. Size estimates of iterative plans would otherwise multiply from round to round. Inside
    ``scratch`` the table goes with it, unless ``keep``.
    """
    base = checkpoint_dir(df.sparkSession)
    return _write(df, base if keep else getattr(_scopes, "path", None) or base)


def cut_all(*dfs: DataFrame) -> list[DataFrame]:
    """``cut`` of several tables that don't build on each other, in one job: each is a partition of one table."""
    spark = dfs[0].sparkSession
    path = f"{getattr(_scopes, 'path', None) or checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    rows = [
        df.select(F.lit(i).alias("part"), *[(F.struct(*df.columns) if i == k else F.lit(None).cast(x.schema)).alias(f"t{k}") for k, x in enumerate(dfs)])
        for i, df in enumerate(dfs)
    ]
    reduce(DataFrame.unionByName, rows).write.partitionBy("part").parquet(path)
    whole = spark.read.schema(T.StructType([*[T.StructField(f"t{k}", df.schema) for k, df in enumerate(dfs)], T.StructField("part", T.IntegerType())])).parquet(path)
    return [whole.where(f"part = {k}").select(f"t{k}.*") for k in range(len(dfs))]


class Growing:
    """A table in the checkpoint folder that steps add rows to, for a step to read what those before it wrote."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{getattr(_scopes, 'path', None) or checkpoint_dir(self.spark)}/grow-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def release(spark: SparkSession) -> None:
    """Lets go of what finished rounds left behind.

    Spark drops shuffle files, broadcasts and generated code when the driver's garbage collector finds their plans
    unused. An operator that runs many small jobs fills disks and the driver long before that happens by itself.
    What the JVM has freed outside of its heap (compilers, codecs) goes back to the system too: the C library would
    keep it in the pools of the threads that had it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Gives freed native memory of the driver's JVM back to the system; False where the JVM has no such command."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kind, management = jvm.java.lang.Class.forName, jvm.java.lang.management.ManagementFactory
    try:
        # The server's own class is hidden from callers, so that its interface has to be named.
        kinds, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = kind(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(management.getPlatformMBeanServer(), values)
    except Py4JError:  # another system or an older JVM
        return False
    return True


def parallelism(spark: SparkSession) -> int:
    """Tasks that a wide step should have at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
