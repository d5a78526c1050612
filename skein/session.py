"""Sessions, and intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Spark's setting that deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Share of the driver's heap limit from which its garbage is collected before a table is written.
HEAP_SHARE = 0.4


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine, as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which driver and executors share.

    Only a local[*] session without that setting gets a temporary folder of its own.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.TemporaryDirectory(prefix="skein-")
        atexit.register(folder.cleanup)
        _OWN[app] = f"file://{folder.name}"
    return _OWN[app]


def collect_garbage(spark: SparkSession) -> bool:
    """Collect the driver's garbage if its heap has grown beyond HEAP_SHARE of its limit; whether it was.

    A heap that grew by garbage keeps its pages until a full collection, beside what the driver needs outside of it; and Spark deletes
    old broadcasts, there and on the executors, only once the driver's collector has found them.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= HEAP_SHARE * runtime.maxMemory():
        return False
    gc.collect()  # else Python still holds plans of the past
    spark._jvm.java.lang.System.gc()
    return True


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, computes the plan once, and survives the loss of any executor. The plan's shuffle files are deleted
    once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    collect_garbage(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_skein_path", None)
        if path:
            del df._skein_path
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
