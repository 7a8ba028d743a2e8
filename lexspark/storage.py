"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_folders: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all of Spark is this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; what is left in it goes when the driver ends."""
    path = f"{shared_dir(spark)}/lexspark-{spark.sparkContext.applicationId}"
    if path not in _folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        _folders[path] = place
        atexit.register(_delete, files, place)
    return path


def _delete(files, place) -> None:
    try:
        files.delete(place, True)
    except Exception:  # the JVM is gone already: nothing can be deleted through it
        pass


#: Has Spark delete the shuffle files of a query when it ends; nothing reads a written plan's shuffles again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of at most so many bytes (a longer row alone): several copies of a batch are in memory at once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs no recomputation.

    The write runs under a clone of the session, so its settings touch no other query.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = spark._jsparkSession.cloneSession()
    own.conf().set(CLEANUP, "true")
    own.conf().set(BATCH, BATCH_BYTES)
    spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.logicalPlan()).write().option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lexspark_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that kept() wrote and that no plan still reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.lexspark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
