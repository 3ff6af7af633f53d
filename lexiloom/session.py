"""Session helpers: shipping this package to Python workers, and the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package as a zip file, once a context; they need not share our path."""
    context = spark.sparkContext
    if getattr(context, "_lexiloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="lexiloom-ship-")) / "lexiloom_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent).as_posix())
    context.addPyFile(str(path))
    context._lexiloom_shipped = True


_own: dict[str, str] = {}
_work: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` with its scheme.

    Where that is unset, a local session, whose executors are this process, gets a folder of our own; any other is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="lexiloom-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie in the shared folder; they are deleted when it ends."""
    out = f"{shared_folder(spark)}/lexiloom/{spark.sparkContext.applicationId}"
    if out not in _work:
        _work.add(out)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), out)
    return out


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: it is worked out once, however often it is read."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lexiloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def _delete(jvm, configuration, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(configuration).delete(where, True)
