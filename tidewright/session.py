"""Session settings, and the package for the executors' Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with adaptive execution; shuffle partitions follow the data."""
    chosen = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"} | settings
    return SparkSession.builder.master(master).config(map=chosen).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors' Python, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tidewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidewright-")) / "tidewright.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tidewright_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error, as its
    executors would not see one another's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
    return folder.rstrip("/")


#: Attribute of a written table's DataFrame that holds its path.
_PATH = "_tidewright_path"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder: later readers start from the table,
    so lost executors cost no recomputation and its rows stay the same."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables from saved() whose readers have all been written themselves."""
    for table in tables:
        path = getattr(table, _PATH)
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
