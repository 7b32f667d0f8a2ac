"""Reading tables, writing intermediate tables and bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_local_folders: list[str] = []


@atexit.register
def _remove_local_folders() -> None:
    for folder in _local_folders:
        shutil.rmtree(folder, ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder, and a cluster the warehouse,
    as a folder of one machine would not survive there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if not _local_folders:
            _local_folders.append(tempfile.mkdtemp(prefix="arqueo-"))
        return _local_folders[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_arqueo"


_cleaned: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder, which is deleted when its driver ends."""
    folder = f"{shared_folder(spark)}/arqueo/{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _cleaned.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once an application, so that it needn't be installed on every machine."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if not _local_folders:
        _local_folders.append(tempfile.mkdtemp(prefix="arqueo-"))
    root, target = Path(__file__).resolve().parent, f"{_local_folders[0]}/arqueo-{app}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)  # the driver hands it out
    _shipped.add(app)


def written(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns a reader of it: lineage ends here,
    and a lost executor costs no more than a read."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that needs no Python to be made."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side of at most so many rows and bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000


def _width(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    total = F.lit(0)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        total = total + 16
    return total


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else as it is.

    The count stops at the limit. df should be cheap to compute, such as a written table.
    """
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(_width(df))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df
