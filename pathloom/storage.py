"""Tables on storage that driver and executors share.

Intermediate results that must outlive an executor are written as Parquet under
the folder that the session names in ``spark.checkpoint.dir``.  Where it names
none, a folder of our own serves a single machine, and is deleted when the process
ends; a session with executors elsewhere is refused, as they would not see it.

What a loop has read for the last time it gives to ``discard``; the rest goes by
``clear`` when the results that were made from it are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own_dirs: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        own = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dirs[app] = f"file://{own}"
    return _own_dirs[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    # Parquet reads every column back as nullable.
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables of frames that ``stored`` gave back, if nothing will read them any more."""
    for df in frames:
        if df is not None and getattr(df, "stored_at", None):
            _delete(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this session has stored and not discarded; how many there were."""
    paths = sorted(_written.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)
