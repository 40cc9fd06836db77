"""Tables in the shared folder: written once, read many times, safe against lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_STAGED: dict[tuple[str, str, str, str], tuple[str, DataFrame]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none (unit tests in local mode) a temporary folder of this process is
    used; on a cluster the setting has to be present.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not _LOCAL_ROOT:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="farelens-"))
    return _LOCAL_ROOT[0]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/farelens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has staged, once no frame that reads them is used any more."""
    delete(spark, _own_folder(spark))
    for key in [k for k in _STAGED if k[0] == spark.sparkContext.applicationId]:
        del _STAGED[key]


#: Spark's own switch: an execution's shuffle files go when it has ended, not when the driver collects its garbage.
SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Inside, what a write has shuffled is deleted once the table stands."""
    before = spark.conf.get(SWEPT)
    spark.conf.set(SWEPT, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEPT, before)


def _write(df: DataFrame, path: str, codec: str) -> None:
    with _swept(df.sparkSession):
        df.write.option("compression", codec).parquet(path)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    _write(df, path, codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        delete(df.sparkSession, df._staged_path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of what a folder holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return ";".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in system.listStatus(place)))


def staged(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame:
    """A step between two plans, as a table: built on first use for the files that an input folder holds, anew when they have changed.

    The panel, the personas and the trace are such steps; each is read by many statistics, and one plan
    through all of them would repeat its inputs at every use. ``build`` may return tables of ``materialize`` behind its frame, which are deleted
    once that stands.
    """
    key = (spark.sparkContext.applicationId, folder, _state(spark, folder), name)
    if key not in _STAGED:
        built = build()
        df, *scratch = built if isinstance(built, tuple) else (built,)
        path = new_path(spark, name)
        _write(df, path, "zstd")
        discard(*scratch)
        _STAGED[key] = (path, df)
    path, df = _STAGED[key]
    return spark.read.schema(df.schema).parquet(path)
