"""Arrival of a month's file: it is checked by its footer, copied, and seen once its manifest is there.

A store has a folder of files for each arrival and a folder of manifests. A manifest names a month, the arrival's folder, the number of rows
and a digest of the files' names, sizes and rows. It is written last, as one file that is created or not, so a month is seen whole or not at
all, and of arrivals side by side one wins. A month that has a manifest is not taken in again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from farelens.sources.staging import delete

#: Kinds of number and of time that may stand for each other.
_ALIKE = ({"int", "bigint", "smallint", "tinyint"}, {"double", "float"}, {"timestamp", "timestamp_ntz"})


class RefusedError(ValueError):
    """A file that is broken, too short, or has other columns than wanted."""


@dataclass(frozen=True)
class Arrived:
    month: str
    rows: int
    added: bool  # False: the month was there already


def footer_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, rows`` of every Parquet file of a folder that has rows. No column is read, so only footers are."""
    files = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return files.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def _fits(have: str, want: str) -> bool:
    return have == want or any({have, want} <= kinds for kinds in _ALIKE)


def _files(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().toString() for s in system.listStatus(place) if s.isFile()) if system.exists(place) else []


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its content if there is none: it is written under another name and renamed without overwriting."""
    jvm = spark._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        system.delete(draft, False)
        return False
    return True


def _manifest(store: str, month: str) -> str:
    return f"{store}/manifests/{month}.json"


def months(spark: SparkSession, store: str) -> list[str]:
    return [f.rpartition("/")[2].removesuffix(".json") for f in _files(spark, f"{store}/manifests") if f.endswith(".json")]


def arrive(spark: SparkSession, path: str, store: str, month: str, schema: str, least_rows: int = 1) -> Arrived:
    """Takes the Parquet files of a folder in as a month.

    ``schema``: the columns that have to be there (more may be). Raises RefusedError for an empty folder, a file without a
    readable footer, missing or foreign columns, or fewer rows than ``least_rows``; nothing is seen of a refused arrival.
    """
    if month in months(spark, store):
        return Arrived(month, _read(spark, _manifest(store, month))["rows"], False)
    if not any(f.endswith(".parquet") for f in _files(spark, path)):
        raise RefusedError(f"no file in {path}")
    try:
        found = footer_rows(spark, path).orderBy("file").collect()  # a month's files
        given = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    except (SparkRuntimeException, AnalysisException, Py4JJavaError) as error:
        raise RefusedError(f"no readable footer in {path}") from error
    rows = sum(r.rows for r in found)
    if rows < least_rows:
        raise RefusedError(f"{rows} rows where {least_rows} are wanted")
    have = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    for f in StructType.fromDDL(schema).fields:
        if f.name not in have or not _fits(have[f.name], f.dataType.simpleString()):
            raise RefusedError(f"column {f.name}: {f.dataType.simpleString()} wanted, {have.get(f.name, 'nothing')} found")
    folder = f"files/{month}-{uuid.uuid4().hex}"
    given.write.parquet(f"{store}/{folder}")
    digest = hashlib.sha256(json.dumps([[r.file, r.bytes, r.rows] for r in found]).encode()).hexdigest()
    text = json.dumps({"month": month, "folder": folder, "rows": rows, "digest": digest})
    if not _create(spark, _manifest(store, month), text):  # another arrival came first
        delete(spark, f"{store}/{folder}")
        return Arrived(month, _read(spark, _manifest(store, month))["rows"], False)
    return Arrived(month, rows, True)


def row_count(spark: SparkSession, store: str, month: str) -> int:
    """The rows of a month, as its manifest says."""
    return _read(spark, _manifest(store, month))["rows"]


def read_month(spark: SparkSession, store: str, month: str, schema: str) -> DataFrame:
    """A month's rows, wanted columns first; none if the month has not arrived."""
    if month not in months(spark, store):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{store}/{_read(spark, _manifest(store, month))['folder']}").select(*(F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema).fields))
