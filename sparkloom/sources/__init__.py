"""Sources: CSV typed by its first row, Parquet, JSON, text, memory, and addresses of any of them; sinks that return where they wrote."""

from __future__ import annotations

import re
import urllib.request
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import column
from ..operators import prune
from ..session import shared_folder

_INTEGER = re.compile(r"[+-]?[0-9]+")


def sniff(sample: str | None) -> T.DataType:
    """The type that a CSV cell suggests: blank or NULL text, true and false boolean, then bigint, double, text."""
    value = (sample or "").strip()
    if value == "" or value.upper() == "NULL":
        return T.StringType()
    if value in ("true", "false"):
        return T.BooleanType()
    if _INTEGER.fullmatch(value) and -(2**63) <= int(value) < 2**63:
        return T.LongType()
    try:
        if "_" not in value:
            float(value)
            return T.DoubleType()
    except ValueError:
        pass
    return T.StringType()


def _cell(name: str, kind: T.DataType) -> Column:
    """A text cell as its column's type: empty and NULL are null, what is no number is null, what is not "true" is false."""
    raw = column(name)
    some = F.when(raw.isin("", "NULL"), F.lit(None)).otherwise(raw)
    if isinstance(kind, T.BooleanType):
        return F.when(some.isNotNull(), some == F.lit("true")).alias(name)
    if isinstance(kind, T.StringType):
        return some.alias(name)
    return some.try_cast(kind).alias(name)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; the first data row decides the types. ValueError without a data row; ragged rows raise when read."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", nullValue="NULL", emptyValue="")
    first = raw.take(1) if raw.columns else []
    if not first:
        raise ValueError("a CSV source needs a header and a data row")
    return raw.select(*(_cell(c, sniff(v)) for c, v in zip(raw.columns, first[0])))


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet file or folder; with columns only these are read, in this order."""
    df = spark.read.parquet(path)
    return df if columns is None else prune(df, *columns)


def json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, array of objects, or one object a line."""
    first = next((r[0] for r in spark.read.text(path).where(F.trim("value") != "").take(1)), "")
    lines = first.strip().startswith("{") and first.strip().endswith("}")
    return spark.read.json(path, multiLine=not lines)


def text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text, as column value."""
    return spark.read.text(path)


def memory(spark: SparkSession, names: list[str], columns: list) -> DataFrame:
    """A table from equally long lists or Arrow arrays, in order of names; unsigned and 16-bit float arrays widen."""
    if len(names) != len(columns):
        raise ValueError(f"{len(names)} names for {len(columns)} columns")
    try:
        arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns]
    except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
        raise ValueError(f"unsupported column: {e}") from e
    if len({len(a) for a in arrays}) > 1:
        raise ValueError("columns differ in length")
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32()}
    return spark.createDataFrame(pa.table([a.cast(wider.get(a.type, a.type)) for a in arrays], names))


#: Readers by media type or suffix.
READERS = {"text/csv": csv, "csv": csv, "application/json": json, "json": json, "application/parquet": parquet, "application/octet-stream": parquet, "parquet": parquet, "text/plain": text, "txt": text}


def resolve(uri: str) -> str:
    """The path that Spark reads for an address: s3 becomes s3a, others stay. Credentials come from the environment or Hadoop's settings only."""
    parts = urlparse(uri)
    if not uri.strip():
        raise ValueError("an address is needed")
    if parts.scheme in ("s3", "s3n"):
        return "s3a" + uri[len(parts.scheme) :]
    if parts.scheme not in ("", "file", "s3a", "hdfs", "viewfs", "abfss", "gs", "http", "https"):
        raise ValueError(f"unknown scheme {parts.scheme!r}")
    return uri


def fetch(spark: SparkSession, url: str, most: float, timeout: float) -> str:
    """Copy an http address to the folder that driver and executors share; returns the copy's path. ValueError beyond most bytes."""
    path = f"{shared_folder(spark)}/fetched-{uuid.uuid4().hex}/{urlparse(url).path.rsplit('/', 1)[-1] or 'file'}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size, whole = 0, False
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        out = store.create(at)
        try:
            while chunk := answer.read(1 << 20):
                size += len(chunk)
                if size > most:
                    raise ValueError(f"the source is larger than {most:.0f} bytes")
                out.write(bytearray(chunk))
            whole = True
        finally:
            out.close()
            if not whole:
                store.delete(at.getParent(), True)
    return path


def copied(spark: SparkSession, path: str, most: float) -> str:
    """Copy a file of any store to the shared folder; returns the copy's path. ValueError beyond most bytes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(conf)
    if store.getContentSummary(source).getLength() > most:
        raise ValueError(f"the source is larger than {most:.0f} bytes")
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/fetched-{uuid.uuid4().hex}/{source.getName()}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(store, source, target.getFileSystem(conf), target, False, conf)
    return target.toString()


def open_source(spark: SparkSession, uri: str, mime: str | None = None, config: Config | None = None) -> DataFrame:
    """A source by address; its kind is the media type's, else the suffix's. Spreadsheets have no reader.

    http sources, and with should_download those of other stores, are copied to the shared folder first, within
    the settings' max_download_size_mb; http waits for its timeout.
    """
    kind = (mime or urlparse(uri).path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind in ("xls", "xlsx") or "spreadsheet" in kind or "excel" in kind:
        raise ValueError("spreadsheets have no reader; save the sheet as CSV")
    if kind not in READERS:
        raise ValueError(f"unknown kind of source {kind!r}")
    path, config = resolve(uri), config or Config()
    most = config.batch.max_download_size_mb * 1e6
    if path.startswith(("http://", "https://")):
        path = fetch(spark, path, most, config.server.timeout)
    elif config.batch.should_download and urlparse(path).scheme not in ("", "file"):
        path = copied(spark, path, most)
    return READERS[kind](spark, path)


def write(df: DataFrame, uri: str, kind: str = "parquet", mode: str = "errorifexists") -> str:
    """Write df and return its address. CSV gets a header and NULL for nulls, so that csv() reads it back."""
    path = resolve(uri)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.csv(path, header=True, nullValue="NULL")
    elif kind in ("parquet", "json", "orc"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown kind of sink {kind!r}")
    return path
