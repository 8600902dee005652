"""SQL over one source: request and response, error codes, size limits, a result cache and a health report."""

from __future__ import annotations

import os
import threading
import time
import uuid
from dataclasses import dataclass, field
from enum import Enum

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from . import sources
from .config import Config

VERSION = "0.1.0"


class Code(Enum):
    SUCCESS = 0
    PARSE_ERROR = 1
    EXECUTION_ERROR = 2
    SOURCE_ERROR = 3
    UPLOAD_ERROR = 4
    OUT_OF_MEMORY = 5
    UNKNOWN_ERROR = 6


@dataclass
class Source:
    uri: str
    mime: str | None = None


@dataclass
class QueryRequest:
    """sql over the view data; a request with plan bytes only is a PARSE_ERROR, as there is no decoder for them."""

    sql: str
    source: Source
    client_id: str = ""
    plan: bytes = b""
    sink: str | None = None


@dataclass
class QueryResponse:
    code: Code
    link: str = ""
    error: str = ""
    rows: int | None = None
    elapsed_ms: float = 0.0


class BadRequest(ValueError):
    """status: what an HTTP front would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def health() -> dict:
    return {"status": "healthy", "version": VERSION}


def bind(spark: SparkSession, df: DataFrame, sql: str) -> DataFrame:
    """sql with df as the table data, in a session of its own view names."""
    view = f"data_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        return spark.sql(f"WITH data AS (SELECT * FROM {view}) SELECT * FROM ({sql.strip().rstrip(';')})")
    finally:
        spark.catalog.dropTempView(view)


def run_query(spark: SparkSession, sql: str | None, file: str | None = None, uri: str | None = None, mime: str | None = None, config: Config | None = None) -> dict:
    """Status, query, result (a DataFrame over the view data) and time. 422 without SQL, 400 unless exactly one of file and uri is given, 413 for a large request or local file."""
    began = time.perf_counter()
    if not (sql or "").strip():
        raise BadRequest(422, "sql_query is required")
    uri = (uri or "").strip() or None
    if (file is None) == (uri is None):
        raise BadRequest(400, "give exactly one of file and file_uri")
    if file is not None and config is not None and os.path.isfile(file) and os.path.getsize(file) > config.batch.max_file_size_mb * 1e6:
        raise BadRequest(413, "the file is too large")
    if config is not None and len(sql.encode()) > config.server.max_request_size_mb * 1e6:
        raise BadRequest(413, "the request is too large")
    df = bind(spark, sources.open_source(spark, file or uri, mime, config), sql)
    return {"status": "success", "query": sql, "result": df, "execution_time_ms": (time.perf_counter() - began) * 1000}


def _fault(phase: Code, e: Exception) -> Code:
    if "OutOfMemory" in str(e):
        return Code.OUT_OF_MEMORY
    if isinstance(e, (PySparkException, Py4JJavaError, ValueError, OSError)):
        return phase
    return Code.UNKNOWN_ERROR


@dataclass
class Service:
    """Runs requests: at most max_concurrent_queries at once, each within max_request_size_mb and timeout; results of equal requests kept for cache_ttl_seconds."""

    spark: SparkSession
    config: Config = field(default_factory=Config)

    def __post_init__(self):
        self.slots = threading.BoundedSemaphore(max(1, self.config.query.max_concurrent_queries))
        self.kept: dict[tuple, tuple[float, QueryResponse]] = {}

    def execute(self, request: QueryRequest) -> QueryResponse:
        key = (request.sql, request.source.uri, request.source.mime, request.sink)
        at = time.monotonic()
        if self.config.query.enable_cache and key in self.kept and at - self.kept[key][0] < self.config.query.cache_ttl_seconds:
            return self.kept[key][1]
        with self.slots:
            found = self._timed(request)
        found.elapsed_ms = (time.monotonic() - at) * 1000
        if found.code is Code.SUCCESS and self.config.query.enable_cache:
            self.kept = {k: v for k, v in self.kept.items() if at - v[0] < self.config.query.cache_ttl_seconds} | {key: (at, found)}
        return found

    def _timed(self, request: QueryRequest) -> QueryResponse:
        """The request's jobs are cancelled after the settings' timeout, in seconds."""
        context, group, late = self.spark.sparkContext, f"request-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context._jsc.sc().cancelJobGroupAndFutureJobs(group)

        timer = threading.Timer(self.config.server.timeout, stop)
        timer.start()
        context.setJobGroup(group, request.sql[:200], True)
        try:
            found = self._execute(request)
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if late.is_set() and found.code not in (Code.SUCCESS, Code.PARSE_ERROR):
            return QueryResponse(Code.EXECUTION_ERROR, error=f"the query took more than {self.config.server.timeout} s")
        return found

    def _execute(self, request: QueryRequest) -> QueryResponse:
        if len(request.sql.encode()) + len(request.plan) > self.config.server.max_request_size_mb * 1e6:
            return QueryResponse(Code.PARSE_ERROR, error="the request is too large")
        if not request.sql.strip():
            return QueryResponse(Code.PARSE_ERROR, error="only SQL text is accepted")
        phase = Code.SOURCE_ERROR
        try:
            df = sources.open_source(self.spark, request.source.uri, request.source.mime, self.config)
            phase = Code.PARSE_ERROR
            df = bind(self.spark, df, request.sql)
            phase = Code.UPLOAD_ERROR if request.sink else Code.EXECUTION_ERROR
            if request.sink:
                return QueryResponse(Code.SUCCESS, link=sources.write(df, request.sink))
            return QueryResponse(Code.SUCCESS, rows=df.count())
        except (ParseException, AnalysisException) as e:
            return QueryResponse(_fault(phase, e), error=str(e).splitlines()[0])
        except Exception as e:
            if phase is Code.UPLOAD_ERROR and any(x in str(e) for x in ("ArithmeticException", "DIVIDE_BY_ZERO", "CAST_INVALID_INPUT", "ARITHMETIC_OVERFLOW")):
                phase = Code.EXECUTION_ERROR
            return QueryResponse(_fault(phase, e), error=str(e).splitlines()[0] if str(e) else type(e).__name__)
