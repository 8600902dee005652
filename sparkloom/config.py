"""Settings in four sections, with defaults, read from YAML."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Server:
    port: int = 8080
    host: str = "localhost"
    timeout: int = 30
    max_request_size_mb: float = 15.0


@dataclass
class Batch:
    size: int = 8192
    enable_parallel_read: bool = True
    max_memory_before_spill: int = 2 << 30
    max_file_size_mb: int = 500
    should_download: bool = False
    max_download_size_mb: float = 10.0


@dataclass
class Query:
    enable_cache: bool = True
    cache_ttl_seconds: int = 600
    max_concurrent_queries: int = 2


@dataclass
class Metrics:
    enable_metrics: bool = True
    metrics_port: int = 9999
    metrics_host: str = "localhost"
    export_interval_secs: int = 60


@dataclass
class Config:
    server: Server = field(default_factory=Server)
    batch: Batch = field(default_factory=Batch)
    query: Query = field(default_factory=Query)
    metrics: Metrics = field(default_factory=Metrics)

    def spark_conf(self) -> dict[str, str]:
        """What of this is a Spark setting."""
        return {"spark.sql.parquet.columnarReaderBatchSize": str(self.batch.size), "spark.sql.execution.arrow.maxRecordsPerBatch": str(self.batch.size)}


def merge(config: Config, given: dict) -> Config:
    """config with the given fields set, zero values too; unknown or wrongly typed ones are left out with a warning."""
    for section, values in (given or {}).items():
        target = getattr(config, section, None)
        if target is None or not isinstance(values, dict):
            warnings.warn(f"unknown section {section!r}", stacklevel=2)
            continue
        kinds = {f.name: type(getattr(target, f.name)) for f in fields(target)}
        for key, value in values.items():
            kind = kinds.get(key)
            fits = kind is not None and (isinstance(value, kind) and (kind is bool) == isinstance(value, bool) or kind is float and isinstance(value, int) and not isinstance(value, bool))
            if fits:
                setattr(target, key, value)
            else:
                warnings.warn(f"setting {section}.{key} is unknown or of another type", stacklevel=2)
    return config


def parse(text: str) -> dict:
    """YAML by PyYAML where it is installed, else its subset of sections and scalars that the settings need."""
    try:
        import yaml
    except ImportError:
        return _plain(text)
    return yaml.safe_load(text) or {}


def _plain(text: str) -> dict:
    out: dict = {}
    section = None
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number} is no setting")
        if line[0] not in " \t":
            section = out.setdefault(key, {})
            if value.strip():
                out[key] = _scalar(value)
        elif isinstance(section, dict):
            section[key] = _scalar(value)
        else:
            raise ValueError(f"line {number} belongs to no section")
    return out


def _scalar(value: str):
    value = value.strip()
    if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    if value in ("true", "false"):
        return value == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value or None


def load(path: str) -> Config:
    """Defaults with the file's settings; ValueError unless it is a .yaml or .yml file with such content."""
    if not path.endswith((".yaml", ".yml")):
        raise ValueError("settings are in a .yaml or .yml file")
    given = parse(Path(path).read_text())
    if not isinstance(given, dict):
        raise ValueError("settings are sections")
    return merge(Config(), given)
