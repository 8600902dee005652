"""Sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC and ANSI fix results; AQE re-plans shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_spark(master: str | None = None, conf: dict[str, str] | None = None, app: str = "sparkloom") -> SparkSession:
    """The active session, or a new one; conf overrides SETTINGS."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def set_log_mode(spark: SparkSession, mode: str) -> str:
    """prod, info or debug; anything else counts as info. Returns the level set."""
    level = {"prod": "WARN", "info": "INFO", "debug": "DEBUG"}.get(mode, "INFO")
    spark.sparkContext.setLogLevel(level)
    return level


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only where Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or "/tmp/checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
