"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings; all may be set on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``_`` for ``.``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**RUNTIME, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def settle(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
