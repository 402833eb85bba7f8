"""Sessions and tables: what every other module takes for granted."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Rows to a task where each row stands for a text.
ROWS_EACH = 4000
TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this engine assumes: UTC and adaptive execution.

    Partition counts and memory stay the cluster's business; give them in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def dealt(rows: DataFrame, key: str, each: int = ROWS_EACH) -> DataFrame:
    """``rows`` over a task for about every ``each`` of them, by their ``key``.

    For small rows that stand for much work, such as keys of which texts are made: a
    reader cuts a file by its bytes, so a million keys may be one task.
    """
    return rows.repartition(max(1, math.ceil(rows.count() / each)), key)


def register(spark: SparkSession, root: str, names: tuple[str, ...] = TABLES) -> None:
    """The tables under ``root`` as temporary views."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)
