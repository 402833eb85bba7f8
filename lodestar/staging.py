"""Tables between steps, and joins on keys that a few values dominate."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows, so there are fewer hot keys than that; a salt is worth this many rows at least.
HOT_SHARES, SALT_ROWS = 1024, 64
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables between steps: their session, path, and a weak reference to what their readers' plans hold.
_STAGED: list[tuple[SparkSession, str, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only a local session, whose driver is its executor, may go without
    ``spark.checkpoint.dir``: it gets a temporary folder.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = f"file://{tempfile.gettempdir()}/lodestar-shared"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Spark deletes the shuffles of the jobs run inside as soon as they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors.

    The table lives as long as a DataFrame reads it: once the driver's JVM has let go
    of the last plan over it, the next ``staged`` or ``release`` deletes it, and the
    end of the JVM deletes what is left.
    """
    spark = df.sparkSession
    _sweep(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return adopted(spark.read.schema(df.schema).parquet(path), path)


def adopted(out: DataFrame, path: str) -> DataFrame:
    """``out``, which reads the folder ``path``: the folder now lives as long as its readers."""
    spark = out.sparkSession
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    held = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _STAGED.append((spark, path, spark.sparkContext._jvm.java.lang.ref.WeakReference(held)))
    return out


def drop(df: DataFrame) -> None:
    """Delete one staged table that nothing reads any more, without waiting for the JVM."""
    path = df.inputFiles()[:1]
    for entry in list(_STAGED):
        if entry[0] is df.sparkSession and path and f"/{entry[1].rsplit('/', 1)[-1]}/" in path[0]:
            _delete(entry)


def release(spark: SparkSession) -> None:
    """Delete every staged table of this session that no DataFrame reads any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _sweep(spark)


def _sweep(spark: SparkSession) -> None:
    for entry in list(_STAGED):
        if entry[0] is spark and entry[2].refersTo(None):
            _delete(entry)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(entry: tuple[SparkSession, str, object]) -> None:
    fs, p = _file_system(*entry[:2])
    fs.cancelDeleteOnExit(p)
    fs.delete(p, True)
    _STAGED.remove(entry)


def hot_keys(counts: DataFrame, keys: list[str], m: str = "m") -> DataFrame:
    """keys and salts (over how many parts to deal their rows) of the hot keys among ``counts`` (keys, m).

    Fewer than ``HOT_SHARES`` keys can each hold more than that share of all rows,
    so this table can be broadcast whatever the input; all salts together are at
    most five times as many, and repeat a key's partner for every ``SALT_ROWS`` of
    its rows at most.
    """
    total = int(counts.agg(F.sum(m).alias("t")).first()["t"] or 0)
    salts = F.least(F.ceil(F.col(m) / SALT_ROWS), F.ceil(F.col(m) * (4 * HOT_SHARES) / F.lit(max(total, 1)))).cast("int")
    return counts.where((F.col(m) * HOT_SHARES > total) & (F.col(m) > SALT_ROWS)).select(*keys, salts.alias("salts"))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, draw: Column, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` on keys; rows of a hot key are dealt over its salts by ``draw``, its partner is repeated there."""
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(draw, F.col("salts").cast("long")), F.lit(0)).cast("int")
    left = many.join(hot, keys, "left").withColumn("__salt", salt).drop("salts")
    right = one.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
