"""Streams: change events, windows with late data, state, and their sinks.

Every function takes a DataFrame that may be a stream or a batch; the batch result
is what tests compare a drained stream with.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.functions.code import FOLDERS
from lodestar.operators import store
from lodestar.staging import adopted, shared_dir

def listing(spark: SparkSession, path: str, glob: str = "*.{xml,bsl,mdo}") -> DataFrame:
    """path, modificationTime and length of every file, without reading any."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "modificationTime", "length")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """path and change_type (created, modified, deleted) between two listings: a file source only ever sees new paths."""
    a, b = now.alias("a"), before.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    same = F.col("a.modificationTime").eqNullSafe(F.col("b.modificationTime")) & F.col("a.length").eqNullSafe(F.col("b.length"))
    kind = F.when(F.col("b.path").isNull(), "created").when(F.col("a.path").isNull(), "deleted").when(~same, "modified")
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), kind.alias("change_type")).where("change_type is not null")


def kept(changes: DataFrame, ignore: list[str], path: str = "path") -> DataFrame:
    """Changes whose path fits none of the globs (``**`` any folders, ``*`` and ``?`` within one name)."""
    for glob in ignore:
        parts = re.split(r"(\*\*/?|\*|\?)", glob)
        fit = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in parts if p)
        changes = changes.where(~F.col(path).rlike(f"^(?:.*/)?{fit}$"))
    return changes


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream has to give now, as a table: the last result in complete mode, all results in append mode."""
    spark = stream.sparkSession
    folder, count = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}", [0]

    def put(batch: DataFrame, _: int) -> None:
        batch.write.parquet(f"{folder}/rows/{count[0]}")
        count[0] += 1

    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    if not count[0]:
        return spark.createDataFrame([], stream.schema)
    last = f"{folder}/rows/{count[0] - 1}" if mode == "complete" else f"{folder}/rows/*"
    return adopted(spark.read.schema(stream.schema).parquet(last), folder)


def next_batch(stream: DataFrame, home: str) -> DataFrame:
    """The rows of one more batch of a stream whose log lies under ``home``, as a table there."""
    told: list[str] = []

    def put(batch: DataFrame, k: int) -> None:
        told.append(f"{home}/rows/{k}")
        batch.write.mode("overwrite").parquet(told[-1])

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{home}/log").trigger(once=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(told[-1]) if told else spark.createDataFrame([], stream.schema)


def file_stream(spark: SparkSession, path: str, glob: str = "*.{xml,bsl}") -> DataFrame:
    """New files under ``path``: path, modificationTime, length, content.  A file source never reads a path twice; ``tree_source`` sees changed and deleted files too."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def located(changes: DataFrame, path: str = "path") -> DataFrame:
    """metadata_type and object_name of the changed path, null outside the known folders."""
    part = rf"/({'|'.join(FOLDERS)})/([^/.]+)"
    kind = F.create_map(*[x for k, v in FOLDERS.items() for x in (F.lit(k), F.lit(v))])
    folder = F.nullif(F.regexp_extract(path, part, 1), F.lit(""))
    return changes.withColumn("metadata_type", kind[folder]).withColumn("object_name", F.nullif(F.regexp_extract(path, part, 2), F.lit("")))


def tumbling(events: DataFrame, every: str, keys: list[str], late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum per fixed window; events later than ``late`` are dropped by a stream."""
    return _windowed(events, F.window("__ts", every), keys, late, ts, value)


def sliding(events: DataFrame, length: str, step: str, keys: list[str], late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    return _windowed(events, F.window("__ts", length, step), keys, late, ts, value)


def sessions(events: DataFrame, gap: str, keys: list[str], late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum per run of events with pauses of less than ``gap``."""
    return _windowed(events, F.session_window("__ts", gap), keys, late, ts, value)


def _windowed(events, window, keys, late, ts, value):
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n", "total")


def debounced(changes: DataFrame, gap: str = "1 second", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The last change of each path in every burst of changes."""
    timed = changes.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    bursts = timed.groupBy(F.session_window("__ts", gap).alias("w"), "path").agg(F.max_by("change_type", "__ts").alias("change_type"), F.max("__ts").alias("last"), F.count("*").alias("n"))
    return bursts.select("path", "change_type", F.col("last").cast("timestamp_ntz").alias("last"), "n")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events without repeats that arrive within ``late``."""
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark(keys).drop("__ts")


def allowed(calls: DataFrame, most: int, period_seconds: float, key: str = "key", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """key, ts and allowed of each call: at most ``most`` accepted calls in any trailing period; refused ones do not count.

    The state of a key is its accepted times within the period, at most ``most`` of
    them; it is given up once the watermark has passed them by a period.
    """

    def limit(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        flags = []
        for at in rows["at"]:
            kept = [x for x in kept if x > at - period_seconds]
            flags.append(len(kept) < most)
            if flags[-1]:
                kept.append(at)
        state.update((kept,))
        state.setTimeoutTimestamp(int((max(kept) + period_seconds) * 1000) + 1)
        yield pd.DataFrame({"key": k[0], "ts": rows["at"], "allowed": flags})

    timed = calls.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("time")).withWatermark("time", late)
    timed = timed.select("key", "time", F.col("time").cast("double").alias("at"))
    return timed.groupBy("key").applyInPandasWithState(limit, "key string, ts double, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_in_window(calls: DataFrame, period_seconds: int, key: str, ts: str = "ts") -> DataFrame:
    """How many calls of the key fall into the period that ends with each call (batch form)."""
    from pyspark.sql.window import Window

    at = F.unix_micros(F.col(ts).cast("timestamp"))
    trailing = Window.partitionBy(key).orderBy(at).rangeBetween(-(period_seconds * 1_000_000) + 1, 0)
    return calls.withColumn("recent", F.count("*").over(trailing))


def upsert_batches(path: str, key: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every micro-batch is merged into the buckets of its keys; ``store.bucketed`` reads the table.

    A batch that is delivered again changes nothing: the merge keeps one row per key.
    """

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert_buckets(batch, path, key, order, buckets)

    return merge


def append_audit(events: DataFrame, path: str, checkpoint: str):
    """An append-only audit sink: a started query that writes Parquet by day."""
    dated = events.withColumn("day", F.to_date("ts"))
    return dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")
