"""The metadata store: keyed tables with lookup, search, upsert, diff and incremental loads.

A store table is any DataFrame with a key; the usual one is (metadata_type, name).
Everything here is a plan over it; writes are commits (``operators/tables.py``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.operators.tables import Change, Tables


def full_name(kind: str | Column = "metadata_type", name: str | Column = "name") -> Column:
    return F.concat_ws(".", kind, name)


# --- lookups -----------------------------------------------------------------


def point(objects: DataFrame, kind: str, name: str) -> DataFrame:
    """The object of this type and name; pruned to one partition where the table is partitioned by type."""
    return objects.where((F.col("metadata_type") == kind) & (F.col("name") == name))


def of_type(objects: DataFrame, kind: str) -> DataFrame:
    return objects.where(F.col("metadata_type") == kind).orderBy("name")


def names(objects: DataFrame, kind: str | None = None) -> DataFrame:
    chosen = objects if kind is None else objects.where(F.col("metadata_type") == kind)
    return chosen.select("metadata_type", "name").orderBy("metadata_type", "name")


def stored_hash(objects: DataFrame, kind: str, name: str) -> DataFrame:
    return point(objects, kind, name).select("file_hash")


def counts_by(objects: DataFrame, column: str = "metadata_type") -> DataFrame:
    return objects.groupBy(column).agg(F.count("*").alias("n"))


# --- search ------------------------------------------------------------------


def ascii_lower(column: Column) -> Column:
    """Folds A-Z only, as the store's LIKE does."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _folded(token: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in token)


def like_ci(column: Column, pattern: str) -> Column:
    """LIKE with ``%`` and ``_`` as wildcards, case-insensitive for A-Z."""
    return ascii_lower(column).like(_folded(pattern))


def token_search(
    objects: DataFrame, query: str, columns: tuple[str, ...] = ("name", "synonym"), limit: int | None = 50, match_all: bool | None = None
) -> DataFrame:
    """Rows in which every token of ``query`` occurs in one of the columns; if there are none, those with any.

    match_all True or False asks for one of the two only.  Names that start with
    the first token come first, then by name.  An empty query finds nothing.
    Both passes are one scan: the fallback is decided by a global maximum.
    """
    tokens = query.split()
    if not tokens:
        return objects.limit(0)
    hits = [reduce(lambda a, b: a | b, [F.coalesce(like_ci(F.col(c), f"%{t}%"), F.lit(False)) for c in columns]) for t in tokens]
    every, some = reduce(lambda a, b: a & b, hits), reduce(lambda a, b: a | b, hits)
    if match_all is not None:
        found = objects.where(every if match_all else some)
    else:
        candidates = objects.where(some).withColumn("__all", every)
        any_all = candidates.agg(F.coalesce(F.max("__all"), F.lit(False)).alias("__any"))
        found = candidates.crossJoin(F.broadcast(any_all)).where(F.col("__all") | ~F.col("__any")).drop("__all", "__any")  # one row
    rank = F.when(like_ci(F.col(columns[0]), f"{tokens[0]}%"), 0).otherwise(1)
    found = found.withColumn("rank", rank).orderBy("rank", columns[0])
    return found if limit is None else found.limit(limit)


# --- upserts and merges ------------------------------------------------------


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; a row of ``changes`` beats an equal one of ``current``."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, [F.col(order).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def merge_roots(roots: DataFrame, key: list[str], priority: str = "priority") -> DataFrame:
    """Overlay trees over the main one: the highest priority wins a key, its ``source`` is kept."""
    return latest(roots, key, [F.col(priority).desc(), F.col("source").asc()])


def changed(scanned: DataFrame, stored: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """Scanned rows that are new or whose MD5 differs from the stored one."""
    hashed = scanned.withColumn("file_hash", F.md5(F.col(content).cast("binary")))
    return hashed.join(stored.select(*key, "file_hash"), [*key, "file_hash"], "left_anti")


def deleted(scanned: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Stored keys that a full scan no longer has."""
    return stored.join(scanned.select(*key), key, "left_anti").select(*key)


def delete_by_prefix(rows: DataFrame, prefix: str, column: str = "id", like: bool = False) -> DataFrame:
    """Without the rows whose id starts with ``prefix``; like: ``%`` and ``_`` in it are wildcards and case is ignored."""
    hit = like_ci(F.col(column), f"{prefix}%") if like else F.col(column).startswith(prefix)
    return rows.where(~F.coalesce(hit, F.lit(False)))


def _split(path: str) -> tuple[str, str]:
    home, name = path.rstrip("/").rsplit("/", 1)
    return home, name


def publish(df: DataFrame, path: str) -> None:
    """A new version of the table at ``path``; readers of the old one can finish."""
    home, name = _split(path)
    Tables(df.sparkSession, home).transact(lambda change: change.write(name, df))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The published version of the table at ``path``; None if there is none."""
    home, name = _split(path)
    return Tables(spark, home).read(name)


def upsert_buckets(changes: DataFrame, path: str, key: list[str], order: str, buckets: int = 64, writer: str | None = None, batch: int | None = None) -> None:
    """Merge ``changes`` into the table at ``path``, which lies in buckets of its keys: only the buckets of changed keys are read and rewritten, at one moment.

    The number of buckets is that of the table's first write.  A batch of a ``writer``
    is taken in once.
    """
    home, name = _split(path)

    def merge(change: Change) -> None:
        n = change.note(name).get("buckets", buckets)
        bucket = F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
        touched = [str(r["b"]) for r in changes.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        old = change.read(name, touched)
        new = latest(changes, key, [F.col(order).desc_nulls_last()]) if old is None else upsert(old, changes, key, order)
        change.write_parts(name, new, bucket, note={"buckets": n})

    Tables(changes.sparkSession, home).transact(merge, writer, batch)


def bucketed(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path)


def clear(spark: SparkSession, path: str, schema: T.StructType) -> None:
    publish(spark.createDataFrame([], schema), path)


# --- comparison --------------------------------------------------------------


def diff(left: DataFrame, right: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """key and status of every row on either side: added, removed, modified or unchanged."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in compared]))
    a, b = left.select(*key, digest.alias("__a")), right.select(*key, digest.alias("__b"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def diff_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("n"))


# --- naming conventions of a configuration -----------------------------------


def ascii_share(objects: DataFrame, column: str = "name", least: float = 0.70) -> DataFrame:
    """Share of names of Latin letters, digits and underscores, and the language that it stands for."""
    share = F.coalesce(F.avg(F.col(column).rlike("^[A-Za-z0-9_]+$").cast("int")), F.lit(0.0))
    return objects.agg(share.alias("share")).withColumn("language", F.when(F.col("share") >= least, "en").otherwise("ru"))


def common_prefixes(objects: DataFrame, prefixes: list[str], least: int = 5, column: str = "name") -> DataFrame:
    """How many names start with each prefix (the first that fits), for prefixes with at least ``least``."""
    first = F.coalesce(*[F.when(F.col(column).startswith(p), F.lit(p)) for p in prefixes])
    return objects.select(first.alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def any_named(objects: DataFrame, wanted: list[str], column: str = "name") -> DataFrame:
    return objects.agg(F.coalesce(F.bool_or(F.col(column).isin(*wanted)), F.lit(False)).alias("found"))


def should_skip(column: Column, obsolete: tuple[str, ...] = ("Удалить",)) -> Column:
    return reduce(lambda a, b: a | b, [column.startswith(p) for p in obsolete])


def numeric_attributes(attributes: Column, obsolete: tuple[str, ...] = ("Удалить",)) -> Column:
    """Of an array of (name, type) structs, those of a numeric type that are not obsolete."""
    return F.filter(attributes, lambda a: a["type"].isin("Number", "Число") & ~should_skip(a["name"], obsolete))


# --- usage statistics --------------------------------------------------------

# The bounds of the latency histogram.
LATENCY_BUCKETS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000)


def tool_metrics(audit: DataFrame) -> DataFrame:
    """Calls, errors, mean and total latency per tool of audit rows (tool, status, latency_ms)."""
    return audit.groupBy("tool").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.round(F.avg("latency_ms"), 6).alias("avg_ms"),
        F.round(F.sum("latency_ms"), 6).alias("total_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
    )


def latency_histogram(audit: DataFrame, by: str = "tool", value: str = "latency_ms", bounds: tuple[float, ...] = LATENCY_BUCKETS_MS) -> DataFrame:
    """Cumulative counts per bound, in long form; the last bound is infinite (null)."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"b{len(bounds)}")]
    wide = audit.groupBy(by).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(float(b) if b is not None else None).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, None])])
    return wide.select(by, F.inline(pairs))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))


def exposition(audit: DataFrame) -> DataFrame:
    """Counters per tool as lines of a text exposition: calls, errors and total milliseconds."""
    counted = tool_metrics(audit)
    lines = [F.concat(F.lit(f"{name}{{tool=\""), "tool", F.lit("\"} "), F.col(c).cast("string")) for name, c in (("tool_calls_total", "calls"), ("tool_errors_total", "errors"))]
    return counted.select(F.explode(F.array(*lines)).alias("line"))


def timings(spans: DataFrame, name: str = "name", value: str = "seconds") -> DataFrame:
    """A timing profile: how often each span ran, for how long in all, on average and at most, the slowest first."""
    return spans.groupBy(name).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most")).orderBy(F.desc("total"), name)


def serialized(rows: DataFrame) -> DataFrame:
    """Every row as one JSON object: nulls are kept, times are ISO."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return rows.select(F.to_json(F.struct(*rows.columns), options).alias("json"))


def cached(requests: DataFrame, puts: DataFrame, ttl_seconds: float, key: str = "key", ts: str = "ts") -> DataFrame:
    """``requests`` with hit: whether the last put of the key before the request is at most ``ttl_seconds`` old.  One pass per key, no pairs."""
    own = requests.columns
    both = requests.withColumn("__put", F.lit(None).cast(requests.schema[ts].dataType)).unionByName(puts.select(key, ts, F.col(ts).alias("__put")), allowMissingColumns=True)
    both = both.withColumn("__asks", F.col("__put").isNull())
    seen = Window.partitionBy(key).orderBy(ts, "__asks").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("__put", ignorenulls=True).over(seen)
    age = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1_000_000
    return both.withColumn("hit", F.coalesce(age <= ttl_seconds, F.lit(False))).where("__asks").select(*own, "hit")
