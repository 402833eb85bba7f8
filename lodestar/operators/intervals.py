"""Interval joins: points into the intervals that hold them, keyed first, ranged second.

``containing`` pairs every point with all its intervals.  ``innermost`` asks for one
interval a point only, and finds it by a sweep: points and bounds of all keys are sorted
together and cut into chunks, a task walks its chunk with the open intervals on a heap,
and of the intervals that span a whole chunk only the shortest is sent there.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.staging import hot_keys, salted_join, staged


def containing(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, width: int | None = None, how: str = "inner") -> DataFrame:
    """Points joined to every interval of their key with start <= at <= end.

    width: intervals are also dealt into buckets of so many units, so the join stays
    an equi-join however many intervals a key has.  Choose it near the usual length
    of an interval; longer ones are entered into several buckets.
    """
    in_range = (F.col(f"p.{at}") >= F.col(f"i.{start}")) & (F.col(f"p.{at}") <= F.col(f"i.{end}"))
    same = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in key]
    right = intervals
    left = points
    if width:
        right = right.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
        left = left.withColumn("__cell", F.floor(F.col(at) / width))
        same.append(F.col("p.__cell") == F.col("i.__cell"))
    on = in_range
    for s in same:
        on = on & s
    joined = left.alias("p").join(right.alias("i"), on, how)
    kept = [F.col(f"i.{c}") for c in intervals.columns if c not in key]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *kept)


def innermost(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, point_id: list[str] | None = None, chunk_rows: int = 200_000) -> DataFrame:
    """Each point with the shortest interval of its key that holds it (then the later start, then the other columns in their order); points without one keep nulls.

    The work is a sort of points and bounds, whatever share of them one key holds and
    however the intervals overlap.  Points and intervals are rows, repeated ones are
    answered one by one (``point_id`` is not needed any more); rows with a null key,
    place or bound, and intervals that end before they start, meet nothing.
    """
    held = staged(points.withColumn("__p", F.monotonically_increasing_id()), "sweep-points")
    # The numbers follow the other columns, so they decide between equal intervals as these do.
    tie = [F.col(f.name).asc_nulls_last() for f in intervals.schema if f.name not in (*key, start, end) and not isinstance(f.dataType, T.MapType)]
    spans = intervals.where(F.col(start) <= F.col(end))
    spans = staged((spans.orderBy(*tie) if tie else spans).withColumn("__i", F.monotonically_increasing_id()), "sweep-intervals")
    k = F.struct(*[F.col(c) for c in key]).alias("k")
    there = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in key])
    none = F.lit(None).cast("double")
    size, begun = F.col(end).cast("double") - F.col(start).cast("double"), F.col(start).cast("double")
    bound = lambda at, kind: F.struct(F.col(at).cast("double").alias("place"), F.lit(kind).alias("kind"))
    events = held.where(there & F.col(at).isNotNull()).select(k, bound(at, 1).alias("e"), F.col("__p").alias("id"), none.alias("size"), none.alias("begun"))
    events = events.unionByName(spans.where(there).select(k, F.explode(F.array(bound(start, 0), bound(end, 2))).alias("e"), F.col("__i").alias("id"), size.alias("size"), begun.alias("begun")))
    # Starts before points before ends of one place: what is open at a point is what holds it.
    order = ["k", "place", "kind", "id"]
    events = events.select("k", "e.place", "e.kind", "id", "size", "begun")
    n = max(1, math.ceil(events.count() / chunk_rows))
    dealt = events.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.select(F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("seq"), "kind", "id", "size", "begun"), "sweep-events")
    best = F.min(F.struct("size", (-F.col("begun")).alias("late"), "id"))
    whole = dealt.where("kind <> 1").groupBy("id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"), F.first("size").alias("size"), F.first("begun").alias("begun")).where("b - a > 1")
    # Chunks a+1 to b-1 as at most two dyadic runs a level, so a long interval is no row per chunk.
    levels = max(1, n.bit_length())
    left, right = F.col("a") + 1, F.col("b")
    runs = []
    for level in range(levels):
        lo, hi = F.ceil(left / (1 << level)), F.floor(right / (1 << level))
        run = lambda x, level=level: F.struct(F.lit(level).alias("level"), x.cast("int").alias("node"))
        runs += [F.when((lo < hi) & (lo % 2 == 1), run(lo)), F.when((lo + lo % 2 < hi) & (hi % 2 == 1), run(hi - 1))]
    covers = whole.select("size", "begun", "id", F.explode(F.array_compact(F.array(*runs))).alias("r")).groupBy("r.level", "r.node").agg(best.alias("cover"))
    chunks = dealt.sparkSession.range(n).select(F.col("id").cast("int").alias("chunk"))
    above = chunks.select("chunk", F.posexplode(F.array(*[F.shiftright("chunk", level) for level in range(levels)])).alias("level", "node"))
    over = above.join(covers, ["level", "node"]).groupBy("chunk").agg(F.min("cover").alias("cover"))
    rows = dealt.join(F.broadcast(over), "chunk", "left")  # one row per chunk
    found = rows.select("chunk", "seq", "kind", "id", "size", "begun", "cover.*").toDF("chunk", "seq", "kind", "id", "size", "begun", "cover_size", "cover_late", "cover_id")
    hits = found.groupBy("chunk").applyInPandas(_sweep, "__p long, __i long")
    named = spans.select("__i", *[F.col(c) for c in intervals.columns if c not in key])
    # One interval may hold most points: its row is repeated for them.
    per = hits.groupBy("__i").agg(F.count("*").alias("m"))
    met = salted_join(hits, named, ["__i"], hot_keys(per, ["__i"]), F.col("__p")).drop("__i")
    return held.join(met, "__p", "left").drop("__p")


def _sweep(chunk: pd.DataFrame) -> pd.DataFrame:
    """Every point of a chunk with the best open interval: (size, -start, id), the least."""
    rows = chunk.sort_values("seq")
    kinds, ids, sizes, begun = (rows[c].to_numpy() for c in ("kind", "id", "size", "begun"))
    starts = set(ids[kinds == 0].tolist())
    heap = [(float(s), -float(b), int(i)) for k, i, s, b in zip(kinds, ids, sizes, begun, strict=True) if k == 2 and int(i) not in starts]
    cover = rows.iloc[0]
    if not pd.isna(cover["cover_id"]):
        heap.append((float(cover["cover_size"]), float(cover["cover_late"]), int(cover["cover_id"])))
    heapq.heapify(heap)
    closed: set[int] = set()
    points, found = [], []
    for k, i, s, b in zip(kinds.tolist(), ids.tolist(), sizes.tolist(), begun.tolist(), strict=True):
        if k == 0:
            heapq.heappush(heap, (s, -b, i))
        elif k == 2:
            closed.add(i)
        else:
            while heap and heap[0][2] in closed:
                heapq.heappop(heap)
            if heap:
                points.append(i)
                found.append(heap[0][2])
    return pd.DataFrame({"__p": points, "__i": found}, dtype="int64")


def cells_in_areas(cells: DataFrame, areas: DataFrame, key: str = "doc", height: int = 256) -> DataFrame:
    """Cells (row, col) with each named area (r1, c1, r2, c2; null: unbounded) of their document that holds them.

    Joined on the document and runs of ``height`` rows; an area without a bound below
    reaches to its document's last row.
    """
    last = cells.groupBy(key).agg(F.max("row").alias("__last"))
    held = areas.join(last, key)
    strip = F.explode(F.sequence(F.floor(F.coalesce("r1", F.lit(0)) / height), F.floor(F.greatest(F.coalesce(F.least("r2", "__last"), F.col("__last")), F.coalesce("r1", F.lit(0))) / height)))
    a = held.withColumn("__strip", strip).alias("a")
    c = cells.withColumn("__strip", F.floor(F.col("row") / height)).alias("c")
    inside = (
        (F.col(f"c.{key}") == F.col(f"a.{key}"))
        & (F.col("c.__strip") == F.col("a.__strip"))
        & (F.col("c.row") >= F.coalesce("a.r1", F.lit(0)))
        & (F.col("c.row") <= F.coalesce("a.r2", F.lit(2**31 - 1)))
        & (F.col("c.col") >= F.coalesce("a.c1", F.lit(0)))
        & (F.col("c.col") <= F.coalesce("a.c2", F.lit(2**31 - 1)))
    )
    return c.join(a, inside).select("c.*", F.col("a.name").alias("area")).drop("__strip")


def best_overlap(left: DataFrame, right: DataFrame, key: str, left_types: str, right_types: str, seq: str) -> DataFrame:
    """For each left row, the right row of the same key whose types overlap most; ties go to the smaller ``seq``, no overlap to none.

    Rows meet on the types they share, so pairs without one are never made.
    """
    own = [c for c in left.columns if c != left_types]
    l = left.select(*left.columns, F.explode(F.array_distinct(left_types)).alias("__type")).alias("l")  # noqa: E741
    r = right.select(key, F.col(seq).alias("__seq"), F.explode(F.array_distinct(right_types)).alias("__type")).alias("r")
    same = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.__type") == F.col("r.__type"))
    scored = l.join(r, same).groupBy(*[F.col(f"l.{c}") for c in left.columns], F.col("r.__seq")).agg(F.count("*").cast("int").alias("score"))
    best = scored.groupBy(*left.columns).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("__seq"))).alias("b")).select(*left.columns, (-F.col("b.s")).alias("score"), F.col("b.__seq").alias("__seq"))
    names = {c: f"right_{c}" for c in right.columns if c != key}
    others = right.select(F.col(key).alias("__key"), *[F.col(c).alias(n) for c, n in names.items()])
    on = (best[key] == others["__key"]) & (best["__seq"] == others[f"right_{seq}"])
    return best.join(others, on).select(*[c for c in own], left_types, *names.values(), "score")


def first_match(wanted: DataFrame, offers: DataFrame, rules: list[tuple[int, list[tuple[str, str]]]], key: list[str], seq: str) -> DataFrame:
    """Each wanted row with the offer that matches by the first rule that any offer meets.

    rules: (priority, pairs of wanted and offered columns to be equal).  One equi-join
    per rule, then the best priority and smallest ``seq``.
    """
    found = None
    for priority, pairs in rules:
        on = None
        for a, b in pairs:
            same = F.col(f"w.{a}") == F.col(f"o.{b}")
            on = same if on is None else on & same
        hit = wanted.alias("w").join(offers.alias("o"), on).select("w.*", *[F.col(f"o.{c}").alias(f"offer_{c}") for c in offers.columns], F.lit(priority).alias("priority"))
        found = hit if found is None else found.unionByName(hit)
    best = Window.partitionBy(*key).orderBy("priority", f"offer_{seq}")
    return found.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")
