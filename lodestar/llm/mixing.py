"""Mixing sources to target weights by entropy balancing.

Every document i of a source has the rate exp(lambda c_i), at most ``most``, where
c_i is its token count over the mean of its source: of all rates that meet the
source's token target, sum(rate_i size_i) = target, these are the closest in relative
entropy to taking every document once.  lambda is the root of the dual's gradient,
found by Newton's method: every round sums gradient and Hessian over the documents of
every source in one distributed aggregate and keeps the root between bounds. A step is at
most a reach, which doubles each time it is too short, so a root at any distance is
bracketed in a few rounds; between bounds, a step that leaves them or stays at one end
is replaced by halving.  Documents of one source
and size have equal terms, so the rounds read a table of their counts, which loses
nothing.  Terms are summed as decimals, so the order of tasks changes no digit.

Rates become copies by sequential Poisson sampling: each document is taken
floor(rate) times, and once more in the order of u / (rate - floor(rate)), u being
drawn by its hash, until the source's remaining tokens are met.  Documents of over a
hundredth of a source's target are dealt first, the rest then fill what is left, so a
source misses its target by less than half of a small document.  What is taken is
thus decided by one cut per source and kind, found from prefix sums over buckets of
that order and then within the one bucket where the budget ends; both hold about the
square root of all rows.  Documents are then judged one by one; texts are never
shuffled.

Defined results: null and wordless texts have size 0 and are taken 0 times; a null
source is a source of its own; rows with equal doc_id, source and text are taken
alike; a source of only empty texts has target 0; without rows there is no result;
extra columns pass through where ``keep`` names them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import WORD_SPACE, staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
NEWTON_ROUNDS, FIRST_REACH, CLOSE = 200, 4.0, 1e-9
#: Bounds this close, relative to lambda, are one double apart or two.
NARROW = 1e-15
LARGE = 100
MAX_BROADCAST_SOURCES = 100_000
_EXACT = "decimal(38,9)"


def words_in(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), "")).cast("long")


def in_turn(by: DataFrame, tag: str) -> DataFrame:
    """Adds turn: each source's place by code point from 0, null last.  Sources are dealt by ranges, only the ranges are counted in one place."""
    order = F.asc_nulls_last("source")
    dealt = staged(by.repartitionByRange(order).withColumn("part", F.spark_partition_id()), f"{tag}-sources")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    turn = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.join(F.broadcast(parts), "part").withColumn("turn", turn).drop("part", "base")  # one row per shuffle partition


def targets(by: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, tag: str = "mix") -> DataFrame:
    """Adds target to ``by`` (source, source_size): weights in turn, filled to one level under the caps.

    Each round caps the sources that the level would overfill and raises the level for
    the others, until no more are.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights)).cast("int"))
    by = staged(in_turn(by, tag).withColumn("weight", weight).drop("turn"), f"{tag}-weights")
    cap = F.lit(float(most)) * F.col("source_size")
    first = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("free")).first()
    total, level, capped = share * (first["size"] or 0), 0.0, -1
    level = total / first["free"] if first["free"] else 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        now = by.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if now["n"] == capped or not now["free"]:
            break
        capped, level = now["n"], (total - (now["spent"] or 0.0)) / now["free"]
    return by.select("source", "source_size", F.when(full, cap).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def tilt(size: Column, most: float) -> Column:
    """The rate of a document of ``size`` under its source's mean, lam and full."""
    return F.when(size == 0, 0.0).when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * size / F.col("mean"))))


def balanced(counts: DataFrame, by: DataFrame, most: float = MOST, tag: str = "mix") -> DataFrame:
    """Adds mean, lam and full (every rate at its bound) to ``by`` (of, target, …) by Newton rounds over ``counts`` (of, size, n)."""
    sums = counts.groupBy("of").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n"))
    none = F.lit(None).cast("double")
    state = by.join(sums, "of", "left").select(
        *by.columns, (F.col("words") / F.col("n")).alias("mean"), F.lit(0.0).alias("lam"),
        (F.col("target") >= float(most) * F.coalesce("words", F.lit(0)) * (1 - CLOSE)).alias("full"), none.alias("low"), none.alias("high"), F.lit(FIRST_REACH).alias("reach"),
    )
    state = staged(state.withColumn("settled", F.col("full") | (F.col("target") <= 0)), f"{tag}-dual0")
    for k in range(1, NEWTON_ROUNDS + 1):
        if state.where("not settled").isEmpty():
            return state.drop("low", "high", "reach", "settled")
        rate = tilt(F.col("size"), most)
        words = F.col("n") * F.col("size") * rate
        free = F.when(rate < float(most), words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        per = counts.join(state.where("not settled").select("of", "mean", "lam", "full"), "of").groupBy("of")
        per = per.agg(F.sum(words.cast(_EXACT)).cast("double").alias("reached"), F.sum(free.cast(_EXACT)).cast("double").alias("slope"))
        missed = F.col("reached") - F.col("target")
        state = state.join(per, "of", "left").withColumns({"low": F.when(missed < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(missed > 0, F.col("lam")).otherwise(F.col("high"))})
        up = F.when(missed < 0, 1.0).otherwise(-1.0)
        newton = F.when(F.col("slope") > 0, F.abs(missed) / F.col("slope"))
        short = F.coalesce(newton > F.col("reach"), F.lit(True))
        step = up * F.when(short, F.col("reach")).otherwise(newton)
        width = F.col("high") - F.col("low")
        inside = (F.coalesce(F.col("lam") + step > F.col("low"), F.lit(True))) & (F.coalesce(F.col("lam") + step < F.col("high"), F.lit(True)))
        if k % 3 == 0:  # where Newton creeps along one bound
            inside &= width.isNull() | (F.abs(step) > width / 4)
        near = F.abs(missed) <= CLOSE * F.col("target")
        narrow = F.coalesce(width <= NARROW * F.greatest(F.abs("low"), F.abs("high")), F.lit(False))
        state = state.withColumns(
            {
                "settled": F.col("settled") | near | narrow,
                "lam": F.when(F.col("settled") | near | narrow, F.col("lam")).when(inside, F.col("lam") + step).otherwise((F.col("low") + F.col("high")) / 2),
                "reach": F.when(short, F.col("reach") * 2).otherwise(F.col("reach")),
            }
        ).drop("reached", "slope")
        state = staged(state, f"{tag}-dual{k}")
    raise RuntimeError(f"the dual did not settle in {NEWTON_ROUNDS} rounds")


def cuts(rows: DataFrame, bits: int) -> DataFrame:
    """of and cut: how far, in the order of (draw, tie), the rows (of, size, draw, tie, budget) fit their budget, by at least half of each."""
    bucket = F.floor(F.col("draw") * float(1 << bits)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("of", "bucket").agg(F.sum("size").alias("held"), F.max("budget").alias("upto"))
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    last = sums.where("base <= upto").groupBy("of").agg(F.max(F.struct("bucket", "base")).alias("l")).select("of", "l.*")
    run = Window.partitionBy("of").orderBy("draw", "tie").rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("base") + F.coalesce(F.sum("size").over(run), F.lit(0))
    edge = rows.join(last, ["of", "bucket"]).withColumn("fits", here + F.col("size") / 2 <= F.col("budget"))
    start = F.struct((F.max("bucket") / float(1 << bits)).alias("draw"), F.lit(-(1 << 63)).cast("long").alias("tie"))
    return edge.groupBy("of").agg(F.coalesce(F.max(F.when(F.col("fits"), F.struct("draw", "tie"))), start).alias("cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, tag: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row, with the columns in ``keep``."""
    id_, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    tie = F.xxhash64("doc_id", "source", "text")
    keep = [c for c in keep or [] if c not in ("doc_id", "source")]
    # The source as a struct: equality then holds for a null one too.
    read = docs.select(id_.alias("doc_id"), F.struct(source.alias("source")).alias("of"), words_in(F.col("text")).alias("size"), tie.alias("tie"), *[F.col(f"`{c}`").alias(f"__{c}") for c in keep])
    own = ["doc_id", "of", "size", "tie"]
    sizes = staged(read.select(*own), f"{tag}-sizes")
    n = sizes.count()
    bits = max(4, math.ceil(math.log2(max(n, 1)) / 2))
    by = sizes.groupBy("of").agg(F.sum("size").alias("source_size")).select("of.source", "source_size")
    by = targets(by, weights, share, most, tag).select(F.struct("source").alias("of"), "source_size", "target")
    counts = staged(sizes.where("size > 0").groupBy("of", "size").agg(F.count("*").alias("n")), f"{tag}-counts")
    by = balanced(counts, by, most, tag)
    few = by.count() <= MAX_BROADCAST_SOURCES

    def judged(rows: DataFrame, by: DataFrame) -> DataFrame:
        rate = tilt(F.col("size"), most)
        out = rows.join(F.broadcast(by) if few else by, "of").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
        u = (F.shiftrightunsigned("tie", 11) + 1) / float(1 << 53)
        late = u / (F.col("rate") - F.col("whole"))
        return out.withColumns({"large": F.col("size") * LARGE > F.col("target"), "draw": F.when(F.col("rate") > F.col("whole"), late / (1 + late))})

    rows = judged(sizes, by)
    part = (F.col("rate") - F.col("whole")) * F.col("size")
    per = rows.groupBy("of").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.sum(F.when(F.col("large"), part).cast(_EXACT)).cast("double").alias("large_budget"))
    by = staged(by.join(per, "of"), f"{tag}-sure")
    open_ = judged(sizes, by).where("draw is not null")
    large = open_.where("large").select("of", "size", "draw", "tie", F.least("large_budget", F.col("target") - F.col("sure")).alias("budget"))
    by = staged(by.join(cuts(large, bits).withColumnRenamed("cut", "large_cut"), "of", "left"), f"{tag}-large")
    place = F.struct("draw", "tie")
    got = judged(sizes, by).where(F.col("large") & (place <= F.col("large_cut"))).groupBy("of").agg(F.sum("size").alias("got"))
    by = staged(by.join(got, "of", "left"), f"{tag}-got")
    small = judged(sizes, by).where("draw is not null and not large")
    small = small.select("of", "size", "draw", "tie", (F.col("target") - F.col("sure") - F.coalesce("got", F.lit(0))).alias("budget"))
    by = staged(by.join(cuts(small, bits).withColumnRenamed("cut", "small_cut"), "of", "left"), f"{tag}-small")
    once_more = F.coalesce(place <= F.when(F.col("large"), F.col("large_cut")).otherwise(F.col("small_cut")), F.lit(False)) & F.col("draw").isNotNull()
    out = judged(read if keep else sizes, by).withColumn("copies", (F.col("whole") + once_more.cast("int")).cast("long"))
    return out.select("doc_id", "of.source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"__{c}").alias(c) for c in keep])
