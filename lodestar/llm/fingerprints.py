"""Document fingerprints by I-Match over randomised lexicon subsets, all in DataFrame operations.

The lexicon holds the terms whose document frequency lies in a band; a text keeps
its distinct terms of the lexicon, sorted, and one 64-bit hash is taken of them
for each of ``len(RATES)`` random subsets of the lexicon.  Subset k holds a term
with probability 2**-RATES[k], so dense subsets tell close copies apart and thin
ones still agree on texts that share only part of their terms.

Size of what is broadcast: at most (distinct terms per text) / ``min_share`` terms
can occur in ``min_share`` of all texts, whatever the corpus size; the count is
checked all the same, and a larger lexicon is joined by shuffle.

Defined results: null counts as empty; a text without a lexicon term in any
subset is fingerprinted by its own hash, so equal texts always agree and those
texts agree with no other; rows that share a doc_id are ordered by text, those without
one come last; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import WORD_SPACE, staged

#: Each subset's share of the lexicon, as powers of 1/2.
RATES = [2] * 2 + [3] * 3 + [4] * 5 + [5] * 6 + [6] * 6 + [7] * 6 + [8] * 4
MIN_SHARE, MAX_SHARE = 0.001, 0.2
MAX_BROADCAST_TERMS = 1 << 20
TERM_BITS = 32


def terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, WORD_SPACE), ""))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """word, code: the terms in the band; code packs a hash (high bits) and one bit per subset it is in."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    some = counts.where(F.col("df").between(max(2, math.ceil(min_share * n)), max(2, math.floor(max_share * n))))
    subsets = F.lit(0).cast("long")
    for k, rate in enumerate(RATES):
        subsets = subsets.bitwiseOR(F.when(F.xxhash64("word", F.lit(k)).bitwiseAND((1 << rate) - 1) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    code = F.shiftleft(F.shiftrightunsigned(F.xxhash64("word"), 64 - TERM_BITS), 64 - TERM_BITS).bitwiseOR(subsets)
    return staged(some.select("word", code.alias("code")), "lexicon")


def with_terms(rows: DataFrame, words: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and codes (sorted distinct lexicon terms) for each row; keys must tell the rows apart."""
    # The empty string stands in every text and keeps texts without lexicon terms.
    marked = words.unionByName(words.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).cast("long").alias("code")))
    if words.count() <= MAX_BROADCAST_TERMS:
        marked = F.broadcast(marked)
    exploded = rows.select(*keys, F.explode(F.array_append(terms(F.col(text)), "")).alias("word"))
    return exploded.join(marked, "word").groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("code") != 0, F.col("code")))).alias("codes"))


def hashes(codes: Column, whole: Column) -> Column:
    """One hash per subset, null where the text has no term of it; then the text's own hash if all of them are null."""

    def within(bit: int) -> Column:
        return F.filter(codes, lambda c: c.bitwiseAND(F.lit(bit)) != 0)

    each = [within(1 << k) for k in range(len(RATES))]
    every = F.lit((1 << len(RATES)) - 1).cast("long")
    none = ~F.exists(codes, lambda c: c.bitwiseAND(every) != 0)
    return F.array(*[F.when(F.size(e) > 0, F.xxhash64(e)) for e in each], F.when(none, whole))


def likeness(a: str, b: str) -> Column:
    """Share of agreeing hashes among the subsets in which either text has a term."""
    pairs = F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.filter(pairs, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    return F.coalesce(F.size(same) / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0)).cast("double")


def printed(signs: str) -> Column:
    return F.array_join(F.transform(signs, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-"))), ".")


def in_ranges(docs: DataFrame, rows_each: int = 2000, most: int = 100_000) -> DataFrame:
    """Adds bucket: ranges of descending doc_id of about ``rows_each`` rows, about ``most`` at most; a row without doc_id comes last.

    The ranges are found and looked up in two steps: a short list of bounds deals the
    rows into runs, and every run has a list of its own, joined from a table of at
    most ``most`` numbers.
    """
    width = math.isqrt(max(1, min(most, docs.count() // rows_each)) - 1) + 1
    if width == 1:
        return docs.withColumn("bucket", F.lit(0))
    shares = [k / width for k in range(1, width)]
    below = lambda bounds: F.size(F.filter(bounds, lambda c: F.col("doc_id") < c))
    coarse = docs.agg(F.percentile_approx("doc_id", shares, 100_000).alias("c")).first()["c"]
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(coarse or []))]).cast("array<long>")
    found = docs.withColumn("run", F.when(F.col("doc_id").isNotNull(), below(bounds)).otherwise(0))
    runs, base = [], 0
    for r in found.groupBy("run").agg(F.percentile_approx("doc_id", shares, 10_000).alias("c")).orderBy("run").collect():
        runs.append((r["run"], base, own := sorted(set(r["c"] or []))))
        base += len(own) + 1
    table = docs.sparkSession.createDataFrame(runs, "run int, base int, bounds array<long>")
    found = found.join(F.broadcast(table), "run")
    return found.withColumn("bucket", F.when(F.col("doc_id").isNull(), base).otherwise(F.col("base") + below("bounds"))).drop("run", "base", "bounds")


def edited_fingerprints(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, tag: str = "imatch") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike neighbours are.

    The edited text has its last floor(n/2) code points replaced by the first as
    many of the next document in descending doc_id (after the last, the first).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(docs, min_share, max_share)
    dealt = in_ranges(docs)
    # The first document of each range also ends the range before it, as a guest.
    firsts = staged(dealt.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")), f"{tag}-firsts")
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row per range, at most 100,000
    before = firsts.select("doc_id", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("bucket"))
    # As a struct, doc_id is compared null-safe: the range of rows without one has a first document too.
    named = before.select(F.struct("doc_id").alias("key"), "bucket")
    guests = docs.withColumn("key", F.struct("doc_id")).join(F.broadcast(named), "key").groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    rows = dealt.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests.select("bucket", F.lit(1).alias("guest"), "doc_id", "text"))
    by = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    placed = rows.select("bucket", "guest", "doc_id", "text", F.row_number().over(by).alias("place"), F.coalesce(F.lead("text").over(by), F.lit("")).alias("next_text"))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = placed.select("bucket", "guest", "doc_id", "place", "text", edited.alias("edited")).select(
        "bucket",
        F.explode(
            F.array(
                F.struct("place", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.lit(0).alias("kind"), F.col("text"), F.xxhash64("text").alias("whole"), F.unhex(F.sha2(F.col("edited"), 256)).alias("sha")),
                F.struct("place", F.lit(2).alias("guest"), "doc_id", F.lit(0).cast("long").alias("n_chars"), F.lit(1).alias("kind"), F.col("edited").alias("text"), F.xxhash64("edited").alias("whole"), F.lit(None).cast("binary").alias("sha")),
            )
        ).alias("r"),
    ).select("bucket", "r.*")
    keys = ["bucket", "place", "kind", "guest", "doc_id", "n_chars", "whole", "sha"]
    coded = with_terms(both, words, keys).withColumn("signs", hashes(F.col("codes"), F.col("whole")))
    # Both kinds of a row lie in one bucket, so no further exchange is needed.
    row = coded.groupBy("bucket", "place").agg(
        F.max("doc_id").alias("doc_id"),
        F.min("guest").alias("guest"),
        F.max("n_chars").alias("n_chars"),
        F.max("sha").alias("sha"),
        F.max(F.when(F.col("kind") == 0, F.struct("signs"))).getField("signs").alias("signs"),
        F.max(F.when(F.col("kind") == 1, F.struct("signs"))).getField("signs").alias("edited_signs"),
    )
    next_row = row.withColumn("next_signs", F.lead("signs").over(Window.partitionBy("bucket").orderBy("place"))).where("guest = 0")
    return next_row.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        printed("signs").alias("fingerprint"),
        printed("edited_signs").alias("edited_fingerprint"),
        likeness("signs", "edited_signs").alias("near_edited"),
        likeness("signs", "next_signs").alias("near_next"),
    )
