"""A stored substring index: postings of character trigrams, intersected, then verified.

A posting is a gram, the row it occurs in and the column; grams of one and two
characters serve tokens that are shorter.  Postings lie in parts by a hash of the gram,
sorted by gram, so a search reads the parts of its own grams, and of those the row
groups that hold them.  Of a token's grams the rarest few are intersected; what is left
is looked up by id and held against the token itself, so the rows are exactly those of a
scan.  A token of wildcards only is answered by the scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import store
from lodestar.operators.tables import Change, Tables
from lodestar.session import dealt
from lodestar.staging import staged

BUCKETS, RAREST = 64, 4
#: Rows to a task as their grams are taken: a row has some hundred postings.
ROWS_EACH = 20_000


def grams(text: Column, n: int) -> Column:
    """The distinct ``n``-grams of a text, A-Z folded."""
    folded = store.ascii_lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(folded, i, F.lit(n))), lambda g: F.length(g) == n))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS))


def pieces(token: str) -> list[str]:
    """What a row must contain literally to be like ``%token%``: the runs between wildcards, A-Z folded."""
    return [p for p in re.split(r"[%_]", store._folded(token)) if p]


def grams_of(piece: str) -> list[str]:
    n = min(3, len(piece))
    return sorted({piece[i : i + n] for i in range(len(piece) - n + 1)})


class SubstringIndex:
    """The index at ``home`` over rows with a unique ``key`` and text ``columns``."""

    def __init__(self, spark: SparkSession, home: str, key: str = "id"):
        self.spark, self.tables, self.key = spark, Tables(spark, home), key

    def build(self, rows: DataFrame, columns: list[str]) -> None:
        """Postings of ``rows`` made anew."""
        each = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("column"), grams(F.coalesce(F.col(c).cast("string"), F.lit("")), n).alias("grams")) for i, c in enumerate(columns) for n in (1, 2, 3)])
        rows = dealt(rows.select(self.key, *columns), self.key, ROWS_EACH)
        found = rows.select(F.col(self.key).alias("id"), F.explode(each).alias("e")).select("id", "e.column", F.explode("e.grams").alias("gram"))
        found = staged(found, "postings")
        # How often a gram occurs goes with its postings, so that a search can take the rarest.
        counts = found.groupBy("gram").agg(F.count("*").alias("n"))

        def put(change: Change) -> None:
            change.write_parts("postings", found, bucket(F.col("gram")), emptied=[str(b) for b in range(BUCKETS)], sort=["gram"])
            change.write_parts("grams", counts, bucket(F.col("gram")), emptied=[str(b) for b in range(BUCKETS)])

        self.tables.transact(put)

    def postings(self, wanted: list[str], table: str = "postings") -> DataFrame:
        """The postings of these grams, from their parts only."""
        buckets = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(bucket(F.col("gram")).alias("b")).distinct()
        parts = [str(r["b"]) for r in buckets.collect()]  # of a query's grams
        return self.tables.read(table, parts).where(F.col("gram").isin(wanted))

    def candidates(self, tokens: list[str]) -> list[DataFrame | None]:
        """For every token the keys (id) of the rows that may contain it; None where any row may."""
        asked = {t: [grams_of(p) for p in pieces(t)] for t in tokens}
        every = sorted({g for lists in asked.values() for gs in lists for g in gs})
        if not every:
            return [None] * len(tokens)
        known = {r["gram"]: r["n"] for r in self.postings(every, "grams").collect()}  # of a query's grams
        out: list[DataFrame | None] = []
        for t in tokens:
            wanted = sorted({g for gs in asked[t] for g in gs}, key=lambda g: (known.get(g, 0), g))[:RAREST]
            if not wanted:
                out.append(None)
                continue
            held = self.postings(wanted).groupBy("id", "column").agg(F.countDistinct("gram").alias("n"))
            out.append(held.where(F.col("n") == len(wanted)).select("id").distinct())
        return out

    def search(self, rows: DataFrame, query: str, columns: tuple[str, ...] = ("name", "synonym"), limit: int | None = 50) -> DataFrame:
        """``store.token_search`` over ``rows`` with the same result, scanning candidates only."""
        tokens = query.split()
        found = self.candidates(tokens)
        if not tokens or None in found:
            return store.token_search(rows, query, columns, limit)
        of = lambda ids: rows.join(ids.withColumnRenamed("id", self.key).hint("merge"), self.key, "left_semi")
        every = reduce(lambda a, b: a.join(b.hint("merge"), "id", "left_semi"), found)
        all_ = staged(of(every), "substring-all")
        strict = store.token_search(all_, query, columns, limit, match_all=True)
        if not strict.isEmpty():
            return strict
        return store.token_search(of(reduce(DataFrame.unionByName, found).distinct()), query, columns, limit, match_all=False)

    def containing(self, rows: DataFrame, token: str, column: str) -> DataFrame:
        """``rows`` whose ``column`` contains ``token`` literally (A-Z folded on both sides)."""
        folded = store._folded(token)
        hit = store.ascii_lower(F.col(column)).contains(folded)
        wanted = grams_of(folded)
        ids = self.postings(wanted).groupBy("id", "column").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(F.col("id").alias(self.key)).distinct()
        return rows.join(ids, self.key, "left_semi").where(hit)
