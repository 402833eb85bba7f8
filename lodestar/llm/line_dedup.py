r"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n): the 128-bit hash of a line's key and the number of
documents that hold it, sorted by hash.  Each new batch of documents is counted by
itself, merge-anti-joined with the lines that the runs already know to be common
(those need no more counting), and added as a run of level 0.  When a level holds
``fanout`` runs they are merged into one of the next level, so a batch meets
logarithmically many runs and every hash is rewritten once per level.

The key of a line is the line without ``[\x20\x09-\x0D]`` at both ends, A-Z in lower
case.  Keys of at least ``min_chars`` code points that ``min_docs`` documents hold
lose all their lines in every document; all other lines stay, joined by \n.

Only DataFrame functions are used.  Lines travel as hashes with their places; texts
are shuffled once, by their own hash, to meet the places that they lose.

Defined results: a document is a row, so repeated rows and rows without doc_id count
and are answered one by one; a null or empty text is one empty line, which is never
dropped; a text that loses all its lines becomes empty; an empty table gives an empty
result; extra columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import drop, hot_keys, salted_join, staged

HASH = ["h1", "h2"]
#: Rows below which the table of common lines is broadcast: 32 bytes each in the hash relation, a few hundred MB at most.
MOST_BROADCAST = 1_000_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def text_hash(text: Column) -> Column:
    """128 bits; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(13), text).alias("t2"))


def hashed_lines(docs: DataFrame, min_chars: int, batches: int, text: str = "text") -> DataFrame:
    """t (hash of the text), place, h1, h2, first (of its key in the row) and batch, for every line with a key.

    The lines of a row are sorted by hash, so that the first of each key is found in
    one pass over the row.
    """
    keys = F.transform(lines_of(F.col(text)), lambda line, i: F.struct(key_of(line).alias("key"), i.alias("place")))
    keys = F.filter(keys, lambda k: F.length(k["key"]) >= F.lit(max(1, min_chars)))
    hashes = F.array_sort(F.transform(keys, lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit(7), k["key"]).alias("h2"), k["place"].alias("place"))))
    rows = docs.select(text_hash(F.col(text)).alias("t"), hashes.alias("lines"))
    same = lambda a, b: (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])
    told = F.transform("lines", lambda e, i: F.struct(e["place"].alias("place"), e["h1"].alias("h1"), e["h2"].alias("h2"), (~F.coalesce(same(F.get(F.col("lines"), i - 1), e), F.lit(False))).alias("first")))
    return rows.select("t", F.pmod("t.t1", F.lit(batches)).cast("int").alias("batch"), F.inline(told))


class LineRuns:
    """The levelled runs of one corpus; every run is a table in the shared folder."""

    def __init__(self, min_docs: int, fanout: int = 2, tag: str = "lines"):
        self.min_docs, self.fanout, self.tag = min_docs, max(2, fanout), tag
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _saturated(self) -> DataFrame | None:
        """Lines that one run alone knows to be common; the filter reaches the scan."""
        found = [run.where(F.col("n") >= self.min_docs).select(*HASH) for run in self.runs()]
        return reduce(DataFrame.unionByName, found) if found else None

    def add(self, counts: DataFrame) -> None:
        """A new batch: ``counts`` (h1, h2, n) of its documents, less what is common anyway."""
        known = self._saturated()
        if known is not None:
            counts = counts.join(known.hint("merge"), HASH, "left_anti")
        self._put(0, counts)

    def _put(self, level: int, rows: DataFrame) -> None:
        run = staged(rows.select(*HASH, "n").sortWithinPartitions(*HASH), f"{self.tag}-run{level}")
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._put(level + 1, reduce(DataFrame.unionByName, merged).groupBy(*HASH).agg(F.sum("n").alias("n")))
            for run in merged:
                drop(run)

    def common(self) -> DataFrame | None:
        """h1, h2, n of the lines that ``min_docs`` documents hold; n stops counting once they do."""
        if not self.runs():
            return None
        return reduce(DataFrame.unionByName, self.runs()).groupBy(*HASH).agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, text: str = "text", tag: str = "lines") -> DataFrame:
    """``docs`` with n_lines (before dropping), n_dropped, and the text without its common lines.

    ``batches`` is how many parts the corpus is fed in; the result does not depend on
    it, nor on ``fanout``.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lines = staged(hashed_lines(docs, min_chars, batches, text), f"{tag}-lines")
    runs = LineRuns(min_docs, fanout, tag)
    for k in range(batches):
        runs.add(lines.where((F.col("batch") == k) & F.col("first")).groupBy(*HASH).agg(F.count("*").alias("n")))
    common = staged(runs.common(), f"{tag}-common")
    size = common.count()
    held = lines.select("t", "place", *HASH)
    if size <= MOST_BROADCAST:
        lost = held.join(F.broadcast(common.select(*HASH)), HASH)
    else:
        lost = salted_join(held, common.select(*HASH), HASH, hot_keys(common, HASH, "n"), F.col("t.t1"))
    # Copies of one text lose the same places: a set of them is kept per text.
    lost = staged(lost.groupBy(F.col("t").alias("__t")).agg(F.collect_set("place").alias("__lost")), f"{tag}-lost")
    whole = docs.withColumn("__t", text_hash(F.col(text))).join(lost, "__t", "left").withColumn("__lines", lines_of(F.col(text)))
    n = F.size("__lines")
    # Places that stay, by a hash set; linear in the lines whatever is lost.
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("__lost", F.array().cast("array<int>")))
    kept = F.when(F.col("__lost").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n"))
    out = whole.withColumns({"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long"), text: kept})
    return out.select(*docs.columns, "n_lines", "n_dropped")
