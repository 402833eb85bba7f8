"""A stored vector index: inverted lists of product-quantised codes, and exact re-ranking.

Unit vectors are dealt to cells by their nearest centre, and coded by the nearest of up
to 256 codewords in each of ``pieces`` subspaces, one byte each.  A search reads the
codes of the cells nearest to a query (a byte a piece instead of a vector), adds up
looked-up scores, keeps the ``candidates`` best of a query, and reads only those vectors
for the exact cosine.

Centres and codebooks are fitted on a sample of at most ``max_sample`` rows, chosen by
the hash of their ids; every row is indexed.  The index is four tables that change in one
commit (``operators/tables.py``): centres and codebooks as a whole, codes and vectors in
parts by cell, so an upsert rewrites the cells that it touches.

Queries meet codes in blocks of both sides, joined on the cell, so neither side passes
through the driver, and a cell of any size is dealt over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.operators.tables import Change, Tables
from lodestar.operators.vectors import _unit, cosine, fit_cells, in_cells, nearest
from lodestar.staging import staged

CODE_BLOCK, QUERY_BLOCK = 8192, 256
WORDS = 256


def codebooks(points: np.ndarray, pieces: int, rounds: int = 12) -> np.ndarray:
    """pieces by codewords by length: Lloyd's rounds in each subspace, seeded by evenly spread sample points."""
    n, d = points.shape
    width = math.ceil(d / pieces)
    padded = np.pad(points, ((0, 0), (0, width * pieces - d))).reshape(n, pieces, width)
    words = min(WORDS, n)
    out = np.empty((pieces, words, width), np.float32)
    for p in range(pieces):
        x = padded[:, p]
        order = np.lexsort(x.T[::-1])
        centres = x[order[np.linspace(0, n - 1, words).astype(int)]].copy()
        for _ in range(rounds):
            own = (2 * x @ centres.T - (centres**2).sum(1)).argmax(1)
            counts = np.bincount(own, minlength=words)
            sums = np.stack([np.bincount(own, x[:, k], words) for k in range(width)], 1)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        out[p] = centres
    return out


def encode(units: np.ndarray, books: np.ndarray) -> np.ndarray:
    """One byte per vector and piece: the nearest codeword."""
    pieces, _, width = books.shape
    x = np.pad(units, ((0, 0), (0, width * pieces - units.shape[1]))).reshape(len(units), pieces, width)
    return np.stack([(2 * x[:, p] @ books[p].T - (books[p] ** 2).sum(1)).argmax(1) for p in range(pieces)], 1).astype(np.uint8)


class VectorIndex:
    """The index at ``home`` over rows (id, embedding); rows without a usable vector are not in it."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.tables = spark, Tables(spark, home)

    # --- writing -------------------------------------------------------------

    def build(self, docs: DataFrame, cells: int | None = None, pieces: int = 32, max_sample: int = 20_000) -> None:
        """The index made anew; ``cells``: about the square root of the rows, 1,024 at most, by default."""
        docs = docs.select("id", "embedding").where(F.size("embedding") > 0)
        n = docs.count()
        cells = cells or max(1, min(1024, math.isqrt(n)))
        centres = fit_cells(docs, cells, max_sample)
        draw = F.xxhash64("id").bitwiseAND((1 << 32) - 1)
        sample = docs.where(draw < int(min(1.0, max_sample / max(n, 1)) * (1 << 32))).select("embedding").toPandas()  # max_sample rows expected
        units = _unit([v for v in sample["embedding"] if len(v) == centres.shape[1]]) if len(centres) else np.zeros((1, 1))
        books = codebooks(units, min(pieces, units.shape[1]))

        def put(change: Change) -> None:
            flat = lambda a: [float(x) for x in a]
            change.write("centres", self.spark.createDataFrame([(k, flat(c)) for k, c in enumerate(centres)], "cell int, centre array<double>"))
            change.write("codebooks", self.spark.createDataFrame([(p, w, flat(v)) for p, book in enumerate(books) for w, v in enumerate(book)], "piece int, word int, value array<float>"))
            self._write(change, self._coded(docs, centres, books), [])

        self.tables.transact(put)

    def put(self, docs: DataFrame) -> None:
        """Upsert by id: only the cells that lose or gain a row are rewritten."""
        docs = docs.select("id", "embedding")

        def merge(change: Change) -> None:
            centres, books = self._fitted(change)
            fresh = staged(self._coded(docs.where(F.size("embedding") > 0), centres, books), "index-fresh")
            self._replace(change, docs.select("id"), fresh)

        self.tables.transact(merge)

    def delete(self, ids: DataFrame) -> None:
        """Without the rows ``ids`` (id)."""
        self.tables.transact(lambda change: self._replace(change, ids.select("id"), None))

    def _replace(self, change: Change, ids: DataFrame, fresh: DataFrame | None) -> None:
        held = change.read("codes")  # ids and cells: the only columns that this scan reads
        cells = held.join(ids, "id", "left_semi").select("cell")
        if fresh is not None:
            cells = cells.unionByName(fresh.select("cell"))
        touched = sorted(str(r["cell"]) for r in cells.distinct().collect())  # at most the number of cells
        kept = [change.read(t, touched).join(ids, "id", "left_anti") for t in ("codes", "vectors")]
        rows = kept[0].join(kept[1], ["id", "cell"])
        if fresh is not None:
            rows = rows.unionByName(fresh.select(*rows.columns))
        self._write(change, rows, touched)

    def _write(self, change: Change, rows: DataFrame, emptied: list[str]) -> None:
        rows = staged(rows, "index-rows")
        change.write_parts("codes", rows.select("id", "cell", "code"), "cell", emptied)
        change.write_parts("vectors", rows.select("id", "cell", "embedding"), "cell", emptied)

    def _coded(self, docs: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(books)
        own = in_cells(docs, centres, 1)
        schema = T.StructType([*own.schema.fields, T.StructField("code", T.BinaryType())])

        def run(batches):
            for b in batches:
                codes = encode(_unit(b.column("embedding").to_pylist()), sent.value) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], schema.names)

        return own.mapInArrow(run, schema)

    def _fitted(self, change: Change) -> tuple[np.ndarray, np.ndarray]:
        """Centres and codebooks; both are bounded by parameters, not by the rows."""
        centres = [r["centre"] for r in change.read("centres").orderBy("cell").collect()]
        words = change.read("codebooks").orderBy("piece", "word").collect()
        pieces = 1 + max(r["piece"] for r in words)
        return np.array(centres).reshape(len(centres), -1), np.array([r["value"] for r in words], np.float32).reshape(pieces, len(words) // pieces, -1)

    # --- reading -------------------------------------------------------------

    def search(self, queries: DataFrame, k: int = 10, candidates: int = 50, probes: float = 0.75, itself: bool = False, exact: bool = False) -> DataFrame:
        """query_id, id, score (6 decimals) and place of the ``k`` nearest rows of every query (query_id, embedding).

        probes: the share of cells whose codes are read, the nearest first.  Vectors are
        read for the ``candidates`` best codes of a query only.  A query's own id is left
        out unless ``itself``.  exact: codes are an estimate, so a near row may be no
        candidate; the vectors of all cells asked are then held against the query too, block
        by block, and the rows are those of a whole scan of these cells.
        """
        change = self.tables.begin()
        centres, books = self._fitted(change)
        queries = staged(queries.select("query_id", "embedding").where(F.size("embedding") == centres.shape[1]), "index-queries")
        asked = in_cells(queries, centres, max(1, math.ceil(probes * len(centres))))
        found = self._candidates(change.read("codes"), asked, books, candidates + (not itself))
        if not itself:
            found = found.where("id <> query_id")
        vectors = change.read("vectors").select("id", "cell", F.col("embedding").alias("__own"))
        met = found.join(vectors, ["cell", "id"]).join(queries.withColumnRenamed("embedding", "__asked"), "query_id")
        scored = met.select("query_id", "id", F.round(cosine(F.col("__own"), F.col("__asked")), 6).alias("score")).where("score is not null")
        if exact:
            held = vectors.select("id", F.col("__own").alias("v"), "cell")
            rest = nearest(held, asked.select("query_id", F.col("embedding").alias("v"), "cell"), k + 1, zeros=False).select("query_id", "id", "score")
            if itself:  # which the blocks leave out
                rest = rest.unionByName(scored.where("id = query_id"))
            scored = scored.where("id <> query_id").unionByName(rest).groupBy("query_id", "id").agg(F.max("score").alias("score"))
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)

    def _candidates(self, codes: DataFrame, asked: DataFrame, books: np.ndarray, most: int) -> DataFrame:
        """query_id, cell and id of each query's ``most`` best codes."""
        kinds = {f.name: f.dataType for f in (codes.schema["id"], asked.schema["query_id"])}
        # Blocks of both sides: how many a cell needs is counted, one row per cell.
        blocks = codes.groupBy("cell").agg(F.ceil(F.count("*") / CODE_BLOCK).cast("int").alias("blocks"))
        left = codes.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        left = left.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "code")).alias("held"))
        q = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        right = asked.join(F.broadcast(q), "cell").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")))
        right = right.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
        sent = self.spark.sparkContext.broadcast(books)
        schema = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("cell", T.IntegerType()), T.StructField("id", kinds["id"]), T.StructField("score", T.DoubleType())])

        def run(batches):
            pieces, _, width = sent.value.shape
            for b in batches:
                for k in range(b.num_rows):
                    held, asks = b.column("held")[k].values, b.column("asked")[k].values
                    code = np.stack([np.frombuffer(c, np.uint8) for c in held.field("code").to_pylist()])
                    units = _unit(asks.field("embedding").to_pylist())
                    units = np.pad(units, ((0, 0), (0, width * pieces - units.shape[1]))).reshape(len(units), pieces, width)
                    table = np.einsum("qpw,pcw->qpc", units, sent.value)  # a query's score with every codeword
                    scores = np.zeros((len(units), len(code)))
                    for p in range(pieces):
                        scores += table[:, p][:, code[:, p]]
                    n = min(most, len(code))
                    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                    rows = np.repeat(np.arange(len(units)), n)
                    yield pa.RecordBatch.from_arrays(
                        [asks.field("query_id").take(pa.array(rows)), pa.array([b.column("cell")[k].as_py()] * len(rows), pa.int32()), held.field("id").take(pa.array(top.ravel())), pa.array(scores[rows, top.ravel()])],
                        schema.names,
                    )

        # A block's best of every query; the window below sees blocks x most rows of a query.
        near = left.join(right, "cell").select("cell", "held", "asked").mapInArrow(run, schema)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("query_id", "cell", "id")
