"""Vector search: documents with embeddings, exact and approximate cosine neighbours.

Exact search for one vector is a projection and a top-k, all in the JVM.  Search
for a table of queries joins blocks of queries with blocks of documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.operators.store import latest, publish

MAX_QUERY_BYTES = 64 << 20
#: Rows to a block of either side, and scores (or cells of a text) that a task holds at once.
QUERY_BLOCK, DOC_BLOCK, SLICE = 16384, 16384, 1 << 21
#: Words whose cells a worker remembers.
MOST_WORDS = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def search(docs: DataFrame, vector: list[float], limit: int = 20, condition: Column | None = None, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """The ``limit`` rows nearest to ``vector``, best first, with score (6 decimals); filters apply before the limit."""
    some = docs if condition is None else docs.where(condition)
    scored = some.withColumn("score", F.round(cosine(F.col(embedding), _literal(vector)), 6)).where("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def similar(docs: DataFrame, doc_id, limit: int = 10, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """Neighbours of a stored document, without itself; nothing if it is not there."""
    own = docs.where(F.col(id_column) == doc_id).select(F.col(embedding).alias("__own")).limit(1)
    scored = docs.where(F.col(id_column) != doc_id).crossJoin(F.broadcast(own))  # one row
    scored = scored.withColumn("score", F.round(cosine(F.col(embedding), F.col("__own")), 6)).drop("__own").where("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def neighbours(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """query_id, id, score and place of the k nearest documents of every query (query_id, embedding), itself left out.

    A stated set of queries against all rows, by blocks of both sides (``nearest``).
    """
    asked = queries.select("query_id", F.col(embedding).alias("v"), F.lit(0).alias("cell"))
    held = docs.select(F.col(id_column).alias("id"), F.col(embedding).alias("v"), F.lit(0).alias("cell"))
    return nearest(held, asked, k)


def nearest(docs: DataFrame, asked: DataFrame, k: int, zeros: bool = True) -> DataFrame:
    """query_id, id, score and place of the k nearest of ``docs`` (id, v, cell) to every row of ``asked`` (query_id, v, cell), among those of its cells.

    Both sides are dealt into blocks of a cell, every block of queries meets every block
    of documents, and a meeting gives its own k best per query (and what ties with the
    last), so no pair of rows is ever a row by itself and neither side passes through the
    driver.  A task holds one meeting, and scores it in slices.  zeros: whether a vector
    without length counts, at score 0.
    """
    d, q = docs.where(F.size("v") > 0), asked.where(F.size("v") > 0)
    blocks = lambda rows, each, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / each).cast("int").alias(name))
    sizes = F.broadcast(blocks(d, DOC_BLOCK, "nx").join(blocks(q, QUERY_BLOCK, "ny"), "cell"))  # one row per cell
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(n)).cast("int")
    left = d.join(sizes, "cell").withColumn("x", own("id", "nx", 3)).withColumn("y", all_of("ny")).select("cell", "x", "y", "id", "v")
    right = q.join(sizes, "cell").withColumn("y", own("query_id", "ny", 1)).withColumn("x", all_of("nx")).select("cell", "x", "y", "query_id", "v")
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", d.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, asks = mine["id"].combine_chunks(), theirs["query_id"].combine_chunks()
        held = {n: (at, m) for n, at, m in _by_length(mine["v"])}
        out = []
        for n, at, wanted in _by_length(theirs["v"]):  # only vectors of one length are compared
            if n not in held:
                continue
            cols, own = held[n][0], _unit(held[n][1])
            some = ids.take(pa.array(cols))
            names = some.to_numpy(zero_copy_only=False)
            none = ~own.any(1) if not zeros else np.zeros(len(own), bool)
            step = max(1, SLICE // len(own))
            for s in range(0, len(at), step):
                units, few = _unit(wanted[s : s + step]), asks.take(pa.array(at[s : s + step]))
                scores = units @ own.T
                scores[few.to_numpy(zero_copy_only=False)[:, None] == names[None, :]] = -2.0
                if not zeros:
                    scores[:, none] = -2.0
                    scores[~units.any(1)] = -2.0
                last = max(0, len(own) - k)
                # What rounds to the last one's score goes on, so the choice among ties is made globally.
                floor = np.partition(scores, last, axis=1)[:, last]
                x, y = np.nonzero((scores >= floor[:, None] - 1e-6) & (scores > -1.5))
                out.append(pa.Table.from_arrays([few.take(pa.array(x)), some.take(pa.array(y)), pa.array(scores[x, y])], schema.names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([asks[:0], ids[:0], pa.array([], pa.float64())], schema.names)

    key = ["cell", "x", "y"]
    out = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, schema).withColumn("score", F.round("score", 6))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _by_length(column: pa.ChunkedArray):
    """Length, places and matrix of the vectors of every length in a column of lists, without a Python object for each number."""
    lists = column.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n), at, flat.reshape(-1, n) if len(at) == len(size) else flat[start[at][:, None] + np.arange(n)]


def _unit(vectors) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def lsh_neighbours(docs: DataFrame, vector: list[float], limit: int = 20, id_column: str = "id", embedding: str = "embedding", tables: int = 16, length: float = 0.8) -> DataFrame:
    """Approximate search: random projections of the unit vectors select candidates, exact cosine ranks them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    size = norm(F.col(embedding))
    unit = F.transform(embedding, lambda x: F.try_divide(x.cast("double"), size))
    hashed = docs.where(size > 0).withColumn("__unit", array_to_vector(unit))
    model = BucketedRandomProjectionLSH(inputCol="__unit", outputCol="__hash", bucketLength=length, numHashTables=tables, seed=7).fit(hashed)
    n = math.sqrt(sum(x * x for x in vector)) or 1.0
    near = model.approxNearestNeighbors(hashed, Vectors.dense([x / n for x in vector]), limit)
    return near.withColumn("score", F.round(cosine(F.col(embedding), _literal(vector)), 6)).drop("__unit", "__hash", "distCol").orderBy(F.desc("score"), id_column)


def stats(docs: DataFrame, by: str = "doc_type", embedding: str = "embedding") -> DataFrame:
    """by, documents, dimension and bytes of 4-byte components, with a total row (by null)."""
    return docs.rollup(by).agg(F.count("*").alias("documents"), F.max(F.size(embedding)).alias("dimension"), F.sum(F.size(embedding) * 4).cast("long").alias("bytes"))


def put(current: DataFrame, documents: DataFrame, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """Upsert by id; documents without an embedding are left out."""
    some = documents.where(F.size(embedding) > 0)
    both = current.withColumn("__new", F.lit(0)).unionByName(some.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [id_column], [F.desc("__new")]).drop("__new")


def missing(documents: DataFrame, stored: DataFrame, id_column: str = "id") -> DataFrame:
    """Documents that the index does not have: what a backfill or a resumed run still has to do."""
    return documents.join(stored.select(id_column), id_column, "left_anti")


def rebuild(documents: DataFrame, home: str) -> None:
    """The index at ``home`` made anew from the documents, as one published version."""
    publish(documents, home)


def get(docs: DataFrame, doc_id, id_column: str = "id") -> DataFrame:
    """The stored document of that id, if there is one."""
    return docs.where(F.col(id_column) == doc_id)


def existing_ids(docs: DataFrame, prefixes: list[str] | None = None, id_column: str = "id") -> DataFrame:
    some = docs if not prefixes else docs.where(reduce(lambda a, b: a | b, [F.col(id_column).startswith(p) for p in prefixes]))
    return some.select(id_column)


def embed(texts: DataFrame, text: str = "content", dims: int = 64, out: str = "embedding") -> DataFrame:
    """Deterministic offline embedding: signed hashing of lower-cased words and their trigrams, L2-normalised."""

    @F.pandas_udf("array<float>")
    def hashed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, bytes] = {}  # words recur; each is hashed once a task, or until there are too many
        for column in columns:
            yield column.map(lambda t: hash_vector(t, dims, known))

    return texts.withColumn(out, hashed(F.col(text)))


def _word_cells(word: str, dims: int) -> bytes:
    """A cell for each of the word and its trigrams: up to ``dims`` those that count down, from there on those that count up."""
    padded = f" {word} "
    h = [zlib.crc32(f.encode()) for f in (word, *(padded[i : i + 3] for i in range(len(padded) - 2)))]
    return np.array([x % dims + (x >> 31) * dims for x in h], _cell_type(dims)).tobytes()


def _cell_type(dims: int) -> str:
    return "u1" if dims <= 128 else "<u4"


def hash_vector(text: str | None, dims: int = 64, known: dict[str, bytes] | None = None) -> np.ndarray:
    known = {} if known is None else known
    if len(known) > MOST_WORDS:
        known.clear()
    words = re.findall(r"\w+", (text or "").lower())
    for word in set(words).difference(known):
        known[word] = _word_cells(word, dims)
    # The text's cells one after the other, counted at once: no vector for each word.
    cells = np.frombuffer(b"".join(map(known.__getitem__, words)), _cell_type(dims))
    n = sum((np.bincount(cells[s : s + SLICE], minlength=2 * dims) for s in range(0, len(cells), SLICE)), np.zeros(2 * dims, np.int64))
    v = (n[dims:] - n[:dims]).astype(np.float64)
    size = np.linalg.norm(v)
    return (v / size if size else v).astype(np.float32)


# --- index of cells ----------------------------------------------------------


def fit_cells(docs: DataFrame, cells: int = 64, max_sample: int = 20_000, id_column: str = "id", embedding: str = "embedding", rounds: int = 15) -> np.ndarray:
    """Centres of ``cells`` cells of unit vectors, by Lloyd's rounds over about ``max_sample`` rows at most, chosen by the hash of their ids."""
    some = docs.where(F.size(embedding) > 0)
    total = some.count()
    draw = F.xxhash64(id_column).bitwiseAND((1 << 32) - 1)
    sample = some.where(draw < int(min(1.0, max_sample / max(total, 1)) * (1 << 32))).select(embedding).toPandas()
    points = _unit(sample[embedding])
    if not len(points):
        return np.zeros((0, 0))
    # Farthest-first seeds, the first point being the one with the smallest coordinates.
    centres = points[np.lexsort(points.T[::-1])[:1]]
    while len(centres) < min(cells, len(np.unique(points, axis=0))):
        centres = np.vstack([centres, points[(points @ centres.T).max(1).argmin()]])
    for _ in range(rounds):
        own = (points @ centres.T).argmax(1)
        sums = np.stack([points[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def in_cells(docs: DataFrame, centres: np.ndarray, probes: int = 1, embedding: str = "embedding") -> DataFrame:
    """Every row once for each of its ``probes`` nearest cells (column cell); rows without a vector of that size have none."""
    if centres.nbytes > MAX_QUERY_BYTES:
        raise ValueError(f"{len(centres)} cells exceed the bound of {MAX_QUERY_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(column: pd.Series) -> pd.Series:
        c = sent.value
        out = [np.empty(0, np.int32)] * len(column)
        fit = [k for k, v in enumerate(column) if v is not None and len(c) and len(v) == c.shape[1]]
        if fit:
            order = np.argsort(-(_unit(column.iloc[fit]) @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            for k, cells in zip(fit, order, strict=True):
                out[k] = cells
        return pd.Series(out)

    return docs.withColumn("cell", F.explode(near(F.col(embedding))))


def neighbours_in_cells(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 16, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """query_id, id, score and place of the k nearest rows among the ``probes`` cells nearest to each query, itself left out; block by block of a cell."""
    asked = in_cells(queries.select("query_id", F.col(embedding).alias("__asked")), centres, probes, "__asked")
    held = indexed.select(F.col(id_column).alias("id"), F.col(embedding).alias("v"), "cell")
    return nearest(held, asked.withColumnRenamed("__asked", "v"), k, zeros=False)
