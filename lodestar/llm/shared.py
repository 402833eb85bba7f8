"""What several operators of this package need: shared tables, batches, hashing, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.staging import _STAGED, drop, hot_keys, release, salted_join, shared_dir, staged

__all__ = ["WORD_SPACE", "_STAGED", "bounded_batches", "byte_texts", "components", "drop", "frugal", "give_back", "hot_keys", "mixed", "release", "salted_join", "shared_dir", "shingle_hashes", "shingles", "signed", "staged", "word_hashes"]

#: White space that separates words in every operator: U+0020 and U+0009 to U+000D.
WORD_SPACE = r"[\x20\x09-\x0D]+"
def bounded_batches(spark: SparkSession, records: int = 4096) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system: a worker stays, idle, while the JVM or another one works."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at the end of a task the worker gives freed memory back."""

    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(32))


#: Bytes of texts whose words are hashed together: their arrays stay in a core's cache. Words of more bytes than LONG_WORD are hashed one by one.
AT_ONCE, LONG_WORD = 1 << 17, 64
_BYTES, _FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), np.array([True])


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``text``, A-Z lower-cased, and where in it they begin."""
    text = b" " + text.lower() + b" " * (16 - (len(text) + 1) % 8)  # whole blocks, and one more after each word
    chars, blocks = np.frombuffer(text, np.uint8), np.frombuffer(text, "<u8")
    space = (chars == 32) | (chars - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # words begin and end there by turns
    starts, sizes = edges[::2], edges[1::2] - edges[::2]

    def piece(of, done):
        at = starts[of] + done
        block, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # A shift by all 64 bits leaves nothing.
        return ((blocks[block] >> shift) | (blocks[block + 1] << (np.uint64(64) - shift))) & _BYTES[np.minimum(sizes[of] - done, 8)]

    h = mixed(piece(slice(None), 0) ^ mixed(sizes.astype(np.uint64)))
    done, longer = 8, np.flatnonzero(sizes > 8)
    while len(longer) and done < LONG_WORD:
        h[longer] = mixed(h[longer] ^ piece(longer, done))
        done += 8
        longer = longer[sizes[longer] > done]
    for i in longer.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + sizes[i]])
    return h, starts - 1


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every n words in a row."""
    h = np.full(max(0, len(word_hashes) - n + 1), np.uint64(n), np.uint64)
    for k in range(n):
        h = mixed(h * _MIX[1] + word_hashes[k : k + len(h)])
    return h


def shingle_hashes(texts: Iterable[bytes | None], n: int) -> Iterator[np.ndarray]:
    """Distinct 64-bit hashes of each text's n-word shingles, ascending; with fewer words, of the whole sequence; none for none.

    Words and shingles are hashed for ``AT_ONCE`` bytes of texts together.
    """
    waiting, held = [], 0

    def out():
        words, at = word_hashes(b"\n".join(waiting))
        every = shingles(words, n)
        cuts = np.searchsorted(at, np.cumsum([0, *[len(t) + 1 for t in waiting]])).tolist()
        for i, j in pairwise(cuts):
            s = np.sort(every[i : j - n + 1] if j - i >= n else shingles(words[i:j], j - i)[: j - i])
            yield s if len(s) < 2 else s[np.concatenate((_FIRST, s[1:] != s[:-1]))]

    for t in texts:
        waiting.append(t or b"")
        held += len(waiting[-1])
        if held > AT_ONCE:
            yield from out()
            waiting, held = [], 0
    yield from out()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(links: DataFrame, tag: str) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): one row (node, comp) per linked node.

    comp is the smallest node reachable.  Alternates large-star and small-star
    rounds until the edges stop changing; each round is a table in the shared
    folder.  Groups are only ever aggregated (min), never collected, so a node
    with very many links is split like any skewed join key.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )
    seen = None
    for _ in range(64):
        # Large star: from u, every larger neighbour is linked to u's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = staged(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct(),
            tag,
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle in 64 rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
