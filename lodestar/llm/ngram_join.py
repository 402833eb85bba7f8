"""N-gram Jaccard self-join: groups of texts whose word-shingle sets are alike.

Method: rare-first prefix filtering.  Every set is ordered by how often its
shingles occur in the corpus (rarest first); two sets of similarity t share a
shingle in their first ``n - ceil(t n) + 1``.  Candidates come from a join on
those prefix shingles and pass length, positional and suffix filters before one
verification per pair against the whole sets.

How it stays bounded:

* Frequencies come from a count sketch over all documents whose cells grow with
  their number, up to ``2**MOST_SKETCH_BITS``; it only decides the order, so its
  error costs candidates, never results.
* Texts with equal sets are one node, found by a map-side aggregate on a
  128-bit set digest, before anything is exploded.  A node has a number of its own,
  whatever doc_ids its rows have.
* Prefix shingles of a single node are dropped before ids are shuffled.
* Whole sets are built only for the nodes of pairs that pass every filter.  A bit
  table, sized by their number, says which documents those are, so texts are not
  shuffled; documents it lets through by chance fall out of the exact join.  Past
  tens of millions of them a join by doc_id takes its place.
* Only connectivity is asked for, so pairs inside a group that is already
  connected are not verified.  A star round joins each node to a hub of its
  prefix buckets, the one with the fewest shingles of its own (then the smallest
  doc_id): what links with any member of a group of edited copies links with its
  least edited one.
  The closing round then takes every pair of a bucket that spans two components
  and passes the filters, so no link between components is lost.  A bucket's largest
  component is not set against itself.  A pair is taken at its first common shingle,
  not in every bucket that holds it.
* Pairs of a hub that holds many of them are dealt over several tasks by salts.

Defined results: null, empty and white-space texts have an empty set and link
with nothing; repeated rows are each returned, and rows that share a doc_id but
not a text each get the group of their own text; a row without doc_id links like
any other and gives no name to its group, whose component_id is null if no row of
it has a doc_id; an empty table gives an empty result; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import bounded_batches, byte_texts, components, drop, frugal, hot_keys, mixed, salted_join, shingle_hashes, signed, staged

LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 20, 24
CHUNKS = 64
BINS = 64
#: Bits of the filter on documents: 16 for each that is wanted, between these bounds; at more than a quarter of the last, a join replaces it.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 16, 28
STAR_ROUNDS = 1
#: How many earlier shingles of a set are kept beside each to tell where a pair first meets.
SEEN = 32

_SET = "doc_id long, key long, sig binary, n int, prefix array<long>, last struct<rank:int,shingle:long>, bins binary"


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    """(doc_id, distinct shingle hashes) of every row."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), *[c.to_pylist() for c in batch.columns[2:]], shingle_hashes(byte_texts(batch.column(1)), words), strict=True)


def _cells(sets: np.ndarray, bits: int) -> np.ndarray:
    return (sets >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(documents: int) -> int:
    """About 4 cells per document, within fixed bounds of 2**20 and 2**24 bytes for the table of ranks."""
    return min(MOST_SKETCH_BITS, max(LEAST_SKETCH_BITS, math.ceil(math.log2(4 * max(documents, 1)))))


def frequency_ranks(docs: DataFrame, words: int, bits: int) -> bytes:
    """One byte per sketch cell: the logarithm of how many document shingles fall into it."""

    def count(batches):
        cells, waiting, held = np.zeros(1 << bits, np.int64), [], 0
        for _, s in _sets(batches, words):
            waiting.append(s)
            held += len(s)
            if held > 1_000_000:
                cells += np.bincount(_cells(np.concatenate(waiting), bits), minlength=len(cells))
                waiting, held = [], 0
        if waiting:
            cells += np.bincount(_cells(np.concatenate(waiting), bits), minlength=len(cells))
        parts = cells.reshape(CHUNKS, -1)
        salt = xxhash.xxh32_intdigest(cells.tobytes()) % 32
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
            ["chunk", "salt", "cells"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in table["cells"].to_pylist())
        return pa.table({"chunk": table["chunk"][:1], "salt": table["salt"][:1], "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, salt int, cells binary"
    parts = docs.select("doc_id", "text").mapInArrow(frugal(count), schema)
    once = parts.groupBy("chunk", "salt").applyInArrow(add, schema)
    rows = once.groupBy("chunk").applyInArrow(add, schema).collect()  # CHUNKS rows, of a fixed size together
    total = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.int64)
    for r in rows:
        total[r["chunk"]] = np.frombuffer(zlib.decompress(r["cells"]), np.int64)
    return np.minimum(255, 6 * np.log2(total.ravel() + 1)).astype(np.uint8).tobytes()


def shingle_sets(docs: DataFrame, words: int, percent: int, ranks: bytes) -> DataFrame:
    """Each row's set size, 128-bit set digest, rare-first prefix and counts per hash range."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def build(batches):
        order = np.frombuffer(sent.value, np.uint8)
        bits = len(order).bit_length() - 1
        rows, held = ([], [], [], [], [], [], []), 0
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.struct([("rank", pa.int32()), ("shingle", pa.int64())]), pa.binary())

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "key", "sig", "n", "prefix", "last", "bins"])
            for c in rows:
                c.clear()
            return batch

        for doc, key, s in _sets(batches, words):
            p = prefix_length(len(s), percent)
            place = order[_cells(s, bits)]
            by = np.lexsort((s, place))[:p]
            # As Spark compares longs: the upper half of the unsigned ones after the lower.
            last = {"rank": int(place[by[-1]]), "shingle": int(s[by[-1]]) - (1 << 63)} if p else None
            bins = np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 65535).astype(np.uint16)
            for c, v in zip(rows, (doc, key, xxhash.xxh3_128_digest(s.tobytes()), len(s), signed(s[by]), last, bins.tobytes()), strict=True):
                c.append(v)
            held += p + 100
            if held > 500_000:
                yield out()
                held = 0
        if held:
            yield out()

    return docs.select("doc_id", "text", "key").mapInArrow(frugal(build), _SET)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def postings(reps: DataFrame, percent: int, tag: str) -> DataFrame:
    """shingle, node, doc, n, pos, last, shared and odd for the prefix shingles of two nodes or more.

    shared counts the node's earlier prefix shingles that other nodes have in their
    prefix too, odd all those that none has; last is the place of the prefix's last one.
    """
    every = reps.select("node", F.posexplode("prefix").alias("pos", "shingle"))
    shared_by = every.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").select("shingle")
    some = staged(every.join(shared_by, "shingle", "left_semi"), f"{tag}-shared")
    by_node = Window.partitionBy("node")
    n = F.col("n").cast("long")
    length = n - F.floor((percent * n + 99) / 100) + 1
    # What a node has once is joined to the few postings that are left, not shuffled with all.
    out = some.join(reps.select("node", "doc", "n", "last"), "node").select(
        "shingle", "node", "doc", "n", "pos", "last",
        (F.row_number().over(by_node.orderBy("pos")) - 1).alias("shared"),
        (length - F.count("*").over(by_node)).cast("int").alias("odd"),
    )
    out = staged(out, f"{tag}-posts")
    drop(some)
    return out


def _may(a: str, b: str, percent: int, first: bool = False):
    """Length and positional filters on two postings of one shingle.

    A shingle that comes before it in both sets is in both prefixes, so at most
    ``shared`` of the earlier ones can be common; of the later ones, as many as
    the smaller rest.  What a prefix holds and no other prefix does may still be in the
    other set, beyond its prefix: only of the set whose prefix ends first it cannot be,
    and of the other set what comes before the shingle cannot.
    first: no shingle in ``seen`` of both is common; where that holds all earlier
    ones, none of these counts.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    ends = [F.col(f"{a}.last") <= F.col(f"{b}.last"), F.col(f"{b}.last") <= F.col(f"{a}.last")]
    # pos counts the earlier ones of both kinds.
    rest = [F.col(f"{x}.n") - F.when(e, F.col(f"{x}.odd") + F.col(f"{x}.shared")).otherwise(F.col(f"{x}.pos")) for x, e in zip((a, b), ends, strict=True)]
    early = F.least(f"{a}.shared", f"{b}.shared")
    if first:
        early = F.when(F.greatest(f"{a}.shared", f"{b}.shared") <= SEEN, 0).otherwise(early)
    most = early + F.least(*rest)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * most >= percent * (na + nb - most))


def filter_bits(wanted: int) -> int | None:
    """The size of the filter for so many documents, as a power of 2; None where it would let too many others through."""
    return None if 4 * wanted > 1 << MOST_FILTER_BITS else min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (16 * wanted).bit_length()))


def _spots(docs: pa.Array, size: int) -> np.ndarray:
    ids = docs.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mixed(ids) & np.uint64((1 << size) - 1)).astype(np.int64)


def row_filter(docs: DataFrame, size: int) -> bytes:
    """A table of ``2**size`` bits, compressed, with the bit of every doc_id set."""

    def words(batches):
        for b in batches:
            at = _spots(b.column(0), size)
            word, which = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, which, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = docs.mapInArrow(frugal(words), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (size - 6), np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return zlib.compress(table.tobytes(), 1)


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int, tag: str) -> DataFrame:
    """sig and items (the whole set) of the documents in ``wanted`` (doc_id), and of a few more."""
    wanted = staged(wanted, f"{tag}-wanted")
    size = filter_bits(wanted.count())
    if size is None:
        key = F.struct("doc_id").alias("key")  # null-safe
        docs = docs.select("*", key).join(wanted.select(key), "key", "left_semi").drop("key")
        chosen = lambda batches: batches
    else:
        sent = docs.sparkSession.sparkContext.broadcast(row_filter(wanted, size))

        def chosen(batches):
            table = np.frombuffer(zlib.decompress(sent.value), np.uint64)
            for b in batches:
                at = _spots(b.column(0), size)
                yield b.filter(pa.array((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))

    def sets(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in rows], ["sig", "items"])

        rows, held = ([], []), 0
        for _, s in _sets(chosen(batches), words):
            if len(s):
                rows[0].append(xxhash.xxh3_128_digest(s.tobytes()))
                rows[1].append(s.tobytes())
                held += 8 * len(s)
            if held > 2_000_000:
                yield out()
                rows, held = ([], []), 0
        yield out()

    return staged(docs.select("doc_id", "text").mapInArrow(frugal(sets), "sig binary, items binary"), f"{tag}-sets")


def _with_partners(pairs: DataFrame, of: DataFrame, names: list[tuple[str, str, str]]) -> DataFrame:
    """The pairs with the rows of ``of`` for either end; names: a column of ``of`` and what it is called at the ends, the key first."""
    ends = names[0][1:]
    often = [hot_keys(pairs.groupBy(e).agg(F.count("*").alias("m")), [e]) for e in ends]
    out = pairs
    for k, (end, other) in enumerate((ends, ends[::-1])):
        side = of.select(*[F.col(n[0]).alias(n[1 + k]) for n in names])
        out = salted_join(out, side, [end], often[k], F.xxhash64(other))
    return out


def _verified(docs: DataFrame, pairs: DataFrame, known: DataFrame, words: int, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets really reach the similarity."""
    ends, names = "a long, sa binary, da long, b long, sb binary, db long", ["a", "sa", "da", "b", "sb", "db"]

    def suffix(batches):
        for x in batches:
            if not x.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int64) for c in ("x", "y"))
            full = (a == 65535).any(1) | (b == 65535).any(1)  # a count that met its ceiling bounds nothing
            most = np.minimum(a, b).sum(1)
            keep = full | (100 * most >= percent * (np.asarray(x.column("nx"), np.int64) + np.asarray(x.column("ny"), np.int64) - most))
            yield pa.RecordBatch.from_arrays([x.column(c) for c in names], names).filter(pa.array(keep))

    def verify(batches):
        for x in batches:
            keep = []
            for p, q in zip(x.column("x").to_pylist(), x.column("y").to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Suffix filter: counts per hash range bound the overlap of everything, past the prefix too.
    ends_of = [("node", "a", "b"), ("sig", "sa", "sb"), ("doc", "da", "db"), ("bins", "x", "y"), ("n", "nx", "ny")]
    some = staged(_with_partners(pairs, known, ends_of).mapInArrow(frugal(suffix), ends), f"{tag}-pairs")
    wanted = some.select(F.col("da").alias("doc_id")).unionByName(some.select(F.col("db").alias("doc_id"))).distinct()
    whole = whole_sets(docs, wanted, words, tag)
    both = _with_partners(some.select("a", "sa", "b", "sb"), whole.dropDuplicates(["sig"]), [("sig", "sa", "sb"), ("items", "x", "y")])
    links = staged(both.mapInArrow(frugal(verify), "a long, b long"), f"{tag}-links")
    drop(whole)
    drop(some)
    return links


def _mixed_buckets(now: DataFrame, tag: str) -> DataFrame:
    """shingle, major and m of the buckets that span components: the component with the most members there, and how many rows there are."""
    per = now.groupBy("shingle", "comp").agg(F.count("*").alias("m"))
    most = per.groupBy("shingle").agg(F.max(F.struct("m", "comp")).alias("l"), F.count("*").alias("comps"), F.sum("m").alias("m"))
    return staged(most.where("comps > 1").select("shingle", F.col("l.comp").alias("major"), "m"), tag)


def _across(now: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """a and b of the nodes of different components that meet in a bucket and may reach the similarity.

    Members of a bucket's largest component are not set against each other: one side of
    the join holds the rest only, so a bucket of one large component and a few others
    matches few rows.  Rows of a hot bucket are dealt over salts.
    """
    columns = [c for c in now.columns if c not in ("shingle", "doc")]
    rest = now.where("comp <> major").select("shingle", F.struct(*columns).alias("p"))
    met = salted_join(now.select("shingle", F.struct(*columns).alias("q")), rest, ["shingle"], hot_keys(buckets, ["shingle"]), F.xxhash64("q.node"))
    # Where both belong to the rest, the pair comes twice.
    once = (F.col("q.comp") == F.col("q.major")) | (F.col("p.node") < F.col("q.node"))
    first = ~F.arrays_overlap("p.seen", "q.seen")
    found = met.where(once & (F.col("p.comp") != F.col("q.comp")) & _may("p", "q", percent, True) & first)
    return found.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _grouped(docs: DataFrame, words: int, percent: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n, sig) and the groups of their sets (sig, comp, component_id)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = sketch_bits(docs.count())
    sets = staged(shingle_sets(docs.withColumn("key", text_key()), words, percent, frequency_ranks(docs, words, bits)), f"{tag}-prefix")
    once = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("last").alias("last"), F.first("bins").alias("bins"))
    # The number of a node is its place in this table, fixed once that is written.
    reps = staged(once.withColumn("node", F.monotonically_increasing_id()), f"{tag}-reps")
    rows = staged(sets.select("doc_id", "key", "n", "sig"), f"{tag}-rows")
    drop(sets)
    posts = postings(reps, percent, tag)
    known = staged(reps.select("node", "sig", "doc", "n", "bins"), f"{tag}-nodes")
    drop(reps)

    links = labels = None
    for r in range(STAR_ROUNDS + 1):
        if labels is None:
            now = posts.withColumn("comp", F.col("node"))
        else:
            now = posts.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            buckets = _mixed_buckets(now, f"{tag}-buckets{r}")
            now = staged(now.join(buckets.select("shingle", "major"), "shingle"), f"{tag}-open{r}")
        if r < STAR_ROUNDS:
            # Each bucket elects a hub, in later rounds at random; each node keeps two of its hubs.
            draw = F.xxhash64("node", "shingle", F.lit(r))
            rank = F.struct((F.col("odd") / F.col("n")).alias("odd"), draw.alias("draw")) if r == 0 else F.struct(draw.alias("draw"))
            hubs = now.groupBy("shingle").agg(F.min_by(F.struct("node", "doc", "n", "pos", "last", "shared", "odd", "comp"), rank).alias("h")).select("shingle", "h.*")
            star = (
                now.alias("p").join(hubs.alias("h"), "shingle").where((F.col("p.comp") != F.col("h.comp")) & _may("p", "h", percent))
                .groupBy(F.col("p.node").alias("node"))
                .agg(F.min_by(F.col("h.node"), F.struct(F.col("h.odd") / F.col("h.n"), F.col("h.doc").isNull(), F.col("h.doc"), F.col("h.node"))).alias("one"), F.max_by(F.col("h.node"), F.xxhash64("h.node", "p.node")).alias("two"))
                .select("node", F.explode(F.array("one", "two")).alias("hub"))
            )
            pairs = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).where("a <> b").distinct()
        else:
            # A pair is taken where its first common shingle is, not at each of them.
            before = Window.partitionBy("node").orderBy("pos").rowsBetween(-SEEN, -1)
            now = staged(now.withColumn("seen", F.collect_list("shingle").over(before)), f"{tag}-seen")
            pairs = _across(now, buckets, percent)
        pairs = staged(pairs, f"{tag}-candidates{r}")
        found = _verified(docs, pairs, known, words, percent, f"{tag}{r}")
        drop(pairs)
        if labels is not None:
            drop(now)
        links = found if links is None else links.unionByName(found)
        labels = staged(components(links, f"{tag}-cc{r}"), f"{tag}-labels{r}")

    linked = labels.join(known.select("node", "doc"), "node")
    lowest = staged(linked.groupBy("comp").agg(F.min("doc").alias("component_id"), F.count("*").alias("m")), f"{tag}-lowest")
    linked = salted_join(linked.drop("doc"), lowest.drop("m"), ["comp"], hot_keys(lowest, ["comp"]), F.xxhash64("node"))
    alone = F.col("comp").isNull()
    groups = known.join(linked, "node", "left").select("sig", F.coalesce("comp", "node").alias("comp"), F.when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    return rows, groups


def text_key():
    """Tells apart the texts under one doc_id."""
    return F.xxhash64("text")


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, tag: str = "jaccard") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows, groups = _grouped(docs, words, percent, tag)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(groups, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, tag: str = "near") -> DataFrame:
    """doc_id and key (``text_key``) of the one text that stays of each group: that of the smallest doc_id, then key.

    A row without doc_id comes after all others; a text without words is a group of its own under each doc_id.
    """
    rows, groups = _grouped(docs, words, percent, tag)
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    kept = rows.where("n > 0").join(groups, "sig").groupBy("comp").agg(F.min(order).alias("k")).select("k.doc_id", "k.key")
    return kept.unionByName(rows.where("n = 0").select("doc_id", "key").distinct())
