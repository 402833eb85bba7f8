"""Conversation prefix trie, built level by level.

Per depth, live conversations are grouped by (parent node, next turn); a node is named
by its smallest member and its depth.  Then, from the deepest level up, the children
of every node are summed and joined to it, which gives leaves and savings.

A node whose members are all one and the same conversation (mostly: one member) is
the top of a chain.  Its members leave the levels at once, and the chain's nodes are
read off the conversation's own turns, so there are as many levels as different
conversations have turns in common, however long they are.

Turns travel as 128-bit hashes with their words counted; texts are moved once, to put
turns in order.  Order comes from one sort of all turns by range, not from a window
per conversation, so a conversation may hold most of the table.  A node's ids are
hashed in order by one task; runs of ids are written out as text before, in all tasks.

Defined results: turns without number come first, equal numbers are ordered by role
and text, equal rows are all kept; a null role or text is empty; rows without conv_id
belong to no conversation; a conversation rebuilt without turns is a member of the
root; without conversations there is no node, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import WORD_SPACE, hot_keys, salted_join, staged

BLOCK, PIECE = 4096, 1024
WORD = WORD_SPACE.replace("[", "[^", 1)


def numbered(turns: DataFrame, tag: str = "trie") -> DataFrame:
    """conv, pos (from 1), t1, t2 (hash of role and text) and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        # Equal rows can be told apart by where they lie, so that they need not share a task.
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = staged(
        dealt.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(11), "role", "text").alias("t2"), words.alias("words")),
        f"{tag}-turns",
    )
    # Only the first conversation of a part can have turns in the parts before.
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("conv", "part", F.sum("n").over(before).alias("base")).where("base is not null")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy("seq"))
    return dealt.withColumn("pos", place.cast("long")).join(F.broadcast(base), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("base", F.lit(0))).alias("pos"), "t1", "t2", "words")


def shift(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, tag: str = "trie") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, t1, t2, words) of the rebuilt conversations, sorted by pos, and their ids (conv)."""
    own = staged(numbered(turns, tag), f"{tag}-numbered")
    first = F.col("conv") - F.col("conv") % 20
    convs = staged(own.groupBy("conv").agg(F.count("*").alias("m")), f"{tag}-convs")
    heads = convs.select(F.col("conv").alias("head"), F.least("m", F.lit(3)).alias("held"))
    info = convs.select("conv", first.alias("head")).join(heads, "head", "left")
    info = staged(info.select("conv", "head", shift(F.col("conv")).alias("h"), F.least(shift(F.col("conv")), F.coalesce("held", F.lit(0))).alias("taken")), f"{tag}-heads")
    rest = own.where(F.col("pos") > shift(F.col("conv")))
    rest = salted_join(rest, info.select("conv", "h", "taken"), ["conv"], hot_keys(convs, ["conv"]), F.col("pos"))
    rest = rest.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "words")
    # At most 39 conversations have one head, and three turns of it at most.
    lent = own.where("pos <= 3 and conv % 20 = 0").withColumnRenamed("conv", "head").join(info.where("taken > 0").select("conv", "head", "taken"), "head")
    lent = lent.where("pos <= taken").select("conv", "pos", "t1", "t2", "words")
    order = ["pos", "conv"]
    return staged(rest.unionByName(lent).repartitionByRange(*order).sortWithinPartitions(*order), f"{tag}-rebuilt"), convs


def _node() -> list[Column]:
    """What a node's live members make of it."""
    # Members that are all one conversation: from here on a chain.
    alike = (F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))
    return [F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("len").alias("len"), alike.alias("chain")]


def trie(turns: DataFrame, convs: DataFrame, tag: str = "trie") -> DataFrame:
    """The trie's nodes from ``turns`` (conv, pos, t1, t2, words; pos from 1 without holes) of ``convs`` (conv)."""
    whole = turns.groupBy("conv").agg(F.count("*").alias("len"), F.bit_xor(F.xxhash64("pos", "t1", "t2")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(5), "pos", "t1", "t2")).alias("s2"))
    zero = F.lit(0).cast("long")
    whole = staged(convs.select("conv").join(whole, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in ("len", "s1", "s2")]), f"{tag}-whole")
    root = staged(whole.withColumns({"words": zero}).agg(*_node()).where("n_convs > 0").withColumn("parent", F.lit(None).cast("long")), f"{tag}-nodes")
    levels, top = [root], root.select("conv_id", "chain").first() or (None, True)
    live = whole.withColumns({"node": F.lit(top[0]).cast("long"), "chain": F.lit(top[1])})
    ended, depth = [], 0
    while True:
        live = staged(live.join(turns.where(F.col("pos") == depth + 1).drop("pos"), "conv", "left"), f"{tag}-live")
        ended.append(live.where(F.col("chain") | (F.col("len") == depth)).select(F.col("node").alias("conv_id"), F.col("len").alias("depth"), "conv"))
        live, depth = live.where(~F.col("chain") & (F.col("len") > depth)).drop("chain"), depth + 1
        keys = ["node", "t1", "t2"]
        nodes = staged(live.groupBy(*keys).agg(*_node()), f"{tag}-nodes")
        if nodes.isEmpty():
            break
        levels.append(nodes.withColumnRenamed("node", "parent"))
        named = nodes.select(*keys, F.col("conv_id").alias("child"), "chain")
        live = salted_join(live.drop("words"), named, keys, hot_keys(nodes, keys, "n_convs"), F.xxhash64("conv"))
        live = live.drop(*keys).withColumnRenamed("child", "node")
    tops = reduce(DataFrame.unionByName, [n.where("chain").select("conv_id", F.lit(d).cast("long").alias("top"), "n_convs", "len") for d, n in enumerate(levels)])
    chains = staged(_chains(turns, tops, hot_keys(whole.select("conv", F.col("len").alias("m")), ["conv"])), f"{tag}-chains")
    rows = [chains.where("depth > top").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", "n_children", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens")]
    above = None
    for d in range(len(levels) - 1, -1, -1):
        here = levels[d].select("conv_id", F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "words", "chain", "len")
        at = chains.where((F.col("top") == d) & (F.col("depth") == d)).select("conv_id", "n_children", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens")
        alone = here.where("chain").drop("words", "chain", "len").join(at, "conv_id")
        if above is not None:
            sums = above.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
            inner = here.where("not chain").join(sums, "conv_id")
            inner = inner.withColumn("saved_tokens", F.col("below") + (F.col("n_convs") - 1) * F.col("words")).drop("words", "chain", "len", "below")
            alone = alone.unionByName(inner)
        above = staged(alone, f"{tag}-level")
        rows.append(above)
    ends = ends_digests(reduce(DataFrame.unionByName, ended))
    none = F.sha2(F.lit(""), 256)
    out = reduce(DataFrame.unionByName, rows).join(ends, ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", none))


def _chains(turns: DataFrame, tops: DataFrame, hot: DataFrame) -> DataFrame:
    """conv_id, top, depth, n_convs, n_children, saved_tokens of every chain's nodes, its top included."""
    own = salted_join(turns.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "words"), tops, ["conv_id"], hot.withColumnRenamed("conv", "conv_id"), F.col("depth"))
    own = own.where("depth >= top").unionByName(tops.where("top = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "top", "n_convs", "len"))
    own = own.withColumn("n_children", F.when(F.col("depth") < F.col("len"), 1).otherwise(0).cast("long")).drop("len")
    columns = ["conv_id", "top", "depth", "n_convs", "n_children", "saved_tokens"]
    lone = own.where("n_convs = 1").withColumn("saved_tokens", F.lit(0).cast("long")).select(*columns)
    # Words from a turn to the chain's end: sums of later blocks, and a running sum within the block.
    many = own.where("n_convs > 1").withColumn("block", F.floor(F.col("depth") / BLOCK))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = many.groupBy("conv_id", "block").agg(F.sum("words").alias("held")).select("conv_id", "block", F.coalesce(F.sum("held").over(after), F.lit(0)).alias("later"))
    onward = F.sum("words").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")))
    many = many.withColumn("onward", onward).join(sums, ["conv_id", "block"])
    return lone.unionByName(many.withColumn("saved_tokens", (F.col("n_convs") - 1) * (F.col("later") + F.col("onward"))).select(*columns))


def _pieces(batches):
    """Runs of ids of one node, written out as text; rows come sorted by node and id."""
    for b in batches:
        depth, node, conv = (b.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "conv_id", "conv"))
        n = b.num_rows
        cuts = [0, *(k for k in range(1, n) if node[k] != node[k - 1] or depth[k] != depth[k - 1]), n] if n else [0]
        told = pc.cast(b.column("conv"), pa.string()).to_pylist()
        spans = [(k, min(k + PIECE, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False) for k in range(lo, hi, PIECE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(x[lo]) for lo, _ in spans], pa.int64()) for x in (node, depth, conv)] + [pa.array([",".join(told[lo:hi]) for lo, hi in spans], pa.string())], names=["conv_id", "depth", "least", "ids"]
        )


def _digests(batches):
    """The SHA-256 of each node's pieces, joined by commas, as they come; one node's state at a time."""
    key, state = None, None
    for b in batches:
        out = []
        for node, depth, ids in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (node, depth) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _rows(out)
    if key:
        yield _rows([(*key, state.hexdigest())])


def _rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "depth": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def ends_digests(ended: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of every node at which conversations (conv) end."""
    order = ["conv_id", "depth", "conv"]
    pieces = ended.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "conv_id long, depth long, least long, ids string")
    dealt = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least")
    return dealt.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, tag: str = "trie") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node over the rebuilt conversations."""
    return trie(*rebuilt(conversations, tag), tag)
