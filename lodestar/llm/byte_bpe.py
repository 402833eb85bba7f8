"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Every partition pre-tokenises its texts and packs them into blocks of about
   ``BLOCK_CHARS`` characters: the distinct words, and per text the positions as
   indexes into them.  A word that occurs thousands of times in a block is sent
   once, and the positions of a block stay one compressed value.
2. A block's words are dealt into parts by their hash, and one shuffle brings
   every part together; there each distinct word is encoded once.  On clusters that
   need more than ``MAX_PARTS`` parts the blocks form groups with parts of their own,
   so that a part of a block stays a packed row; a word is then encoded once a group.
3. The ids go back to their block, and each text is put together by position, in
   vector operations.

One shuffle carries words and blocks, and both uses read it.  Decoding joins the ids
to the token-byte table, which is broadcast: one entry per rank, bounded by the
vocabulary and checked.

Defined results: null and empty texts have no tokens and decode to no bytes; a text
longer than a block is a block of its own; repeated rows and doc_ids are encoded row
by row; an empty table gives an empty result; lone surrogates cannot occur in a Spark
string.  Only the columns named in ``carry`` come along.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.llm.shared import bounded_batches, frugal, give_back

BLOCK_CHARS = 12_000_000
KNOWN_WORDS = 1_000_000
MAX_PARTS = 1024
MAX_VOCABULARY = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank per line, read by the driver."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens exceed the bound of {MAX_VOCABULARY}")
    return ranks


def _packed(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte planes apart, compressed."""
    a = np.concatenate(arrays) if arrays else np.empty(0, np.uint32)
    return b"".join(len(z := zstandard.compress(p.tobytes(), 1)).to_bytes(4, "little") + z for p in a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unpacked(b: bytes) -> np.ndarray:
    planes, at = [], 0
    for _ in range(4):
        n = int.from_bytes(b[at : at + 4], "little")
        planes.append(np.frombuffer(zstandard.decompress(b[at + 4 : at + 4 + n]), np.uint8))
        at += 4 + n
    return np.ascontiguousarray(np.stack(planes, 1)).view("<u4").ravel()


def _pieces(items: list[bytes]) -> bytes:
    """Byte strings as one: count, lengths, contents, compressed."""
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.compress(np.array([len(items)], "<u4").tobytes() + lengths.tobytes() + b"".join(items), 1)


def _of_pieces(b: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and contents."""
    raw = zstandard.decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n :]


_ROW = "key long, block long, part int, data binary, rows binary"
_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("rows", pa.binary())])


class _Block:
    def __init__(self):
        self.words, self.rows, self.at, self.chars = {}, [], [], 0

    def add(self, row: tuple, found: list[str]) -> None:
        put, words = self.words.setdefault, self.words
        self.at.append(np.fromiter((put(w, len(words)) for w in found), np.uint32, len(found)))
        self.rows.append(row)
        self.chars += sum(map(len, found)) + 64

    def out(self, number: int, group: int, parts: int, carried: pa.Schema) -> pa.RecordBatch:
        """A row for the block (key: its number) and one for each part of its words (key: negative, the group's own)."""
        at = np.concatenate(self.at) if self.at else np.empty(0, np.uint32)
        often = np.argsort(-np.bincount(at, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often), dtype=np.uint32)
        words = [w.encode() for w in self.words]
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
        # Within a part words are sorted, which compresses well; ``sent`` is where each word stands among all sent.
        order = sorted(range(len(words)), key=lambda k: (part[k], words[k]))
        sent = np.empty(len(words), np.uint32)
        sent[rank[order]] = np.arange(len(words), dtype=np.uint32)
        held = pa.RecordBatch.from_pylist([dict(zip(carried.names, r, strict=True)) for r in self.rows], carried)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, carried) as w:
            w.write_batch(held)
        lengths = np.fromiter(map(len, self.at), np.uint32, len(self.at))
        sizes = np.array([len(words), len(lengths)], np.uint32)
        made = [(number, number, -1, _packed(sizes, sent, lengths, rank[at]), zstandard.compress(sink.getvalue().to_pybytes(), 1))]
        bounds = np.searchsorted(part[order], np.arange(parts + 1)) if order else np.zeros(parts + 1, np.int64)
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            made.append((-1 - group * parts - p, number, p, _pieces([words[k] for k in order[bounds[p] : bounds[p + 1]]]), None))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _blocks(pattern: str, carried: pa.Schema, parts: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(pattern).findall
        task, made, block = TaskContext.get().partitionId(), 0, _Block()

        def out() -> pa.RecordBatch:
            return block.out((task << 28) | made, (task + made) % groups, parts, carried)

        for batch in batches:
            side = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in carried.names]
            for text, *row in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), *side, strict=True):
                block.add(tuple(row), found(text) if text else [])
                if block.chars > BLOCK_CHARS:
                    yield out()
                    made, block = made + 1, _Block()
        if block.rows:
            yield out()

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, carry: list[str], reduce, result: str) -> DataFrame:
    """Encode ``text`` of every row.

    reduce(ids, table) makes the columns of ``result`` (a DDL string) from a text's
    ids (uint32 array) and the token-byte table; the columns of ``carry`` precede them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = docs.select(*[F.col(f"`{c}`") for c in carry], "text")
    kept = T.StructType([held.schema[c] for c in carry])
    carried = to_arrow_schema(kept)
    token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        token_bytes[rank] = token
    sent = spark.sparkContext.broadcast((ranks, token_bytes))
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-wanted // MAX_PARTS)
    width = "<u2" if len(token_bytes) <= 1 << 16 else "<u4"
    dealt = held.mapInArrow(frugal(_blocks(pattern, carried, -(-wanted // groups), groups)), _ROW).repartition("key")

    def bpe(batches):
        one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=sent.value[0], special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for b in batches:
            for key, block, part, data in zip(*[c.to_pylist() for c in b.columns[:4]], strict=True):
                if key >= 0:
                    continue
                if len(known) > KNOWN_WORDS:
                    known.clear()
                lengths, raw = _of_pieces(data)
                ends = np.cumsum(lengths).tolist()
                words = [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                for w in words:
                    if w not in known:
                        known[w] = np.array(one(w), width).tobytes()
                out = _pieces([known[w] for w in words])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([out], pa.binary())], ["key", "part", "ids"])

    # Both uses read all columns of ``dealt``, so that they share its exchange; a condition that is not
    # deterministic to the optimiser stays above it, and only the blocks' own rows go on to be put together.
    blocks = dealt.where(F.when(F.spark_partition_id() >= 0, F.col("key")) >= 0)
    ids = dealt.mapInArrow(frugal(bpe), "key long, part int, ids binary")
    schema = T.StructType([*kept.fields, *T._parse_datatype_string(result).fields])
    arrow = to_arrow_schema(schema)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return arrow.empty_table()
        table = sent.value[1]
        got = [_of_pieces(x) for _, x in sorted(zip(right["part"].to_pylist(), right["ids"].to_pylist(), strict=True))]
        sizes = np.concatenate([n for n, _ in got]) // np.dtype(width).itemsize if got else np.empty(0, np.int64)
        flat = np.frombuffer(b"".join(x for _, x in got), width)
        starts = np.cumsum(sizes) - sizes
        values = _unpacked(left["data"][0].as_py())
        n_words, n_texts = int(values[0]), int(values[1])
        place, lengths, at = np.split(values[2:], [n_words, n_words + n_texts])
        made, end = [], 0
        for n in lengths.tolist():
            mine, end = place[at[end : end + n]], end + n
            size = sizes[mine]
            after = np.cumsum(size)
            where = np.repeat(starts[mine] - after + size, size) + np.arange(after[-1]) if n else np.empty(0, np.int64)
            made.append(reduce(flat[where].astype(np.uint32), table))
        side = pa.ipc.open_stream(zstandard.decompress(left["rows"][0].as_py())).read_all()
        for f, column in zip(list(arrow)[len(carry) :], zip(*made, strict=True), strict=True):
            side = side.append_column(f, pa.array(list(column), f.type))
        return side

    def tidy(left: pa.Table, right: pa.Table) -> pa.Table:
        out = assemble(left, right)
        give_back()
        return out

    return blocks.groupBy("key").cogroup(ids.groupBy("key")).applyInArrow(tidy, schema)


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of the ids: each joined to its entry of the token-byte table."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def digests(ids: np.ndarray, table: list[bytes]) -> tuple[int, str, str]:
    """n_tokens, ids_sha256, decoded_sha256."""
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, table)).hexdigest()


def checked_ids(ids: np.ndarray, table: list[bytes]) -> tuple[int, np.ndarray]:
    """n_tokens and the ids, as an array, since those of a whole block are held at once; fails on ids whose bytes are no text."""
    decode(ids, table).decode()
    return len(ids), ids.astype(np.int32)
