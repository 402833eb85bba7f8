"""URL filters on a sorted digest array.

Rules (host, path prefix) become one array of sorted 64-bit xxhash keys with the
rule strings beside it.  Workers memory-map the file in which Spark keeps the
broadcast array, once for all of an executor, and probe a batch of candidate
(host suffix, path prefix) strings by vectorised binary search; a hit counts
only when the stored string is equal, so colliding digests cannot misjudge.
The longest fitting rule wins, of equally long ones that with the longer host; of
rules with the same host and path the last listed counts; with none, the verdict
is ``default``.

The array is sent to the workers only up to ``max_index_bytes``, checked before.
Beyond that the candidates of each distinct url are joined to the rules instead.

Defined results: host and path are empty for a null url or one without ``://``,
no rule fits then; a url of any length is judged whole; repeated rows are judged
one by one; an empty table or an empty list of rules is no special case; extra
columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import functools
import mmap
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import bounded_batches

MAX_INDEX_BYTES = 64 << 20
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def candidates(host: str, path: str, host_lengths: list[int], lengths: list[int]) -> list[str]:
    """Every string under which a rule that fits could be stored: longest first, of equally long ones the longer host. Host and path are kept apart by a NUL.

    Only suffixes as long as some rule's host are made, so a host of any number of
    labels gives a bounded number of bounded strings.
    """
    hosts = [host[-h:] for h in host_lengths if 0 < h <= len(host) and (h == len(host) or host[-h - 1] == ".")]
    out = [(len(h) + n, len(h), f"{h}\0{path[:n]}") for h in hosts for n in lengths if n <= len(path)]
    return [c for *_, c in sorted(out, reverse=True)]


class SortedDigests:
    """64-bit keys in order, and the strings (with a verdict byte) they stand for."""

    MAGIC = b"sorted64"

    def __init__(self, image: bytes | mmap.mmap):
        at = image.find(self.MAGIC) + len(self.MAGIC)
        n = int(np.frombuffer(image, "<u8", 1, at)[0])
        self.keys = np.frombuffer(image, "<u8", n, at + 8)
        self.ends = np.frombuffer(image, "<u8", n + 1, at + 8 + 8 * n)
        self.text = memoryview(image)[at + 8 + 8 * n + 8 * (n + 1) :]

    @classmethod
    def image(cls, entries: dict[str, str]) -> bytes:
        """The bytes of the array; entries: candidate string to verdict. Its numbers stand at multiples of 8 in the broadcast's file."""
        coded = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode() + (b"\x01" if v == "block" else b"\x00")) for k, v in entries.items())
        keys = np.array([k for k, _ in coded], "<u8")
        ends = np.concatenate(([0], np.cumsum([len(t) for _, t in coded], dtype=np.int64))).astype("<u8")
        out = cls.MAGIC + np.array([len(coded)], "<u8").tobytes() + keys.tobytes() + ends.tobytes() + b"".join(t for _, t in coded)
        return next(padded for k in range(8) if pickle.dumps(padded := bytes(k) + out, pickle.HIGHEST_PROTOCOL).find(cls.MAGIC) % 8 == 0)

    @staticmethod
    def of(sent: Broadcast) -> SortedDigests:
        """Mapped from the file of a broadcast image, or over its value where Spark keeps no plain file of it."""
        path = getattr(sent, "_path", None)
        return _mapped(path) if path else SortedDigests(sent.value)

    def probe(self, strings: list[str]) -> list[str | None]:
        """The verdict stored for each string, or None."""
        out: list[str | None] = [None] * len(strings)
        if not strings or not len(self.keys):
            return out
        coded = [s.encode() for s in strings]
        digests = np.array([xxhash.xxh64_intdigest(c) for c in coded], "<u8")
        first, after = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, "right")
        for k in np.flatnonzero(first < after).tolist():
            for at in range(int(first[k]), int(after[k])):  # more than one where digests collide
                stored = self.text[int(self.ends[at]) : int(self.ends[at + 1])].tobytes()
                if stored[:-1] == coded[k]:
                    out[k] = "block" if stored[-1] else "allow"
        return out


@functools.lru_cache(maxsize=2)
def _mapped(path: str) -> SortedDigests:
    with open(path, "rb") as f:
        return SortedDigests(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


_RESULT = "host string, path string, rule string, verdict string"


def _held(pages: DataFrame) -> tuple[DataFrame, T.StructType]:
    held = pages.drop("host", "path", "rule", "verdict")
    return held, T.StructType([*held.schema.fields, *T._parse_datatype_string(_RESULT).fields])


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict of its ``url``."""
    bounded_batches(pages.sparkSession)
    entries = {f"{r.host}\0{r.path}": r.verdict for r in rules}
    host_lengths, lengths = sorted({len(r.host) for r in rules}), sorted({len(r.path) for r in rules})
    image = SortedDigests.image(entries)
    if len(image) > max_index_bytes:
        listed = pages.sparkSession.createDataFrame([(k, v) for k, v in entries.items()], "candidate string, listed string")
        return judge_urls_by_join(pages, listed, host_lengths, lengths, default)
    held, schema = _held(pages)
    sent = pages.sparkSession.sparkContext.broadcast(image)

    def run(batches):
        index = SortedDigests.of(sent)
        for batch in batches:
            split = [split_url(u) for u in batch.column(batch.schema.get_field_index("url")).to_pylist()]
            tried = [candidates(h, p, host_lengths, lengths) for h, p in split]
            found = iter(index.probe([c for each in tried for c in each]))
            rule, verdict = [], []
            for each in tried:
                hits = [(c, v) for c, v in [(c, next(found)) for c in each] if v is not None]
                rule.append(hits[0][0].replace("\0", "") if hits else None)
                verdict.append(hits[0][1] if hits else default)
            new = [[h for h, _ in split], [p for _, p in split], rule, verdict]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in new)], schema.names)

    return held.mapInArrow(run, schema)


def judge_urls_by_join(pages: DataFrame, listed: DataFrame, host_lengths: list[int], lengths: list[int], default: str = "allow") -> DataFrame:
    """The same for a list of any size: ``listed`` has (candidate, listed), candidate being host, NUL and path."""
    held, schema = _held(pages)

    def run(batches):
        for batch in batches:
            urls = batch.column(0).to_pylist()
            split = [split_url(u) for u in urls]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in split]), pa.array([p for _, p in split]), pa.array([candidates(h, p, host_lengths, lengths) for h, p in split], pa.list_(pa.string()))],
                ["url", "host", "path", "tried"],
            )

    urls = held.select(F.col("url")).where("url is not null").distinct().mapInArrow(run, "url string, host string, path string, tried array<string>")
    hits = urls.select("url", F.explode("tried").alias("candidate")).join(listed, "candidate")
    best = hits.groupBy("url").agg(F.max_by(F.struct("candidate", "listed"), F.struct(F.length("candidate"), F.instr("candidate", "\0"))).alias("b"))
    judged = urls.select("url", "host", "path").join(best, "url", "left").select(
        F.col("url").alias("__judged"), "host", "path", F.replace("b.candidate", F.lit("\0"), F.lit("")).alias("rule"), F.coalesce("b.listed", F.lit(default)).alias("verdict")
    )
    out = held.join(judged, F.col("url") == F.col("__judged"), "left").drop("__judged")
    return out.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "verdict": F.coalesce("verdict", F.lit(default))}).select(*schema.names)
