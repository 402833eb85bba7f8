"""Substring dedup by sliding sentence spans.

A text is cut into sentences (a run up to and with ``.``, ``!``, ``?`` or a line
feed), and sentences of ``EDGE_WORDS`` words or more at words that their hashes
choose, so that passages glued to other words are cut alike; parts without a word
belong to no span, and no part has more than ``EDGE_WORDS`` words.  From every part
a span runs over the following ones until it has ``MIN_WORDS`` words, and to every
part one runs over those before it in the same way, so a repeated run of any length
is covered from its first part to its last; a text too short for any of these is
one span as a whole.  Every span is hashed (97 bits, A-Z lower-cased, white space
collapsed), spans are counted over the whole corpus, and of each repeated span
every occurrence but the first (smallest doc_id, then text hash, then position) is
removed: the parts that a removed span covers go, the rest of the text stays as it
is.

Spans are hashed once, into a table; only those that repeat are ever joined.  They
are counted and their first occurrences found by aggregates that combine before the
shuffle, and the occurrences of a span that holds a large share of all are dealt
over many tasks by salts and never gathered.

Defined results: a null text stays null and an empty one empty; a row without
doc_id stays as it is; exact copies of
a document with a word but the first end up empty, their rows stay; identical rows that
share doc_id and text count as one document and stay, different texts under one
doc_id are documents of their own; extra columns pass through unchanged, but for
n_removed, which is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import bounded_batches, drop, frugal, hot_keys, mixed, salted_join, signed, staged

#: Of a repeated passage up to 2 * EDGE_WORDS - 1 words at its ends may be cut differently;
#: with MIN_WORDS more, that is 50, so a longer passage always holds a whole span.
EDGE_WORDS, MIN_WORDS = 13, 25

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_PLACE_BITS = 31
_WINDOWS = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``parts`` with the end offsets always."""
    return parts(text, True)


def parts(text: str, placed: bool = False) -> tuple[np.ndarray | None, np.ndarray, list[bytes]]:
    """End offsets (code points) of the parts with words, their word counts and their normal forms.

    A part is a sentence, or a piece of one that ``_inner_cuts`` takes apart; the form
    of a piece that its sentence goes on after ends in a space.  A sentence without
    words is joined to the part before it (or after it, at the start).  The offsets are
    None unless ``placed``.
    """
    found, at = [], 0
    for piece in _PIECE.findall(text):
        start, at = at, at + len(piece)
        words = piece.encode().lower().split()
        if words and any(w.strip(b".!?") for w in words):
            found.append([start, at, piece, words])
        elif found:
            found[-1][1] = at
    cuts = _inner_cuts([words for _, _, _, words in found])
    ends, counts, forms = [], [], []
    for (start, end, piece, words), inner in zip(found, cuts, strict=True):
        since = 0
        if inner:
            if placed:
                after = [m.end() for m in _WORD.finditer(piece)]
                ends += [start + after[c] for c in inner]
            for c in inner:
                counts.append(c + 1 - since)
                forms.append(b" ".join(words[since : c + 1]) + b" ")
                since = c + 1
            words = words[since:]
        ends.append(end)
        counts.append(len(words))
        forms.append(b" ".join(words))
    return np.array(ends, np.int64) if placed else None, np.array(counts, np.int64), forms


def _inner_cuts(found: list[list[bytes]]) -> list[list[int]]:
    """For every sentence, the words after which it is cut.

    Of every ``EDGE_WORDS`` words in a row that lie in one sentence, the one with the
    smallest hash (the last of several) is such a word.  Where words repeat, all
    these choices repeat but those in the first and last ``EDGE_WORDS`` of them.
    """
    out: list[list[int]] = [[] for _ in found]
    some = [k for k, words in enumerate(found) if len(words) >= EDGE_WORDS]
    if not some:
        return out
    h = np.array([xxhash.xxh3_64_intdigest(w) for k in some for w in found[k]], np.uint64)
    sizes = np.array([len(found[k]) for k in some])
    owner, starts = np.repeat(np.arange(len(some)), sizes), np.cumsum(sizes) - sizes
    seen = np.lib.stride_tricks.sliding_window_view(h[::-1], EDGE_WORDS)[::-1]  # each window from its last word
    inside = np.flatnonzero(owner[: len(h) - EDGE_WORDS + 1] == owner[EDGE_WORDS - 1 :])
    chosen = np.zeros(len(h), bool)
    for part in np.split(inside, range(_WINDOWS, len(inside), _WINDOWS)):
        chosen[part + EDGE_WORDS - 1 - seen[part].argmin(1)] = True
    chosen[starts + sizes - 1] = False
    at = np.flatnonzero(chosen)
    for k, c in zip(owner[at].tolist(), (at - starts[owner[at]]).tolist(), strict=True):
        out[some[k]].append(c)
    return out


def spans(counts: np.ndarray, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first part, part after the last and two hashes of every span.

    The place is the first part, doubled, for a shortest run forwards, and the last
    one, doubled and odd, for all others.  Which of both a run is depends on its own
    parts alone, so places of equal spans are in the order of the text.
    """
    n = len(forms)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    upto = np.concatenate(([0], np.cumsum(counts)))
    until = np.searchsorted(upto, upto[:-1] + MIN_WORDS)
    since = np.searchsorted(upto, upto[1:] - MIN_WORDS, "right") - 1
    ahead = np.flatnonzero(until <= n)
    # A run that is the shortest from either end is taken once.
    back = np.flatnonzero(since >= 0)
    back = back[until[since[back]] != back + 1]
    place = np.concatenate((ahead << 1, back << 1 | 1))
    first = np.concatenate((ahead, since[back]))
    after = np.concatenate((until[ahead], back + 1))
    if not len(place):  # too short for any run: the whole text is its only span
        place, first, after = np.array([1]), np.array([0]), np.array([n])
    h = np.fromiter((xxhash.xxh3_64_intdigest(f) for f in forms), np.uint64, n)
    up, down = _powers(_ODD, n), _powers(_INVERSE, n)
    out = []
    for x in (h, mixed(h + np.uint64(1))):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[:-1])))
        out.append(mixed((total[after] - total[first]) * down[first] + (after - first).astype(np.uint64)))
    return place, first, after, out[0], out[1]


def _occurrences(batches):
    kinds = [("doc_id", pa.int64()), ("tie", pa.int64()), ("h", pa.int64()), ("low", pa.int64())]

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, (_, k) in zip(rows, kinds, strict=True)], [c for c, _ in kinds])

    rows, held = ([], [], [], []), 0
    for batch in batches:
        for doc, tie, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            place, _, _, hi, lo = spans(*parts(text)[1:])
            if not len(place):
                continue
            top = np.uint64(_PLACE_BITS)
            for c, v in zip(rows, (np.full(len(place), doc), np.full(len(place), tie), signed(hi), signed((lo >> top << top) | place.astype(np.uint64))), strict=True):
                c.append(v)
            held += len(place)
            if held > 200_000:
                yield out()
                rows, held = ([], [], [], []), 0
    if held:
        yield out()


def text_key():
    """Tells apart texts that share a doc_id."""
    return F.xxhash64("text")


def dedup_spans(docs: DataFrame, tag: str = "spans") -> DataFrame:
    """``docs`` with the repeated spans taken out of ``text``, and n_removed: how many parts of it went."""
    bounded_batches(docs.sparkSession)
    key = ["h", "hash2"]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tie"), "text").where("doc_id is not null and text <> ''")
    every = staged(read.mapInArrow(frugal(_occurrences), "doc_id long, tie long, h long, low long"), f"{tag}-spans")
    hashed = [F.col("h"), F.shiftright("low", _PLACE_BITS).alias("hash2")]
    occ = every.select(*hashed, "doc_id", "tie", F.col("low").bitwiseAND((1 << _PLACE_BITS) - 1).alias("at"))
    repeated = staged(occ.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1"), f"{tag}-repeated")
    hot = hot_keys(repeated, key)
    draw = F.xxhash64("doc_id", "tie", "at")
    some = staged(salted_join(occ, repeated.select(*key), key, hot, draw, "left_semi"), f"{tag}-some")
    drop(every)
    firsts = staged(some.groupBy(*key).agg(F.min(F.struct("doc_id", "tie", "at")).alias("f")), f"{tag}-firsts")
    later = salted_join(some, firsts, key, hot, draw).where(F.struct("doc_id", "tie", "at") != F.col("f"))
    gone = staged(later.groupBy("doc_id", "tie").agg(F.collect_set("at").alias("places")), f"{tag}-gone")
    for done in (some, firsts, repeated):
        drop(done)
    return _applied(docs, gone)


def _applied(docs: DataFrame, gone: DataFrame) -> DataFrame:
    gone = gone.select(F.col("doc_id").alias("__span_doc"), F.col("tie").alias("__span_tie"), F.col("places").alias("__span_places"))
    here = (F.col("doc_id").cast("long") == F.col("__span_doc")) & (text_key() == F.col("__span_tie"))
    return docs.drop("n_removed").join(gone, here, "left").drop("__span_doc", "__span_tie").mapInArrow(frugal(_rewritten), _schema(docs))


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name != "n_removed"] + [T.StructField("n_removed", T.LongType())])


def _rewritten(batches):
    for batch in batches:
        names = batch.schema.names
        texts, by = batch.column(names.index("text")).to_pylist(), batch.column(names.index("__span_places")).to_pylist()
        gone = [0] * len(texts)
        for k, (text, places) in enumerate(zip(texts, by, strict=True)):
            if places:
                texts[k], gone[k] = without(text, places)
        kept = [c for c in names if c != "__span_places"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(names.index(c)) for c in kept] + [pa.array(gone, pa.int64())], [*kept, "n_removed"])


def without(text: str, places: list[int]) -> tuple[str, int]:
    """The text without the parts of the spans at ``places``, and how many those were."""
    ends, counts, forms = sentences(text)
    place, first, after, _, _ = spans(counts, forms)
    held = {p: (a, b) for p, a, b in zip(place.tolist(), first.tolist(), after.tolist(), strict=True)}
    edge = np.zeros(len(ends) + 1, np.int64)
    for p in places:
        edge[held[p][0]] += 1
        edge[held[p][1]] -= 1
    out = (np.cumsum(edge[:-1]) > 0).tolist()
    starts = [0, *ends[:-1].tolist()]
    return "".join(text[a:b] for a, b, o in zip(starts, ends.tolist(), out, strict=True) if not o), sum(out)
