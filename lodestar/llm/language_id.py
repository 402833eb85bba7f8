"""Language identification as a mixture: EM over per-language n-gram likelihoods.

Learning counts hashed character trigrams of letters (lower-cased; anything that
is no letter counts as one space) per language over a bounded sample of the
labelled rows: ``max_train_docs`` per language, taken by the hash of doc_id, so
the sample is the same in every run.  The model is languages x 2**BITS floats;
its size is checked before it is sent to the workers.

Prediction looks at the whole text only.  Its likelihood under one language, or
under a mixture whose proportions EM finds, is penalised by half the logarithm
of the trigram count for every language beyond the first, scaled by
``penalty``; the language set with the best penalised likelihood is the answer and
its largest member the predicted language.  The score is that language's proportion
in the mixture of all languages, before the penalty clears the small ones away, so
it tells a pure text from one that other languages explain in part.

Defined results: a text that is null, empty or has no letter is ``und`` with
score 0 and no languages; so is everything if nothing was learned.  Ties go to
the language first in code point order.  Rows are judged one by one, so
repeated rows and doc_ids get equal answers; extra columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import bounded_batches, frugal

BITS = 15
MAX_MODEL_BYTES = 256 << 20
ROUNDS = 12

RESULT = "lang_pred string, score double, languages array<string>, shares array<double>, fit double"


@functools.cache
def _letters() -> np.ndarray:
    """Every code point, or a space in place of those that are no letter."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Hash cells of the trigrams that have a letter in the middle; empty if there is no letter."""
    code = _letters()[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)]
    h = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS))[code[1:-1] != 32]


def learn(docs: DataFrame, max_train_docs: int = 5000) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and log-probabilities (languages x cells) from rows with doc_id, text, lang."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 1 << BITS), np.float32)
    if len(langs) * (4 << BITS) > MAX_MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages exceed the model bound of {MAX_MODEL_BYTES} bytes")
    # The share of the hash range that holds about max_train_docs rows of each language.
    cut = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, max_train_docs / sizes[k]) * (1 << 32))))])
    sample = labelled.where(F.xxhash64("doc_id").bitwiseAND((1 << 32) - 1) < cut[F.col("lang")])

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in found:
                    found[lang] = np.zeros(1 << BITS, np.int64)
                found[lang] += np.bincount(trigrams(text), minlength=1 << BITS)
        for lang, cells in found.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(cells[at])], ["lang", "cell", "n"])

    counts = sample.select("text", "lang").mapInArrow(frugal(count), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most languages x 2**BITS rows, checked above
    dense = np.full((len(langs), 1 << BITS), 0.5)
    rows = np.searchsorted(langs, table["lang"].to_pylist())
    dense[rows, table["cell"].to_numpy()] += table["n"].to_numpy()
    return langs, np.log(dense / dense.sum(1, keepdims=True)).astype(np.float32)


def _shares(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM: mixture proportions of the rows' languages and the log-likelihood they reach."""
    share, total = np.full(p.shape[1], 1.0 / p.shape[1]), c.sum()
    for _ in range(rounds):
        w = p * share
        share = (c / w.sum(1)) @ w / total
    return share, float(c @ np.log(p @ share))


def judge(text: str | None, langs: list[str], logs: np.ndarray, penalty: float):
    """(lang_pred, score, languages, shares, fit); fit: mean log-likelihood of a trigram above a uniform model."""
    cells = trigrams(text) if text and langs else ()
    if not len(cells):
        return "und", 0.0, [], [], None
    cells, c = np.unique(cells, return_counts=True)
    logp, c = logs[:, cells].astype(np.float64), c.astype(np.float64)
    alone = logp @ c
    best, per = int(alone.argmax()), penalty * 0.5 * np.log(c.sum() + 1)
    chosen, share, value = [best], np.ones(1), float(alone[best])
    every = share
    if len(langs) > 1:
        p = np.exp(logp).T
        every, most = _shares(p, c)
        if most - value > per:
            order = np.argsort(-every, kind="stable")
            for k in range(2, len(langs) + 1):
                if most - value <= per * (k - len(chosen)):
                    break  # no larger set can win any more
                some = np.sort(order[:k])
                got, reached = _shares(p[:, some], c)
                if reached - per * (k - len(chosen)) > value:
                    chosen, share, value = some.tolist(), got, reached
    rank = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
    top = chosen[rank[0]]
    return langs[top], min(1.0, float(every[top])) if len(langs) > 1 else 1.0, [langs[chosen[k]] for k in rank], [float(share[k]) for k in rank], value / float(c.sum()) + BITS * np.log(2)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0) -> DataFrame:
    """``docs`` with the columns of RESULT, which replace any of the same name."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [x.split()[0] for x in RESULT.split(", ")]
    held = docs.drop(*own)
    schema = T.StructType([*held.schema.fields, *T._parse_datatype_string(RESULT).fields])

    def run(batches):
        langs, logs = sent.value
        for batch in batches:
            out = [judge(t, langs, logs, penalty) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [*batch.schema.names, *own])

    return held.mapInArrow(frugal(run), schema)
