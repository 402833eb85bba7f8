"""Embedding whitening on exact integer moments.

Entries become integers x = floor(scale * c) + shift.  Moments of all vectors are taken
by digit slices: a block of vectors is cut into limbs of 20 bits, and products of limb
matrices run in float64 BLAS, where every sum of at most 2^12 products of 20-bit limbs is
an exact integer below 2^53.  Limb products are recombined as big integers, cut into
30-bit digits, and merged by one small Spark aggregate, so the moments are exact
whatever the order and the number of tasks.  The covariance of these integers is exact
too; its eigenvectors come from LAPACK and are refined in extended precision.

Only the moments (d+1 by d+1 integers for d dimensions) reach the driver; they do not
grow with the number of vectors.

Defined results: a vector that is null, or holds null or non-finite entries or an entry
whose x is no long, is dropped, and so is one of another length than most (of equally
frequent lengths, than the longest); repeated rows count and are answered one by one, a
null id stays null; components without variance (fewer vectors than dimensions, equal
vectors) have whitened null and explained 0 and are left out of identity_error, which is 0
if no component has variance; d dimensions have at most d components; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import staged

LIMB, ROWS, DIGIT = 20, 1 << 12, 30
assert ROWS << 2 * LIMB <= 1 << 53
#: The largest |x|; sums and products of such integers are exact at any size.
MOST = (1 << 62) - 1


def usable(vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> Column:
    """No null, no NaN, no infinity, and every x a long."""
    most = (MOST - shift) / scale
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) > most))
    return F.col(vector).isNotNull() & ~bad


def integers(column: pa.Array, d: int, scale: int, shift: int) -> np.ndarray:
    """x of a list column without nulls: rows by d, int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * scale).astype(np.int64) + shift).reshape(len(column), d)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 matrices L_k with x = sum of L_k << 20k: all but the last from 0 to 2^20 - 1, the last in +-2^20."""
    out = []
    while np.abs(x).max(initial=0) >> LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """x^T x in Python integers, exact for any int64 x of fewer than 2^63 in size."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    for lo in range(0, len(x), ROWS):
        cut = limbs(x[lo : lo + ROWS])
        for a, left in enumerate(cut):
            for b, right in enumerate(cut[: a + 1]):
                part = (left.T @ right).astype(np.int64).astype(object) << LIMB * (a + b)
                total += part if a == b else part + part.T
    return total


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows of y (int64, or Python integers where those do not fit)."""
    if y.dtype == object:
        return (y * y).sum(axis=1).tolist()
    total = [0] * len(y)
    cut = limbs(y)
    for a, left in enumerate(cut):
        for b, right in enumerate(cut[: a + 1]):
            # At most 2^12 columns are added up in float64 at a time.
            for lo in range(0, y.shape[1], ROWS):
                part = np.einsum("ij,ij->i", left[:, lo : lo + ROWS], right[:, lo : lo + ROWS]).astype(np.int64).tolist()
                up = LIMB * (a + b) + (a != b)
                total = [t + (p << up) for t, p in zip(total, part, strict=True)]
    return total


def moments(vectors: DataFrame, d: int, scale: int, shift: int) -> list[list[int]]:
    """The exact sums of products of (1, x): n in the corner, then S, then the products."""

    def per_task(batches):
        total = np.zeros((d + 1, d + 1), object)
        for b in batches:
            if b.num_rows:
                x = integers(b.column(0), d, scale, shift)
                total += gram(np.hstack([np.ones((len(x), 1), np.int64), x]))
        rows = []
        for i, j in zip(*np.tril_indices(d + 1), strict=True):
            v, k = total[i, j], 0
            sign, v = (-1, -v) if v < 0 else (1, v)
            while v:
                rows.append((int(i), int(j), k, sign * (v & ((1 << DIGIT) - 1))))
                v, k = v >> DIGIT, k + 1
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "k", "digit"])

    # Digits of 30 bits: sums of 2^33 tasks fit a long.
    digits = vectors.mapInArrow(per_task, "i int, j int, k int, digit long").groupBy("i", "j", "k").agg(F.sum("digit").alias("digit"))
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in digits.collect():
        out[r["i"]][r["j"]] += r["digit"] << DIGIT * r["k"]
    for i in range(d + 1):
        for j in range(i):
            out[j][i] = out[i][j]
    return out


def eigen(moment: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance, and its trace.

    The first are LAPACK's; two rounds of Ogita-Aishima refinement in extended
    precision, on the exact covariance, take them to double precision.
    """
    n, s = moment[0][0], moment[0][1:]
    d = len(s)
    high, low = np.empty((d, d)), np.empty((d, d))
    for i in range(d):
        for j in range(d):
            c = n * moment[i + 1][j + 1] - s[i] * s[j]  # n^2 times the covariance
            high[i, j] = c / (n * n)
            p, q = high[i, j].as_integer_ratio()
            low[i, j] = (c * q - p * n * n) / (n * n * q)
    trace = float(sum(n * moment[i + 1][i + 1] - s[i] ** 2 for i in range(d)) / (n * n))
    values, u = np.linalg.eigh(high)
    wide = np.longdouble
    v, u, one = high.astype(wide) + low.astype(wide), u.astype(wide), np.eye(d, dtype=wide)
    lam = values.astype(wide)
    for _ in range(2):
        r = one - u.T @ u
        m = u.T @ v @ u
        lam = np.diag(m) / (1 - np.diag(r))
        gap = lam[None, :] - lam[:, None]
        # Values closer than this cannot be told apart: their vectors are only made orthogonal.
        close = np.abs(gap) <= 2 * (np.abs(m - np.diag(lam)).max() + np.abs(lam).max() * np.abs(r).max())
        e = np.where(close, r / 2, (m + lam[None, :] * r) / np.where(close, 1, gap))
        u = u + u @ e
    order = np.argsort(-lam, kind="stable")
    u = (u / np.sqrt((u * u).sum(axis=0)))[:, order].astype(np.float64)
    return lam[order].astype(np.float64), u, trace


def whiten(embeddings: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, tag: str = "white") -> DataFrame:
    """vec_id, component, n, deviation (exact, decimal), whitened, explained, identity_error."""
    named = embeddings.select("vec_id", "embedding").where(usable("embedding", scale, shift))
    lengths = named.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("m")).where("d > 0")
    most = lengths.orderBy(F.desc("m"), F.desc("d")).first()
    schema = "vec_id long, deviation string, w array<double>"
    if most is None:
        wide, d, n, values, kept = embeddings.sparkSession.createDataFrame([], schema), 0, 0, np.zeros(0), 0
        trace = 0.0
    else:
        d = most["d"]
        named = named.where(F.size("embedding") == d)
        moment = moments(named.select(F.transform("embedding", lambda e: e.cast("double")).alias("x")), d, scale, shift)
        values, u, trace = eigen(moment)
        n, s = moment[0][0], moment[0][1:]
        kept = min(d, components)
        held = max(abs(x) for x in s) if s else 0
        least = trace * d * 1e-15
        has = [values[k] > least for k in range(kept)]
        axes = np.column_stack([u[:, k] / np.sqrt(values[k]) if has[k] else np.zeros(d) for k in range(kept)])

        def per_task(batches):
            for b in batches:
                x = integers(b.column(1), d, scale, shift)
                big = n * int(np.abs(x).max(initial=0)) + held >= 1 << 63
                y = (x.astype(object) if big else x) * n - np.array(s, object if big else np.int64)
                w = (y.astype(np.float64) / n) @ axes
                told = [[v if has[k] else None for k, v in enumerate(row)] for row in w.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(v) for v in square_sums(y)], pa.string()), pa.array(told, pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

        rows = named.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("x"))
        wide = rows.mapInArrow(per_task, schema)
    wide = staged(wide, f"{tag}-wide")
    pairs = [(a, b) for a in range(kept) for b in range(a + 1)]
    worst = 0.0
    if pairs:
        w = [F.col("w")[k] for k in range(kept)]
        got = wide.agg(*[F.covar_pop(w[a], w[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
        worst = max([abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs if has[a] and has[b]], default=0.0)
    shares = F.array(*[F.lit(float(values[k] / trace) if has[k] else 0.0) for k in range(kept)]).cast("array<double>")
    return wide.select(
        "vec_id",
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        F.posexplode("w").alias("component", "whitened"),
    ).select(
        "vec_id",
        (F.col("component") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("component")).alias("explained"),
        F.lit(float(worst)).alias("identity_error"),
    )
