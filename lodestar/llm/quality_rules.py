"""Quality rules: a learned decision list over text statistics, all in Spark expressions.

``statistics`` measures whole texts with built-in functions.  ``learn`` grows an
ordered list of threshold conjunctions by sequential covering: a rule is grown
on two thirds of the labelled rows by information gain, pruned on the last
third, and kept if it is precise there; the rows it covers are then set aside
and the next rule is grown.  ``verdict`` is the list as one conditional
expression.  Only the labelled statistics of at most ``max_labelled`` rows (in
expectation, chosen by hash) reach the driver; nothing runs in Python workers.

Defined results: a null or empty text has zero words and fails the base rule;
without labels, or with labels of one class, no rule is learned and the base
rule decides; a document with several labels counts as the worst of them; repeated
rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import WORD_SPACE, staged

POSITION_BITS = 20
FEATURES = ["n_words", "word_chars_x100", "symbols_permille", "upper_permille", "dup_lines_permille", "repeat_permille", "distinct_permille"]
THRESHOLDS = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
MIN_PRECISION, MIN_COVERED = 0.95, 5


def _covered(places: str) -> Column:
    """How many words the 3-word windows at these ascending places cover."""
    three = F.lit(3).cast("long")
    spans = F.transform(places, lambda p, i: F.least(three, F.coalesce(F.get(places, i + 1) - F.get(places, i), three)))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)


def _repeats(df: DataFrame, hash_bits: int) -> DataFrame:
    """Adds n_repeat_words, from ``words``: windows sorted by hash with their place packed in; equal neighbours repeat.

    Equal hashes are confirmed on the words.  Where two windows only share a hash,
    or a text has more words than places fit, its windows are sorted as strings.
    """
    place_mask = (1 << POSITION_BITS) - 1
    hash_mask = -(1 << max(64 - hash_bits, POSITION_BITS))
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))

    def word(i: Column) -> Column:
        return F.get("words", i.cast("int"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(place_mask))

    def same_hash(x: Column, y: Column) -> Column:
        return x.bitwiseAND(F.lit(hash_mask)) == y.bitwiseAND(F.lit(hash_mask))

    def other_words(x: Column, y: Column) -> Column:
        return reduce(lambda a, b: a | b, [word(place(x) + k) != word(place(y) + k) for k in range(3)])

    packed = F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.lit(hash_mask)).bitwiseOR(i.cast("long")))
    df = df.withColumn("packed", F.when(n.between(4, place_mask), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("twice", F.filter("packed", lambda x, i: same_hash(x, F.get("packed", i - 1)) | same_hash(x, F.get("packed", i + 1))))
    df = df.withColumn(
        "by_string",
        (n > place_mask) | F.exists(F.sequence(F.lit(1), F.greatest(F.size("twice") - 1, F.lit(1))), lambda i: same_hash(F.get("twice", i - 1), F.get("twice", i)) & other_words(F.get("twice", i - 1), F.get("twice", i))),
    )
    strings = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.cast("long").alias("p"))))
    df = df.withColumn("strings", F.when(F.coalesce("by_string", F.lit(False)), strings))
    exact = F.filter("strings", lambda x, i: (x["w"] == F.get("strings", i - 1)["w"]) | (x["w"] == F.get("strings", i + 1)["w"]))
    df = df.withColumn("places", F.sort_array(F.when(F.col("strings").isNotNull(), F.transform(exact, lambda x: x["p"])).otherwise(F.transform("twice", place))))
    return df.withColumn("n_repeat_words", _covered("places"))


def statistics(docs: DataFrame, hash_bits: int = 44) -> DataFrame:
    """doc_id, the base statistics and FEATURES of every row."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("words", F.array_remove(F.split("text", WORD_SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _repeats(df.withColumn("lines", lines), hash_bits)
    long = lambda c: c.cast("long")
    df = df.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_repeat_words",
        long(F.size("lines")).alias("n_lines"),
        long(F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))).alias("n_upper"),
        long(F.size(F.array_distinct("words"))).alias("n_distinct"),
    )
    some, lines_or_one, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest("word_chars", F.lit(1))
    ratio = lambda a, b, by=1000: F.floor(F.lit(by) * F.col(a) / b)
    return df.select(
        "*",
        ratio("word_chars", some, 100).alias("word_chars_x100"),
        ratio("n_symbols", some).alias("symbols_permille"),
        ratio("n_upper", chars).alias("upper_permille"),
        ratio("n_dup_lines", lines_or_one).alias("dup_lines_permille"),
        ratio("n_repeat_words", some).alias("repeat_permille"),
        ratio("n_distinct", some).alias("distinct_permille"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, int]


def learn(stats: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[list[Condition]]:
    """Ordered rules that reject: conjunctions of (feature, ">=" or "<=", threshold), from labels (doc_id, quality)."""
    known = stats.join(labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    total = known.count()
    draw = F.xxhash64("doc_id", F.lit("rules")).bitwiseAND((1 << 32) - 1)
    sample = known.where(draw < int(min(1.0, max_labelled / max(total, 1)) * (1 << 32)))
    rows = sample.select(*FEATURES, (F.col("quality") == 0).alias("bad"), (draw % 3 == 0).alias("prune")).collect()
    return cover([[r[f] for f in FEATURES] for r in rows], [r["bad"] for r in rows], [r["prune"] for r in rows])


def cover(values: list[list[int]], bad: list[bool], held: list[bool]) -> list[list[Condition]]:
    """Sequential covering; sets of rows are bits of an integer."""
    bits = lambda flags: int("".join("1" if f else "0" for f in reversed(flags)) or "0", 2)
    wrong, prune = bits(bad), bits(held)
    every = (1 << len(values)) - 1
    right, grow = every & ~wrong, every & ~prune
    conditions: list[tuple[Condition, int]] = []
    for k, name in enumerate(FEATURES):
        ranked = sorted(v[k] for v in values)
        cuts = sorted({ranked[(len(ranked) - 1) * j // THRESHOLDS] for j in range(THRESHOLDS + 1)} | {x for j in (1, 2, 3, 5, 10, 20) for x in ranked[-1 - len(ranked) * j // 100 :][:1]}) if ranked else []
        for cut in cuts:
            conditions.append(((name, ">=", cut), bits([v[k] >= cut for v in values])))
            conditions.append(((name, "<=", cut), bits([v[k] <= cut for v in values])))
    rules, left = [], every
    purity = lambda p, n: math.log2(p / (p + n)) if p else -1e9
    while len(rules) < MAX_RULES:
        inside, rule = left & grow, []
        while len(rule) < MAX_CONDITIONS:
            p, n = (inside & wrong).bit_count(), (inside & right).bit_count()
            if not p or not n:
                break
            best, gain = None, 1e-9
            for condition, holds in conditions:
                x = inside & holds
                q = (x & wrong).bit_count()
                if q >= MIN_COVERED and (g := q * (purity(q, (x & right).bit_count()) - purity(p, n))) > gain:
                    best, gain = (condition, holds), g
            if not best:
                break
            rule.append(best)
            inside &= best[1]
        options = []
        for k in range(1, len(rule) + 1):
            x = reduce(lambda a, b: a & b[1], rule[:k], left & prune)
            p, n = (x & wrong).bit_count(), (x & right).bit_count()
            options.append(((p - n) / max(p + n, 1), p, -k))
        if not options:
            break
        worth, p, k = max(options)
        rule = rule[:-k]
        covered = reduce(lambda a, b: a & b[1], rule, left)
        if p < MIN_COVERED // 2 or (worth + 1) / 2 < MIN_PRECISION or (covered & wrong).bit_count() < MIN_PRECISION * covered.bit_count():
            break
        rules.append([c for c, _ in rule])
        left &= ~covered
    return rules


def described(rule: list[Condition]) -> str:
    return " and ".join(f"{name} {sign} {cut}" for name, sign, cut in rule)


def verdict(rules: list[list[Condition]]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = reduce(lambda a, b: a & b, [F.col(c) >= t if sign == ">=" else F.col(c) <= t for c, sign, t in rule])
        out = F.when(holds, F.lit(described(rule))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, tag: str = "quality") -> DataFrame:
    """The statistics of every row with base_failed, rule (the rejecting rule or null) and kept."""
    stats = staged(statistics(docs), tag)
    rule = verdict(learn(stats, labels, max_labelled))
    return stats.select("*", base_failed().alias("base_failed"), rule.alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
