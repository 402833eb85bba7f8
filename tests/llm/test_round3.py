"""Whitening, prefix trie and line dedup against brute force on small tables, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, prefix_trie, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 11 --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, n string, component int, d int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "clash", 0, 0) for k, v in rows], VECTORS)


def exact(x):
    """n, S and the covariance times n^2, in Python integers."""
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [1, 2**21, 2**45, 2**61])
def test_gram_is_exact(size):
    r = random.Random(size)
    x = [[r.randrange(-size, size + 1) for _ in range(5)] for _ in range(37)]
    got = whitening.gram(np.array(x, np.int64))
    assert all(got[i, j] == sum(a[i] * a[j] for a in x) for i in range(5) for j in range(5))
    assert whitening.square_sums(np.array(x, np.int64)) == whitening.square_sums(np.array(x, object)) == [sum(v * v for v in a) for a in x]


def test_gram_over_many_rows():
    x = np.full((3 * whitening.ROWS + 5, 2), (1 << 20) - 1, np.int64)
    assert whitening.gram(x)[0, 1] == len(x) * ((1 << 20) - 1) ** 2


def test_whitening(spark):
    r = random.Random(5)
    good = [(k, [r.gauss(0, 3 - i / 4) + (i == 2) * 100 for i in range(10)]) for k in range(300)] + [(7, [0.5] * 10), (None, [60.0] * 10)]
    bad = [(900, None), (901, [math.nan] * 10), (902, [math.inf] + [0.0] * 9), (903, [None] * 10), (904, [1.0] * 4), (905, []), (906, [1e30] * 10)]
    rows = whitening.whiten(vectors(spark, good + bad).repartition(3)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, s, cov = exact(x)
    assert len(rows) == 8 * len(good) and {q["n"] for q in rows} == {n}
    by = collections.defaultdict(list)
    for q in rows:
        by[q["vec_id"]].append(q)
    e, u = np.linalg.eigh(np.array([[c / n**2 for c in row] for row in cov]))
    for (k, _), v in zip(good, x, strict=True):
        want = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        assert int(want) in {int(q["deviation"]) for q in by[k]}
        if k not in (7, None):
            for q in by[k]:
                c = -q["component"]
                y = np.array([(n * a - b) / n for a, b in zip(v, s, strict=True)]) @ u[:, c] / math.sqrt(e[c])
                assert abs(abs(y) - abs(q["whitened"])) < 1e-8 and abs(q["explained"] - e[c] / e.sum()) < 1e-12
    assert {q["identity_error"] for q in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_eigenvectors_to_double_precision():
    """Two eigenvalues a hair apart: LAPACK alone is off by far more."""
    import fractions

    moment = [[2, 0, 0], [0, 2 * 10**15 + 2, 1], [0, 1, 2 * 10**15]]
    values, u, trace = whitening.eigen(moment)
    a, b, c = fractions.Fraction(10**15 + 1), fractions.Fraction(1, 2), fractions.Fraction(10**15)
    lead = (a - c) / 2 + fractions.Fraction(math.sqrt(((a - c) / 2) ** 2 + b**2))
    want = np.array([float(lead), 0.5]) / math.hypot(float(lead), 0.5)
    assert values[0] >= values[1] and np.abs(np.abs(u[:, 0]) - want).max() < 1e-4 and trace == float(a + c)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)], [(k, [float(k)]) for k in range(5)]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whiten(vectors(spark, rows)).collect()
    usable = [v for _, v in rows if v]
    assert len(got) == sum(map(len, usable))
    for q in got:
        flat = len({tuple(v) for v in usable}) == 1
        assert (q["whitened"] is None) == flat and (q["deviation"] == 0) == (flat or usable[q["vec_id"]] == [2.0]) and q["identity_error"] < 1e-12


def test_deviation_as_a_long(spark, tmp_path):
    """Beyond a long, the query's deviation is null and deviation_exact still whole."""
    spark.createDataFrame([(k, [k * 1e8, 0.0]) for k in range(40)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op11_whitening(spark, str(tmp_path)).where("component = 1").collect()
    x = [math.floor(1024 * k * 1e8) for k in range(40)]
    for q in rows:
        want = (40 * x[q["vec_id"]] - sum(x)) ** 2
        assert int(q["deviation_exact"]) == want and q["deviation"] == (want if want < 1 << 63 else None)


# 12 --------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, node long"


def nodes_of(rows):
    conv = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, role or "", text or ""))
    conv = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    whole = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = conv.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        if k:
            kids[k[:-1]].append(k)
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(whole[c]) == len(k)))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], digest(k)) for k, m in members.items()), key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, **size):
    turns = spark.createDataFrame([(*r, 0, 0) for r in rows], TURNS)
    return sorted((tuple(q) for q in prefix_trie.conversation_trie(turns).select(*COLUMNS).collect()), key=str)


def conversations(kind):
    r = random.Random(kind)
    if kind == "shared":  # few different turns, so that prefixes meet in many ways
        return [(c, t, r.choice(["user", "bot"]), r.choice(["a", "b c"])) for c in range(60) for t in range(r.randrange(6))]
    if kind == "awkward":  # nulls, ties, repeated rows, negative ids, missing heads, turnless when rebuilt
        texts = [None, "", "x  y\tz", "x y z", " ", "é"]
        rows = [(r.choice([None, -41, -3, 0, 1, 5, 19, 20, 33, 47, 61, 62, 63]), r.choice([None, 0, 0, 3]), r.choice([None, "user"]), r.choice(texts)) for _ in range(60)]
        return rows + rows[:9] + [(c, None, None, None) for c in range(100, 120)]
    if kind == "copies":  # one long conversation in many copies, and one that leaves it late
        long = [f"turn {k}" for k in range(30)]
        return [(c, t, "user", x) for c in range(0, 400, 20) for t, x in enumerate(long)] + [(401, t, "user", x) for t, x in enumerate([*long[:7], "other", "end"])]
    return []


@pytest.mark.parametrize("kind", ["shared", "awkward", "copies", "empty"])
def test_trie(spark, kind):
    rows = conversations(kind)
    assert trie_of(spark, rows) == nodes_of(rows)


def test_trie_over_cut_runs(spark, monkeypatch):
    """Blocks and pieces of three: sums and digests are put together from many parts."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = conversations("copies")
    assert trie_of(spark, rows) == nodes_of(rows)


def test_copies_leave_the_levels(spark, monkeypatch):
    """Thirty equal turns are no thirty levels."""
    tags = []
    monkeypatch.setattr(prefix_trie, "staged", lambda df, tag, f=prefix_trie.staged: tags.append(tag) or f(df, tag))
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 20) for t in range(30)]
    assert trie_of(spark, rows) == nodes_of(rows) and tags.count("trie-level") == 1


def test_one_conversation_over_many_parts(spark):
    rows = [(20, t // 3 if t % 5 else None, "user", f"{t % 7}") for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    try:
        got = [(q["pos"], q["t1"]) for q in prefix_trie.numbered(turns).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[3]))
    told = {q["text"]: q["t1"] for q in turns.select("text", F.xxhash64("role", "text").alias("t1")).distinct().collect()}
    assert got == [(k + 1, told[x[3]]) for k, x in enumerate(want)]


# 13 --------------------------------------------------------------------------


def lines_kept(texts, min_docs, min_chars):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(strip).translate(lower) for x in (t or "").split("\n")] for t in texts]
    held = collections.Counter(k for row in keys for k in set(row) if len(k) >= max(1, min_chars))
    out = []
    for t, row in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), row, strict=True) if held[k] < min_docs]
        out.append((len(row), len(row) - len(kept), "\n".join(kept)))
    return out


def texts_of(seed):
    r = random.Random(seed)
    pool = ["Same Line", " same line\t", "SAME LINE", "Ünder", "ünder", "", "  ", "x", "é" * 9, "rare\r", "a" * 5000]
    texts = [None, "", "\n", "\n\n\n", "x\nx\nx", " \x0b\x0c\r "] + ["\n".join(r.choice(pool) + (str(r.randrange(40)) if r.random() < 0.5 else "") for _ in range(r.randrange(12))) for _ in range(70)]
    return texts + texts[10:14] * 5


@pytest.mark.parametrize(("min_docs", "min_chars", "batches", "fanout"), [(10, 1, 4, 2), (1, 0, 3, 2), (5, 3, 7, 3), (1000, 1, 1, 2)])
def test_line_dedup(spark, min_docs, min_chars, batches, fanout):
    texts = texts_of(3)
    docs = spark.createDataFrame([(k % 50 or None, k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, k long, text string, n_lines string, __lost int").repartition(5)
    got = line_dedup.drop_common_lines(docs.drop("__lost").withColumn("lost", F.lit("clash")), min_docs, min_chars, batches, fanout).collect()
    assert [(q["n_lines"], q["n_dropped"], q["text"]) for q in sorted(got, key=lambda q: q["k"])] == lines_kept(texts, min_docs, min_chars)


def test_line_dedup_of_an_empty_table(spark):
    out = line_dedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_lines", "n_dropped"]


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    texts = texts_of(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = line_dedup.drop_common_lines(docs).orderBy("k").collect()
    assert [(q["n_lines"], q["n_dropped"], q["text"]) for q in got] == lines_kept(texts, 10, 1)


def test_runs_are_levelled(spark):
    """Eight batches at fanout 2 end as one run; a common line is counted no further; runs are sorted."""
    runs = line_dedup.LineRuns(min_docs=3, fanout=2)
    for k in range(8):
        batch = spark.createDataFrame([(1, 1, 2), (2, k, 1), (3, 3, 1)], "h1 long, h2 long, n long")
        runs.add(batch)
        assert len(runs.runs()) == bin(k + 1).count("1")
    rows = {(q["h1"], q["h2"]): q["n"] for q in runs.common().collect()}
    assert set(rows) == {(1, 1), (3, 3)} and rows[1, 1] < 16 and [tuple(q)[:2] for q in runs.runs()[0].collect()] == sorted({(1, 1), (3, 3)} | {(2, k) for k in range(8)})


def test_line_dedup_uses_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup.drop_common_lines(docs, 1)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


# results that do not change or fail with size or shape --------------------------


def test_urls_of_many_labels(spark):
    """A host of 100,000 labels needs no more than the strings a rule could have."""
    import tracemalloc

    from lodestar.llm import url_filter

    host = ".".join(["a"] * 100_000) + ".example.com"
    tracemalloc.start()
    got = url_filter.candidates(host, "/en/x", [3, 11, 14], [1, 4])
    assert got == ["example.com\0/en/", "example.com\0/", "com\0/en/", "com\0/"] and tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    rules = [url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "com", "/")]
    for limit in (1 << 20, 0):
        row = url_filter.judge_urls(spark.createDataFrame([(1, f"http://{host}/en/x")], "page_id int, url string"), rules, max_index_bytes=limit).first()
        assert (row["host"], row["rule"], row["verdict"]) == (host, "example.com/en/", "block")


@pytest.mark.parametrize("n", [20, 6000])
def test_the_row_without_doc_id_is_a_neighbour(spark, n):
    """It comes last, whatever the number of ranges; rows that share a doc_id stand by text."""
    from lodestar.llm import fingerprints

    ids = [None, None, *range(n), 5, 5]
    texts = [f"text {k} of {i} " * 3 for k, i in enumerate(ids)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    rows = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    got = [(q["doc_id"], q["edited_sha256"]) for q in fingerprints.edited_fingerprints(docs).select("doc_id", "edited_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def licenses(text):
    from lodestar.llm import license_scan

    ready = [license_scan.Template(k, v) for k, v in license_scan.TEMPLATES.items()]
    return {x["license"]: x for x in license_scan.scan(text, ready)[4]}


@pytest.mark.parametrize("between", [0, 3, 13, 500, 15_000])
def test_scattered_words_are_no_license(between):
    """The words of a template count while at least half of all words from the first to the last are its own."""
    from lodestar.llm import license_scan

    for name in ("MIT", "MIT-text"):
        words = license_scan.words_of(license_scan.TEMPLATES[name])
        cut = len(words) // 2
        got = licenses(" ".join(["so"] * 30 + words[:cut] + [f"q{k % 9}" for k in range(between)] + words[cut:] + ["and"] * 30))
        assert (got.get(name, {}).get("coverage") == 1.0) == (between <= len(words))
    album = "The album was released " + "x " * between + "under " + "x " * between + "the " + "x " * between + "license plate"
    assert bool(licenses(album)) == (between == 0)


def test_license_among_its_own_words():
    """A whole text is found between broken copies of it and stray words of it."""
    from lodestar.llm import license_scan

    r = random.Random(2)
    words = license_scan.words_of(license_scan.TEMPLATES["MIT-text"])
    for _ in range(20):
        stray = [r.choice(words) for _ in range(400)]
        broken = [w for w in words if r.random() > 0.4]
        got = licenses(" ".join(stray[:200] + broken + stray[200:] + words + broken + stray))
        first = 400 + len(broken)
        assert got["MIT-text"]["coverage"] == 1.0 and abs(got["MIT-text"]["first_word"] - first) <= 20


def test_recurring_words_take_linear_time():
    import time

    def took(n):
        text = " ".join(w for w in ("released", "under", "the", "license") for _ in range(n))
        start = time.perf_counter()
        assert not licenses(text)
        return time.perf_counter() - start

    took(1000)
    assert took(16_000) < 12 * max(took(4_000), 0.05)


@pytest.mark.parametrize(("sizes", "shares"), [([(1, 100_000), (1_000_000, 100)], [1.9999, 1e-4]), ([(10, 50), (50_000, 2)], [1.9999999])])
def test_mixing_near_the_cap(spark, sizes, shares):
    """A target just under twice the source's size, and one just over nothing: rates meet them however far lambda lies."""
    from lodestar.llm import mixing

    counts = spark.createDataFrame([((s,), k, n) for s in "ab" for k, n in sizes], "of struct<source: string>, size long, n long")
    whole = sum(k * n for k, n in sizes)
    for share in shares:
        by = spark.createDataFrame([(("a",), whole, share * whole), (("b",), whole, 0.7 * whole)], "of struct<source: string>, source_size long, target double")
        state = {q["of"]["source"]: q for q in mixing.balanced(counts, by, 2.0).collect()}
        for s, target in (("a", share * whole), ("b", 0.7 * whole)):
            q = state[s]
            reached = sum(k * n * (2.0 if q["full"] else min(2.0, math.exp(min(700, q["lam"] * k / q["mean"])))) for k, n in sizes)
            assert abs(reached - target) <= 1e-6 * target


@pytest.mark.parametrize("least", [0, 28])
def test_links_across_components(spark, monkeypatch, least):
    """A bucket that many sets of one component and a few of others share: every link is found, and few pairs are looked at."""
    from lodestar.llm import ngram_join

    monkeypatch.setattr(ngram_join, "MOST_FILTER_BITS", least)  # 0: the join in place of the filter
    r = random.Random(12)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for k in range(60):
        words = list(base)
        words[r.randrange(20, 40)] = f"e{k}"
        texts.append(words)
    for k in range(12):  # of other sizes, with the same rare words in front
        texts.append([f"w{j}" for j in range(4)] + [f"z{k}x{j}" for j in range(r.choice([3, 30, 90]))])
    texts += [texts[-1] + ["more"], texts[60] + ["x"], ["w0", "w1"], ["w0", "w1"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 4]) for i in range(max(1, len(t) - 3))} for t in texts]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    got = {q["doc_id"]: q["component_id"] for q in ngram_join.jaccard_groups(docs, words=4, percent=80).collect()}
    assert [got[k] for k in range(len(texts))] == comp


def test_the_filter_grows_with_what_is_wanted():
    from lodestar.llm import ngram_join

    assert [ngram_join.filter_bits(n) for n in (0, 10, 10_000, 1_000_000, 60_000_000)] == [16, 16, 18, 24, 28] and ngram_join.filter_bits(70_000_000) is None


@pytest.mark.parametrize("at_once", [1, 1 << 17])
def test_shingles_of_many_texts_at_once(monkeypatch, at_once):
    """Words as split() finds them and A-Z alone lower-cased, wherever a text lies among others and however long a word is."""
    from lodestar.llm import shared

    monkeypatch.setattr(shared, "AT_ONCE", at_once)
    r = random.Random(5)
    some = ["a", "A", "ab", "ba", "Ärger", "ärger", " ", "\x1c", "\x00", "\x00\x00", "é" * 4, *["x" * k for k in (7, 8, 9, 15, 16, 17, 63, 64, 65, 400)], "x" * 64 + "y", "x" * 8 + "y" + "x" * 7]
    texts = [None, "", " \n", "one", "ONE two", "one\ttwo\x0bthree\x0cfour\rfive", *["".join(r.choice(some) + r.choice([" ", "\n", " \t"]) for _ in range(r.randrange(40))) for _ in range(200)], None, "end"]
    texts = [t.encode() if t is not None else None for t in texts]
    got = list(shared.shingle_hashes(texts, 4))
    assert len(got) == len(texts)
    of = {}
    for t, s in zip(texts, got, strict=True):
        w = (t or b"").lower().split()
        want = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        assert len(s) == len(want) and (s[1:] > s[:-1]).all() and s.dtype == np.uint64
        assert of.setdefault(frozenset(want), s.tobytes()) == s.tobytes()
    assert len(set(of.values())) == len(of)
    one = list(shared.shingle_hashes([t for t in texts for t in (t, b"other words")], 4))[::2]
    assert all((x == y).all() for x, y in zip(got, one, strict=True))


def test_sets_cost_little_more_than_splitting():
    """Many different words, as in any large corpus: no Python step for each, so hashing costs a few times the splitting at most."""
    import time

    import pyarrow as pa

    from lodestar.llm import ngram_join

    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(1_000_000)}" for _ in range(500)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    split = least(lambda: [t.encode().lower().split() for t in texts])
    assert least(lambda: list(ngram_join._sets(iter([batch]), 4))) < 4 * split
