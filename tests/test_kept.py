"""What is stored and kept up by change, against the same made anew; and SQL table functions."""

import math
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import compare, tables
from lodestar.operators import call_graph, graph, registers, store, trigrams, vectors
from lodestar.operators.tables import Tables
from lodestar.operators.vector_index import VectorIndex


@pytest.fixture
def home(tmp_path):
    return "file://" + str(tmp_path / "home")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- vectors -----------------------------------------------------------------


def recall(docs, index, k=10, **options):
    asked = docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = {(r[0], r[1]) for r in vectors.neighbours(docs, asked, k).select("query_id", "id").collect()}
    got = {(r[0], r[1]) for r in index.search(asked, k, **options).select("query_id", "id").collect()}
    return len(got & want) / len(want)


def test_vector_index(spark, home):
    """Recall of at least 0.9 while at most a tenth of the vectors is read for a query; also after an upsert and a delete."""
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, home)
    index.build(docs.unionByName(spark.createDataFrame([(-1, None), (-2, [])], docs.schema)))
    assert docs.count() == 500 and recall(docs, index, candidates=50) >= 0.9
    parts = Tables(spark, home).manifest()["tables"]["codes"]["parts"]
    turned = docs.where("id % 9 = 1").withColumn("embedding", F.reverse("embedding"))
    index.put(turned)
    gone = docs.where("id % 11 = 2").select("id")
    index.delete(gone)
    now = docs.where("id % 9 <> 1").unionByName(turned).join(gone, "id", "left_anti")
    assert recall(now, index, candidates=50) >= 0.9 and rows(Tables(spark, home).read("vectors"), "id") == rows(now, "id")
    one = docs.where("id = 5")
    before = Tables(spark, home).manifest()["tables"]["codes"]["parts"]
    index.put(one)
    after = Tables(spark, home).manifest()["tables"]["codes"]["parts"]
    assert len(parts) > 10 and sum(before.get(p) != after.get(p) for p in {*before, *after}) <= 2, "an upsert rewrites the cells it touches"
    top = index.search(one.select(F.lit(-9).cast("long").alias("query_id"), "embedding"), 1).first()
    assert (top["id"], top["score"], top["place"]) == (5, 1.0, 1)


# --- substrings --------------------------------------------------------------


def test_substring_index(spark, home):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abAB_%éЯ1") for _ in range(r.randrange(7)))
    data = [(k, word(), r.choice([None, word()])) for k in range(200)]
    table = spark.createDataFrame(data, "id long, name string, synonym string")
    index = trigrams.SubstringIndex(spark, home)
    index.build(table, ["name", "synonym"])
    for query in ["ab", "a", "abA", "AB é", "a_a", "%", "a%b 1", "zzz ab", "zz zy", "_", "ЯЯ", "bab abb aab"]:
        assert rows(index.search(table, query, limit=None), "id", "rank") == rows(store.token_search(table, query, limit=None), "id", "rank"), query
    assert index.search(table, " ").count() == 0
    plan = index.postings(["aba", "bab"])._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan or "gram IN" in plan
    assert len(index.postings(["aba"]).inputFiles()) < len(Tables(spark, home).read("postings").inputFiles())


# --- call graph --------------------------------------------------------------


def test_call_graph_by_change(spark, home):
    """After any sequence of changes the kept edges are those of a full build."""
    r = random.Random(8)
    kept, state = call_graph.CallGraph(spark, home), {}
    assert kept.edges().count() == 0
    for _ in range(5):
        touched = {f"m{r.randrange(6)}" for _ in range(r.randrange(1, 4))}
        for m in touched:
            if r.random() < 0.25:
                state.pop(m, None)
                continue
            names = r.sample(["Ab", "aB", "c", "d", "e"], r.randrange(4))
            state[m] = ([(m, n, f"{m}::{n}") for n in names], [(m, f"{m}::{r.choice(names)}", r.choice(["AB", "c", "D", "e", "x"]), k) for k in range(4) if names])
        make = lambda i, mods, schema: spark.createDataFrame([x for m in mods if m in state for x in state[m][i]], schema)
        kept.refresh(spark.createDataFrame([(m,) for m in touched], "module string"), make(0, touched, call_graph.PROCEDURE), make(1, touched, call_graph.CALL), parts=7)
        full = graph.resolve_calls(make(1, state, call_graph.CALL), make(0, state, call_graph.PROCEDURE))
        assert rows(kept.edges(), "caller", "callee", "line") == rows(full, "caller", "callee", "line")


# --- totals ------------------------------------------------------------------


def test_stored_totals(spark, home):
    r = random.Random(6)
    totals = registers.StoredTotals(spark, home, ["k"], ["q"])
    with pytest.raises(ValueError, match="no movements"):
        totals.balance(dt.datetime(2024, 1, 1))
    every = []
    for batch in range(4):
        some = [(dt.datetime(r.choice([2023, 2024]), r.randrange(1, 13), r.randrange(1, 28), r.randrange(24)), r.choice(["Receipt", "Expense"]), r.choice("abc"), r.randrange(9)) for _ in range(r.randrange(1, 9))]
        moves = spark.createDataFrame(some, "period timestamp, kind string, k string, q long")
        for _ in range(2):
            totals.add(moves, "w", batch)
        every += some
        whole = spark.createDataFrame(every, moves.schema)
        for at in (dt.datetime(2022, 5, 5), dt.datetime(2023, 6, 15), min(every)[0], max(every)[0], dt.datetime(2024, 1, 1), dt.datetime(2030, 1, 1)):
            assert rows(totals.balance(at)) == rows(registers.balance(whole, ["k"], ["q"], at=at))
    read = {f.split("/home/")[1].split("/__part=")[1][:7] for f in totals.balance(dt.datetime(2024, 1, 20)).inputFiles()}
    assert len(read) == 1, "one month is read"


# --- modules compared --------------------------------------------------------


def test_line_changes_rebuild_the_new_text():
    r = random.Random(9)
    for _ in range(300):
        old, new = ([r.choice("abcd") for _ in range(r.randrange(14))] for _ in range(2))
        script = compare.line_changes(old, new)
        gone, come = {x for c, x, _, _ in script if c == "removed"}, {y: t for c, _, y, t in script if c == "added"}
        kept = iter(x for k, x in enumerate(old, 1) if k not in gone)
        assert [come[k] if k in come else next(kept) for k in range(1, len(new) + 1)] == new and not list(kept)
        row = [0] * (len(new) + 1)
        for x in old:
            last = 0
            for j, y in enumerate(new):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert len(script) == len(old) + len(new) - 2 * row[-1], "no shorter script"


def test_modules_compared(spark):
    make = lambda *r: spark.createDataFrame(list(r), "path string, content string")
    a = "Процедура А()\n\tБ();\nКонецПроцедуры\n"
    b = "Функция Б() Экспорт\n\tВозврат 1;\nКонецФункции\n"
    found = compare.procedures(make(("m", a + b), ("gone", a), ("null", None)), make(("m", b + a.replace("Б();", "Б();\n\tВ();")), ("new", b)))
    assert rows(found, "path", "name", "status") == [("gone", "А", "removed"), ("m", "А", "changed"), ("m", "Б", "same"), ("new", "Б", "added")]
    assert rows(compare.changed_lines(found)) == [("m", "А", "added", None, 6, "\tВ();")]
    assert rows(compare.summary(found)) == [("gone", 0, 1, 0, 0), ("m", 0, 0, 1, 1), ("new", 1, 0, 0, 0)]


# --- SQL ---------------------------------------------------------------------


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("m", "Процедура А(Знач Б = 1) Экспорт\n\tВ(Б);\nКонецПроцедуры"), ("null", None)], "path string, content string").createOrReplaceTempView("kept_modules")
    got = spark.sql("SELECT path, p.name, p.is_export, p.parameters[0].name AS first FROM kept_modules, LATERAL code_rows(content, 'procedures') p").collect()
    assert [tuple(q) for q in got] == [("m", "А", True, "Б")]
    for kind in ("calls", "references", "queries", "variables", "complexity", "issues"):
        spark.sql(f"SELECT p.* FROM kept_modules, LATERAL code_rows(content, '{kind}') p").collect()
    with pytest.raises(Exception, match="second argument"):
        spark.sql("SELECT * FROM code_rows('x', 'nothing')").collect()
    assert [tuple(q) for q in spark.sql("SELECT * FROM text_chunks('abcdef', 4, 1)").collect()] == [(0, 2, 0, "abcd"), (1, 2, 3, "def")]


def test_totals_are_kept_per_year(spark, home):
    """Totals of every month would repeat every key for each later month."""
    totals = registers.StoredTotals(spark, home, ["k"], ["q"])
    some = [(dt.datetime(2021 + m // 12, 1 + m % 12, 5), "Receipt", "a", 1) for m in range(36)]
    schema = "period timestamp, kind string, k string, q long"
    totals.add(spark.createDataFrame(some[30:], schema))
    totals.add(spark.createDataFrame(some[:6], schema))
    totals.add(spark.createDataFrame(some[6:30], schema))
    assert totals.tables.read("totals").count() == 3
    for m in range(36):
        assert [tuple(r) for r in totals.balance(some[m][0] + dt.timedelta(days=1)).collect()] == [("a", m + 1)]


def test_exact_search_of_an_index_finds_what_codes_miss(spark, home):
    """Vectors whose codes are all alike: the ten nearest are told by the exact score only."""
    base = [1.0] + [0.0] * 31
    rows = [(k, [*base[:-2], 0.001 * k, 0.5]) for k in range(400)] + [(1000 + k, [0.0] * (k % 32) + [1.0] + [0.0] * (31 - k % 32)) for k in range(64)]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = VectorIndex(spark, home)
    index.build(docs, cells=4, pieces=2, max_sample=40)
    asked = docs.where("id in (3, 200, 399)").select(F.col("id").alias("query_id"), "embedding")
    want = {(r["query_id"], r["id"], r["place"]) for r in vectors.neighbours(docs, asked, 10).collect()}
    got = {(r["query_id"], r["id"], r["place"]) for r in index.search(asked, 10, 12, probes=1.0, exact=True).collect()}
    assert got == want and len(want) == 30


def test_blocks_of_both_sides_give_the_same(spark, monkeypatch):
    """However small blocks and slices are; ties of the rounded score go by id."""
    r = random.Random(4)
    rows = [(k, [float(r.randrange(-2, 3)) for _ in range(r.choice([3, 3, 4]))]) for k in range(300)]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = docs.where("id % 7 = 0").select(F.col("id").alias("query_id"), "embedding")
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6) + 0.0
    want = []
    for q, v in rows[::7]:
        best = sorted((-cos(v, w), k) for k, w in rows if k != q and len(v) == len(w))[:5]
        want += [(q, k, p + 1) for p, (_, k) in enumerate(best)]
    for block, part in ((16384, 1 << 21), (20, 100), (7, 1)):
        monkeypatch.setattr(vectors, "DOC_BLOCK", block)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "SLICE", part)
        assert sorted((x["query_id"], x["id"], x["place"]) for x in vectors.neighbours(docs, asked, 5).collect()) == sorted(want)
