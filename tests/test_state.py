"""Commits of several tables, streams with state, and the source of file changes."""

import datetime as dt
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, index, store
from lodestar.operators.tables import Change, Conflict, Tables
from lodestar.streaming import changes, stateful, tree_source

NAMES = ["edges", "embeddings", "files", "nodes", "objects"]


@pytest.fixture
def home(tmp_path):
    return "file://" + str(tmp_path / "home")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- commits -----------------------------------------------------------------


def test_tables_change_together(spark, home):
    tables = Tables(spark, home)
    assert tables.versions() == [] and tables.read("a") is None and tables.begin().commit() == 0

    def both(change):
        change.write("a", spark.range(3))
        change.write("b", spark.range(2))

    assert tables.transact(both) == 1
    old = tables.read("a")
    assert tables.transact(lambda c: c.write("a", c.read("a").where("id > 0"))) == 2
    assert tables.transact(lambda c: c.drop("b")) == 3
    assert rows(old) == [(0,), (1,), (2,)], "a reader of the version before finishes"
    assert rows(tables.read("a")) == [(1,), (2,)] and tables.read("b") is None and rows(tables.read("b", version=2)) == [(0,), (1,)]


def test_nothing_is_seen_before_the_commit(spark, home):
    tables = Tables(spark, home)
    change = tables.begin()
    change.write("a", spark.range(3))
    assert tables.read("a") is None and change.commit() == 1 and tables.read("a").count() == 3


def test_conflicts(spark, home):
    tables = Tables(spark, home)
    by = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("a b/=%", 4)], "k string, v int")
    tables.transact(lambda c: c.write_parts("t", by, "k"))
    assert sorted(tables.manifest()["tables"]["t"]["parts"]) == ["a b/=%", "null", "x", "y"] and rows(tables.read("t")) == rows(by) and rows(tables.read("t", ["a b/=%", "y"])) == [("a b/=%", 4), ("y", 2)]
    one, two, three, other = (tables.begin() for _ in range(4))
    one.write_parts("t", spark.createDataFrame([("x", 10)], by.schema), "k")
    two.write_parts("t", spark.createDataFrame([("y", 20)], by.schema), "k", emptied=["null"])
    three.write_parts("t", three.read("t", ["x"]), "k")
    other.write("u", other.read("t", ["x", "y"]))
    assert one.commit() == 2 and two.commit() == 3, "writers of different parts do not disturb each other"
    for stale in (three, other):
        with pytest.raises(Conflict):
            stale.commit()
    assert rows(tables.read("t")) == [("a b/=%", 4), ("x", 10), ("y", 20)] and tables.read("u") is None


def test_two_writers_lose_no_count(spark, home):
    calls = spark.createDataFrame([("a", "b", "calls", "f", 1, 0), ("a", "b", "calls", "f", 2, 0)], "source string, target string, edge_type string, file string, line int, column int")
    put = lambda *w: index.save_code_graph(graph.collapse_edges(calls), graph.edge_locations(calls), home, *w)
    threads = [threading.Thread(target=put) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.current(spark, f"{home}/code_edges").first()["count"] == 8 and store.current(spark, f"{home}/code_locations").count() == 2
    for batch in (0, 1, 1, 0):
        put("job", batch)
    assert store.current(spark, f"{home}/code_edges").first()["count"] == 12, "a batch of one writer counts once"


def catalog(k, kind="xs:decimal"):
    text = f'<MetaDataObject xmlns:v8="http://v8.1c.ru/8.1/data/core"><Catalog><Properties><Name>P{k}</Name></Properties><ChildObjects><Attribute><Properties><Name>A</Name><Type><v8:Type>{kind}</v8:Type></Type></Properties></Attribute></ChildObjects></Catalog></MetaDataObject>'
    return (f"file:/c/Catalogs/P{k}.xml", text.encode())


def state(spark, home):
    tables = Tables(spark, home)
    return {n: None if (t := tables.read(n)) is None else rows(t.select(*(["id"] if n in ("nodes", "embeddings") else ["source", "target"] if n == "edges" else ["name"] if n == "objects" else ["path", "file_hash"]))) for n in NAMES}


def test_refresh_survives_a_stop_anywhere(spark, tmp_path, home, monkeypatch):
    """Stopped at each of its five writes, and at the commit: all tables as before; repeated: as after."""
    files = lambda *r: spark.createDataFrame(list(r), "path string, content binary")
    first, second = files(catalog(1), catalog(2)), files(catalog(2, "xs:string"), catalog(3))
    index.refresh(first, home)
    before = state(spark, home)
    for fails_at in range(6):
        calls = []
        with monkeypatch.context() as m:
            def write(self, name, *rest, calls=calls, fails_at=fails_at, go=Change.write_parts, **more):
                calls.append(name)
                if len(calls) == fails_at + 1:
                    raise OSError("stopped")
                go(self, name, *rest, **more)

            def put(*_):
                raise OSError("stopped")

            m.setattr(Change, "write_parts", write)
            if fails_at == 5:
                m.setattr(Tables, "_put", put)
            with pytest.raises(OSError, match="stopped"):
                index.refresh(second, home)
        assert len(calls) == min(fails_at + 1, 5) and state(spark, home) == before
    assert {r["status"]: r["n"] for r in index.refresh(second, home).collect()} == {"added": 1, "changed": 1, "removed": 1}
    assert {r["status"]: r["n"] for r in index.refresh(second, home).collect()} == {"same": 2}
    clean = "file://" + str(tmp_path / "clean")
    index.refresh(second, clean)
    assert state(spark, home) == state(spark, clean) and [r[0] for r in state(spark, home)["nodes"]] == ["Catalog.P2", "Catalog.P3"]


def test_a_small_change_rewrites_few_parts(spark, home):
    files = lambda *r: spark.createDataFrame(list(r), "path string, content binary")
    many = [catalog(k) for k in range(40)]
    index.refresh(files(*many), home, parts=64)
    before = Tables(spark, home).manifest()["tables"]
    index.refresh(files(*many[:39], catalog(39, "xs:string")), home)
    after = Tables(spark, home).manifest()["tables"]
    assert all(sum(before[n]["parts"][p] != after[n]["parts"].get(p) for p in before[n]["parts"]) == 1 and len(before[n]["parts"]) > 20 for n in NAMES if n != "edges")
    assert {r["type"] for r in store.current(spark, f"{home}/objects").where("name = 'P39'").select(F.explode("attributes").alias("a")).select("a.type").collect()} == {"string"}


def test_vacuum(spark, home, tmp_path):
    tables = Tables(spark, home)
    for n in (1, 2, 3):
        tables.transact(lambda c, n=n: c.write("a", spark.range(n)))
    tables.transact(lambda c: c.write("b", spark.range(1)))
    lost = tables.begin()
    lost.write("a", spark.range(9))  # never committed
    assert tables.vacuum(3600) == 0 and tables.versions() == [1, 2, 3, 4]
    time.sleep(1.1)
    assert tables.vacuum(0.5) == 3 and tables.versions() == [4]
    assert tables.read("a").count() == 3 and tables.read("b").count() == 1 and len(list((tmp_path / "home" / "a").iterdir())) == 1
    with pytest.raises(FileNotFoundError):
        tables.read("a", version=1)


def test_buckets_change_at_one_moment(spark, home):
    path = f"{home}/table"
    data = lambda *r: spark.createDataFrame(list(r), "k int, v string, seq int")
    store.upsert_buckets(data(*[(k, "a", 1) for k in range(50)]), path, ["k"], "seq", 8)
    old = store.bucketed(spark, path)
    store.upsert_buckets(data((7, "b", 2), (7, "c", 3), (99, "d", 1)), path, ["k"], "seq", 64)
    now = {r["k"]: r["v"] for r in store.bucketed(spark, path).collect()}
    assert len(now) == 51 and now[7] == "c" and now[99] == "d" and old.count() == 50
    assert len(Tables(spark, home).manifest()["tables"]["table"]["parts"]) == 8, "the first write's number of buckets holds"
    store.upsert_buckets(data((7, "late", 2)), path, ["k"], "seq", writer="w", batch=4)
    store.upsert_buckets(data((7, "again", 9)), path, ["k"], "seq", writer="w", batch=4)
    assert {r["v"] for r in store.bucketed(spark, path).where("k = 7").collect()} == {"c"}
    store.clear(spark, path, old.schema)
    assert store.current(spark, path).count() == 0


# --- small operators ---------------------------------------------------------


def test_graph_puts_and_merges(spark):
    nodes = lambda *r: spark.createDataFrame(list(r), "id string, name string")
    a, b = nodes(("1", "a"), ("2", "a")), nodes(("2", "b"), ("3", "b"))
    assert rows(graph.merge_nodes(a, b)) == [("1", "a"), ("2", "a"), ("3", "b")] and rows(graph.put_nodes(a, b)) == [("1", "a"), ("2", "b"), ("3", "b")]


def test_audit_sink(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events = [("look", dt.datetime(2024, 1, 1, 23)), ("look", dt.datetime(2024, 1, 2, 1))]
    spark.createDataFrame(events, "tool string, ts timestamp").write.parquet(source)
    for _ in range(2):  # a repeated start appends nothing
        changes.append_audit(spark.readStream.schema("tool string, ts timestamp").parquet(source), sink, str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(sink).select("tool", F.col("day").cast("string"))) == [("look", "2024-01-01"), ("look", "2024-01-02")]


# --- streams with state ------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, folder, events, batches):
    """The events dealt over batches at random, then one far event that lets every timer ring."""
    r = random.Random(3)
    r.shuffle(events)
    for k in range(batches):
        spark.createDataFrame(events[k::batches], "key string, ts timestamp, id long, kind string").coalesce(1).write.parquet(f"{folder}/{k}")
    spark.createDataFrame([("end", T0 + dt.timedelta(days=9999), -1, "end")], "key string, ts timestamp, id long, kind string").coalesce(1).write.parquet(f"{folder}/{batches}")
    return spark.readStream.schema("key string, ts timestamp, id long, kind string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("batches", [1, 4])
def test_streams_give_the_batch_answers(spark, tmp_path, batches):
    r = random.Random(batches)
    events = [(r.choice("abc"), T0 + dt.timedelta(seconds=r.randrange(400), microseconds=r.choice([0, 0, 1, 999_999])), k, r.choice(["put", "ask"])) for k in range(90)]
    batch = spark.createDataFrame(events, "key string, ts timestamp, id long, kind string")
    put = F.col("kind") == "put"
    made = 0

    def got(make):
        nonlocal made
        made += 1
        with stateful.rocksdb(spark):
            return changes.drained(make(stream_of(spark, str(tmp_path / f"in{made}"), list(events), batches)), "append")

    hits = got(lambda s: stateful.cached(s, put, 20, late="9 days"))
    want = store.cached(batch.where(~put), batch.where(put).select("key", "ts"), 20)
    assert rows(hits.where("key <> 'end'").select(F.col("id").cast("long"), "hit")) == rows(want, "id", "hit")
    recent = got(lambda s: stateful.recent_calls(s, 30, late="9 days"))
    assert rows(recent.where("key <> 'end'").select(F.col("id").cast("long"), "recent")) == rows(changes.rate_in_window(batch, 30, "key"), "id", "recent")
    flags = {int(q["id"]): q["allowed"] for q in got(lambda s: stateful.limited(s, 2, 30, late="9 days")).collect()}
    for key in "abc":
        taken = []
        for _, ts, k, _ in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], str(e[2]))):
            taken = [t for t in taken if t > ts - dt.timedelta(seconds=30)]
            assert flags[k] == (len(taken) < 2)
            taken += [ts] if flags[k] else []
    runs = got(lambda s: stateful.bursts(s, 5, "key", "ts", "kind", late="9 days"))
    want = changes.debounced(batch.withColumnRenamed("key", "path").withColumnRenamed("kind", "change_type"), "5 seconds")
    assert rows(runs.where("path <> 'end'"), "path", "last", "n") == rows(want, "path", "last", "n")


# --- file changes ------------------------------------------------------------


def test_tree_changes_as_a_stream(spark, tmp_path):
    tree, out = tmp_path / "tree", tmp_path / "out"
    for name in ("a/b/c/one.xml", "a/b/two.xml", "a/skip.txt", "top.xml", "z/three.xml"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("1")
    spark.dataSource.register(tree_source.TreeChanges)
    seen = 0

    def batch():
        nonlocal seen
        stream = spark.readStream.format("tree_changes").options(path=str(tree), log=str(tmp_path / "log")).load()
        run = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        run.awaitTermination()
        got = rows(spark.read.schema(tree_source.SCHEMA).parquet(str(out)).select("path", "change_type"))
        fresh, seen = len(got) - seen, len(got)
        return got, fresh

    at = lambda n, kind: (str(tree / n), kind)
    first = [at(n, "created") for n in ("a/b/c/one.xml", "a/b/two.xml", "top.xml", "z/three.xml")]
    assert batch() == (sorted(first), 4)
    (tree / "a/b/c/one.xml").write_text("longer")
    (tree / "top.xml").unlink()
    (tree / "z/three.xml").unlink()
    (tree / "z").rmdir()
    (tree / "new").mkdir()
    (tree / "new/four.mdo").write_text("")
    second = [at("a/b/c/one.xml", "modified"), at("top.xml", "deleted"), at("z/three.xml", "deleted"), at("new/four.mdo", "created")]
    assert batch() == (sorted(first + second), 4) and batch()[1] == 0


def test_a_repeated_read_gives_the_same_rows(tmp_path):
    tree = tmp_path / "tree"
    (tree / "a").mkdir(parents=True)
    (tree / "a/x.xml").write_text("1")
    reader = tree_source.TreeReader({"path": str(tree), "log": str(tmp_path / "log"), "depth": "1", "partitions": "1"})
    end = reader.latestOffset()
    shards = reader.partitions(reader.initialOffset(), end)
    told = lambda: sorted(r for s in shards for b in reader.read(s) for r in zip(*(c.to_pylist() for c in b.columns)))  # noqa: B905, E731
    once = told()
    (tree / "a/y.xml").write_text("1")  # between two attempts of one batch
    os.utime(tree / "a/x.xml", (1, 1))
    again = tree_source.TreeReader({"path": str(tree), "log": str(tmp_path / "log"), "depth": "1", "partitions": "1"})
    shards = again.partitions(again.initialOffset(), end)
    assert told() == once and [r[:2] for r in once] == [(str(tree / "a/x.xml"), "created")]
    later = again.latestOffset()
    shards = again.partitions(end, later)
    assert sorted(r[1] for r in told()) == ["created", "modified"]
    again.commit(later)
    assert [n for n in os.listdir(tmp_path / "log") if n.isdigit()] == [str(later["listing"])]
