"""Streams, state, the index job, collections and the rest of the scalar functions as queries with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import collections, platform, text
from lodestar.operators import graph, index, store, vectors
from lodestar.queries_trees import PART, _say, catalogs
from lodestar.registry import query
from lodestar.session import table
from lodestar.staging import adopted, shared_dir
from lodestar.streaming import changes

# --- streams -----------------------------------------------------------------


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _cents(windows: DataFrame) -> DataFrame:
    return windows.withColumn("total", F.round("total", 4))


_TUMBLING = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(_TUMBLING)
def window_tumbling(spark, d):
    return _cents(changes.tumbling(table(spark, d, "events"), "1 hour", ["event_type"]))


@query(_TUMBLING)
def stream_tumbling(spark, d):
    """The same from a drained stream."""
    return _cents(changes.drained(changes.tumbling(event_stream(spark, d), "1 hour", ["event_type"])))


_SLIDING = """WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, value FROM events, (VALUES (0), (1)) v(k))
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"""


@query(_SLIDING)
def stream_sliding(spark, d):
    return _cents(changes.drained(changes.sliding(event_stream(spark, d), "1 hour", "30 minutes", ["event_type"])))


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query(_SESSIONS + " SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session")
def stream_sessions(spark, d):
    return _cents(changes.drained(changes.sessions(event_stream(spark, d), "6 hours", ["user_id"])))


@query(_SESSIONS + " SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, ts) AS change_type, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session")
def debounced_changes(spark, d):
    """The last change of each burst."""
    found = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_type").alias("change_type"))
    return changes.debounced(found, "6 hours")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark, d):
    return changes.drained(changes.once(event_stream(spark, d), ["user_id", "event_type"], "3650 days"), "append").select("user_id", "event_type")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_in_window(spark, d):
    return changes.rate_in_window(table(spark, d, "events"), 21_600, "user_id").select("event_id", "recent")


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start, event_type, n FROM w WHERE n > 1")
def restart_storms(spark, d):
    """Windows with more than one start of a kind."""
    return changes.tumbling(table(spark, d, "events"), "1 hour", ["event_type"]).where("n > 1").select("start", "event_type", "n")


@query("SELECT event_type AS key, count(*) AS calls FROM events GROUP BY event_type")
def stream_rate_limit(spark, d):
    """Every call is answered once; the counts tell that none is lost (the answers are held against brute force in the tests)."""
    limited = changes.drained(changes.allowed(event_stream(spark, d), 5, 3600.0, "event_type"), "append")
    return limited.groupBy("key").agg(F.count("*").alias("calls"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert(spark, d):
    """Micro-batches merged into buckets of their keys: the last event of every user."""
    home = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    put = changes.upsert_batches(f"{home}/table", ["user_id"], "event_id", 8)
    run = event_stream(spark, d).select("user_id", "event_id", "event_type").writeStream.foreachBatch(put).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    put(table(spark, d, "events").where("event_id % 2 = 0").select("user_id", "event_id", "event_type"), 1)  # delivered again
    return adopted(store.bucketed(spark, f"{home}/table"), home)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Catalog' WHEN 1 THEN 'CommonModule' END AS metadata_type, CASE WHEN p_partkey % 3 < 2 THEN 'Obj' || p_partkey END AS object_name FROM part")
def located_changes(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, _say("file:/c/Catalogs/Obj", k, "/Ext/ObjectModule.bsl")).when(k % 3 == 1, _say("file:/c/CommonModules/Obj", k, ".xml")).otherwise(_say("file:/c/Other/Obj", k))
    return changes.located(table(spark, d, "part").select("p_partkey", path.alias("path"))).drop("path")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 = 3")
def ignored_changes(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, _say("/c/.git/x", k)).when(k % 4 == 1, _say("/c/a/b", k, ".tmp")).when(k % 4 == 2, _say("/c/build/deep/er/", k, ".xml")).otherwise(_say("/c/src/git/", k, ".xml"))
    return changes.kept(table(spark, d, "part").select("p_partkey", path.alias("path")), [".git/**", "*.tmp", "build/**/*.xml"]).select("p_partkey")


@query("SELECT '/o/' || o_orderkey AS path, CASE o_orderkey % 10 WHEN 0 THEN 'created' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change_type FROM orders WHERE o_orderkey % 10 < 3")
def changed_files(spark, d):
    """Two listings compared: created, modified and deleted files."""
    files = table(spark, d, "orders").select(_say("/o/", F.col("o_orderkey")).alias("path"), F.col("o_orderdate").alias("modificationTime"), F.col("o_custkey").alias("length"), "o_orderkey")
    now = files.where("o_orderkey % 10 <> 1").withColumn("length", F.when(F.col("o_orderkey") % 10 == 2, F.col("length") + 1).otherwise(F.col("length")))
    return changes.changed_files(now.drop("o_orderkey"), files.where("o_orderkey % 10 <> 0").drop("o_orderkey"))


# --- the index job -----------------------------------------------------------


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Two refreshes: at first all catalogs but those of k % 4 = 0, then all but k % 5 = 0, with those of k % 3 = 0 changed."""
    home = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    k = F.regexp_extract("path", r"Part(\d+)\.", 1).cast("long")
    files = catalogs(spark, d)
    changed = F.when(k % 3 == 0, F.replace(F.col("content").cast("string"), F.lit("xs:decimal"), F.lit("xs:string")).cast("binary")).otherwise(F.col("content"))
    index.refresh(files.where(k % 4 != 0), home)
    return index.refresh(files.withColumn("content", changed).where(k % 5 != 0), home), home


@query(
    """SELECT CASE WHEN p_partkey % 5 = 0 THEN 'removed' WHEN p_partkey % 4 = 0 THEN 'added' WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 4 = 0) GROUP BY 1"""
)
def index_refresh(spark, d):
    counts, home = _indexed(spark, d)
    adopted(store.current(spark, f"{home}/objects"), home)
    return counts


@query(f"SELECT {PART} AS name, CASE WHEN p_partkey % 3 = 0 THEN 'string' ELSE 'decimal' END AS type FROM part WHERE p_partkey % 5 <> 0")
def index_objects(spark, d):
    _, home = _indexed(spark, d)
    return adopted(store.current(spark, f"{home}/objects"), home).select("name", F.get("attributes", 0)["type"].alias("type"))


@query(
    f"""SELECT 'node' AS kind, 'Catalog.' || {PART} AS id, 1 AS n FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'embedding', 'Catalog.' || {PART}, 1 FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'edge', 'Catalog.' || {PART}, 3 FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT kind, 'Catalog.' || {PART} || '.Form.' || form, 1 FROM (SELECT p_partkey, unnest(['ФормаЭлемента', 'Форма' || p_partkey % 4]) AS form FROM part WHERE p_partkey % 5 <> 0), (VALUES ('node'), ('edge')) v(kind)"""
)
def index_cascade(spark, d):
    """Nodes, edges and embeddings follow the objects they come from."""
    _, home = _indexed(spark, d)
    nodes = adopted(store.current(spark, f"{home}/nodes"), home).select(F.lit("node").alias("kind"), "id")
    rest = [store.current(spark, f"{home}/{t}").select(F.lit(k).alias("kind"), F.col(c).alias("id")) for t, k, c in (("embeddings", "embedding", "id"), ("edges", "edge", "source"))]
    return nodes.unionByName(rest[0]).unionByName(rest[1]).groupBy("kind", "id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'known' AS relationship FROM nation WHERE n_nationkey % 2 = 0")
def graph_save_and_load(spark, d):
    """Edges of unknown kinds are passed over when a graph is read back; repeated ones are stored once."""
    home = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    k = F.col("n_nationkey")
    edges = table(spark, d, "nation").select(k.cast("long").alias("edge_seq"), _say("n", k).alias("source"), _say("r", F.col("n_regionkey")).alias("target"), F.when(k % 2 == 0, "known").otherwise("unknown").alias("relationship"), F.lit("").alias("label"))
    index.save_graph(edges.select(F.col("source").alias("id")), edges.unionByName(edges), home)
    index.save_graph(edges.select(F.col("source").alias("id")), edges.unionByName(edges), home)
    _, found = index.load_graph(spark, home, ["known"])
    return adopted(found, home).select("source", "target", "relationship")


@query("SELECT 'Order.' || l_orderkey AS source, 'Part.' || l_partkey AS target, 'calls' AS edge_type, CAST(2 * count(*) AS BIGINT) AS count, count(DISTINCT l_linenumber) AS places FROM lineitem GROUP BY ALL")
def code_graph_save(spark, d):
    """A code graph saved twice: counts add up, locations are replaced."""
    home = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}"
    calls = table(spark, d, "lineitem").select(_say("Order.", F.col("l_orderkey")).alias("source"), _say("Part.", F.col("l_partkey")).alias("target"), F.lit("calls").alias("edge_type"), F.lit("f").alias("file"), F.col("l_linenumber").alias("line"), F.lit(0).alias("column"))
    for _ in range(2):
        index.save_code_graph(graph.collapse_edges(calls), graph.edge_locations(calls), home)
    key = ["source", "target", "edge_type"]
    places = store.current(spark, f"{home}/code_locations").groupBy(*key).agg(F.count("*").alias("places"))
    return adopted(store.current(spark, f"{home}/code_edges"), home).join(places, key)


# --- vectors -----------------------------------------------------------------


@query("SELECT vec_id AS id, label, CASE WHEN vec_id % 10 <> 3 THEN embedding[len(embedding)] ELSE embedding[1] END AS first FROM embeddings WHERE vec_id % 10 <> 3 OR vec_id % 2 = 1")
def vector_put(spark, d):
    """Upsert by id, the new embedding in place of the old one; documents without an embedding are left out."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    empty = F.array().cast("array<float>")
    fresh = e.withColumn("embedding", F.when(F.col("id") % 10 == 3, empty).otherwise(F.reverse("embedding")))
    return vectors.put(e.where("id % 10 <> 3 or id % 2 = 1").where("id % 3 = 0"), fresh.where("id % 10 <> 3").unionByName(e.where("id % 10 = 3 and id % 2 = 1"))).select("id", "label", F.get("embedding", 0).alias("first"))


@query("SELECT vec_id AS id, CAST(len(embedding) AS INT) AS dims, embedding[1] AS first FROM embeddings")
def vector_rebuild(spark, d):
    home = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    vectors.rebuild(e.where("id % 2 = 0").withColumn("embedding", F.reverse("embedding")), f"{home}/documents")
    vectors.rebuild(e, f"{home}/documents")
    return adopted(store.current(spark, f"{home}/documents"), home).select("id", F.size("embedding").alias("dims"), F.get("embedding", 0).alias("first"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 11")
def vector_get(spark, d):
    return vectors.get(table(spark, d, "embeddings"), 11, "vec_id").select("vec_id", "label")


@query("SELECT c_name AS id FROM customer WHERE starts_with(c_name, 'Customer#00000000') OR starts_with(c_name, 'Customer#00000001')")
def vector_existing_ids(spark, d):
    return vectors.existing_ids(table(spark, d, "customer").select(F.col("c_name").alias("id")), ["Customer#00000000", "Customer#00000001"])


# --- chunks ------------------------------------------------------------------


@query(
    """WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents),
cut(doc_id, x, n, i, a, b) AS (
  SELECT doc_id, x, n, 0, 0, CASE WHEN n <= 2000 THEN n ELSE (SELECT CASE WHEN strpos(reverse(substr(x, 1801, 200)), chr(10)) > 0 THEN 2000 - strpos(reverse(substr(x, 1801, 200)), chr(10)) + 1 ELSE 2000 END) END FROM t WHERE n > 0
  UNION ALL
  SELECT doc_id, x, n, i + 1, s, CASE WHEN s + 2000 >= n THEN n WHEN strpos(reverse(substr(x, s + 1801, 200)), chr(10)) > 0 THEN s + 2000 - strpos(reverse(substr(x, s + 1801, 200)), chr(10)) + 1 ELSE s + 2000 END
  FROM (SELECT *, CASE WHEN 300 < b - a THEN greatest(b - 300, a + 1) ELSE b END AS s FROM cut WHERE b < n))
SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS chunk_total, CAST(a AS INT) AS start, CAST(b - a AS INT) AS n_chars FROM cut"""
)
def chunk_sizes(spark, d):
    return text.chunks(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "chunk_index", "chunk_total", "start", F.length("chunk").alias("n_chars"))


# --- collections -------------------------------------------------------------


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


@query("SELECT row_number() OVER (ORDER BY n_regionkey DESC, n_name) - 1 AS \"row\", n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def value_table_sort(spark, d):
    return collections.sort(_values(spark, d), "region УБЫВ, name")


@query("SELECT row_number() OVER (ORDER BY min(n_nationkey)) - 1 AS \"row\", CAST(n_regionkey AS BIGINT) AS region, CAST(sum(n_nationkey) AS BIGINT) AS k FROM nation GROUP BY n_regionkey")
def value_table_group_by(spark, d):
    return collections.group_by(_values(spark, d).withColumn("k", F.col("row")), "region", "k")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT * FROM (SELECT n_name FROM nation WHERE n_regionkey = 3 ORDER BY n_nationkey LIMIT 1)")
def value_table_find(spark, d):
    held = _values(spark, d)
    return collections.find_rows(held, {"region": 2}).select("name").unionByName(collections.find(held, 3, "region").select("name"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS \"row\", n_name AS name FROM nation WHERE n_regionkey = 1")
def value_table_copy(spark, d):
    return collections.copy(_values(spark, d), {"region": 1}, "name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS \"row\", n_name || '!' AS name, CAST(7 AS BIGINT) AS region FROM nation")
def value_table_columns(spark, d):
    """A column unloaded, changed and loaded again; another filled."""
    held = _values(spark, d)
    values = collections.unload_column(held, "name").withColumn("value", F.concat("value", F.lit("!")))
    return collections.fill_values(collections.load_column(held, values, "name"), 7, "region")


@query(
    """WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS r, n_name AS name FROM nation), n AS (SELECT max(r) + 1 AS n FROM t),
i AS (SELECT CASE WHEN r >= 2 THEN r + 1 ELSE r END AS r, name FROM t UNION ALL SELECT 2, 'NEW'), a AS (SELECT * FROM i UNION ALL SELECT n + 1, 'LAST' FROM n),
x AS (SELECT CASE WHEN r > 5 THEN r - 1 ELSE r END AS r, name FROM a WHERE r <> 5)
SELECT CASE WHEN r = 1 THEN 4 WHEN r BETWEEN 2 AND 4 THEN r - 1 ELSE r END AS "row", name FROM x"""
)
def value_table_edit(spark, d):
    """A row inserted at 2, one added, row 5 deleted, row 1 moved by 3."""
    held = collections.insert(_values(spark, d).drop("region"), 2, name="NEW")
    return collections.move(collections.delete(collections.add(held, name="LAST"), 5), 1, 3)


@query("SELECT CAST(sum(n_regionkey) AS BIGINT) AS total, count(*) AS count, (SELECT CAST(min(n_nationkey) AS BIGINT) FROM nation WHERE n_regionkey = 4) AS \"index\" FROM nation")
def value_table_totals(spark, d):
    held = _values(spark, d)
    return collections.total(held, "region").crossJoin(collections.count(held)).crossJoin(collections.index_of(held, {"region": 4}))  # one row each


@query(
    """SELECT p_partkey, p_size || ',0,' || p_partkey AS inserted, p_size || '' AS deleted, 1 AS found, 1 AS upper, p_size || ',9' AS put, CAST(p_size AS BIGINT) AS got FROM part"""
)
def array_methods(spark, d):
    items = F.array(F.col("p_size").cast("long"), F.col("p_partkey").cast("long") + 1000)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    plain = F.array(F.col("p_size").cast("long"), F.col("p_partkey").cast("long"))
    return table(spark, d, "part").select(
        "p_partkey", joined(collections.array_insert_at(plain, 1, 0)).alias("inserted"), joined(collections.array_delete_at(plain, 1)).alias("deleted"),
        collections.array_find(F.array_append(F.array(F.lit(-1).cast("long")), F.lit(5).cast("long")), 5).cast("int").alias("found"), collections.ubound(items).alias("upper"),
        joined(collections.array_set(plain, 1, 9)).alias("put"), F.get(plain, 0).alias("got"),
    )


@query("SELECT c_custkey, c_mktsegment AS kept, 'new' AS put, CAST(NULL AS VARCHAR) AS missing, 2 AS size, 'B' AS first, 'b' AS found FROM customer")
def map_and_list_methods(spark, d):
    pairs = collections.map_insert(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("x"), F.lit("old")), "x", "new")
    pairs = collections.map_delete(pairs, "name")
    entry = lambda v, p: F.struct(F.lit(v).alias("value"), F.lit(p).alias("presentation"))
    values = F.array(entry("A", "z"), entry("B", "b"))
    return table(spark, d, "customer").select(
        "c_custkey", collections.map_get(pairs, "segment").alias("kept"), collections.map_get(pairs, "x").alias("put"), collections.map_get(pairs, "name").alias("missing"), F.size(pairs).alias("size"),
        F.get(collections.list_sort(values, "presentation"), 0)["value"].alias("first"), collections.list_find(values, "B")["presentation"].alias("found"),
    )


# --- the other scalar functions ----------------------------------------------


@query(
    r"""SELECT p_partkey, ltrim('  ' || p_name || ' ') AS tl, rtrim('  ' || p_name || ' ') AS tr, CAST(1 + length(p_name) - length(replace(p_name, ' ', '')) AS INT) AS n_lines, split_part(p_name, ' ', 1) AS line1, p_brand || '-' || p_type AS joined,
CAST(len(regexp_split_to_array(p_name, '[ ,]')) AS INT) AS n_split, p_size % 2 = 0 AS blank, upper(p_brand[1:1]) || lower(p_brand[2:]) AS title FROM part"""
)
def fn_string_more(spark, d):
    p, name = platform.call, F.col("p_name")
    broken = F.replace(name, F.lit(" "), F.lit("\n"))
    return table(spark, d, "part").select(
        "p_partkey", p("TrimL", F.concat(F.lit("  "), name, F.lit(" "))).alias("tl"), p("СокрП", F.concat(F.lit("  "), name, F.lit(" "))).alias("tr"), p("StrLineCount", broken).alias("n_lines"), p("СтрПолучитьСтроку", broken, 1).alias("line1"),
        p("StrConcat", F.array("p_brand", "p_type"), "-").alias("joined"), F.size(p("СтрРазделить", name, " ,")).alias("n_split"), p("IsBlankString", F.when(F.col("p_size") % 2 == 0, " \t").otherwise("x")).alias("blank"), p("ТРег", F.replace("p_brand", F.lit(" "), F.lit(""))).alias("title"),
    )


@query("SELECT l_orderkey, l_linenumber, round(cos(l_quantity), 6) AS cs, round(tan(l_quantity), 6) AS tn, round(asin(l_discount), 6) AS asn, round(acos(l_discount), 6) AS acs FROM lineitem")
def fn_math_more(spark, d):
    p, q, x = platform.call, F.col("l_quantity"), F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p("Cos", q), 6).alias("cs"), F.round(p("Tan", q), 6).alias("tn"), F.round(p("ASin", x), 6).alias("asn"), F.round(p("ACos", x), 6).alias("acs"))


@query(
    """WITH e AS (SELECT event_id, ts, (ts - INTERVAL '0' SECOND) AS x FROM events) SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(date_trunc('year', ts) AS TIMESTAMP) AS by_, CAST(date_trunc('year', ts) AS TIMESTAMP) + INTERVAL 1 YEAR - INTERVAL 1 SECOND AS ey,
CAST(date_trunc('quarter', ts) AS TIMESTAMP) + INTERVAL 3 MONTH - INTERVAL 1 SECOND AS eq, CAST(date_trunc('month', ts) AS TIMESTAMP) AS bm, CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY - INTERVAL 1 SECOND AS ew, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bd, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND AS ed,
CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bh, CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR - INTERVAL 1 SECOND AS eh, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS bmi, CAST(date_trunc('minute', ts) AS TIMESTAMP) + INTERVAL 1 MINUTE - INTERVAL 1 SECOND AS emi,
make_timestamp(year(ts), month(ts), day(ts), 0, 0, 0) AS made, strftime(ts, '%Y-%m') AS shown FROM e"""
)
def fn_date_more(spark, d):
    p, x = platform.call, F.col("ts")
    return table(spark, d, "events").select(
        "event_id", p("Час", x).alias("h"), p("Minute", x).alias("mi"), p("Секунда", x).cast("int").alias("s"), p("НачалоГода", x).alias("by_"), p("EndOfYear", x).alias("ey"), p("КонецКвартала", x).alias("eq"), p("BegOfMonth", x).alias("bm"), p("EndOfWeek", x).alias("ew"),
        p("BegOfDay", x).alias("bd"), p("КонецДня", x).alias("ed"), p("BegOfHour", x).alias("bh"), p("EndOfHour", x).alias("eh"), p("BegOfMinute", x).alias("bmi"), p("EndOfMinute", x).alias("emi"),
        p("Date", p("Year", x), p("Month", x), p("Day", x)).alias("made"), p("Format", x, "yyyy-MM").alias("shown"),
    )


@query(
    """SELECT p_partkey, 'Число' AS type, 'int' AS type_of, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DECIMAL(38, 10)) AS n, CAST(NULL AS DECIMAL(38, 10)) AS bad, p_size <> 0 AS b, p_size % 2 = 0 AS filled, CAST(p_size AS VARCHAR) AS inner_, CAST(p_partkey AS VARCHAR) AS xml, CAST(p_partkey AS BIGINT) AS back FROM part"""
)
def fn_types(spark, d):
    p, size, k = platform.call, F.col("p_size"), F.col("p_partkey")
    inside = p("ValueFromStringInternal", p("ValueToStringInternal", size.alias("v")))
    return table(spark, d, "part").select(
        "p_partkey", p("Type", "Число").alias("type"), p("ТипЗнч", size).alias("type_of"), p("Строка", size).alias("s"), p("Число", size.cast("string")).alias("n"), p("Number", F.concat(F.lit("x"), size)).alias("bad"), p("Булево", size).alias("b"),
        p("ЗначениеЗаполнено", F.when(size % 2 == 0, "a").otherwise(" ")).alias("filled"), F.try_variant_get(inside, "$.v", "string").alias("inner_"), p("XMLString", k).alias("xml"), p("XMLValue", "bigint", p("XMLString", k)).alias("back"),
    )


# --- the dialect's advice ----------------------------------------------------


@query("SELECT r_regionkey AS k, r_regionkey <> 0 AS is_valid, CASE WHEN r_regionkey = 1 THEN 'Catalog.Нет' ELSE '' END AS unknown, CASE r_regionkey WHEN 2 THEN 'select_star' WHEN 3 THEN 'slice_without_period' WHEN 4 THEN 'subquery' ELSE '' END AS advice, CASE WHEN r_regionkey = 0 THEN 0 ELSE 1 END AS n_sources FROM region")
def dialect_advice(spark, d):
    """Validation, advice and explanation of a table of query texts."""
    texts = ["ВЫБРАТЬ ИЗ Справочник.Товары", "ВЫБРАТЬ т.Код ИЗ Справочник.Нет КАК т", "ВЫБРАТЬ * ИЗ Справочник.Товары", "ВЫБРАТЬ т.Цена ИЗ РегистрСведений.Цены.СрезПоследних КАК т", "ВЫБРАТЬ т.Код ИЗ Справочник.Товары КАК т ГДЕ т.Код В (ВЫБРАТЬ п.Код ИЗ Справочник.Товары КАК п)"]
    held = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.get(F.array(*map(F.lit, texts)), F.col("r_regionkey")).alias("query_text"))
    from lodestar.plans import dialect

    found = dialect.review(held, ["Catalog.Товары", "InformationRegister.Цены"])
    return found.select("k", "is_valid", F.array_join("unknown_tables", ",").alias("unknown"), F.array_join("advice", ",").alias("advice"), F.when(F.col("k") == 0, 0).otherwise(F.size(F.filter(F.split("explanation", "\n"), lambda x: x.startswith("Sources:")))).alias("n_sources"))
