"""Every operator as a query over the test tables, with SQL for the same result where SQL can say it."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import platform, text
from lodestar.operators import graph, intervals, registers, store, vectors
from lodestar.plans import dialect
from lodestar.registry import QUERIES, SQL, Query, query
from lodestar.session import table

# --- derived tables ----------------------------------------------------------


def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the star schema as graph nodes."""
    parts = [
        ("region", "Region", "r_regionkey", "r_name"),
        ("nation", "Nation", "n_nationkey", "n_name"),
        ("customer", "Customer", "c_custkey", "c_name"),
        ("supplier", "Supplier", "s_suppkey", "s_name"),
        ("part", "Part", "p_partkey", "p_name"),
    ]
    out = None
    for name, kind, key, title in parts:
        t = table(spark, d, name).select(_id(kind, key).alias("id"), F.lit(kind).alias("node_type"), F.col(title).alias("name"))
        out = t if out is None else out.unionByName(t)
    orders = table(spark, d, "orders").select(_id("Order", "o_orderkey").alias("id"), F.lit("Order").alias("node_type"), F.col("o_orderkey").cast("string").alias("name"))
    return out.unionByName(orders)


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}."), F.col(key).cast("string"))


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """Child to parent by foreign key; lines of one order repeat their edges."""

    def link(t: str, kind: str, key: str, parent: str, ref: str, relationship: str, rank: int) -> DataFrame:
        return table(spark, d, t).select(
            F.lit(rank).alias("rank"), _id(kind, key).alias("source"), _id(parent, ref).alias("target"), F.lit(relationship).alias("relationship"), F.lit(ref).alias("label")
        )

    return (
        link("nation", "Nation", "n_nationkey", "Region", "n_regionkey", "subsystem_hierarchy", 1)
        .unionByName(link("customer", "Customer", "c_custkey", "Nation", "c_nationkey", "attribute_reference", 2))
        .unionByName(link("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", "attribute_reference", 3))
        .unionByName(link("orders", "Order", "o_orderkey", "Customer", "o_custkey", "attribute_reference", 4))
        .unionByName(link("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey", "tabular_reference", 5))
        .unionByName(link("lineitem", "Order", "l_orderkey", "Part", "l_partkey", "tabular_reference", 6))
    )


def numbered_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with edge_seq by the order of the tables, then by the edge itself; repeated ones have equal numbers, which no traversal minds."""
    digest = F.substring(F.md5(F.concat_ws("|", "source", "target", "relationship", "label")), 1, 14)
    seq = F.col("rank").cast("long") * (1 << 56) + F.conv(digest, 16, 10).cast("long")
    return raw_edges(spark, d).withColumn("edge_seq", seq).drop("rank")


def entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """The same, each edge once."""
    return graph.dedup_edges(numbered_edges(spark, d))


EDGES_SQL = """
raw AS (
  SELECT 1 AS rank, 'Nation.' || n_nationkey AS source, 'Region.' || n_regionkey AS target, 'subsystem_hierarchy' AS relationship, 'n_regionkey' AS label FROM nation
  UNION ALL SELECT 2, 'Customer.' || c_custkey, 'Nation.' || c_nationkey, 'attribute_reference', 'c_nationkey' FROM customer
  UNION ALL SELECT 3, 'Supplier.' || s_suppkey, 'Nation.' || s_nationkey, 'attribute_reference', 's_nationkey' FROM supplier
  UNION ALL SELECT 4, 'Order.' || o_orderkey, 'Customer.' || o_custkey, 'attribute_reference', 'o_custkey' FROM orders
  UNION ALL SELECT 5, 'Order.' || l_orderkey, 'Supplier.' || l_suppkey, 'tabular_reference', 'l_suppkey' FROM lineitem
  UNION ALL SELECT 6, 'Order.' || l_orderkey, 'Part.' || l_partkey, 'tabular_reference', 'l_partkey' FROM lineitem
), edges AS (
  SELECT min(CAST(rank AS BIGINT) * 72057594037927936 + CAST('0x' || substr(md5(source || '|' || target || '|' || relationship || '|' || label), 1, 14) AS BIGINT)) AS edge_seq,
         source, target, relationship, label FROM raw GROUP BY source, target, relationship, label)
"""
NODES_SQL = """
nodes AS (
  SELECT 'Region.' || r_regionkey AS id, 'Region' AS node_type, r_name AS name FROM region
  UNION ALL SELECT 'Nation.' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'Customer.' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'Supplier.' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'Part.' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT 'Order.' || o_orderkey, 'Order', CAST(o_orderkey AS VARCHAR) FROM orders
)
"""


def movements(spark: SparkSession, d: str) -> DataFrame:
    """Lines as register movements; quantities are whole numbers, kept as such so that sums are exact."""
    return table(spark, d, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_returnflag") == "R", "Expense").otherwise("Receipt").alias("kind"),
        F.col("l_shipdate").alias("period"),
        F.col("l_orderkey").alias("recorder"),
        F.col("l_linenumber").alias("line"),
        F.round("l_quantity").cast("bigint").alias("quantity"),
    )


MOVES_SQL = """
moves AS (
  SELECT l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'Expense' ELSE 'Receipt' END AS kind, l_shipdate AS period,
         l_orderkey AS recorder, l_linenumber AS line, CAST(round(l_quantity) AS BIGINT) AS quantity FROM lineitem
), signed AS (SELECT *, CASE WHEN kind = 'Receipt' THEN quantity ELSE -quantity END AS q FROM moves)
"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    changed = orders.withColumn("cents", F.when(F.col("o_orderkey") % 10 == 2, F.col("cents") + 1).otherwise(F.col("cents")))
    return orders.where("o_orderkey % 10 <> 0"), changed.where("o_orderkey % 10 <> 1")


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Customers and parts as store objects."""
    parts = table(spark, d, "part").select(F.lit("Part").alias("metadata_type"), F.col("p_name").alias("name"), F.col("p_type").alias("synonym"), F.col("p_partkey").alias("key"))
    customers = table(spark, d, "customer").select(F.lit("Customer").alias("metadata_type"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("synonym"), F.col("c_custkey").alias("key"))
    return parts.unionByName(customers)


OBJECTS_SQL = """
objects AS (
  SELECT 'Part' AS metadata_type, p_name AS name, p_type AS synonym, p_partkey AS key FROM part
  UNION ALL SELECT 'Customer', c_name, c_mktsegment, c_custkey FROM customer
)
"""


# --- store -------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_counts(spark, d):
    return store.counts_by(table(spark, d, "events"), "event_type")


@query(f"WITH {OBJECTS_SQL} SELECT * FROM objects WHERE metadata_type = 'Customer' AND name = (SELECT min(c_name) FROM customer)")
def point_lookup(spark, d):
    first = table(spark, d, "customer").agg(F.min("c_name").alias("name"))
    return objects(spark, d).where("metadata_type = 'Customer'").join(F.broadcast(first), "name").select("metadata_type", "name", "synonym", "key")  # one row


@query(f"WITH {OBJECTS_SQL} SELECT metadata_type, name FROM objects WHERE metadata_type = 'Part'")
def type_scan_names(spark, d):
    return store.names(objects(spark, d), "Part")


_TOKEN_SQL = """
, f AS (SELECT *, ({all}) AS every FROM objects WHERE {some}), g AS (SELECT *, max(CAST(every AS INT)) OVER () AS any_all FROM f)
SELECT metadata_type, name, synonym, key, CASE WHEN lower(name) LIKE '{first}%' THEN 0 ELSE 1 END AS rank FROM g WHERE every OR any_all = 0
"""


def _token_sql(*tokens: str) -> str:
    hit = [f"(lower(name) LIKE '%{t}%' OR lower(synonym) LIKE '%{t}%')" for t in tokens]
    return f"WITH {OBJECTS_SQL}" + _TOKEN_SQL.format(all=" AND ".join(hit), some=" OR ".join(hit), first=tokens[0])


@query(_token_sql("st", "br"))
def token_search_all(spark, d):
    return store.token_search(objects(spark, d), "ST br", limit=None)


@query(_token_sql("build", "nosuchtoken"))
def token_search_fallback_or(spark, d):
    return store.token_search(objects(spark, d), "build nosuchtoken", limit=None)


@query(f"WITH {OBJECTS_SQL} SELECT metadata_type, name, synonym, key, CASE WHEN lower(name) LIKE 'cust%' THEN 0 ELSE 1 END AS rank FROM objects WHERE lower(name) LIKE '%cust%' OR lower(synonym) LIKE '%cust%' ORDER BY rank, name LIMIT 50")
def token_search_top(spark, d):
    return store.token_search(objects(spark, d), "cust", limit=50)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT event_id, ts, user_id, event_type, value, props FROM r WHERE n = 1"""
)
def upsert_latest_event(spark, d):
    return store.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS seq FROM customer"""
)
def upsert_by_key(spark, d):
    now = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(1).alias("seq"))
    changes = now.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment"), F.lit(2).alias("seq"))
    return store.upsert(now, changes, ["c_custkey"], "seq")


@query("SELECT doc_id, md5(coalesce(text, '') || '!') AS file_hash FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL")
def hash_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    stored = docs.select("doc_id", F.md5(F.col("content").cast("binary")).alias("file_hash"))
    scanned = docs.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return store.changed(scanned, stored, ["doc_id"]).select("doc_id", "file_hash")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def deleted_keys(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return store.deleted(orders.where("o_orderkey % 10 <> 0"), orders, ["o_orderkey"])


DIFF_SQL = """
WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
a AS (SELECT * FROM o WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 2 THEN cents + 1 ELSE cents END AS cents FROM o WHERE o_orderkey % 10 <> 1),
c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.cents <> b.cents OR a.o_orderstatus <> b.o_orderstatus THEN 'modified' ELSE 'unchanged' END AS status
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
"""


@query(DIFF_SQL + "SELECT * FROM c")
def config_diff_orders(spark, d):
    a, b = snapshots(spark, d)
    return store.diff(a, b, ["o_orderkey"], ["o_orderstatus", "cents"])


@query(DIFF_SQL + "SELECT status, count(*) AS n FROM c GROUP BY status")
def config_diff_summary(spark, d):
    return store.diff_summary(config_diff_orders(spark, d))


@query("SELECT event_id, 'p' || (event_id % 3) AS source, 3 - (event_id % 3) AS priority FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'p1', 2 FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'p2', 1 FROM events WHERE event_id % 3 = 2")
def overlay_precedence(spark, d):
    events = table(spark, d, "events").select("event_id")
    roots = events.where("event_id % 3 = 0").select("event_id", F.lit("p0").alias("source"), F.lit(3).cast("bigint").alias("priority"))
    roots = roots.unionByName(events.where("event_id % 3 <= 1").select("event_id", F.lit("p1").alias("source"), F.lit(2).cast("bigint").alias("priority")))
    roots = roots.unionByName(events.select("event_id", F.lit("p2").alias("source"), F.lit(1).cast("bigint").alias("priority")))
    return store.merge_roots(roots, ["event_id"])


@query("SELECT c_name AS id FROM customer WHERE NOT c_name LIKE 'Customer#00000001%'")
def delete_by_prefix(spark, d):
    return store.delete_by_prefix(table(spark, d, "customer").select(F.col("c_name").alias("id")), "Customer#00000001")


@query("SELECT avg(CASE WHEN regexp_matches(c_name, '^[A-Za-z0-9_]+$') THEN 1.0 ELSE 0.0 END) AS share, CASE WHEN avg(CASE WHEN regexp_matches(c_name, '^[A-Za-z0-9_]+$') THEN 1.0 ELSE 0.0 END) >= 0.7 THEN 'en' ELSE 'ru' END AS language FROM customer")
def lang_ratio(spark, d):
    return store.ascii_share(table(spark, d, "customer"), "c_name")


@query("SELECT prefix, count(*) AS n FROM (SELECT CASE WHEN starts_with(p_type, 'STANDARD') THEN 'STANDARD' WHEN starts_with(p_type, 'SMALL') THEN 'SMALL' WHEN starts_with(p_type, 'S') THEN 'S' END AS prefix FROM part) WHERE prefix IS NOT NULL GROUP BY prefix HAVING count(*) >= 5")
def obsolete_prefixes(spark, d):
    return store.common_prefixes(table(spark, d, "part"), ["STANDARD", "SMALL", "S"], 5, "p_type")


@query("SELECT bool_or(r_name IN ('ASIA', 'NOWHERE')) AS found FROM region")
def any_named(spark, d):
    return store.any_named(table(spark, d, "region"), ["ASIA", "NOWHERE"], "r_name")


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Events as audit rows with whole milliseconds."""
    return table(spark, d, "events").select(F.col("event_type").alias("tool"), F.when(F.col("event_id") % 7 == 0, "error").otherwise("ok").alias("status"), F.floor("value").cast("bigint").alias("latency_ms"))


AUDIT_SQL = "WITH audit AS (SELECT event_type AS tool, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CAST(floor(value) AS BIGINT) AS latency_ms FROM events) "


@query(
    AUDIT_SQL
    + """SELECT tool, count(*) AS calls, count(*) FILTER (status <> 'ok') AS errors, round(avg(latency_ms), 6) AS avg_ms, CAST(sum(latency_ms) AS BIGINT) AS total_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM audit GROUP BY tool"""
)
def tool_metrics(spark, d):
    return store.tool_metrics(audit(spark, d))


@query(
    AUDIT_SQL
    + "SELECT tool, le, count(latency_ms) FILTER (le IS NULL OR latency_ms <= le) AS n FROM audit CROSS JOIN (SELECT unnest([5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, NULL]::DOUBLE[]) AS le) GROUP BY tool, le"
)
def latency_histogram(spark, d):
    return store.latency_histogram(audit(spark, d))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view') = 0 THEN 0.0 ELSE round(count(*) FILTER (event_type = 'click') / (count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view')), 6) END AS rate FROM events GROUP BY user_id")
def hit_rate(spark, d):
    clicks, views = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(store.hit_rate(clicks, views), 6).alias("rate"))


@query("SELECT 'tool_calls_total{tool=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT 'tool_errors_total{tool=\"' || event_type || '\"} ' || count(*) FILTER (event_id % 7 = 0) FROM events GROUP BY event_type")
def tool_exposition(spark, d):
    return store.exposition(audit(spark, d))


@query("SELECT event_type AS name, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, round(avg(CAST(floor(value) AS BIGINT)), 6) AS mean, max(CAST(floor(value) AS BIGINT)) AS most FROM events GROUP BY event_type")
def timing_profile(spark, d):
    spans = audit(spark, d).select(F.col("tool").alias("name"), F.col("latency_ms").alias("seconds"))
    return store.timings(spans).withColumn("mean", F.round("mean", 6))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, '1996-07-01T12:00:00' AS at, c_custkey % 2 = 1 AS kept_null FROM customer")
def serialized_rows(spark, d):
    """Rows as JSON objects and back: nulls are kept, times are ISO."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.lit(dt.datetime(1996, 7, 1, 12)).cast("timestamp_ntz").alias("at"))
    back = store.serialized(rows).select("json", F.from_json("json", "c_custkey long, name string, at string").alias("r"))
    return back.select("r.*", F.col("json").contains('"name":null').alias("kept_null"))


@query("WITH puts AS (SELECT user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click') SELECT r.event_id, coalesce(epoch_us(r.ts) - epoch_us(p.ts) <= 86400000000, false) AS hit FROM r ASOF LEFT JOIN puts p ON r.user_id = p.user_id AND r.ts >= p.ts")
def cache_hits(spark, d):
    """Requests answered by a put of the same key that is at most a day old."""
    e = table(spark, d, "events")
    puts = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), "ts")
    return store.cached(e.where("event_type <> 'click'").select("event_id", F.col("user_id").alias("key"), "ts"), puts, 86_400).select("event_id", "hit")


@query("SELECT CASE WHEN avg(CASE WHEN regexp_matches(p_name, '^[A-Za-z0-9_]+$') THEN 1.0 ELSE 0.0 END) >= 0.7 THEN 'en' ELSE 'ru' END AS language, bool_or(p_name = (SELECT min(p_name) FROM part)) AS bsp_used, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT CASE WHEN starts_with(p_type, 'SMALL') THEN 'SMALL' WHEN starts_with(p_type, 'NONE') THEN 'NONE' END AS p FROM part GROUP BY 1 HAVING count(*) >= 5) WHERE p IS NOT NULL) AS obsolete_prefixes, (SELECT count(DISTINCT n_name) FROM nation) AS n_extensions FROM part")
def profile_detected(spark, d):
    from lodestar.plans import profile

    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("name"))
    first = names.agg(F.min("name")).first()[0]
    extensions = table(spark, d, "nation").select(F.col("n_name").alias("extension"), F.lit("").alias("purpose"))
    row = profile.detected(names, part.select(F.col("p_type").alias("name")), ["SMALL", "NONE"], [first], extensions)
    return row.select("language", "bsp_used", F.array_join("obsolete_prefixes", ",").alias("obsolete_prefixes"), F.size("extensions").cast("long").alias("n_extensions"))


# --- graph -------------------------------------------------------------------


@query(f"WITH {EDGES_SQL} SELECT edge_seq, source, target, relationship, label FROM edges")
def edge_dedup(spark, d):
    return entity_edges(spark, d)


@query(
    f"""WITH {EDGES_SQL}, {NODES_SQL}
SELECT 'node' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY ROLLUP(node_type) UNION ALL
SELECT 'edge', relationship, count(*) FROM edges GROUP BY ROLLUP(relationship)"""
)
def graph_stats(spark, d):
    return graph.stats(entity_nodes(spark, d), entity_edges(spark, d))


IMPACT_SQL = f"""
WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, bfs(id, depth) AS (
  SELECT 'Region.0', 0 UNION SELECT e.source, depth + 1 FROM bfs JOIN edges e ON e.target = bfs.id WHERE depth < 3
), least AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY id)
"""


@query(
    IMPACT_SQL
    + """, led AS (SELECT l.id, arg_min(e.relationship, e.edge_seq) AS via FROM least l JOIN edges e ON e.source = l.id JOIN least t ON t.id = e.target AND t.depth = l.depth - 1 GROUP BY l.id)
SELECT l.id, n.node_type, n.name, CAST(l.depth AS INT) AS depth, v.via FROM least l JOIN led v ON v.id = l.id LEFT JOIN nodes n ON n.id = l.id WHERE l.depth > 0"""
)
def impact_bfs(spark, d):
    return graph.impact(entity_nodes(spark, d), numbered_edges(spark, d), "Region.0", 3)


@query(IMPACT_SQL + "SELECT CAST(depth AS INT) AS depth, count(*) AS n FROM least WHERE depth > 0 GROUP BY depth")
def impact_summary(spark, d):
    return graph.impact_summary(graph.impact(entity_nodes(spark, d), numbered_edges(spark, d), "Region.0", 3))


PATH_SQL = f"""WITH RECURSIVE {EDGES_SQL}, ways AS (SELECT source AS a, target AS b, * FROM edges UNION ALL SELECT target, source, * FROM edges),
bfs(id, depth) AS (SELECT 'Customer.1', 0 UNION SELECT b, depth + 1 FROM bfs JOIN ways ON a = id WHERE depth < 5), least AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY id)
"""


@query(PATH_SQL + "SELECT CAST(max(depth) AS INT) AS length FROM least WHERE id = 'Region.0'")
def shortest_path_length(spark, d):
    path = graph.shortest_path(numbered_edges(spark, d), "Customer.1", "Region.0")
    return path.agg(F.max("step").alias("length"))


@query(
    PATH_SQL
    + """, up AS (SELECT n.id, n.depth, arg_min(p.id, w.edge_seq) AS parent, arg_min(w.source, w.edge_seq) AS source, arg_min(w.target, w.edge_seq) AS target, arg_min(w.relationship, w.edge_seq) AS relationship, min(w.edge_seq) AS edge_seq
  FROM least n JOIN ways w ON w.a = n.id JOIN least p ON p.id = w.b AND p.depth = n.depth - 1 GROUP BY n.id, n.depth),
walk AS (SELECT * FROM up WHERE id = 'Region.0' UNION ALL SELECT up.* FROM walk JOIN up ON up.id = walk.parent)
SELECT CAST(depth AS INT) AS step, edge_seq, source, target, relationship FROM walk"""
)
def shortest_path(spark, d):
    return graph.shortest_path(numbered_edges(spark, d), "Customer.1", "Region.0")


RELATED_SQL = f"""WITH {EDGES_SQL}, {NODES_SQL}, r AS (
  SELECT edge_seq, relationship, label, CASE WHEN source = 'Nation.3' THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN source = 'Nation.3' THEN target ELSE source END AS neighbour
  FROM edges WHERE source = 'Nation.3' OR target = 'Nation.3')
SELECT edge_seq, relationship, label, direction, neighbour, node_type AS neighbour_type, name AS neighbour_name{{}} FROM r JOIN nodes ON id = neighbour"""


@query(RELATED_SQL.format(""))
def related_both(spark, d):
    return graph.related(entity_nodes(spark, d), entity_edges(spark, d), "Nation.3")


@query(RELATED_SQL.format(", count(*) OVER () AS total_connections"))
def object_context(spark, d):
    return graph.context(entity_nodes(spark, d), entity_edges(spark, d), "Nation.3")


@query(RELATED_SQL.format("") + " WHERE direction = 'incoming' AND relationship = 'attribute_reference'")
def related_incoming(spark, d):
    return graph.related(entity_nodes(spark, d), entity_edges(spark, d), "Nation.3", "attribute_reference", "incoming")


@query(f"WITH {EDGES_SQL} SELECT source, target, relationship, label FROM edges WHERE (source LIKE 'Nation.%' OR source LIKE 'Customer.%') AND target LIKE 'Nation.%'")
def subgraph(spark, d):
    nodes = entity_nodes(spark, d)
    _, edges = graph.subgraph(nodes, entity_edges(spark, d), nodes.where("node_type in ('Nation', 'Customer')").select("id"))
    return edges.drop("edge_seq")


@query("SELECT 'Part.' || p_partkey AS id, 'Part' AS node_type, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def unused_parts(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("x").alias("source"), _id("Part", "l_partkey").alias("target"), F.lit("used").alias("relationship"))
    return graph.unused(entity_nodes(spark, d).where("node_type = 'Part'"), used)


def _two_nations(spark, d):
    return table(spark, d, "nation").where("n_nationkey in (3, 4)").select(_id("Nation", "n_nationkey").alias("id"))


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT id, node_type, name FROM nodes WHERE id NOT IN ('Nation.3', 'Nation.4')")
def invalidate_nodes(spark, d):
    return graph.invalidate(entity_nodes(spark, d), entity_edges(spark, d), _two_nations(spark, d))[0]


@query(f"WITH {EDGES_SQL} SELECT edge_seq, source, target, relationship, label FROM edges WHERE source NOT IN ('Nation.3', 'Nation.4') AND target NOT IN ('Nation.3', 'Nation.4')")
def invalidate_edges(spark, d):
    return graph.invalidate(entity_nodes(spark, d), entity_edges(spark, d), _two_nations(spark, d))[1]


@query(
    """WITH n AS (SELECT lower(c_mktsegment) AS k, c_custkey FROM customer UNION ALL SELECT lower(c_name), c_custkey FROM customer), u AS (SELECT k, count(*) AS m, min(c_custkey) AS id FROM n GROUP BY k)
SELECT k AS lower_name, id FROM u WHERE m = 1"""
)
def unique_name_join(spark, d):
    c = table(spark, d, "customer")
    names = c.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id")).unionByName(c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")))
    return graph.unique_names(names)


CALLS_SQL = """
c AS (SELECT 'Order.' || l_orderkey AS source, 'Part.' || l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'uses_metadata' ELSE 'calls' END AS edge_type, l_suppkey AS file, l_linenumber AS line, CAST(round(l_quantity) AS BIGINT) AS col FROM lineitem)
"""


def _calls(spark, d):
    return table(spark, d, "lineitem").select(
        _id("Order", "l_orderkey").alias("source"), _id("Part", "l_partkey").alias("target"), F.when(F.col("l_returnflag") == "R", "uses_metadata").otherwise("calls").alias("edge_type"),
        F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.round("l_quantity").cast("bigint").alias("column"),
    )


@query(f"WITH {CALLS_SQL} SELECT source, target, edge_type, count(*) AS count FROM c GROUP BY source, target, edge_type")
def edge_collapse(spark, d):
    return graph.collapse_edges(_calls(spark, d))


@query(f"WITH {CALLS_SQL} SELECT DISTINCT source, target, edge_type, file, line, col AS \"column\" FROM c")
def edge_locations(spark, d):
    return graph.edge_locations(_calls(spark, d))


@query(f"WITH {CALLS_SQL} SELECT source, target, edge_type, CAST(2 * count(*) AS BIGINT) AS count FROM c GROUP BY source, target, edge_type")
def graph_merge(spark, d):
    one = graph.collapse_edges(_calls(spark, d))
    return graph.merge_code_edges(one, one)


@query(
    f"""WITH {CALLS_SQL}, u AS (SELECT edge_type, target, count(*) AS uses FROM c GROUP BY edge_type, target),
r AS (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY uses DESC, target) AS place FROM u) SELECT edge_type, target, uses, CAST(place AS INT) AS place FROM r WHERE place <= 10"""
)
def top10_called(spark, d):
    return graph.dependency_stats(graph.collapse_edges(_calls(spark, d)))


@query("SELECT 'Customer.' || c_custkey AS source, 'Region.' || n_regionkey AS target, 'attribute_reference' AS relationship FROM customer JOIN nation ON c_nationkey = n_nationkey")
def resolve_transitive(spark, d):
    edges = entity_edges(spark, d).where("source like 'Customer.%' or relationship = 'subsystem_hierarchy'")
    return graph.resolve_through(edges, "Nation.", "subsystem_hierarchy").select("source", "target", "relationship")


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, bfs(id, depth) AS (SELECT 'Order.1', 0 UNION SELECT e.target, depth + 1 FROM bfs JOIN edges e ON e.source = bfs.id WHERE depth < 2)
SELECT id, CAST(min(depth) AS INT) AS depth FROM bfs GROUP BY id HAVING min(depth) > 0"""
)
def dependency_tree(spark, d):
    return graph.dependencies(numbered_edges(spark, d), "Order.1", 2)


@query(
    """SELECT r_name AS name, '' AS parent, 0 AS level, r_name AS path FROM region
UNION ALL SELECT n_name, r_name, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def subsystem_tree(spark, d):
    regions = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    return graph.tree(regions.unionByName(nations))


# --- intervals ---------------------------------------------------------------


@query("SELECT o_orderkey, o.o_custkey, CAST(k AS BIGINT) AS band FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders) o JOIN range(0, 60) t(k) ON o.price BETWEEN k * 10000 AND k * 10000 + 12000")
def interval_contains(spark, d):
    points = table(spark, d, "orders").select(F.lit(1).alias("k"), "o_orderkey", "o_custkey", F.floor("o_totalprice").cast("bigint").alias("price"))
    bands = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("band"), (F.col("id") * 10000).alias("lo"), (F.col("id") * 10000 + 12000).alias("hi"))
    return intervals.containing(points, bands, ["k"], "price", "lo", "hi", width=10000).select("o_orderkey", "o_custkey", "band")


@query(
    """WITH b AS (SELECT c_nationkey, min(CAST(floor(c_acctbal) AS BIGINT)) AS lo, max(CAST(floor(c_acctbal) AS BIGINT)) AS hi, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment),
s AS (SELECT s_suppkey, s_nationkey, CAST(floor(s_acctbal) AS BIGINT) AS bal FROM supplier),
j AS (SELECT s_suppkey, c_mktsegment, row_number() OVER (PARTITION BY s_suppkey ORDER BY hi - lo NULLS LAST, lo DESC, c_mktsegment) AS n FROM s LEFT JOIN b ON s_nationkey = c_nationkey AND bal BETWEEN lo AND hi)
SELECT s_suppkey, c_mktsegment FROM j WHERE n = 1"""
)
def innermost_interval(spark, d):
    bands = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.floor("c_acctbal").cast("bigint").alias("v")).groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    points = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor("s_acctbal").cast("bigint").alias("bal"))
    return intervals.innermost(points, bands, ["nation"], "bal", "lo", "hi", ["s_suppkey"]).select("s_suppkey", "c_mktsegment")


@query(
    """WITH l AS (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority, 'x']) AS t FROM orders WHERE o_orderkey % 7 = 0), r AS (SELECT 1 AS seq, unnest(['O', '1-URGENT']) AS t UNION ALL SELECT 2, unnest(['F', 'x']) UNION ALL SELECT 3, unnest(['x', 'P', '5-LOW'])),
s AS (SELECT o_orderkey, seq, count(*) AS score FROM l JOIN r USING (t) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, seq) AS n FROM s)
SELECT o_orderkey, seq AS right_seq, CAST(score AS INT) AS score FROM b WHERE n = 1"""
)
def type_overlap(spark, d):
    """For each order the offer that shares most types with it."""
    left = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.lit(1).alias("k"), "o_orderkey", F.array("o_orderstatus", "o_orderpriority", F.lit("x")).alias("types"))
    offers = spark.createDataFrame([(1, 1, ["O", "1-URGENT"]), (1, 2, ["F", "x"]), (1, 3, ["x", "P", "5-LOW"])], "k int, seq int, types array<string>")
    return intervals.best_overlap(left, offers, "k", "types", "types", "seq").select("o_orderkey", "right_seq", "score")


@query(
    """WITH w AS (SELECT s_suppkey, s_nationkey AS nation, s_suppkey % 5 AS region FROM supplier), h AS (SELECT s_suppkey, n_nationkey, 1 AS p FROM w JOIN nation ON n_nationkey = nation AND n_regionkey = region
UNION ALL SELECT s_suppkey, n_nationkey, 2 FROM w JOIN nation ON n_regionkey = region), b AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY p, n_nationkey) AS n FROM h)
SELECT s_suppkey, n_nationkey AS offer_seq, p AS priority FROM b WHERE n = 1"""
)
def first_match(spark, d):
    """Each supplier's offer by the first rule that any meets: nation and region, else region."""
    wanted = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).cast("int").alias("region"))
    offers = table(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return intervals.first_match(wanted, offers, [(1, [("nation", "nation"), ("region", "region")]), (2, [("region", "region")])], ["s_suppkey"], "seq").select("s_suppkey", "offer_seq", "priority")


# --- registers ---------------------------------------------------------------

AT = dt.datetime(1996, 7, 1)
START, END = dt.datetime(1995, 1, 1), dt.datetime(1996, 12, 31)

_SLICE = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {0}, event_id {0}) AS n FROM events {1}) SELECT event_id, ts, user_id, event_type, value, props FROM r WHERE n = 1"""


@query(_SLICE.format("DESC", ""))
def slice_last_events(spark, d):
    return registers.slice_last(table(spark, d, "events"), ["user_id", "event_type"], "ts", tie=["event_id"])


@query(_SLICE.format("ASC", "WHERE value >= 50"))
def slice_first_events(spark, d):
    return registers.slice_first(table(spark, d, "events"), ["user_id", "event_type"], "ts", tie=["event_id"], condition=F.col("value") >= 50)


@query(f"WITH {MOVES_SQL} SELECT l_partkey, l_suppkey, CAST(sum(q) AS BIGINT) AS quantity_balance FROM signed WHERE period < TIMESTAMP '1996-07-01' GROUP BY l_partkey, l_suppkey")
def balance_lineitem(spark, d):
    return registers.balance(movements(spark, d), ["l_partkey", "l_suppkey"], ["quantity"], at=AT)


TURN_SQL = f"""WITH {MOVES_SQL}, t AS (
  SELECT l_suppkey, date_trunc('month', period) AS bucket, CAST(sum(CASE WHEN kind = 'Receipt' THEN quantity ELSE 0 END) AS BIGINT) AS quantity_receipt,
         CAST(sum(CASE WHEN kind = 'Expense' THEN quantity ELSE 0 END) AS BIGINT) AS quantity_expense, CAST(sum(q) AS BIGINT) AS quantity_turnover
  FROM signed {{}} GROUP BY l_suppkey, date_trunc('month', period))
"""


@query(TURN_SQL.format("WHERE period BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'") + "SELECT l_suppkey, CAST(bucket AS TIMESTAMP) AS bucket, quantity_receipt, quantity_expense, quantity_turnover FROM t")
def turnovers_month(spark, d):
    out = registers.turnovers(movements(spark, d), ["l_suppkey"], ["quantity"], start=START, end=END, every="month")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    TURN_SQL.format("")
    + """, c AS (SELECT *, sum(quantity_turnover) OVER (PARTITION BY l_suppkey ORDER BY bucket) AS closing FROM t)
SELECT l_suppkey, CAST(bucket AS TIMESTAMP) AS bucket, CAST(closing - quantity_turnover AS BIGINT) AS opening, quantity_receipt AS receipt, quantity_expense AS expense, quantity_turnover AS turnover, CAST(closing AS BIGINT) AS closing FROM c"""
)
def balance_and_turnovers(spark, d):
    return registers.balance_and_turnovers(movements(spark, d), ["l_suppkey"], "quantity").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"WITH {MOVES_SQL} SELECT l_partkey, l_suppkey, CAST(sum(q) AS BIGINT) AS quantity_balance FROM signed GROUP BY l_partkey, l_suppkey HAVING sum(q) < 0")
def negative_balances(spark, d):
    return registers.negative_balances(movements(spark, d), ["l_partkey", "l_suppkey"], "quantity")


@query(
    f"""WITH {MOVES_SQL} SELECT l_suppkey, kind, CAST(2 - grouping(l_suppkey) - grouping(kind) AS INT) AS level, CAST(sum(quantity) AS BIGINT) AS quantity_total FROM moves GROUP BY ROLLUP(l_suppkey, kind)"""
)
def totals_rollup(spark, d):
    return registers.totals(movements(spark, d), ["l_suppkey", "kind"], ["quantity"])


# --- text --------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2)"


@query(f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS token FROM documents) GROUP BY token")
def inverted_index_df(spark, d):
    return text.document_frequency(table(spark, d, "documents"), "text")


@query(f"SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token, doc_id")
def inverted_index(spark, d):
    return text.inverted_index(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT doc_id FROM t GROUP BY doc_id HAVING bool_or(contains(token, 'ing')) AND bool_or(contains(token, 'tion'))")
def inverted_index_search(spark, d):
    return text.index_search(text.inverted_index(table(spark, d, "documents"), "doc_id", "text"), "ING tion", "doc_id")


@query(
    r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x FROM pages)
SELECT page_id, count(*) AS n_lines, count(*) FILTER (trim(regexp_replace(x, '[\t\r]', '', 'g')) = '') AS n_blank, count(*) FILTER (starts_with(ltrim(replace(x, chr(9), ' ')), '//')) AS n_comment,
  count(*) - count(*) FILTER (trim(regexp_replace(x, '[\t\r]', '', 'g')) = '') - count(*) FILTER (starts_with(ltrim(replace(x, chr(9), ' ')), '//')) AS n_code FROM l GROUP BY page_id"""
)
def line_metrics(spark, d):
    return table(spark, d, "pages").select("page_id", *text.line_metrics("html"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS part FROM documents")
def line_range(spark, d):
    return table(spark, d, "documents").select("doc_id", text.line_range("text", 2, 3).alias("part"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, CAST(line AS INT) AS line, content FROM l WHERE regexp_matches(lower(content), '(^|[^\p{L}\p{N}_])license($|[^\p{L}\p{N}_])')"""
)
def usages(spark, d):
    return text.usages(table(spark, d, "documents"), ["doc_id"], "text", "License", None)


@query(
    """SELECT doc_id, sha256(coalesce(text, '')) AS whole, substr(sha256(source), 1, 16) AS short FROM documents"""
)
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"), text.short_id("source").alias("short"))


# --- vectors -----------------------------------------------------------------

_COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"


def _vector(spark: SparkSession, d: str, key: int) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == key).first()["embedding"]


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def knn_cosine(spark, d):
    return vectors.search(table(spark, d, "embeddings"), _vector(spark, d, 0), 20, id_column="vec_id").select("vec_id", "label", "score")


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 1 ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered_label(spark, d):
    return vectors.search(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, F.col("label") == 1, "vec_id").select("vec_id", "label", "score")


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 10")
def similar_to(spark, d):
    return vectors.similar(table(spark, d, "embeddings"), 7, 10, "vec_id").select("vec_id", "label", "score")


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) SELECT query_id, id, score, CAST(place AS INT) AS place FROM r WHERE place <= 5"""
)
def knn_join(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.neighbours(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, "vec_id")


@query("SELECT label, count(*) AS documents, CAST(max(len(embedding)) AS INT) AS dimension, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes FROM embeddings GROUP BY ROLLUP(label)")
def vector_stats(spark, d):
    return vectors.stats(table(spark, d, "embeddings"), "label")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 = 3")
def vector_backfill(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.missing(e, e.where("vec_id % 4 <> 3"), "vec_id").select("vec_id")


@query()
def knn_join_cells(spark, d):
    """The neighbours of every 20th vector through an index of cells; the tests measure its recall against ``knn_join``."""
    e = table(spark, d, "embeddings")
    centres = vectors.fit_cells(e, 32, id_column="vec_id")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.neighbours_in_cells(vectors.in_cells(e, centres), asked, centres, 5, 20, "vec_id")


@query()
def lsh_search(spark, d):
    return vectors.lsh_neighbours(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, "vec_id").select("vec_id", "score")


@query()
def embedded_documents(spark, d):
    return vectors.embed(table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "embedding")


# --- scalar functions --------------------------------------------------------


@query(
    r"""SELECT p_partkey, length(p_name) AS str_len, strpos(p_name, 'e') AS str_find, left(p_name, 3) AS lft, right(p_name, 3) AS rgt, substr(p_name, 2, 4) AS mid, trim(p_name) AS trim_all, upper(p_name) AS up, lower(p_type) AS low,
replace(p_name, 'e', 'E!') AS repl, CAST((length(p_name) - length(replace(p_name, 'e', ''))) AS INT) AS occurrences, CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) > lower(p_type) THEN 1 ELSE 0 END AS cmp,
starts_with(p_type, 'S') AS starts, ends_with(p_type, 'L') AS ends, CAST(unicode(p_brand) AS BIGINT) AS char_code, chr(CAST(1040 + p_size % 32 AS INT)) AS chr FROM part"""
)
def fn_string(spark, d):
    p, name = platform.call, F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", p("StrLen", name).alias("str_len"), p("СтрНайти", name, "e").alias("str_find"), p("Left", name, 3).alias("lft"), p("Прав", name, 3).alias("rgt"), p("Mid", name, 2, 4).alias("mid"),
        p("СокрЛП", name).alias("trim_all"), p("Upper", name).alias("up"), p("Lower", F.col("p_type")).alias("low"), p("StrReplace", name, "e", "E!").alias("repl"), p("StrOccurrenceCount", name, "e").alias("occurrences"),
        p("StrCompare", name, F.col("p_type")).alias("cmp"), p("StrStartsWith", F.col("p_type"), "S").alias("starts"), p("StrEndsWith", F.col("p_type"), "L").alias("ends"), p("CharCode", F.col("p_brand")).alias("char_code"),
        p("Символ", F.lit(1040) + F.col("p_size") % 32).alias("chr"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, round(l_quantity / 7, 2) AS rnd, CAST(trunc(l_extendedprice) AS BIGINT) AS int_part, least(l_quantity, 10) AS mn, greatest(l_quantity, 10) AS mx, round(pow(l_quantity, 2), 4) AS pw, round(sqrt(l_quantity), 6) AS sq,
round(exp(l_discount), 6) AS ex, round(ln(l_quantity), 6) AS lg, round(log10(l_quantity), 6) AS lg10, round(sin(l_quantity), 6) AS sn, round(atan(l_quantity), 6) AS atn FROM lineitem"""
)
def fn_math(spark, d):
    p, q = platform.call, F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", p("Round", q / 7, 2).alias("rnd"), p("Цел", F.col("l_extendedprice")).alias("int_part"), p("Min", q, F.lit(10.0)).alias("mn"), p("Макс", q, F.lit(10.0)).alias("mx"), F.round(p("Pow", q, 2.0), 4).alias("pw"),
        F.round(p("Sqrt", q), 6).alias("sq"), F.round(p("Exp", F.col("l_discount")), 6).alias("ex"), F.round(p("Log", q), 6).alias("lg"), F.round(p("Log10", q), 6).alias("lg10"), F.round(p("Sin", q), 6).alias("sn"), F.round(p("ATan", q), 6).alias("atn"),
    )


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS dd, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(isodow(o_orderdate) AS INT) AS wd, CAST(weekofyear(o_orderdate) AS INT) AS wk,
CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS bq, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS TIMESTAMP) AS em, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS bw, CAST(o_orderdate + INTERVAL 1 MONTH AS TIMESTAMP) AS next_month FROM orders"""
)
def fn_date(spark, d):
    p, x = platform.call, F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", p("Year", x).alias("y"), p("Месяц", x).alias("m"), p("Day", x).alias("dd"), p("DayOfYear", x).alias("doy"), p("WeekDay", x).alias("wd"), p("WeekOfYear", x).alias("wk"),
        p("BegOfQuarter", x).alias("bq"), p("EndOfMonth", x).alias("em"), p("НачалоНедели", x).alias("bw"), p("AddMonth", x, 1).alias("next_month"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- dialect -----------------------------------------------------------------


def dialect_schema(spark: SparkSession, d: str) -> dialect.Schema:
    """The test tables under dialect names."""
    for name in ("customer", "orders", "lineitem", "part", "nation", "events"):
        table(spark, d, name).createOrReplaceTempView(f"d_{name}")
    movements(spark, d).createOrReplaceTempView("d_moves")
    return dialect.Schema(
        tables={
            "Catalog.Контрагенты": "d_customer",
            "Catalog.Номенклатура": "d_part",
            "Catalog.Страны": "d_nation",
            "Document.Заказ": "d_orders",
            "Document.Заказ.Товары": "d_lineitem",
            "InformationRegister.События": "d_events",
            "AccumulationRegister.Остатки": "d_moves",
        },
        registers={
            "InformationRegister.События": dialect.Register(["user_id", "event_type"], ["value"], "ts", ["event_id"], others=["event_id"]),
            "AccumulationRegister.Остатки": dialect.Register(["l_partkey", "l_suppkey"], ["quantity"], "period", ["recorder", "line"], "kind"),
        },
    )


def _dialect(name: str, source: str, sql: str, **parameters) -> None:
    def run(spark, d):
        return dialect.run(spark, source, dialect_schema(spark, d), **parameters)

    run.__name__, run.__doc__ = f"dialect_{name}", f"Dialect text: {source}"
    query(sql)(run)


_dialect("select_simple", "ВЫБРАТЬ к.c_custkey КАК Код, к.c_name КАК Имя ИЗ Справочник.Контрагенты КАК к ГДЕ к.c_nationkey = &Страна И НЕ к.c_mktsegment = \"BUILDING\"", "SELECT c_custkey AS \"Код\", c_name AS \"Имя\" FROM customer WHERE c_nationkey = 3 AND c_mktsegment <> 'BUILDING'", Страна=3)
_dialect("select_with_join", "ВЫБРАТЬ з.o_orderkey КАК Номер, к.c_name КАК Клиент ИЗ Документ.Заказ КАК з ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Контрагенты КАК к ПО з.o_custkey = к.c_custkey И к.c_nationkey <= 5", "SELECT o_orderkey AS \"Номер\", c_name AS \"Клиент\" FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey <= 5")
_dialect("select_grouped", "ВЫБРАТЬ o_orderstatus КАК s, КОЛИЧЕСТВО(*) КАК n, МАКСИМУМ(o_totalprice) КАК mx ИЗ Документ.Заказ СГРУППИРОВАТЬ ПО o_orderstatus ИМЕЮЩИЕ КОЛИЧЕСТВО(*) > 10", "SELECT o_orderstatus AS s, count(*) AS n, max(o_totalprice) AS mx FROM orders GROUP BY 1 HAVING count(*) > 10")
_dialect("register_slice_last", "ВЫБРАТЬ с.user_id, с.event_type, с.event_id, с.value ИЗ РегистрСведений.События.СрезПоследних(, event_type = &Вид) КАК с", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click') WHERE n = 1", Вид="click")
_dialect("register_slice_first", "SELECT s.user_id, s.event_type, s.event_id FROM InformationRegister.События.SliceFirst(&From, value > 10 AND (value < 90 OR value > 95)) AS s", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '1970-01-01' AND value > 10 AND (value < 90 OR value > 95)) WHERE n = 1", From=dt.datetime(1970, 1, 1))
_dialect("accumulation_balance", "ВЫБРАТЬ о.l_partkey, СУММА(о.quantityОстаток) КАК rest ИЗ РегистрНакопления.Остатки.Остатки(ДАТАВРЕМЯ(1996, 7, 1), l_suppkey < 50) КАК о СГРУППИРОВАТЬ ПО о.l_partkey", f"WITH {MOVES_SQL} SELECT l_partkey, CAST(sum(q) AS BIGINT) AS rest FROM signed WHERE period < TIMESTAMP '1996-07-01' AND l_suppkey < 50 GROUP BY l_partkey")
_dialect("accumulation_turnovers", "ВЫБРАТЬ о.l_suppkey, о.period, СУММА(о.quantityОборот) КАК t, СУММА(о.quantityПриход) КАК r ИЗ РегистрНакопления.Остатки.Обороты(ДАТАВРЕМЯ(1995,1,1), ДАТАВРЕМЯ(1996,12,31), Месяц, ) КАК о СГРУППИРОВАТЬ ПО о.l_suppkey, о.period", TURN_SQL.format("WHERE period BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'") + "SELECT l_suppkey, CAST(bucket AS TIMESTAMP) AS period, quantity_turnover AS t, quantity_receipt AS r FROM t")
_dialect("batch_query", "ВЫБРАТЬ к.c_custkey ПОМЕСТИТЬ ВТ_Клиенты ИЗ Справочник.Контрагенты КАК к ГДЕ к.c_acctbal > 0; ВЫБРАТЬ в.c_custkey, КОЛИЧЕСТВО(з.o_orderkey) КАК n ИЗ ВТ_Клиенты КАК в ЛЕВОЕ СОЕДИНЕНИЕ Документ.Заказ КАК з ПО з.o_custkey = в.c_custkey СГРУППИРОВАТЬ ПО в.c_custkey", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey")
_dialect("select_top", "ВЫБРАТЬ ПЕРВЫЕ 10 o_orderkey, o_totalprice ИЗ Документ.Заказ УПОРЯДОЧИТЬ ПО o_totalprice УБЫВ, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_dialect("select_distinct", "ВЫБРАТЬ РАЗЛИЧНЫЕ o_orderstatus, o_orderpriority ИЗ Документ.Заказ", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_dialect("union", "ВЫБРАТЬ c_nationkey КАК k ИЗ Справочник.Контрагенты ОБЪЕДИНИТЬ ВЫБРАТЬ n_nationkey ИЗ Справочник.Страны", "SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation")
_dialect("union_all", "SELECT c_nationkey AS k FROM Catalog.Контрагенты UNION ALL SELECT n_nationkey FROM Catalog.Страны", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT n_nationkey FROM nation")
_dialect("subquery_in", "ВЫБРАТЬ к.c_custkey ИЗ Справочник.Контрагенты КАК к ГДЕ к.c_custkey В (ВЫБРАТЬ з.o_custkey ИЗ Документ.Заказ КАК з ГДЕ з.o_totalprice МЕЖДУ 1000 И 50000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000)")
_dialect("full_text_search", "ВЫБРАТЬ p_partkey, p_name ИЗ Справочник.Номенклатура ГДЕ p_name ПОДОБНО \"%e%\" И p_type ЕСТЬ НЕ NULL", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_type IS NOT NULL")
_dialect("case_parameters", "ВЫБРАТЬ o_orderkey, ВЫБОР КОГДА o_totalprice >= &p ТОГДА \"large\" ИНАЧЕ \"small\" КОНЕЦ КАК size ИЗ Документ.Заказ ГДЕ ГОД(o_orderdate) <= 1995", "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'large' ELSE 'small' END AS size FROM orders WHERE year(o_orderdate) <= 1995", p=100000)
_dialect("tabular_section", "ВЫБРАТЬ т.l_orderkey, СУММА(т.l_linenumber) КАК n ИЗ Документ.Заказ.Товары КАК т ВНУТРЕННЕЕ СОЕДИНЕНИЕ Документ.Заказ КАК з ПО з.o_orderkey = т.l_orderkey СГРУППИРОВАТЬ ПО т.l_orderkey", "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")


# The others register themselves.
from lodestar import queries_code, queries_state, queries_streams, queries_trees  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
