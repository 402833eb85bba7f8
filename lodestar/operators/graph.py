"""The property graph: nodes(id, node_type, name, …) and edges(edge_seq, source, target, relationship, label).

``edge_seq`` is the order in which edges were declared; every tie (which edge
explains an impact, which of several shortest paths) is broken by it, so results
do not depend on partitioning.  Traversals are level loops.  A frontier of at most
``FEW`` nodes becomes a filter that reaches the scan of the edges as they come; a larger
one is an equi-join, and from the second such join on the edges are a table in shared
storage.  A larger frontier never reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.staging import staged

EDGE_KEY = ["source", "target", "relationship", "label"]
#: How many nodes of a frontier are told to the scan one by one.
FEW = 1000
CALL, METADATA_REFERENCE, QUERY_REFERENCE = "procedure_call", "code_metadata_reference", "code_query_reference"


# --- building ----------------------------------------------------------------


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, relationship, label): the first declared.  min() combines map-side."""
    return edges.groupBy(*EDGE_KEY).agg(F.min("edge_seq").alias("edge_seq")).select("edge_seq", *EDGE_KEY)


def known_edges(edges: DataFrame, relationships: list[str]) -> DataFrame:
    """Edges of a known kind, as a stored graph is read back."""
    return edges.where(F.col("relationship").isin(*relationships))


def number_edges(edges: DataFrame) -> DataFrame:
    """edge_seq from the edges themselves, for sources that have no order of their own."""
    return edges.withColumn("edge_seq", F.xxhash64(*EDGE_KEY).bitwiseAND((1 << 63) - 1))


def merge_nodes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Nodes of both, the first graph's where both have an id."""
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"), allowMissingColumns=True)


def put_nodes(nodes: DataFrame, added: DataFrame) -> DataFrame:
    """Nodes with ``added`` replacing those of the same id."""
    return nodes.join(added.select("id"), "id", "left_anti").unionByName(added, allowMissingColumns=True)


def collapse_edges(calls: DataFrame) -> DataFrame:
    """source, target, edge_type and count from one row per call site; counted map-side, however hot an edge is."""
    return calls.groupBy("source", "target", "edge_type").agg(F.count("*").alias("count"))


def edge_locations(calls: DataFrame) -> DataFrame:
    """The call sites of collapsed edges as rows: source, target, edge_type, file, line, column, each place once."""
    return calls.select("source", "target", "edge_type", "file", "line", "column").distinct()


def merge_code_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two collapsed edge tables as one: counts add up.  Their locations are merged by union and ``distinct``."""
    return first.unionByName(second).groupBy("source", "target", "edge_type").agg(F.sum("count").alias("count"))


def resolve_through(edges: DataFrame, container: str = "DefinedType.", contains: str = "defined_type_contains") -> DataFrame:
    """Edges that lead through a type container: ref -> container -> member, keeping the first edge's kind; one hop."""
    refs = edges.where(F.col("target").startswith(container)).select("source", F.col("target").alias("via"), "relationship", "edge_seq")
    members = edges.where(F.col("source").startswith(container) & (F.col("relationship") == contains)).select(F.col("source").alias("via"), F.col("target"))
    return refs.join(members, "via").where("source <> target").groupBy("source", "target", "relationship").agg(
        F.min("edge_seq").alias("edge_seq"), F.lit("via_defined_type").alias("label")
    )


def existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node."""
    return edges.join(nodes.select(F.col("id").alias("target")).hint("merge"), "target", "left_semi")


def invalidate(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes ``ids`` (id) and every edge that touches them."""
    left = nodes.join(ids, "id", "left_anti")
    kept = edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti").join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    return left, kept


# --- one hop -----------------------------------------------------------------


def related(nodes: DataFrame, edges: DataFrame, node_id: str, relationship: str | None = None, direction: str = "both") -> DataFrame:
    """Neighbours of a node that exist, with the edge; a loop counts once, as outgoing."""
    out, into = F.col("source") == node_id, F.col("target") == node_id
    asked = {"both": out | into, "outgoing": out, "incoming": into}[direction]
    some = edges.where(asked if relationship is None else asked & (F.col("relationship") == relationship))
    way = F.when(out if direction != "incoming" else F.lit(False), "outgoing").otherwise("incoming")
    some = some.withColumn("direction", way).withColumn("neighbour", F.when(F.col("direction") == "outgoing", F.col("target")).otherwise(F.col("source")))
    return some.join(nodes.select(F.col("id").alias("neighbour"), F.col("node_type").alias("neighbour_type"), F.col("name").alias("neighbour_name")).hint("merge"), "neighbour").select(
        "edge_seq", "relationship", "label", "direction", "neighbour", "neighbour_type", "neighbour_name"
    )


def context(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Neighbours both ways with the number of connections beside each row, counted map-side."""
    found = related(nodes, edges, node_id)
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("total_connections"))))  # one row


def callers(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return related(nodes, edges, node_id, CALL, "incoming")


def callees(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return related(nodes, edges, node_id, CALL, "outgoing")


def code_references(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return related(nodes, edges.where(F.col("relationship").isin(METADATA_REFERENCE, QUERY_REFERENCE)), node_id, None, "incoming")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes ``ids`` (id) and the edges between them."""
    return nodes.join(ids, "id", "left_semi"), edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(
        ids.select(F.col("id").alias("target")), "target", "left_semi"
    )


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), name and n: counts by node type and by relationship, and the totals (name null)."""
    n = nodes.rollup("node_type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("node_type").alias("name"), "n")
    e = edges.rollup("relationship").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("relationship").alias("name"), "n")
    return n.unionByName(e)


def unused(nodes: DataFrame, edges: DataFrame, relationships: list[str] | None = None) -> DataFrame:
    """Nodes that no edge (of the relationships) points to."""
    some = edges if relationships is None else edges.where(F.col("relationship").isin(*relationships))
    return nodes.join(some.select(F.col("target").alias("id")), "id", "left_anti")


# --- traversals --------------------------------------------------------------


class _Links:
    """Edges to be met by frontiers, written once they are joined a second time."""

    def __init__(self, edges: DataFrame, tag: str):
        self.edges, self.tag, self.joins = edges, tag, 0

    def at(self, column: str, ids: DataFrame, n: int) -> DataFrame:
        """The edges whose ``column`` is one of the ``n`` nodes ``ids`` (id)."""
        if n <= FEW:
            return self.edges.where(F.col(column).isin([r["id"] for r in ids.select("id").collect()]))
        self.joins += 1
        if self.joins == 2:
            self.edges = staged(self.edges, self.tag)
        return self.edges.join(ids.select(F.col("id").alias(column)), column)


def impact(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 3) -> DataFrame:
    """Everything that depends on a node: reverse breadth-first search.

    id, node_type, name, depth (the least) and via (the edge's relationship that
    led there).  The start is left out; a source that is no node keeps null type and name.
    """
    spark = edges.sparkSession
    links = _Links(edges.select("source", "target", "relationship", "edge_seq"), "impact-edges")
    seen = spark.range(1).select(F.lit(node_id).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    frontier, n = seen.select("id"), 1
    for level in range(1, depth + 1):
        step = (
            links.at("target", frontier, n)
            .groupBy(F.col("source").alias("id"))
            .agg(F.min_by("relationship", "edge_seq").alias("via"))
            .join(seen.select("id"), "id", "left_anti")
            .select("id", F.lit(level).alias("depth"), "via")
        )
        if level < depth:
            step = staged(step, "impact-level")
            n = step.count()
        seen, frontier = seen.unionByName(step), step.select("id")
        if not n:
            break
    found = seen.where("depth > 0")
    return found.join(nodes.select("id", "node_type", "name"), "id", "left").select("id", "node_type", "name", "depth", "via")


def impact_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("depth").agg(F.count("*").alias("n"))


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """The edges of a shortest undirected path, in order (step from 1), in their own direction.

    No rows if there is none, or start and goal are the same.  Of several paths the
    one with the smallest edge_seq at every step back from the goal is taken.

    Levels grow from both ends, the smaller frontier first, until one meets the
    other; then the edges that lie on any shortest path are walked back.
    """
    spark = edges.sparkSession
    columns = ["edge_seq", "source", "target", "relationship"]
    nothing = edges.select(F.lit(0).alias("step"), *columns).limit(0)
    if start == goal:
        return nothing
    links = _Links(edges.select(*columns), "path-edges")

    def touching(ids: DataFrame, n: int) -> DataFrame:
        """Every edge at one of the ``n`` nodes ``ids`` (id), from there (at) to its other end (to)."""
        out = links.at("source", ids, n).withColumns({"at": F.col("source"), "to": F.col("target")})
        into = links.at("target", ids, n).withColumns({"at": F.col("target"), "to": F.col("source")})
        return out.unionByName(into)

    one = spark.range(1)
    sides = {k: [one.select(F.lit(k).alias("id"), F.lit(0).alias("depth"))] for k in (start, goal)}
    sizes, tick = {start: 1, goal: 1}, 0
    while True:
        here = min((start, goal), key=lambda k: sizes[k])
        other = goal if here == start else start
        known = _all(sides[here])
        step = touching(sides[here][-1], sizes[here]).select(F.col("to").alias("id")).distinct().join(known.select("id"), "id", "left_anti")
        step = staged(step.withColumn("depth", F.lit(len(sides[here]))), f"path-level{tick}")
        sides[here].append(step)
        met = F.col("other").isNotNull()
        ends = step.join(sides[other][-1].select("id", F.lit(1).alias("other")), "id", "left").agg(F.count("*").alias("n"), F.count_if(met).alias("met")).first()
        if not ends["n"]:
            return nothing
        sizes[here], tick = ends["n"], tick + 1
        if ends["met"]:
            break
    # By distance from the start: all that the start's side found, then what leads on from where both met.
    ahead, back = sides[start], sides[goal]
    layers = [x.select("id") for x in ahead[:-1]] + [staged(ahead[-1].select("id").join(back[-1].select("id"), "id", "left_semi"), "path-met")]
    for x in back[-2::-1]:
        layers.append(staged(x.select("id").join(touching(layers[-1], layers[-1].count()).select(F.col("to").alias("id")), "id", "left_semi"), "path-layer"))
    rows, at = [], goal
    for k in range(len(layers) - 1, 0, -1):
        before = layers[k - 1].select(F.col("id").alias("to"))
        here = F.col("source") == at  # a literal, which the scan of the edges filters by
        ways = links.edges.where(here | (F.col("target") == at)).withColumn("to", F.when(here, F.col("target")).otherwise(F.col("source")))
        edge = ways.join(before, "to", "left_semi").agg(F.min_by(F.struct("to", *columns), "edge_seq").alias("edge")).first()["edge"]  # one row
        rows.append((k, *[edge[c] for c in columns]))
        at = edge["to"]
    return spark.createDataFrame(rows, nothing.schema)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def dependencies(edges: DataFrame, node_id: str, depth: int = 1, outgoing: bool = True) -> DataFrame:
    """id and least depth of what a node calls (or is called by) within ``depth`` steps."""
    here, there = ("source", "target") if outgoing else ("target", "source")
    links = _Links(edges.select("source", "target"), "dependency-edges")
    seen = edges.sparkSession.range(1).select(F.lit(node_id).alias("id"), F.lit(0).alias("depth"))
    frontier, n = seen.select("id"), 1
    for level in range(1, depth + 1):
        step = links.at(here, frontier, n).select(F.col(there).alias("id")).distinct()
        step = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"))
        if level < depth:
            step = staged(step, "dependency-level")
            n = step.count()
        seen, frontier = seen.unionByName(step), step.select("id")
        if not n:
            break
    return seen.where("depth > 0")


def tree(items: DataFrame, parent: str = "parent", name: str = "name") -> DataFrame:
    """name, parent, level and path of every item under the roots (null or empty parent), however deep; no item stands below itself."""
    key = F.coalesce(F.col(parent), F.lit(""))
    held = staged(items.select(F.col(name).alias("name"), key.alias("parent")), "tree-items")
    level = held.where("parent = ''").select("name", "parent", F.lit(0).alias("level"), F.array("name").alias("trail"))
    out, children, k = level, held.where("parent <> ''").withColumnRenamed("name", "child"), 0
    while True:
        k += 1
        under = level.select(F.col("name").alias("parent"), "trail")
        below = children.join(under, "parent").where(~F.array_contains("trail", F.col("child")))
        level = staged(below.select(F.col("child").alias("name"), "parent", F.lit(k).alias("level"), F.array_append("trail", F.col("child")).alias("trail")), "tree-level")
        if level.isEmpty():
            return out.select("name", "parent", "level", F.array_join("trail", "/").alias("path"))
        out = out.unionByName(level)


# --- procedure calls ---------------------------------------------------------


def unique_names(procedures: DataFrame) -> DataFrame:
    """lower_name and id of the procedures whose name occurs once."""
    return procedures.groupBy(F.lower("name").alias("lower_name")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("lower_name", "id")


def resolve_calls(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    """caller and callee ids of calls (caller, module, name): a procedure of the same module first, else the only one of that name.

    Calls of oneself are left out.  Both sides are keyed by name, so a popular name is an ordinary (skewed) join key.
    """
    local = procedures.groupBy("module", F.lower("name").alias("lower_name")).agg(F.min("id").alias("local_id"))
    everywhere = unique_names(procedures).select("lower_name", F.col("id").alias("global_id"))
    named = calls.withColumn("lower_name", F.lower("name"))
    # Never broadcast: procedures read from texts are more than the size of their files tells.
    found = named.join(local.hint("merge"), ["module", "lower_name"], "left").join(everywhere.hint("merge"), "lower_name", "left")
    return found.withColumn("callee", F.coalesce("local_id", "global_id")).where("callee is not null and callee <> caller").drop("lower_name", "local_id", "global_id")


def dead_procedures(procedures: DataFrame, calls: DataFrame, handlers: DataFrame, include_exports: bool = False) -> DataFrame:
    """Procedures that no call names (case-insensitively) and that handle no event (handlers: name)."""
    some = procedures if include_exports else procedures.where(~F.col("is_export"))
    some = some.withColumn("lower_name", F.lower("name"))
    called = calls.select(F.lower("name").alias("lower_name")).distinct()
    handled = handlers.select(F.lower("name").alias("lower_name")).distinct()
    return some.join(called.hint("merge"), "lower_name", "left_anti").join(handled.hint("merge"), "lower_name", "left_anti").drop("lower_name").orderBy("path", "start_line")


def dependency_stats(code_edges: DataFrame, top: int = 10) -> DataFrame:
    """The most used targets per edge type: edge_type, target, uses, place (1 to ``top``)."""
    uses = code_edges.groupBy("edge_type", "target").agg(F.sum("count").alias("uses"))
    place = Window.partitionBy("edge_type").orderBy(F.desc("uses"), "target")
    return uses.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)


def at_node(column: Column, procedure: str) -> Column:
    """Whether a node id names this procedure, whatever its module."""
    return column.endswith(f"::{procedure}") | (column == procedure)
