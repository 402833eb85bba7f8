"""The index job: a scan of files against stored tables, and what depends on them.

One refresh reads the files, passes over those whose hash is known, parses the rest,
takes in what is new or changed, drops what is gone, and then does the same to all
that was derived from an object: its graph node, the edges that start at it, and its
embeddings.  All five tables change in one commit, so a refresh that fails leaves them
as they were, one that is repeated finds nothing to do, and readers see whole states only.
Files and objects lie in parts by path, what is derived in parts by object, so a change
of a few files rewrites the parts of these only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import code, text
from lodestar.operators import graph, store, vectors
from lodestar.operators.tables import Change, Tables
from lodestar.sources import trees
from lodestar.staging import staged

KEY = ["metadata_type", "name"]
#: Files to a part, as a table is first written, and parts at most.
FILES_EACH, MOST_PARTS = 2000, 1024


def refresh(found: DataFrame, home: str, parts: int | None = None) -> DataFrame:
    """Bring the tables under ``home`` up to the files (path, content) found; returns status and n (added, changed, removed, same).

    Run twice on the same files, the second run changes nothing.  If another writer
    changes the tables meanwhile, the work is done again on its state.  parts: into how
    many the tables are cut at the first refresh; by default so many that each holds
    about ``FILES_EACH`` files.
    """
    counts: list[DataFrame] = []
    Tables(found.sparkSession, home).transact(lambda change: counts.append(_refreshed(found, change, parts)))
    return counts[-1]


def _bucket(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _parts(keys: DataFrame, n: int) -> list[str]:
    """The parts that hold these keys (one column); at most ``n``."""
    return sorted(str(r["b"]) for r in keys.select(_bucket(keys.columns[0], n).alias("b")).distinct().collect())


def _refreshed(found: DataFrame, change: Change, parts: int | None) -> DataFrame:
    files = found.withColumn("file_hash", F.md5("content"))
    known = change.read("files")  # files that hold no object are known too
    known = (files.limit(0) if known is None else known).select("path", F.col("file_hash").alias("known"))
    state = files.join(known, "path", "full_outer").select(
        "path", "content", "file_hash",
        F.when(F.col("known").isNull(), "added").when(F.col("file_hash").isNull(), "removed").when(F.col("file_hash") != F.col("known"), "changed").otherwise("same").alias("status"),
    )
    state = staged(state.withColumn("content", F.when(F.col("status").isin("added", "changed"), F.col("content"))), "index-state")
    counts = staged(state.groupBy("status").agg(F.count("*").alias("n")), "index-counts")
    moved = state.where("status <> 'same'")
    if not moved.isEmpty():
        # The number of parts is that of the first refresh.
        n = change.note("files").get("parts") or parts or max(4, min(MOST_PARTS, 1 << (state.count() // FILES_EACH).bit_length()))
        touched = _parts(moved.select("path"), n)
        fresh = staged(trees.read_objects(state.where("content is not null").select("path", "content")), "index-fresh")
        stale = state.where("status in ('removed', 'changed')").select("path").hint("merge")
        stored = change.read("objects", touched)
        gone, kept = fresh.limit(0).select(*KEY), fresh
        if stored is not None:
            gone = staged(stored.join(stale, "path", "left_semi").select(*KEY), "index-gone")
            kept = stored.join(stale, "path", "left_anti").unionByName(fresh)
        change.write_parts("objects", kept, _bucket("path", n), emptied=touched)
        here = state.where((F.col("status") != "removed") & _bucket("path", n).isin([int(b) for b in touched]))
        change.write_parts("files", here.select("path", "file_hash"), _bucket("path", n), emptied=touched, note={"parts": n})
        _cascade(change, fresh, gone, n)
    return counts


def _cascade(change: Change, fresh: DataFrame, gone: DataFrame, n: int) -> None:
    """Nodes, edges and embeddings of changed and removed objects go, those of new ones come; forms and edges go with the object that declares them."""
    ids = gone.select(store.full_name().alias("id")).hint("merge")  # may be all that there is
    touched = _parts(gone.select(store.full_name().alias("id")).unionByName(fresh.select(store.full_name().alias("id"))), n)
    declared = graph.number_edges(trees.edges(fresh, owner=True)).groupBy("owner", *graph.EDGE_KEY).agg(F.min("edge_seq").alias("edge_seq"))
    for name, made, key in (
        ("nodes", trees.nodes(fresh), trees.owner_of("id")),
        ("edges", declared, F.col("owner")),
        ("embeddings", embeddings(fresh), text.base_id("id")),
    ):
        old = change.read(name, touched)
        kept = made if old is None else old.withColumn("__of", key).join(ids.select(F.col("id").alias("__of")), "__of", "left_anti").drop("__of").unionByName(made)
        change.write_parts(name, kept, _bucket(key, n), emptied=touched)


def embeddings(objects: DataFrame) -> DataFrame:
    """id, content and embedding of every object's description."""
    names = lambda c: F.transform(c, lambda a: a["name"])
    content = text.metadata_text(store.full_name(), F.col("synonym"), F.col("comment"), names("attributes"), names("tabular_sections"))
    return vectors.embed(objects.select(store.full_name().alias("id"), content.alias("content")))


def code_chunks(modules: DataFrame, procedures: DataFrame) -> DataFrame:
    """id, doc_type and content of what is embedded of the code: chunks of every procedure, and of every module's source.

    modules: path, content, owner, module; procedures: as extracted, with path.
    """
    key = F.concat_ws(".", "owner", "module")
    of = modules.select("path", key.alias("__of"))
    named = procedures.join(of.hint("merge"), "path").withColumn("owner", F.col("__of"))
    parts = text.procedure_chunks(named.withColumn("base", code.procedure_id("path", "name")), ["base"]).withColumn("doc_type", F.lit("procedure"))
    sources = text.module_chunks(modules.withColumn("base", F.col("path")), ["base"]).withColumn("doc_type", F.lit("module"))
    both = parts.unionByName(sources).withColumn("id", text.chunk_id("base", "chunk_index", "chunk_total"))
    # Procedures of one name in one module share an id; the first content by code point stands for it.
    return both.groupBy("id", "doc_type").agg(F.min("content").alias("content"))


def index_code(chunks: DataFrame, home: str) -> DataFrame:
    """Bring the embeddings of code up to ``chunks`` (id, doc_type, content); returns how many were embedded, kept and dropped.

    A chunk whose id and content are known keeps its embedding, so a repeated or
    resumed run embeds only what is new.
    """
    counts: list[DataFrame] = []
    chunks = staged(chunks.withColumn("content_hash", F.md5("content")), "code-chunks")
    key = ["id", "doc_type", "content_hash"]

    def put(change: Change) -> None:
        held = change.read("code_embeddings")
        held = vectors.embed(chunks.limit(0)) if held is None else held
        fresh = staged(vectors.embed(chunks.join(held.select(*key).hint("merge"), key, "left_anti")), "code-fresh")
        kept = held.join(chunks.select(*key).hint("merge"), key, "left_semi")
        change.write("code_embeddings", kept.select(*fresh.columns).unionByName(fresh))
        told = [fresh.select(F.lit("embedded").alias("status")), kept.select(F.lit("kept").alias("status")), held.join(chunks.select(*key).hint("merge"), key, "left_anti").select(F.lit("dropped").alias("status"))]
        counts.append(staged(told[0].unionByName(told[1]).unionByName(told[2]).groupBy("status").agg(F.count("*").alias("n")), "code-counts"))

    Tables(chunks.sparkSession, home).transact(put)
    return counts[-1]


def reset(spark: SparkSession, home: str) -> None:
    """Forget all that was indexed, every table at once; the next refresh reads all files."""

    def forget(change: Change) -> None:
        for name in ("files", "objects", "nodes", "edges", "embeddings", "code_embeddings"):
            if change.read(name) is not None:
                change.drop(name)

    Tables(spark, home).transact(forget)


def save_graph(nodes: DataFrame, edges: DataFrame, home: str) -> None:
    """Replace the stored graph, both tables at once; edges are deduplicated."""

    def put(change: Change) -> None:
        change.write("nodes", nodes)
        change.write("edges", graph.dedup_edges(edges))

    Tables(nodes.sparkSession, home).transact(put)


def load_graph(spark: SparkSession, home: str, relationships: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stored graph of one version, with the edges of known kinds."""
    tables = Tables(spark, home)
    version = tables.manifest()["version"]
    return tables.read("nodes", version=version), graph.known_edges(tables.read("edges", version=version), relationships)


def save_code_graph(edges: DataFrame, locations: DataFrame, home: str, writer: str | None = None, batch: int | None = None) -> None:
    """Counts add to the stored ones; the locations of the edges saved replace theirs.

    Two writers at once both count.  With a ``writer`` and its ``batch`` number, a
    repeated call counts once.
    """
    key = ["source", "target", "edge_type"]

    def add(change: Change) -> None:
        before, places = change.read("code_edges"), change.read("code_locations")
        change.write("code_edges", edges if before is None else graph.merge_code_edges(before, edges))
        change.write("code_locations", locations if places is None else places.join(locations.select(*key).distinct(), key, "left_anti").unionByName(locations))

    Tables(edges.sparkSession, home).transact(add, writer, batch)
