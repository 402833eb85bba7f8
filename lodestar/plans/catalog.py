"""Bundled knowledge as tables: the platform's methods, types and events, and a library's modules, hooks and patterns.

Catalogs are JSON documents that Spark reads itself; every lookup is a plan over the
resulting tables, and the search goes through one inverted index of all entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import text

_PARAMETERS = "array<struct<name:string,name_en:string,types:array<string>,required:boolean,description:string>>"
_METHOD = f"name string, name_en string, description string, parameters {_PARAMETERS}, return_types array<string>, category string, keywords array<string>"
_METHODS = f"array<struct<{_METHOD.replace(' string', ':string').replace(' array', ':array')}>>"
_PROPERTIES = "array<struct<name:string,name_en:string,description:string,types:array<string>,readable:boolean,writable:boolean>>"
METHODS = f"version string, sections array<struct<name:string,name_en:string,description:string,methods:{_METHODS}>>"
TYPES = f"types array<struct<name:string,name_en:string,description:string,category:string,keywords:array<string>,constructors:{_METHODS},methods:{_METHODS},properties:{_PROPERTIES}>>"
EVENTS = "events array<struct<name:string,name_en:string,description:string,category:string,object_types:array<string>,execution_context:string,can_cancel:boolean,execution_order:int>>"
MODULES = "modules array<struct<name:string,kind:string,purpose:string,tags:array<string>,procedures:array<struct<name:string,exported:boolean,signature:string,description:string>>>>"
HOOKS = "hooks array<struct<name:string,module:string,purpose:string,template:string>>"
PATTERNS = "patterns array<struct<name:string,task:string,description:string,modules:array<string>,example:string>>"
# Words that ask for a whole category.
CATEGORY_WORDS = {
    "hook": ("хук", "хуки", "hook", "hooks", "переопределяемый"),
    "pattern": ("паттерн", "паттерны", "pattern", "patterns"),
    "module": ("модуль", "модули", "module", "modules"),
}


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON documents at ``path``, one row each."""
    return spark.read.schema(T._parse_datatype_string(schema)).option("multiLine", True).json(path)


def methods(found: DataFrame) -> DataFrame:
    """seq, section, section_en and the fields of every global method (rows of METHODS)."""
    sections = found.select(F.posexplode("sections").alias("at", "s"))
    each = sections.select("at", F.col("s.name").alias("section"), F.col("s.name_en").alias("section_en"), F.posexplode("s.methods").alias("k", "m"))
    return each.select((F.col("at") * 10_000 + F.col("k")).alias("seq"), "section", "section_en", "m.*")


def types(found: DataFrame) -> DataFrame:
    """seq and the fields of every type, its methods and properties as arrays (rows of TYPES)."""
    return found.select(F.posexplode("types").alias("seq", "t")).select("seq", "t.*")


def events(found: DataFrame) -> DataFrame:
    return found.select(F.posexplode("events").alias("seq", "e")).select("seq", "e.*")


def members(kinds: DataFrame, column: str) -> DataFrame:
    """type, type_en and the fields of the types' ``methods``, ``properties`` or ``constructors``."""
    return kinds.select(F.col("name").alias("type"), F.col("name_en").alias("type_en"), F.explode(column).alias("m")).select("type", "type_en", "m.*")


def named(rows: DataFrame, name: str, columns: tuple[str, ...] = ("name", "name_en")) -> DataFrame:
    """The entries of that name, in either language and any case."""
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(c) == name.lower(), F.lit(False)) for c in columns]))


def sections(found: DataFrame) -> DataFrame:
    """section, section_en and how many methods each section of the global context has."""
    return found.groupBy("section", "section_en").agg(F.count("*").alias("n"))


def events_of(found: DataFrame, object_type: str) -> DataFrame:
    """Events that an object type raises (any case)."""
    return found.where(F.exists("object_types", lambda t: F.lower(t) == object_type.lower()))


def entries(kind: str, rows: DataFrame, *texts: str | Column) -> DataFrame:
    """kind, name and the text under which an entry is found; arrays count as all their items."""
    parts = [F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit("")) for t in texts]
    return rows.select(F.lit(kind).alias("kind"), "name", F.concat_ws(" ", *parts).alias("text"))


def index(found: DataFrame) -> DataFrame:
    """token, kind and name, once each."""
    return found.select(F.explode(F.array_distinct(text.tokens("text"))).alias("token"), "kind", "name").distinct()


def search(index: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """kind and name of the entries that hold, for every token of the query, some token that contains it."""
    some = index if kind is None else index.where(F.col("kind") == kind)
    held = some.withColumn("ref", F.struct("kind", "name"))
    return text.index_search(held, query, "ref").select("ref.kind", "ref.name")


# --- a library's knowledge ---------------------------------------------------


def library(found: DataFrame, what: str) -> DataFrame:
    """seq and the fields of the ``modules``, ``hooks`` or ``patterns`` of a document."""
    return found.select(F.posexplode(what).alias("seq", "x")).select("seq", "x.*")


def tagged(modules: DataFrame, tag: str | None = None) -> DataFrame:
    return modules if tag is None else modules.where(F.array_contains("tags", tag))


def find(modules: DataFrame, hooks: DataFrame, patterns: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """kind, module, name and purpose of what holds the query as a substring, any case: modules with their procedures, hooks, patterns, in the order listed.

    The name of a category lists all of it; an empty query finds nothing.
    """
    q = query.lower().strip()
    asked = next((kind for kind, words in CATEGORY_WORDS.items() if q in words), None)
    none = F.lit(None).cast("string")

    def part(kind: str, rows: DataFrame, module: Column, purpose: str, order: list[Column], *texts: Column) -> DataFrame:
        hit = F.lit(kind == asked) if asked else F.lower(F.concat_ws(" ", *texts)).contains(q)
        return rows.where(hit).select(F.array(*[o.cast("long") for o in order]).alias("place"), F.lit(kind).alias("kind"), module.alias("module"), "name", F.col(purpose).alias("purpose"))

    inside = modules.select("seq", F.col("name").alias("owner"), F.posexplode("procedures").alias("k", "p")).select("seq", "owner", "k", "p.*")
    words = [F.col("name"), F.col("purpose"), F.array_join("tags", " ")]
    out = (
        part("module", modules, none, "purpose", [F.lit(0), F.col("seq"), F.lit(0)], *words)
        .unionByName(part("procedure", inside, F.col("owner"), "description", [F.lit(0), F.col("seq"), F.col("k") + 1], F.col("name"), F.col("description")))
        .unionByName(part("hook", hooks, F.col("module"), "purpose", [F.lit(1), F.col("seq")], F.col("name"), F.col("module"), F.col("purpose")))
        .unionByName(part("pattern", patterns, none, "task", [F.lit(2), F.col("seq")], F.col("name"), F.col("task"), F.col("description")))
    )
    out = out.orderBy("place") if q else out.limit(0)
    return (out if limit is None or not q else out.limit(limit)).drop("place")
