"""The readers of configuration trees as queries over files made from the tables, with SQL that computes what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import graph, intervals, store
from lodestar.plans import catalog, templates
from lodestar.registry import query
from lodestar.session import dealt, table
from lodestar.sources import documents, trees
from lodestar.staging import staged


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _named(tag: str, *parts) -> Column:
    return _say(f"<{tag}><Properties><Name>", *parts, "</Name>")


def _bytes(rows: DataFrame, path: Column, body: Column) -> DataFrame:
    return rows.select(path.alias("path"), body.cast("binary").alias("content"))


def catalogs(spark: SparkSession, d: str) -> DataFrame:
    """One catalog per part: two attributes, one tabular section, two forms, a template; in either layout."""
    k = F.col("p_partkey")
    body = _say(
        '<MetaDataObject xmlns="urn:m" xmlns:v8="urn:v8"><Catalog uuid="u-', k, '"><Properties><Name>Part', k, "</Name>",
        "<Synonym><v8:item><v8:lang>en</v8:lang><v8:content>Part ", k, "</v8:content></v8:item>", F.when(k % 2 == 0, _say("<v8:item><v8:lang>ru</v8:lang><v8:content>Деталь ", k, "</v8:content></v8:item>")).otherwise(""),
        "</Synonym><Comment>", F.col("p_type"), "</Comment></Properties><ChildObjects>",
        _named("Attribute", "Размер"), "<Type><v8:Type>xs:decimal</v8:Type></Type><Indexing>Index</Indexing></Properties></Attribute>",
        _named("Attribute", "Вид"), "<Type><v8:Type>cfg:CatalogRef.Part", k % 10, "</v8:Type><v8:Type>cfg:DocumentRef.Order", k % 5, "</v8:Type></Type></Properties></Attribute>",
        _named("TabularSection", "Состав"), "</Properties><ChildObjects>", _named("Attribute", "Товар"), "<Type><v8:Type>cfg:CatalogRef.Part", k % 3, "</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection>",
        "<Form>ФормаЭлемента</Form><Form>Форма", k % 4, "</Form><Template>Макет</Template></ChildObjects></Catalog></MetaDataObject>",
    )
    path = F.when(k % 5 == 0, _say("file:/c/src/Catalogs/Part", k, ".catalog/Part", k, ".mdo")).otherwise(_say("file:/c/Catalogs/Part", k, ".xml"))
    return _bytes(dealt(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey"), path, body)


def others(spark: SparkSession, d: str) -> DataFrame:
    """One object per customer, of eight kinds in turn."""
    k = F.col("c_custkey")
    kinds = [
        ("Document", "Doc", _say("<Posting>Allow</Posting><RegisterRecords><v8:Item>AccumulationRegister.Acc", k - 7 + k % 8, "</v8:Item></RegisterRecords><BasedOn><v8:Item>Doc", k - 8, "</v8:Item></BasedOn><Produces><v8:Item>Doc", k + 8, "</v8:Item></Produces>"), F.lit("")),
        ("AccumulationRegister", "Acc", F.lit(""), _say(_named("Dimension", "Товар"), "<Type><v8:Type>cfg:CatalogRef.Part", k % 6, "</v8:Type></Type></Properties></Dimension>", _named("Resource", "Сумма"), "<Type><v8:Type>cfg:EnumRef.E", k % 2, "</v8:Type></Type></Properties></Resource>")),
        ("EventSubscription", "Sub", _say("<Source><v8:Type>cfg:DocumentObject.Doc", k - 2, "</v8:Type></Source><Handler>CommonModule.Module", k % 5, ".Handle</Handler>"), F.lit("")),
        ("ScheduledJob", "Job", _say("<MethodName>CommonModule.Module", k % 5, ".Run</MethodName>"), F.lit("")),
        ("DefinedType", "Def", _say("<Type><v8:Type>cfg:CatalogRef.Part", k % 6, "</v8:Type><v8:Type>cfg:DocumentRef.Doc", k - 4, "</v8:Type></Type>"), F.lit("")),
        ("CommonAttribute", "Com", _say("<AutoUse>Use</AutoUse><Content><v8:Item>Catalog.Part", k % 9, "</v8:Item></Content>"), F.lit("")),
        ("Subsystem", "System", _say("<Content><v8:Item>Catalog.Part", k % 9, "</v8:Item><v8:Item>Document.Doc", k - 6, "</v8:Item></Content>"), F.lit("")),
        ("HTTPService", "Http", _say("<RootURL>api", k, "</RootURL>"), F.lit("")),
    ]
    body = path = F.lit(None).cast("string")
    for j, (kind, name, properties, children) in enumerate(kinds):
        made = _say(f'<MetaDataObject xmlns:v8="urn:v8"><{kind} uuid="u-', k, f'"><Properties><Name>{name}', k, "</Name>", properties, "</Properties><ChildObjects>", children, f"</ChildObjects></{kind}></MetaDataObject>")
        body = F.when(k % 8 == j, made).otherwise(body)
        # Every other subsystem lies in the folder of the one before it.
        place = F.when((F.lit(j) == 6) & (k % 16 == 14), _say("file:/c/Subsystems/System", k - 8, "/Subsystems/System", k, "/System", k, ".xml")).otherwise(_say(f"file:/c/{kind}s/{name}", k, ".xml"))
        path = F.when(k % 8 == j, place).otherwise(path)
    return _bytes(dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey"), path, body)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.read_objects(catalogs(spark, d).unionByName(others(spark, d)))


PART = "'Part' || p_partkey"


@query(
    f"""SELECT {PART} AS name, 'u-' || p_partkey AS uuid, CASE WHEN p_partkey % 2 = 0 THEN 'Деталь ' ELSE 'Part ' END || p_partkey AS synonym, p_type AS comment, 'ФормаЭлемента,Форма' || p_partkey % 4 AS forms, 'Макет' AS templates,
true AS same_hash FROM part"""
)
def tree_objects(spark, d):
    files = catalogs(spark, d).select("path", F.md5("content").alias("own"))
    found = trees.read_objects(catalogs(spark, d)).join(files.hint("merge"), "path")
    return found.select("name", "uuid", "synonym", "comment", F.array_join("forms", ",").alias("forms"), F.array_join("templates", ",").alias("templates"), (F.col("own") == F.col("file_hash")).alias("same_hash"))


@query(
    f"""SELECT {PART} AS owner, '' AS section, 'Размер' AS name, 'decimal' AS type, 'decimal' AS types, true AS indexed FROM part
UNION ALL SELECT {PART}, '', 'Вид', 'cfg:CatalogRef.Part' || p_partkey % 10, 'cfg:CatalogRef.Part' || p_partkey % 10 || ',cfg:DocumentRef.Order' || p_partkey % 5, false FROM part
UNION ALL SELECT {PART}, 'Состав', 'Товар', 'cfg:CatalogRef.Part' || p_partkey % 3, 'cfg:CatalogRef.Part' || p_partkey % 3, false FROM part"""
)
def tree_attributes(spark, d):
    found = trees.read_objects(catalogs(spark, d))
    own = found.select(F.col("name").alias("owner"), F.lit("").alias("section"), F.explode("attributes").alias("a"))
    inside = found.select(F.col("name").alias("owner"), F.explode("tabular_sections").alias("s")).select("owner", F.col("s.name").alias("section"), F.explode("s.attributes").alias("a"))
    return own.unionByName(inside).select("owner", "section", "a.name", "a.type", F.array_join("a.types", ",").alias("types"), "a.indexed")


@query(
    """WITH k AS (SELECT c_custkey AS k, c_custkey % 8 AS j FROM customer)
SELECT CASE j WHEN 0 THEN 'Document' WHEN 1 THEN 'AccumulationRegister' WHEN 2 THEN 'EventSubscription' WHEN 3 THEN 'ScheduledJob' WHEN 4 THEN 'DefinedType' WHEN 5 THEN 'CommonAttribute' WHEN 6 THEN 'Subsystem' ELSE 'HTTPService' END AS metadata_type,
  CASE j WHEN 0 THEN 'Doc' WHEN 1 THEN 'Acc' WHEN 2 THEN 'Sub' WHEN 3 THEN 'Job' WHEN 4 THEN 'Def' WHEN 5 THEN 'Com' WHEN 6 THEN 'System' ELSE 'Http' END || k AS name, j = 0 AS posting,
  CASE WHEN j = 0 THEN 'AccumulationRegister.Acc' || (k - 7 + j) ELSE '' END AS register_records, CASE WHEN j = 2 THEN 'cfg:DocumentObject.Doc' || (k - 2) ELSE '' END AS event_source,
  CASE WHEN j = 2 THEN 'CommonModule.Module' || k % 5 || '.Handle' ELSE '' END AS event_handler, CASE WHEN j = 3 THEN 'CommonModule.Module' || k % 5 || '.Run' ELSE '' END AS method_name,
  CASE WHEN j = 4 THEN 'cfg:CatalogRef.Part' || k % 6 || ',cfg:DocumentRef.Doc' || (k - 4) ELSE '' END AS type_constituents, CASE WHEN j = 5 THEN 'Use' ELSE '' END AS auto_use,
  CASE j WHEN 5 THEN 'Catalog.Part' || k % 9 WHEN 6 THEN 'Catalog.Part' || k % 9 || ',Document.Doc' || (k - 6) ELSE '' END AS content, CASE WHEN j = 7 THEN 'api' || k ELSE '' END AS root_url,
  CASE WHEN j = 1 THEN 'Товар:cfg:CatalogRef.Part' || k % 6 ELSE '' END AS dimensions, CASE WHEN j = 1 THEN 'Сумма:cfg:EnumRef.E' || k % 2 ELSE '' END AS resources FROM k"""
)
def tree_kinds(spark, d):
    """Register records, sources, handlers, constituents, common content, dimensions and resources."""
    typed = lambda c: F.array_join(F.transform(c, lambda a: F.concat_ws(":", a["name"], a["type"])), ",").alias(c)
    listed = [F.array_join(c, ",").alias(c) for c in ("register_records", "event_source", "type_constituents", "content")]
    return trees.read_objects(others(spark, d)).select("metadata_type", "name", "posting", *listed, "event_handler", "method_name", "auto_use", "root_url", typed("dimensions"), typed("resources"))


EDGES_SQL = f"""
k AS (SELECT c_custkey AS k, c_custkey % 8 AS j FROM customer), tree_edges AS (
  SELECT 'Catalog.' || {PART} AS source, 'Catalog.Part' || p_partkey % 10 AS target, 'attribute_reference' AS relationship, 'Вид' AS label FROM part
  UNION ALL SELECT 'Catalog.' || {PART}, 'Document.Order' || p_partkey % 5, 'attribute_reference', 'Вид' FROM part
  UNION ALL SELECT 'Catalog.' || {PART}, 'Catalog.Part' || p_partkey % 3, 'tabular_reference', 'Состав.Товар' FROM part
  UNION ALL SELECT 'Catalog.' || {PART} || '.Form.ФормаЭлемента', 'Catalog.' || {PART}, 'form_ownership', '' FROM part
  UNION ALL SELECT 'Catalog.' || {PART} || '.Form.Форма' || p_partkey % 4, 'Catalog.' || {PART}, 'form_ownership', '' FROM part
  UNION ALL SELECT 'Document.Doc' || k, 'AccumulationRegister.Acc' || (k - 7 + j), 'register_movement', '' FROM k WHERE j = 0
  UNION ALL SELECT 'Document.Doc' || k, 'Document.Doc' || (k - 8), 'based_on', '' FROM k WHERE j = 0
  UNION ALL SELECT 'Document.Doc' || k, 'Document.Doc' || (k + 8), 'produces', '' FROM k WHERE j = 0
  UNION ALL SELECT 'AccumulationRegister.Acc' || k, 'Catalog.Part' || k % 6, 'dimension_type', 'Товар' FROM k WHERE j = 1
  UNION ALL SELECT 'AccumulationRegister.Acc' || k, 'Enum.E' || k % 2, 'resource_type', 'Сумма' FROM k WHERE j = 1
  UNION ALL SELECT 'EventSubscription.Sub' || k, 'Document.Doc' || (k - 2), 'event_subscription', '' FROM k WHERE j = 2
  UNION ALL SELECT 'EventSubscription.Sub' || k, 'CommonModule.Module' || k % 5, 'subscription_handler', '' FROM k WHERE j = 2
  UNION ALL SELECT 'ScheduledJob.Job' || k, 'CommonModule.Module' || k % 5, 'scheduled_job_method', '' FROM k WHERE j = 3
  UNION ALL SELECT 'DefinedType.Def' || k, 'Catalog.Part' || k % 6, 'defined_type_contains', '' FROM k WHERE j = 4
  UNION ALL SELECT 'DefinedType.Def' || k, 'Document.Doc' || (k - 4), 'defined_type_contains', '' FROM k WHERE j = 4
  UNION ALL SELECT 'CommonAttribute.Com' || k, 'Catalog.Part' || k % 9, 'common_attribute_usage', '' FROM k WHERE j = 5
  UNION ALL SELECT 'Catalog.Part' || k % 9, 'Subsystem.System' || k, 'subsystem_membership', '' FROM k WHERE j = 6
  UNION ALL SELECT 'Document.Doc' || (k - 6), 'Subsystem.System' || k, 'subsystem_membership', '' FROM k WHERE j = 6
  UNION ALL SELECT 'Subsystem.System' || k, 'Subsystem.System' || (k - 8), 'subsystem_hierarchy', '' FROM k WHERE k % 16 = 14)
"""


@query(f"WITH {EDGES_SQL} SELECT * FROM tree_edges")
def tree_edges(spark, d):
    return trees.edges(_tree(spark, d))


NODES_SQL = f"""
tree_nodes AS (
  SELECT 'Catalog.' || {PART} AS id FROM part
  UNION ALL SELECT 'Catalog.' || {PART} || '.Form.ФормаЭлемента' FROM part
  UNION ALL SELECT 'Catalog.' || {PART} || '.Form.Форма' || p_partkey % 4 FROM part
  UNION ALL SELECT CASE j WHEN 0 THEN 'Document.Doc' WHEN 1 THEN 'AccumulationRegister.Acc' WHEN 2 THEN 'EventSubscription.Sub' WHEN 3 THEN 'ScheduledJob.Job'
    WHEN 4 THEN 'DefinedType.Def' WHEN 5 THEN 'CommonAttribute.Com' WHEN 6 THEN 'Subsystem.System' WHEN 7 THEN 'HTTPService.Http' END || k FROM k)
"""


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT relationship, count(*) AS n FROM (SELECT DISTINCT e.* FROM tree_edges e JOIN tree_nodes ON target = id) GROUP BY relationship")
def tree_graph_build(spark, d):
    """Edges of the built graph whose targets are nodes of any type, by kind: deduplicated and joined to the nodes."""
    found = staged(_tree(spark, d), "tree")  # parsed once, read for nodes and for edges
    edges = graph.existing(graph.dedup_edges(graph.number_edges(trees.edges(found))), trees.nodes(found))
    return edges.groupBy("relationship").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 8 = 6) SELECT 'System' || k AS name, CASE WHEN k % 16 = 14 THEN 'System' || (k - 8) ELSE '' END AS parent, CASE WHEN k % 16 = 14 THEN 1 ELSE 0 END AS level, CASE WHEN k % 16 = 14 THEN 'System' || (k - 8) || '/' ELSE '' END || 'System' || k AS path FROM k")
def tree_subsystems(spark, d):
    """Subsystems as a tree, parents taken from the folders the files lie in."""
    return graph.tree(trees.subsystems(trees.read_objects(others(spark, d))))


@query("SELECT 'Catalog' AS metadata_type, 'Part' || p_partkey AS name, CASE WHEN p_partkey % 3 <> 0 THEN 'u-' || p_partkey END AS uuid FROM part")
def tree_missing_files(spark, d):
    """A listed object without a file is an empty object."""
    manifest = table(spark, d, "part").select(F.lit("Catalog").alias("type"), _say("Part", F.col("p_partkey")).alias("name"))
    found = trees.read_objects(catalogs(spark, d)).where("cast(substring(name, 5) as long) % 3 <> 0")
    return trees.listed(manifest, found).select("metadata_type", "name", "uuid")


@query("SELECT 'Catalog' AS type, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'BusinessProcess', n_name FROM nation WHERE n_nationkey % 2 = 1")
def tree_manifest(spark, d):
    """Both shapes of the manifest: children by type, and containers of items."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    children = _say("<MetaDataObject><Configuration><ChildObjects><Catalog>", name, "</Catalog></ChildObjects></Configuration></MetaDataObject>")
    container = _say("<MetaDataObject><Configuration><BusinessProcesses><item>", name, "</item></BusinessProcesses></Configuration></MetaDataObject>")
    return trees.read_manifest(_bytes(table(spark, d, "nation"), _say("file:/c/", k, "/Configuration.xml"), F.when(k % 2 == 0, children).otherwise(container)))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = _say(
        "<MetaDataObject><Role><Name>Role", k % 7, "</Name><Rights><Object path='Catalog.Part", k % 5, "'><Right><Name>Read</Name><Value>true</Value>",
        "<RestrictionByCondition>Где", k % 2, "</RestrictionByCondition></Right><Right><Name>Write</Name><Value>", F.when(k % 3 == 0, "true").otherwise("false"), "</Value></Right></Object></Rights></Role></MetaDataObject>",
    )
    return trees.read_roles(_bytes(table(spark, d, "supplier"), _say("file:/c/Roles/R", k, ".xml"), body))


@query(
    """SELECT 'Role' || s_suppkey % 7 AS role, 'Catalog.Part' || s_suppkey % 5 AS object, 'Read' AS "right", true AS value, 'Где' || s_suppkey % 2 AS rls FROM supplier
UNION ALL SELECT 'Role' || s_suppkey % 7, 'Catalog.Part' || s_suppkey % 5, 'Write', s_suppkey % 3 = 0, '' FROM supplier"""
)
def tree_roles(spark, d):
    return _roles(spark, d).withColumn("rls", F.array_join("rls", ","))


@query(
    """SELECT 'Role' || s_suppkey % 7 AS role, CASE WHEN bool_or(s_suppkey % 3 = 0) THEN 'Read,Write' ELSE 'Read' END AS rights, string_agg(DISTINCT 'Где' || s_suppkey % 2, ',' ORDER BY 'Где' || s_suppkey % 2) AS rls FROM supplier WHERE s_suppkey % 5 = 2 GROUP BY 1"""
)
def tree_rights_of(spark, d):
    found = trees.rights_of(_roles(spark, d), "catalog.PART2")
    return found.select("role", F.array_join("rights", ",").alias("rights"), F.array_join("rls", ",").alias("rls"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Modules in four encodings: UTF-8 with and without a mark, Windows-1251, and bytes that only the last fits."""
    k = F.col("n_nationkey")
    plain, ascii_ = F.encode(F.lit("Привет"), "UTF-8"), F.encode(_say(" ", F.col("n_name")), "UTF-8")
    head = F.when(k % 4 == 0, plain).when(k % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(k % 4 == 2, F.unhex(F.lit("CFF0E8E2E5F2"))).otherwise(F.unhex(F.lit("98E0A0A8")))
    path = F.when(k % 4 == 0, _say("file:/c/CommonModules/M", k, "/Ext/Module.bsl")).when(k % 4 == 1, _say("file:/c/Catalogs/C", k, "/Forms/Form1/Ext/Form/Module.bsl"))
    path = path.when(k % 4 == 2, _say("file:/c/src/Documents/D", k, ".document/ObjectModule.bsl")).otherwise(_say("file:/c/Catalogs/%D0%A2", k, "/Ext/ManagerModule.bsl"))
    return table(spark, d, "nation").select(path.alias("path"), F.concat(head, ascii_).alias("content"))


@query(
    """SELECT CASE n_nationkey % 4 WHEN 3 THEN 'Шраи' ELSE 'Привет' END || ' ' || n_name AS content, CASE n_nationkey % 4 WHEN 0 THEN 'CommonModules' WHEN 2 THEN 'Documents' ELSE 'Catalogs' END AS owner_type,
CASE n_nationkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'Т' END || n_nationkey AS owner, CASE n_nationkey % 4 WHEN 2 THEN 'ObjectModule' WHEN 3 THEN 'ManagerModule' ELSE 'Module' END AS module FROM nation"""
)
def tree_modules(spark, d):
    """Modules by path, their text by the first encoding that fits."""
    return trees.read_modules(_sources(spark, d)).drop("path")


_OWNERS = """o AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'CommonModule.M' WHEN 2 THEN 'Document.D' WHEN 3 THEN 'Catalog.Т' ELSE 'Catalog.C' END || n_nationkey AS owner,
CASE n_nationkey % 4 WHEN 0 THEN 'CommonModule' WHEN 1 THEN 'FormModule' WHEN 2 THEN 'ObjectModule' ELSE 'ManagerModule' END AS module_type FROM nation)"""


@query(f"WITH {_OWNERS} SELECT owner || '.Module.' || module_type AS id, module_type AS name, owner FROM o")
def tree_module_nodes(spark, d):
    """Modules as nodes, each with the edge to the object it belongs to."""
    owned = trees.owned_modules(trees.read_modules(_sources(spark, d)))
    edges = trees.module_edges(owned).select(F.col("source").alias("id"), F.col("target").alias("owner"))
    return trees.module_nodes(owned).join(edges, "id").select("id", "name", "owner")


@query(
    """SELECT 'Catalog.Part' || p_partkey AS source, 'file:/c/Catalogs/Part' || p_partkey || '/Ext/ObjectModule.bsl::Расчет' || p_partkey || '_' || i AS target, 'procedure_ownership' AS relationship FROM part, unnest(range(1 + p_partkey % 3)) AS u(i)
UNION ALL SELECT 'Catalog.Part' || p_partkey || '.Module.ObjectModule', 'Catalog.Part' || p_partkey, 'module_ownership' FROM part"""
)
def tree_procedure_edges(spark, d):
    """From objects to the procedures of their modules, and from modules to their objects."""
    from lodestar.functions import code
    from lodestar.queries_code import modules

    found = modules(spark, d).select(F.concat(F.lit("file:/c/"), "path").alias("path"), F.encode("content", "UTF-8").alias("content"))
    read = staged(trees.read_modules(found), "modules")
    return trees.module_edges(trees.owned_modules(read), code.extract(read, "procedures")).select("source", "target", "relationship")


@query(
    f"""WITH {EDGES_SQL} SELECT DISTINCT source AS id, relationship AS via FROM tree_edges WHERE target = 'Catalog.Part7'"""
)
def tree_dependents(spark, d):
    """What depends on a catalog at one step: its forms and its users, and not the subsystems that list it."""
    found = staged(_tree(spark, d), "tree")
    edges = graph.dedup_edges(graph.number_edges(trees.edges(found)))
    return edges.where("target = 'Catalog.Part7'").select(F.col("source").alias("id"), F.col("relationship").alias("via")).distinct()


# --- extensions, reports, grids, forms ---------------------------------------


def _extensions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = _say(
        "<MetaDataObject><Configuration><Name>Ext", k, "</Name><Properties><Purpose>Customization</Purpose><NamePrefix>E", k, "_</NamePrefix></Properties><ChildObjects>",
        '<Catalog Adopted="true" Replaced="true">Part', k % 20, '</Catalog><Catalog Replaced="true" parent="Part', k % 15, '">E_Part</Catalog><Document>Own', k, "</Document></ChildObjects></Configuration></MetaDataObject>",
    )
    return documents.read_extensions(_bytes(table(spark, d, "supplier"), _say("file:/e/", k, "/Configuration.xml"), body))


EXT_SQL = """ext AS (SELECT 'Ext' || s_suppkey AS extension, 'Catalog' AS metadata_type, 'Part' || s_suppkey % 20 AS name, 'Adopted' AS mode, '' AS parent FROM supplier
  UNION ALL SELECT 'Ext' || s_suppkey, 'Catalog', 'E_Part', 'Replaced', 'Part' || s_suppkey % 15 FROM supplier UNION ALL SELECT 'Ext' || s_suppkey, 'Document', 'Own' || s_suppkey, 'Own', '' FROM supplier)"""


@query(f"WITH {EXT_SQL} SELECT extension, metadata_type, name, mode, parent FROM ext")
def extension_objects(spark, d):
    return _extensions(spark, d).select("extension", "metadata_type", "name", "mode", "parent")


@query(f"WITH {EXT_SQL} SELECT extension, name FROM ext WHERE mode = 'Own' AND extension = 'Ext3'")
def extension_own(spark, d):
    return documents.with_mode(_extensions(spark, d), "Ext3", "Own").select("extension", "name")


@query(
    f"""WITH {EXT_SQL}, x AS (SELECT *, 'Extension.' || extension || '.' || metadata_type || '.' || name AS id, CASE WHEN parent = '' THEN name ELSE parent END AS base FROM ext)
SELECT 'Extension.' || extension AS source, id AS target, 'extension_owns' AS relationship FROM x
UNION ALL SELECT id, 'Catalog.' || base, CASE mode WHEN 'Adopted' THEN 'extension_adopts' ELSE 'extension_replaces' END FROM x JOIN part ON base = 'Part' || p_partkey WHERE mode <> 'Own' AND metadata_type = 'Catalog'"""
)
def extension_edges(spark, d):
    main = table(spark, d, "part").select(F.lit("Catalog").alias("metadata_type"), _say("Part", F.col("p_partkey")).alias("name"))
    return documents.extension_edges(_extensions(spark, d), main)


@query(f"WITH {EXT_SQL} SELECT extension, mode FROM ext WHERE metadata_type = 'Catalog' AND name = 'Part7'")
def extension_impact(spark, d):
    return documents.extension_impact(_extensions(spark, d), "Catalog", "Part7")


@query(
    """SELECT 'r' || n_nationkey AS report, part, owner, name, expression FROM nation, (VALUES ('data_set', '', 'Main', 'SELECT 1'), ('data_set', '', 'Inner', 'SELECT 2'), ('field', 'Main', 'Client', ''), ('parameter', '', 'From', ''), ('resource', '', 'Sum', 'sum(Sum)'), ('setting', '', 'Base', '')) v(part, owner, name, expression)"""
)
def report_schema_parts(spark, d):
    """Data sets (those within a union too), fields, parameters, resources and settings."""
    body = F.lit(
        "<DataCompositionSchema><DataSet><Name>Main</Name><Type>DataSetUnion</Type><Query>SELECT 1</Query><Field><DataPath>Client</DataPath></Field><DataSet><Name>Inner</Name><Query>SELECT 2</Query></DataSet></DataSet>"
        "<Parameter><Name>From</Name></Parameter><TotalField><DataPath>Sum</DataPath><Expression>sum(Sum)</Expression></TotalField><SettingsVariants><SettingsVariant><Name>Base</Name></SettingsVariant></SettingsVariants></DataCompositionSchema>"
    )
    found = documents.read_report_schemas(_bytes(table(spark, d, "nation"), _say("r", F.col("n_nationkey")), body))
    return found.select(F.col("path").alias("report"), "part", "owner", "name", "expression")


@query("SELECT o_orderstatus, CAST(sum(1) AS BIGINT) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY o_orderstatus")
def report_resources(spark, d):
    """Resources of a report: aggregates by their expressions."""
    return documents.run_report(table(spark, d, "orders"), ["o_orderstatus"], [("n", "sum(1)"), ("top", "round(max(o_totalprice), 2)")])


@query("SELECT c_nationkey AS k, 'c' AS side, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT s_nationkey, 's', count(*) FROM supplier GROUP BY s_nationkey")
def report_union(spark, d):
    """A report over a union of data sets: columns by name, rows of both."""
    sets = [table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")), table(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("k"))]
    return documents.run_report(documents.union_sets(sets), ["k", "side"], [("n", "count(1)")])


def _grids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    body = _say(
        "<SpreadsheetDocument><Rows><Row><Cell><Text>Title [Org", k, "]</Text></Cell></Row><Row><Cell><Text>[Item]</Text></Cell><Cell><Text>{Qty * ", k, "} &lt;b&gt; &lt;Name&gt; [Item]</Text></Cell></Row>",
        "<Row><Cell><MergeDown>2</MergeDown><MergeRight>", k % 3 + 1, "</MergeRight><Text>Wide</Text></Cell><Cell><Text>After</Text></Cell><Cell><ColumnSpan>2</ColumnSpan></Cell><Cell><Parameter>Param</Parameter></Cell></Row></Rows>",
        "<Areas><Area><Name>Header</Name><Top>1</Top><Bottom>1</Bottom></Area><Area><Name>Строка</Name><Top>2</Top><Bottom>2</Bottom></Area><Area><Name>Left</Name><Left>1</Left><Right>1</Right></Area></Areas></SpreadsheetDocument>",
    )
    return _bytes(table(spark, d, "nation"), _say("g", k), body)


@query(
    """SELECT 'g' || n_nationkey AS doc, row, CAST(col + CASE WHEN row = 3 AND col > 1 THEN n_nationkey % 3 ELSE 0 END AS INT) AS col, n_rows, CAST(CASE WHEN text = 'Wide' THEN n_nationkey % 3 + 1 ELSE 1 END AS INT) AS n_cols, replace(text, '#', CAST(n_nationkey AS VARCHAR)) AS text
FROM nation, (VALUES (1, 1, 1, 'Title [Org#]'), (2, 1, 1, '[Item]'), (2, 2, 1, '{Qty * #} <b> <Name> [Item]'), (3, 1, 2, 'Wide'), (3, 2, 1, 'After'), (3, 5, 1, '[Param]')) v(row, col, n_rows, text)"""
)
def grid_cells(spark, d):
    return documents.read_cells(_grids(spark, d))


@query("SELECT 'g' || n_nationkey AS doc, name, kind FROM nation, (VALUES ('Header', 'header'), ('Строка', 'row'), ('Left', 'other')) v(name, kind)")
def grid_areas(spark, d):
    return documents.read_areas(_grids(spark, d)).select("doc", "name", "kind")


@query("SELECT 'g' || n_nationkey AS doc, row, col, area FROM nation, (VALUES (1, 1, 'Header'), (2, 1, 'Строка'), (2, 2, 'Строка'), (1, 1, 'Left'), (2, 1, 'Left'), (3, 1, 'Left')) v(row, col, area)")
def grid_cells_in_areas(spark, d):
    held = _grids(spark, d)
    return intervals.cells_in_areas(documents.read_cells(held), documents.read_areas(held)).select("doc", "row", "col", "area")


@query(
    """SELECT 'g' || n_nationkey AS doc, replace(name, '#', CAST(n_nationkey AS VARCHAR)) AS name, is_expression, row, CAST(col + CASE WHEN row = 3 THEN n_nationkey % 3 ELSE 0 END AS INT) AS col FROM nation, (VALUES ('Org#', false, 1, 1), ('Item', false, 2, 1), ('Qty * #', true, 2, 2), ('Name', false, 2, 2), ('Param', false, 3, 5)) v(name, is_expression, row, col)"""
)
def grid_parameters(spark, d):
    return documents.parameters(documents.read_cells(_grids(spark, d)))


@query("SELECT 'Catalogs' AS owner_type, 'Part' || p_partkey AS owner, 'Макет' || p_partkey % 3 AS template FROM part WHERE p_partkey % 4 = 0")
def grid_templates(spark, d):
    """Templates of a tree by their paths; other files are none."""
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, _say("file:/c/Catalogs/Part", k, "/Templates/Макет", k % 3, "/Ext/Template.xml")).otherwise(_say("file:/c/Catalogs/Part", k, ".xml"))
    return documents.located_templates(table(spark, d, "part").select(path.alias("path"))).drop("path")


@query(
    """SELECT 'f' || n_nationkey AS path, part, id, parent, kind, replace(name, '#', CAST(n_nationkey AS VARCHAR)) AS name, detail FROM nation, (VALUES ('handler', 1, 0, 'event', 'OnOpen', 'Opened'), ('element', 2, 0, 'UsualGroup', 'Top#', ''),
('element', 3, 2, 'InputField', 'Code', 'Object.Code'), ('handler', 4, 3, 'event', 'OnChange', 'Changed'), ('attribute', 5, 0, 'Attribute', 'Object', 'cfg:CatalogObject.Goods'), ('command', 6, 0, 'Command', 'Go', 'GoAction')) v(part, id, parent, kind, name, detail)"""
)
def form_parts(spark, d):
    """Elements with their parents, attributes, commands and handlers."""
    k = F.col("n_nationkey")
    body = _say(
        '<Form><Events><Event name="OnOpen">Opened</Event></Events><ChildItems><UsualGroup name="Top', k, '"><ChildItems><InputField name="Code"><DataPath>Object.Code</DataPath><Events><Event name="OnChange">Changed</Event></Events></InputField></ChildItems></UsualGroup></ChildItems>',
        '<Attributes><Attribute name="Object"><Type><Type>cfg:CatalogObject.Goods</Type></Type></Attribute></Attributes><Commands><Command name="Go"><Action>GoAction</Action></Command></Commands></Form>',
    )
    return documents.read_forms(_bytes(table(spark, d, "nation"), _say("f", k), body))


# --- knowledge and templates -------------------------------------------------


def _index(spark: SparkSession, d: str) -> DataFrame:
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    methods = catalog.entries("method", part.withColumnRenamed("p_name", "name"), "name", "p_brand", "p_type")
    kinds = catalog.entries("type", nation.withColumnRenamed("n_name", "name"), "name", F.lit("a type of place"))
    return catalog.index(methods.unionByName(kinds))


_FOUND = "SELECT DISTINCT 'method' AS kind, p_name AS name FROM part WHERE list_bool_or(list_transform(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: contains(t, '{}') AND length(t) >= 2)) AND list_bool_or(list_transform(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: contains(t, '{}') AND length(t) >= 2))"


@query(_FOUND.format("an", "br"))
def knowledge_search_methods(spark, d):
    return catalog.search(_index(spark, d), "AN br", "method")


@query(_FOUND.format("an", "an") + " UNION ALL SELECT 'type', n_name FROM nation WHERE contains(lower(n_name), 'an')")
def knowledge_search_all(spark, d):
    return catalog.search(_index(spark, d), "an")


@query("SELECT n_nationkey, n_name AS name FROM nation WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation) OR n_nationkey = 7")
def knowledge_named(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.concat(F.lit("Country"), "n_nationkey").alias("name_en"))
    first = rows.agg(F.min("name")).first()[0]
    return catalog.named(rows, first.upper()).unionByName(catalog.named(rows, "COUNTRY7")).distinct().select("n_nationkey", "name")


@query("SELECT n_nationkey AS seq, n_name AS name FROM nation WHERE n_nationkey % 3 = 1")
def knowledge_events_of(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(k.alias("seq"), F.col("n_name").alias("name"), F.array(F.when(k % 3 == 1, "Document").otherwise("Catalog")).alias("object_types"))
    return catalog.events_of(rows, "document").drop("object_types")


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, name = F.col("n_nationkey"), F.col("n_name")
    nation = table(spark, d, "nation")
    procedures = F.array(F.struct(_say("Get", name).alias("name"), F.lit(True).alias("exported"), F.lit("()").alias("signature"), _say("reads ", k).alias("description")))
    modules = nation.select(k.alias("seq"), name.alias("name"), F.lit("Server").alias("kind"), _say("module of region ", F.col("n_regionkey")).alias("purpose"), F.array(F.when(k % 2 == 0, "even").otherwise("odd")).alias("tags"), procedures.alias("procedures"))
    region = table(spark, d, "region")
    hooks = region.select(F.col("r_regionkey").alias("seq"), _say("On", F.col("r_name")).alias("name"), F.lit("Overrides").alias("module"), F.lit("called before").alias("purpose"), F.lit("").alias("template"))
    patterns = region.select(F.col("r_regionkey").alias("seq"), _say("Use", F.col("r_name")).alias("name"), F.lit("print").alias("task"), F.lit("a recipe").alias("description"), F.array().cast("array<string>").alias("modules"), F.lit("").alias("example"))
    return modules, hooks, patterns


_LIBRARY_SQL = """WITH a AS (
  SELECT 'module' AS kind, CAST(NULL AS VARCHAR) AS module, n_name AS name, 'module of region ' || n_regionkey AS purpose, n_name || ' module of region ' || n_regionkey || ' ' || CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS hay, 0 AS a, n_nationkey AS b, 0 AS c FROM nation
  UNION ALL SELECT 'procedure', n_name, 'Get' || n_name, 'reads ' || n_nationkey, 'Get' || n_name || ' reads ' || n_nationkey, 0, n_nationkey, 1 FROM nation
  UNION ALL SELECT 'hook', 'Overrides', 'On' || r_name, 'called before', 'On' || r_name || ' Overrides called before', 1, r_regionkey, 0 FROM region
  UNION ALL SELECT 'pattern', NULL, 'Use' || r_name, 'print', 'Use' || r_name || ' print a recipe', 2, r_regionkey, 0 FROM region)
SELECT kind, module, name, purpose FROM a """


@query(_LIBRARY_SQL + "WHERE contains(lower(hay), 'as')")
def knowledge_find(spark, d):
    return catalog.find(*_library(spark, d), " AS ", None)


@query(_LIBRARY_SQL + "WHERE contains(lower(hay), 're') ORDER BY a, b, c LIMIT 10")
def knowledge_find_limit(spark, d):
    return catalog.find(*_library(spark, d), "re")


@query(_LIBRARY_SQL + "WHERE kind = 'hook'")
def knowledge_hooks(spark, d):
    return catalog.find(*_library(spark, d), "Хуки", None)


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def knowledge_tagged(spark, d):
    return catalog.tagged(_library(spark, d)[0], "even").select("name")


def _templates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as code templates: the brand is the category, the words of the type are tags."""
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("name_ru"), F.lit("").alias("description"), F.lit("").alias("description_ru"),
        F.col("p_brand").alias("category"), F.split(F.lower("p_type"), " ").alias("tags"), F.lit("").alias("template_code"),
    )


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS category FROM part WHERE contains(lower(p_partkey || ' ' || p_name || ' ' || p_type), 'red') OR contains(lower(p_name), 'red')")
def template_search(spark, d):
    return templates.search(_templates(spark, d), "RED").select("id", "category")


@query("SELECT p_brand AS category, count(*) AS n FROM part GROUP BY p_brand")
def template_categories(spark, d):
    return templates.categories(_templates(spark, d))


@query("SELECT count(*) AS templates, count(DISTINCT p_brand) AS categories, (SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS x FROM part)) AS tags FROM part")
def template_stats(spark, d):
    return templates.stats(_templates(spark, d))


@query(
    """WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, round(least(CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'green') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(p_name), 'steel') OR contains(lower(p_name), 'green') THEN 0.2 ELSE 0 END
  + CASE WHEN contains(lower(p_type), 'small') OR contains(lower(p_name), 'small') THEN 0.2 ELSE 0 END, 1.0), 6) AS score FROM part) SELECT id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10"""
)
def template_suggest(spark, d):
    return templates.suggest(_templates(spark, d), "a steel or green", "Small").select("id", "score")


@query(
    """SELECT l_orderkey AS recorder, CAST(o_orderdate AS TIMESTAMP) AS period, 'Receipt' AS kind, l_partkey AS "Товар", CAST(o_custkey AS BIGINT) AS "Клиент", CAST(NULL AS VARCHAR) AS "Нет" FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def movement_rows(spark, d):
    """Register rows of documents: one per line, fields mapped by type and name."""
    heads = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").cast("long").alias("Контрагент"), "o_orderdate")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("Номенклатура"))
    mapping = templates.map_fields([("Товар", "CatalogRef.Part"), ("Клиент", "CatalogRef.Customer"), ("Нет", "Number")], [("Контрагент", "CatalogRef.Customer")], [("Номенклатура", "CatalogRef.Part")])
    return templates.movement_rows(heads, lines, "ref", mapping, "o_orderdate")


# --- texts of objects --------------------------------------------------------


@query(
    """SELECT p_partkey, 'Object: ' || p_name || chr(10) || 'Comment: ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Attributes: Size, Brand' ELSE '' END AS content FROM part"""
)
def metadata_texts(spark, d):
    attributes = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Size"), F.lit("Brand"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", text.metadata_text(F.col("p_name"), F.lit(""), F.col("p_type"), attributes, F.array().cast("array<string>")).alias("content"))


@query(
    """SELECT c_custkey, 'Customer.' || c_name AS full_name, lower(trim('  ' || c_mktsegment)) AS normal, 'Find By Code' || c_custkey AS words, '/srv/a b/' || c_custkey AS path FROM customer"""
)
def name_helpers(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", store.full_name(F.lit("Customer"), F.col("c_name")).alias("full_name"), text.normal_name(F.concat(F.lit("  "), "c_mktsegment")).alias("normal"),
        F.array_join(text.camel_words(_say("FindByCode", k)), " ").alias("words"), text.file_path(_say("FILE:///srv/a%20b/", k)).alias("path"),
    )


@query("SELECT 'Customer' AS metadata_type, c_name AS name, md5(c_mktsegment) AS file_hash FROM customer WHERE c_custkey = 3")
def stored_hash(spark, d):
    rows = table(spark, d, "customer").select(F.lit("Customer").alias("metadata_type"), F.col("c_custkey").cast("string").alias("name"), F.md5("c_mktsegment").alias("file_hash"), "c_name")
    one = store.stored_hash(rows, "Customer", "3")
    return rows.join(one, "file_hash", "left_semi").where("name = '3'").select("metadata_type", F.col("c_name").alias("name"), "file_hash")


@query("SELECT p_partkey, p_size % 3 = 0 AS skipped, CASE WHEN p_size % 3 = 0 THEN 'Сумма' ELSE 'Сумма,Цена' END AS numeric FROM part")
def numeric_attributes(spark, d):
    """Numeric attributes that are not obsolete."""
    one = lambda n, t: F.struct(n.alias("name"), F.lit(t).alias("type"))
    name = F.when(F.col("p_size") % 3 == 0, "УдалитьЦена").otherwise("Цена")
    held = F.array(one(F.lit("Сумма"), "Число"), one(F.lit("Имя"), "Строка"), one(name, "Number"))
    return table(spark, d, "part").select("p_partkey", store.should_skip(name).alias("skipped"), F.array_join(F.transform(store.numeric_attributes(held), lambda a: a["name"]), ",").alias("numeric"))
