"""One place to ask: the tools by their names, over the tables of a configuration tree.

A workspace reads a tree once (``refresh`` takes in changes) and answers every tool as
a DataFrame.  Tools that evaluate code on a live system, talk to one, or only print a
form are not offered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import code, compare, text
from lodestar.operators import graph, index, registers, store, vectors
from lodestar.plans import catalog, dialect, templates
from lodestar.sources import documents, trees
from lodestar.staging import staged

TOOLS: dict[str, Callable[..., DataFrame]] = {}
#: Types that config-objects and its kin list.
CONFIG_TYPES = {"options": "FunctionalOption", "constants": "Constant", "scheduled_jobs": "ScheduledJob", "event_subscriptions": "EventSubscription", "exchanges": "ExchangePlan", "http_services": "HTTPService"}


def tool(name: str):
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TOOLS[name] = f
        return f

    return put


class Workspace:
    """The tables behind the tools.

    root: the tree; overlays: trees whose objects stand over the root's, the last over
    all; home: where its tables are kept; knowledge and templates: the catalogs of
    ``plans.catalog`` and a table of code templates, where there are any.
    """

    def __init__(self, spark: SparkSession, root: str, home: str, library: tuple[DataFrame, DataFrame, DataFrame] | None = None, platform: dict[str, DataFrame] | None = None, code_templates: DataFrame | None = None, overlays: list[str] | None = None):
        self.overlays = list(overlays or [])
        self.spark, self.root, self.home, self.library, self.platform, self.code_templates = spark, root, home, library, platform or {}, code_templates
        self.refresh()

    def refresh(self) -> DataFrame:
        """Take in what changed in the tree; all derived tables are made anew when next asked for."""
        counts = index.refresh(trees.overlaid(self.spark, [self.root, *self.overlays]), self.home)
        for name in [k for k, v in type(self).__dict__.items() if isinstance(v, cached_property)]:
            self.__dict__.pop(name, None)
        return counts

    def run(self, tool_name: str, /, **arguments) -> DataFrame:
        if tool_name not in TOOLS:
            raise ValueError(f"no tool {tool_name!r}")
        return TOOLS[tool_name](self, **arguments)

    @cached_property
    def objects(self) -> DataFrame:
        return store.current(self.spark, f"{self.home}/objects")

    @cached_property
    def embeddings(self) -> DataFrame:
        """Descriptions of objects, and chunks of code once those are indexed."""
        found = store.current(self.spark, f"{self.home}/embeddings")
        found = found.withColumns({"doc_type": F.lit("metadata"), "object_type": F.split_part("id", F.lit("."), F.lit(1)), "module_type": F.lit(None).cast("string")})
        of_code = store.current(self.spark, f"{self.home}/code_embeddings")
        if of_code is None:
            return found
        path = F.regexp_replace(text.base_id("id"), "::[^:]*$", "")
        owned = self.owned.select(F.col("path").alias("__path"), F.split_part("owner", F.lit("."), F.lit(1)).alias("object_type"), "module_type")
        of_code = of_code.withColumn("__path", path).join(owned, "__path", "left")
        return found.unionByName(of_code.select(*found.columns))

    @cached_property
    def modules(self) -> DataFrame:
        found = staged(trees.modules(self.spark, self.root), "modules")
        kind = F.create_map(*[x for k, v in code.FOLDERS.items() for x in (F.lit(k), F.lit(v))])
        return found.withColumn("owner_type", F.coalesce(kind[F.col("owner_type")], "owner_type"))

    @cached_property
    def procedures(self) -> DataFrame:
        found = code.extract(self.modules, "procedures").join(self.modules.select("path", "owner_type", "owner", F.col("module").alias("module_name")), "path")
        return staged(found.withColumn("id", code.procedure_id("path", "name")), "procedures")

    @cached_property
    def calls(self) -> DataFrame:
        return staged(code.with_procedure(code.extract(self.modules, "calls"), self.procedures), "calls")

    @cached_property
    def references(self) -> DataFrame:
        return staged(code.with_procedure(code.extract(self.modules, "references"), self.procedures), "references")

    @cached_property
    def resolved(self) -> DataFrame:
        sites = self.calls.where("containing_procedure is not null").select(code.procedure_id("path", "containing_procedure").alias("caller"), F.col("path").alias("module"), "name", "line")
        return graph.resolve_calls(sites, self.procedures.select("id", F.col("path").alias("module"), "name"))

    @cached_property
    def nodes(self) -> DataFrame:
        own = trees.nodes(self.objects).unionByName(trees.module_nodes(self.owned)).select("id", "node_type", "name")
        return staged(own.unionByName(self.procedures.select("id", F.lit("Procedure").alias("node_type"), "name")), "nodes")

    @cached_property
    def owned(self) -> DataFrame:
        """Modules that lie in an indexed object's folder."""
        return trees.owned_modules(self.modules).join(self.objects.select(store.full_name().alias("owner")).distinct(), "owner", "left_semi")

    @cached_property
    def edges(self) -> DataFrame:
        named = lambda rows, kind: rows.select("source", "target", F.lit(kind).alias("relationship"), F.lit("").alias("label"))
        calls = named(self.resolved.select(F.col("caller").alias("source"), F.col("callee").alias("target")), graph.CALL)
        uses = named(code.metadata_edges(self.references), graph.METADATA_REFERENCE)
        queries = code.with_procedure(code.extract(self.modules, "queries"), self.procedures, "start_line")
        reads = named(code.query_edges(queries), graph.QUERY_REFERENCE)
        found = trees.edges(self.objects).unionByName(trees.module_edges(self.owned, self.procedures)).unionByName(calls).unionByName(uses).unionByName(reads)
        return staged(graph.existing(graph.dedup_edges(graph.number_edges(found)), self.nodes), "edges")

    @cached_property
    def rights(self) -> DataFrame:
        return trees.roles(self.spark, self.root)

    @cached_property
    def extensions(self) -> DataFrame:
        return documents.extensions(self.spark, self.root)

    def of(self, rows: DataFrame, type: str, name: str, module: str | None = None) -> DataFrame:  # noqa: A002
        some = rows.where((F.lower("owner_type") == type.lower()) & (F.lower("owner") == name.lower()))
        column = "module_name" if "module_name" in rows.columns else "module"
        return some if module is None else some.where(F.lower(column) == module.lower())

    def chosen(self, type: str | None = None, name: str | None = None, module: str | None = None, path: str | None = None) -> DataFrame:  # noqa: A002
        if path:
            return self.modules.where(F.col("path").endswith(path))
        return self.of(self.modules, type, name, module) if type and name else self.modules

    def about(self, rows: DataFrame, type: str, name: str, module: str | None = None) -> DataFrame:  # noqa: A002
        return rows.join(self.of(self.modules, type, name, module).select("path"), "path", "left_semi")


# --- metadata ----------------------------------------------------------------


@tool("metadata-init")
def _init(w, full_reindex=False, overlay_roots=None):
    if overlay_roots is not None:
        w.overlays = list(overlay_roots)
    if full_reindex:
        index.reset(w.spark, w.home)
    return w.refresh()


@tool("metadata-list")
def _list(w, type):  # noqa: A002
    return store.of_type(w.objects, type).select("metadata_type", "name", "synonym")


@tool("metadata-get")
def _get(w, type, name):  # noqa: A002
    return store.point(w.objects, type, name)


@tool("metadata-search")
def _search(w, query, type=None, limit=50):  # noqa: A002
    some = w.objects if type is None else w.objects.where(F.col("metadata_type") == type)
    return store.token_search(some.select("metadata_type", "name", "synonym"), query, limit=limit)


@tool("metadata-tree")
def _tree(w, parent=None):
    found = graph.tree(trees.subsystems(w.objects))
    return found if parent is None else found.where(F.col("parent") == parent)


@tool("metadata-attributes")
def _attributes(w, type, name, include_tabular=True):  # noqa: A002
    one = store.point(w.objects, type, name)
    own = one.select(F.lit("").alias("section"), F.explode("attributes").alias("a"))
    if include_tabular:
        own = own.unionByName(one.select(F.explode("tabular_sections").alias("s")).select(F.col("s.name").alias("section"), F.explode("s.attributes").alias("a")))
    return own.select("section", "a.*")


@tool("metadata-forms")
def _forms(w, type, name):  # noqa: A002
    return store.point(w.objects, type, name).select(F.explode("forms").alias("form"))


@tool("metadata-templates")
def _templates(w, type, name):  # noqa: A002
    return store.point(w.objects, type, name).select(F.explode("templates").alias("template"))


@tool("metadata-registers")
def _registers(w, document):
    return store.point(w.objects, "Document", document).select(F.explode("register_records").alias("register"))


@tool("metadata-references")
def _references(w, type, name):  # noqa: A002
    return trees.edges(store.point(w.objects, type, name)).where(F.col("source") == f"{type}.{name}").select("target", "relationship", "label")


# --- configuration -----------------------------------------------------------


@tool("config-objects")
def _objects(w, type, name=None):  # noqa: A002
    return store.of_type(w.objects, CONFIG_TYPES.get(type, type)) if name is None else store.point(w.objects, CONFIG_TYPES.get(type, type), name)


def _config(kind: str, columns: list[str]):
    def run(w, name=None, **_):
        return _objects(w, kind, name).select("name", "synonym", *columns)

    return run


for _kind, _columns in {
    "options": ["content"],
    "constants": [],
    "scheduled_jobs": ["method_name"],
    "event_subscriptions": ["event_source", "event_handler"],
    "exchanges": ["attributes", "content"],
    "http_services": ["root_url", "url_templates"],
}.items():
    TOOLS[f"config-{_kind}"] = _config(_kind, _columns)


@tool("config-roles")
def _roles(w, name=None):
    some = w.rights if name is None else w.rights.where(F.col("role") == name)
    return some.groupBy("role").agg(F.countDistinct("object").alias("objects"), F.count_if("value").alias("granted"))


@tool("config-role-rights")
def _role_rights(w, object_name, right_type=None):
    return trees.rights_of(w.rights, object_name, right_type)


def _compared(spark: SparkSession, left: str, right: str) -> DataFrame:
    sides = [trees.objects(spark, p).select("metadata_type", "name", "file_hash") for p in (left, right)]
    return store.diff(*sides, ["metadata_type", "name"], ["file_hash"])


@tool("config-compare")
def _compare(w, path_a, path_b, metadata_type=None, include_modules=False):
    """Objects by status; with the modules, also each procedure that differs, and how many of its lines came and went."""
    found = _compared(w.spark, path_a, path_b)
    found = found if metadata_type is None else found.where(F.col("metadata_type") == metadata_type)
    if not include_modules:
        return found
    below = f"/((?:{'|'.join(code.FOLDERS)})/.*)$"
    plain = lambda root: trees.modules(w.spark, root).withColumn("path", F.regexp_extract("path", below, 1)).where("path <> ''")
    both = staged(compare.procedures(plain(path_a), plain(path_b)), "compared")
    lines = compare.changed_lines(both).groupBy("path", "name").agg(F.count_if(F.col("change") == "added").alias("lines_added"), F.count_if(F.col("change") == "removed").alias("lines_removed"))
    differ = both.where("status <> 'same'").join(lines, ["path", "name"], "left")
    if metadata_type is not None:
        kinds = F.create_map(*[x for k, v in code.FOLDERS.items() for x in (F.lit(k), F.lit(v))])
        differ = differ.where(kinds[F.split_part("path", F.lit("/"), F.lit(1))] == metadata_type)
    rows = differ.select(F.lit("Procedure").alias("metadata_type"), F.concat_ws("::", "path", "name").alias("name"), "status", "lines_added", "lines_removed")
    return found.unionByName(rows, allowMissingColumns=True)


@tool("diff-configurations")
def _diff(w, left, right):
    return store.diff_summary(_compared(w.spark, left, right))


# --- code --------------------------------------------------------------------


@tool("code-module")
def _module(w, type, name, module=None):  # noqa: A002
    return w.of(w.modules, type, name, module)


@tool("code-procedure")
def _procedure(w, type, name, procedure, module=None):  # noqa: A002
    return w.of(w.procedures, type, name, module).where(F.lower("name") == procedure.lower())


@tool("code-resolve")
def _resolve(w, identifier, path=None):
    found = w.procedures.where(F.lower("name") == identifier.lower())
    return (found if path is None else found.where(F.col("path").endswith(path))).select("path", "name", "start_line", "signature")


@tool("code-usages")
def _usages(w, identifier, path=None, limit=100):
    return text.usages(w.chosen(path=path), ["path"], "content", identifier, limit)


@tool("code-dependencies")
def _dependencies(w, type, name, procedure=None, module=None, depth=1):  # noqa: A002
    if procedure:
        start = _procedure(w, type, name, procedure, module).select("id").first()
        links = w.edges.where(F.col("relationship").isin(graph.CALL, graph.METADATA_REFERENCE, graph.QUERY_REFERENCE))
        return graph.dependencies(links, start["id"] if start else "", depth)
    own = w.about(w.procedures, type, name, module).select(F.col("id").alias("source"))
    return w.edges.join(own, "source", "left_semi").select("source", "target", "relationship")


@tool("code-analyze")
def _analyze(w, type, name, module=None, analysis_type="calls"):  # noqa: A002
    kinds = {"calls": w.calls, "references": w.references}
    rows = kinds[analysis_type] if analysis_type in kinds else code.extract(w.of(w.modules, type, name, module), analysis_type)
    return w.about(rows, type, name, module)


@tool("code-callgraph")
def _callgraph(w, type, name, procedure, module=None, direction="both"):  # noqa: A002
    own = _procedure(w, type, name, procedure, module).select("id")
    out = w.resolved.join(own.withColumnRenamed("id", "caller"), "caller", "left_semi").select(F.lit("callee").alias("direction"), F.col("callee").alias("id"))
    into = w.resolved.join(own.withColumnRenamed("id", "callee"), "callee", "left_semi").select(F.lit("caller").alias("direction"), F.col("caller").alias("id"))
    return {"both": out.unionByName(into), "callees": out, "callers": into}[direction].distinct()


@tool("code-validate")
def _validate(w, type=None, name=None, module=None, path=None):  # noqa: A002
    return code.extract(w.chosen(type, name, module, path), "issues")


@tool("code-lint")
def _lint(w, type=None, name=None, module=None, path=None, severity_filter=None):  # noqa: A002
    some = w.chosen(type, name, module, path)
    found = code.review(some).unionByName(code.extract(some, "issues").select("path", "line", F.col("code").alias("rule"), "severity"))
    return found if severity_filter is None else found.where(F.col("severity") == severity_filter)


@tool("code-format")
def _format(w, type=None, name=None, module=None, path=None):  # noqa: A002
    return code.format_modules(w.chosen(type, name, module, path))


@tool("code-complexity")
def _complexity(w, type=None, name=None, module=None, path=None, threshold=None):  # noqa: A002
    found = code.extract(w.chosen(type, name, module, path), "complexity")
    return found if threshold is None else found.where(F.col("cyclomatic") > threshold)


@tool("code-dead-code")
def _dead(w, metadata_type=None, include_exports=False, limit=None):
    some = w.procedures if metadata_type is None else w.procedures.where(F.lower("owner_type") == metadata_type.lower())
    handlers = w.objects.select(F.element_at(F.split("event_handler", r"\."), -1).alias("name")).unionByName(w.objects.select(F.element_at(F.split("method_name", r"\."), -1).alias("name")))
    events = documents.forms(w.spark, w.root).where("part = 'handler'").select(F.col("detail").alias("name"))
    found = graph.dead_procedures(some, w.calls, handlers.unionByName(events), include_exports).select("path", "name", "start_line")
    return found if limit is None else found.limit(limit)


# --- knowledge ---------------------------------------------------------------


@tool("bsp-find")
def _bsp_find(w, query, limit=10):
    return catalog.find(*w.library, query, limit)


@tool("bsp-hook")
def _bsp_hook(w, name):
    return catalog.named(w.library[1], name, ("name",))


@tool("bsp-modules")
def _bsp_modules(w, tag=None):
    return catalog.tagged(w.library[0], tag)


@tool("bsp-review")
def _bsp_review(w, code_text):
    return code.review(w.spark.createDataFrame([("", code_text)], "path string, content string")).drop("path")


@tool("platform-method")
def _platform_method(w, name, type_name=None):
    if type_name is None:
        return catalog.named(w.platform["methods"], name)
    return catalog.named(catalog.members(catalog.named(w.platform["types"], type_name), "methods"), name)


@tool("platform-type")
def _platform_type(w, name):
    return catalog.named(w.platform["types"], name)


@tool("platform-event")
def _platform_event(w, name, object_type=None):
    found = catalog.named(w.platform["events"], name)
    return found if object_type is None else catalog.events_of(found, object_type)


@tool("platform-search")
def _platform_search(w, query, category=None, limit=None):
    listed = lambda c: F.array_join(c, " ")
    methods = catalog.entries("method", w.platform["methods"], "name", "name_en", "description", listed("keywords"))
    kinds = catalog.entries("type", w.platform["types"], "name", "name_en", "description", listed("keywords"))
    events = catalog.entries("event", w.platform["events"], "name", "name_en", "description", listed("object_types"))
    found = catalog.search(catalog.index(methods.unionByName(kinds).unionByName(events)), query, category).orderBy("kind", "name")
    return found if limit is None else found.limit(limit)


@tool("platform-global_context")
def _global_context(w, section=None):
    return catalog.sections(w.platform["methods"]) if section is None else w.platform["methods"].where((F.col("section") == section) | (F.col("section_en") == section))


# --- graph -------------------------------------------------------------------


@tool("graph.build")
def _build(w, force=False):
    if force:
        w.refresh()
    return graph.stats(w.nodes, w.edges)


@tool("graph.stats")
def _stats(w):
    return graph.stats(w.nodes, w.edges)


@tool("graph.impact")
def _impact(w, node_id, depth=3):
    return graph.impact(w.nodes, w.edges, node_id, depth)


@tool("graph.related")
def _related(w, node_id, relationship=None):
    return graph.related(w.nodes, w.edges, node_id, relationship)


@tool("graph.path")
def _path(w, source, target):
    return graph.shortest_path(w.edges, source, target)


@tool("graph.context")
def _context(w, node_id):
    return graph.context(w.nodes, w.edges, node_id)


@tool("graph-callers")
def _callers(w, node_id):
    return graph.callers(w.nodes, w.edges, node_id)


@tool("graph-callees")
def _callees(w, node_id):
    return graph.callees(w.nodes, w.edges, node_id)


@tool("graph-code-references")
def _code_references(w, node_id):
    return graph.code_references(w.nodes, w.edges, node_id)


# --- embeddings --------------------------------------------------------------


@tool("embedding.index")
def _embedding_index(w, scope="all"):
    """scope: metadata, code or all."""
    w.refresh()
    if scope in ("code", "all"):
        index.index_code(index.code_chunks(w.modules, w.procedures), w.home)
        w.__dict__.pop("embeddings", None)
    return vectors.stats(w.embeddings if scope == "all" else w.embeddings.where((F.col("doc_type") == "metadata") == (scope == "metadata")))


@tool("embedding.search")
def _embedding_search(w, query, doc_type=None, object_type=None, limit=20, module_type=None):
    some = w.embeddings
    for column, value in (("doc_type", doc_type), ("object_type", object_type), ("module_type", module_type)):
        some = some if value is None else some.where(F.col(column) == value)
    return vectors.search(some, vectors.hash_vector(query).tolist(), limit).select("id", "content", "score")


@tool("embedding.similar")
def _embedding_similar(w, doc_id, limit=10):
    return vectors.similar(w.embeddings, doc_id, limit).select("id", "content", "score")


@tool("embedding.stats")
def _embedding_stats(w):
    return vectors.stats(w.embeddings)


# --- extensions, reports, forms, grids ---------------------------------------


@tool("extension-list")
def _extension_list(w):
    return w.extensions.select("extension", "purpose", "namespace").distinct()


@tool("extension-objects")
def _extension_objects(w, name):
    return documents.with_mode(w.extensions, name)


@tool("extension-impact")
def _extension_impact(w, type, name):  # noqa: A002
    return documents.extension_impact(w.extensions, type, name)


def _schema(w, name, parts):
    found = documents.report_schemas(w.spark, w.root).where(F.col("path").contains(f"/{name}/"))
    return found if parts is None else found.where(F.col("part").isin(*parts))


for _tool, _parts in {"composition-get": None, "composition-fields": ["field", "calculated", "resource"], "composition-datasets": ["data_set"], "composition-settings": ["setting"]}.items():
    TOOLS[_tool] = lambda w, name, _parts=_parts: _schema(w, name, _parts)


def _form(w, type, name, form, part):  # noqa: A002
    found = documents.forms(w.spark, w.root).where(F.col("path").contains(f"/{name}/") & F.col("path").contains(f"/{form}/"))
    return found if part is None else found.where(F.col("part") == part)


for _tool, _part in {"form-get": None, "form-handlers": "handler", "form-attributes": "attribute"}.items():
    TOOLS[_tool] = lambda w, type, name, form, _part=_part: _form(w, type, name, form, _part)


def _grid(w, file_path):
    return w.spark.read.format("binaryFile").load(file_path).select("path", "content")


@tool("template-get")
def _template_get(w, file_path):
    return documents.read_cells(_grid(w, file_path))


@tool("template-parameters")
def _template_parameters(w, file_path):
    return documents.parameters(documents.read_cells(_grid(w, file_path)))


@tool("template-areas")
def _template_areas(w, file_path):
    return documents.read_areas(_grid(w, file_path))


@tool("template-find")
def _template_find(w, config_path):
    return documents.template_files(w.spark, config_path)


# --- code templates ----------------------------------------------------------


@tool("pattern-list")
def _pattern_list(w, category=None):
    return w.code_templates if category is None else w.code_templates.where(F.col("category") == category)


@tool("pattern-get")
def _pattern_get(w, template_id):
    return w.code_templates.where(F.col("id") == template_id)


@tool("pattern-search")
def _pattern_search(w, query, category=None, tags=None):
    return templates.search(w.code_templates, query, category, tags)


@tool("pattern-suggest")
def _pattern_suggest(w, task_description, current_module_type="", current_object_type=""):
    return templates.suggest(w.code_templates, task_description, current_object_type, current_module_type)


@tool("pattern-apply")
def _pattern_apply(w, template_id, values):
    found = w.code_templates.where(F.col("id") == template_id).select("template_code").first()
    if found is None:
        raise ValueError(f"no template {template_id!r}")
    return w.spark.createDataFrame([(template_id, templates.substitute(found["template_code"], values))], "id string, code string")


for _tool in ("generate-query", "generate-handler", "generate-movement", "generate-api", "generate-form_handler", "generate-subscription", "generate-scheduled_job"):
    TOOLS[_tool] = _pattern_apply


# --- queries -----------------------------------------------------------------


@tool("query-parse")
def _query_parse(w, query_text):
    p = dialect.parse(query_text)
    rows = [("field", f["alias"] or f["expression"], f["expression"]) for f in p.select_fields] + [("table", t["alias"] or t["table_name"], t["table_name"]) for t in p.tables]
    rows += [("condition", c["operator"], f"{c['left_operand']} {c['operator']} {c['right_operand']}") for c in p.conditions] + [("group", g, g) for g in p.group_by] + [("order", o["field"], o["direction"]) for o in p.order_by]
    rows += [("parameter", x, x) for x in p.parameters] + [("temp_table", x, x) for x in p.temp_tables]
    return w.spark.createDataFrame(rows, "part string, name string, text string")


def _reviewed(w, query_text, available=None):
    return dialect.review(w.spark.createDataFrame([(query_text,)], "query_text string"), available)


@tool("query-validate")
def _query_validate(w, query_text, available_tables=None):
    return _reviewed(w, query_text, available_tables).select("is_valid", "errors", "warnings", "unknown_tables")


@tool("query-optimize")
def _query_optimize(w, query_text):
    return w.spark.createDataFrame([(a["kind"], a["text"]) for a in dialect.suggest(dialect.parse(query_text))], "kind string, text string")


@tool("query-explain")
def _query_explain(w, query_text):
    return _reviewed(w, query_text).select("explanation")


@tool("query-tables")
def _query_tables(w, query_text):
    rows = [(t["table_name"], t["alias"], t["is_virtual_table"], t["virtual_table_type"]) for t in dialect.parse(query_text).tables]
    return w.spark.createDataFrame(rows, "table_name string, alias string, is_virtual_table boolean, virtual_table_type string")


@tool("runtime-query")
def _runtime_query(w, query, schema, parameters=None):
    return dialect.run(w.spark, query, schema, **(parameters or {}))


@tool("runtime-data")
def _runtime_data(w, table, guid, column="ref"):
    return table.where(F.col(column) == guid)


@tool("smart-query")
def _smart_query(w, object_name, include_tabular=None):
    kind, _, name = object_name.partition(".")
    found = store.point(w.objects, kind, name).select("attributes", "tabular_sections").first()
    if found is None:
        raise ValueError(f"no object {object_name!r}")
    fields = [(a["name"], "Ref" in (a["type"] or "") or "Ссылка" in (a["type"] or "")) for a in found["attributes"]]
    section = next(((s["name"], [a["name"] for a in s["attributes"]]) for s in found["tabular_sections"] if s["name"] == include_tabular), None)
    return w.spark.createDataFrame([(templates.object_query(kind, name, fields, section),)], "query_text string")


@tool("smart-movement")
def _smart_movement(w, document_name, register_name, movement_type=None):
    """Which field of the document fills which field of the register, and the kind of movement."""
    document = store.point(w.objects, "Document", document_name).select("attributes", "tabular_sections").first()
    register = w.objects.where(F.col("name") == register_name).select("dimensions", "resources").first()
    if document is None or register is None:
        raise ValueError(f"no document {document_name!r} or no register {register_name!r}")
    typed = lambda rows: [(a["name"], a["type"]) for a in rows or []]
    section = document["tabular_sections"][0]["attributes"] if document["tabular_sections"] else []
    mapping = templates.map_fields(typed(register["dimensions"]) + typed(register["resources"]), typed(document["attributes"]), typed(section))
    kind = registers.detect_movement(register_name, movement_type)
    return w.spark.createDataFrame([(field, at[0] if at else None, at[1] if at else None, kind) for field, at in mapping.items()], "field string, side string, from_field string, kind string")


@tool("test-data-generate")
def _test_data(w, type, name, count=10, seed=0):  # noqa: A002
    found = store.point(w.objects, type, name).select("attributes").first()
    return templates.test_rows(w.spark, [(a["name"], a["type"]) for a in (found["attributes"] if found else [])], count, seed)
