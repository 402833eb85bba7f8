"""Every tool by its name, on one small tree."""

import pytest
from pyspark.sql import functions as F

from lodestar.plans import catalog, dialect
from lodestar.workspace import TOOLS, Workspace

GOODS = '<MetaDataObject><Catalog uuid="1"><Properties><Name>Goods</Name><Synonym><item><lang>ru</lang><content>Товары</content></item></Synonym></Properties><ChildObjects><Attribute><Properties><Name>Unit</Name><Type><Type>cfg:CatalogRef.Units</Type></Type></Properties></Attribute><Form>Item</Form><Template>Card</Template></ChildObjects></Catalog></MetaDataObject>'
UNITS = '<MetaDataObject><Catalog uuid="2"><Properties><Name>Units</Name></Properties></Catalog></MetaDataObject>'
SALE = '<MetaDataObject><Document uuid="3"><Properties><Name>Sale</Name><RegisterRecords><Item>AccumulationRegister.Stock</Item></RegisterRecords></Properties><ChildObjects><TabularSection><Properties><Name>Lines</Name></Properties><ChildObjects><Attribute><Properties><Name>Item</Name><Type><Type>cfg:CatalogRef.Goods</Type></Type></Properties></Attribute></ChildObjects></TabularSection></ChildObjects></Document></MetaDataObject>'
STOCK = '<MetaDataObject><AccumulationRegister uuid="4"><Properties><Name>Stock</Name></Properties><ChildObjects><Dimension><Properties><Name>Good</Name><Type><Type>cfg:CatalogRef.Goods</Type></Type></Properties></Dimension></ChildObjects></AccumulationRegister></MetaDataObject>'
SYSTEM = '<MetaDataObject><Subsystem uuid="5"><Properties><Name>Trade</Name><Content><Item>Catalog.Goods</Item></Content></Properties></Subsystem></MetaDataObject>'
SERVICE = '<MetaDataObject><HTTPService uuid="6"><Properties><Name>Api</Name><RootURL>api</RootURL></Properties><ChildObjects><URLTemplate><Properties><Name>One</Name><Template>/one</Template></Properties></URLTemplate></ChildObjects></HTTPService></MetaDataObject>'
ROLE = "<MetaDataObject><Role><Name>Seller</Name><Rights><Object path='Catalog.Goods'><Right><Name>Read</Name><Value>true</Value></Right></Object></Rights></Role></MetaDataObject>"
FORM = '<Form><Events><Event name="OnOpen">Opened</Event></Events><ChildItems><InputField name="Code"><DataPath>Object.Code</DataPath></InputField></ChildItems><Attributes><Attribute name="Object"/></Attributes></Form>'
SCHEMA = "<DataCompositionSchema><DataSet><Name>Main</Name><Query>SELECT 1</Query><Field><DataPath>A</DataPath></Field></DataSet><SettingsVariants><SettingsVariant><Name>Base</Name></SettingsVariant></SettingsVariants></DataCompositionSchema>"
GRID = "<SpreadsheetDocument><Rows><Row><Cell><Text>[Name]</Text></Cell></Row></Rows><Areas><Area><Name>Header</Name><Top>1</Top><Bottom>1</Bottom></Area></Areas></SpreadsheetDocument>"
EXT = '<MetaDataObject><Configuration><Name>Plus</Name><ChildObjects><Catalog Adopted="true">Goods</Catalog></ChildObjects></Configuration></MetaDataObject>'
MODULE = "Процедура Первая()\n\tВторая();\n\tА = Справочники.Units.НайтиПоКоду(1);\nКонецПроцедуры\nПроцедура Вторая()\n\tЗапрос = Новый Запрос(\"ВЫБРАТЬ 1 ИЗ Справочник.Units\");\nКонецПроцедуры\nПроцедура Лишняя()\n\tСообщить(1);\nКонецПроцедуры"
FILES = {
    "Catalogs/Goods.xml": GOODS, "Catalogs/Units.xml": UNITS, "Documents/Sale.xml": SALE, "AccumulationRegisters/Stock.xml": STOCK, "Subsystems/Trade.xml": SYSTEM, "HTTPServices/Api.xml": SERVICE, "Roles/Seller.xml": ROLE,
    "Catalogs/Goods/Ext/ObjectModule.bsl": MODULE, "Catalogs/Goods/Forms/Item/Ext/Form.xml": FORM, "Reports/Sales/Templates/Main/Ext/Template.xml": SCHEMA, "Catalogs/Goods/Templates/Card.mxl": GRID, "Ext/Plus/Configuration.xml": EXT,
}
P1, P2 = "Первая", "Вторая"
ME = {"type": "Catalog", "name": "Goods"}
CASES = {
    "metadata-list": ({"type": "Catalog"}, 2), "metadata-get": (ME, 1), "metadata-search": ({"query": "goo"}, 1), "metadata-tree": ({}, 1), "metadata-attributes": (ME, 1), "metadata-forms": (ME, 1), "metadata-templates": (ME, 1),
    "metadata-registers": ({"document": "Sale"}, 1), "metadata-references": (ME, 1), "config-objects": ({"type": "http_services"}, 1), "config-options": ({}, 0), "config-constants": ({}, 0), "config-scheduled_jobs": ({}, 0),
    "config-event_subscriptions": ({}, 0), "config-exchanges": ({}, 0), "config-http_services": ({}, 1), "config-roles": ({}, 1), "config-role-rights": ({"object_name": "catalog.goods"}, 1), "code-module": (ME, 1),
    "code-procedure": (ME | {"procedure": P1}, 1), "code-resolve": ({"identifier": P2.upper()}, 1), "code-usages": ({"identifier": P2}, 1), "code-dependencies": (ME | {"procedure": P1, "depth": 2}, 2), "code-analyze": (ME, 4),
    "code-callgraph": (ME | {"procedure": P2}, 1), "code-validate": ({}, 0), "code-lint": ({"severity_filter": "info"}, 1), "code-format": (ME, 1), "code-complexity": ({"threshold": 0}, 3), "code-dead-code": ({}, 2),
    "bsp-find": ({"query": "core"}, 1), "bsp-hook": ({"name": "ONSTART"}, 1), "bsp-modules": ({"tag": "core"}, 1), "bsp-review": ({"code_text": "А = ТекущаяДата();"}, 1), "platform-method": ({"name": "len"}, 1), "platform-type": ({"name": "array"}, 1),
    "platform-event": ({"name": "OnWrite", "object_type": "document"}, 1), "platform-search": ({"query": "text"}, 1), "platform-global_context": ({}, 1), "graph.build": ({}, 22), "graph.stats": ({}, 22), "graph.impact": ({"node_id": "Catalog.Units"}, 0),
    "graph.related": ({"node_id": "Catalog.Goods"}, 0), "graph.path": ({"source": "Document.Sale", "target": "Catalog.Units"}, 2), "graph.context": ({"node_id": "Catalog.Goods"}, 0), "graph-callers": ({"node_id": "?" + P2}, 1),
    "graph-callees": ({"node_id": "?" + P1}, 1), "graph-code-references": ({"node_id": "Catalog.Units"}, 2), "embedding.search": ({"query": "Goods", "object_type": "Catalog"}, 2), "embedding.similar": ({"doc_id": "Catalog.Goods", "limit": 2}, 2),
    "embedding.stats": ({}, 2), "embedding.index": ({"scope": "metadata"}, 2), "extension-list": ({}, 1), "extension-objects": ({"name": "Plus"}, 1), "extension-impact": (ME, 1), "composition-get": ({"name": "Sales"}, 3), "composition-fields": ({"name": "Sales"}, 1),
    "composition-datasets": ({"name": "Sales"}, 1), "composition-settings": ({"name": "Sales"}, 1), "form-get": (ME | {"form": "Item"}, 3), "form-handlers": (ME | {"form": "Item"}, 1), "form-attributes": (ME | {"form": "Item"}, 1),
    "template-get": ({"file_path": "!Catalogs/Goods/Templates/Card.mxl"}, 1), "template-parameters": ({"file_path": "!Catalogs/Goods/Templates/Card.mxl"}, 1), "template-areas": ({"file_path": "!Catalogs/Goods/Templates/Card.mxl"}, 1),
    "template-find": ({"config_path": "!"}, 2), "pattern-list": ({}, 1), "pattern-get": ({"template_id": "t"}, 1), "pattern-search": ({"query": "hello"}, 1), "pattern-suggest": ({"task_description": "hello there"}, 1),
    "pattern-apply": ({"template_id": "t", "values": {"X": 1}}, 1), "query-parse": ({"query_text": "SELECT a FROM Catalog.Goods"}, 2), "query-validate": ({"query_text": "SELECT a FROM Catalog.Goods"}, 1),
    "query-optimize": ({"query_text": "SELECT * FROM Catalog.Goods"}, 1), "query-explain": ({"query_text": "SELECT a FROM Catalog.Goods"}, 1), "query-tables": ({"query_text": "SELECT a FROM Catalog.Goods"}, 1),
    "smart-query": ({"object_name": "Document.Sale", "include_tabular": "Lines"}, 1), "smart-movement": ({"document_name": "Sale", "register_name": "Stock"}, 1), "test-data-generate": (ME | {"count": 4}, 4),
    "config-compare": ({"path_a": "!", "path_b": "!Catalogs"}, 7), "diff-configurations": ({"left": "!", "right": "!"}, 1), "metadata-init": ({"full_reindex": True}, 1),
}


M = "Catalogs/Goods/Ext/ObjectModule.bsl"
GOODS_LINKS = {("procedure_ownership", "outgoing", f"{M}::{p}") for p in (P1, P2, "Лишняя")} | {
    ("attribute_reference", "outgoing", "Catalog.Units"), ("form_ownership", "incoming", "Catalog.Goods.Form.Item"), ("module_ownership", "incoming", "Catalog.Goods.Module.ObjectModule"),
    ("tabular_reference", "incoming", "Document.Sale"), ("dimension_type", "incoming", "AccumulationRegister.Stock"), ("subsystem_membership", "outgoing", "Subsystem.Trade"),
}
#: What a tool must give in some of its columns; paths from the tree's root.
VALUES = {
    "metadata-list": ("metadata_type name synonym", {("Catalog", "Goods", "Товары"), ("Catalog", "Units", "")}),
    "metadata-get": ("metadata_type name uuid forms templates", {("Catalog", "Goods", "1", ("Item",), ("Card",))}),
    "metadata-search": ("name rank", {("Goods", 0)}),
    "metadata-tree": ("name parent level path", {("Trade", "", 0, "Trade")}),
    "metadata-attributes": ("section name type", {("", "Unit", "cfg:CatalogRef.Units")}),
    "metadata-forms": ("form", {("Item",)}),
    "metadata-templates": ("template", {("Card",)}),
    "metadata-registers": ("register", {("AccumulationRegister.Stock",)}),
    "metadata-references": ("target relationship label", {("Catalog.Units", "attribute_reference", "Unit")}),
    "config-objects": ("metadata_type name root_url", {("HTTPService", "Api", "api")}),
    "config-options": ("name", set()),
    "config-constants": ("name", set()),
    "config-scheduled_jobs": ("name", set()),
    "config-event_subscriptions": ("name", set()),
    "config-exchanges": ("name", set()),
    "config-http_services": ("name root_url url_templates", {("Api", "api", (("One", "/one"),))}),
    "config-roles": ("role objects granted", {("Seller", 1, 1)}),
    "config-role-rights": ("role rights rls", {("Seller", ("Read",), ())}),
    "code-module": ("path content owner_type owner module", {(M, MODULE, "Catalog", "Goods", "ObjectModule")}),
    "code-procedure": ("path name start_line end_line signature", {(M, P1, 1, 4, "Процедура Первая()")}),
    "code-resolve": ("path name start_line", {(M, P2, 5)}),
    "code-usages": ("path line content", {(M, 2, "\tВторая();")}),
    "code-dependencies": ("id depth", {("Catalog.Units", 1), (f"{M}::{P2}", 1)}),
    "code-analyze": ("name object_name line containing_procedure", {(P2, None, 2, P1), ("НайтиПоКоду", "Units", 3, P1), ("Запрос", None, 6, P2), ("Сообщить", None, 9, "Лишняя")}),
    "code-callgraph": ("direction id", {("caller", f"{M}::{P1}")}),
    "code-validate": ("code", set()),
    "code-lint": ("path line rule severity", {(M, 9, "BSP_USER_MESSAGE", "info")}),
    "code-format": ("path content", {(M, MODULE)}),
    "code-complexity": ("name cyclomatic lines", {(P1, 1, 4), (P2, 1, 3), ("Лишняя", 1, 3)}),
    "code-dead-code": ("name start_line", {(P1, 1), ("Лишняя", 8)}),
    "bsp-find": ("kind name", {("module", "Common")}),
    "bsp-hook": ("name module", {("OnStart", "Over")}),
    "bsp-modules": ("name kind tags", {("Common", "Server", ("core",))}),
    "bsp-review": ("line rule severity", {(1, "BSP_TIMEZONE", "warning")}),
    "platform-method": ("section name name_en", {("S", "Длина", "Len")}),
    "platform-type": ("name name_en", {("Массив", "Array")}),
    "platform-event": ("name name_en", {("ПриЗаписи", "OnWrite")}),
    "platform-search": ("kind name", {("method", "Длина")}),
    "platform-global_context": ("section n", {("S", 1)}),
    "graph.impact": ("id depth via", {("Catalog.Goods", 1, "attribute_reference"), (f"{M}::{P1}", 1, "code_metadata_reference"), (f"{M}::{P2}", 1, "code_query_reference"), ("Document.Sale", 2, "tabular_reference"),
        ("AccumulationRegister.Stock", 2, "dimension_type"), ("Catalog.Goods.Form.Item", 2, "form_ownership"), ("Catalog.Goods.Module.ObjectModule", 2, "module_ownership")}),
    "graph.related": ("relationship direction neighbour", GOODS_LINKS),
    "graph.context": ("relationship direction neighbour", GOODS_LINKS),
    "graph.path": ("step source target relationship", {(1, "Document.Sale", "Catalog.Goods", "tabular_reference"), (2, "Catalog.Goods", "Catalog.Units", "attribute_reference")}),
    "graph-callers": ("relationship direction neighbour", {("procedure_call", "incoming", f"{M}::{P1}")}),
    "graph-callees": ("relationship direction neighbour", {("procedure_call", "outgoing", f"{M}::{P2}")}),
    "graph-code-references": ("relationship neighbour", {("code_query_reference", f"{M}::{P2}"), ("code_metadata_reference", f"{M}::{P1}")}),
    "embedding.search": ("id content", {("Catalog.Goods", "Object: Catalog.Goods\nSynonym: Товары\nAttributes: Unit"), ("Catalog.Units", "Object: Catalog.Units")}),
    "embedding.stats": ("doc_type documents dimension", {("metadata", 7, 64), (None, 7, 64)}),
    "extension-objects": ("extension metadata_type name mode", {("Plus", "Catalog", "Goods", "Adopted")}),
    "extension-impact": ("extension mode", {("Plus", "Adopted")}),
    "composition-get": ("part name expression", {("data_set", "Main", "SELECT 1"), ("field", "A", ""), ("setting", "Base", "")}),
    "composition-fields": ("owner name", {("Main", "A")}),
    "composition-datasets": ("name expression", {("Main", "SELECT 1")}),
    "composition-settings": ("name", {("Base",)}),
    "form-get": ("part kind name detail", {("handler", "event", "OnOpen", "Opened"), ("element", "InputField", "Code", "Object.Code"), ("attribute", "Attribute", "Object", "")}),
    "form-handlers": ("name detail", {("OnOpen", "Opened")}),
    "form-attributes": ("name", {("Object",)}),
    "template-get": ("row col n_rows n_cols text", {(1, 1, 1, 1, "[Name]")}),
    "template-parameters": ("name is_expression row col", {("Name", False, 1, 1)}),
    "template-areas": ("name kind r1 c1 r2 c2", {("Header", "header", 1, None, 1, None)}),
    "template-find": ("path owner_type owner template", {("Reports/Sales/Templates/Main/Ext/Template.xml", "Reports", "Sales", "Main"), ("Catalogs/Goods/Templates/Card.mxl", "Catalogs", "Goods", "Card")}),
    "pattern-get": ("id name category", {("t", "Hello", "greeting")}),
    "pattern-suggest": ("id score", {("t", 0.5)}),
    "pattern-apply": ("id code", {("t", "say 1")}),
    "query-parse": ("part name", {("field", "a"), ("table", "Catalog.Goods")}),
    "query-validate": ("is_valid unknown_tables", {(True, ())}),
    "query-optimize": ("kind", {("select_star",)}),
    "query-explain": ("explanation", {("Sources: Catalog.Goods\nFields: a",)}),
    "query-tables": ("table_name is_virtual_table", {("Catalog.Goods", False)}),
    "smart-query": ("query_text", {("ВЫБРАТЬ Д.Ссылка КАК Ссылка, ТЧ.Item КАК LinesItem ИЗ Document.Sale КАК Д ЛЕВОЕ СОЕДИНЕНИЕ Document.Sale.Lines КАК ТЧ ПО ТЧ.Ссылка = Д.Ссылка",)}),
    "smart-movement": ("field side from_field kind", {("Good", "section", "Item", "Receipt")}),
    "config-compare": ("metadata_type name status", {("AccumulationRegister", "Stock", "removed"), ("Catalog", "Goods", "unchanged"), ("Catalog", "Units", "unchanged"), ("Document", "Sale", "removed"), ("HTTPService", "Api", "removed"), ("Role", "Seller", "removed"), ("Subsystem", "Trade", "removed")}),
    "diff-configurations": ("status n", {("unchanged", 7)}),
    "metadata-init": ("status n", {("added", 10)}),
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("space")
    for name, body in FILES.items():
        (root / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "t" / name).write_text(body, encoding="utf-8")
    module = spark.createDataFrame([(0, "Common", "Server", "core things", ["core"], [])], "seq int, name string, kind string, purpose string, tags array<string>, procedures array<struct<name:string,exported:boolean,signature:string,description:string>>")
    hooks = spark.createDataFrame([(0, "OnStart", "Over", "at start", "")], "seq int, name string, module string, purpose string, template string")
    patterns = spark.createDataFrame([], "seq int, name string, task string, description string, modules array<string>, example string")
    one = spark.range(1)
    words = F.array(F.lit("text"))
    platform = {
        "methods": one.select(F.lit("S").alias("section"), F.lit("Str").alias("section_en"), F.lit("Длина").alias("name"), F.lit("Len").alias("name_en"), F.lit("").alias("description"), words.alias("keywords")),
        "types": one.select(F.lit("Массив").alias("name"), F.lit("Array").alias("name_en"), F.lit("").alias("description"), F.array().cast("array<string>").alias("keywords")),
        "events": one.select(F.lit("ПриЗаписи").alias("name"), F.lit("OnWrite").alias("name_en"), F.lit("").alias("description"), F.array(F.lit("Document")).alias("object_types")),
    }
    code = spark.createDataFrame([("t", "Hello", "", "", "", "greeting", ["hello"], "say ${X}")], "id string, name string, name_ru string, description string, description_ru string, category string, tags array<string>, template_code string")
    space = Workspace(spark, f"file://{root}/t", f"file://{root}/home", (module, hooks, patterns), platform, code)
    return space


def test_every_tool_is_covered():
    left = set(TOOLS) - set(CASES)
    assert left == {"generate-query", "generate-handler", "generate-movement", "generate-api", "generate-form_handler", "generate-subscription", "generate-scheduled_job", "runtime-query", "runtime-data"}
    assert len(TOOLS) >= 85


@pytest.mark.parametrize("name", list(CASES))
def test_tool(spark, workspace, name):
    arguments, n = CASES[name]
    ids = {r["name"]: r["id"] for r in workspace.procedures.collect()} if any(str(v).startswith("?") for v in arguments.values()) else {}
    swap = lambda v: ids[v[1:]] if isinstance(v, str) and v.startswith("?") else f"{workspace.root}/{v[1:]}" if isinstance(v, str) and v.startswith("!") else v
    got = workspace.run(name, **{k: swap(v) for k, v in arguments.items()}).collect()
    if name in VALUES:
        columns, want = VALUES[name]
        assert {tuple(flat(r[c], workspace.root) for c in columns.split()) for r in got} == want
    assert len(got) == (n or len(VALUES[name][1]) if name in VALUES else n)


def flat(v, root):
    """Lists and rows as tuples, paths from the tree's root."""
    if isinstance(v, (list, tuple)):
        return tuple(flat(x, root) for x in v)
    return v.replace(root.replace("file://", "file:") + "/", "").replace(root + "/", "") if isinstance(v, str) else v


def test_build_counts_what_it_built(spark, workspace):
    found = {(r["kind"], r["name"]): r["n"] for r in workspace.run("graph.build").collect()}
    assert found == {(r["kind"], r["name"]): r["n"] for r in workspace.run("graph.stats").collect()}
    want = {"form_ownership": 1, "module_ownership": 1, "procedure_ownership": 3, "subsystem_membership": 1, "procedure_call": 1, "attribute_reference": 1, "tabular_reference": 1, "dimension_type": 1, "register_movement": 1}
    assert {k: found[("edge", k)] for k in want} == want and found[("node", "Module")] == found[("node", "Form")] == 1


def test_code_is_embedded_once(spark, workspace):
    stats = lambda scope: {r["doc_type"]: r["documents"] for r in workspace.run("embedding.index", scope=scope).collect()}
    assert stats("code") == {"module": 1, "procedure": 3, None: 4} and stats("all") == {"module": 1, "procedure": 3, "metadata": 7, None: 11}
    got = workspace.run("embedding.search", query="Вторая Первая", module_type="ObjectModule", doc_type="procedure", limit=1).first()
    assert got["id"] == f"{workspace.root.replace('file://', 'file:')}/{M}::{P1}" and P2 in got["content"]
    from lodestar.operators import index

    again = {r["status"]: r["n"] for r in index.index_code(index.code_chunks(workspace.modules, workspace.procedures), workspace.home).collect()}
    assert again == {"kept": 4}
    less = {r["status"]: r["n"] for r in index.index_code(index.code_chunks(workspace.modules, workspace.procedures).where("doc_type = 'module'"), workspace.home).collect()}
    assert less == {"kept": 1, "dropped": 3}


def test_overlays_and_compared_modules(spark, tmp_path):
    for name, body in {"a/Catalogs/Goods.xml": GOODS, "a/Catalogs/Units.xml": UNITS, f"a/{M}": MODULE, "b/Catalogs/Renamed.xml": GOODS.replace("Товары", "Other"), f"b/{M}": MODULE.replace("Сообщить(1)", "Сообщить(2)")}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body, encoding="utf-8")
    space = Workspace(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/home")
    synonyms = lambda: {r["name"]: r["synonym"] for r in space.run("metadata-list", type="Catalog").collect()}
    assert synonyms() == {"Goods": "Товары", "Units": ""}
    space.run("metadata-init", overlay_roots=[f"file://{tmp_path}/b"])
    assert synonyms() == {"Goods": "Other", "Units": ""}
    space.run("metadata-init", overlay_roots=[])
    assert synonyms() == {"Goods": "Товары", "Units": ""}
    got = space.run("config-compare", path_a=f"file://{tmp_path}/a", path_b=f"file://{tmp_path}/b", metadata_type="Catalog", include_modules=True)
    assert {tuple(r) for r in got.where("metadata_type = 'Procedure'").collect()} == {("Procedure", f"{M}::Лишняя", "changed", 1, 1)}


def test_runtime(spark, workspace):
    spark.createDataFrame([(1, "a"), (2, "b")], "ref int, name string").createOrReplaceTempView("w_goods")
    schema = dialect.Schema(tables={"Catalog.Goods": "w_goods"}, registers={})
    assert workspace.run("runtime-query", query="ВЫБРАТЬ name ИЗ Справочник.Goods ГДЕ ref = &r", schema=schema, parameters={"r": 2}).first()["name"] == "b"
    assert workspace.run("runtime-data", table=spark.table("w_goods"), guid=1).first()["name"] == "a"
    assert catalog.tagged(workspace.library[0]).count() == 1
    with pytest.raises(ValueError):
        workspace.run("no-such-tool")
