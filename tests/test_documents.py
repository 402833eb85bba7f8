"""Extensions, report schemas, grids, forms and templates."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import intervals
from lodestar.plans import dialect, templates
from lodestar.sources import documents

FILES = {
    "ext/Configuration.xml": '<MetaDataObject><Configuration><Name>E</Name><Properties><Purpose>Customization</Purpose><NamePrefix>E_</NamePrefix></Properties><ChildObjects><Catalog Adopted="true" Replaced="true">Goods</Catalog><Document Replaced="true">Sale</Document><Catalog>E_Own</Catalog></ChildObjects></Configuration></MetaDataObject>',
    "rep/Template.xml": "<DataCompositionSchema><DataSet><Name>Main</Name><Type>DataSetQuery</Type><Query>SELECT 1</Query><Field><DataPath>Client</DataPath><Title>Client</Title><Role>Dimension</Role></Field></DataSet><Parameter><Name>From</Name></Parameter><TotalField><DataPath>Sum</DataPath><Expression>sum(Sum)</Expression></TotalField><SettingsVariants><SettingsVariant><Name>A</Name></SettingsVariant><SettingsVariant><Name>B</Name></SettingsVariant></SettingsVariants></DataCompositionSchema>",
    "grid/T.mxl": "<SpreadsheetDocument><Rows><Row><Cell><Text>Title [Org]</Text></Cell></Row><Row><Cell><Text>[Item]</Text></Cell><Cell><Text>{Qty * Price} &lt;b&gt; &lt;Name&gt; [Org]</Text></Cell></Row></Rows><Areas><Area><Name>Header</Name><Top>1</Top><Bottom>1</Bottom></Area><Area><Name>Строка</Name><Top>2</Top><Bottom>2</Bottom></Area></Areas></SpreadsheetDocument>",
    "form/Form.xml": '<Form><Events><Event name="OnOpen">Opened</Event></Events><ChildItems><UsualGroup name="Top"><ChildItems><InputField name="Code"><DataPath>Object.Code</DataPath></InputField></ChildItems></UsualGroup></ChildItems><Attributes><Attribute name="Object"><Type><Type>cfg:CatalogObject.Goods</Type></Type></Attribute></Attributes><Commands><Command name="Go"><Action>GoAction</Action></Command></Commands></Form>',
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body, encoding="utf-8")
    return str(root)


def test_extensions(spark, tree):
    found = documents.extensions(spark, tree)
    assert {(r["name"], r["mode"]) for r in found.collect()} == {("Goods", "Adopted"), ("Sale", "Replaced"), ("E_Own", "Own")}
    main = spark.createDataFrame([("Catalog", "Goods")], "metadata_type string, name string")
    edges = {(r["relationship"], r["target"]) for r in documents.extension_edges(found, main).collect()}
    assert ("extension_adopts", "Catalog.Goods") in edges and not any(k == "extension_replaces" for k, _ in edges) and sum(k == "extension_owns" for k, _ in edges) == 3
    assert documents.extension_impact(found, "Catalog", "Goods").count() == 1 and documents.with_mode(found, "E", "Own").count() == 1


def test_reports(spark, tree):
    parts = [(r["part"], r["name"], r["owner"], r["expression"]) for r in documents.report_schemas(spark, tree).collect()]
    assert ("data_set", "Main", "", "SELECT 1") in parts and ("field", "Client", "Main", "") in parts and ("resource", "Sum", "", "sum(Sum)") in parts
    assert sum(p[0] == "setting" for p in parts) == 2 and sum(p[0] == "parameter" for p in parts) == 1
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "Client string, Sum int")
    assert [tuple(r) for r in documents.run_report(rows, ["Client"], [("Sum", "sum(Sum)")]).collect()] == [("a", 3)]


def test_grids(spark, tree):
    grid = documents.cells(spark, tree)
    assert grid.count() == 3
    found = {r["name"]: (r["is_expression"], r["row"]) for r in documents.parameters(grid).collect()}
    assert found == {"Org": (False, 1), "Item": (False, 2), "Qty * Price": (True, 2), "Name": (False, 2)}
    inside = intervals.cells_in_areas(grid, documents.areas(spark, tree))
    assert sorted(r["area"] for r in inside.collect()) == ["Header", "Строка", "Строка"]


def test_forms(spark, tree):
    rows = {(r["part"], r["name"]): r for r in documents.forms(spark, tree).collect()}
    assert rows[("element", "Code")]["parent"] == rows[("element", "Top")]["id"] and rows[("element", "Code")]["detail"] == "Object.Code"
    assert rows[("handler", "OnOpen")]["detail"] == "Opened" and rows[("command", "Go")]["detail"] == "GoAction"
    assert rows[("attribute", "Object")]["detail"] == "cfg:CatalogObject.Goods"


def test_templates(spark):
    text = "Проц ${Name:X}({{#each Args}}${this}{{#if last}}{{else}}, {{/if}}{{/each}}){{#if Doc}} // ${Doc}{{/if}}"
    assert templates.substitute(text, {"Name": "A", "Args": ["p", "q"], "Doc": ""}) == "Проц A(p, q)"
    assert templates.substitute(text, {"Args": []}) == "Проц X()"
    assert templates.validate([{"name": "a", "required": True}, {"name": "b", "pattern": "[a-z]+"}, {"name": "c", "allowed": [1]}, {"name": "d", "type": "number"}], {"b": "1", "c": 2, "d": "x"}) == ["a is required", "b does not fit [a-z]+", "c is none of 1", "d is not a number"]
    catalog = spark.createDataFrame([("q1", "Slice", "Срез", "last record", "", "query", ["register", "slice"]), ("q2", "Union", "", "two queries", "", "query", ["union"])], "id string, name string, name_ru string, description string, description_ru string, category string, tags array<string>")
    assert [r["id"] for r in templates.search(catalog, "СРЕЗ", "query", ["slice"]).collect()] == ["q1"]
    assert [(r["id"], r["score"]) for r in templates.suggest(catalog, "slice of a register record").collect()] == [("q1", 0.5)]
    assert templates.categories(catalog).first()["n"] == 2


def test_builders(spark):
    text = templates.object_query("Справочник", "Товары", [("Код", False), ("Вид", True), ("УдалитьСтарое", False)], ("Цены", ["Цена"]))
    parsed = dialect.parse(text)
    assert [t["table_name"] for t in parsed.tables] == ["Catalog.Товары", "Catalog.Товары.Цены"] and len(parsed.select_fields) == 4 and not parsed.errors
    mapping = templates.map_fields([("Товар", "CatalogRef.Goods"), ("Количество", "Number"), ("Склад", "CatalogRef.Stores"), ("Нет", "Number")], [("Склад", "CatalogRef.Stores")], [("Номенклатура", "CatalogRef.Goods"), ("Количество", "Number")])
    assert mapping == {"Товар": ("section", "Номенклатура"), "Количество": ("section", "Количество"), "Склад": ("header", "Склад"), "Нет": None}
    heads = spark.createDataFrame([(1, "S", "2024-01-01")], "ref int, `Склад` string, d string")
    lines = spark.createDataFrame([(1, "g", 5), (1, "h", 6)], "ref int, `Номенклатура` string, `Количество` int")
    assert sorted(r["Количество"] for r in templates.movement_rows(heads, lines, "ref", mapping, "d").collect()) == [5, 6]
    rows = templates.test_rows(spark, [("n", "Number"), ("s", "String"), ("b", "Boolean"), ("d", "Date")], 5, 1)
    assert rows.collect() == templates.test_rows(spark, [("n", "Number"), ("s", "String"), ("b", "Boolean"), ("d", "Date")], 5, 1).collect()
    assert rows.where(F.col("n").isNull()).count() == 0
