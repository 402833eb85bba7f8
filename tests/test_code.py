"""Source-code extraction on small modules, and properties of generated ones."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import code, text
from lodestar.operators import graph

MODULE = """#Область Обработчики

// Считает цену
&НаСервере
Функция Цена(Знач Дата, Склад = Неопределено) Экспорт
    Если Дата = "Процедура Ложная()" Тогда // Процедура Тоже()
        Для Каждого Строка Из Таблица Цикл
            Сообщить("тест");
        КонецЦикла;
    КонецЕсли;
    Запрос = Новый Запрос("ВЫБРАТЬ Цена ИЗ РегистрСведений.Цены
        |ГДЕ Имя = ""x"" И Склад В (ВЫБРАТЬ Ссылка ИЗ Справочник.Склады)");
    Возврат Справочники.Товары.НайтиПоКоду(Код(1, Имя("a,b")));
КонецФункции

#КонецОбласти

Процедура Пустая()
КонецПроцедуры
"""


def test_procedures():
    first, second = code.procedures_of(MODULE)
    assert (first["name"], first["is_function"], first["is_export"], first["directive"], first["region"]) == ("Цена", True, True, "НаСервере", "Обработчики")
    assert first["comment"] == "// Считает цену"
    assert [(p["name"], p["by_value"], p["is_optional"]) for p in first["parameters"]] == [("Дата", True, False), ("Склад", False, True)]
    assert (first["start_line"], first["end_line"]) == (5, 14)
    assert (second["name"], second["is_export"], second["region"]) == ("Пустая", False, None)


def test_multi_line_signature_and_missing_end():
    text = "Процедура А(Первый,\n  Второй = 1) Экспорт\n Б();\n"
    (only,) = code.procedures_of(text)
    assert [p["name"] for p in only["parameters"]] == ["Первый", "Второй"] and only["is_export"] and only["end_line"] == 4


def test_calls_count_nested_arguments():
    calls = {c["name"]: c for c in code.calls_of(MODULE)}
    assert calls["Код"]["argument_count"] == 2 and calls["Имя"]["argument_count"] == 1
    assert "Ложная" not in calls and "Тоже" not in calls and "Цена" not in calls


def test_references_queries_variables():
    refs = {r["full_name"]: r["access_type"] for r in code.references_of(MODULE)}
    assert refs == {"Catalog.Товары": "ref"}
    (query,) = code.queries_of(MODULE)
    assert query["tables"] == ["РегистрСведений.Цены", "Справочник.Склады"] and '"x"' in query["query_text"] and query["start_line"] == 11
    assert [v["name"] for v in code.variables_of("А = Б + 1; // В") if v["is_assignment"]] == ["А"]


def test_complexity_and_issues():
    first = code.complexity_of(MODULE)[0]
    assert (first["cyclomatic"], first["cognitive"], first["nesting_depth"]) == (3, 3, 2)
    assert code.issues_of(MODULE) == []
    found = {i["code"] for i in code.issues_of("Если А Тогда\nКонецЦикла;\nПерейти ~М;\nЕсли Б Тогда")}
    assert found == {"UNBALANCED_BLOCK", "DEPRECATED_KEYWORD"}


def test_formatted_is_stable():
    once = code.formatted(MODULE)
    assert code.formatted(once) == once
    assert "\t\tДля Каждого" in once


def test_tables(spark):
    modules = spark.createDataFrame([("a", MODULE), ("b", "Процедура Лишняя()\n Пустая();\nКонецПроцедуры"), ("c", None)], "path string, content string")
    procedures = code.extract(modules, "procedures")
    assert procedures.count() == 3
    calls = code.with_procedure(code.extract(modules, "calls"), procedures)
    assert sorted(r["name"] for r in code.in_procedure(calls, "ЦЕНА").collect()) == ["Запрос", "Имя", "Код", "НайтиПоКоду", "Сообщить"]
    ids = procedures.select(code.procedure_id("path", "name").alias("id"), F.col("path").alias("module"), "name")
    sites = calls.where("containing_procedure is not null").select(code.procedure_id("path", "containing_procedure").alias("caller"), F.col("path").alias("module"), "name")
    assert [(r["caller"], r["callee"]) for r in graph.resolve_calls(sites, ids).collect()] == [("b::Лишняя", "a::Пустая")]
    handlers = spark.createDataFrame([("ПередЗаписью",)], "name string")
    assert [r["name"] for r in graph.dead_procedures(procedures, calls, handlers).collect()] == ["Лишняя"]
    assert {r["rule"] for r in code.review(modules).collect()} == {"BSP_USER_MESSAGE"}
    metrics = {r["path"]: r for r in code.module_metrics(modules.where("content is not null")).collect()}
    assert metrics["a"]["n_functions"] == 1 and metrics["a"]["cyclomatic"] == 4


names = st.text(alphabet="абвгABCxyz_", min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(names, st.booleans(), st.booleans()), max_size=6))
def test_what_is_written_is_read(items):
    text = "\n".join(f"{'Функция' if f else 'Процедура'} {n}(){' Экспорт' if e else ''}\n\tА = \"Процедура Б() \"\"\";\n{'КонецФункции' if f else 'КонецПроцедуры'}" for n, f, e in items)
    assert [(p["name"], p["is_function"], p["is_export"]) for p in code.procedures_of(text)] == items


def test_procedure_chunks_keep_header_and_empty_bodies(spark):
    line = "x = 1;\n"
    rows = [
        (1, "c" * 1500, "Procedure A()", line * 1000),
        (2, "", "Procedure B()", ""),
        (3, "", "Procedure C()", "y" * 3900),
        (4, "d" * 5000, "Procedure D()", line * 40),
        (5, "", "Procedure E()", None),
    ]
    schema = "id long, comment string, signature string, body string"
    procedures = spark.createDataFrame(rows, schema).selectExpr("*", "'Catalog.X' as owner", "'P' as name", "false as is_function", "true as is_export", "'' as directive")
    got = {}
    for r in text.procedure_chunks(procedures, ["id"]).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r)
    assert {k: len(v) for k, v in got.items() if k in (2, 3, 5)} == {2: 1, 3: 1, 5: 1}
    assert got[2][0]["content"].endswith("\nProcedure B()") and got[5][0]["content"].endswith("\nProcedure E()")
    assert len(got[1]) > 1 and all("c" * 1500 in r["content"] and len(r["content"]) <= 4000 for r in got[1])
    assert len(got[4]) > 1 and all("d" * 5000 in r["content"] for r in got[4])


# --- rows that stand for much work -------------------------------------------


def _by_characters(line):
    """``code_only`` one character at a time."""
    out, inside, k = [], line.lstrip().startswith("|"), 0
    while k < len(line):
        c = line[k]
        if inside and c == '"' and line[k + 1 : k + 2] == '"':
            out.append("  ")
            k += 2
            continue
        if not inside and line.startswith("//", k):
            break
        out.append(c if c == '"' or not inside else " ")
        inside ^= c == '"'
        k += 1
    return "".join(out)


def test_code_only_of_odd_lines():
    import itertools

    from lodestar.functions import code

    for size in range(7):
        for line in map("".join, itertools.product('"/|a\n', repeat=size)):
            assert code.code_only.__wrapped__(line) == _by_characters(line), line


def test_the_procedure_of_a_row_without_a_join(spark):
    """What the extractor tells by itself is what the join tells."""
    from lodestar.functions import code

    body = "А(1);\nПроцедура П(Б)\n\tВ(2);\nКонецПроцедуры\nГ(3);\nФункция Ф(\n\tБ) Экспорт\n\tД(4);\nКонецФункции\nПроцедура Н()\n\tЕ(5);"
    found = spark.createDataFrame([("m", body), ("n", None), ("o", "А(1);"), ("p", "")], "path string, content string")
    joined = code.with_procedure(code.extract(found, "calls"), code.extract(found, "procedures"))
    placed = code.extract(found, "calls", place="line")
    assert placed.columns == joined.columns and sorted(map(str, placed.collect())) == sorted(map(str, joined.collect()))
    few = code.extract(found, "calls", ["name", "line"], "line")
    assert few.columns == ["path", "name", "line", "containing_procedure"] and few.count() == placed.count() == 6
    assert {(q["name"], q["containing_procedure"]) for q in few.collect()} == {("А", None), ("В", "П"), ("Г", None), ("Д", "Ф"), ("Е", "Н")}


@pytest.mark.parametrize("name", ["code_format", "code_resolved_calls", "code_call_graph", "code_dead_procedures", "code_callers", "code_usages", "tree_objects", "tree_graph_build"])
def test_what_is_made_of_rows_is_not_broadcast(spark, small, name):
    """The size of a file of keys tells nothing of the texts made from them."""
    from lodestar import queries as core

    plan = core.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_keys_are_dealt_over_tasks(spark):
    from lodestar.session import dealt

    assert dealt(spark.range(1000, numPartitions=1), "id", 100).rdd.getNumPartitions() == 10
    assert dealt(spark.range(0), "id").count() == 0
