"""The source-code operators as queries over modules made from the parts, with SQL that computes what they hold.

The SQL never sees a module's text: it says from a part's key what a reader must find
where, so that every parser is held against facts and not against another parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import code, text
from lodestar.operators import graph
from lodestar.registry import query
from lodestar.session import dealt, table

LINES = 17


def modules(spark: SparkSession, d: str) -> DataFrame:
    """path, k and content: one to three procedures per part, of ``LINES`` lines each.

    Parts decide on exports (k % 3), calls (k % 4), deprecated jumps (k % 10), a query
    that is run (k % 6) and a block that is never closed (k % 25).
    """
    k = F.col("p_partkey")

    def procedure(i: Column) -> Column:
        function = (k + i) % 2 == 0
        word = lambda n: F.when(function, n[0]).otherwise(n[1])
        say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        lines = [
            say("#Область Раздел", i),
            say("// Описание ", k),
            F.lit("&НаСервере"),
            say(word(("Функция", "Процедура")), " Расчет", k, "_", i, "(Знач А, Б = ", k, ")", F.when(k % 3 == 0, " Экспорт").otherwise("")),
            F.lit("\t// Скрыто(1);"),
            say('\tТекст1 = "Ложный(вызов) // " + Общий', k % 4, ".Имя(А, Макс(Б, ", i, "));"),
            F.lit("\tЕсли А > Б И Б <> 0 Тогда"),
            say("\t\tДля Каждого Р Из Справочники.Товары", k % 7, ".НайтиПоКоду(Б) Цикл"),
            say(F.when(k % 4 == 3, "\t\t\tПрочее(Р);").otherwise(say("\t\t\tРасчет", k, "_", (i + 1) % (1 + k % 3), "(Р);")), " Расчет", k + 1, "_0(Р);"),
            F.lit("\t\tКонецЦикла;"),
            F.when((k % 25 == 1) & (i == 0), "").when(k % 6 == 0, "\tКонецЕсли; Запрос.Выполнить();").otherwise("\tКонецЕсли;"),
            say('\tЗапрос = Новый Запрос("ВЫБРАТЬ Т.Ссылка ИЗ Справочник.Товары', k % 5, " КАК Т"),
            F.lit('\t|ГДЕ Т.Код = ""x""");'),
            F.when(k % 10 == 0, "\tПерейти ~М; Д = ТекущаяДата();").otherwise('\tСообщить("а, б", А);'),
            word(("КонецФункции", "КонецПроцедуры")),
            F.lit("#КонецОбласти"),
            F.lit(""),
        ]
        return F.concat_ws("\n", *lines)

    body = F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: procedure(i.cast("long"))), "\n")
    return dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("Catalogs/Part"), k, F.lit("/Ext/ObjectModule.bsl")).alias("path"), k.alias("k"), body.alias("content"))


PROCEDURES_SQL = f"""
procs AS (SELECT 'Catalogs/Part' || p_partkey || '/Ext/ObjectModule.bsl' AS path, p_partkey AS k, i, 'Расчет' || p_partkey || '_' || i AS name, {LINES} * i AS base
  FROM (SELECT p_partkey, unnest(range(1 + p_partkey % 3)) AS i FROM part))
"""
CALLS_SQL = f"""{PROCEDURES_SQL}, calls AS (
  SELECT path, k, i, name AS containing_procedure, 'Имя' AS name, 'Общий' || k % 4 AS object_name, 2 AS argument_count, base + 6 AS line FROM procs
  UNION ALL SELECT path, k, i, name, 'Макс', NULL, 2, base + 6 FROM procs
  UNION ALL SELECT path, k, i, name, 'НайтиПоКоду', 'Товары' || k % 7, 1, base + 8 FROM procs
  UNION ALL SELECT path, k, i, name, CASE WHEN k % 4 = 3 THEN 'Прочее' ELSE 'Расчет' || k || '_' || (i + 1) % (1 + k % 3) END, NULL, 1, base + 9 FROM procs
  UNION ALL SELECT path, k, i, name, 'Расчет' || k + 1 || '_0', NULL, 1, base + 9 FROM procs
  UNION ALL SELECT path, k, i, name, 'Выполнить', 'Запрос', 0, base + 11 FROM procs WHERE k % 6 = 0 AND NOT (k % 25 = 1 AND i = 0)
  UNION ALL SELECT path, k, i, name, 'Запрос', NULL, 1, base + 12 FROM procs
  UNION ALL SELECT path, k, i, name, CASE WHEN k % 10 = 0 THEN 'ТекущаяДата' ELSE 'Сообщить' END, NULL, CASE WHEN k % 10 = 0 THEN 0 ELSE 2 END, base + 14 FROM procs)
"""


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, name, (k + i) % 2 = 0 AS is_function, k % 3 = 0 AS is_export, 'НаСервере' AS directive, '// Описание ' || k AS comment, 'Раздел' || i AS region,
CAST(base + 4 AS INT) AS start_line, CAST(base + 15 AS INT) AS end_line, 'А:true:,Б:false:' || k AS parameters, CASE WHEN (k + i) % 2 = 0 THEN 'Функция' ELSE 'Процедура' END || ' ' || name || '(Знач А, Б = ' || k || ')' || CASE WHEN k % 3 = 0 THEN ' Экспорт' ELSE '' END AS signature FROM procs"""
)
def code_procedures(spark, d):
    parameters = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["by_value"].cast("string"), F.coalesce(p["default_value"], F.lit("")))), ",")
    found = code.extract(modules(spark, d), "procedures")
    return found.select("path", "name", "is_function", "is_export", "directive", "comment", "region", "start_line", "end_line", parameters.alias("parameters"), "signature")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return code.extract(modules(spark, d), "calls", place="line")


@query(f"WITH {CALLS_SQL} SELECT path, name, object_name, CAST(argument_count AS INT) AS argument_count, CAST(line AS INT) AS line, false AS is_async, containing_procedure FROM calls")
def code_calls(spark, d):
    return _calls(spark, d).select("path", "name", "object_name", "argument_count", "line", "is_async", "containing_procedure")


@query(f"WITH {CALLS_SQL} SELECT path, name, CAST(line AS INT) AS line FROM calls WHERE containing_procedure = 'Расчет4_1'")
def code_calls_in_procedure(spark, d):
    return code.in_procedure(_calls(spark, d), "расчет4_1").select("path", "name", "line")


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, 'Catalog' AS reference_type, 'Товары' || k % 7 AS object_name, 'Catalog.Товары' || k % 7 AS full_name, 'ref' AS access_type, CAST(base + 8 AS INT) AS line, 19 AS "column", name AS containing_procedure FROM procs"""
)
def code_references(spark, d):
    return code.extract(modules(spark, d), "references", place="line")


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, 'ВЫБРАТЬ Т.Ссылка ИЗ Справочник.Товары' || k % 5 || ' КАК Т' || chr(10) || 'ГДЕ Т.Код = "x"' AS query_text, CAST(base + 12 AS INT) AS start_line, CAST(base + 13 AS INT) AS end_line, 'Справочник.Товары' || k % 5 AS tables, name AS containing_procedure FROM procs"""
)
def code_queries(spark, d):
    found = code.extract(modules(spark, d), "queries", place="start_line")
    return found.withColumn("tables", F.array_join("tables", ","))


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, 'Catalog.Товары' || k % 5 AS target, name AS containing_procedure, CAST(base + 12 AS INT) AS line FROM procs"""
)
def code_query_tables(spark, d):
    found = code.extract(modules(spark, d), "queries", place="start_line")
    return code.query_edges(found).select(F.col("file").alias("path"), "target", F.element_at(F.split("source", "::"), -1).alias("containing_procedure"), "line")


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, 'Текст1' AS name, CAST(base + 6 AS INT) AS line, 1 AS "column" FROM procs UNION ALL SELECT path, 'Запрос', CAST(base + 12 AS INT), 1 FROM procs"""
)
def code_assignments(spark, d):
    return code.extract(modules(spark, d), "variables").where("is_assignment").drop("is_assignment")


@query(f"WITH {PROCEDURES_SQL} SELECT path, 'А' AS name, CAST(sum(3 + CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM procs GROUP BY path UNION ALL SELECT path, 'Б', CAST(5 * count(*) AS BIGINT) FROM procs GROUP BY path")
def code_variables(spark, d):
    return code.extract(modules(spark, d), "variables").where("name in ('А', 'Б')").groupBy("path", "name").agg(F.count("*").alias("n"))


@query(f"WITH {PROCEDURES_SQL} SELECT path, name, (k + i) % 2 = 0 AS is_function, 4 AS cyclomatic, 3 AS cognitive, 12 AS lines, 2 AS n_parameters, 2 AS nesting_depth, CAST(base + 4 AS INT) AS start_line FROM procs")
def code_complexity(spark, d):
    return code.extract(modules(spark, d), "complexity")


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, 'DEPRECATED_KEYWORD' AS code, 'warning' AS severity, CAST(base + 14 AS INT) AS line FROM procs WHERE k % 10 = 0
UNION ALL SELECT path, 'UNBALANCED_BLOCK', 'error', CAST(base + 15 AS INT) FROM procs WHERE k % 25 = 1 AND i = 0
UNION ALL SELECT path, 'UNBALANCED_BLOCK', 'error', CAST(base + 4 AS INT) FROM procs WHERE k % 25 = 1 AND i = 0"""
)
def code_issues(spark, d):
    return code.extract(modules(spark, d), "issues").drop("message")


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, CAST({LINES} * count(*) AS BIGINT) AS n_lines, CAST(count(*) + count(*) FILTER (k % 25 = 1 AND i = 0) AS BIGINT) AS n_blank, CAST(2 * count(*) AS BIGINT) AS n_comment,
CAST(({LINES} - 3) * count(*) - count(*) FILTER (k % 25 = 1 AND i = 0) AS BIGINT) AS n_code, count(*) FILTER ((k + i) % 2 = 1) AS n_procedures, count(*) FILTER ((k + i) % 2 = 0) AS n_functions,
CAST(4 * count(*) AS BIGINT) AS cyclomatic, CAST(3 * count(*) AS BIGINT) AS cognitive, 2 AS max_nesting, 0 AS n_complex FROM procs GROUP BY path"""
)
def code_module_metrics(spark, d):
    return code.module_metrics(modules(spark, d)).withColumn("n_complex", F.size("complex_procedures")).drop("complex_procedures")


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, CAST(base + 14 AS INT) AS line, CASE WHEN k % 10 = 0 THEN 'BSP_TIMEZONE' ELSE 'BSP_USER_MESSAGE' END AS rule, CASE WHEN k % 10 = 0 THEN 'warning' ELSE 'info' END AS severity FROM procs
UNION ALL SELECT path, CAST(base + 11 AS INT), 'BSP_QUERY_RESULT', 'info' FROM procs WHERE k % 6 = 0 AND NOT (k % 25 = 1 AND i = 0)"""
)
def code_review(spark, d):
    return code.review(modules(spark, d))


@query("SELECT 'Catalogs/Part' || p_partkey || '/Ext/ObjectModule.bsl' AS path, p_partkey % 25 <> 1 AS restored FROM part")
def code_format(spark, d):
    held = modules(spark, d)
    flat = held.select("path", F.regexp_replace("content", r"(?m)^\t+", "").alias("content"))
    return code.format_modules(flat).withColumnRenamed("content", "formatted").join(held.hint("merge"), "path").select("path", (F.col("formatted") == F.col("content")).alias("restored"))


@query(
    f"""WITH {CALLS_SQL} SELECT path, name, CAST(line AS INT) AS line, containing_procedure FROM calls WHERE lower(name) = 'расчет4_0' OR lower(name) = 'расчет5_0'"""
)
def code_usages(spark, d):
    """Lines that use two procedures as whole words; the lines that define them are left out."""
    held, used = modules(spark, d), ("Расчет4_0", "Расчет5_0")
    found = None
    for name in used:
        some = text.usages(held, ["path"], "content", name, None).select("path", "line", F.lit(name).alias("name"))
        found = some if found is None else found.unionByName(some)
    # Modules without these letters hold no such line, so their procedures are not asked for.
    some = held.where(F.lower("content").rlike("|".join(n.lower() for n in used)))
    return code.with_procedure(found, code.extract(some, "procedures", ["name", "start_line", "end_line"]))


def _procedures(found: DataFrame) -> DataFrame:
    return found.select(code.procedure_id("path", "name").alias("id"), F.col("path").alias("module"), "path", "name", "is_export", "start_line")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    held = modules(spark, d)
    procedures = code.extract(held, "procedures", ["name", "is_export", "start_line"])
    calls = code.extract(held, "calls", ["name", "object_name", "line"], "line")
    sites = calls.where("containing_procedure is not null and object_name is null")
    sites = sites.select(code.procedure_id("path", "containing_procedure").alias("caller"), F.col("path").alias("module"), "name", "line")
    return graph.resolve_calls(sites, _procedures(procedures))


RESOLVED_SQL = f"""{CALLS_SQL}, resolved AS (SELECT c.path || '::' || c.containing_procedure AS caller, c.path AS module, c.name, CAST(c.line AS INT) AS line, p.path || '::' || p.name AS callee
  FROM calls c JOIN procs p ON p.name = c.name WHERE c.object_name IS NULL AND (p.path <> c.path OR p.name <> c.containing_procedure))
"""


@query(f"WITH {RESOLVED_SQL} SELECT caller, module, name, line, callee FROM resolved")
def code_resolved_calls(spark, d):
    return _resolved(spark, d)


@query(f"WITH {RESOLVED_SQL} SELECT caller AS source, callee AS target, 'calls' AS edge_type, count(*) AS count FROM resolved GROUP BY caller, callee")
def code_call_graph(spark, d):
    sites = _resolved(spark, d).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("edge_type"))
    return graph.collapse_edges(sites)


@query(
    f"""WITH {CALLS_SQL} SELECT path || '::' || containing_procedure AS source, CASE WHEN object_name IS NULL THEN name ELSE object_name || '.' || name END AS target, 'calls' AS edge_type, count(*) AS count FROM calls GROUP BY ALL
UNION ALL SELECT path || '::' || name, 'Catalog.Товары' || k % 7, 'uses_metadata', 1 FROM procs"""
)
def code_dependency_graph(spark, d):
    """The code graph by name: calls and uses of metadata, collapsed."""
    held = modules(spark, d)
    uses = code.extract(held, "references", place="line")
    return graph.collapse_edges(code.call_edges(code.extract(held, "calls", place="line")).unionByName(code.metadata_edges(uses)))


@query(
    f"""WITH {CALLS_SQL} SELECT path, name, CAST(base + 4 AS INT) AS start_line FROM procs WHERE k % 3 <> 0 AND name NOT IN (SELECT name FROM calls) AND NOT (i = 2 AND k % 5 = 0)"""
)
def code_dead_procedures(spark, d):
    found = modules(spark, d)
    held = _procedures(code.extract(found, "procedures", ["name", "is_export", "start_line"]))
    calls = code.extract(found, "calls", ["name"])
    handlers = table(spark, d, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("РАСЧЕТ"), "p_partkey", F.lit("_2")).alias("name"))
    return graph.dead_procedures(held, calls, handlers).select("path", "name", "start_line")


def _code_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _procedures(code.extract(modules(spark, d), "procedures", ["name", "is_export", "start_line"])).select("id", F.lit("Procedure").alias("node_type"), "name")
    calls = _resolved(spark, d).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit(graph.CALL).alias("relationship"), F.lit("").alias("label"))
    uses = code.extract(modules(spark, d), "references", ["full_name", "line"], "line")
    uses = uses.select(code.procedure_id("path", "containing_procedure").alias("source"), F.col("full_name").alias("target"), F.lit(graph.METADATA_REFERENCE).alias("relationship"), F.lit("").alias("label"))
    items = table(spark, d, "part").select(F.concat(F.lit("Товары"), F.col("p_partkey") % 7).alias("name")).distinct()
    nodes = nodes.unionByName(items.select(F.concat(F.lit("Catalog."), "name").alias("id"), F.lit("Catalog").alias("node_type"), "name"))
    return nodes, graph.dedup_edges(graph.number_edges(calls.unionByName(uses)))


@query(f"WITH {RESOLVED_SQL} SELECT DISTINCT caller AS neighbour FROM resolved WHERE callee = 'Catalogs/Part5/Ext/ObjectModule.bsl::Расчет5_0'")
def code_callers(spark, d):
    return graph.callers(*_code_nodes(spark, d), "Catalogs/Part5/Ext/ObjectModule.bsl::Расчет5_0").select("neighbour")


@query(f"WITH {RESOLVED_SQL} SELECT DISTINCT callee AS neighbour FROM resolved WHERE caller = 'Catalogs/Part5/Ext/ObjectModule.bsl::Расчет5_0'")
def code_callees(spark, d):
    return graph.callees(*_code_nodes(spark, d), "Catalogs/Part5/Ext/ObjectModule.bsl::Расчет5_0").select("neighbour")


@query(f"WITH {PROCEDURES_SQL} SELECT path || '::' || name AS neighbour FROM procs WHERE k % 7 = 3")
def code_uses_of_object(spark, d):
    return graph.code_references(*_code_nodes(spark, d), "Catalog.Товары3").select("neighbour")


@query(
    f"""WITH RECURSIVE {RESOLVED_SQL}, e AS (SELECT DISTINCT caller, callee FROM resolved),
bfs(id, depth) AS (SELECT 'Catalogs/Part5/Ext/ObjectModule.bsl::Расчет5_0', 0 UNION SELECT e.callee, depth + 1 FROM bfs JOIN e ON e.caller = bfs.id WHERE depth < 4)
SELECT id, CAST(min(depth) AS INT) AS depth FROM bfs GROUP BY id HAVING min(depth) > 0"""
)
def code_procedure_dependencies(spark, d):
    calls = _resolved(spark, d).select(F.col("caller").alias("source"), F.col("callee").alias("target"))
    return graph.dependencies(calls, "Catalogs/Part5/Ext/ObjectModule.bsl::Расчет5_0", 4)


@query(
    f"""WITH {PROCEDURES_SQL} SELECT path, name, 0 AS chunk_index, 1 AS chunk_total, 'Part' || k || '.' || name || ' (' || CASE WHEN (k + i) % 2 = 0 THEN 'Function' ELSE 'Procedure' END || CASE WHEN k % 3 = 0 THEN ', export' ELSE '' END || ')' || chr(10) || 'НаСервере' || chr(10) || '// Описание ' || k AS header, path || '.' || name AS id FROM procs"""
)
def code_procedure_chunks(spark, d):
    """Every body here fits one chunk, which starts with the whole header."""
    found = code.extract(modules(spark, d), "procedures").withColumn("owner", F.regexp_extract("path", "/(Part[0-9]+)/", 1))
    parts = text.procedure_chunks(found, ["path", "name"])
    header = F.array_join(F.slice(F.split("content", "\n"), 1, 3), "\n")
    base = F.concat_ws(".", "path", "name")
    return parts.select("path", "name", "chunk_index", "chunk_total", header.alias("header"), text.base_id(text.chunk_id(base, "chunk_index", "chunk_total")).alias("id"))


@query(
    f"""WITH {PROCEDURES_SQL}, m AS (SELECT path, k, count(*) AS n FROM procs GROUP BY path, k) SELECT path, 0 AS chunk_index, 1 AS chunk_total, 'Catalog.Part' || k || ' (ObjectModule)' AS title, CAST({LINES} * n + 1 AS BIGINT) AS n_lines FROM m"""
)
def code_module_chunks(spark, d):
    held = modules(spark, d).select("path", F.concat(F.lit("Catalog.Part"), "k").alias("owner"), F.lit("ObjectModule").alias("module"), "content")
    parts = text.module_chunks(held, ["path"], most=10_000)
    lines = F.split("content", "\n")
    return parts.select("path", "chunk_index", "chunk_total", F.get(lines, 0).alias("title"), F.size(lines).cast("long").alias("n_lines"))


@query(f"WITH {CALLS_SQL} SELECT path, count(DISTINCT lower(name)) AS methods, count(DISTINCT lower(object_name)) AS objects FROM calls GROUP BY path")
def code_distinct_targets(spark, d):
    return code.distinct_targets(code.extract(modules(spark, d), "calls", ["name", "object_name"]))
