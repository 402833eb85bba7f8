"""Source-code extraction: modules (path, content) into procedures, calls, references, queries, variables, metrics.

A module is read as a stream of lines by one state machine per text, inside an
Arrow batch function; nothing crosses modules, so a scan of any size is a single
map stage, which can also tell the procedure that holds a row.  Everything that needs
rows of two modules (what resolves to what), or of another table, is a join elsewhere.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.intervals import containing
from lodestar.staging import staged

LINES_TOGETHER = 256

# Words of the language, Russian and English.
PROCEDURE_WORDS = ("процедура", "procedure")
FUNCTION_WORDS = ("функция", "function")
END_WORDS = ("конецпроцедуры", "конецфункции", "endprocedure", "endfunction")
EXPORT_WORDS = ("экспорт", "export")
BY_VALUE_WORDS = ("знач", "val")
ASYNC_WORDS = ("асинх", "async")
AWAIT_WORDS = ("ждать", "await")
REGION_WORDS = ("область", "region")
END_REGION_WORDS = ("конецобласти", "endregion")
RUN_WORDS = ("выполнить", "execute")  # called as methods too
NOT_CALLS = frozenset(
    (
        "если", "тогда", "иначе", "иначеесли", "конецесли", "для", "каждого", "из", "по", "цикл", "конеццикла", "пока",
        "попытка", "исключение", "конецпопытки", "возврат", "перейти", "продолжить", "прервать", "новый", "new", "if",
        "then", "else", "elseif", "elsif", "endif", "for", "each", "in", "to", "do", "enddo", "while",
        "try", "except", "endtry", "return", "goto", "continue", "break", "процедура", "функция", "procedure", "function", "конецпроцедуры",
        "конецфункции", "endprocedure", "endfunction", "и", "или", "не", "and", "or", "not", "истина", "ложь", "true",
        "false", "неопределено", "undefined", "null", "знач", "val", "экспорт", "export", "перем", "var",
    )
)
NEST_OPEN = {"если": "конецесли", "для": "конеццикла", "пока": "конеццикла", "попытка": "конецпопытки", "if": "endif", "for": "enddo", "while": "enddo", "try": "endtry"}
NEST_CLOSE = frozenset(NEST_OPEN.values()) | {"конецвыбора", "endselect"}
BRANCH_WORDS = ("если", "иначеесли", "для", "пока", "исключение", "и", "или", "if", "elsif", "for", "while", "except", "and", "or")
DEPRECATED = ("перейти", "goto")
UNBALANCED, DEPRECATED_CODE = "UNBALANCED_BLOCK", "DEPRECATED_KEYWORD"
#: Metadata collections in singular and plural, to their type.
METADATA_TYPES = {
    "Catalog": ("справочник", "справочники", "catalog", "catalogs"),
    "Document": ("документ", "документы", "document", "documents"),
    "Enum": ("перечисление", "перечисления", "enum", "enums"),
    "Report": ("отчет", "отчёт", "отчеты", "отчёты", "report", "reports"),
    "DataProcessor": ("обработка", "обработки", "dataprocessor", "dataprocessors"),
    "InformationRegister": ("регистрсведений", "регистрысведений", "informationregister", "informationregisters"),
    "AccumulationRegister": ("регистрнакопления", "регистрынакопления", "accumulationregister", "accumulationregisters"),
    "CalculationRegister": ("регистррасчета", "регистрырасчета", "calculationregister", "calculationregisters"),
    "AccountingRegister": ("регистрбухгалтерии", "регистрыбухгалтерии", "accountingregister", "accountingregisters"),
    "BusinessProcess": ("бизнеспроцесс", "бизнеспроцессы", "businessprocess", "businessprocesses"),
    "Task": ("задача", "задачи", "task", "tasks"),
    "ChartOfAccounts": ("плансчетов", "планысчетов", "chartofaccounts", "chartsofaccounts"),
    "ChartOfCharacteristicTypes": ("планвидовхарактеристик", "планывидовхарактеристик", "chartofcharacteristictypes", "chartsofcharacteristictypes"),
    "ChartOfCalculationTypes": ("планвидоврасчета", "планывидоврасчета", "chartofcalculationtypes", "chartsofcalculationtypes"),
    "ExchangePlan": ("планобмена", "планыобмена", "exchangeplan", "exchangeplans"),
    "Constant": ("константа", "константы", "constant", "constants"),
    "Sequence": ("последовательность", "последовательности", "sequence", "sequences"),
    "WebService": ("webсервис", "webсервисы", "webservice", "webservices"),
    "HTTPService": ("httpсервис", "httpсервисы", "httpservice", "httpservices"),
    "CommonModule": ("общиймодуль", "общиемодули", "commonmodule", "commonmodules"),
    "SessionParameter": ("параметрсеанса", "параметрысеанса", "sessionparameter", "sessionparameters"),
    "FunctionalOption": ("функциональнаяопция", "функциональныеопции", "functionaloption", "functionaloptions"),
    "DefinedType": ("определяемыйтип", "определяемыетипы", "definedtype", "definedtypes"),
    "CommonAttribute": ("общийреквизит", "общиереквизиты", "commonattribute", "commonattributes"),
    "Subsystem": ("подсистема", "подсистемы", "subsystem", "subsystems"),
}
_TYPE_OF = {w: k for k, words in METADATA_TYPES.items() for w in words}
#: Folders of a tree, to the type of what lies in them.
FOLDERS = {
    "AccountingRegisters": "AccountingRegister",
    "AccumulationRegisters": "AccumulationRegister",
    "BusinessProcesses": "BusinessProcess",
    "CalculationRegisters": "CalculationRegister",
    "Catalogs": "Catalog",
    "ChartsOfAccounts": "ChartOfAccounts",
    "ChartsOfCalculationTypes": "ChartOfCalculationTypes",
    "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes",
    "CommonForms": "CommonForm",
    "CommonModules": "CommonModule",
    "Constants": "Constant",
    "DataProcessors": "DataProcessor",
    "Documents": "Document",
    "Enums": "Enum",
    "ExchangePlans": "ExchangePlan",
    "HTTPServices": "HTTPService",
    "InformationRegisters": "InformationRegister",
    "Reports": "Report",
    "Tasks": "Task",
    "WebServices": "WebService",
}
#: What the word after a reference says about the access.
ACCESS = {
    "создатьменеджерзаписи": "manager",
    "createrecordmanager": "manager",
    "создатьнаборзаписей": "record_set",
    "createrecordset": "record_set",
    "выбрать": "selection",
    "select": "selection",
    "создатьэлемент": "object",
    "создатьдокумент": "object",
    "createitem": "object",
    "createdocument": "object",
    "найтипокоду": "ref",
    "найтипонаименованию": "ref",
    "findbycode": "ref",
    "findbydescription": "ref",
    "пустаяссылка": "ref",
    "emptyref": "ref",
    "получитьссылку": "ref",
    "getref": "ref",
}

_NAME = r"[^\W\d]\w*"
_SIGNATURE = re.compile(rf"^\s*(?:(?P<async>\w+)\s+)?(?P<kind>процедура|функция|procedure|function)\s+(?P<name>{_NAME})\s*\(", re.IGNORECASE)
_REGION = re.compile(r"^\s*#\s*(?P<word>\w+)(?:\s+(?P<name>\S+))?")
_CALL = re.compile(rf"(?:(?P<object>{_NAME})\s*\.\s*|(?P<chain>\)\s*\.\s*))?(?P<name>{_NAME})\s*\(")
_REFERENCE = re.compile(rf"(?<![\w.])(?P<type>{_NAME})\s*\.\s*(?P<name>{_NAME})(?:\s*\.\s*(?P<next>{_NAME}))?")
_IDENTIFIER = re.compile(rf"(?<![\w.]){_NAME}")
_ASSIGNED = re.compile(rf"^\s*({_NAME})\s*=")
_QUERY_START = re.compile(r"(?:текст|text)\s*=\s*\"|(?:новый|new)\s+(?:запрос|query)\s*\(\s*\"", re.IGNORECASE)
_QUERY_WORD = re.compile(r"\s*(?:выбрать|select)\b", re.IGNORECASE)
_TABLE = re.compile(rf"(?:\bиз|\bfrom|\bсоединение|\bjoin|,)\s+({_NAME}(?:\s*\.\s*{_NAME})+)", re.IGNORECASE)


# A string (a doubled quote is part of it; it may go on past the line), or a comment.
_OPAQUE = re.compile(r'"((?:[^"]|"")*)("?)|//.*', re.DOTALL)
_REST_OF_STRING = re.compile(r'((?:[^"]|"")*)("?)')


@lru_cache(maxsize=4096)
def code_only(line: str) -> str:
    """The line with string contents blanked and the comment cut; columns stay as they are.

    A line that starts with ``|`` goes on with the string of the line before.
    """
    head = ""
    if line.lstrip().startswith("|"):
        m = _REST_OF_STRING.match(line)
        head, line = " " * len(m[1]) + m[2], line[m.end() :]
    if '"' in line or "//" in line:
        line = _OPAQUE.sub(lambda m: "" if m[1] is None else '"' + " " * len(m[1]) + m[2], line)
    return head + line


def split_arguments(text: str) -> list[str]:
    """Top-level, comma-separated parts; none for blank text."""
    if not text.strip():
        return []
    parts, depth, quote = [""], 0, False
    for c in text:
        quote ^= c == '"'
        if not quote:
            depth += c in "([" and 1 or 0
            depth -= c in ")]" and 1 or 0
            if c == "," and depth == 0:
                parts.append("")
                continue
        parts[-1] += c
    return parts


def _parameters(text: str) -> list[dict]:
    out = []
    for part in split_arguments(text):
        head, eq, default = part.partition("=")
        words = head.split()
        by_value = bool(words) and words[0].lower() in BY_VALUE_WORDS
        name = words[by_value] if len(words) > by_value else ""
        out.append({"name": name, "by_value": by_value, "default_value": default.strip() if eq else None, "is_optional": bool(eq)})
    return out


def procedures_of(content: str) -> list[dict]:
    """Every procedure and function of a module, in order."""
    lines = content.split("\n")
    out: list[dict] = []
    regions: list[str] = []
    now: dict | None = None
    k = 0
    while k < len(lines):
        line = lines[k]
        if m := _REGION.match(line):
            word = m["word"].lower()
            if word in REGION_WORDS:
                regions.append(m["name"] or "")
            elif word in END_REGION_WORDS and regions:
                regions.pop()
        code = code_only(line)
        if now is None and (m := _SIGNATURE.match(code)) and (not m["async"] or m["async"].lower() in ASYNC_WORDS):
            # A signature may run over several lines; it ends with the parenthesis that closes it.
            text, last = line, k
            while _closed(code_only(text), m.end() - 1) < 0 and last + 1 < len(lines) and last - k < 10:
                last += 1
                text += "\n" + lines[last]
            clean = "\n".join(code_only(x) for x in text.split("\n"))
            end = _closed(clean, m.end() - 1)
            tail = clean[end + 1 :].split() if end >= 0 else []
            comment, directive, before = [], "", k - 1
            while before >= 0 and lines[before].strip().startswith(("//", "&")):
                stripped = lines[before].strip()
                if stripped.startswith("&"):
                    directive = stripped[1:] or directive
                else:
                    comment.insert(0, stripped)
                before -= 1
            now = {
                "name": m["name"],
                "is_function": m["kind"].lower() in FUNCTION_WORDS,
                "is_export": bool(tail) and tail[0].lower() in EXPORT_WORDS,
                "directive": directive,
                "parameters": _parameters(text[m.end() : end] if end >= 0 else ""),
                "start_line": k + 1,
                "end_line": k + 1,
                "signature": text.strip(),
                "body": "",
                "comment": "\n".join(comment),
                "region": regions[-1] if regions else None,
            }
            body_from = last + 1
            k = last
        elif now is not None and code.strip().lower().rstrip(";") in END_WORDS:
            now["end_line"] = k + 1
            now["body"] = "\n".join(lines[body_from:k])
            out.append(now)
            now = None
        k += 1
    if now is not None:  # never closed: it reaches to the end of the module
        now["end_line"] = len(lines)
        now["body"] = "\n".join(lines[body_from:])
        out.append(now)
    return out


def _closed(code: str, opening: int) -> int:
    depth = 0
    for k in range(opening, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if depth == 0:
            return k
    return -1


def calls_of(content: str) -> list[dict]:
    """Calls: name, object, arguments, place; definitions and keywords are none."""
    out = []
    for n, line in enumerate(content.split("\n"), 1):
        code = code_only(line)
        if "(" not in code:
            continue
        defined = _SIGNATURE.match(code)
        for m in _CALL.finditer(code):
            name = m["name"]
            if name.lower() in NOT_CALLS or defined and m.start("name") < defined.end():
                continue
            end = _closed(code, m.end() - 1)
            arguments = line[m.end() : end if end >= 0 else None].strip()
            before = code[: m.start()].split()
            out.append(
                {
                    "name": name,
                    "object_name": m["object"],
                    "arguments_text": arguments,
                    "argument_count": len(split_arguments(arguments)),
                    "line": n,
                    "column": m.start("name"),
                    "is_async": bool(before) and before[-1].lower() in AWAIT_WORDS,
                }
            )
    return out


def references_of(content: str) -> list[dict]:
    """Uses of metadata: Catalogs.X, Справочники.X and the like."""
    out = []
    for n, line in enumerate(content.split("\n"), 1):
        for m in _REFERENCE.finditer(code_only(line)):
            kind = _TYPE_OF.get(m["type"].lower())
            if kind:
                access = ACCESS.get((m["next"] or "").lower(), "reference")
                out.append({"reference_type": kind, "object_name": m["name"], "full_name": f"{kind}.{m['name']}", "access_type": access, "line": n, "column": m.start()})
    return out


def queries_of(content: str) -> list[dict]:
    """Query texts in string literals, continued over lines by ``|``; a doubled quote is part of the text."""
    out, at = [], 0
    while m := _QUERY_START.search(content, at):
        k, text = m.end(), []
        while k < len(content):
            if content[k] == '"':
                if content[k + 1 : k + 2] != '"':
                    break
                text.append('"')
                k += 2
            else:
                text.append(content[k])
                k += 1
        at = k + 1
        query = "\n".join(re.sub(r"^\s*\|", "", x) for x in "".join(text).split("\n"))
        if _QUERY_WORD.match(query):
            tables = list(dict.fromkeys(re.sub(r"\s+", "", t) for t in _TABLE.findall(query)))
            out.append({"query_text": query, "start_line": content.count("\n", 0, m.start()) + 1, "end_line": content.count("\n", 0, k) + 1, "tables": tables})
    return out


def variables_of(content: str) -> list[dict]:
    out = []
    for n, line in enumerate(content.split("\n"), 1):
        code = code_only(line)
        assigned = _ASSIGNED.match(code)
        for m in _IDENTIFIER.finditer(code):
            low = m[0].lower()
            if low in NOT_CALLS or low in RUN_WORDS or low in _TYPE_OF or code[: m.start()].rstrip().endswith(("#", "&")):
                continue
            out.append({"name": m[0], "line": n, "column": m.start(), "is_assignment": bool(assigned) and m.start() == assigned.start(1)})
    return out


def complexity_of(content: str) -> list[dict]:
    """Cyclomatic and cognitive complexity, nesting and size of every procedure."""
    lines = content.split("\n")
    out = []
    for p in procedures_of(content):
        cyclomatic, cognitive, depth, deepest = 1, 0, 0, 0
        for line in lines[p["start_line"] : p["end_line"] - 1]:
            for word in re.findall(r"\w+", code_only(line).lower()):
                cyclomatic += word in BRANCH_WORDS
                if word in NEST_OPEN:
                    cognitive += 1 + depth
                    depth += 1
                    deepest = max(deepest, depth)
                elif word in NEST_CLOSE:
                    depth = max(0, depth - 1)
        out.append(
            {"name": p["name"], "is_function": p["is_function"], "cyclomatic": cyclomatic, "cognitive": cognitive, "lines": p["end_line"] - p["start_line"] + 1, "n_parameters": len(p["parameters"]), "nesting_depth": deepest, "start_line": p["start_line"]}
        )
    return out


def issues_of(content: str) -> list[dict]:
    """Unbalanced blocks and deprecated words: code, severity, line, message."""
    out, stack = [], []
    openers = NEST_OPEN | {"процедура": "конецпроцедуры", "функция": "конецфункции", "procedure": "endprocedure", "function": "endfunction"}
    closers = set(openers.values())
    for n, line in enumerate(content.split("\n"), 1):
        code = code_only(line)
        if code.lstrip().startswith("#"):
            continue
        for word in re.findall(r"\w+", code.lower()):
            if word in openers:
                stack.append((openers[word], word, n))
            elif word in closers:
                if not stack:
                    out.append({"code": UNBALANCED, "severity": "error", "line": n, "message": f"{word} closes nothing"})
                elif stack[-1][0] != word:
                    out.append({"code": UNBALANCED, "severity": "error", "line": n, "message": f"{word} instead of {stack[-1][0]}"})
                    stack.pop()
                else:
                    stack.pop()
            elif word in DEPRECATED:
                out.append({"code": DEPRECATED_CODE, "severity": "warning", "line": n, "message": f"{word} is deprecated"})
    out += [{"code": UNBALANCED, "severity": "error", "line": n, "message": f"{word} is never closed"} for _, word, n in stack]
    return out


def formatted(content: str) -> str:
    """Lines indented by tabs along the blocks they stand in."""
    depth, out = 0, []
    openers = set(NEST_OPEN) | set(PROCEDURE_WORDS) | set(FUNCTION_WORDS)
    closers = set(NEST_OPEN.values()) | set(END_WORDS)
    middle = {"иначе", "иначеесли", "исключение", "else", "elsif", "except"}
    for line in content.split("\n"):
        words = re.findall(r"\w+", code_only(line).lower())
        stripped = line.strip()
        first = words[0] if words else ""
        back = first in closers or first in middle
        out.append("\t" * max(0, depth - back) + stripped if stripped else "")
        if not stripped.startswith("#"):
            depth = max(0, depth + sum(w in openers for w in words) - sum(w in closers for w in words))
    return "\n".join(out)


# Review rules, as rule, severity and the texts a line has and must not have.
UNREAD_RESULT = "BSP_QUERY_RESULT"
REVIEW_RULES = (
    ("BSP_TIMEZONE", "warning", "ТекущаяДата()", None),
    ("BSP_USER_MESSAGE", "info", "Сообщить(", "СообщитьПользователю"),
)


def format_modules(modules: DataFrame) -> DataFrame:
    """path and the formatted content of every module; null content stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if c is None else formatted(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "content"])

    return modules.select("path", "content").mapInArrow(run, "path string, content string")


def review(modules: DataFrame) -> DataFrame:
    """path, line, rule, severity for each line that breaks a rule; a query whose result is never unloaded is one too."""
    exploded = modules.select("path", F.col("content").contains(".Выгрузить(").alias("unloads"), F.posexplode(F.split("content", "\n")).alias("at", "text"))
    code = exploded.select("path", (F.col("at") + 1).alias("line"), "unloads", F.trim("text").alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("//"))
    hits = []
    for rule, severity, has, without in REVIEW_RULES:
        test = F.col("text").contains(has) if without is None else F.col("text").contains(has) & ~F.col("text").contains(without)
        hits.append(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))))
    hits.append(F.when(F.col("text").contains("Запрос.Выполнить()") & ~F.col("unloads"), F.struct(F.lit(UNREAD_RESULT).alias("rule"), F.lit("info").alias("severity"))))
    return code.select("path", "line", F.inline(F.array_compact(F.array(*hits))))


# --- as tables ---------------------------------------------------------------

SCHEMAS = {
    "procedures": "name string, is_function boolean, is_export boolean, directive string, parameters array<struct<name:string,by_value:boolean,default_value:string,is_optional:boolean>>, start_line int, end_line int, signature string, body string, comment string, region string",
    "calls": "name string, object_name string, arguments_text string, argument_count int, line int, column int, is_async boolean",
    "references": "reference_type string, object_name string, full_name string, access_type string, line int, column int",
    "queries": "query_text string, start_line int, end_line int, tables array<string>",
    "variables": "name string, line int, column int, is_assignment boolean",
    "complexity": "name string, is_function boolean, cyclomatic int, cognitive int, lines int, n_parameters int, nesting_depth int, start_line int",
    "issues": "code string, severity string, line int, message string",
}
_READERS: dict[str, Callable[[str], list[dict]]] = {
    "procedures": procedures_of,
    "calls": calls_of,
    "references": references_of,
    "queries": queries_of,
    "variables": variables_of,
    "complexity": complexity_of,
    "issues": issues_of,
}


def _placed(read: Callable[[str], list[dict]], at: str) -> Callable[[str], list[dict]]:
    """``read`` with the containing_procedure of every row, that whose lines hold it; procedures never overlap."""

    def rows(content: str) -> list[dict]:
        found = read(content)
        spans = procedures_of(content) if found else []
        starts = [p["start_line"] for p in spans]
        for r in found:
            k = bisect_right(starts, r[at]) - 1
            r["containing_procedure"] = spans[k]["name"] if k >= 0 and r[at] <= spans[k]["end_line"] else None
        return found

    return rows


def extract(modules: DataFrame, what: str, columns: list[str] | None = None, place: str | None = None) -> DataFrame:
    """path and the rows of one kind (a key of SCHEMAS) for every module (path, content); null content has none.

    columns: which of the kind's columns (all by default); the others never leave the worker.
    place: the column with a row's line; adds containing_procedure, as ``with_procedure``
    would, from the text at hand and without a join.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType, _parse_datatype_string

    read = _READERS[what]
    kind = StructType([f for f in _parse_datatype_string(SCHEMAS[what]).fields if columns is None or f.name in columns])
    if place:
        kind, read = kind.add("containing_procedure", StringType()), _placed(read, place)
    schema = StructType([*_parse_datatype_string("path string").fields, *kind.fields])
    arrow, names = to_arrow_schema(schema), kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rows = [], []
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = read(c) if c else []
                paths += [p] * len(found)
                rows += found
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array([r[n] for r in rows], arrow.field(n).type) for n in names]], schema=arrow)

    return modules.select("path", "content").mapInArrow(run, schema)


def extract_all(modules: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """``extract`` of several kinds from one pass over the modules: every text is read once, the rows are one table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

    parts = {k: _parse_datatype_string(SCHEMAS[k]) for k in kinds}
    schema = StructType([_parse_datatype_string("path string").fields[0], *[StructField(k, ArrayType(t)) for k, t in parts.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p} | {k: _READERS[k](c) for k in kinds} for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if c]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    held = staged(modules.select("path", "content").mapInArrow(run, schema), "code-rows")
    return {k: held.select("path", F.inline(k)) for k in kinds}


def with_procedure(rows: DataFrame, procedures: DataFrame, at: str = "line") -> DataFrame:
    """Adds containing_procedure: the one whose lines hold the row.  Joined on path and runs of lines, so a huge module is no hot key."""
    # Never broadcast: what a file of keys or packed texts holds is larger than its bytes tell.
    spans = procedures.select("path", F.col("name").alias("containing_procedure"), F.col("start_line").alias("__from"), F.col("end_line").alias("__to")).hint("merge")
    return containing(rows, spans, ["path"], at, "__from", "__to", width=LINES_TOGETHER, how="left").drop("__from", "__to")


def in_procedure(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.lower("containing_procedure") == name.lower())


def module_metrics(modules: DataFrame, least: int = 10) -> DataFrame:
    """Size and summed complexity per module, with the procedures above ``least``."""
    from lodestar.functions.text import line_metrics

    sizes = modules.select("path", *line_metrics("content"))
    per = extract(modules, "complexity").groupBy("path").agg(
        F.count_if(~F.col("is_function")).alias("n_procedures"),
        F.count_if(F.col("is_function")).alias("n_functions"),
        F.sum("cyclomatic").alias("cyclomatic"),
        F.sum("cognitive").alias("cognitive"),
        F.max("nesting_depth").alias("max_nesting"),
        F.array_sort(F.collect_list(F.when(F.col("cyclomatic") > least, F.col("name")))).alias("complex_procedures"),
    )
    return sizes.join(per.hint("merge"), "path", "left")


def procedure_id(path: str | Column, name: str | Column) -> Column:
    """Keeps the whole path, so equal module names never collide."""
    return F.concat_ws("::", path, name)


def call_edges(calls: DataFrame) -> DataFrame:
    """source, target, edge_type, file, line, column of calls that stand in a procedure, by name."""
    target = F.when(F.col("object_name").isNull(), F.col("name")).otherwise(F.concat_ws(".", "object_name", "name"))
    return calls.where("containing_procedure is not null").select(
        procedure_id("path", "containing_procedure").alias("source"), target.alias("target"), F.lit("calls").alias("edge_type"), F.col("path").alias("file"), "line", "column"
    )


def metadata_edges(references: DataFrame) -> DataFrame:
    return references.where("containing_procedure is not null").select(
        procedure_id("path", "containing_procedure").alias("source"), F.col("full_name").alias("target"), F.lit("uses_metadata").alias("edge_type"), F.col("path").alias("file"), "line", "column"
    )


def query_edges(queries: DataFrame) -> DataFrame:
    """source, target, edge_type, file, line, column of the tables that embedded queries read; unknown kinds of tables give no edge."""
    kinds = F.create_map(*[x for k, v in _TYPE_OF.items() for x in (F.lit(k), F.lit(v))])
    held = queries.where("containing_procedure is not null").select("path", "containing_procedure", F.col("start_line").alias("line"), F.explode("tables").alias("name"))
    target = F.concat_ws(".", kinds[F.lower(F.split_part("name", F.lit("."), F.lit(1)))], F.split_part("name", F.lit("."), F.lit(2)))
    known = kinds[F.lower(F.split_part("name", F.lit("."), F.lit(1)))].isNotNull()
    return held.where(known).select(
        procedure_id("path", "containing_procedure").alias("source"), target.alias("target"), F.lit("uses_query_table").alias("edge_type"), F.col("path").alias("file"), "line", F.lit(0).alias("column")
    )


def distinct_targets(calls: DataFrame) -> DataFrame:
    """path, and how many different methods and objects each module calls (any case)."""
    return calls.groupBy("path").agg(F.countDistinct(F.lower("name")).alias("methods"), F.countDistinct(F.lower("object_name")).alias("objects"))
