"""The bilingual query dialect: lexer, parser, translation to Spark SQL, advice.

A text (one query, or a batch separated by ``;``) is parsed by recursive descent
into ``Select`` trees.  ``to_sql`` writes them as Spark SQL, resolving prefixed
tables and virtual register tables through a ``Schema``; Catalyst does the rest.
Parameters ``&Name`` become named markers ``:Name`` and are bound by ``spark.sql``,
never pasted into the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Keywords of the dialect, Russian to English.
KEYWORDS = {
    "ВЫБРАТЬ": "SELECT",
    "РАЗЛИЧНЫЕ": "DISTINCT",
    "ПЕРВЫЕ": "TOP",
    "ИЗ": "FROM",
    "ГДЕ": "WHERE",
    "СГРУППИРОВАТЬ": "GROUP",
    "ИМЕЮЩИЕ": "HAVING",
    "УПОРЯДОЧИТЬ": "ORDER",
    "ВОЗР": "ASC",
    "УБЫВ": "DESC",
    "СОЕДИНЕНИЕ": "JOIN",
    "ЛЕВОЕ": "LEFT",
    "ПРАВОЕ": "RIGHT",
    "ПОЛНОЕ": "FULL",
    "ВНУТРЕННЕЕ": "INNER",
    "ВНЕШНЕЕ": "OUTER",
    "И": "AND",
    "ИЛИ": "OR",
    "НЕ": "NOT",
    "В": "IN",
    "МЕЖДУ": "BETWEEN",
    "ПОДОБНО": "LIKE",
    "ЕСТЬ": "IS",
    "КАК": "AS",
    "ПОМЕСТИТЬ": "INTO",
    "ОБЪЕДИНИТЬ": "UNION",
    "ВСЕ": "ALL",
    "ИТОГИ": "TOTALS",
    "ОБЩИЕ": "OVERALL",
    "ВЫБОР": "CASE",
    "КОГДА": "WHEN",
    "ТОГДА": "THEN",
    "ИНАЧЕ": "ELSE",
    "КОНЕЦ": "END",
    "ИСТИНА": "TRUE",
    "ЛОЖЬ": "FALSE",
    "НЕОПРЕДЕЛЕНО": "UNDEFINED",
    "УНИЧТОЖИТЬ": "DROP",
}
#: Aggregate and scalar functions of the dialect, Russian to Spark.
FUNCTIONS = {
    "СУММА": "sum",
    "КОЛИЧЕСТВО": "count",
    "СРЕДНЕЕ": "avg",
    "МИНИМУМ": "min",
    "МАКСИМУМ": "max",
    "ЕСТЬNULL": "coalesce",
    "ПОДСТРОКА": "substring",
    "ГОД": "year",
    "КВАРТАЛ": "quarter",
    "МЕСЯЦ": "month",
    "ДЕНЬ": "day",
    "ЧАС": "hour",
    "МИНУТА": "minute",
    "СЕКУНДА": "second",
    "ISNULL": "coalesce",
}
AGGREGATES = {"sum", "count", "avg", "min", "max"}
#: Table prefixes, Russian to English.
PREFIXES = {
    "Справочник": "Catalog",
    "Документ": "Document",
    "РегистрСведений": "InformationRegister",
    "РегистрНакопления": "AccumulationRegister",
    "РегистрБухгалтерии": "AccountingRegister",
    "РегистрРасчета": "CalculationRegister",
    "Перечисление": "Enum",
    "ПланСчетов": "ChartOfAccounts",
    "ПланВидовХарактеристик": "ChartOfCharacteristicTypes",
    "ПланОбмена": "ExchangePlan",
    "Константа": "Constant",
    "Последовательность": "Sequence",
    "БизнесПроцесс": "BusinessProcess",
    "Задача": "Task",
}
#: Virtual tables, Russian to English.
VIRTUAL = {
    "СрезПоследних": "SliceLast",
    "СрезПервых": "SliceFirst",
    "Остатки": "Balance",
    "Обороты": "Turnovers",
    "ОстаткиИОбороты": "BalanceAndTurnovers",
}
#: Periodicities of turnovers, Russian to Spark.
PERIODS = {"День": "DAY", "Неделя": "WEEK", "Месяц": "MONTH", "Квартал": "QUARTER", "Год": "YEAR", "Час": "HOUR"}
PERIODS |= {v.capitalize(): v for v in PERIODS.values()}

_PREFIX_BY_LOWER = {k.lower(): v for k, v in PREFIXES.items()} | {v.lower(): v for v in PREFIXES.values()}
_VIRTUAL_BY_LOWER = {k.lower(): v for k, v in VIRTUAL.items()} | {v.lower(): v for v in VIRTUAL.values()}
_PERIOD_BY_LOWER = {k.lower(): v for k, v in PERIODS.items()}
_WORDS = set(KEYWORDS.values()) | {"BY", "NULL", "ON", "ПО", "ESCAPE"}

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
      | (?P<string>"(?:[^"]|"")*")
      | (?P<param>&\w+)
      | (?P<number>\d+(?:\.\d+)?)
      | (?P<word>[^\W\d]\w*)
      | (?P<sign><>|!=|>=|<=|[=<>+\-*/(),.;{}])""",
    re.VERBOSE,
)


class DialectError(ValueError):
    """The text is not a query of the dialect."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def key(self) -> str:
        """English keyword, or '' for anything else."""
        if self.kind != "word":
            return ""
        up = self.text.upper()
        up = KEYWORDS.get(up, up)
        return up if up in _WORDS else ""


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DialectError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


# --- trees -------------------------------------------------------------------


@dataclass
class Table:
    name: str  # normalised: Catalog.X, or a temporary table's name
    alias: str | None = None
    section: str | None = None
    virtual: str | None = None
    arguments: list[list[Token]] = field(default_factory=list)
    query: Query | None = None


@dataclass
class Join:
    kind: str
    table: Table
    on: list[Token]


@dataclass
class Field:
    tokens: list[Token]
    alias: str | None = None


@dataclass
class Select:
    fields: list[Field] = field(default_factory=list)
    distinct: bool = False
    top: int | None = None
    into: str | None = None
    table: Table | None = None
    joins: list[Join] = field(default_factory=list)
    where: list[Token] = field(default_factory=list)
    group: list[list[Token]] = field(default_factory=list)
    having: list[Token] = field(default_factory=list)

    @property
    def tables(self) -> list[Table]:
        return ([self.table] if self.table else []) + [j.table for j in self.joins]


@dataclass
class Query:
    branches: list[tuple[str, Select]] = field(default_factory=list)  # ('', first), ('UNION'|'UNION ALL', next)…
    order: list[tuple[list[Token], bool]] = field(default_factory=list)
    totals: list[list[Token]] = field(default_factory=list)
    totals_by: list[list[Token]] = field(default_factory=list)
    drop: str | None = None

    @property
    def first(self) -> Select:
        return self.branches[0][1]


class Parser:
    """Recursive descent over tokens; expressions stay token lists, cut at top-level commas and clause words."""

    ENDS = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "UNION", "INTO", "TOTALS", "LEFT", "RIGHT", "FULL", "INNER", "JOIN", "AS", "ON", "ПО"}

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, k: int = 0) -> Token:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else Token("end", "", -1)

    def take(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def accept(self, *keys: str) -> bool:
        if self.peek().key in keys:
            self.at += 1
            return True
        return False

    def sign(self, text: str) -> bool:
        if self.peek().kind == "sign" and self.peek().text == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.sign(text):
            raise DialectError(f"expected {text!r} at {self.peek().at}, found {self.peek().text!r}")

    def name(self) -> str:
        token = self.take()
        if token.kind != "word":
            raise DialectError(f"expected a name at {token.at}, found {token.text!r}")
        return token.text

    def expression(self, stop: set[str], commas: bool = True) -> list[Token]:
        """Tokens up to a comma, ``;``, closing parenthesis or clause word at depth 0.  CASE … END nests like parentheses."""
        out, depth = [], 0
        while (t := self.peek()).kind != "end":
            if depth == 0 and (t.kind == "sign" and t.text in ((",", ")", ";") if commas else (")", ";")) or t.key in stop):
                break
            depth += (t.text == "(") + (t.key == "CASE") - (t.text == ")") - (t.key == "END")
            out.append(self.take())
        if depth:
            raise DialectError("unbalanced parentheses")
        return out

    def batch(self) -> list[Query]:
        out = []
        while self.peek().kind != "end":
            if self.sign(";"):
                continue
            out.append(self.query())
            if self.peek().kind != "end" and not self.sign(";"):
                raise DialectError(f"unexpected {self.peek().text!r} at {self.peek().at}")
        return out

    def query(self) -> Query:
        q = Query()
        if self.accept("DROP"):
            q.drop = self.name()
            return q
        q.branches.append(("", self.select()))
        while self.accept("UNION"):
            q.branches.append(("UNION ALL" if self.accept("ALL") else "UNION", self.select()))
        while True:
            if self.peek().key == "ORDER":
                self.take()
                self.accept("BY", "ПО")
                while True:
                    e = self.expression(self.ENDS | {"ASC", "DESC"})
                    down = self.accept("DESC") or (self.accept("ASC") and False)
                    q.order.append((e, down))
                    if not self.sign(","):
                        break
            elif self.accept("TOTALS"):
                while self.peek().key not in ("BY", "ПО", ""):
                    break
                while self.peek().kind != "end" and self.peek().key not in ("BY", "ПО"):
                    q.totals.append(self.expression(self.ENDS | {"BY"}))
                    if not self.sign(","):
                        break
                if self.accept("BY", "ПО"):
                    while True:
                        if not self.accept("OVERALL"):
                            q.totals_by.append(self.expression(self.ENDS))
                        if not self.sign(","):
                            break
            else:
                return q

    def select(self) -> Select:
        if not self.accept("SELECT"):
            raise DialectError(f"expected SELECT at {self.peek().at}, found {self.peek().text!r}")
        s = Select()
        while True:
            if self.accept("DISTINCT"):
                s.distinct = True
            elif self.accept("TOP"):
                s.top = int(self.take().text)
            elif self.peek().kind == "word" and self.peek().text.upper() in ("РАЗРЕШЕННЫЕ", "ALLOWED"):
                self.take()
            else:
                break
        while True:
            e = self.expression(self.ENDS)
            if e:
                alias = self.name() if self.accept("AS") else None
                if alias is None and len(e) > 1 and e[-1].kind == "word" and not e[-1].key and (e[-2].kind in ("word", "string", "number", "param") and not e[-2].key or e[-2].text == ")"):
                    alias = e.pop().text
                s.fields.append(Field(e, alias))
            if not self.sign(","):
                break
        if self.accept("INTO"):
            s.into = self.name()
        if self.accept("FROM"):
            s.table = self.source()
            while (k := self.peek().key) in ("LEFT", "RIGHT", "FULL", "INNER", "JOIN") or self.peek().text == ",":
                if self.sign(","):
                    s.joins.append(Join("CROSS", self.source(), []))
                    continue
                kind = "INNER" if k == "JOIN" else k
                if k != "JOIN":
                    self.take()
                self.accept("OUTER")
                if not self.accept("JOIN"):
                    raise DialectError(f"expected JOIN at {self.peek().at}")
                table = self.source()
                if not self.accept("ON", "ПО"):
                    raise DialectError(f"expected ON at {self.peek().at}")
                s.joins.append(Join(kind, table, self.expression(self.ENDS - {"ON", "ПО"}, commas=True)))
        if self.accept("WHERE"):
            s.where = self.expression(self.ENDS, commas=False)
        if self.accept("GROUP"):
            self.accept("BY", "ПО")
            while True:
                s.group.append(self.expression(self.ENDS))
                if not self.sign(","):
                    break
        if self.accept("HAVING"):
            s.having = self.expression(self.ENDS, commas=False)
        return s

    def source(self) -> Table:
        if self.sign("("):
            table = Table("", query=self.query())
            self.need(")")
        else:
            parts = [self.name()]
            while self.sign("."):
                parts.append(self.name())
            prefix = _PREFIX_BY_LOWER.get(parts[0].lower())
            if prefix and len(parts) > 1:
                table = Table(f"{prefix}.{parts[1]}")
                if len(parts) > 2:
                    virtual = _VIRTUAL_BY_LOWER.get(parts[2].lower())
                    table.virtual, table.section = virtual, None if virtual else parts[2]
            else:
                table = Table(".".join(parts))
            if table.virtual and self.sign("("):
                while True:
                    table.arguments.append(self.expression(set()))
                    if not self.sign(","):
                        break
                self.need(")")
        if self.accept("AS"):
            table.alias = self.name()
        elif self.peek().kind == "word" and not self.peek().key:
            table.alias = self.name()
        return table


def parse_batch(text: str) -> list[Query]:
    return Parser(lex(text)).batch()


# --- flat description --------------------------------------------------------


@dataclass
class ParsedQuery:
    """What a caller sees of a query: every clause of the first one of a batch, names of all."""

    select_fields: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    conditions: list[dict] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    order_by: list[dict] = field(default_factory=list)
    parameters: list[str] = field(default_factory=list)
    temp_tables: list[str] = field(default_factory=list)
    is_distinct: bool = False
    top_count: int | None = None
    has_subqueries: bool = False
    errors: list[str] = field(default_factory=list)


def plain(tokens: list[Token]) -> str:
    """Tokens as text, spaced for reading."""
    out = ""
    for t in tokens:
        tight = t.text in (".", ",", ")") or out.endswith((".", "(")) or t.text == "(" and out and out.split()[-1:] and re.fullmatch(r"\w+", out.split()[-1])
        out += ("" if tight or not out else " ") + t.text
    return out


def _aggregate(tokens: list[Token]) -> str | None:
    if len(tokens) > 1 and tokens[0].kind == "word" and tokens[1].text == "(":
        name = FUNCTIONS.get(tokens[0].text.upper(), tokens[0].text.lower())
        return name.upper() if name in AGGREGATES else None
    return None


def _conditions(tokens: list[Token]) -> list[dict]:
    """The comparisons at the top level of AND and OR."""
    parts, now, depth, between = [], [], 0, False
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        between = between or t.key == "BETWEEN"
        if depth == 0 and t.key in ("AND", "OR") and not (between and t.key == "AND"):
            parts.append(now)
            now = []
            continue
        if between and depth == 0 and t.key == "AND":
            between = False
        now.append(t)
    parts.append(now)
    out = []
    for p in parts:
        depth = 0
        for k, t in enumerate(p):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0 and (t.text in ("=", "<>", "!=", ">=", "<=", ">", "<") or t.key in ("LIKE", "IN", "BETWEEN", "IS")):
                right = p[k + 1 :]
                out.append({"left_operand": plain(p[:k]), "operator": t.key or t.text, "right_operand": plain(right), "is_parameter": any(x.kind == "param" for x in right)})
                break
    return out


def parse(text: str) -> ParsedQuery:
    """The flat description; a text that does not parse gives what its tokens tell, and the error."""
    out = ParsedQuery()
    try:
        tokens = lex(text)
        out.parameters = list(dict.fromkeys(t.text[1:] for t in tokens if t.kind == "param"))
        batch = Parser(tokens).batch()
    except DialectError as e:
        out.errors.append(str(e))
        return out
    queries = [q for q in batch if q.branches]
    if not queries:
        out.errors.append("no query")
        return out
    out.has_subqueries = sum(t.key == "SELECT" for t in tokens) > len(queries) + sum(len(q.branches) - 1 for q in queries)
    for q in queries:
        out.temp_tables += [s.into for _, s in q.branches if s.into]
        for _, s in q.branches:
            _describe_tables(s, out.tables)
    main = queries[-1].first
    for f in main.fields:
        aggregate = _aggregate(f.tokens)
        out.select_fields.append({"expression": plain(f.tokens), "alias": f.alias, "is_aggregate": aggregate is not None, "aggregate_function": aggregate})
    out.conditions = _conditions(main.where) if main.where else []
    out.group_by = [plain(g) for g in main.group]
    out.order_by = [{"field": plain(e), "direction": "DESC" if down else "ASC"} for e, down in queries[-1].order]
    out.is_distinct, out.top_count = main.distinct, main.top
    return out


def _describe_tables(s: Select, out: list[dict]) -> None:
    for t in s.tables:
        if t.query:
            for _, inner in t.query.branches:
                _describe_tables(inner, out)
        else:
            name = t.name + (f".{t.section}" if t.section else "")
            out.append({"table_name": name, "alias": t.alias, "is_virtual_table": t.virtual is not None, "virtual_table_type": t.virtual, "virtual_parameters": [plain(a) for a in t.arguments]})


def validate(parsed: ParsedQuery, available: list[str] | None = None) -> dict:
    """is_valid, errors, warnings, suggestions and unknown_tables."""
    errors, warnings, suggestions = list(parsed.errors), [], []
    if not parsed.select_fields:
        errors.append("the SELECT list is empty")
    if not parsed.tables:
        errors.append("no source table")
    if any(f["is_aggregate"] for f in parsed.select_fields) or parsed.group_by:
        grouped = {g.lower() for g in parsed.group_by}
        for f in parsed.select_fields:
            if not f["is_aggregate"] and f["expression"].lower() not in grouped and any(c.isalpha() for c in f["expression"]) and not f["expression"].startswith("&"):
                warnings.append(f"{f['expression']} is neither aggregated nor grouped by")
    if len(parsed.tables) > 3 and not parsed.conditions:
        warnings.append("more than three tables and no WHERE")
    if parsed.has_subqueries:
        suggestions.append("a temporary table may replace the subquery")
    known = None if available is None else set(available) | set(parsed.temp_tables)
    unknown = [] if known is None else [t["table_name"] for t in parsed.tables if t["table_name"] not in known]
    return {"is_valid": not errors, "errors": errors, "warnings": warnings, "suggestions": suggestions, "unknown_tables": unknown}


def suggest(parsed: ParsedQuery) -> list[dict]:
    """Advice as rows of kind and text."""
    out = []
    if any(f["expression"] == "*" or f["expression"].endswith(".*") for f in parsed.select_fields):
        out.append({"kind": "select_star", "text": "name the fields instead of *: fewer columns are read"})
    for t in parsed.tables:
        if t["virtual_table_type"] in ("SliceLast", "SliceFirst") and not any(t["virtual_parameters"]):
            out.append({"kind": "slice_without_period", "text": f"{t['table_name']}: give the slice a period and a condition in its parameters"})
    if parsed.has_subqueries:
        out.append({"kind": "subquery", "text": "put a subquery that is used more than once into a temporary table"})
    if parsed.is_distinct and parsed.group_by:
        out.append({"kind": "distinct_with_group", "text": "DISTINCT is redundant beside GROUP BY"})
    return out


def explain(parsed: ParsedQuery) -> str:
    """What the query does, line by line."""
    lines = []
    if parsed.tables:
        lines.append("Sources: " + ", ".join(t["table_name"] + (f".{t['virtual_table_type']}" if t["is_virtual_table"] else "") + (f" as {t['alias']}" if t["alias"] else "") for t in parsed.tables))
    if parsed.select_fields:
        lines.append("Fields: " + ", ".join(f["expression"] + (f" as {f['alias']}" if f["alias"] else "") for f in parsed.select_fields))
    for label, items in (
        ("Conditions", [f"{c['left_operand']} {c['operator']} {c['right_operand']}" for c in parsed.conditions]),
        ("Grouped by", parsed.group_by),
        ("Ordered by", [f"{o['field']} {o['direction']}" for o in parsed.order_by]),
        ("Parameters", parsed.parameters),
        ("Temporary tables", parsed.temp_tables),
    ):
        if items:
            lines.append(f"{label}: " + ", ".join(items))
    flags = [x for x, on in (("distinct rows", parsed.is_distinct), (f"first {parsed.top_count}", parsed.top_count), ("subqueries", parsed.has_subqueries)) if on]
    if flags:
        lines.append("Modifiers: " + ", ".join(flags))
    return "\n".join(lines + [f"Error: {e}" for e in parsed.errors])


def review(queries: DataFrame, available: list[str] | None = None) -> DataFrame:
    """``queries`` with is_valid, errors, warnings, unknown_tables, advice and explanation of their ``query_text``; null texts are not valid."""
    own = "is_valid boolean, errors array<string>, warnings array<string>, unknown_tables array<string>, advice array<string>, explanation string"
    schema = T.StructType([*queries.schema.fields, *T._parse_datatype_string(own).fields])

    def run(batches):
        kinds = (pa.bool_(), *[pa.list_(pa.string())] * 4, pa.string())
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index("query_text")).to_pylist():
                parsed = parse(text or "")
                checked = validate(parsed, available)
                rows.append((checked["is_valid"], checked["errors"], checked["warnings"], checked["unknown_tables"], [a["kind"] for a in suggest(parsed)], explain(parsed)))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return queries.mapInArrow(run, schema)


# --- translation -------------------------------------------------------------


@dataclass
class Register:
    """What a virtual table needs to know of a register."""

    dimensions: list[str]
    resources: list[str]
    period: str = "period"
    tie: list[str] = field(default_factory=list)
    kind: str | None = None  # column that says Receipt or Expense; None: turnovers only
    others: list[str] = field(default_factory=list)


@dataclass
class Schema:
    """Dialect names to Spark relations: tables maps Catalog.X (or Document.X.Section) to a view."""

    tables: dict[str, str]
    registers: dict[str, Register] = field(default_factory=dict)

    def view(self, table: Table) -> str:
        name = table.name + (f".{table.section}" if table.section else "")
        by_lower = {k.lower(): v for k, v in self.tables.items()}
        return quoted(by_lower.get(name.lower(), name))


def quoted(name: str) -> str:
    return ".".join(f"`{p}`" if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", p) else p for p in name.split("."))


class Writer:
    def __init__(self, schema: Schema):
        self.schema = schema

    def query(self, q: Query) -> str:
        if len(q.branches) == 1 and q.totals_by:
            body = self.with_totals(q)
        else:
            body = " ".join((f"{op} " if op else "") + self.select(s, bare=len(q.branches) == 1) for op, s in q.branches)
        if q.order:
            body += " ORDER BY " + ", ".join(self.expression(e) + (" DESC" if down else "") for e, down in q.order)
        if len(q.branches) == 1 and q.first.top is not None:
            body += f" LIMIT {q.first.top}"
        return body

    def with_totals(self, q: Query) -> str:
        """TOTALS: the rows of the query rolled up by the given fields, detail rows kept, grand total first."""
        by = [self.expression(e) for e in q.totals_by]
        names = [f.alias or plain(f.tokens).split(".")[-1] for f in q.first.fields]
        sums = {}
        for e in q.totals:
            aggregate, inner = _aggregate(e), plain(e[2:-1])
            sums[inner.split(".")[-1].lower()] = f"{(aggregate or 'SUM').lower()}({quoted(inner)})"
        keys = {k.lower() for k in by}
        columns = [sums.get(n.lower(), quoted(n) if n.lower() in {k.strip('`') for k in keys} else f"CAST(NULL AS STRING)") + f" AS {quoted(n)}" for n in names]
        detail = ", ".join(quoted(n) for n in names)
        inner = self.select(q.first, bare=True)
        level = f"{len(by)} - bit_count(grouping_id({', '.join(by)}))"
        return f"SELECT {', '.join(columns)}, CAST({level} AS INT) AS totals_level FROM ({inner}) GROUP BY ROLLUP({', '.join(by)}) UNION ALL SELECT {detail}, {len(by) + 1} AS totals_level FROM ({inner})"

    def select(self, s: Select, bare: bool = True) -> str:
        fields = ", ".join(self.expression(f.tokens) + (f" AS {quoted(f.alias)}" if f.alias else "") for f in s.fields)
        out = f"SELECT {'DISTINCT ' if s.distinct else ''}{fields}"
        if s.table:
            out += f" FROM {self.table(s.table)}"
        for j in s.joins:
            out += f" CROSS JOIN {self.table(j.table)}" if j.kind == "CROSS" else f" {j.kind} JOIN {self.table(j.table)} ON {self.expression(j.on)}"
        if s.where:
            out += f" WHERE {self.expression(s.where)}"
        if s.group:
            out += " GROUP BY " + ", ".join(map(self.expression, s.group))
        if s.having:
            out += f" HAVING {self.expression(s.having)}"
        if not bare and s.top is not None:
            out = f"(SELECT * FROM ({out}) LIMIT {s.top})"
        return out

    def table(self, t: Table) -> str:
        alias = f" AS {quoted(t.alias)}" if t.alias else ""
        if t.query:
            return f"({self.query(t.query)}){alias}"
        if t.virtual:
            return f"({self.virtual(t)}){alias or ' AS ' + quoted(t.virtual)}"
        return self.schema.view(t) + alias

    def virtual(self, t: Table) -> str:
        registers = {k.lower(): v for k, v in self.schema.registers.items()}
        if t.name.lower() not in registers:
            raise DialectError(f"{t.name} is not described as a register")
        r, view = registers[t.name.lower()], self.schema.view(t)
        arguments = [self.expression(a) for a in t.arguments] + [""] * 4
        dims = ", ".join(map(quoted, r.dimensions))
        period, condition = quoted(r.period), arguments[1] if t.virtual in ("SliceLast", "SliceFirst", "Balance") else arguments[3]
        wheres = [f"({condition})"] if condition else []
        if t.virtual in ("SliceLast", "SliceFirst"):
            last = t.virtual == "SliceLast"
            if arguments[0]:
                wheres.append(f"{period} {'<=' if last else '>='} {arguments[0]}")
            order = ", ".join(f"{quoted(c)} {'DESC' if last else 'ASC'}" for c in [r.period, *r.tie])
            columns = ", ".join(map(quoted, [r.period, *r.dimensions, *r.resources, *r.others]))
            inner = f"SELECT {columns}, row_number() OVER (PARTITION BY {dims} ORDER BY {order}) AS slice_row FROM {view}{_where(wheres)}"
            return f"SELECT {columns} FROM ({inner}) WHERE slice_row = 1"
        signed = lambda x: f"CASE WHEN {quoted(r.kind)} = 'Receipt' THEN {quoted(x)} ELSE -{quoted(x)} END" if r.kind else quoted(x)
        if t.virtual == "Balance":
            if arguments[0]:
                wheres.append(f"{period} < {arguments[0]}")
            sums = ", ".join(f"sum({signed(x)}) AS {quoted(x + 'Balance')}, sum({signed(x)}) AS {quoted(x + 'Остаток')}" for x in r.resources)
            return f"SELECT {dims}, {sums} FROM {view}{_where(wheres)} GROUP BY {dims}"
        if arguments[0]:
            wheres.append(f"{period} >= {arguments[0]}")
        if arguments[1]:
            wheres.append(f"{period} <= {arguments[1]}")
        every = _PERIOD_BY_LOWER.get(plain(t.arguments[2]).lower()) if len(t.arguments) > 2 and t.arguments[2] else None
        bucket = f"CAST(date_trunc('{every}', {period}) AS TIMESTAMP_NTZ)" if every else None
        sums = []
        for x in r.resources:
            sums.append(f"sum({signed(x)}) AS {quoted(x + 'Turnover')}, sum({signed(x)}) AS {quoted(x + 'Оборот')}")
            if r.kind:
                for kind, en, ru in (("Receipt", "Receipt", "Приход"), ("Expense", "Expense", "Расход")):
                    one = f"sum(CASE WHEN {quoted(r.kind)} = '{kind}' THEN {quoted(x)} ELSE 0 END)"
                    sums.append(f"{one} AS {quoted(x + en)}, {one} AS {quoted(x + ru)}")
        head = f"{dims}, {bucket} AS {period}" if bucket else dims
        by = f"{dims}, {bucket}" if bucket else dims
        if t.virtual == "Turnovers":
            return f"SELECT {head}, {', '.join(sums)} FROM {view}{_where(wheres)} GROUP BY {by}"
        # Balance and turnovers: everything before the start is opening balance, so the scan is bounded above only.
        start = arguments[0]
        upper = _where([w for w in wheres if not (start and w == f"{period} >= {start}")])
        when = f"CASE WHEN {period} < {start} THEN NULL ELSE {bucket or '0'} END" if start else bucket or "0"
        before = f"{period} < {start}" if start else "false"
        inner, outer = [], []
        for x in r.resources:
            inner += [f"sum({signed(x)}) AS {quoted(x + '_all')}", f"sum(CASE WHEN {before} THEN 0 ELSE {signed(x)} END) AS {quoted(x + '_turn')}"]
            over = f"OVER (PARTITION BY {dims} ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING)"
            closing, turn = f"sum({quoted(x + '_all')}) {over}", quoted(x + "_turn")
            outer += [f"{closing} - {turn} AS {quoted(x + 'OpeningBalance')}", f"{turn} AS {quoted(x + 'Turnover')}", f"{closing} AS {quoted(x + 'ClosingBalance')}"]
        grouped = f"SELECT {dims}, {when} AS bucket, {', '.join(inner)} FROM {view}{upper} GROUP BY {dims}, {when}"
        rows = f"SELECT {dims}, bucket AS {period}, bucket IS NULL AS before_start, {', '.join(outer)} FROM ({grouped})"
        return f"SELECT * FROM ({rows})" + (" WHERE NOT before_start" if start and every else "")

    def expression(self, tokens: list[Token]) -> str:
        out: list[str] = []
        k = 0
        while k < len(tokens):
            t, after = tokens[k], tokens[k + 1] if k + 1 < len(tokens) else None
            if t.text == "(" and after is not None and after.key == "SELECT":
                end = _closing(tokens, k)
                out.append(f"({self.query(Parser(tokens[k + 1 : end]).query())})")
                k = end + 1
                continue
            if t.kind == "string":
                out.append("'" + t.text[1:-1].replace('""', '"').replace("\\", "\\\\").replace("'", "\\'") + "'")
            elif t.kind == "param":
                out.append(":" + t.text[1:])
            elif t.kind == "word":
                dotted = out and out[-1] == "." or after is not None and after.text == "."
                if t.text.upper() in ("ДАТАВРЕМЯ", "DATETIME") and after is not None and after.text == "(":
                    end = _closing(tokens, k + 1)
                    parts = [self.expression(p) for p in _split(tokens[k + 2 : end])]
                    out.append(f"make_timestamp_ntz({', '.join(parts + ['1', '1', '0', '0', '0'][len(parts) - 1 :])})")
                    k = end + 1
                    continue
                if after is not None and after.text == "(" and not dotted and t.text.upper() in FUNCTIONS:
                    out.append(FUNCTIONS[t.text.upper()])
                elif t.key in ("UNDEFINED",):
                    out.append("NULL")
                elif t.key and not dotted:
                    out.append("" if t.key == "ПО" else t.key)
                elif after is not None and after.text == "(" and not dotted:
                    out.append(t.text)
                else:
                    out.append(quoted(t.text))
            else:
                out.append(t.text)
            k += 1
        text = " ".join(x for x in out if x)
        text = re.sub(r"\s*\.\s*", ".", text) if "'" not in text else "".join(p if i % 2 else re.sub(r"\s*\.\s*", ".", p) for i, p in enumerate(re.split(r"('(?:[^'\\]|\\.)*')", text)))
        return re.sub(r"(\b[A-Za-z_]\w*) \(", lambda m: m[0] if m[1].upper() in _WORDS else m[1] + "(", text)


def _where(parts: list[str]) -> str:
    return " WHERE " + " AND ".join(parts) if parts else ""


def _closing(tokens: list[Token], opening: int) -> int:
    depth = 0
    for k in range(opening, len(tokens)):
        depth += (tokens[k].text == "(") - (tokens[k].text == ")")
        if depth == 0:
            return k
    raise DialectError("unbalanced parentheses")


def _split(tokens: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def to_sql(text: str, schema: Schema) -> list[str]:
    """Spark SQL of every query of the batch, temporary tables as CREATE statements left out."""
    writer = Writer(schema)
    return [writer.query(q) for q in parse_batch(text) if not q.drop]


def run(spark: SparkSession, text: str, schema: Schema, **parameters) -> DataFrame:
    """The result of the last query of the batch; INTO makes temporary views on the way."""
    writer, out = Writer(schema), None
    for q in parse_batch(text):
        if q.drop:
            spark.catalog.dropTempView(q.drop)
            continue
        sql = writer.query(q)
        used = {k: v for k, v in parameters.items() if re.search(rf":{k}\b", sql)}
        out = spark.sql(sql, args=used)
        if q.first.into:
            out.createOrReplaceTempView(quoted(q.first.into))
    if out is None:
        raise DialectError("no query")
    return out
