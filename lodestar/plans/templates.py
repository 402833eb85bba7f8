"""Code templates: search, suggestion, validation of values and substitution; builders from object descriptions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IF = re.compile(r"\{\{#if (\w+)\}\}((?:(?!\{\{#if )[\s\S])*?)(?:\{\{else\}\}((?:(?!\{\{#if )[\s\S])*?))?\{\{/if\}\}")
_EACH = re.compile(r"\{\{#each (\w+)\}\}((?:(?!\{\{#each )[\s\S])*?)\{\{/each\}\}")
_NAME = re.compile(r"\$\{([\w@.]+)(?::([^}]*))?\}")


def substitute(template: str, values: dict) -> str:
    """``${X:default}``, ``{{#if X}}…{{else}}…{{/if}}`` and ``{{#each X}}`` with ``${this}``, ``${index}``, ``${first}``, ``${last}``."""

    def each(m: re.Match) -> str:
        items = values.get(m[1]) or []
        parts = []
        for k, item in enumerate(items):
            scope = values | {"this": item, "index": k, "first": k == 0, "last": k == len(items) - 1} | (item if isinstance(item, dict) else {})
            parts.append(substitute(m[2], scope))
        return "".join(parts)

    while _EACH.search(template):
        template = _EACH.sub(each, template, 1)
    while _IF.search(template):
        template = _IF.sub(lambda m: m[2] if values.get(m[1]) else m[3] or "", template, 1)
    return _NAME.sub(lambda m: str(values[m[1]]) if values.get(m[1]) is not None else m[2] if m[2] is not None else m[0], template)


def validate(placeholders: list[dict], values: dict) -> list[str]:
    """Errors of ``values`` against placeholders (name, required, type, pattern, allowed)."""
    kinds = {"string": str, "number": (int, float), "boolean": bool, "list": list}
    out = []
    for p in placeholders:
        v = values.get(p["name"], p.get("default"))
        if v is None or v == "":
            if p.get("required"):
                out.append(f"{p['name']} is required")
            continue
        if p.get("type") in kinds and not isinstance(v, kinds[p["type"]]):
            out.append(f"{p['name']} is not a {p['type']}")
        if p.get("pattern") and not re.fullmatch(p["pattern"], str(v)):
            out.append(f"{p['name']} does not fit {p['pattern']}")
        if p.get("allowed") and v not in p["allowed"]:
            out.append(f"{p['name']} is none of {', '.join(map(str, p['allowed']))}")
    return out


def search(catalog: DataFrame, query: str, category: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Templates (id, name, name_ru, description, description_ru, category, tags array, template_code) with the text in any field."""
    texts = F.lower(F.concat_ws("\n", "id", "name", "name_ru", "description", "description_ru", F.array_join("tags", "\n")))
    found = catalog.where(texts.contains(query.lower()))
    found = found if category is None else found.where(F.col("category") == category)
    return found if not tags else found.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def suggest(catalog: DataFrame, task: str, object_type: str = "", module_type: str = "", limit: int = 10) -> DataFrame:
    """The best scored templates: words of the task in tags (0.3) or texts (0.2), fitting object (0.2) and module (0.1), at most 1."""
    words = [w for w in re.findall(r"\w+", task.lower()) if len(w) > 2]

    def any_of(test) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | test(w)
        return out

    # 0.3, 0.2, 0.2 and 0.1 are the weights of a suggestion.
    tags, texts = F.lower(F.array_join("tags", " ")), F.lower(F.concat_ws(" ", "name", "name_ru", "description", "description_ru"))
    score = F.when(any_of(lambda w: tags.contains(w)), 0.3).otherwise(0.0) + F.when(any_of(lambda w: texts.contains(w)), 0.2).otherwise(0.0)
    for value, points in ((object_type, 0.2), (module_type, 0.1)):
        if value:
            score = score + F.when(tags.contains(value.lower()) | texts.contains(value.lower()), points).otherwise(0.0)
    scored = catalog.withColumn("score", F.round(F.least(score, F.lit(1.0)), 6))
    return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def categories(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("category").agg(F.count("*").alias("n"))


def stats(catalog: DataFrame) -> DataFrame:
    """How many templates, categories and tags a catalog has."""
    tags = catalog.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("tags"))
    return catalog.agg(F.count("*").alias("templates"), F.countDistinct("category").alias("categories")).crossJoin(tags)  # one row each


def object_query(kind: str, name: str, attributes: list[tuple[str, bool]], section: tuple[str, list[str]] | None = None, obsolete: tuple[str, ...] = ("Удалить",)) -> str:
    """Dialect text that selects an object's fields (name, is_reference) and, by LEFT JOIN, one tabular section."""
    fields = [f"Д.{a} КАК {a}" if not ref else f"Д.{a}.Наименование КАК {a}" for a, ref in attributes if not a.startswith(obsolete)]
    source = f"{kind}.{name} КАК Д"
    if section:
        fields += [f"ТЧ.{a} КАК {section[0]}{a}" for a in section[1] if not a.startswith(obsolete)]
        source += f" ЛЕВОЕ СОЕДИНЕНИЕ {kind}.{name}.{section[0]} КАК ТЧ ПО ТЧ.Ссылка = Д.Ссылка"
    return f"ВЫБРАТЬ {', '.join(['Д.Ссылка КАК Ссылка', *fields])} ИЗ {source}"


def map_fields(register: list[tuple[str, str]], header: list[tuple[str, str]], section: list[tuple[str, str]]) -> dict[str, tuple[str, str] | None]:
    """Each register field to (side, field): same type in the section, same name there, then type and name in the header."""
    out: dict[str, tuple[str, str] | None] = {}
    for name, kind in register:
        reference = "." in kind
        rules = [
            ("section", lambda a: reference and a[1] == kind, section),
            ("section", lambda a: a[0].lower() == name.lower(), section),
            ("header", lambda a: reference and a[1] == kind, header),
            ("header", lambda a: a[0].lower() == name.lower(), header),
        ]
        out[name] = next(((side, a[0]) for side, test, fields in rules for a in fields if test(a)), None)
    return out


def movement_rows(documents: DataFrame, lines: DataFrame, key: str, mapping: dict[str, tuple[str, str] | None], period: str, kind: str = "Receipt") -> DataFrame:
    """Register rows of documents: one per line, fields taken by ``mapping``; unmapped fields are null."""
    joined = documents.alias("h").join(lines.alias("s"), key)
    columns = [(F.col(f"{'s' if at[0] == 'section' else 'h'}.{at[1]}") if at else F.lit(None).cast("string")).alias(name) for name, at in mapping.items()]
    return joined.select(F.col(key).alias("recorder"), F.col(f"h.{period}").alias("period"), F.lit(kind).alias("kind"), *columns)


def test_rows(spark: SparkSession, fields: list[tuple[str, str]], count: int = 10, seed: int = 0) -> DataFrame:
    """Made-up rows for an object's (name, type) fields; the same seed gives the same rows everywhere."""
    words = F.array(*map(F.lit, ["Alpha", "Beta", "Gamma", "Delta", "Omega"]))
    rows = spark.range(count)
    out = []
    for name, kind in fields:
        h = F.pmod(F.xxhash64(F.col("id"), F.lit(name), F.lit(seed)), F.lit(1_000_000))
        low = kind.lower()
        if low in ("number", "число"):
            value = h / 100
        elif low in ("boolean", "булево"):
            value = h % 2 == 0
        elif low in ("date", "дата"):
            value = F.date_add(F.lit("2020-01-01").cast("date"), (h % 2000).cast("int"))
        else:
            value = F.concat(F.element_at(words, (h % 5 + 1).cast("int")), F.lit(" "), h.cast("string"))
        out.append(value.alias(name))
    return rows.select(F.col("id").alias("row"), *out)
