"""Readers for the other XML files of a tree: extensions, report schemas, spreadsheet grids and forms.

Each gives flat rows (parent pointers instead of trees, one row per cell), so that
lookups are filters and joins.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.trees import _child, _local, _root, _rows, _tag, _text, files, type_names


def _all(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _tag(x) == name] if e is not None else []


# --- extensions --------------------------------------------------------------


def extensions(spark: SparkSession, root: str) -> DataFrame:
    """extension, purpose, namespace, target, metadata_type, name, mode and parent of every object; adopted wins over replaced."""
    return read_extensions(files(spark, root, "Configuration.{xml,mdo}"))


def read_extensions(found: DataFrame) -> DataFrame:
    """The same from (path, content) rows of bytes."""

    def parse(content: bytes, _: str) -> list[dict]:
        e = _child(_root(content), "Configuration")
        if e is None:
            return []
        p = _child(e, "Properties")
        common = {"extension": _text(e, "Name") or _text(p, "Name"), "purpose": _text(p, "Purpose"), "namespace": _text(p, "NamePrefix"), "target": _text(p, "BaseConfigurationName")}
        out = []
        held = _child(e, "ChildObjects")
        for x in held if held is not None else []:
            mode = "Adopted" if x.get("Adopted") == "true" else "Replaced" if x.get("Replaced") == "true" else "Own"
            out.append(common | {"metadata_type": _tag(x), "name": (x.text or "").strip(), "mode": mode, "parent": x.get("parent") or ""})
        return out

    return _rows(found, "extension string, purpose string, namespace string, target string, metadata_type string, name string, mode string, parent string", parse)


def with_mode(objects: DataFrame, extension: str, mode: str | None = None) -> DataFrame:
    some = objects.where(F.col("extension") == extension)
    return some if mode is None else some.where(F.col("mode") == mode)


def extension_edges(objects: DataFrame, main: DataFrame) -> DataFrame:
    """Edges from extension objects: owns, and adopts or replaces where the main object (metadata_type, name) exists."""
    source = F.concat_ws(".", F.lit("Extension"), "extension", "metadata_type", "name")
    owns = objects.select(F.concat_ws(".", F.lit("Extension"), "extension").alias("source"), source.alias("target"), F.lit("extension_owns").alias("relationship"))
    base = F.coalesce(F.nullif("parent", F.lit("")), "name")
    keyed = objects.where("mode <> 'Own'").select(source.alias("source"), "mode", "metadata_type", base.alias("name"))
    known = keyed.join(main.select("metadata_type", "name").distinct(), ["metadata_type", "name"])
    kind = F.when(F.col("mode") == "Adopted", "extension_adopts").otherwise("extension_replaces")
    return owns.unionByName(known.select("source", F.concat_ws(".", "metadata_type", "name").alias("target"), kind.alias("relationship")))


def extension_impact(objects: DataFrame, metadata_type: str, name: str) -> DataFrame:
    return objects.where((F.col("metadata_type") == metadata_type) & (F.col("name") == name)).select("extension", "mode")


# --- report schemas ----------------------------------------------------------


def report_schemas(spark: SparkSession, root: str, glob: str = "Template.xml") -> DataFrame:
    """path, part (data_set, field, parameter, resource, calculated, setting), owner, name, title, kind and expression."""
    return read_report_schemas(files(spark, root, glob))


def read_report_schemas(found: DataFrame) -> DataFrame:
    """The same from (path, content) rows of bytes."""

    def parse(content: bytes, path: str) -> list[dict]:
        e = _root(content)
        if e is None or _tag(e) != "DataCompositionSchema":
            return []
        out = []

        def row(part, x, owner="", name=("Name", "DataPath"), kind=(), expression=("Expression",)):
            first = lambda names: next((t for n in names if (t := _text(x, n) or _local(x, n))), "")
            out.append({"path": path, "part": part, "owner": owner, "name": first([n for n in name] + [n[0].lower() + n[1:] for n in name]), "title": first(("Title", "title")), "kind": first(kind), "expression": first(expression)})

        # A union's children are data sets of their own.
        for s in _all(e, "DataSet") + _all(e, "dataSet"):
            row("data_set", s, kind=("Type", "type"), expression=("Query", "query"))
            for f in [x for x in s if _tag(x) in ("Field", "field")]:
                row("field", f, owner=_text(s, "Name") or _text(s, "name"), name=("DataPath", "Name"), kind=("Role", "role"), expression=())
        for tag, part in (("Parameter", "parameter"), ("TotalField", "resource"), ("CalculatedField", "calculated"), ("SettingsVariant", "setting")):
            for x in _all(e, tag) + _all(e, tag[0].lower() + tag[1:]):
                row(part, x, kind=("AvailableForUser",))
        return out

    return _rows(found, "path string, part string, owner string, name string, title string, kind string, expression string", parse)


def union_sets(sets: list[DataFrame]) -> DataFrame:
    """A union data set: the rows of all its sets, columns by name, those that a set lacks null."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def run_report(rows: DataFrame, groups: list[str], resources: list[tuple[str, str]], order: list[str] | None = None) -> DataFrame:
    """A report: ``groups`` and, per (name, expression), an aggregate in Spark SQL."""
    out = rows.groupBy(*groups).agg(*[F.expr(e).alias(n) for n, e in resources])
    return out.orderBy(*order) if order else out


# --- spreadsheet grids -------------------------------------------------------

_SQUARE, _ANGLE, _CURLY = re.compile(r"\[([^\[\]]+)\]"), re.compile(r"<([^<>/\s][^<>]*)>"), re.compile(r"\{([^{}]+)\}")
#: Markup that is no parameter.
_MARKUP = {"b", "i", "u", "br", "p", "div", "span", "table", "tr", "td", "th"}
#: Words of an area's name that tell its kind.
AREA_KINDS = {"header": ("шапка", "заголовок", "header"), "footer": ("подвал", "итог", "footer", "total"), "row": ("строка", "row", "detail")}


def cells(spark: SparkSession, root: str, glob: str = "*.mxl") -> DataFrame:
    """doc, row, col (from 1), n_rows and n_cols (how far the cell is merged) and text of every cell that has one."""
    return read_cells(files(spark, root, glob))


def _span(cell: ET.Element, *names: str) -> int:
    """How many rows or columns a cell takes: the first of these elements that holds a positive number, else 1."""
    return next((int(t) for n in names if (t := _text(cell, n)).isdigit() and int(t) > 0), 1)


def read_cells(found: DataFrame) -> DataFrame:
    """A cell stands behind all columns that the cells before it in its row take, texts or not."""

    def parse(content: bytes, path: str) -> list[dict]:
        out = []
        for row, r in enumerate(_all(_root(content), "Row"), 1):
            col = 1
            for c in [x for x in r if _tag(x) == "Cell"]:
                wide = _span(c, "MergeRight", "ColumnSpan")
                text = f"[{p}]" if (p := _text(c, "Parameter")) else _text(c, "Text")
                if text:
                    out.append({"doc": path, "row": row, "col": col, "n_rows": _span(c, "MergeDown", "RowSpan"), "n_cols": wide, "text": text})
                col += wide
        return out

    return _rows(found, "doc string, row int, col int, n_rows int, n_cols int, text string", parse)


def areas(spark: SparkSession, root: str, glob: str = "*.mxl") -> DataFrame:
    """doc, name, kind and bounds r1, c1, r2, c2 (null: unbounded) of the named areas."""
    return read_areas(files(spark, root, glob))


def read_areas(found: DataFrame) -> DataFrame:
    def parse(content: bytes, path: str) -> list[dict]:
        number = lambda a, n: int(t) if (t := _text(a, n)).isdigit() else None
        out = []
        for a in _all(_root(content), "Area"):
            name = _text(a, "Name")
            kind = next((k for k, words in AREA_KINDS.items() if any(w in name.lower() for w in words)), "other")
            out.append({"doc": path, "name": name, "kind": kind, "r1": number(a, "Top"), "c1": number(a, "Left"), "r2": number(a, "Bottom"), "c2": number(a, "Right")})
        return out

    return _rows(found, "doc string, name string, kind string, r1 int, c1 int, r2 int, c2 int", parse)


def parameters_of(text: str) -> list[tuple[str, bool]]:
    """Names in [x] and <x>, expressions in {x}, in order of place; markup is left out."""
    found = [(m.start(), m[1].strip(), False) for m in _SQUARE.finditer(text)]
    found += [(m.start(), m[1].strip(), False) for m in _ANGLE.finditer(text) if m[1].strip().lower() not in _MARKUP]
    found += [(m.start(), m[1].strip(), not re.fullmatch(r"\w+", m[1].strip())) for m in _CURLY.finditer(text)]
    return [(n, e) for _, n, e in sorted(found) if n]


def parameters(grid: DataFrame) -> DataFrame:
    """doc, name, is_expression, row and col: of each name its first place."""

    def find(batches):
        for b in batches:
            rows = [(d, r, c, n, e) for d, r, c, t in zip(*[x.to_pylist() for x in b.columns], strict=True) for n, e in parameters_of(t or "")]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc", "row", "col", "name", "is_expression"])

    each = grid.select("doc", "row", "col", "text").mapInArrow(find, "doc string, row int, col int, name string, is_expression boolean")
    return each.groupBy("doc", "name").agg(F.min(F.struct("row", "col", "is_expression")).alias("first")).select("doc", "name", "first.is_expression", "first.row", "first.col")


def template_files(spark: SparkSession, root: str) -> DataFrame:
    """path, owner_type, owner and template of every spreadsheet template in a tree."""
    return located_templates(files(spark, root, "*.{mxl,xml}").select("path"))


def located_templates(paths: DataFrame) -> DataFrame:
    """The same from paths: files below a Templates folder, or .mxl files anywhere."""
    tail = r"/([^/]+)/([^/]+)/Templates/([^/.]+)"
    part = lambda i: F.nullif(F.regexp_extract("path", tail, i), F.lit(""))
    name = F.coalesce(part(3), F.regexp_extract("path", r"/([^/]+)\.mxl$", 1))
    found = paths.where(F.col("path").rlike(tail) | F.col("path").endswith(".mxl"))
    return found.select("path", part(1).alias("owner_type"), part(2).alias("owner"), name.alias("template"))


# --- forms -------------------------------------------------------------------


def forms(spark: SparkSession, root: str, glob: str = "Form.xml") -> DataFrame:
    """path, part (element, attribute, command, handler), id, parent, kind, name and detail.

    Elements point to their parent; detail is an element's data path, an attribute's
    type, a command's action or a handler's procedure.
    """
    return read_forms(files(spark, root, glob))


def read_forms(found: DataFrame) -> DataFrame:
    def parse(content: bytes, path: str) -> list[dict]:
        e = _root(content)
        if e is None:
            return []
        out: list[dict] = []

        def put(part, parent, kind, name, detail):
            out.append({"path": path, "part": part, "id": len(out) + 1, "parent": parent, "kind": kind, "name": name, "detail": detail})
            return len(out)

        def walk(holder, parent):
            for x in holder if holder is not None else []:
                name = x.get("name") or _text(x, "Name")
                if not name:
                    continue
                me = put("element", parent, _tag(x), name, _text(x, "DataPath"))
                handlers(x, me)
                walk(_child(x, "ChildItems"), me)

        def handlers(owner, parent):
            held = _child(owner, "Events") if _child(owner, "Events") is not None else _child(owner, "Handlers")
            for x in held if held is not None else []:
                put("handler", parent, "event", x.get("name") or _text(x, "Event") or _tag(x), (x.text or "").strip() or _text(x, "Procedure"))

        form = next((x for x in [e, *e.iter()] if _child(x, "ChildItems") is not None or _child(x, "Attributes") is not None), e)
        handlers(form, 0)
        walk(_child(form, "ChildItems"), 0)
        for group, one, part, detail in (("Attributes", "Attribute", "attribute", None), ("Commands", "Command", "command", "Action")):
            held = _child(form, group)
            for x in [c for c in (held if held is not None else []) if _tag(c) == one]:
                what = ", ".join(type_names(_child(x, "Type"))) if detail is None else _text(x, detail)
                put(part, 0, one, x.get("name") or _text(x, "Name"), what)
        return out

    return _rows(found, "path string, part string, id int, parent int, kind string, name string, detail string", parse)
