"""Readers for configuration trees: XML objects, source modules, roles, forms, reports, extensions, grids, catalogs.

Files come in through Spark's binaryFile source, so any store that Spark reads
will do, and parsing is one map stage per kind: Arrow in, typed rows out.  Entity
declarations are refused, so a hostile file cannot expand or reach elsewhere.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "cp866")

_ATTRIBUTE = "struct<name:string,synonym:string,type:string,types:array<string>,comment:string,indexed:boolean>"
OBJECT = (
    "metadata_type string, name string, uuid string, synonym string, comment string, "
    f"attributes array<{_ATTRIBUTE}>, tabular_sections array<struct<name:string,synonym:string,attributes:array<{_ATTRIBUTE}>>>, "
    f"dimensions array<{_ATTRIBUTE}>, resources array<{_ATTRIBUTE}>, forms array<string>, templates array<string>, posting boolean, register_records array<string>, "
    "event_source array<string>, event_handler string, method_name string, type_constituents array<string>, auto_use string, content array<string>, based_on array<string>, produces array<string>, root_url string, url_templates array<struct<name:string,template:string>>, file_hash string, path string"
)


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path and content (binary) of every file under ``root`` that fits the glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")


def decoded(content: bytes | None) -> str | None:
    """Text by the first encoding that fits; cp866 fits everything."""
    if content is None:
        return None
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("cp866", "replace")


def modules(spark: SparkSession, root: str) -> DataFrame:
    """path, content (text), owner_type, owner and module of every source module."""
    return read_modules(files(spark, root, "*.bsl"))


def read_modules(found: DataFrame) -> DataFrame:
    """The same from (path, content) rows of bytes."""

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoded(x) for x in b.column(1).to_pylist()], pa.string())], ["path", "content"])

    rows = found.select("path", "content").mapInArrow(read, "path string, content string")
    # A folder of the other layout carries its type as a suffix of the object's name.
    tail = r"/([^/]+)/([^/.]+)(?:\.[^/]+)?(?:/Ext|/Forms/[^/]+(?:/Ext(?:/Form)?)?)?/([^/]+)\.bsl$"
    plain = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    return rows.select("path", "content", *[F.nullif(F.regexp_extract(plain, tail, i), F.lit("")).alias(n) for i, n in ((1, "owner_type"), (2, "owner"), (3, "module"))])


def _root(content: bytes) -> ET.Element | None:
    if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
        return None
    try:
        return ET.fromstring(content)
    except ET.ParseError:
        return None


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        e = next((c for c in e if _tag(c) == name), None) if e is not None else None
    return e


def _text(e: ET.Element | None, *names: str) -> str:
    e = _child(e, *names)
    return (e.text or "").strip() if e is not None else ""


def _local(e: ET.Element | None, name: str) -> str:
    """A localized string: the Russian entry if there is one, else the first, else plain text."""
    e = _child(e, name)
    if e is None:
        return ""
    found = []
    for item in e:
        lang = item.get("lang") or _text(item, "lang")
        found.append((lang, _text(item, "content") or (item.text or "").strip()))
    return next((t for lang, t in found if lang == "ru"), found[0][1] if found else (e.text or "").strip())


def _items(e: ET.Element | None, *names: str) -> list[str]:
    """Texts of the entries of a list element, whatever the entries are called."""
    e = _child(e, *names)
    return [t for c in (e if e is not None else []) if (t := (c.text or "").strip() or _text(c, "Name"))]


def type_names(e: ET.Element | None) -> list[str]:
    """All types of a type description, in either the nested or the comma-joined form."""
    if e is None:
        return []
    nested = [(c.text or "").strip() for c in e.iter() if c is not e and _tag(c) in ("Type", "TypeSet", "types")]
    joined = [t.strip() for t in (e.text or "").split(",")]
    return [re.sub(r"^xs:", "", t) for t in nested + joined if t]


def _attributes(owner: ET.Element, group: str, one: str) -> list[dict]:
    out = []
    holder = _child(owner, group)
    for e in [c for c in (holder if holder is not None else []) if _tag(c) == one] + [c for c in _objects(owner) if _tag(c) == one]:
        p = _child(e, "Properties") if _child(e, "Properties") is not None else e
        types = type_names(_child(p, "Type"))
        out.append({"name": _text(p, "Name"), "synonym": _local(p, "Synonym"), "type": types[0] if types else "", "types": types, "comment": _local(p, "Comment"), "indexed": _text(p, "Indexing") not in ("", "false", "DontIndex")})
    return out


def _objects(owner: ET.Element) -> list[ET.Element]:
    held = _child(owner, "ChildObjects")
    return list(held) if held is not None else []


def parse_object(content: bytes, path: str = "") -> dict | None:
    """One object file as a row; None for what is no object."""
    root = _root(content)
    if root is None or _tag(root) != "MetaDataObject" or not len(root):
        return None
    e = root[0]
    p = _child(e, "Properties") if _child(e, "Properties") is not None else e
    sections = []
    holder = _child(e, "TabularSections")
    for s in [c for c in [*(holder if holder is not None else []), *_objects(e)] if _tag(c) == "TabularSection"]:
        q = _child(s, "Properties") if _child(s, "Properties") is not None else s
        sections.append({"name": _text(q, "Name"), "synonym": _local(q, "Synonym"), "attributes": _attributes(s, "Attributes", "Attribute")})
    import hashlib

    return {
        "metadata_type": _tag(e),
        "name": _text(p, "Name"),
        "uuid": e.get("uuid") or "",
        "synonym": _local(p, "Synonym"),
        "comment": _local(p, "Comment"),
        "attributes": _attributes(e, "Attributes", "Attribute"),
        "tabular_sections": sections,
        "dimensions": _attributes(e, "Dimensions", "Dimension"),
        "resources": _attributes(e, "Resources", "Resource"),
        "forms": _items(e, "Forms") + [(c.text or "").strip() for c in _objects(e) if _tag(c) == "Form"],
        "templates": _items(e, "Templates") + [(c.text or "").strip() for c in _objects(e) if _tag(c) == "Template"],
        "posting": _text(p, "Posting").lower() in ("true", "allow"),
        "register_records": _items(p, "RegisterRecords"),
        "event_source": type_names(_child(p, "Source")),
        "event_handler": _text(p, "Handler"),
        "method_name": _text(p, "MethodName"),
        "type_constituents": type_names(_child(p, "Type")),
        "auto_use": _text(p, "AutoUse"),
        "content": _items(p, "Content"),
        "based_on": _items(p, "BasedOn"),
        "produces": _items(p, "Produces") + _items(p, "ProducesDocuments"),
        "root_url": _text(p, "RootURL"),
        "url_templates": [{"name": _text(q, "Name"), "template": _text(q, "Template")} for c in _objects(e) if _tag(c) == "URLTemplate" for q in [_child(c, "Properties") if _child(c, "Properties") is not None else c]],
        "file_hash": hashlib.md5(content).hexdigest(),
        "path": path,
    }


def _rows(df: DataFrame, schema: str, parse: Callable[[bytes, str], list[dict]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parse(content or b"", path)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.select("path", "content").mapInArrow(run, schema)


def objects(spark: SparkSession, root: str) -> DataFrame:
    """Every object of the tree, in either layout; unreadable files and files of other kinds give no row."""
    return read_objects(files(spark, root, "*.{xml,mdo}"))


def read_objects(found: DataFrame) -> DataFrame:
    """The same from (path, content) rows of bytes."""
    return _rows(found, OBJECT, lambda c, p: [o] if (o := parse_object(c, p)) and o["metadata_type"] != "Configuration" else [])


def overlaid(spark: SparkSession, roots: list[str], glob: str = "*.{xml,mdo}") -> DataFrame:
    """path and content of the files of several trees, the later roots over the earlier: of one object only the last tree's file counts.

    Files that hold no object are kept from every root.
    """
    every = reduce(DataFrame.unionByName, [files(spark, r, glob).withColumn("__root", F.lit(k)) for k, r in enumerate(roots)])
    if len(roots) == 1:
        return every.drop("__root")
    named = read_objects(every).select("path", "metadata_type", "name").join(every.select("path", "__root"), "path")
    best = named.groupBy("metadata_type", "name").agg(F.max("__root").alias("__best"))
    hidden = named.join(best, ["metadata_type", "name"]).where("__root < __best").select("path")
    return every.join(hidden, "path", "left_anti").drop("__root")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """type and name of everything the configuration lists, in both shapes of the manifest."""
    return read_manifest(files(spark, root, "Configuration.{xml,mdo}"))


def read_manifest(found: DataFrame) -> DataFrame:
    def parse(content: bytes, _: str) -> list[dict]:
        e = _child(_root(content), "Configuration")
        out = []
        for c in e if e is not None else []:
            if _tag(c) == "ChildObjects":
                out += [{"type": _tag(x), "name": (x.text or "").strip()} for x in c]
            elif len(c) and all(_tag(x) == "item" and not x.get("lang") for x in c):
                out += [{"type": _singular(_tag(c)), "name": (x.text or "").strip()} for x in c]
        return out

    return _rows(found, "type string, name string", parse)


def listed(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Every object of the manifest; one without a file has its type and name only."""
    return manifest.select(F.col("type").alias("metadata_type"), "name").distinct().join(found, ["metadata_type", "name"], "left")


def _parent_folder() -> Column:
    """The subsystem in whose folder a file lies, null at the top."""
    plain = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    parent = F.regexp_extract(plain, r"/Subsystems/([^/.]+)(?:\.[^/]+)?/Subsystems/[^/]+(?:/[^/]+)?\.(?:xml|mdo)$", 1)
    return F.nullif(parent, F.lit(""))


def subsystems(found: DataFrame) -> DataFrame:
    """name, parent, synonym and content of the subsystems; the parent is the subsystem in whose folder the file lies, null at the top."""
    return found.where("metadata_type = 'Subsystem'").select("name", _parent_folder().alias("parent"), "synonym", "content")


def _singular(plural: str) -> str:
    special = {"BusinessProcesses": "BusinessProcess", "ChartsOfAccounts": "ChartOfAccounts", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes", "ChartsOfCalculationTypes": "ChartOfCalculationTypes"}
    return special.get(plural, plural.removesuffix("s"))


def layout(spark: SparkSession, root: str) -> str:
    """``edt`` if the tree has Configuration/Configuration.mdo, else ``configurator``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/Configuration/Configuration.mdo")
    return "edt" if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else "configurator"


def roles(spark: SparkSession, root: str) -> DataFrame:
    """role, object, right, value and rls (restriction templates), one row per right."""
    return read_roles(files(spark, root, "*.xml"))


def read_roles(found: DataFrame) -> DataFrame:
    def parse(content: bytes, _: str) -> list[dict]:
        e = _child(_root(content), "Role")
        if e is None:
            return []
        rights = _child(e, "Rights")
        out = []
        for o in rights if rights is not None else []:
            for r in [c for c in o if _tag(c) == "Right"]:
                rls = [(x.text or "").strip() for x in r.iter() if _tag(x) in ("Template", "condition", "RestrictionByCondition") and (x.text or "").strip()]
                out.append({"role": _text(e, "Name"), "object": o.get("path") or _text(o, "name"), "right": _text(r, "Name"), "value": _text(r, "Value") == "true", "rls": rls})
        return out

    return _rows(found, "role string, object string, right string, value boolean, rls array<string>", parse)


def rights_of(rights: DataFrame, object_name: str, right: str | None = None) -> DataFrame:
    """Roles with at least one granted right on an object (any case), and those rights."""
    some = rights.where((F.lower("object") == object_name.lower()) & F.col("value"))
    some = some if right is None else some.where(F.lower("right") == right.lower())
    return some.groupBy("role").agg(F.array_sort(F.collect_set("right")).alias("rights"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rls")))).alias("rls"))


# --- edges from objects ------------------------------------------------------

# Reference prefixes of type strings, to object types.
REFERENCE_TYPES = {
    "СправочникСсылка": "Catalog",
    "ДокументСсылка": "Document",
    "ПеречислениеСсылка": "Enum",
    "ПланВидовХарактеристикСсылка": "ChartOfCharacteristicTypes",
    "ПланСчетовСсылка": "ChartOfAccounts",
    "ПланВидовРасчетаСсылка": "ChartOfCalculationTypes",
    "БизнесПроцессСсылка": "BusinessProcess",
    "ЗадачаСсылка": "Task",
    "ПланОбменаСсылка": "ExchangePlan",
    "ОпределяемыйТипСсылка": "DefinedType",
    "CatalogRef": "Catalog",
    "DocumentRef": "Document",
    "EnumRef": "Enum",
    "ChartOfCharacteristicTypesRef": "ChartOfCharacteristicTypes",
    "ChartOfAccountsRef": "ChartOfAccounts",
    "ChartOfCalculationTypesRef": "ChartOfCalculationTypes",
    "BusinessProcessRef": "BusinessProcess",
    "TaskRef": "Task",
    "ExchangePlanRef": "ExchangePlan",
    "DefinedType": "DefinedType",
    "InformationRegisterRecordKey": "InformationRegister",
    "AccumulationRegisterRecordKey": "AccumulationRegister",
    "AccountingRegisterRecordKey": "AccountingRegister",
    "CalculationRegisterRecordKey": "CalculationRegister",
}
# Prefixes of registers and event sources, to object types.
OWNER_TYPES = {
    "РегистрНакопления": "AccumulationRegister",
    "РегистрСведений": "InformationRegister",
    "РегистрБухгалтерии": "AccountingRegister",
    "РегистрРасчета": "CalculationRegister",
    "AccumulationRegister": "AccumulationRegister",
    "InformationRegister": "InformationRegister",
    "AccountingRegister": "AccountingRegister",
    "CalculationRegister": "CalculationRegister",
    "DocumentObject": "Document",
    "CatalogObject": "Catalog",
    "ДокументОбъект": "Document",
    "СправочникОбъект": "Catalog",
    "InformationRegisterRecordSet": "InformationRegister",
    "AccumulationRegisterRecordSet": "AccumulationRegister",
    "ExchangePlanObject": "ExchangePlan",
    "BusinessProcessObject": "BusinessProcess",
    "TaskObject": "Task",
    "ReportObject": "Report",
    "DataProcessorObject": "DataProcessor",
}


def _mapped(column: Column, prefixes: dict[str, str]) -> Column:
    """``Prefix.Name`` (a namespace before it is dropped) as ``Type.Name``; null for unknown prefixes."""
    plain = F.regexp_replace(column, r"^\w+:", "")
    kinds = F.create_map(*[x for k, v in prefixes.items() for x in (F.lit(k), F.lit(v))])
    kind = kinds[F.split_part(plain, F.lit("."), F.lit(1))]
    return F.when(kind.isNotNull(), F.concat_ws(".", kind, F.split_part(plain, F.lit("."), F.lit(2))))


def _own() -> Column:
    return F.concat_ws(".", "metadata_type", "name")


def nodes(found: DataFrame) -> DataFrame:
    """id, node_type, name and synonym of every object and every form of one.  Objects are read once."""
    node = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("id", "node_type", "name", "synonym"), strict=True)])
    own = F.array(node(_own(), F.col("metadata_type"), F.col("name"), F.col("synonym")))
    forms = F.transform("forms", lambda f: node(F.concat_ws(".", "metadata_type", "name", F.lit("Form"), f), F.lit("Form"), f, F.lit("")))
    return found.select(F.inline(F.concat(own, F.coalesce(forms, F.filter(own, lambda _: F.lit(False))))))


def owner_of(node: Column | str) -> Column:
    """The object to which a node belongs: itself, or that of a form or module."""
    return F.regexp_extract(node, r"^([^.]+\.[^.]+)", 1)


def owned_modules(found: DataFrame) -> DataFrame:
    """path, owner (its node) and module_type of modules (path, owner_type, owner, module) that lie in an object's folder."""
    from lodestar.functions.code import FOLDERS

    kinds = F.create_map(*[x for k, v in FOLDERS.items() for x in (F.lit(k), F.lit(v))])
    of_form = F.col("path").rlike("/Forms/") | F.col("owner_type").isin("CommonForms", "CommonForm")
    kind = F.when(F.col("module") != "Module", F.col("module")).when(of_form, "FormModule").otherwise("CommonModule")
    known = F.when(F.col("owner_type").isin(*FOLDERS.values()), F.col("owner_type"))  # a type may stand for its folder
    rows = found.withColumn("__kind", F.coalesce(kinds[F.col("owner_type")], known)).where("__kind is not null and owner is not null")
    return rows.select("path", F.concat_ws(".", "__kind", "owner").alias("owner"), kind.alias("module_type"))


def module_id(owner: str = "owner", module_type: str = "module_type") -> Column:
    return F.concat_ws(".", owner, F.lit("Module"), module_type)


def module_nodes(owned: DataFrame) -> DataFrame:
    """Nodes of modules, as ``nodes``; the form modules of one object are one node."""
    return owned.select(module_id().alias("id"), F.lit("Module").alias("node_type"), F.col("module_type").alias("name"), F.lit("").alias("synonym")).distinct()


def module_edges(owned: DataFrame, procedures: DataFrame | None = None) -> DataFrame:
    """As ``edges``: from each module to its object, and from the object to the procedures (path, name) of its modules."""
    from lodestar.functions.code import procedure_id

    out = owned.select(module_id().alias("source"), F.col("owner").alias("target"), F.lit("module_ownership").alias("relationship"), F.lit("").alias("label")).distinct()
    if procedures is None:
        return out
    held = procedures.select("path", "name").join(owned.select("path", "owner"), "path")
    return out.unionByName(held.select(F.col("owner").alias("source"), procedure_id("path", "name").alias("target"), F.lit("procedure_ownership").alias("relationship"), F.lit("").alias("label")))


def edges(found: DataFrame, owner: bool = False) -> DataFrame:
    """source, target, relationship and label of every reference between objects; targets need not exist.  Objects are read once.

    Members point to what they belong to: an object to its subsystem, a form to its
    object.  owner: also the object whose file declares the edge, which is not always
    its source.
    """
    none = F.array().cast("array<struct<source:string,target:string,relationship:string,label:string>>")

    def of(refs: Column, prefixes: dict[str, str] | None, relationship: str, kind: str | None = None, turned: bool = False) -> Column:
        """refs: strings, or structs of ref and label; kind: of objects of that type only; turned: from the reference to the object."""
        plain = lambda x: x if prefixes is None else _mapped(x, prefixes)
        ends = lambda x: (plain(x["ref"]), _own()) if turned else (_own(), plain(x["ref"]))
        made = F.transform(refs, lambda x: F.struct(ends(x)[0].alias("source"), ends(x)[1].alias("target"), F.lit(relationship).alias("relationship"), x["label"].alias("label")))
        return F.coalesce(made if kind is None else F.when(F.col("metadata_type") == kind, made), none)

    def unlabelled(refs: Column) -> Column:
        return F.transform(refs, lambda x: F.struct(x.alias("ref"), F.lit("").alias("label")))

    def typed(attributes: Column | str) -> Column:
        return F.flatten(F.transform(attributes, lambda a: F.transform(a["types"], lambda t: F.struct(t.alias("ref"), a["name"].alias("label")))))

    def based(x: Column) -> Column:
        return F.when(x.contains("."), F.coalesce(_mapped(x, REFERENCE_TYPES), x)).otherwise(F.concat(F.lit("Document."), x))

    sections = F.flatten(F.transform("tabular_sections", lambda s: F.flatten(F.transform(s["attributes"], lambda a: F.transform(a["types"], lambda t: F.struct(t.alias("ref"), F.concat_ws(".", s["name"], a["name"]).alias("label")))))))
    parts = [
        of(typed("attributes"), REFERENCE_TYPES, "attribute_reference"),
        of(sections, REFERENCE_TYPES, "tabular_reference"),
        of(typed("dimensions"), REFERENCE_TYPES, "dimension_type"),
        of(typed("resources"), REFERENCE_TYPES, "resource_type"),
        of(unlabelled(F.col("register_records")), OWNER_TYPES, "register_movement", "Document"),
        of(unlabelled(F.col("event_source")), OWNER_TYPES, "event_subscription"),
        of(unlabelled(F.array(F.regexp_extract("event_handler", r"^([^.]+\.[^.]+)", 1))), None, "subscription_handler"),
        of(unlabelled(F.array(F.regexp_extract("method_name", r"^([^.]+\.[^.]+)", 1))), None, "scheduled_job_method"),
        of(unlabelled(F.col("type_constituents")), REFERENCE_TYPES, "defined_type_contains", "DefinedType"),
        of(unlabelled(F.col("content")), None, "common_attribute_usage", "CommonAttribute"),
        of(unlabelled(F.col("content")), None, "subsystem_membership", "Subsystem", turned=True),
        of(unlabelled(F.transform("forms", lambda f: F.concat_ws(".", "metadata_type", "name", F.lit("Form"), f))), None, "form_ownership", turned=True),
        of(unlabelled(F.transform("based_on", based)), None, "based_on"),
        of(unlabelled(F.transform("produces", based)), None, "produces"),
        of(unlabelled(F.array(F.concat(F.lit("Subsystem."), _parent_folder()))), None, "subsystem_hierarchy", "Subsystem"),
    ]
    every = found.select(*([_own().alias("owner")] if owner else []), F.inline(F.concat(*parts)))
    return every.where("target is not null and target <> '' and source is not null and source <> ''")
