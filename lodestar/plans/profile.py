"""A project's profile: conventions found in its metadata, merged with what a file says."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import store

# The profile of a project that says nothing.
DEFAULTS = {
    "language": "ru",
    "naming": {"language": "ru", "obsolete_prefixes": ["Удалить"], "presentation_field_overrides": {}},
    "bsp": {"used": True, "version": ""},
    "patterns": {"print_form": "bsp_print_management", "movement": "register_set"},
    "extensions": [],
}


def detected(objects: DataFrame, attributes: DataFrame, prefixes: list[str], markers: list[str], extensions: DataFrame | None = None) -> DataFrame:
    """One row: language by the share of Latin names, whether a marker module is there, prefixes that are used often enough, extensions.

    objects (name), attributes (name), extensions (extension, purpose); each is one aggregate.
    """
    common = store.common_prefixes(attributes, prefixes).agg(F.array_sort(F.collect_list("prefix")).alias("obsolete_prefixes"))  # at most one per prefix asked
    parts = [store.ascii_share(objects), store.any_named(objects, markers).withColumnRenamed("found", "bsp_used"), common]
    if extensions is not None:
        parts.append(extensions.agg(F.array_sort(F.collect_set(F.struct("extension", "purpose"))).alias("extensions")))
    return reduce(lambda a, b: a.crossJoin(b), parts).drop("share")  # one row each


def as_profile(row) -> dict:
    """The row of ``detected`` as a profile; what was not found stays at its default."""
    naming = DEFAULTS["naming"] | {"language": row["language"], "obsolete_prefixes": sorted({*DEFAULTS["naming"]["obsolete_prefixes"], *row["obsolete_prefixes"]})}
    found = [e.asDict() for e in row["extensions"]] if "extensions" in row else []
    return DEFAULTS | {"language": row["language"], "naming": naming, "bsp": DEFAULTS["bsp"] | {"used": row["bsp_used"]}, "extensions": found}


def merged(base: dict, override: dict, defaults: dict | None = None) -> dict:
    """``base`` with what ``override`` says beyond the defaults; sections are merged field by field."""
    defaults = DEFAULTS if defaults is None else defaults
    out = dict(base)
    for key, value in override.items():
        normal = defaults.get(key) if isinstance(defaults, dict) else None
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            out[key] = merged(base[key], value, normal if isinstance(normal, dict) else {})
        elif value != normal or key not in base:
            out[key] = value
    return out


def load(spark: SparkSession, path: str) -> dict:
    """The profile at ``path`` (JSON, or YAML where a parser is installed) over the defaults; the defaults if there is no file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return merged(DEFAULTS, {})
    text = jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        said = yaml.safe_load(text) or {}
    else:
        said = json.loads(text or "{}")
    if not isinstance(said, dict):
        raise ValueError(f"the profile at {path} is no mapping")
    unknown = set(said) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"the profile at {path} has unknown sections: {', '.join(sorted(unknown))}")
    return merged(DEFAULTS, said)


def save(spark: SparkSession, profile: dict, path: str) -> None:
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(profile, sort_keys=False, allow_unicode=True)
    else:
        text = json.dumps(profile, ensure_ascii=False, indent=1)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
