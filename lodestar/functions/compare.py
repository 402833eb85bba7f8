"""Two states of modules compared: procedures matched by name, changed ones line by line."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import code
from lodestar.staging import staged

#: Procedures to a part, as two states are matched.
ROWS_EACH = 50_000


def line_changes(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None, str]]:
    """(removed or added, line in the old text, line in the new one, text): a shortest edit script.

    Equal lines at both ends are passed over first.  What is kept of the rest is a longest
    common subsequence, by Myers' bit vectors: one word of len(new) bits per old line,
    so two texts of 10,000 lines need 12 MB.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for line in a:
        both = rows[-1] & places.get(line, 0)
        rows.append((rows[-1] + both | rows[-1] - both) & full)
    # Bit j of row i is clear where line j adds to what i old lines have in common with the new ones.
    out, i, j = [], len(a), len(b)
    while i or j:
        if j and rows[i] >> (j - 1) & 1:
            j -= 1
            out.append(("added", None, head + j + 1, b[j]))
        elif i and (not j or not rows[i - 1] >> (j - 1) & 1):
            i -= 1
            out.append(("removed", head + i + 1, None, a[i]))
        else:
            i, j = i - 1, j - 1
    return out[::-1]


def bodies(modules: DataFrame) -> DataFrame:
    """path, name, start_line and lines of every procedure; of equal names in one module the first."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines, seen = (content or "").split("\n"), set()
                for p in code.procedures_of(content) if content else []:
                    key = p["name"].lower()
                    if key not in seen:
                        seen.add(key)
                        # The carriage return of a line that ends with one is no part of it.
                        own = [x.removesuffix("\r") for x in lines[p["start_line"] - 1 : p["end_line"]]]
                        if p["end_line"] == len(lines):
                            own[-1] = lines[-1]
                        rows.append((path, key, p["start_line"], p["name"], own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "key", "start_line", "name", "lines"])

    return modules.select("path", "content").mapInArrow(run, "path string, key string, start_line int, name string, lines array<string>")


def procedures(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, name, status (added, removed, changed, same) and the old and new start and lines of every procedure of modules (path, content)."""
    a, b = staged(bodies(before), "compare-before"), staged(bodies(after), "compare-after")
    # As many parts as the rows ask for: a part's memory does not grow with the modules.
    parts = max(1, math.ceil(max(a.count(), b.count()) / ROWS_EACH))
    a, b = a.repartition(parts, "path", "key"), b.repartition(parts, "path", "key")
    was = a.select("path", "key", F.col("name").alias("old_name"), F.col("start_line").alias("old_start"), F.col("lines").alias("old_lines"))
    both = was.join(b.select("path", "key", F.col("name").alias("new_name"), F.col("start_line").alias("new_start"), F.col("lines").alias("new_lines")), ["path", "key"], "full_outer")
    status = F.when(F.col("old_lines").isNull(), "added").when(F.col("new_lines").isNull(), "removed").when(F.col("old_lines") == F.col("new_lines"), "same").otherwise("changed")
    return both.select("path", F.coalesce("new_name", "old_name").alias("name"), status.alias("status"), "old_start", "old_lines", "new_start", "new_lines")


def changed_lines(compared: DataFrame) -> DataFrame:
    """path, name, change (added, removed), old_line, new_line (in the module) and text of every line that differs in a changed procedure."""
    some = compared.where("status = 'changed'").select("path", "name", "old_start", "old_lines", "new_start", "new_lines")
    schema = "path string, name string, change string, old_line int, new_line int, text string"

    def run(batches):
        for batch in batches:
            rows = []
            for path, name, old_start, old, new_start, new in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for change, x, y, text in line_changes(old, new):
                    rows.append((path, name, change, None if x is None else old_start + x - 1, None if y is None else new_start + y - 1, text))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "name", "change", "old_line", "new_line", "text"])

    return some.mapInArrow(run, schema)


def summary(compared: DataFrame) -> DataFrame:
    """path and how many procedures were added, removed, changed and left alone."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return compared.groupBy("path").agg(*map(count, ("added", "removed", "changed", "same")))
