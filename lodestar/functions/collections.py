"""The platform's collections on Spark: value tables as DataFrames with a row number, arrays, maps and lists as columns.

A value table is any DataFrame with a column ``row`` that counts from 0; methods that
change the order renumber it.  Renumbering sorts by ranges and counts per range, so
no table passes through one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.staging import staged

ROW = "row"


# --- value tables ------------------------------------------------------------


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``row`` from 0 along ``order`` (which should leave no ties)."""
    held = rows.drop(ROW)
    dealt = staged(held.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "value-table")
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    parts = parts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    place = F.col("__base") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(parts), "__part").withColumn(ROW, place).select(ROW, *held.columns)  # a row per partition


def sort(table: DataFrame, columns: str) -> DataFrame:
    """Rows by a list such as ``"Sum DESC, Name"`` (``УБЫВ`` and ``ВОЗР`` too); ties keep their order."""
    order = []
    for part in columns.split(","):
        name, _, way = part.strip().partition(" ")
        down = way.strip().lower() in ("desc", "убыв")
        order.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first())
    return numbered(table.withColumn("__was", F.col(ROW)), [*order, F.col("__was").asc()]).drop("__was")


def group_by(table: DataFrame, groups: str, sums: str = "") -> DataFrame:
    """One row per distinct values of ``groups`` with the sums of ``sums`` (comma-separated names)."""
    keys, added = ([x.strip() for x in names.split(",") if x.strip()] for names in (groups, sums))
    first = F.min(ROW).alias("__first")
    return numbered(table.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in added], first), [F.col("__first").asc()]).drop("__first")


def find_rows(table: DataFrame, wanted: dict) -> DataFrame:
    """Rows in which every named column has the value; null finds null."""
    return table.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()], F.lit(True)))


def find(table: DataFrame, value, columns: str = "") -> DataFrame:
    """The first row that has the value in one of the columns (all, if none is named)."""
    names = [x.strip() for x in columns.split(",") if x.strip()] or [c for c in table.columns if c != ROW]
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string") == F.lit(value).cast("string"), F.lit(False)) for c in names])
    return table.where(hit).orderBy(ROW).limit(1)


def copy(table: DataFrame, wanted: dict | None = None, columns: str = "") -> DataFrame:
    some = find_rows(table, wanted or {})
    names = [x.strip() for x in columns.split(",") if x.strip()]
    return numbered(some.select(F.col(ROW).alias("__was"), *(names or [c for c in table.columns if c != ROW])), [F.col("__was").asc()]).drop("__was")


def unload_column(table: DataFrame, column: str) -> DataFrame:
    """row and value: the column as a table of its own, since an array would gather it."""
    return table.select(ROW, F.col(column).alias("value"))


def load_column(table: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``column`` from (row, value); rows without a value keep theirs."""
    joined = table.join(values.select(ROW, F.col("value").alias("__value"), F.lit(True).alias("__has")), ROW, "left")
    return joined.withColumn(column, F.when(F.col("__has"), F.col("__value")).otherwise(F.col(column))).drop("__value", "__has")


def fill_values(table: DataFrame, value, columns: str = "") -> DataFrame:
    names = [x.strip() for x in columns.split(",") if x.strip()] or [c for c in table.columns if c != ROW]
    return table.withColumns({c: F.lit(value).cast(table.schema[c].dataType) for c in names})


def total(table: DataFrame, column: str) -> DataFrame:
    return table.agg(F.sum(column).alias("total"))


def count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("count"))


def insert(table: DataFrame, at: int, **values) -> DataFrame:
    """A new row at place ``at``; columns without a value are null."""
    one = table.sparkSession.range(1).select(F.lit(at).cast("long").alias(ROW), *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != ROW])
    return table.withColumn(ROW, F.when(F.col(ROW) >= at, F.col(ROW) + 1).otherwise(F.col(ROW))).unionByName(one)


def add(table: DataFrame, **values) -> DataFrame:
    last = table.agg(F.coalesce(F.max(ROW) + 1, F.lit(0)).alias("n")).first()["n"]
    return insert(table, last, **values)


def delete(table: DataFrame, at: int) -> DataFrame:
    return table.where(F.col(ROW) != at).withColumn(ROW, F.when(F.col(ROW) > at, F.col(ROW) - 1).otherwise(F.col(ROW)))


def move(table: DataFrame, at: int, by: int) -> DataFrame:
    """The row at ``at`` shifted by ``by`` places; those between make room."""
    to = at + by
    between = F.col(ROW).between(min(at, to), max(at, to))
    step = -1 if by > 0 else 1
    return table.withColumn(ROW, F.when(F.col(ROW) == at, F.lit(to)).when(between, F.col(ROW) + step).otherwise(F.col(ROW)).cast("long"))


def index_of(table: DataFrame, wanted: dict) -> DataFrame:
    """index: the place of the first row with these values, -1 if there is none."""
    return find_rows(table, wanted).agg(F.coalesce(F.min(ROW), F.lit(-1)).alias("index"))


# --- arrays, structures, maps and value lists --------------------------------


def array_insert_at(items: Column, at: int, value) -> Column:
    return F.array_insert(items, at + 1, F.lit(value))


def array_delete_at(items: Column, at: int) -> Column:
    return F.filter(items, lambda _, i: i != at)


def array_find(items: Column, value) -> Column:
    """The place of the value, from 0; null if it is not there."""
    return F.nullif(F.array_position(items, F.lit(value)) - 1, F.lit(-1).cast("long"))


def array_set(items: Column, at: int, value) -> Column:
    return F.transform(items, lambda x, i: F.when(i == at, F.lit(value)).otherwise(x))


def ubound(items: Column) -> Column:
    return F.size(items) - 1


def map_insert(pairs: Column, key, value) -> Column:
    """The map with this value under the key, whether it had one or not."""
    return F.map_concat(map_delete(pairs, key), F.create_map(F.lit(key), F.lit(value)))


def map_delete(pairs: Column, key) -> Column:
    return F.map_filter(pairs, lambda k, _: k != F.lit(key))


def map_get(pairs: Column, key) -> Column:
    return F.try_element_at(pairs, F.lit(key))


def list_sort(items: Column, by: str = "value", down: bool = False) -> Column:
    """A value list (array of structs of value and presentation) by one of its fields."""
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(x[by].alias("__by"), x.alias("item"))))
    plain = F.transform(ordered, lambda x: x["item"])
    return F.reverse(plain) if down else plain


def list_find(items: Column, value) -> Column:
    """The first entry of a value list with this value; null if there is none."""
    return F.get(F.filter(items, lambda x: x["value"] == F.lit(value)), 0)
