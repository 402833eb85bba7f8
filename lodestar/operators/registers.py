"""Virtual register tables: slices, balances and turnovers over movement rows.

Movements carry a period, dimensions, resources and, for accumulation registers,
a kind (Receipt or Expense).  Every table is one aggregate or one window over
(dimensions); an aggregate always comes before a window, so a hot dimension key
is combined map-side and the window sees one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.tables import Change, Tables
from lodestar.staging import drop, staged

RECEIPT, EXPENSE = "Receipt", "Expense"


def _slice(rows: DataFrame, dims: list[str], period: str, tie: list[str], last: bool) -> DataFrame:
    """The whole row with the greatest (or least) (period, *tie) per dimensions, as a combinable aggregate."""
    others = [c for c in rows.columns if c not in dims]
    pick = (F.max_by if last else F.min_by)(F.struct(*others), F.struct(period, *tie))
    return rows.groupBy(*dims).agg(pick.alias("__row")).select(*dims, "__row.*").select(*rows.columns)


def slice_last(rows: DataFrame, dims: list[str], period: str, at=None, tie: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """The latest record of each dimension key at or before ``at`` (any time if None)."""
    some = rows if condition is None else rows.where(condition)
    return _slice(some if at is None else some.where(F.col(period) <= F.lit(at)), dims, period, tie or [], True)


def slice_first(rows: DataFrame, dims: list[str], period: str, at=None, tie: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """The earliest record of each dimension key at or after ``at``."""
    some = rows if condition is None else rows.where(condition)
    return _slice(some if at is None else some.where(F.col(period) >= F.lit(at)), dims, period, tie or [], False)


def signed(resource: str, kind: str = "kind") -> Column:
    return F.when(F.col(kind) == RECEIPT, F.col(resource)).otherwise(-F.col(resource))


def balance(moves: DataFrame, dims: list[str], resources: list[str], period: str = "period", at=None, kind: str = "kind") -> DataFrame:
    """Receipts less expenses per dimensions before ``at`` (all of them if None), in <resource>_balance."""
    some = moves if at is None else moves.where(F.col(period) < F.lit(at))
    return some.groupBy(*dims).agg(*[F.sum(signed(r, kind)).alias(f"{r}_balance") for r in resources])


def turnovers(moves: DataFrame, dims: list[str], resources: list[str], period: str = "period", start=None, end=None, every: str | None = None, kind: str | None = "kind") -> DataFrame:
    """Receipt, expense and turnover per dimensions [and per ``every``: day, week, month, …] from ``start`` to ``end`` inclusive.

    kind None: a turnover register, whose movements only add up.
    """
    some = moves if start is None else moves.where(F.col(period) >= F.lit(start))
    some = some if end is None else some.where(F.col(period) <= F.lit(end))
    keys = [*dims] if every is None else [*dims, F.date_trunc(every, period).alias("bucket")]
    sums = []
    for r in resources:
        if kind is not None:
            sums.append(F.sum(F.when(F.col(kind) == RECEIPT, F.col(r)).otherwise(F.lit(0))).alias(f"{r}_receipt"))
            sums.append(F.sum(F.when(F.col(kind) == EXPENSE, F.col(r)).otherwise(F.lit(0))).alias(f"{r}_expense"))
        sums.append(F.sum(signed(r, kind) if kind is not None else F.col(r)).alias(f"{r}_turnover"))
    return some.groupBy(*keys).agg(*sums)


def balance_and_turnovers(moves: DataFrame, dims: list[str], resource: str, every: str = "month", period: str = "period", kind: str = "kind") -> DataFrame:
    """Opening, receipt, expense, turnover and closing per dimensions and bucket."""
    by = turnovers(moves, dims, [resource], period, every=every, kind=kind)
    upto = Window.partitionBy(*dims).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("closing", F.sum(f"{resource}_turnover").over(upto))
    return by.select(
        *dims,
        "bucket",
        (F.col("closing") - F.col(f"{resource}_turnover")).alias("opening"),
        F.col(f"{resource}_receipt").alias("receipt"),
        F.col(f"{resource}_expense").alias("expense"),
        F.col(f"{resource}_turnover").alias("turnover"),
        "closing",
    )


def negative_balances(moves: DataFrame, dims: list[str], resource: str, **options) -> DataFrame:
    """Balance control: the dimension keys whose balance is below zero."""
    return balance(moves, dims, [resource], **options).where(F.col(f"{resource}_balance") < 0)


def totals(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Sums per prefix of ``by`` with level (0: grand total), as TOTALS BY asks."""
    level = F.lit(len(by)) - F.bit_count(F.grouping_id(*by))
    return rows.rollup(*by).agg(level.cast("int").alias("level"), *[F.sum(s).alias(f"{s}_total") for s in sums])


def detect_movement(register_name: str, explicit: str | None = None) -> str:
    """Receipt, Expense or Turnover for a register, from its name unless said."""
    if explicit:
        return explicit
    low = register_name.lower()
    return "Turnover" if any(w in low for w in ("оборот", "turnover", "продажи", "sales")) else RECEIPT


class StoredTotals:
    """Balances kept per year beside their movements, in parts by month (``operators/tables.py``).

    The totals of a year are the balances at its first moment, kept as the part of its
    January: one row a key and year, where totals of every month would be twelve.  A
    change adds its movements to their months, and their sums to the totals of every
    later year, in one commit.  A balance at any date reads one year's totals and the
    movements of that year's months up to the date.
    """

    def __init__(self, spark: SparkSession, home: str, dims: list[str], resources: list[str], period: str = "period", kind: str = "kind"):
        self.tables = Tables(spark, home)
        self.dims, self.resources, self.period, self.kind = dims, resources, period, kind

    def _sums(self, rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy(*more, *self.dims).agg(*[F.sum(r).alias(r) for r in self.resources])

    def add(self, moves: DataFrame, writer: str | None = None, batch: int | None = None) -> None:
        """Take in movements of any months, late ones too; a numbered batch of a writer once."""
        if self.tables.begin().heard(writer, batch):
            return
        columns = [self.period, self.kind, *self.dims, *self.resources]
        month = F.date_format(self.period, "yyyy-MM")
        moves = staged(moves.select(*columns).withColumn("__month", month), "totals-moves")
        january = F.concat(F.substring("__month", 1, 4), F.lit("-01"))
        by_year = staged(moves.groupBy(january.alias("__year"), *self.dims).agg(*[F.sum(signed(r, self.kind)).alias(r) for r in self.resources]), "totals-sums")

        def put(change: Change) -> None:
            fresh = sorted(r["__month"] for r in moves.select("__month").distinct().collect())  # one per month
            if not fresh:
                return
            held, known = self._parts(change, "movements"), self._starts(change)
            starts = {f"{m[:4]}-01" for m in {*held, *fresh}}
            starts |= {f"{int(max(starts)[:4]) + 1:04d}-01"}  # so that the present reads no movements
            touched = sorted(m for m in starts if m > fresh[0] or m not in known)
            target = moves.sparkSession.createDataFrame([(m,) for m in touched], "month string")
            rows = by_year.join(F.broadcast(target), F.col("__year") < F.col("month")).select("month", *self.dims, *self.resources)
            before = change.read("movements", fresh)
            if before is not None:
                rows = rows.unionByName(change.read("totals", touched).select(*rows.columns))
                for m in [m for m in touched if m not in known]:  # a year between: it starts from the one before it
                    last = max((x for x in known if x < m), default=None)
                    if last:
                        upto = self._since(change, last, [x for x in held if last <= x < m], None)
                        rows = rows.unionByName(upto.select(F.lit(m).alias("month"), *self.dims, *self.resources))
            change.write_parts("movements", moves.drop("__month") if before is None else before.unionByName(moves.drop("__month")), month)
            change.write_parts("totals", self._sums(rows, "month"), "month", emptied=touched)

        self.tables.transact(put, writer, batch)
        drop(by_year)
        drop(moves)

    def balance(self, at) -> DataFrame:
        """Receipts less expenses per dimensions before ``at``, in <resource>_balance."""
        change = self.tables.begin()
        held, here = self._parts(change, "movements"), f"{at:%Y-%m}"
        if not held:
            raise ValueError("no movements were added yet")
        start = max((m for m in self._starts(change) if m <= here), default=None)
        months = [m for m in held if start is not None and start <= m <= here]
        # A key is told from its first movement on, whatever its balance.
        return self._since(change, start, months, at).groupBy(*self.dims).agg(*[F.sum(r).alias(f"{r}_balance") for r in self.resources])

    def _parts(self, change: Change, name: str) -> set[str]:
        return set(change.base["tables"].get(name, {"parts": {}})["parts"])

    def _starts(self, change: Change) -> set[str]:
        """The Januaries whose totals are kept; those of the first year are empty and no part."""
        return self._parts(change, "totals") | {f"{m[:4]}-01" for m in self._parts(change, "movements")}

    def _since(self, change: Change, start: str | None, months: list[str], at) -> DataFrame:
        """Rows of dims and resources that add up to the balance before ``at`` (the end of the months if None): the totals of ``start`` and the movements of ``months``."""
        moves = change.read("movements", months)
        moves = moves if at is None else moves.where(F.col(self.period) < F.lit(at))
        tail = moves.select(*self.dims, *[signed(r, self.kind).alias(r) for r in self.resources])
        return tail.unionByName(change.read("totals", [start] if start else []).select(*tail.columns))
