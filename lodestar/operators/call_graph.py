"""The resolved call graph, kept up by change.

Whether a call resolves, and to what, depends on one name only: on the procedures of that
name and where they stand.  So procedures, calls and resolved edges lie in parts by a hash
of the lower-cased name, and a change to some modules rewrites the parts of the names that
these modules declare or call, before or after: a second procedure of one name un-resolves
callers in modules that did not change, and its removal resolves them again.

Which names' parts a module touches is kept beside, in parts by module, so the names of a
module's last state are found without looking at the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.graph import resolve_calls
from lodestar.operators.tables import Change, Tables
from lodestar.staging import staged

#: Rows to a part, as the tables are first written, and parts at most.
ROWS_EACH, MOST_PARTS = 50_000, 1024
PROCEDURE, CALL = "module string, name string, id string", "module string, caller string, name string, line int"


def _of_name(n: int) -> Column:
    return F.pmod(F.xxhash64(F.lower("name")), F.lit(n)).cast("int")


def _of_module(n: int) -> Column:
    return F.pmod(F.xxhash64("module"), F.lit(n)).cast("int")


class CallGraph:
    """procedures (module, name, id), calls (module, caller, name, line) and the edges (caller, callee, module, line) that they make."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.tables = spark, Tables(spark, home)

    def refresh(self, modules: DataFrame, procedures: DataFrame, calls: DataFrame, parts: int | None = None) -> None:
        """``modules`` (module) were added, changed or removed; ``procedures`` and ``calls`` are all that they hold now.

        parts: into how many the tables are cut at the first call; by default as many as
        its rows need.
        """
        # Each of these may hold all modules, so none is broadcast.
        modules = staged(modules.select("module").distinct(), "calls-modules").hint("merge")
        procedures = staged(procedures.select("module", "name", "id"), "calls-procedures")
        calls = staged(calls.select("module", "caller", "name", "line"), "calls-calls")

        def put(change: Change) -> None:
            n = change.note("procedures").get("parts") or parts or max(4, min(MOST_PARTS, 1 << ((procedures.count() + calls.count()) // ROWS_EACH).bit_length()))
            places = [str(r["b"]) for r in modules.select(_of_module(n).alias("b")).distinct().collect()]  # at most the number of parts
            if not places:
                return
            before = change.read("touches", places)
            now = procedures.select("module", _of_name(n).alias("part")).unionByName(calls.select("module", _of_name(n).alias("part"))).distinct()
            named = now.select("part")
            if before is not None:
                named = named.unionByName(before.join(modules, "module", "left_semi").select("part"))
            held = sorted(str(r["part"]) for r in named.distinct().collect())
            kept = lambda name, fresh: fresh if (old := change.read(name, held)) is None else old.join(modules, "module", "left_anti").unionByName(fresh)
            own, sites = staged(kept("procedures", procedures), "calls-own"), staged(kept("calls", calls), "calls-sites")
            change.write_parts("procedures", own, _of_name(n), emptied=held, note={"parts": n})
            change.write_parts("calls", sites, _of_name(n), emptied=held)
            edges = resolve_calls(sites, own).select("caller", "callee", "module", "line", "name")
            change.write_parts("edges", edges, _of_name(n), emptied=held)
            touches = now if before is None else before.join(modules, "module", "left_anti").unionByName(now)
            change.write_parts("touches", touches, _of_module(n), emptied=places)

        self.tables.transact(put)

    def edges(self) -> DataFrame:
        """caller, callee, module and line of every call that resolves."""
        found = self.tables.read("edges")
        return self.spark.createDataFrame([], "caller string, callee string, module string, line int") if found is None else found.select("caller", "callee", "module", "line")
