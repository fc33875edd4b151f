"""The queries of the code graph over every line: no quantity or date cuts the relations.

Each stands beside the query of its name without `_whole`, whose SQL carries the cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from codelattice.jobs import catalogue
from codelattice.operators import graph
from codelattice.sources import projection

def entries(s: SparkSession, d: str, calls: DataFrame | None = None) -> DataFrame:
    """Entry points by all three rules: no caller, entry name, or framework decorator. calls: those of all lines, where they are at hand."""
    return graph.entry_points(RELATIONS.nodes(s, d), RELATIONS.calls(s, d) if calls is None else calls, catalogue.ENTRY_NAME, projection.decorated(s, d))


RELATIONS = SimpleNamespace(
    nodes=projection.nodes,
    files=projection.files,
    documented=projection.documented,
    subjects=projection.subjects,
    calls=partial(projection.calls, min_quantity=None),
    imports=partial(projection.imports, min_quantity=None),
    commits=partial(projection.commits, min_quantity=None),
    diff_ranges=partial(projection.diff_ranges, since=None),
    entries=entries,
    edges=partial(projection.edges, min_call=None, min_import=None),
)
#: What the SQL of the cut relations filters by.
CUTS = ("l_quantity >= 45", "l_quantity >= 49", "l_shipdate >= TIMESTAMP '2001-10-15'")
#: Symbols with a framework's decorator, by the turns of projection.DECORATORS.
DECORATED = "(symbol_id % 7 < 2 AND symbol_id % 12 IN (0, 2, 4, 6, 8, 9) OR symbol_id % 7 = 1 AND symbol_id // 12 % 12 IN (0, 2, 4, 6, 8, 9))"
#: The other two rules of an entry point.
ENTRIES = """ UNION SELECT qualified_name FROM nodes WHERE kind = 'Function' AND (regexp_matches(name, '{}') OR {})"""
#: Their recursive SQL walks every path, which DuckDB doesn't end over all lines.
FLOWS = ("flow_nodes", "flow_depth", "flow_criticality", "flows_topk", "affected_flows")


def _uncut(sql: str) -> str:
    for cut in CUTS:
        sql = sql.replace(cut, "true")
    return sql


_on = catalogue.queries_on(RELATIONS)
_names = [name for name, sql in catalogue.ORACLE_SQL.items() if _uncut(sql) != sql]

_on["entry_points"] = entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"{name}_whole": _on[name] for name in _names}

ORACLE_SQL: dict[str, str] = {f"{name}_whole": _uncut(catalogue.ORACLE_SQL[name]) for name in _names if name not in FLOWS}
ORACLE_SQL["entry_points_whole"] += ENTRIES.format(catalogue.ENTRY_NAME, DECORATED)
