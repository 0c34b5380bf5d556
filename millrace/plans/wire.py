"""Queries as JSON, and their execution at the receiver under its own scopes. Everything but maps with expressions and groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from millrace.functions import expressions as E
from millrace.operators.query import Query

TERMINALS = ("rows", "count", "sum", "min", "max", "distinct", "some")


def encode(collection: str, query: Query, terminal: str = "rows") -> dict[str, Any]:
    steps = []
    for s in query.steps:
        if s["kind"] == "filter":
            if "predicate" not in s:
                raise ValueError("a column expression has no JSON form")
            steps.append({"kind": "filter", "predicate": E.to_json(s["predicate"]), "params": {k: E._pack(v) for k, v in s["params"].items()}})
        elif s["kind"] == "map":
            steps.append({"kind": "map", "columns": s["columns"], "named": s["named"]})
        elif s["kind"] == "sort" and s["by"] is None:
            raise ValueError("a column expression has no JSON form")
        else:
            steps.append(dict(s))
    return {"collection": collection, "steps": steps, "terminal": terminal}


def decode(plan: Mapping[str, Any], source: Query) -> Query:
    """The plan's steps on the source; unknown steps and properties are errors."""
    q = source
    for s in plan["steps"]:
        kind = s.get("kind")
        if kind == "filter":
            q = q.where(E.from_json(s["predicate"], q.df.schema), {k: E._unpack(v) for k, v in s.get("params", {}).items()})
        elif kind == "map":
            q = q.map(*s["columns"], **s["named"])
        elif kind == "sort":
            q = q.sort(s["by"], s["descending"])
        elif kind in ("skip", "take"):
            q = getattr(q, kind)(int(s["n"]))
        elif kind == "nearest":
            q = q.nearest(s["property"], s["vector"], int(s["k"]))
        else:
            raise ValueError(f"an unknown step: {kind}")
    return q


def finish(plan: Mapping[str, Any], q: Query) -> DataFrame:
    terminal = plan.get("terminal", "rows")
    if terminal not in TERMINALS:
        raise ValueError(f"an unknown terminal: {terminal}")
    if terminal == "rows":
        return q.to_df()
    return q.distinct() if terminal == "distinct" else getattr(q, f"{terminal}_df")()


def handle(plan: Mapping[str, Any], collections: Mapping[str, Query], authorize: Callable[[Mapping[str, Any]], bool] | None = None, scope: Callable[[str], E.Expr] | None = None) -> tuple[DataFrame | None, str | None]:
    """Run a received plan. ``scope`` gives a predicate that holds for every read of a collection. Errors are values: (None, message)."""
    try:
        if authorize is not None and not authorize(plan):
            return None, "not authorized"
        source = collections[plan["collection"]]
        if scope is not None:
            source = source.where(scope(plan["collection"]))
        return finish(plan, decode(plan, source)), None
    except (KeyError, ValueError, TypeError) as e:
        return None, f"{type(e).__name__}: {e}"
