"""What a query does where: which steps reach the scan, which run in Spark, which in Python."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from millrace.functions.expressions import Expr, has_opaque

#: Why a step isn't done by the scan.
REASONS = {
    "opaque-filter": "a Python function is tested row by row",
    "after-opaque": "it follows a step in Python",
    "computed": "the property isn't stored",
    "join": "pairs exist only after the join",
    "nearest": "distances are computed on the rows read",
    "window": "order and windows need all rows",
    "projection": "expressions are computed on the rows read",
}


@dataclass(frozen=True)
class Explanation:
    steps: tuple[tuple[str, str, str | None], ...]  # kind, scan or engine or python, reason
    pushed: tuple[str, ...]
    columns_read: tuple[str, ...]
    exchanges: int
    python: bool
    plan: str

    def __str__(self) -> str:
        lines = [f"{i}. {kind}: {where}" + (f" ({REASONS.get(why, why)})" if why else "") for i, (kind, where, why) in enumerate(self.steps, 1)]
        return "\n".join([*lines, f"pushed filters: {', '.join(self.pushed) or 'none'}", f"columns read: {', '.join(self.columns_read) or 'none'}", f"shuffles: {self.exchanges}", f"Python: {'yes' if self.python else 'no'}"])


def explain(df: DataFrame, steps: Sequence[dict[str, Any]] = ()) -> Explanation:
    plan = df._jdf.queryExecution().toString()
    physical = plan.partition("== Physical Plan ==")[2] or plan
    pushed = tuple(dict.fromkeys(x.strip() for m in re.finditer(r"PushedFilters: \[([^\]]*)\]", physical) for x in re.split(r",\s*(?=[A-Z])", m[1]) if x.strip()))
    read = tuple(dict.fromkeys(x.split(":")[0] for m in re.finditer(r"ReadSchema: struct<([^\n]*)>", physical) for x in re.findall(r"(\w+):", m[1])))
    python = bool(re.search(r"BatchEvalPython|ArrowEvalPython|MapInArrow|MapInPandas", physical))
    told, opaque = [], False
    for s in steps:
        kind = s["kind"]
        if kind == "filter":
            if isinstance(s.get("predicate"), Expr) and has_opaque(s["predicate"]):
                opaque = True
                told.append((kind, "python", "opaque-filter"))
            else:
                told.append((kind, "engine", "after-opaque") if opaque else (kind, "scan" if pushed else "engine", None))
        else:
            why = {"sort": "window", "skip": "window", "take": "window", "nearest": "nearest", "join": "join", "map": "projection"}.get(kind)
            told.append((kind, "engine", why))
    return Explanation(tuple(told), pushed, read, len(re.findall(r"\bExchange\b|ShuffleExchange", physical)), python, physical.strip())
