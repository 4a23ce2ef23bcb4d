"""Rules applied to a bounded page or to figures on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_budget(sizes: list[int], budget: int) -> list[bool]:
    """Which items of a page fit: in order, skipping what is too large, not stopping at it."""
    out = []
    for size in sizes:
        fits = size <= budget
        budget -= size if fits else 0
        out.append(fits)
    return out


def within_budget(rows: DataFrame, of: str, order: list[str], size: str, budget: int) -> DataFrame:
    """``of, order, fits``: which rows of each ``of`` fit a budget, by ``greedy_budget`` in their order.

    Only places and sizes of one ``of`` (a version) meet in a task.
    """
    small = rows.select(of, *order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"))
    schema = T.StructType([*small.select(of, *order).schema.fields, T.StructField("fits", T.BooleanType())])

    def mark(part):
        part = part.sort_values(order, kind="stable")
        return part.assign(fits=greedy_budget(part["__size"].tolist(), budget)).drop(columns="__size")

    return small.groupBy(of).applyInPandas(mark, schema)


# Least share of each measure that opens hybrid retrieval.
GATES = {"exact": 1.0, "no_hit": 1.0, "resolution": 1.0, "role": 1.0}


def gates(figures: dict[str, float], keyword_ndcg: float, conceptual: tuple[float, float], warm_p95_ms: float, memory_share: float) -> dict[str, bool]:
    """Which gates of an evaluation are passed; all must be.

    ``figures`` has the shares named in ``GATES``, ``leaks`` and ``ndcg``; ``conceptual`` is
    the measure of concept queries by hybrid and by keyword search.
    """
    out = {name: figures.get(name, 0.0) >= least for name, least in GATES.items()}
    out["leakage"] = figures.get("leaks", 1) == 0
    out["overall"] = figures.get("ndcg", 0.0) >= 0.98 * keyword_ndcg
    out["conceptual"] = conceptual[0] >= 1.10 * conceptual[1]
    out["latency"] = warm_p95_ms <= 250
    out["memory"] = memory_share < 0.75
    return out


def stamp_text(stamp: dict[str, str]) -> str:
    """The canonical text of a stamp: ``key=value`` lines in order of key."""
    return "\n".join(f"{k}={stamp[k]}" for k in sorted(stamp))


def stamp_hash(stamp: dict[str, str]) -> str:
    return hashlib.sha256(stamp_text(stamp).encode()).hexdigest()


def equivalent_fraction(a: set[str], b: set[str]) -> float:
    """Share of the smaller anchor set that both have; 0 if either is empty."""
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0
