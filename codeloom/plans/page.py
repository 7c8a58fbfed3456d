"""Pages of ordered results: limits, byte budgets and envelopes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the response format.
DEFAULT_BUDGET, HEADROOM, SIDE_HEADROOM, MOST_ROWS = 102_400, 512, 48, 1000


def limit_or(limit: int, default: int, most: int = MOST_ROWS) -> int:
    return min(limit or default, most)


@dataclass
class Page:
    results: list[dict] = field(default_factory=list)
    total: int = 0
    offset: int = 0
    limit: int = 0
    truncated: bool = False
    next_offset: int | None = None

    def to_json(self) -> str:
        return json.dumps(self.__dict__, separators=(",", ":"))


def row_json(row: dict) -> str:
    """A row's JSON without empty strings and zeros in the optional fields."""
    optional = ("signature", "namespace", "parent", "column", "end_line")
    return json.dumps({k: v for k, v in row.items() if k not in optional or v not in ("", 0)}, separators=(",", ":"), ensure_ascii=False)


def take_budget(rows: list[dict], budget: int) -> tuple[list[dict], bool]:
    """The leading rows whose JSON fits the budget, and whether one did not."""
    used, kept = 0, []
    for row in rows:
        used += len(row_json(row).encode()) + 1
        if used > budget - HEADROOM:
            return kept, True
        kept.append(row)
    return kept, False


def page(ordered: DataFrame, offset: int = 0, limit: int = 0, default: int = 100, count_only: bool = False, budget: int = DEFAULT_BUDGET) -> Page:
    """A page of an ordered frame. A page that is full by its limit does not count as truncated."""
    total = ordered.count()
    if count_only:
        return Page(total=total)
    limit = limit_or(limit, default)
    rows = [r.asDict(recursive=True) for r in ordered.offset(offset).limit(limit).collect()]
    kept, over = take_budget(rows, budget)
    return Page(kept, total, offset, limit, over, offset + len(kept) if over else None)


def within_budget(ordered_by: list[str | Column], rows: DataFrame, size: Column, budget: int) -> DataFrame:
    """The leading rows of one bounded page whose sizes sum up to at most ``budget``. The page is what one task sorts."""
    running = F.sum(size + 1).over(Window.orderBy(*ordered_by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget - HEADROOM)


def both_sides(incoming: DataFrame, outgoing: DataFrame, offset: int = 0, limit: int = 0, budget: int = DEFAULT_BUDGET) -> tuple[Page, Page]:
    """Incoming first; outgoing gets what is left of the budget, less some headroom, and is empty if nothing is."""
    first = page(incoming, offset, limit, 50, budget=budget)
    left = budget - sum(len(row_json(r).encode()) + 1 for r in first.results) - SIDE_HEADROOM
    if left <= HEADROOM:
        return first, Page(total=outgoing.count(), offset=offset, limit=limit_or(limit, 50), truncated=True, next_offset=0)
    return first, page(outgoing, offset, limit, 50, budget=left)
