"""Feature values of all rows, or of the last ones of each code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.minute_features import features
from .expr import SPARK, TAILS, Expr, factors_sql, render, stages
from .tails import all_values, tail_values


def median_close(panel: DataFrame) -> float:
    """The median close, which picks the price levels; 50 for an empty panel."""
    found = panel.agg(F.percentile("close", 0.5)).first()[0]
    return 50.0 if found is None else float(found)


def compute(panel: DataFrame, exprs: dict[str, Expr], fill: float | None = 0.0) -> DataFrame:
    """(datetime, code, one column per feature) at every row, by window functions.

    All windows share one partitioning and order, so there is one exchange.
    """
    for level in stages(exprs.values(), SPARK):
        panel = panel.select("*", *[F.expr(text).alias(name) for name, text in level.items()])
    value = lambda e: F.expr(render(e, SPARK)) if fill is None else F.coalesce(F.expr(render(e, SPARK)), F.lit(fill))
    return panel.select("datetime", "code", *[value(e).alias(name) for name, e in exprs.items()])


def minute_features(panel: DataFrame, families: tuple[str, ...] | None = None, snapshot: bool = True, fill: float | None = 0.0, since=None) -> DataFrame:
    """The behaviour features, with levels by the panel's median close: of each code's last row, of its rows from a
    time on, or (snapshot=False) of all rows. All look back on all rows of the code."""
    chosen = {"families": families} if families else {}
    median = median_close(panel) if families is None or "round_number" in families else 50.0
    if snapshot or since is not None:
        return tail_values(panel, features(median=median, rows=TAILS, **chosen), fill, since)
    return all_values(panel, features(median=median, rows=TAILS, **chosen), fill)


def snapshot_sql(panel: str, exprs: dict[str, Expr], digits: int = 6) -> str:
    """Rounded snapshot as DuckDB SQL."""
    return factors_sql(panel, exprs, wrap=lambda name, text: f"round(coalesce({text}, 0), {digits}) + 0.0", tail="qualify row_number() over (partition by code order by datetime desc) = 1")
