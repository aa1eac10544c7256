"""Statistics that stay null where a spread is zero (ANSI mode would raise)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_corr(a, b, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over complete pairs; null without spread."""
    a, b = _col(a), _col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return parts[0] / F.nullif(parts[1] * parts[2], F.lit(0.0))
