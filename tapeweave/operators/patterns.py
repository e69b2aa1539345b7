"""Candlestick flags of the bar on which a pattern completes.

Expressions over the bar and the lagged columns ``_po``, ``_pc`` (one bar back) and ``_po2``,
``_pc2`` (two back) that the indicator blocks provide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeweave.functions.arith import flag, sign_flag, zero_null

# Names and order of the pattern columns.
PATTERN_COLUMNS = [
    "cdl_doji", "cdl_hammer", "cdl_inverted_hammer", "cdl_engulfing", "cdl_shooting_star",
    "cdl_marubozu", "cdl_morning_evening_star",
]


def pattern_columns() -> dict[str, Column]:
    open_, high, low, close = (F.col(c) for c in ("open", "high", "low", "close"))
    po, pc, po2, pc2 = (F.col(c) for c in ("_po", "_pc", "_po2", "_pc2"))
    body = F.abs(close - open_)
    span = zero_null(high - low)
    above = high - F.greatest(open_, close)
    below = F.least(open_, close) - low
    up, down = close > open_, close < open_
    middle_small = F.abs(pc - po) <= 0.5 * F.abs(pc2 - po2)
    midpoint = (po2 + pc2) / 2.0
    return {
        "cdl_doji": flag(body <= 0.1 * span),
        "cdl_hammer": flag((below >= 2.0 * body) & (above <= body) & (body > 0)),
        "cdl_inverted_hammer": flag((above >= 2.0 * body) & (below <= body) & (body > 0)),
        "cdl_engulfing": sign_flag(
            up & (pc < po) & (close >= po) & (open_ <= pc),
            down & (pc > po) & (open_ >= pc) & (close <= po),
        ),
        "cdl_shooting_star": flag((above >= 2.0 * body) & (below <= 0.3 * body) & down),
        "cdl_marubozu": sign_flag((body >= 0.9 * span) & up, (body >= 0.9 * span) & down),
        "cdl_morning_evening_star": sign_flag(
            (pc2 < po2) & middle_small & up & (close > midpoint),
            (pc2 > po2) & middle_small & down & (close < midpoint),
        ),
    }
