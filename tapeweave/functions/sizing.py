"""Position sizing as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.arith import col

# The sizing methods.
METHODS = ["fixed_fractional", "kelly", "vol_target"]


def kelly_fraction(win_probability, reward_risk: float) -> Column:
    """Kelly's optimal fraction, kept between 0 and 1."""
    p = col(win_probability)
    if reward_risk <= 0:
        return p * 0.0
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - (1.0 - p) / reward_risk))


@dataclass(frozen=True)
class Sizing:
    risk_pct: float = 0.01
    rr_ratio: float = 2.0
    stop_atr_mult: float = 1.5
    max_position_pct: float = 0.25
    method: str = "fixed_fractional"
    kelly_multiplier: float = 0.5
    target_volatility: float = 0.01

    def __post_init__(self):
        if not 0 < self.risk_pct < 1:
            raise ValueError("risk_pct must be between 0 and 1")
        if not 0 < self.max_position_pct <= 1:
            raise ValueError("max_position_pct must be above 0 and at most 1")
        if self.method not in METHODS:
            raise ValueError(f"unknown sizing method: {self.method!r}")

    def fraction(self, probability) -> Column:
        """Share of equity put at risk."""
        if self.method == "kelly":
            return self.kelly_multiplier * kelly_fraction(probability, self.rr_ratio)
        return F.lit(self.target_volatility if self.method == "vol_target" else self.risk_pct)


def size_positions(candidates: DataFrame, equity: float = 100_000.0, sizing: Sizing = Sizing()) -> DataFrame:
    """Sized plans from rows with ``direction, probability, entry, atr``; untradable rows drop out.

    ``equity`` is a stated reference: sizes do not compound with earlier results.
    """
    direction, entry = F.col("direction"), F.col("entry")
    distance = F.col("_distance")
    tradable = (direction != 0) & (F.col("atr") > 0) & (entry > 0) & (distance > 0) & F.lit(equity > 0)
    side = F.when(direction > 0, 1.0).otherwise(-1.0)
    budget = equity * sizing.fraction("probability")
    by_risk = F.floor(budget / F.nullif(distance, F.lit(0.0)))
    by_notional = F.floor(F.lit(equity * sizing.max_position_pct) / F.nullif(entry, F.lit(0.0)))
    return (
        candidates.withColumn("_distance", sizing.stop_atr_mult * F.col("atr"))
        .filter(tradable)
        .withColumns({
            "stop": entry - side * distance,
            "take_profit": entry + side * sizing.rr_ratio * distance,
            "quantity": F.greatest(F.lit(0).cast("long"), F.least(by_risk, by_notional)),
        })
        .filter(F.col("quantity") > 0)
        .withColumns({
            "risk_amount": F.col("quantity") * distance,
            "rr_ratio": F.lit(float(sizing.rr_ratio)),
            "method": F.lit(sizing.method),
        })
        .drop("_distance")
    )
