"""Trading costs as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.arith import col

BASIS_POINT = 1e-4


@dataclass(frozen=True)
class Costs:
    """Cost parameters, per side. All zero means no friction."""

    commission_per_share: float = 0.0
    commission_pct: float = 0.0
    min_commission: float = 0.0
    slippage_bps: float = 0.0
    half_spread_bps: float = 0.0

    @property
    def adverse(self) -> float:
        return (self.slippage_bps + self.half_spread_bps) * BASIS_POINT

    def entry_fill(self, price, direction) -> Column:
        """A long buys above, a short sells below the reference price."""
        price, direction = col(price), col(direction)
        return F.when(direction > 0, price + price * self.adverse).otherwise(price - price * self.adverse)

    def exit_fill(self, price, direction) -> Column:
        return self.entry_fill(price, -col(direction))

    def commission(self, price, quantity) -> Column:
        price, quantity = col(price), col(quantity)
        variable = self.commission_per_share * quantity + self.commission_pct * price * quantity
        return F.greatest(F.lit(float(self.min_commission)), variable.cast("double"))


# The standard cost setting of the trading configuration.
STANDARD_COSTS = Costs(
    commission_per_share=0.005, commission_pct=0.0, min_commission=1.0, slippage_bps=1.0, half_spread_bps=1.0
)


def apply_costs(trades: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Add ``pnl`` after all costs and ``cost``, what friction took away."""
    direction, quantity = F.col("direction"), F.col("quantity")
    opened, closed = costs.entry_fill("entry", "direction"), costs.exit_fill("exit", "direction")
    fees = costs.commission(opened, quantity) + costs.commission(closed, quantity)
    net = direction * (closed - opened) * quantity - fees
    plain = direction * (F.col("exit") - F.col("entry")) * quantity
    return trades.withColumn("pnl", net).withColumn("cost", plain - F.col("pnl"))
