"""Exponentially weighted means over blocked series, as plain window sums.

``y[0] = x[0]``, ``y[t] = (1-a) y[t-1] + a x[t]``. Within a sub-block of S rows the mean is a running
sum of ``a x c**-o`` times ``c**o`` (``c = 1-a``, ``o`` the row's place in its sub-block), short
enough not to overflow. What earlier sub-blocks add is a fixed number of their end values, each
decayed by ``c**S``: terms are kept until they fall below the smallest double, so even ratios of two
decaying means keep their value through long flat stretches. The halo of a block holds exactly
those sub-blocks, so no second shuffle is needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeweave.operators.series import INDEX, Blocks

# exp() range of a double, with some room at the large end.
LARGEST_EXPONENT = 650.0
SMALLEST_EXPONENT = 745.0


@dataclass(frozen=True)
class Ewm:
    """One mean. ``start`` is the first row (of the series) with a value.

    ``gaps`` allows NULLs between values: the mean is carried over them and the next update is
    renormalised with the elapsed rows, and ``start`` is not used.
    """

    out: str
    value: str
    alpha: float
    min_periods: int
    start: int = 0
    gaps: bool = False

    @property
    def decay(self) -> float:
        """Decay per row as a positive exponent."""
        return -math.log(1.0 - self.alpha) if self.alpha < 1 else math.inf


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def sub_block_rows(alphas: list[float]) -> int:
    """Largest power of two up to 2048 whose decay stays inside the exponent range."""
    fastest = max((-math.log(1.0 - a) for a in alphas if a < 1), default=0.01)
    return 1 << min(11, max(0, int(math.log2(LARGEST_EXPONENT / fastest))))


def carry_terms(alpha: float, sub_rows: int) -> int:
    return math.ceil(SMALLEST_EXPONENT / (-math.log(1.0 - alpha) * sub_rows)) if alpha < 1 else 1


def halo_rows(alphas: list[float], sub_rows: int) -> int:
    return max(carry_terms(a, sub_rows) for a in alphas) * sub_rows


def ewm_means(blocks: Blocks, means: list[Ewm]) -> Blocks:
    """Add all means in one pass over the blocks."""
    plain = [m for m in means if not m.gaps]
    gappy = [m for m in means if m.gaps]
    if plain:
        blocks = _plain(blocks, plain)
    if gappy:
        blocks = _with_gaps(blocks, gappy)
    return blocks


def _place(size: int):
    return F.pmod(F.col(INDEX), F.lit(size)).cast("double")


def _plain(blocks: Blocks, means: list[Ewm]) -> Blocks:
    size = blocks.sub_rows
    place = _place(size)
    part = blocks.sub_window()
    running = part.rowsBetween(Window.unboundedPreceding, 0)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def weighted(m: Ewm):
        # One row's share of the mean, before decay; nothing before the series starts.
        share = F.when(F.col(INDEX) == m.start, 1.0).otherwise(m.alpha)
        return F.when(F.col(INDEX) >= m.start, F.col(m.value) * share).otherwise(0.0)

    decaying = [m for m in means if m.alpha < 1]
    sums = {}
    for m in decaying:
        c = 1.0 - m.alpha
        sums[f"_run_{m.out}"] = F.sum(weighted(m) * F.pow(F.lit(c), -place)).over(running)
        sums[f"_end_{m.out}"] = F.sum(weighted(m) * F.pow(F.lit(c), F.lit(size - 1.0) - place)).over(whole)
    blocks = blocks.columns(sums)

    carried = {}
    order = blocks.window()
    for m in decaying:
        step = (1.0 - m.alpha) ** size
        terms = [
            F.lag(f"_end_{m.out}", k * size, 0.0).over(order) * (step ** (k - 1))
            for k in range(1, carry_terms(m.alpha, size) + 1)
        ]
        carried[f"_carry_{m.out}"] = sum(terms[1:], terms[0])
    blocks = blocks.columns(carried)

    results = {}
    for m in means:
        c = 1.0 - m.alpha
        value = F.col(m.value)
        if m.alpha < 1:
            value = F.pow(F.lit(c), place) * (F.col(f"_run_{m.out}") + c * F.col(f"_carry_{m.out}"))
        results[m.out] = F.when(F.col(INDEX) >= m.start + m.min_periods - 1, value)
    return blocks.columns(results)


def _with_gaps(blocks: Blocks, means: list[Ewm]) -> Blocks:
    size = blocks.sub_rows
    order = blocks.window()
    part = blocks.sub_window()
    running = part.rowsBetween(Window.unboundedPreceding, 0)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)

    blocks = blocks.columns({
        f"_prev_{m.out}": F.max(F.when(F.col(m.value).isNotNull(), F.col(INDEX))).over(before) for m in means
    } | {f"_seen_{m.out}": F.count(m.value).over(so_far) for m in means})

    # ln of the factor on the old mean, and the share of the new value.
    steps = {}
    for m in means:
        present = F.col(m.value).isNotNull()
        first = F.col(f"_prev_{m.out}").isNull()
        old = F.exp(-m.decay * (F.col(INDEX) - F.col(f"_prev_{m.out}")))
        steps[f"_ln_{m.out}"] = F.when(present & ~first, F.ln(old / (old + m.alpha))).otherwise(0.0)
        steps[f"_share_{m.out}"] = F.when(present, F.when(first, 1.0).otherwise(m.alpha / (old + m.alpha))).otherwise(0.0)
    blocks = blocks.columns(steps)
    blocks = blocks.columns(
        {f"_log_{m.out}": F.sum(f"_ln_{m.out}").over(running) for m in means}
        | {f"_logall_{m.out}": F.sum(f"_ln_{m.out}").over(whole) for m in means}
    )
    grown = lambda m: F.coalesce(F.col(m.value), F.lit(0.0)) * F.col(f"_share_{m.out}") * F.exp(-F.col(f"_log_{m.out}"))
    blocks = blocks.columns(
        {f"_run_{m.out}": F.sum(grown(m)).over(running) for m in means}
        | {f"_end_{m.out}": F.exp(f"_logall_{m.out}") * F.sum(grown(m)).over(whole) for m in means}
        | {f"_all_{m.out}": F.exp(f"_logall_{m.out}") for m in means}
    )
    carried = {}
    for m in means:
        terms = carry_terms(m.alpha, size)
        total = F.lit(0.0)
        for k in range(terms, 0, -1):
            end = F.lag(f"_end_{m.out}", k * size, 0.0).over(order)
            kept = F.lag(f"_all_{m.out}", k * size, 0.0).over(order)
            total = end + kept * total
        carried[f"_carry_{m.out}"] = total
    blocks = blocks.columns(carried)
    return blocks.columns({
        m.out: F.when(
            F.col(f"_seen_{m.out}") >= m.min_periods,
            F.exp(f"_log_{m.out}") * (F.col(f"_run_{m.out}") + F.col(f"_carry_{m.out}")),
        )
        for m in means
    })
