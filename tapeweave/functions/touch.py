"""First touches of price levels, found by descending tables of running extremes.

Level ``a`` of a table holds the extremes of the ``2**a`` bars from each bar on, so a search over any number of bars
skips stretches without a touch in as many steps as the horizon has binary digits. Works on numpy arrays of one
block of bars inside a task, for all plans of the block at once.
"""

from __future__ import annotations

import numpy as np


def _ahead(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    if by < x.size:
        out[:-by] = x[by:]
    return out


class Extremes:
    """Tables over a block of consecutive bars for searches of at most ``longest`` bars.

    With ``pull``, a level per bar that a stop is tightened to before the bar is tested, the tables also know
    whether a stretch crosses the tightest level it has itself brought.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, longest: int, pull: np.ndarray | None = None):
        self.high, self.low = [high], [low]
        self.pull = [np.full(high.size, -np.inf) if pull is None else pull]
        self.crossed = [low <= self.pull[0]]
        for a in range(max(1, int(longest)).bit_length() - 1):
            by = 1 << a
            h, l, p, x = self.high[-1], self.low[-1], self.pull[-1], self.crossed[-1]
            next_low = _ahead(l, by, np.inf)
            self.high.append(np.maximum(h, _ahead(h, by, -np.inf)))
            self.low.append(np.minimum(l, next_low))
            self.pull.append(np.maximum(p, _ahead(p, by, -np.inf)))
            self.crossed.append(x | _ahead(x, by, False) | (next_low <= p))

    def first(self, start: np.ndarray, bars: np.ndarray, stop: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bars before the first one whose low reaches the stop or whose high reaches ``take``, and the stop then.

        ``bars`` where none does. The stop is the tightest of ``stop`` and the levels of ``pull`` so far, that
        bar's own included.
        """
        at, left, stop = start.astype(np.int64), bars.astype(np.int64), stop.astype(float)
        for a in range(len(self.high) - 1, -1, -1):
            i = np.minimum(at, self.high[0].size - 1)
            skip = (left >= 1 << a) & (self.high[a][i] < take) & (self.low[a][i] > stop) & ~self.crossed[a][i]
            stop = np.where(skip, np.maximum(stop, self.pull[a][i]), stop)
            at, left = at + (skip << a), left - (skip << a)
        passed = at - start
        hit = passed < bars
        return passed, np.where(hit, np.maximum(stop, self.pull[0][np.minimum(at, self.high[0].size - 1)]), stop)
