"""Rows of small bar series that several test modules share."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def minute_rows(symbol="AAA", days=3, per_day=120, seed=0):
    """A random walk of one-minute bars from 14:00 on weekdays from 2024-06-03."""
    rng = np.random.default_rng(seed)
    price, rows = 100.0, []
    for d in range(days):
        start = datetime(2024, 6, 3, 14) + timedelta(days=d)
        for i in range(per_day):
            close = price + rng.normal(0, 0.1)
            high, low = max(price, close) + 0.05, min(price, close) - 0.05
            rows.append((symbol, start + timedelta(minutes=i), price, high, low, close, float(rng.integers(100, 1000))))
            price = close
    return rows


def linear_rows(symbol, first, last, n=60, up=0.1, down=0.1, start=datetime(2024, 6, 3, 14), step=5):
    closes = np.linspace(first, last, n)
    return [
        (symbol, start + timedelta(minutes=step * i), float(c), float(c + up), float(c - down), float(c), 1.0)
        for i, c in enumerate(closes)
    ]
