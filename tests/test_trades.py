import random
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from bar_rows import BAR, linear_rows, minute_rows
from pyspark.sql import functions as F

from tapeweave.functions.costs import Costs, apply_costs
from tapeweave.functions.sizing import Sizing, kelly_fraction, size_positions
from tapeweave.operators import fusion, metrics, portfolio, trades
from tapeweave.operators.trades import trade_ledger, trade_outcomes

T0 = datetime(2024, 6, 3, 14)
SIGNAL = "symbol string, ts timestamp_ntz, direction int, probability double, horizon int"


def candidates(spark, direction=1, probability=0.6, entry=100.0, atr=2.0):
    return spark.createDataFrame(
        [("AAA", T0, direction, probability, entry, atr)],
        "symbol string, ts timestamp_ntz, direction int, probability double, entry double, atr double",
    )


def test_long_and_short_geometry(spark):
    long = size_positions(candidates(spark), sizing=Sizing(stop_atr_mult=1.0)).first()
    assert (long["stop"], long["take_profit"]) == (98.0, 104.0) and long["quantity"] == 250
    short = size_positions(candidates(spark, -1), sizing=Sizing(stop_atr_mult=1.0)).first()
    assert (short["stop"], short["take_profit"]) == (102.0, 96.0)
    assert long["risk_amount"] <= 100_000 * 0.01 + 1e-9


def test_no_trade_rows(spark):
    for bad in (dict(direction=0), dict(atr=0.0), dict(entry=0.0), dict(atr=-1.0), dict(entry=1e9)):
        assert size_positions(candidates(spark, **bad)).isEmpty()
    assert size_positions(candidates(spark), equity=0.0).isEmpty()
    for bad in (dict(risk_pct=0.0), dict(risk_pct=1.0), dict(max_position_pct=1.5), dict(method="other")):
        with pytest.raises(ValueError):
            Sizing(**bad)


def test_notional_cap_kelly_and_volatility(spark):
    capped = size_positions(candidates(spark, atr=0.01), sizing=Sizing(max_position_pct=0.1)).first()
    assert capped["quantity"] * capped["entry"] <= 10_000
    one = spark.range(1)
    frac = lambda p, b: one.select(kelly_fraction(F.lit(p), b).alias("f")).first()["f"]
    assert frac(0.6, 2.0) == pytest.approx(0.4) and frac(0.2, 2.0) == 0.0 and frac(0.9, 0.0) == 0.0
    low, high = (size_positions(candidates(spark, probability=p, atr=20.0), sizing=Sizing(method="kelly", max_position_pct=1.0)).first() for p in (0.5, 0.7))
    assert high["quantity"] > low["quantity"]
    vol = size_positions(candidates(spark), sizing=Sizing(method="vol_target", target_volatility=0.01, stop_atr_mult=1.0, max_position_pct=1.0)).first()
    assert vol["quantity"] == 500


def trade(spark, entry, exit_, direction, quantity):
    return spark.createDataFrame([(entry, exit_, direction, quantity)], "entry double, exit double, direction int, quantity long")


@pytest.mark.parametrize("costs,args,pnl,cost", [
    (Costs(), (100.0, 110.0, 1, 10), 100.0, 0.0),
    (Costs(commission_per_share=0.01, min_commission=1.0), (100.0, 110.0, 1, 10), 98.0, 2.0),
    (Costs(slippage_bps=10.0), (100.0, 110.0, 1, 10), 97.9, 2.1),
    (Costs(slippage_bps=10.0), (110.0, 100.0, -1, 10), 97.9, 2.1),
    (Costs(commission_pct=0.001), (100.0, 100.0, 1, 10), -2.0, 2.0),
])
def test_costs(spark, costs, args, pnl, cost):
    got = apply_costs(trade(spark, *args), costs).first()
    assert got["pnl"] == pytest.approx(pnl) and got["cost"] == pytest.approx(cost)


WALKED = "symbol string, ts timestamp_ntz, high double, low double, close double, atr double, _i long"
PLAN = "symbol string, direction int, entry double, stop double, take_profit double, horizon int, bar_index long"


def walk(spark, bars, direction=1, entry=100.0, stop=98.0, take=104.0, horizon=12, trail=None):
    """Exit price, bar and reason of a plan whose signal is on the bar before the given ones."""
    rows = [("AAA", T0 + timedelta(minutes=i), float(h), float(l), float(c), a, i) for i, (h, l, c, a) in enumerate([(0, 0, 0, 1.0), *bars])]
    plan = spark.createDataFrame([("AAA", direction, entry, stop, take, horizon, 0)], PLAN)
    r = trade_outcomes(plan, spark.createDataFrame(rows, WALKED), horizon, trail).first()
    assert r["exit_time"] == T0 + timedelta(minutes=r["exit_index"])
    return r["exit"], r["exit_index"] - 1, r["reason"]


def test_exit_rules(spark):
    assert walk(spark, [(101, 99, 100, 1.0), (105, 100, 104, 1.0)]) == (104.0, 1, "take")
    assert walk(spark, [(101, 97, 100, 1.0)]) == (98.0, 0, "stop")
    assert walk(spark, [(106, 97, 100, 1.0)]) == (98.0, 0, "stop")  # both in one bar: the stop
    assert walk(spark, [(101, 99, 100.5, 1.0)] * 3) == (100.5, 2, "horizon")
    assert walk(spark, [(101, 99, 100.5, 1.0), (105, 99, 100.0, 1.0)], horizon=0) == (100.5, 0, "horizon")
    assert walk(spark, [(101, 99, 100, 1.0), (103, 100, 100, 1.0)], -1, stop=102.0, take=96.0) == (102.0, 1, "stop")


def test_trailing_stop(spark):
    # 105 - 2 * 1 = 103 is the new stop; it never loosens afterwards.
    bars = [(105, 104, 104.5, 1.0), (104, 103.5, 103.6, 1.0), (103.5, 102.5, 102.6, 1.0)]
    assert walk(spark, bars, stop=98.0, take=200.0, trail=2.0) == (103.0, 2, "trail")
    short = [(96, 95, 95.5, 1.0), (96.5, 95.5, 96, 1.0), (97.5, 96, 97, 1.0)]
    assert walk(spark, short, -1, stop=102.0, take=1.0, trail=2.0) == (97.0, 2, "trail")
    assert walk(spark, [(105, 97, 98, 0.0)], take=200.0, trail=2.0) == (98.0, 0, "trail")


@pytest.mark.parametrize("trail", [None, 1.5])
def test_outcomes_equal_a_walk_along_every_path(spark, trail):
    """Random walks of two symbols with missing ATRs, horizons up to 200 bars, many plans a bar, plans near the end."""
    rng = np.random.default_rng(11)
    rows, plans, want = [], [], []
    for symbol, n in (("HOT", 900), ("b", 40)):
        close = 100 + np.cumsum(rng.normal(0, 0.5, n))
        high, low = close + rng.random(n), close - rng.random(n)
        atr = np.where(rng.random(n) < 0.1, 0.0, rng.random(n) + 0.2)
        rows += [(symbol, T0 + timedelta(minutes=i), *map(float, (high[i], low[i], close[i], atr[i])), i) for i in range(n)]
        for _ in range(n):
            at, side, horizon = int(rng.integers(0, n - 1)), int(rng.choice([-1, 1])), int(rng.integers(0, 201))
            entry = float(close[at])
            stop, take = entry - side * float(rng.random() * 6), entry + side * float(rng.random() * 12)
            plans.append((symbol, side, entry, stop, take, horizon, at))
            level, found = stop, None
            path = range(at + 1, min(n, at + 2 + horizon))
            for i in path:
                if trail and atr[i] > 0:
                    level = max(level, high[i] - trail * atr[i]) if side > 0 else min(level, low[i] + trail * atr[i])
                if (low[i] <= level) if side > 0 else (high[i] >= level):
                    found = (float(level), i, "trail" if trail else "stop")
                elif (high[i] >= take) if side > 0 else (low[i] <= take):
                    found = (take, i, "take")
                if found:
                    break
            want.append((*plans[-1], *(found or (float(close[path[-1]]), path[-1], "horizon"))))
    got = trade_outcomes(spark.createDataFrame(plans, PLAN), spark.createDataFrame(rows, WALKED), 200, trail)
    assert not any(x in str(got._jdf.queryExecution()) for x in ("collect_list", "CollectList"))
    cols = ["symbol", "direction", "entry", "stop", "take_profit", "horizon", "bar_index", "exit", "exit_index", "reason"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(want)


def signal(spark, *rows):
    return spark.createDataFrame([(s, t, d, 0.9, h) for s, t, d, h in rows], SIGNAL)


def bar_time(i):
    return T0 + timedelta(minutes=5 * i)


def test_next_bar_entry_and_take(spark):
    df = spark.createDataFrame(linear_rows("AAA", 100, 130), BAR)
    got = trade_ledger(df, signal(spark, ("AAA", bar_time(20), 1, 12)), "5m").collect()
    rows = linear_rows("AAA", 100, 130)
    assert len(got) == 1 and got[0]["entry"] == rows[21][2] and got[0]["entry_time"] == bar_time(21)
    assert got[0]["reason"] == "take" and got[0]["pnl"] > 0


def test_untradable_signals_drop(spark):
    df = spark.createDataFrame(linear_rows("AAA", 100, 130), BAR)
    off = [("AAA", bar_time(20) + timedelta(minutes=1), 1, 12), ("AAA", bar_time(59), 1, 12), ("AAA", bar_time(2), 1, 12),
           ("BBB", bar_time(20), 1, 12), ("AAA", bar_time(20), 0, 12)]
    assert trade_ledger(df, signal(spark, *off), "5m").isEmpty()
    with pytest.raises(Exception, match="max_horizon"):
        trade_ledger(df, signal(spark, ("AAA", bar_time(20), 1, 13)), "5m").collect()


def brute_ledger(bars, signals, trail=None, horizon=12, equity=100_000.0, s=Sizing()):
    """The reference-equity walk, trade by trade."""
    out = []
    for symbol, g in bars.groupby("symbol"):
        g = g.sort_values("ts").reset_index(drop=True)
        tr = pd.concat([g.high - g.low, (g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()], axis=1).max(axis=1)
        atr = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        at = {t: i for i, t in enumerate(g.ts)}
        busy = None
        for _, sig in signals[signals.symbol == symbol].sort_values("ts").iterrows():
            i = at[sig.ts]
            if busy is not None and sig.ts < busy or i + 1 >= len(g) or not atr[i] > 0 or sig.direction == 0:
                continue
            entry, dist, d = g.open[i + 1], s.stop_atr_mult * atr[i], sig.direction
            qty = min(equity * s.risk_pct // dist, equity * s.max_position_pct // entry)
            stop, take = entry - d * dist, entry + d * s.rr_ratio * dist
            end = min(i + 1 + horizon, len(g) - 1)
            price, when, why = g.close[end], g.ts[end], "horizon"
            for j in range(i + 1, end + 1):
                if trail:
                    stop = max(stop, g.high[j] - trail * atr[j]) if d > 0 else min(stop, g.low[j] + trail * atr[j])
                if (g.low[j] <= stop) if d > 0 else (g.high[j] >= stop):
                    price, when, why = stop, g.ts[j], "trail" if trail else "stop"
                    break
                if (g.high[j] >= take) if d > 0 else (g.low[j] <= take):
                    price, when, why = take, g.ts[j], "take"
                    break
            busy = when
            out.append((symbol, sig.ts, when, why, qty, d * (price - entry) * qty))
    return out


@pytest.mark.parametrize("trail", [None, 1.0])
def test_ledger_matches_brute_force(spark, trail):
    rows = minute_rows("A") + minute_rows("B", seed=5) + minute_rows("C", seed=6)
    bars = spark.createDataFrame(rows, BAR)
    rng = random.Random(1)
    sigs = [(r[0], r[1], rng.choice([-1, 0, 1]), 12) for r in rows if rng.random() < 0.5]
    sdf = signal(spark, *sigs)
    got = trade_ledger(bars, sdf, "1m", trail_atr_mult=trail).orderBy("symbol", "signal_ts").collect()
    want = brute_ledger(bars.toPandas(), sdf.toPandas(), trail)
    assert len(got) == len(want) > 30
    for g, w in zip(got, want):
        assert (g["symbol"], g["signal_ts"], g["exit_time"], g["reason"], g["quantity"]) == w[:5]
        assert g["pnl"] == pytest.approx(w[5], abs=1e-6)


@pytest.mark.parametrize("block", [8, 16, 1024])
def test_single_position_over_blocks(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    for symbol in ("A", "B"):
        at = np.sort(rng.choice(600, 260, replace=False))
        rows += [(symbol, int(i), int(i + rng.integers(1, 8))) for i in at]
    df = spark.createDataFrame(rows, "symbol string, bar_index long, exit_index long")
    got = {(r["symbol"], r["bar_index"]) for r in trades.single_position(df, 7, block_bars=block).collect()}
    want, busy = set(), {}
    for s, i, x in rows:
        if i >= busy.get(s, -1):
            want.add((s, i))
            busy[s] = x
    assert got == want


LEDGER = ("symbol string, signal_ts timestamp_ntz, exit_time timestamp_ntz, entry double, quantity long, pnl double, "
          "risk_amount double, cost double")


def ledger(spark, *rows):
    return spark.createDataFrame([(*r, 0.0) for r in rows], LEDGER)


def at(minutes, day=3):
    return datetime(2024, 6, day, 10) + timedelta(minutes=minutes)


def test_equity_and_metrics(spark):
    pnl = [20000.0, -30000.0, 20000.0, 5000.0, -1000.0]
    df = ledger(spark, *[("A", at(i), at(i + 1, 3 + i % 3), 10.0, 1, p, 1.0) for i, p in enumerate(pnl)])
    curve = metrics.equity_curve(df)
    got = curve.orderBy("exit_time").toPandas()
    ordered = df.orderBy("exit_time").toPandas().pnl
    equity = 100_000 + ordered.cumsum()
    np.testing.assert_allclose(got.equity, equity)
    peaks = np.maximum.accumulate(np.r_[100_000, equity])
    np.testing.assert_allclose(got.drawdown, (equity - peaks[1:]) / peaks[1:])
    m = metrics.trade_metrics(curve).first()
    r = ordered / (equity - ordered)
    assert m["n_trades"] == 5 and m["win_rate"] == pytest.approx(0.6)
    assert m["total_return"] == pytest.approx(0.14) and m["best_trade"] == pytest.approx(r.max())
    assert m["profit_factor"] == pytest.approx(r[r > 0].sum() / -r[r < 0].sum())
    assert m["sharpe"] == pytest.approx(np.sqrt(252) * r.mean() / r.std(ddof=1))
    rows = {x["metric"]: x["value"] for x in metrics.metrics_rows(metrics.trade_metrics(curve)).collect()}
    assert rows["n_trades"] == 5.0 and len(rows) == 10


def test_drawdown_of_a_quarter(spark):
    df = ledger(spark, ("A", at(0), at(1), 1.0, 1, 20.0, 0.0), ("A", at(2), at(3), 1.0, 1, -30.0, 0.0), ("A", at(4), at(5), 1.0, 1, 20.0, 0.0))
    curve = metrics.equity_curve(df, 100.0)
    assert metrics.max_drawdown(curve).first()[0] == pytest.approx(-0.25)


def test_metric_edge_cases(spark):
    wins = metrics.trade_metrics(metrics.equity_curve(ledger(spark, ("A", at(0), at(1), 1.0, 1, 5.0, 0.0)))).first()
    assert wins["profit_factor"] == float("inf") and wins["sharpe"] == 0.0
    none = metrics.trade_metrics(metrics.equity_curve(ledger(spark).limit(0))).first()
    assert none["n_trades"] == 0 and none["profit_factor"] == 0 and none["max_drawdown"] == 0


def test_equity_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        t = datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(0, 20000)))
        rows.append((f"s{i}", t, t + timedelta(minutes=int(rng.integers(1, 50))), 1.0, 1, float(rng.normal(0, 3000)), 1.0))
    got = metrics.equity_curve(ledger(spark, *rows)).toPandas().sort_values(["exit_time", "signal_ts", "symbol"])
    equity = 100_000 + got.pnl.cumsum()
    np.testing.assert_allclose(got.equity, equity)
    np.testing.assert_allclose(got.peak, np.maximum(100_000, equity.cummax()))


def breach(spark, rows, limits=portfolio.Limits(), correlations=None):
    out = portfolio.limit_breaches(ledger(spark, *rows), 100_000.0, limits, correlations)
    return {(r["symbol"], r["signal_ts"]): r["breach"] for r in out.collect()}


def test_each_limit(spark):
    row = lambda s, a, b, entry=10.0, qty=10, pnl=0.0, risk=100.0, day=3: (s, at(a, day), at(b, day), entry, qty, pnl, risk)
    got = breach(spark, [row("A", 0, 50), row("B", 1, 50), row("C", 2, 50)], portfolio.Limits(max_concurrent_positions=2))
    assert list(got.values()) == [None, None, "max concurrent positions"]
    got = breach(spark, [row("A", 0, 50), row("A", 10, 60)])
    assert got["A", at(10)] == "symbol already open" and got["A", at(0)] is None
    got = breach(spark, [row("A", 0, 50), row("A", 50, 60)])
    assert got["A", at(50)] is None  # closed at that moment
    got = breach(spark, [row("A", 0, 5, qty=3000)])
    assert got["A", at(0)] == "symbol exposure cap"
    got = breach(spark, [row("A", 0, 50, risk=4000.0), row("B", 5, 50, risk=2500.0)])
    assert got["A", at(0)] is None and got["B", at(5)] == "total risk budget"
    loss = [row("A", 0, 5, pnl=-3000.0), row("B", 6, 8), row("C", 6, 8, day=4)]
    got = breach(spark, loss)
    assert got["B", at(6)] == "daily loss limit reached" and got["C", at(6, 4)] is None
    pairs = spark.createDataFrame([("A", "B", 0.95)], "symbol_a string, symbol_b string, correlation double")
    got = breach(spark, [row("A", 0, 50), row("B", 5, 50), row("C", 6, 50)], correlations=pairs)
    assert got["B", at(5)] == "correlated with open A" and got["C", at(6)] is None


def test_open_state_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in ("A", "B", "C", "D"):
        t = datetime(2024, 1, 1)
        for _ in range(60):
            t += timedelta(minutes=int(rng.integers(0, 400)))
            e = t + timedelta(minutes=int(rng.integers(1, 500)))
            rows.append((s, t, e, 1.0, 1, float(rng.normal(0, 100)), float(rng.uniform(1, 50))))
            t = e
    got = portfolio.open_state(ledger(spark, *rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [x for x in rows if (x[1], x[0]) < (r["signal_ts"], r["symbol"]) and x[2] > r["signal_ts"]]
        assert r["open_count"] == len(earlier)
        assert r["open_risk"] == pytest.approx(sum(x[6] for x in earlier), abs=1e-6)
        today = [x[5] for x in rows if x[2] <= r["signal_ts"] and x[2].date() == r["signal_ts"].date()]
        assert r["realised_today"] == pytest.approx(sum(today), abs=1e-6)


@pytest.mark.parametrize("tile", [2, 3, 512])
def test_correlations_match_pandas(spark, tile):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    wide = pd.DataFrame({"A": a, "C": 0.97 * a + 0.05 * rng.normal(size=200), "D": rng.normal(size=200), "E": rng.normal(size=200), "F": -a})
    wide.iloc[::7, 1] = np.nan
    wide.iloc[1::3, 3] = np.nan
    wide["ts"] = pd.date_range("2024-01-01", periods=200, freq="1min")
    long = wide.melt("ts", var_name="symbol", value_name="ret").dropna()
    df = spark.createDataFrame(long, "ts timestamp_ntz, symbol string, ret double")
    got = portfolio.return_correlations(df, tile=tile).toPandas()
    want = wide.drop(columns="ts").corr()
    assert len(got) == 10
    for _, r in got.iterrows():
        assert r.correlation == pytest.approx(want.loc[r.symbol_a, r.symbol_b], abs=1e-10)
    pairs = spark.createDataFrame([("A", "A"), ("C", "A"), ("A", "Z")], "symbol_a string, symbol_b string")
    look = {(r[0], r[1]): r[2] for r in portfolio.correlation_lookup(pairs, portfolio.return_correlations(df)).select("symbol_a", "symbol_b", "correlation").collect()}
    assert look["A", "A"] == 1.0 and look["A", "Z"] == 0.0 and look["C", "A"] > 0.9
    assert portfolio.return_correlations(df, ["A", "C"]).count() == 1


@pytest.mark.parametrize("group", [60, 4_000_000])
def test_correlations_of_groups_and_slices(spark, group):
    rng = np.random.default_rng(4)
    wide = pd.DataFrame({f"S{i}": rng.normal(size=90) for i in range(9)})
    wide = wide.mask(rng.random(wide.shape) < 0.5)
    wide["ts"] = pd.date_range("2024-01-01", periods=90, freq="1D")
    long = wide.melt("ts", var_name="symbol", value_name="ret").dropna()
    long = pd.concat([long, pd.DataFrame({"ts": wide.ts[:3], "symbol": "S1", "ret": [np.inf, np.nan, -np.inf]})])
    long = long.drop_duplicates(["ts", "symbol"])
    df = spark.createDataFrame(long, "ts timestamp_ntz, symbol string, ret double").repartition(3)
    want = wide.drop(columns="ts").corr()
    there = wide.drop(columns="ts").notna().astype(int)
    common = there.T @ there
    # Two symbols a tile; the small group also cuts the moments into slices.
    got = portfolio.return_correlations(df, tile=2, group=group).toPandas()
    assert len(got) == 36 and (got.symbol_a < got.symbol_b).all()
    for _, r in got.iterrows():
        assert r.n == common.loc[r.symbol_a, r.symbol_b] and r.correlation == pytest.approx(want.loc[r.symbol_a, r.symbol_b], abs=1e-9)
    strong = portfolio.return_correlations(df, tile=2, group=group, least=0.2, min_rows=20).toPandas()
    kept = got[(got.correlation.abs() >= 0.2) & (got.n >= 20)]
    assert set(zip(strong.symbol_a, strong.symbol_b)) == set(zip(kept.symbol_a, kept.symbol_b)) and len(kept) < 36


def test_pairs_of_symbols_are_not_shuffled(spark):
    rows = [(f"S{i}", datetime(2024, 1, 1 + k), float((i * 7 + k * k) % 5)) for i in range(30) for k in range(9)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    plan = portfolio.return_correlations(df)._jdf.queryExecution().executedPlan().toString()
    # The plan is printed from the result down: no exchange or join follows the step that adds up the pairs.
    above = plan[: plan.index("MapIn")]
    assert "Exchange" not in above and "Join" not in above
    assert portfolio.return_correlations(df).count() == 435


def test_returns_meet_without_copies(spark):
    rows = [(f"S{i}", datetime(2024, 1, 1 + k), float((i * 7 + k * k) % 5)) for i in range(30) for k in range(9)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    found = portfolio.return_correlations(df, tile=3)
    # Cells are read from the stored table, whichever join Spark takes; only many slices shuffle sums.
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = portfolio.return_correlations(df, tile=3)
        assert "CartesianProduct" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(large.collect()) == sorted(found.collect()) and found.count() == 435
        sliced = portfolio.return_correlations(df, tile=3, group=9).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = found.toPandas().merge(sliced, on=["symbol_a", "symbol_b"])
    assert len(whole) == len(sliced) == 435 and (whole.n_x == whole.n_y).all()
    assert np.allclose(whole.correlation_x, whole.correlation_y, atol=1e-9, equal_nan=True)
    empty = spark.createDataFrame([], "symbol string, ts timestamp_ntz, ret double")
    assert portfolio.return_correlations(empty).count() == 0


def test_supplier_correlations_leave_one_stored_table(spark, tmp_path):
    from tapeweave.plans.queries import return_correlation_suppliers
    from tapeweave.session import child_names, shared_dir

    rng = np.random.default_rng(8)
    lines = pd.DataFrame({
        "l_orderkey": np.arange(400), "l_partkey": 1, "l_suppkey": rng.integers(1, 8, 400), "l_linenumber": 1,
        "l_quantity": rng.integers(1, 9, 400).astype(float), "l_extendedprice": rng.random(400) * 100 + 1,
        "l_shipdate": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, 400), "D"),
    })
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = f"{shared_dir(spark)}/tables"
    before = set(child_names(spark, tables))
    got = return_correlation_suppliers(spark, str(tmp_path))
    assert len(set(child_names(spark, tables)) - before) == 1
    closes = lines.assign(price=lines.l_extendedprice / lines.l_quantity).groupby(["l_suppkey", "l_shipdate"]).price.last()
    want = closes.groupby("l_suppkey").pct_change().unstack(0).corr()
    rows = got.collect()
    assert len(rows) == 21
    for r in rows:
        assert r.correlation == pytest.approx(want.loc[int(r.symbol_a[1:]), int(r.symbol_b[1:])], abs=2e-6)


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    from tapeweave.session import materialize_all

    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept, before = spark.conf.get(key, "false"), shuffles()
    frames = {k: spark.range(5000).groupBy((F.col("id") % (1000 + k)).alias("id")).count() for k in range(3)}
    stored = materialize_all(frames)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(key, "false") == kept
    assert [stored[k].count() for k in range(3)] == [1000, 1001, 1002]


CATALYST = "symbol string, ts timestamp_ntz, catalyst string, strength double, confidence double"


def test_boost_inside_and_outside_the_window(spark):
    sig = spark.createDataFrame([("A", at(0, 5), 1, 0.5, 12)], SIGNAL)
    cat = lambda t, s="A", c="m_and_a": spark.createDataFrame([(s, t, c, 0.9, 0.8)], CATALYST)
    near = fusion.fuse_signals(sig, cat(at(-60, 5))).first()
    assert near["probability"] == pytest.approx(0.5 + 0.15 * 0.72) and near["catalyst_boost"] == pytest.approx(0.108)
    for other in (cat(at(-60, 3)), cat(at(1, 5)), cat(at(-60, 5), "B"), cat(at(-60, 5), c="none")):
        assert fusion.fuse_signals(sig, other).first()["probability"] == 0.5
    # Both ends of the window count, and a boost can lift a signal over the gate.
    assert fusion.fuse_signals(sig, cat(at(0, 4))).first()["catalyst_boost"] > 0
    assert fusion.fuse_signals(sig, cat(at(0, 5)), min_prob=0.55).count() == 1
    assert fusion.fuse_signals(sig, None, min_prob=0.55).isEmpty()


def test_boost_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    hot = lambda n: rng.choice(["HOT", "a"], n, p=[0.9, 0.1])
    when = lambda n: [datetime(2024, 1, 1) + timedelta(minutes=int(m)) for m in rng.integers(0, 6000, n)]
    sig = [(s, t, 1, 0.5, 12) for s, t in {*zip(hot(300).tolist(), when(300))}]
    cat = [(s, t, "earnings", float(a), float(b)) for s, t, a, b in zip(hot(200).tolist(), when(200), rng.random(200), rng.random(200))]
    got = fusion.catalyst_boost(spark.createDataFrame(sig, SIGNAL), spark.createDataFrame(cat, CATALYST), 7200).collect()
    assert len(got) == len(sig)
    for r in got:
        near = [0.15 * c[3] * c[4] for c in cat if c[0] == r["symbol"] and timedelta(0) <= r["ts"] - c[1] <= timedelta(hours=2)]
        assert r["catalyst_boost"] == pytest.approx(max(near, default=0.0), abs=1e-12)


def test_meta_keeps_its_entries(spark):
    sig = spark.createDataFrame([("A", at(0, 5), 1, 0.5, 12, {"model": "x"})], SIGNAL + ", meta map<string,string>")
    cat = spark.createDataFrame([("A", at(-5, 5), "earnings", 1.0, 1.0)], CATALYST)
    assert fusion.fuse_signals(sig, cat).first()["meta"] == {"model": "x", "catalyst_boost": "0.15"}


def test_block_starts_equal_a_walk(spark):
    """Long, short and gapped series, over several levels of groups."""
    rng = np.random.default_rng(2)
    rows, want = [], []
    for symbol, numbers in (("HOT", range(300)), ("gaps", sorted(rng.choice(5000, 200, replace=False).tolist())), ("one", [7]), ("edge", [63, 64, 127, 128, 4095, 4096])):
        busy, last = 0, None
        for n in numbers:
            table = rng.integers(0, 4, 4).tolist()
            busy = busy if last is not None and n == last + 1 else 0
            rows.append((symbol, n, table))
            want.append((symbol, n, busy))
            busy, last = table[busy], n
    got = trades.block_starts(spark.createDataFrame(rows, "symbol string, _blk long, _map array<long>"), ["symbol"], 3)
    assert sorted(tuple(r) for r in got.select("symbol", "_blk", "_busy").collect()) == sorted(want)
