"""DuckDB statements that state each registered query's result independently."""

from __future__ import annotations

from tapeweave.operators.catalysts import KEYWORDS, MODEL_LABELS, STRENGTH
from tapeweave.operators.indicators import INDICATOR_COLUMNS
from tapeweave.operators.models import draw_trials
from tapeweave.operators.patterns import PATTERN_COLUMNS
from tapeweave.plans.fixtures import LEXICON, SYMBOLS

OHLC = "open, high, low, close, volume"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def rs(cols, digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in (cols.split(", ") if isinstance(cols, str) else cols))


def q(*ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {body}"


# --- bars ------------------------------------------------------------------------------------

TICKS = """ticks AS MATERIALIZED (SELECT event_type AS symbol, ts, event_id AS seq, value + 1.0 AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events)"""


def tick_bars(name: str, bin_: str, stamp: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT symbol, {stamp} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(size) AS volume
  FROM (SELECT *, {bin_} AS bin FROM ticks) GROUP BY symbol, bin)"""


def bar_bars(name: str, source: str, bin_: str, stamp: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT symbol, {stamp} AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
  min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
  FROM (SELECT *, {bin_} AS bin FROM {source}) GROUP BY symbol, bin)"""


HOUR = "date_trunc('hour', ts)"
B1H = f"{TICKS}, " + tick_bars("bars", HOUR, "bin")
B1HC = f"{TICKS}, " + tick_bars("bars", HOUR, "bin + INTERVAL 1 HOUR")
FOUR = "date_trunc('day', ts) + (extract(hour FROM ts) // 4 * 4) * INTERVAL 1 HOUR"
DAY = "date_trunc('day', ts)"
SUNDAY = "date_trunc('day', ts) - extract(dow FROM ts) * INTERVAL 1 DAY"
MONTH = "date_trunc('month', ts)"


def resampled(bin_: str, stamp: str, source: str = "bars") -> str:
    return q(B1H, bar_bars("out", source, bin_, stamp), body=f"SELECT symbol, ts, {rs(OHLC)} FROM out")


SUPPLIER_BARS = """sbars AS MATERIALIZED (SELECT 'S' || l_suppkey AS symbol, date_trunc('day', l_shipdate) + INTERVAL 1 DAY AS ts,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

FILLED = """days AS (SELECT symbol, date_trunc('day', ts) AS day, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1, 2),
grid AS (SELECT symbol, day, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM days),
gridded AS (SELECT g.symbol, g.day, g.ts, b.open, b.high, b.low, b.close, b.volume, b.close IS NULL AS imputed,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol, g.day ORDER BY g.ts) AS carried
  FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts),
filled AS MATERIALIZED (SELECT symbol, ts, CASE WHEN imputed THEN carried ELSE open END AS open,
  CASE WHEN imputed THEN carried ELSE high END AS high, CASE WHEN imputed THEN carried ELSE low END AS low,
  carried AS close, coalesce(volume, 0.0) AS volume, imputed FROM gridded WHERE carried IS NOT NULL)"""

# --- indicators ------------------------------------------------------------------------------


def window_features(source: str, out: str) -> str:
    """All columns that need no decaying mean."""
    w = "PARTITION BY symbol ORDER BY ts"
    roll = lambda n: f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""{out}_lag AS (SELECT *, row_number() OVER ({w}) - 1 AS i, lag(close) OVER ({w}) AS pc, lag(high) OVER ({w}) AS ph,
  lag(low) OVER ({w}) AS pl, lag(open) OVER ({w}) AS po, lag(open, 2) OVER ({w}) AS po2, lag(close, 2) OVER ({w}) AS pc2,
  avg(close) {roll(20)} AS a20, stddev_samp(close) {roll(20)} AS s20, min(low) {roll(14)} AS l14, max(high) {roll(14)} AS h14
  FROM {source}),
{out}_bar AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm,
  CASE WHEN i >= 13 THEN 100.0 * (close - l14) / nullif(h14 - l14, 0) END AS stoch_k,
  sum(coalesce(sign(close - pc), 0) * volume) OVER ({w}) AS obv,
  sum((high + low + close) / 3.0 * volume) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts) AS cpv,
  sum(volume) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts) AS cv FROM {out}_lag),
{out} AS MATERIALIZED (SELECT *, close / nullif(pc, 0) - 1 AS ret_1, ln(close) - ln(pc) AS log_ret_1,
  CASE WHEN i >= 19 THEN a20 END AS sma_20, CASE WHEN i >= 19 THEN a20 END AS bb_mid,
  CASE WHEN i >= 19 THEN a20 + 2 * s20 END AS bb_upper, CASE WHEN i >= 19 THEN a20 - 2 * s20 END AS bb_lower,
  CASE WHEN i >= 19 THEN 4 * s20 / nullif(a20, 0) END AS bb_width,
  CASE WHEN count(stoch_k) {roll(3)} >= 3 THEN avg(stoch_k) {roll(3)} END AS stoch_d,
  (close - cpv / nullif(cv, 0)) / nullif(close, 0) AS vwap_dev,
  CASE WHEN i >= 9 THEN (obv - avg(obv) {roll(50)}) / nullif(stddev_samp(obv) {roll(50)}, 0) END AS obv_z,
  (close - low) / nullif(high - low, 0) AS close_pos FROM {out}_bar)"""


def ewm_features(source: str, out: str) -> str:
    """Decaying means row by row, over a frame from ``window_features``."""
    step = lambda a, old, new: f"(1.0 - {a}) * {old} + {a} * {new}"
    w14 = "(1.0 / 14)"
    return f"""{out}_one AS (
  SELECT symbol, i, close AS e12, close AS e26, NULL::DOUBLE AS ag, NULL::DOUBLE AS al, tr AS a14, pdm AS p14, mdm AS m14
  FROM {source} WHERE i = 0
  UNION ALL
  SELECT s.symbol, s.i, {step('(2.0 / 13)', 'e.e12', 's.close')}, {step('(2.0 / 27)', 'e.e26', 's.close')},
    CASE WHEN e.ag IS NULL THEN greatest(s.close - s.pc, 0.0) ELSE {step(w14, 'e.ag', 'greatest(s.close - s.pc, 0.0)')} END,
    CASE WHEN e.al IS NULL THEN greatest(s.pc - s.close, 0.0) ELSE {step(w14, 'e.al', 'greatest(s.pc - s.close, 0.0)')} END,
    {step(w14, 'e.a14', 's.tr')}, {step(w14, 'e.p14', 's.pdm')}, {step(w14, 'e.m14', 's.mdm')}
  FROM {out}_one e JOIN {source} s ON s.symbol = e.symbol AND s.i = e.i + 1),
{out}_two AS MATERIALIZED (SELECT s.*, CASE WHEN s.i >= 11 THEN e12 END AS ema_12, CASE WHEN s.i >= 25 THEN e26 END AS ema_26,
  CASE WHEN s.i >= 25 THEN e12 - e26 END AS macd, CASE WHEN s.i >= 14 THEN 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi_14,
  CASE WHEN s.i >= 13 THEN a14 END AS atr, CASE WHEN s.i >= 13 THEN 100 * p14 / nullif(a14, 0) END AS plus_di,
  CASE WHEN s.i >= 13 THEN 100 * m14 / nullif(a14, 0) END AS minus_di
  FROM {source} s JOIN {out}_one e ON s.symbol = e.symbol AND s.i = e.i),
{out}_dx AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM {out}_two),
{out}_three AS (
  SELECT symbol, i, macd AS sig, dx AS y, 0 AS gap, CASE WHEN dx IS NULL THEN 0 ELSE 1 END AS seen FROM {out}_dx WHERE i = 0
  UNION ALL
  SELECT s.symbol, s.i, CASE WHEN e.sig IS NULL THEN s.macd ELSE 0.8 * e.sig + 0.2 * s.macd END,
    CASE WHEN s.dx IS NULL THEN e.y WHEN e.y IS NULL THEN s.dx
      ELSE (pow(13.0 / 14, e.gap + 1) * e.y + s.dx / 14) / (pow(13.0 / 14, e.gap + 1) + 1.0 / 14) END,
    CASE WHEN s.dx IS NULL THEN e.gap + 1 ELSE 0 END, e.seen + CASE WHEN s.dx IS NULL THEN 0 ELSE 1 END
  FROM {out}_three e JOIN {out}_dx s ON s.symbol = e.symbol AND s.i = e.i + 1),
{out} AS MATERIALIZED (SELECT s.*, CASE WHEN s.i >= 33 THEN sig END AS macd_signal, CASE WHEN s.i >= 33 THEN macd - sig END AS macd_hist,
  CASE WHEN seen >= 14 THEN y END AS adx, nullif(high - low, 0) / nullif(atr, 0) AS range_atr
  FROM {out}_dx s JOIN {out}_three e ON s.symbol = e.symbol AND s.i = e.i)"""


def atr_only(source: str, out: str) -> str:
    return f"""{out}_tr AS (
  SELECT symbol, i, tr AS a14 FROM {source} WHERE i = 0
  UNION ALL
  SELECT s.symbol, s.i, (13.0 / 14) * e.a14 + s.tr / 14 FROM {out}_tr e JOIN {source} s ON s.symbol = e.symbol AND s.i = e.i + 1),
{out} AS MATERIALIZED (SELECT s.*, CASE WHEN s.i >= 13 THEN a14 END AS atr
  FROM {source} s JOIN {out}_tr e ON s.symbol = e.symbol AND s.i = e.i)"""


WINDOWED = f"{B1HC}, {window_features('bars', 'wf')}"
FULL = f"{WINDOWED}, {ewm_features('wf', 'feat')}"


def windowed(*cols: str) -> str:
    return q(WINDOWED, body=f"SELECT symbol, ts, {rs(cols)} FROM wf")


def decayed(*cols: str) -> str:
    return q(FULL, body=f"SELECT symbol, ts, {rs(cols)} FROM feat")


PATTERN_SQL = {
    "cdl_doji": "CASE WHEN abs(close - open) <= 0.1 * nullif(high - low, 0) THEN 1 ELSE 0 END",
    "cdl_hammer": """CASE WHEN least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= abs(close - open)
      AND close <> open THEN 1 ELSE 0 END""",
    "cdl_inverted_hammer": """CASE WHEN high - greatest(open, close) >= 2 * abs(close - open)
      AND least(open, close) - low <= abs(close - open) AND close <> open THEN 1 ELSE 0 END""",
    "cdl_engulfing": """CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1
      WHEN close < open AND pc > po AND open >= pc AND close <= po THEN -1 ELSE 0 END""",
    "cdl_shooting_star": """CASE WHEN high - greatest(open, close) >= 2 * abs(close - open)
      AND least(open, close) - low <= 0.3 * abs(close - open) AND close < open THEN 1 ELSE 0 END""",
    "cdl_marubozu": """CASE WHEN abs(close - open) >= 0.9 * nullif(high - low, 0) AND close > open THEN 1
      WHEN abs(close - open) >= 0.9 * nullif(high - low, 0) AND close < open THEN -1 ELSE 0 END""",
    "cdl_morning_evening_star": """CASE WHEN pc2 < po2 AND abs(pc - po) <= 0.5 * abs(pc2 - po2) AND close > open
      AND close > (po2 + pc2) / 2 THEN 1 WHEN pc2 > po2 AND abs(pc - po) <= 0.5 * abs(pc2 - po2) AND close < open
      AND close < (po2 + pc2) / 2 THEN -1 ELSE 0 END""",
}


def pattern(col: str) -> str:
    return q(WINDOWED, body=f"SELECT symbol, ts, CAST({PATTERN_SQL[col]} AS INTEGER) AS {col} FROM wf")


SUPPLIER_COLUMNS = ["ret_1", "sma_20", "bb_width", "ema_12", "atr", "stoch_k"]
SUPPLIER_EWM = """semw AS (
  SELECT symbol, i, close AS e12, tr AS a14 FROM swf WHERE i = 0
  UNION ALL
  SELECT s.symbol, s.i, (11.0 / 13) * e.e12 + (2.0 / 13) * s.close, (13.0 / 14) * e.a14 + s.tr / 14
  FROM semw e JOIN swf s ON s.symbol = e.symbol AND s.i = e.i + 1),
sfeat AS (SELECT s.*, CASE WHEN s.i >= 11 THEN e12 END AS ema_12, CASE WHEN s.i >= 13 THEN a14 END AS atr
  FROM swf s JOIN semw e ON s.symbol = e.symbol AND s.i = e.i)"""

# --- point in time, labels, samples ----------------------------------------------------------


def labelled(source: str, out: str) -> str:
    """First touch by a bounded self-join; ``source`` has i, close, high, low, atr."""
    return f"""{out}_bar AS (SELECT a.symbol, a.i, min(b.i) FILTER (b.high >= a.close + 2 * a.atr) AS tp,
    min(b.i) FILTER (b.low <= a.close - 1 * a.atr) AS sl
  FROM {source} a JOIN {source} b ON b.symbol = a.symbol AND b.i BETWEEN a.i + 1 AND a.i + 12
  WHERE a.atr > 0 GROUP BY 1, 2),
{out}_end AS (SELECT *, lead(close, 12) OVER (PARTITION BY symbol ORDER BY i) AS close_end FROM {source}),
{out}_hit AS (SELECT e.*, CASE WHEN e.atr > 0 AND close_end IS NOT NULL THEN CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 'sl'
    WHEN tp IS NOT NULL THEN 'tp' ELSE 'vertical' END ELSE '' END AS touched
  FROM {out}_end e LEFT JOIN {out}_bar b ON b.symbol = e.symbol AND b.i = e.i),
{out} AS MATERIALIZED (SELECT *, CASE touched WHEN 'sl' THEN -1 WHEN 'tp' THEN 1 WHEN 'vertical' THEN 0 END AS label,
  CASE touched WHEN 'sl' THEN close - atr WHEN 'tp' THEN close + 2 * atr WHEN 'vertical' THEN close_end END / close - 1 AS ret
  FROM {out}_hit)"""


LABELS = f"{WINDOWED}, {atr_only('wf', 'af')}, {labelled('af', 'lab')}"


def cleaned(source: str, out: str, cols: list[str]) -> str:
    keep = ", ".join(
        f"coalesce(last_value(CAST({c} AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 0.0) AS {c}" for c in cols
    )
    return f"{out} AS MATERIALIZED (SELECT symbol, ts, i, {keep} FROM {source})"


def flat(source: str, out: str, cols: list[str], window: int) -> str:
    roll = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    stats = ", ".join(f"{c} AS {c}_last, avg({c}) {roll} AS {c}_mean, var_pop({c}) {roll} AS {c}_var" for c in cols)
    return f"{out} AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, i, {stats} FROM {source}) WHERE i >= {window - 1})"


FEATURES = INDICATOR_COLUMNS + PATTERN_COLUMNS


def hours(k: int) -> str:
    return f"date_trunc('day', ts) + (extract(hour FROM ts) // {k} * {k}) * INTERVAL 1 HOUR"


def grid(expr: str, name: str, bits: int) -> str:
    return f"round({expr} * {2**bits}.0::DOUBLE) / {2**bits}.0::DOUBLE + 0.0 AS {name}"


def frame_ctes(k: int) -> list[str]:
    """All features of the bars of ``k`` hours, cleaned as ``c<k>``; the bars with their indicators are ``e<k>``."""
    if k == 1:
        bars = "f1 AS (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, open, high, low, close, volume FROM filled)"
    else:
        bars = bar_bars(f"f{k}", "filled", DAY if k == 24 else hours(k), f"bin + INTERVAL {k} HOUR")
    flags = ", ".join(f"CAST({PATTERN_SQL[c]} AS INTEGER) AS {c}" for c in PATTERN_COLUMNS)
    return [bars, window_features(f"f{k}", f"w{k}"), ewm_features(f"w{k}", f"e{k}"), f"d{k} AS (SELECT *, {flags} FROM e{k})", cleaned(f"d{k}", f"c{k}", FEATURES)]


FRAMES = (1, 2, 4, 8)


def sample_ctes() -> str:
    parts = [B1H, FILLED]
    for k in FRAMES:
        parts += [*frame_ctes(k), flat(f"c{k}", f"x{k}", FEATURES, 64)]
    picked = ", ".join(f"x{k}.{c}_{kind} AS {c}_{kind}_{k}h" for k in FRAMES for c in FEATURES for kind in ("last", "mean"))
    ends = ", ".join(f"x{k}.i AS i{k}" for k in FRAMES)
    joins = " ".join(f"ASOF JOIN x{k} ON x{k}.symbol = lab.symbol AND x{k}.ts <= lab.ts" for k in FRAMES[1:])
    joined = f"""samples AS MATERIALIZED (SELECT lab.symbol, lab.ts, lab.i, CAST(lab.label + 1 AS INTEGER) AS label, lab.ret, {picked}, {ends}
  FROM lab JOIN x1 ON x1.symbol = lab.symbol AND x1.ts = lab.ts {joins} WHERE lab.label IS NOT NULL)"""
    return ", ".join([*parts, labelled("e1", "lab"), joined])


# Labelled bars and the number of the last bar of every timeframe that was closed then.
TENSOR_FRAMES = {1: "1h", 2: "2h", 4: "4h", 24: "1d"}
POINTED = """pointed AS MATERIALIZED (SELECT lab.symbol, lab.ts, CAST(lab.label + 1 AS INTEGER) AS label, lab.i AS i1, c2.i AS i2, c4.i AS i4, c24.i AS i24
  FROM lab ASOF JOIN c2 ON c2.symbol = lab.symbol AND c2.ts <= lab.ts ASOF JOIN c4 ON c4.symbol = lab.symbol AND c4.ts <= lab.ts
  ASOF JOIN c24 ON c24.symbol = lab.symbol AND c24.ts <= lab.ts
  WHERE lab.label IS NOT NULL AND least(lab.i, c2.i, c4.i, c24.i) >= 15)"""


SAMPLES = sample_ctes()
MODEL_COLS = [f"{c}_{kind}_{k}h" for k in FRAMES for kind in ("last", "mean") for c in FEATURES]
# Samples in their global order, with the blocks that four expanding folds are made of.
BLOCKED = """blocked AS MATERIALIZED (SELECT *, (rank >= floor(n / 5.0::DOUBLE))::INT + (rank >= floor(2 * (n / 5.0::DOUBLE)))::INT
  + (rank >= floor(3 * (n / 5.0::DOUBLE)))::INT + (rank >= floor(4 * (n / 5.0::DOUBLE)))::INT AS block
  FROM (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS rank, count(*) OVER () AS n FROM samples))"""
# The window values are unrolled here: mean and deviation over every value of every window.
UNROLLED = "unrolled AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT s.block, {', '.join('v.' + c for c in FEATURES)} FROM blocked s JOIN c{k} v ON v.symbol = s.symbol AND v.i BETWEEN s.i{k} - 63 AND s.i{k}"
    for k in FRAMES
) + ")"
STATS = "stats AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END AS std FROM unrolled" for c in FEATURES
) + ")"
ALL_STATS = f"{SAMPLES}, {BLOCKED}, {UNROLLED}, {STATS}"


def scaled(col: str) -> str:
    feature = next(c for c in sorted(FEATURES, key=len, reverse=True) if col.startswith((c + "_last_", c + "_mean_")))
    return grid(
        f"({col} - (SELECT mean FROM stats WHERE feature = '{feature}')) / (SELECT std FROM stats WHERE feature = '{feature}')", col, 12
    )


# Nearest class means under several label settings: ``marks`` has (setting, symbol, ts, label).
NEAREST = f"""long AS MATERIALIZED (SELECT symbol, ts, block, col, x, regexp_replace(col, '_(last|mean)_[0-9]+h$', '') AS feature
  FROM blocked UNPIVOT (x FOR col IN ({', '.join(MODEL_COLS)}))),
folds AS (SELECT unnest([1, 2, 3, 4]) AS fold),
wide_devs AS (SELECT fold, {', '.join(f"CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END AS {c}" for c in FEATURES)}
  FROM unrolled JOIN folds ON block < fold GROUP BY fold),
devs AS (SELECT fold, feature, std FROM wide_devs UNPIVOT (std FOR feature IN ({', '.join(FEATURES)}))),
block_sums AS MATERIALIZED (SELECT setting, block, label, col, feature, sum(x) AS total, count(*) AS n FROM long JOIN marks USING (symbol, ts) GROUP BY ALL),
means AS MATERIALIZED (SELECT setting, fold, label AS cls, col, std, sum(total) / sum(n) AS mean FROM block_sums JOIN folds ON block < fold
  JOIN devs USING (fold, feature) GROUP BY ALL),
far AS (SELECT m.setting, l.block AS fold, l.symbol, l.ts, m.cls, sum(pow((l.x - m.mean) / m.std, 2)) AS d
  FROM long l JOIN means m ON m.fold = l.block AND m.col = l.col GROUP BY ALL),
nearest AS (SELECT setting, fold, symbol, ts, cls AS pred FROM far QUALIFY row_number() OVER (PARTITION BY setting, symbol, ts ORDER BY d, cls) = 1),
predicted AS MATERIALIZED (SELECT setting, fold, (setting, fold) AS part, label, pred FROM nearest JOIN marks USING (setting, symbol, ts))"""
ONE_SETTING = "marks AS (SELECT 0 AS setting, symbol, ts, label FROM samples)"
TRIALS = "trials AS (SELECT * FROM (VALUES " + ", ".join(
    f"({t}, {p['take_profit_atr']!r}::DOUBLE, {p['stop_loss_atr']!r}::DOUBLE)" for t, p in enumerate(draw_trials())
) + ") AS v(setting, take, stop))"
TRIAL_MARKS = """touches AS (SELECT setting, a.symbol, a.i, min(b.i) FILTER (b.high >= a.close + take * a.atr) AS tp,
    min(b.i) FILTER (b.low <= a.close - stop * a.atr) AS sl
  FROM e1 a JOIN e1 b ON b.symbol = a.symbol AND b.i BETWEEN a.i + 1 AND a.i + 12, trials GROUP BY 1, 2, 3),
marks AS MATERIALIZED (SELECT setting, s.symbol, s.ts, CAST(CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 0 WHEN tp IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS label
  FROM samples s JOIN touches t ON t.symbol = s.symbol AND t.i = s.i)"""
SEARCHED = f"{SAMPLES}, {BLOCKED}, {UNROLLED}, {TRIALS}, {TRIAL_MARKS}, {NEAREST}"


RANKED = "ranked AS (SELECT symbol, ts, row_number() OVER (ORDER BY ts, symbol) - 1 AS rank, count(*) OVER () AS n FROM bars)"


def fold_rows(k: int, expanding: bool) -> str:
    """Rows (fold, role, symbol, ts, rank) of ``ranked``."""
    parts = []
    for i in range(1, k + 1):
        bound = lambda j: "n" if j == k + 1 else f"floor({j} * (n::DOUBLE / {k + 1}))"
        low = "0" if expanding else bound(i - 1)
        parts.append(f"SELECT {i} AS fold, 'train' AS role, symbol, ts, rank FROM ranked WHERE rank >= {low} AND rank < {bound(i)}")
        parts.append(f"SELECT {i} AS fold, 'val' AS role, symbol, ts, rank FROM ranked WHERE rank >= {bound(i)} AND rank < {bound(i + 1)}")
    return " UNION ALL ".join(parts)


def folds(k: int, expanding: bool) -> str:
    return q(B1HC, RANKED, body=fold_rows(k, expanding))


SAMPLE_RANKED = "ranked AS (SELECT symbol, ts, label, row_number() OVER (ORDER BY ts, symbol) - 1 AS rank, count(*) OVER () AS n FROM samples)"
# What SQL can state of a scored model: its rows, that probabilities add up to 1, and that the class is the likeliest.
MODEL_ROWS = """SELECT symbol, ts, label, 3 AS classes, 1.0::DOUBLE AS total, TRUE AS likeliest FROM ranked WHERE rank >= floor(n * 0.8::DOUBLE)"""


# --- stored tables and loads -----------------------------------------------------------------

MERGED = """early AS (SELECT symbol, '1h' AS timeframe, ts, open, high, low, close, volume FROM bars WHERE ts < TIMESTAMP '2024-01-20'),
late AS (SELECT symbol, '1h' AS timeframe, ts, open, high, low, close + 1 AS close, volume FROM bars WHERE ts >= TIMESTAMP '2024-01-10'),
merged AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM early e WHERE e.symbol = late.symbol AND e.ts = late.ts) THEN 'updated'
  ELSE 'inserted' END AS change FROM late
  UNION ALL SELECT *, 'kept' FROM early WHERE ts < TIMESTAMP '2024-01-10')"""
BAR_COLS = f"symbol, timeframe, ts, {rs(OHLC)}"
SYMBOL_LIST = "[" + ", ".join(f"'{s}'" for s in SYMBOLS) + "]"
NEWS = f"""news AS MATERIALIZED (SELECT TIMESTAMP '2024-01-01' + ((doc_id * 7919) % 43200) * INTERVAL 1 MINUTE AS ts,
  {SYMBOL_LIST}[(doc_id % 5) + 1] AS symbol, split_part(text, chr(10), 1) AS headline, text AS body, source, '' AS url, doc_id, n_chars
  FROM documents)"""
LAST_NEWS = """(SELECT *, row_number() OVER (PARTITION BY symbol, ts, headline ORDER BY doc_id DESC) AS k FROM {0}) WHERE k = 1"""
PLAN = """plan AS (SELECT symbol, timeframe, TIMESTAMP '2024-01-28' - days * INTERVAL 1 DAY AS start, TIMESTAMP '2024-01-28' AS "end"
  FROM (SELECT DISTINCT event_type AS symbol FROM events), (VALUES ('1m', 30), ('1h', 24)) AS h(timeframe, days))"""
RESUMED = """known AS (SELECT symbol, max(ts) AS max_ts FROM bars WHERE ts < TIMESTAMP '2024-01-20' AND symbol <> 'view' GROUP BY 1),
resumed AS (SELECT p.symbol, p.timeframe, CASE WHEN p.timeframe = '1h' AND max_ts >= start THEN max_ts + INTERVAL 1 SECOND ELSE start END AS start,
  "end" FROM plan p LEFT JOIN known k ON k.symbol = p.symbol)"""

# --- news and catalysts ----------------------------------------------------------------------


def tagged(lexicon: dict[str, list[str]], source: str = "news", out: str = "tagged") -> str:
    hits = ", ".join(
        " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words) + f" AS h_{name}"
        for name, words in lexicon.items()
    )
    top = "greatest(" + ", ".join(f"h_{n}" for n in lexicon) + ")"
    name = "CASE WHEN hits = 0 THEN 'none' " + " ".join(f"WHEN h_{n} = hits THEN '{n}'" for n in lexicon) + " END"
    strength = "CASE catalyst " + " ".join(f"WHEN '{n}' THEN {STRENGTH[n]}" for n in lexicon) + " ELSE 0.0 END"
    return f"""{out}_hits AS (SELECT *, {hits} FROM (SELECT *, lower(headline || ' ' || body) AS t FROM {source})),
{out}_top AS (SELECT *, {top} AS hits FROM {out}_hits),
{out}_named AS (SELECT *, {name} AS catalyst FROM {out}_top),
{out} AS MATERIALIZED (SELECT doc_id, ts, symbol, headline, body, source, url, catalyst, CAST({strength} AS DOUBLE) AS strength,
  CAST(CASE WHEN hits > 0 THEN least(1.0, 0.4 + 0.2 * hits) ELSE 0.0 END AS DOUBLE) AS confidence FROM {out}_named)"""


TAGS = f"{NEWS}, {tagged(LEXICON)}"
HYPOTHESES = "[" + ", ".join("'" + v + "'" for v in MODEL_LABELS.values()) + "]"
SCORED = f"""scored AS (SELECT doc_id, symbol, {HYPOTHESES}[(doc_id % 6) + 1] AS named, 0.3 + (n_chars % 70) / 100.0 AS conf,
  lower(['positive', 'neutral', 'Negative'][(doc_id % 3) + 1]) AS mood, (doc_id % 101) / 100.0 AS score FROM news),
judged AS (SELECT *, named <> 'none' AND conf >= 0.5 AS kept,
  CASE named {' '.join(f"WHEN '{k}' THEN {v}" for k, v in STRENGTH.items())} ELSE 0.3 END
  * CASE WHEN mood = 'neutral' THEN 0.5 ELSE 0.5 + 0.5 * score END AS raw FROM scored)"""

# --- signals and trades ----------------------------------------------------------------------

SIGNALS = f"""{FULL}, signals AS MATERIALIZED (SELECT symbol, ts, CAST(sign(macd_hist) AS INTEGER) AS direction,
  0.5 + least(0.49, abs(rsi_14 - 50) / 100) AS probability, 12 AS horizon FROM feat WHERE macd_hist IS NOT NULL AND rsi_14 IS NOT NULL)"""
BOOSTED = """boosted AS (SELECT s.*, coalesce((SELECT max(0.15 * c.strength * c.confidence) FROM tagged c WHERE c.symbol = s.symbol
  AND c.catalyst <> 'none' AND c.ts BETWEEN s.ts - INTERVAL 1 DAY AND s.ts), 0.0) AS catalyst_boost FROM signals s)"""


def plans(method: str = "fixed_fractional") -> str:
    kelly = "0.5 * greatest(0.0, least(1.0, probability - (1 - probability) / 2.0))"
    share = {"fixed_fractional": "0.01", "vol_target": "0.01", "kelly": kelly}[method]
    return f"""ctx AS (SELECT symbol, ts, i, atr, lead(open) OVER w AS entry, lead(ts) OVER w AS entry_time
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
sized AS (SELECT s.symbol, s.ts, s.direction, s.probability, c.i, c.entry, c.entry_time, 1.5 * c.atr AS dist,
  greatest(0, least(floor(100000.0 * {share} / (1.5 * c.atr)), floor(25000.0 / c.entry))) AS qty
  FROM signals s JOIN ctx c ON c.symbol = s.symbol AND c.ts = s.ts
  WHERE s.direction <> 0 AND c.entry IS NOT NULL AND c.atr > 0 AND c.entry > 0),
plans AS MATERIALIZED (SELECT *, entry - direction * dist AS stop, entry + direction * 2.0 * dist AS take_profit,
  CAST(qty AS BIGINT) AS quantity, qty * dist AS risk_amount FROM sized WHERE qty > 0)"""


def outcomes(trail: float | None) -> str:
    bars = "p.symbol = b.symbol AND b.i BETWEEN p.i + 1 AND p.i + 13"
    if trail:
        level = f"""CASE WHEN p.direction > 0 THEN greatest(p.stop, max(b.high - {trail} * b.atr) OVER w)
          ELSE least(p.stop, min(b.low + {trail} * b.atr) OVER w) END"""
    else:
        level = "p.stop"
    return f"""walk AS (SELECT p.symbol, p.i, p.direction, p.take_profit, b.i AS j, b.ts AS bts, b.high, b.low, b.close, {level} AS level
  FROM plans p JOIN feat b ON {bars} WINDOW w AS (PARTITION BY p.symbol, p.i ORDER BY b.i)),
marked AS (SELECT *, CASE WHEN direction > 0 AND low <= level OR direction < 0 AND high >= level THEN '{'trail' if trail else 'stop'}'
  WHEN direction > 0 AND high >= take_profit OR direction < 0 AND low <= take_profit THEN 'take' END AS why FROM walk),
firsts AS (SELECT symbol, i, min(j) FILTER (why IS NOT NULL) AS hit, max(j) AS final FROM marked GROUP BY 1, 2),
done AS MATERIALIZED (SELECT p.*, m.bts AS exit_time, m.j AS exit_index, coalesce(m.why, 'horizon') AS reason,
  CASE WHEN m.why = 'take' THEN p.take_profit WHEN m.why IS NOT NULL THEN m.level ELSE m.close END AS exit
  FROM plans p JOIN firsts f ON f.symbol = p.symbol AND f.i = p.i
  JOIN marked m ON m.symbol = p.symbol AND m.i = p.i AND m.j = coalesce(f.hit, f.final))"""


COSTED = """fills AS (SELECT *, entry * (1 + direction * 2e-4) AS fe, exit * (1 - direction * 2e-4) AS fx FROM done),
costed AS MATERIALIZED (SELECT *, direction * (fx - fe) * quantity - 2 * greatest(1.0, 0.005 * quantity) AS pnl,
  direction * (exit - entry) * quantity - (direction * (fx - fe) * quantity - 2 * greatest(1.0, 0.005 * quantity)) AS cost FROM fills)"""
PICKED = """nth AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM costed),
chain AS (SELECT symbol, k, exit_index AS busy, true AS kept FROM nth WHERE k = 1
  UNION ALL SELECT n.symbol, n.k, CASE WHEN n.i >= c.busy THEN n.exit_index ELSE c.busy END, n.i >= c.busy
  FROM chain c JOIN nth n ON n.symbol = c.symbol AND n.k = c.k + 1),
ledger AS MATERIALIZED (SELECT n.*, n.ts AS signal_ts FROM nth n JOIN chain c ON c.symbol = n.symbol AND c.k = n.k WHERE c.kept)"""
TRADED = f"{SIGNALS}, {plans()}, {outcomes(None)}, {COSTED}"
LEDGER = f"{TRADED}, {PICKED}"


def curve(by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""summed AS (SELECT *, 100000.0 + sum(pnl) OVER ({part}ORDER BY exit_time, signal_ts, symbol ROWS UNBOUNDED PRECEDING) AS equity FROM ledger),
curve AS MATERIALIZED (SELECT *, greatest(100000.0, max(equity) OVER ({part}ORDER BY exit_time, signal_ts, symbol ROWS UNBOUNDED PRECEDING)) AS peak,
  pnl / (equity - pnl) AS return_pct FROM summed),
falls AS MATERIALIZED (SELECT *, (equity - peak) / peak AS drawdown FROM curve)"""


MEASURES = """CAST(count(*) AS DOUBLE) AS n_trades, sum(pnl) / 100000.0 AS total_return,
  count(*) FILTER (return_pct > 0) / count(*) AS win_rate, avg(return_pct) AS avg_return,
  sum(return_pct) FILTER (return_pct > 0) / -sum(return_pct) FILTER (return_pct < 0) AS profit_factor,
  sqrt(252.0) * avg(return_pct) / stddev_samp(return_pct) AS sharpe, least(min(drawdown), 0.0) AS max_drawdown,
  max(return_pct) AS best_trade, min(return_pct) AS worst_trade, sum(cost) AS total_costs"""
MEASURE_NAMES = ["n_trades", "total_return", "win_rate", "avg_return", "profit_factor", "sharpe", "max_drawdown",
                 "best_trade", "worst_trade", "total_costs"]

# --- portfolio -------------------------------------------------------------------------------

CORR = """pairs AS MATERIALIZED (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, corr(a.ret_1, b.ret_1) AS correlation, count(*) AS n
  FROM wf a JOIN wf b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret_1 IS NOT NULL AND b.ret_1 IS NOT NULL GROUP BY 1, 2)"""
OPEN = """openings AS MATERIALIZED (SELECT a.symbol, a.signal_ts, any_value(a.quantity * a.entry) AS notional, any_value(a.risk_amount) AS risk_amount,
  count(b.symbol) FILTER (b.exit_time > a.signal_ts AND (b.signal_ts, b.symbol) < (a.signal_ts, a.symbol)) AS open_count,
  coalesce(sum(b.risk_amount) FILTER (b.exit_time > a.signal_ts AND (b.signal_ts, b.symbol) < (a.signal_ts, a.symbol)), 0.0) AS open_risk,
  coalesce(sum(b.pnl) FILTER (b.exit_time <= a.signal_ts AND CAST(b.exit_time AS DATE) = CAST(a.signal_ts AS DATE)), 0.0) AS realised_today,
  coalesce(bool_or(b.symbol = a.symbol AND b.exit_time > a.signal_ts AND b.signal_ts < a.signal_ts), false) AS symbol_open
  FROM ledger a CROSS JOIN ledger b GROUP BY 1, 2)"""
def breach_cte(count=4, loss="0.02", exposure="0.012", risk="0.035", tied="0.06") -> str:
    return f"""strong AS (SELECT symbol_a AS symbol, symbol_b AS partner FROM pairs WHERE abs(correlation) >= {tied}
  UNION ALL SELECT symbol_b, symbol_a FROM pairs WHERE abs(correlation) >= {tied}),
tied AS (SELECT a.symbol, a.signal_ts, first(b.symbol ORDER BY b.signal_ts, b.symbol) AS partner
  FROM ledger a JOIN strong s ON s.symbol = a.symbol JOIN ledger b ON b.symbol = s.partner
  AND b.exit_time > a.signal_ts AND (b.signal_ts, b.symbol) < (a.signal_ts, a.symbol) GROUP BY 1, 2),
breaches AS MATERIALIZED (SELECT o.symbol, o.signal_ts, CASE WHEN symbol_open THEN 'symbol already open'
  WHEN open_count >= {count} THEN 'max concurrent positions' WHEN realised_today <= -{loss} * 100000 THEN 'daily loss limit reached'
  WHEN notional > {exposure} * 100000 + 1e-6 THEN 'symbol exposure cap'
  WHEN open_risk + risk_amount > {risk} * 100000 + 1e-6 THEN 'total risk budget'
  WHEN partner IS NOT NULL THEN 'correlated with open ' || partner END AS breach
  FROM openings o LEFT JOIN tied t ON t.symbol = o.symbol AND t.signal_ts = o.signal_ts)"""


BREACH = breach_cte()
LOOSE_BREACH = breach_cte(1000, "10.0", "100.0", "10.0", "0.02")

# --- evaluation ------------------------------------------------------------------------------

PREDICTED = "predicted AS (SELECT CAST(quality + toxic AS INTEGER) AS label, CAST(doc_id % 4 AS INTEGER) AS pred, CAST(doc_id % 3 + 1 AS INTEGER) AS fold FROM labels)"
NAMES = ["down", "flat", "up"]


def report(by: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (label = {k} AND pred = {k})::DOUBLE AS tp{k}, count(*) FILTER (pred = {k} AND label BETWEEN 0 AND 2)::DOUBLE AS pp{k}, "
        f"count(*) FILTER (label = {k} AND pred BETWEEN 0 AND 2)::DOUBLE AS tt{k}" for k in range(3)
    )
    rates = ", ".join(
        f"coalesce(tp{k} / nullif(pp{k}, 0), 0.0) AS precision_{n}, coalesce(tp{k} / nullif(tt{k}, 0), 0.0) AS recall_{n}"
        for k, n in enumerate(NAMES)
    )
    f1 = ", ".join(
        f"coalesce(2 * precision_{n} * recall_{n} / nullif(precision_{n} + recall_{n}, 0), 0.0) AS f1_{n}" for n in NAMES
    )
    mean = lambda kind: "(" + " + ".join(f"{kind}_{n}" for n in NAMES) + ") / 3"
    return f"""counted AS (SELECT {by} AS g, count(*)::DOUBLE AS n, count(*) FILTER (label = pred) / count(*) AS accuracy, {counts} FROM predicted GROUP BY 1),
rated AS (SELECT *, {rates} FROM counted),
report AS (SELECT *, {f1}, {mean('recall')} AS balanced_accuracy FROM rated),
reports AS (SELECT *, {mean('f1')} AS macro_f1 FROM report)"""


REPORT_COLS = ["n", "accuracy", "balanced_accuracy", "macro_f1"] + [f"{k}_{n}" for n in NAMES for k in ("precision", "recall", "f1")]
FOLD_COLS = ", ".join(
    f"{r(f'avg({m})', m + '_mean')}, {r(f'stddev_pop({m})', m + '_std')}" for m in ("balanced_accuracy", "macro_f1", "accuracy")
)

ORACLE = {
    "flagship": q(
        B1H, FILLED, "fclose AS (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, open, high, low, close, volume, imputed FROM filled)",
        window_features("fclose", "wf"), ewm_features("wf", "feat"), bar_bars("daily", "filled", DAY, "bin + INTERVAL 1 DAY"),
        body=f"""SELECT f.symbol, f.ts, {r('f.close', 'close')}, {r('f.volume', 'volume')}, imputed, {rs('sma_20, ema_12, atr')},
        {r('d.close', 'close_1d')}, {r('d.volume', 'volume_1d')} FROM feat f ASOF LEFT JOIN daily d
        ON d.symbol = f.symbol AND d.ts <= f.ts WHERE atr IS NOT NULL""",
    ),
    "bars_1h": q(B1HC, body=f"SELECT symbol, ts, {rs(OHLC)} FROM bars"),
    "bars_4h": resampled(FOUR, "bin + INTERVAL 4 HOUR"),
    "bars_1d": resampled(DAY, "bin + INTERVAL 1 DAY"),
    "bars_1w": resampled(SUNDAY, "bin + INTERVAL 7 DAY"),
    "bars_1mo": resampled(MONTH, "bin + INTERVAL 1 MONTH"),
    "bars_7h": resampled(
        "origin + CAST(floor(date_diff('hour', origin, ts) / 7) AS INTEGER) * 7 * INTERVAL 1 HOUR", "bin + INTERVAL 7 HOUR",
        "(SELECT *, date_trunc('day', min(ts) OVER (PARTITION BY symbol)) AS origin FROM bars)",
    ),
    "bars_supplier_1d": q(SUPPLIER_BARS, body=f"SELECT symbol, ts, {rs(OHLC, 8)} FROM sbars"),
    "fill_bars": q(B1H, FILLED, body=f"SELECT symbol, ts, {rs(OHLC)}, imputed FROM filled"),
    "close_label": q(B1H, body=f"""SELECT symbol, ts, ts + INTERVAL 1 HOUR AS hour_close,
        ts + (7 - extract(dow FROM ts)) * INTERVAL 1 DAY AS week_close,
        date_trunc('month', ts) + INTERVAL 1 MONTH + (ts - date_trunc('day', ts)) AS month_close FROM bars"""),
    "canonical_bars": q(TICKS, body=f"""SELECT symbol, m AS ts, {', '.join(r('price', c) for c in ('open', 'high', 'low', 'close'))},
        {r('size', 'volume')} FROM (SELECT *, date_trunc('minute', ts) AS m,
        row_number() OVER (PARTITION BY symbol, date_trunc('minute', ts) ORDER BY ts DESC, seq DESC) AS k FROM ticks) WHERE k = 1"""),
    "validate_bars": q(B1H, body="""SELECT symbol, ts, concat_ws(',', CASE WHEN volume % 7 = 0 THEN 'open_null' END,
        CASE WHEN volume % 5 = 0 THEN 'low_negative' END) AS violations FROM bars"""),
    "returns": windowed("ret_1", "log_ret_1"),
    "sma": windowed("sma_20"),
    "ema": decayed("ema_12", "ema_26"),
    "rsi": decayed("rsi_14"),
    "macd": decayed("macd", "macd_signal", "macd_hist"),
    "atr": decayed("atr"),
    "bollinger": windowed("bb_mid", "bb_upper", "bb_lower", "bb_width"),
    "stochastic": windowed("stoch_k", "stoch_d"),
    "adx": decayed("adx", "plus_di", "minus_di"),
    "vwap": windowed("vwap_dev"),
    "obv": q(WINDOWED, body="SELECT symbol, ts, obv FROM wf"),
    "obv_z": windowed("obv_z"),
    "bar_shape": decayed("close_pos", "range_atr"),
    "indicators": decayed(*INDICATOR_COLUMNS),
    "feature_names": q(FULL, f"flagged AS (SELECT *, {', '.join(f'{PATTERN_SQL[c]} AS {c}' for c in PATTERN_COLUMNS)} FROM feat)",
                       body=" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n FROM flagged" for c in FEATURES)),
    "indicators_supplier": q(
        SUPPLIER_BARS, window_features("sbars", "swf"), SUPPLIER_EWM,
        body=f"SELECT symbol, ts, {rs(SUPPLIER_COLUMNS)}, CAST({PATTERN_SQL['cdl_doji']} AS INTEGER) AS cdl_doji FROM sfeat",
    ),
    **{"pattern_" + c.removeprefix("cdl_"): pattern(c) for c in PATTERN_COLUMNS},
    "mtf_asof": q(
        B1H, FILLED, "fclose AS (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, close FROM filled)",
        bar_bars("f4", "filled", FOUR, "bin + INTERVAL 4 HOUR"), window_features("f4", "w4"),
        bar_bars("fd", "filled", DAY, "bin + INTERVAL 1 DAY"), window_features("fd", "wd"),
        body=f"""SELECT b.symbol, b.ts, {r('b.close', 'close')}, {r('a.close', 'close_4h')}, {r('a.ret_1', 'ret_1_4h')},
        {r('a.sma_20', 'sma_20_4h')}, {r('d.close', 'close_1d')}, {r('d.ret_1', 'ret_1_1d')}, {r('d.sma_20', 'sma_20_1d')}
        FROM fclose b ASOF LEFT JOIN w4 a ON a.symbol = b.symbol AND a.ts <= b.ts
        ASOF LEFT JOIN wd d ON d.symbol = b.symbol AND d.ts <= b.ts""",
    ),
    "window_arrays": q(WINDOWED, cleaned("wf", "c", ["ret_1", "close_pos"]), body=f"""SELECT symbol, ts, 16 AS n_bars, {r('sr', 'sum_ret')},
        {r('sp', 'sum_pos')}, {r('close_pos', 'last_pos')}, {r('list_dot_product(rets, list_transform(range(1, 17), lambda k: k::DOUBLE))', 'placed_ret')}
        FROM (SELECT *, list(ret_1) OVER w AS rets, sum(ret_1) OVER w AS sr, sum(close_pos) OVER w AS sp FROM c
        WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) WHERE i >= 15"""),
    "triple_barrier": q(LABELS, body=f"SELECT symbol, ts, CAST(label AS DOUBLE) AS label, {r('ret')}, touched FROM lab"),
    "class_balance": q(LABELS, body=f"""SELECT CAST(label + 1 AS INTEGER) AS label, count(*) AS count,
        {r('(SELECT count(*) FROM lab WHERE label IS NOT NULL) / (3.0 * count(*))', 'weight')} FROM lab WHERE label IS NOT NULL GROUP BY 1"""),
    "clean_features": q(WINDOWED, cleaned("wf", "c", ["close_pos", "sma_20", "ret_1"]),
                        body=f"SELECT symbol, ts, {rs('close_pos, sma_20, ret_1')} FROM c"),
    "flat_features": q(WINDOWED, cleaned("wf", "c", ["ret_1", "close_pos"]), flat("c", "x", ["ret_1", "close_pos"], 16),
                       body=f"SELECT symbol, ts, {rs([f'{c}_{k}' for c in ('ret_1', 'close_pos') for k in ('last', 'mean', 'var')])} FROM x"),
    "window_tensors": q(
        B1H, FILLED, *[part for k in TENSOR_FRAMES for part in frame_ctes(k)], labelled("e1", "lab"), POINTED,
        body=" UNION ALL ".join(
            f"SELECT p.symbol, p.ts, p.label, '{name}' AS timeframe, CAST(v.i - p.i{k} + 15 AS INTEGER) AS bar, {', '.join(grid('v.' + c, c, 16) for c in FEATURES)} "
            f"FROM pointed p JOIN c{k} v ON v.symbol = p.symbol AND v.i BETWEEN p.i{k} - 15 AND p.i{k}" for k, name in TENSOR_FRAMES.items()
        ),
    ),
    "weekly_asof": q(
        B1H, FILLED, "fclose AS (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, close FROM filled)",
        bar_bars("fw", "filled", SUNDAY, "bin + INTERVAL 7 DAY"), bar_bars("f4", "filled", FOUR, "bin + INTERVAL 4 HOUR"),
        "gapped AS (SELECT * FROM f4 WHERE dayofyear(ts) % 3 = 0)",
        body=f"""SELECT b.symbol, b.ts, {r('b.close', 'close')}, {r('w.close', 'close_1w')}, {r('w.volume', 'volume_1w')}, {r('g.high', 'high_gap')}
        FROM fclose b ASOF LEFT JOIN fw w ON w.symbol = b.symbol AND w.ts <= b.ts ASOF LEFT JOIN gapped g ON g.symbol = b.symbol AND g.ts <= b.ts""",
    ),
    "build_samples": q(SAMPLES, body=f"SELECT symbol, ts, label, {grid('ret', 'ret', 16)}, {', '.join(grid(c, c, 16) for c in MODEL_COLS)} FROM samples"),
    "scaler_stats": q(ALL_STATS, body=f"SELECT feature, {rs('mean, std')} FROM stats"),
    "scaled_features": q(ALL_STATS, body=f"SELECT symbol, ts, {', '.join(scaled(c) for c in MODEL_COLS)} FROM samples"),
    "temporal_split": q(B1HC, RANKED, body="SELECT symbol, ts, rank, CASE WHEN rank < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS role FROM ranked"),
    "walk_forward_folds": folds(4, True),
    "walk_forward_rolling": folds(3, False),
    "upsert_bars": q(B1H, MERGED, body=f"SELECT {BAR_COLS} FROM merged"),
    "upsert_report": q(B1H, MERGED, body="""SELECT symbol, timeframe, count(*) FILTER (change = 'inserted') AS inserted,
        count(*) FILTER (change = 'updated') AS updated, count(*) AS total FROM merged GROUP BY 1, 2"""),
    "merge_bars": q(B1H, MERGED, body=f"SELECT {BAR_COLS}, change FROM merged"),
    "upsert_news": q(NEWS, body=f"""SELECT ts, symbol, headline, length(body) AS n_body, md5(body) AS body_md5,
        CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN source || '+' ELSE source END AS source, url FROM {LAST_NEWS.format('news')}"""),
    "range_read": q(B1H, body=f"""SELECT symbol, ts, {rs('close, volume')} FROM bars WHERE symbol IN ('click', 'view')
        AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'"""),
    "news_range_read": q(NEWS, body=f"""SELECT ts, symbol, source, length(body) AS n_body, md5(body) AS body_md5 FROM {LAST_NEWS.format('news')}
        AND symbol = 'error' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'"""),
    "series_coverage": q(B1H, body="SELECT symbol, '1h' AS timeframe, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_rows FROM bars GROUP BY 1"),
    "news_coverage": q(NEWS, body=f"SELECT symbol, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_rows FROM {LAST_NEWS.format('news')} GROUP BY 1"),
    "empty_series": q(B1H, body=f"SELECT symbol, '1h' AS timeframe, ts, {OHLC} FROM bars WHERE symbol = 'nosuch'"),
    "list_symbols": "SELECT DISTINCT event_type AS symbol FROM events",
    "base_bars": q(B1H, body=f"SELECT symbol, ts, {rs(OHLC)} FROM bars WHERE symbol IN ('click', 'purchase')"),
    "chunk_plan": q(PLAN, body="""SELECT symbol, timeframe, k AS chunk, start + k * INTERVAL 7 DAY AS lo,
        least(start + (k + 1) * INTERVAL 7 DAY, "end") AS hi FROM plan, range(0, 100) AS t(k) WHERE start + k * INTERVAL 7 DAY < "end" """),
    "resume_plan": q(B1H, PLAN, RESUMED, body='SELECT symbol, timeframe, start, "end" FROM resumed'),
    "load_report": q(B1H, PLAN, body="""SELECT p.symbol, p.timeframe, any_value(start) AS start, any_value("end") AS "end",
        CAST(ceil(date_diff('hour', any_value(start), any_value("end")) / 48) AS BIGINT) AS chunks, count(b.ts) AS rows,
        count(DISTINCT date_diff('hour', start, b.ts) // 48) AS filled_chunks FROM plan p
        LEFT JOIN bars b ON b.symbol = p.symbol AND p.timeframe = '1h' AND b.ts >= start AND b.ts < "end" GROUP BY 1, 2"""),
    "load_bars": q(B1H, body=f"""SELECT symbol, '1h' AS timeframe, ts, {rs(OHLC)} FROM bars
        WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-28'"""),
    "load_news": q(NEWS, body=f"""SELECT a.symbol, TIMESTAMP '2024-01-07' AS start, TIMESTAMP '2024-01-28' AS "end", CAST(3 AS BIGINT) AS chunks,
        (SELECT count(*) FROM news n WHERE n.symbol = a.symbol AND n.ts >= TIMESTAMP '2024-01-07' AND n.ts < TIMESTAMP '2024-01-28') AS rows,
        (SELECT count(DISTINCT date_diff('minute', TIMESTAMP '2024-01-07', n.ts) // 10080) FROM news n WHERE n.symbol = a.symbol
          AND n.ts >= TIMESTAMP '2024-01-07' AND n.ts < TIMESTAMP '2024-01-28') AS filled_chunks,
        a.c AS inserted, CAST(0 AS BIGINT) AS updated, a.c AS total, CAST(0 AS BIGINT) AS rejected, '' AS error FROM (SELECT symbol, count(*) AS c FROM {LAST_NEWS.format('news')}
        AND ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-28' GROUP BY 1) a"""),
    "load_news_rows": q(NEWS, body=f"""SELECT ts, symbol, headline, md5(body) AS body_md5, source, url FROM {LAST_NEWS.format('news')}
        AND ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-28'"""),
    "news_canonical": q(NEWS, body="""SELECT ts, symbol, headline, CASE WHEN body = headline THEN 0 ELSE length(body) END AS n_body,
        md5(CASE WHEN body = headline THEN '' ELSE body END) AS body_md5,
        CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS source, '' AS url FROM news"""),
    "news_csv": q(NEWS, body="SELECT ts, symbol, headline, length(body) AS n_body, md5(body) AS body_md5, source, '' AS url FROM news"),
    "news_json": q(NEWS, body="""SELECT ts, symbol, headline, CASE WHEN doc_id % 2 = 1 THEN body ELSE '' END AS body, source,
        'https://example.org/' || doc_id AS url FROM news WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND headline <> ''"""),
    "news_slice": q(NEWS, body="""SELECT ts, symbol, headline, source FROM news WHERE symbol = 'signup'
        AND ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-11'"""),
    "keyword_catalysts": q(TAGS, body=f"SELECT doc_id, ts, symbol, catalyst, {rs('strength, confidence')}, source FROM tagged"),
    "keyword_default": q(NEWS, tagged(KEYWORDS), body=f"SELECT doc_id, catalyst, {rs('strength, confidence')} FROM tagged"),
    "scored_catalysts": q(NEWS, SCORED, body="""SELECT doc_id, symbol, CASE WHEN kept THEN named ELSE 'none' END AS catalyst,
        CASE WHEN kept THEN round(least(1.0, raw), 4) ELSE 0.0 END::DOUBLE AS strength,
        CASE WHEN kept THEN round(conf, 4) ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN kept THEN mood END AS sentiment FROM judged"""),
    "catalyst_report": q(TAGS, body=f"""SELECT ts, symbol, catalyst, {rs('strength, confidence')}, source, headline FROM tagged
        WHERE catalyst <> 'none' AND symbol IN ('click', 'error', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"""),
    "catalyst_counts": q(TAGS, body="SELECT symbol, catalyst, count(*) AS tagged, count(*) FILTER (catalyst <> 'none') AS actionable FROM tagged GROUP BY 1, 2"),
    "catalyst_boost": q(SIGNALS, TAGS, BOOSTED, body=f"SELECT symbol, ts, {r('catalyst_boost')} FROM boosted"),
    "model_text": q(NEWS, body="""SELECT doc_id, md5(CASE WHEN trim(coalesce(body, ''), ' ') <> '' THEN headline || '. ' || trim(body, ' ')
        ELSE headline END) AS text_md5 FROM news"""),
    "fused_meta": q(SIGNALS, TAGS, BOOSTED, body=f"""SELECT symbol, ts, 'trend' AS kind, CASE WHEN catalyst_boost > 0 THEN round(catalyst_boost, 6)
        ELSE -1.0 END AS noted_boost FROM boosted WHERE direction <> 0 AND least(1.0, probability + catalyst_boost) >= 0.55"""),
    "fused_signals": q(SIGNALS, TAGS, BOOSTED, body=f"""SELECT symbol, ts, direction, {r('least(1.0, probability + catalyst_boost)', 'probability')},
        horizon, {r('catalyst_boost')} FROM boosted WHERE direction <> 0 AND least(1.0, probability + catalyst_boost) >= 0.55"""),
    **{name: q(SIGNALS, plans(method), body=f"""SELECT symbol, ts, direction, {rs('probability, entry, stop, take_profit')}, quantity,
        {r('risk_amount')}, 2.0::DOUBLE AS rr_ratio, '{method}' AS method FROM plans""")
       for name, method in (("trade_plan_fixed", "fixed_fractional"), ("trade_plan_kelly", "kelly"), ("trade_plan_vol", "vol_target"))},
    **{name: q(SIGNALS, plans(), outcomes(trail), body=f"""SELECT symbol, ts, direction, entry_time, {r('entry')}, exit_time,
        {r('exit')}, reason FROM done""") for name, trail in (("trade_outcome", None), ("trade_outcome_trailing", 0.8))},
    "trade_costs": q(TRADED, body=f"SELECT symbol, ts, direction, quantity, {rs('pnl, cost')} FROM costed"),
    "single_position": q(LEDGER, body="SELECT symbol, ts, direction, entry_time, exit_time, reason FROM ledger"),
    "trade_ledger": q(LEDGER, body=f"""SELECT symbol, direction, signal_ts, entry_time, exit_time, {rs('entry, exit')}, quantity, {r('pnl')},
        {r('pnl / 100000.0', 'return_pct')}, reason, {rs('cost, risk_amount')} FROM ledger"""),
    "equity_curve": q(LEDGER, curve(), body=f"SELECT symbol, signal_ts, exit_time, {rs('pnl, equity, peak, return_pct, drawdown')} FROM falls"),
    "trade_metrics": q(LEDGER, curve(), f"measured AS (SELECT {MEASURES} FROM falls)", body=f"SELECT {rs(MEASURE_NAMES)} FROM measured"),
    "metrics_rows": q(LEDGER, curve(), f"measured AS (SELECT {MEASURES} FROM falls)",
                      body=" UNION ALL ".join(f"SELECT '{m}' AS metric, {r(m, 'value')} FROM measured" for m in MEASURE_NAMES)),
    "metrics_by_symbol": q(LEDGER, curve("symbol"), f"measured AS (SELECT symbol, {MEASURES} FROM falls GROUP BY symbol)",
                           body=f"SELECT symbol, {rs(MEASURE_NAMES)} FROM measured"),
    "return_correlation": q(WINDOWED, CORR, body=f"SELECT symbol_a, symbol_b, {r('correlation')}, n FROM pairs"),
    "return_correlation_suppliers": q(
        SUPPLIER_BARS, window_features("sbars", "wf"), CORR,
        body=f"SELECT symbol_a, symbol_b, {r('correlation')}, n FROM pairs",
    ),
    "correlation_lookup": q(WINDOWED, CORR, body=f"""SELECT a.s AS symbol_a, b.s AS symbol_b, round(CASE WHEN a.s = b.s THEN 1.0
        ELSE coalesce((SELECT correlation FROM pairs WHERE symbol_a = least(a.s, b.s) AND symbol_b = greatest(a.s, b.s)), 0.0) END, 6) + 0.0 AS correlation
        FROM (SELECT DISTINCT event_type AS s FROM events) a, (SELECT unnest({SYMBOL_LIST[:-1]}, 'nosuch']) AS s) b"""),
    "open_state": q(LEDGER, OPEN, body=f"""SELECT symbol, signal_ts, open_count, {rs('open_risk, realised_today', 2)}, symbol_open FROM openings"""),
    "limit_breaches": q(LEDGER, CORR, OPEN, BREACH, body="SELECT symbol, signal_ts, breach FROM breaches"),
    "limit_breaches_correlated": q(LEDGER, CORR, OPEN, LOOSE_BREACH, body="SELECT symbol, signal_ts, breach FROM breaches"),
    "breach_counts": q(LEDGER, CORR, OPEN, BREACH, body="SELECT breach, count(*) AS trades FROM breaches WHERE breach IS NOT NULL GROUP BY 1"),
    "daily_pnl": q(LEDGER, body=f"""SELECT symbol, signal_ts, exit_time, CAST(exit_time AS DATE) AS day, {r('''sum(pnl) OVER (PARTITION BY
        CAST(exit_time AS DATE) ORDER BY exit_time, signal_ts, symbol ROWS UNBOUNDED PRECEDING)''', 'day_pnl')} FROM ledger"""),
    "confusion": q(PREDICTED, body="""SELECT CAST(t AS INTEGER) AS label, CAST(p AS INTEGER) AS pred,
        (SELECT count(*) FROM predicted x WHERE x.label = t AND x.pred = p) AS count FROM range(0, 3) AS a(t), range(0, 3) AS b(p)"""),
    "class_report": q(PREDICTED, report("1"), body=f"SELECT {rs(REPORT_COLS)} FROM reports"),
    "fold_summary": q(PREDICTED, report("fold"), body=f"SELECT count(*)::DOUBLE AS n_folds, {FOLD_COLS} FROM reports"),
    "baseline_fit_score": q(SAMPLES, SAMPLE_RANKED, body=MODEL_ROWS.replace("FROM ranked", ", TRUE AS learned FROM ranked")),
    "ensemble_score": q(SAMPLES, SAMPLE_RANKED, body=MODEL_ROWS.replace("FROM ranked", ", TRUE AS weighted, TRUE AS reloaded, TRUE AS learned FROM ranked")),
    "walk_forward": q(SAMPLES, SAMPLE_RANKED, body=f"""SELECT fold, count(*) FILTER (role = 'train') AS n_train,
        count(*) FILTER (role = 'val') AS n_val, TRUE AS in_range FROM ({fold_rows(4, True)}) GROUP BY fold"""),
    "walk_forward_fixed": q(SAMPLES, BLOCKED, UNROLLED, ONE_SETTING, NEAREST, report("fold"), body=f"""SELECT CAST(g AS INTEGER) AS fold,
        (SELECT count(*) FROM blocked WHERE block < g) AS n_train, {rs(REPORT_COLS)} FROM reports"""),
    "param_search": q(SEARCHED, report("part"), """scores AS (SELECT g[1] AS setting, avg(balanced_accuracy) AS fixed_score FROM reports GROUP BY 1),
        sized AS (SELECT setting, count(*) AS n_samples, count(*) FILTER (label = 0) AS n_down, count(*) FILTER (label = 1) AS n_flat,
        count(*) FILTER (label = 2) AS n_up FROM marks GROUP BY 1),
        placed AS (SELECT *, row_number() OVER (ORDER BY fixed_score DESC, setting) <= 5 AS advanced FROM scores)""",
        body=f"""SELECT CAST(setting AS INTEGER) AS trial, {r('take', 'take_profit_atr')}, {r('stop', 'stop_loss_atr')}, n_samples, n_down, n_flat, n_up,
        {r('fixed_score')}, advanced, advanced AS scored FROM trials JOIN sized USING (setting) JOIN placed USING (setting)"""),
    "average_probs": q("""members AS (SELECT doc_id, [0.5, 0.3, 0.2] AS a, CASE WHEN quality = 1 THEN [0.1, 0.2, 0.7] ELSE [0.0, 0.9, 0.1] END AS b FROM labels),
        mixed AS (SELECT doc_id, list_transform([1, 2, 3], lambda k: 0.25 * a[k]::DOUBLE + 0.75 * b[k]::DOUBLE) AS p FROM members),
        topped AS (SELECT doc_id, p, CAST(list_position(p, list_max(p)) AS INTEGER) - 1 AS pred FROM mixed)""",
        body="""SELECT 'D' || doc_id AS symbol, pred - 1 AS direction, round(list_max(p), 6) AS probability, CAST(12 AS INTEGER) AS horizon FROM topped
        WHERE list_max(p) >= 0.6"""),
    "stream_bars": q(B1HC, body=f"SELECT symbol, ts, {rs(OHLC)} FROM bars"),
    "stream_dedup": q(NEWS, body="SELECT DISTINCT ts, symbol, headline FROM news"),
    "stream_catalysts": q(TAGS, body=f"SELECT doc_id, symbol, catalyst, {rs('strength, confidence')} FROM tagged"),
    "stream_boost": q(SIGNALS, TAGS, BOOSTED, body=f"SELECT symbol, ts, {r('catalyst_boost')} FROM boosted"),
    "stream_load": q(B1H, MERGED, body=f"SELECT {BAR_COLS} FROM merged"),
}
