"""The registry of runnable queries over the test tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave import schemas
from tapeweave.functions import text
from tapeweave.functions.costs import STANDARD_COSTS, apply_costs
from tapeweave.functions.sizing import Sizing, size_positions
from tapeweave.operators import catalysts as cat
from tapeweave.operators import evaluation, fusion, metrics, models, portfolio, samples, tensors, trades
from tapeweave.operators.asof import asof_join
from tapeweave.operators.bars import close_labeled, fill_missing_bars, resample_bars
from tapeweave.operators.indicators import FEATURE_COLUMNS, INDICATOR_COLUMNS, add_indicators, add_obv, feature_columns
from tapeweave.operators.labels import triple_barrier_labels
from tapeweave.operators.patterns import PATTERN_COLUMNS
from tapeweave.operators.series import INDEX
from tapeweave.plans import fixtures as fx
from tapeweave.session import drop_path, materialize, shared_dir, stage
from tapeweave.sources import loads
from tapeweave.sources.news import news_from_json, news_slice, read_news_csv
from tapeweave.sources.tables import BarTable, NewsTable, merge_upsert, range_filter
from tapeweave.streaming import jobs


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero: results are compared across engines."""
    fix = lambda f: (F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
    return df.select(*[fix(f) for f in df.schema.fields])


def gridded(df: DataFrame, bits: int) -> DataFrame:
    """Doubles to the nearest multiple of ``2 ** -bits``. Averages of prices in cents often lie halfway between two
    decimal roundings, where the last bit decides; they never lie halfway between two binary ones."""
    step = float(2**bits)
    fix = lambda f: (F.round(F.col(f.name) * step) / step + 0.0).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
    return df.select(*[fix(f) for f in df.schema.fields])


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/runs/{name}-{uuid.uuid4().hex}"


# --- bars ------------------------------------------------------------------------------------


def _resampled(timeframe):
    return lambda spark, sf: rounded(resample_bars(fx.bars_1h(spark, sf), timeframe))


def fill_bars(spark, sf):
    return rounded(fill_missing_bars(fx.bars_1h(spark, sf), "1h"))


def close_label(spark, sf):
    """The same hourly bars labelled as if they were hours, weeks and months."""
    from tapeweave.functions.timeframes import Timeframe

    return fx.bars_1h(spark, sf).select(
        "symbol", "ts", *[Timeframe(tf).close_label(F.col("ts")).alias(n) for tf, n in
                          (("1h", "hour_close"), ("1w", "week_close"), ("1M", "month_close"))]
    )


def canonical_bars(spark, sf):
    """Ticks as provider rows, in mixed case and with repeated minutes; the last one stays."""
    t = fx.ticks(spark, sf)
    raw = t.select(
        F.col("symbol").alias("Symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("DateTime"),
        *[F.col("price").cast("string").alias(c) for c in ("Open", "High", "Low", "Close")],
        F.col("size").cast("string").alias("VOLUME"), "seq",
    )
    return rounded(schemas.canonical_bars(raw, ["symbol"], "seq"))


def validate_bars(spark, sf):
    b = fx.bars_1h(spark, sf)
    spoiled = b.withColumns({
        "open": F.when(F.col("volume") % 7 == 0, None).otherwise(F.col("open")),
        "low": F.when(F.col("volume") % 5 == 0, -F.col("low")).otherwise(F.col("low")),
    })
    return schemas.validate_bars(spoiled).select(
        "symbol", "ts", F.concat_ws(",", "violations").alias("violations")
    )


# --- indicators ------------------------------------------------------------------------------


def _indicators(*columns):
    return lambda spark, sf: rounded(
        add_indicators(fx.hourly_closed(spark, sf), "1h", list(columns)).select("symbol", "ts", *columns)
    )


def obv(spark, sf):
    return add_obv(fx.hourly_closed(spark, sf), "1h").select("symbol", "ts", "obv")


def feature_names(spark, sf):
    """The model inputs of a feature frame, each with the number of its values."""
    f = add_indicators(fx.hourly_closed(spark, sf), "1h")
    names = feature_columns(f)
    counts = f.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "n")


def indicators_supplier(spark, sf):
    """Trend and volatility of the daily bars of every supplier."""
    cols = ["ret_1", "sma_20", "bb_width", "ema_12", "atr", "stoch_k", "cdl_doji"]
    return rounded(add_indicators(fx.daily_closed(spark, sf), "1d", cols).select("symbol", "ts", *cols))


# --- point in time ---------------------------------------------------------------------------


def mtf_asof(spark, sf):
    """Hourly closes with the last closed 4-hour and daily bar."""
    base = materialize(fill_missing_bars(fx.bars_1h(spark, sf), "1h"))
    left = close_labeled(base, "1h").select("symbol", "ts", "close")
    rights = {
        tf: add_indicators(resample_bars(base, tf), tf, ["ret_1", "sma_20"]).select("symbol", "ts", "close", "ret_1", "sma_20")
        for tf in ("4h", "1d")
    }
    return rounded(asof_join(left, rights))


def window_arrays(spark, sf):
    """The last 16 bars as an array, shown by its shape, sums, and a sum weighted by place."""
    f = add_indicators(fx.hourly_closed(spark, sf), "1h", ["ret_1", "close_pos"])
    clean = samples.clean_features(f, ["ret_1", "close_pos"], "1h")
    arrays = samples.window_arrays(clean, ["ret_1", "close_pos"], 16)
    total = lambda k: F.aggregate("window", F.lit(0.0), lambda acc, row: acc + F.get(row, F.lit(k)))
    return rounded(arrays.select(
        "symbol", "ts", F.size("window").alias("n_bars"), total(0).alias("sum_ret"), total(1).alias("sum_pos"),
        F.element_at(F.element_at("window", -1), 2).alias("last_pos"),
        F.aggregate(F.transform("window", lambda row, i: (i + 1) * F.get(row, F.lit(0))), F.lit(0.0), lambda a, b: a + b).alias("placed_ret"),
    ))


# --- labels and samples ----------------------------------------------------------------------

#: Four timeframes over which 30 days of hourly bars hold the default window of 64 bars.
FRAMES = ["1h", "2h", "4h", "8h"]


def triple_barrier(spark, sf):
    out = triple_barrier_labels(fx.hourly_closed(spark, sf), "1h", 12)
    return rounded(out.select("symbol", "ts", F.col("label").cast("double").alias("label"), "ret", "touched"))


def class_balance(spark, sf):
    out = triple_barrier_labels(fx.hourly_closed(spark, sf), "1h", 12).filter("label is not null")
    return rounded(samples.class_weights(out.withColumn("label", F.col("label") + 1)))


def clean_features(spark, sf):
    f = add_indicators(fx.hourly_closed(spark, sf), "1h", ["close_pos", "sma_20", "ret_1"])
    return rounded(samples.clean_features(f, ["close_pos", "sma_20", "ret_1"], "1h").select("symbol", "ts", "close_pos", "sma_20", "ret_1"))


def flat_features(spark, sf):
    f = add_indicators(fx.hourly_closed(spark, sf), "1h", ["ret_1", "close_pos"])
    clean = samples.clean_features(f, ["ret_1", "close_pos"], "1h")
    return rounded(samples.flat_features(clean, ["ret_1", "close_pos"], 16))


def _samples(spark, sf) -> DataFrame:
    """Samples of all features, with the default window and horizon."""
    return samples.build_samples(fx.hourly(spark, sf), "1h", FRAMES)


def build_samples(spark, sf):
    return gridded(_samples(spark, sf).select("symbol", "ts", "label", "ret", *samples.model_columns(FEATURE_COLUMNS, FRAMES)), 16)


def scaler_stats(spark, sf):
    return rounded(samples.scaler_stats(_samples(spark, sf), FEATURE_COLUMNS))


def scaled_features(spark, sf):
    s = _samples(spark, sf)
    out = samples.apply_scaler(s, samples.scaler_stats(s, FEATURE_COLUMNS), FEATURE_COLUMNS)
    return gridded(out.select("symbol", "ts", *samples.model_columns(FEATURE_COLUMNS, FRAMES)), 12)


def window_tensors(spark, sf):
    """Every cell of every sample's windows on four timeframes: a row per sample, timeframe and bar, a column per feature."""
    frames = ["1h", "2h", "4h", "1d"]
    built = tensors.build_tensors(fx.hourly(spark, sf), "1h", frames, window=16)
    stacked = F.array(*[F.struct(F.lit(tf).alias("timeframe"), F.col(f"window_{tf}").alias("cells")) for tf in frames])
    bars = built.select("symbol", "ts", "label", F.explode(stacked).alias("w")).select("symbol", "ts", "label", "w.timeframe", F.posexplode("w.cells").alias("bar", "x"))
    return gridded(bars.select("symbol", "ts", "label", "timeframe", "bar", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(FEATURE_COLUMNS)]), 16)


def weekly_asof(spark, sf):
    """Hourly closes with the last closed weekly bar, and with the last 4-hour bar of a series that misses two days in three."""
    base = materialize(fill_missing_bars(fx.bars_1h(spark, sf), "1h"))
    left = close_labeled(base, "1h").select("symbol", "ts", "close")
    gapped = resample_bars(base, "4h").filter(F.dayofyear("ts") % 3 == 0)
    return rounded(asof_join(left, {"1w": resample_bars(base, "1w").select("symbol", "ts", "close", "volume"), "gap": gapped.select("symbol", "ts", "high")}))


def temporal_split(spark, sf):
    return samples.temporal_split(fx.hourly_closed(spark, sf).select("symbol", "ts"), 0.2)


def walk_forward_folds(spark, sf):
    return samples.walk_forward_folds(fx.hourly_closed(spark, sf).select("symbol", "ts"), 4)


def walk_forward_rolling(spark, sf):
    return samples.walk_forward_folds(fx.hourly_closed(spark, sf).select("symbol", "ts"), 3, expanding=False)


# --- stored tables and loads -----------------------------------------------------------------

JAN = lambda d: datetime(2024, 1, d)


def _bar_rows(spark, sf):
    return fx.bars_1h(spark, sf).withColumn("timeframe", F.lit("1h"))


def _early_and_late(rows):
    """Rows before the 20th, and changed rows from the 10th on."""
    early = range_filter(rows, None, JAN(20))
    late = range_filter(rows, JAN(10), None).withColumn("close", F.col("close") + 1)
    return early, late


def upsert_bars(spark, sf):
    early, late = _early_and_late(_bar_rows(spark, sf))
    store = BarTable(spark, scratch(spark, "bars"))
    store.upsert(early)
    store.upsert(late)
    return rounded(store.read())


def upsert_report(spark, sf):
    early, late = _early_and_late(_bar_rows(spark, sf))
    store = BarTable(spark, scratch(spark, "bars"))
    store.upsert(early)
    return store.upsert(late)


def merge_bars(spark, sf):
    early, late = _early_and_late(_bar_rows(spark, sf))
    return rounded(merge_upsert(early, late, ["symbol", "timeframe", "ts"]))


def _news_rows(spark, sf):
    return fx.news(spark, sf).select("ts", "symbol", "headline", "body", "source", "url", F.col("doc_id").alias("arrival"))


def upsert_news(spark, sf):
    store = NewsTable(spark, scratch(spark, "news"))
    rows = _news_rows(spark, sf)
    store.upsert(rows.filter(F.col("ts") < F.lit(JAN(20)).cast("timestamp_ntz")))
    late = rows.filter(F.col("ts") >= F.lit(JAN(10)).cast("timestamp_ntz")).withColumn("source", F.concat("source", F.lit("+")))
    store.upsert(late)
    return store.read().select("ts", "symbol", "headline", F.length("body").cast("long").alias("n_body"), F.md5("body").alias("body_md5"), "source", "url")


def _stored_bars(spark, sf) -> BarTable:
    store = BarTable(spark, scratch(spark, "bars"))
    store.upsert(_bar_rows(spark, sf))
    return store


def range_read(spark, sf):
    return rounded(_stored_bars(spark, sf).read(["click", "view"], "1h", JAN(5), JAN(9), ["close", "volume"], ordered=True))


def news_range_read(spark, sf):
    store = NewsTable(spark, scratch(spark, "news"))
    store.upsert(_news_rows(spark, sf))
    return store.read(["error"], JAN(3), JAN(25), ordered=True).select("ts", "symbol", "source", F.length("body").cast("long").alias("n_body"), F.md5("body").alias("body_md5"))


def series_coverage(spark, sf):
    return _stored_bars(spark, sf).coverage()


def news_coverage(spark, sf):
    store = NewsTable(spark, scratch(spark, "news"))
    store.upsert(_news_rows(spark, sf))
    return store.coverage()


def list_symbols(spark, sf):
    return _stored_bars(spark, sf).symbols()


def base_bars(spark, sf):
    return rounded(loads.base_bars(_stored_bars(spark, sf), ["click", "purchase", "nosuch"], "1h"))


def empty_series(spark, sf):
    """A series that is not stored, as the typed empty frame."""
    return schemas.empty_bars(spark).unionByName(_stored_bars(spark, sf).read(["nosuch"]))


def _plan(spark, sf):
    end = F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    names = fx.ticks(spark, sf).select("symbol").distinct()
    return loads.series_plan(names, ["1m", "1h"], end, {"1m": "30d", "1h": "24d"})


def chunk_plan(spark, sf):
    return loads.chunk_plan(_plan(spark, sf), "1W").withColumn("chunk", F.col("chunk").cast("long"))


def _known(spark, sf):
    early, _ = _early_and_late(_bar_rows(spark, sf).filter("symbol <> 'view'"))
    return early.groupBy("symbol", "timeframe").agg(F.max("ts").alias("max_ts"))


def resume_plan(spark, sf):
    return loads.resume_plan(_plan(spark, sf), _known(spark, sf))


def load_report(spark, sf):
    return loads.load_report(_bar_rows(spark, sf), _plan(spark, sf), ["symbol", "timeframe"], "2d")


def load_bars(spark, sf):
    """A first load up to the 20th, then an incremental one; the table afterwards."""
    rows, plan = _bar_rows(spark, sf), _plan(spark, sf)
    store = BarTable(spark, scratch(spark, "bars"))
    loads.load(range_filter(rows, None, JAN(20)), plan, store)
    loads.load(rows, plan, store)
    return rounded(store.read())


def load_news(spark, sf):
    rows = _news_rows(spark, sf)
    plan = loads.series_plan(rows.select("symbol").distinct(), ["all"], F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"), {"all": "21d"}).drop("timeframe")
    store = NewsTable(spark, scratch(spark, "news"))
    return loads.load(rows, plan, store, "7d")


def load_news_rows(spark, sf):
    """The table after the load."""
    rows = _news_rows(spark, sf)
    plan = loads.series_plan(rows.select("symbol").distinct(), ["all"], F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"), {"all": "21d"}).drop("timeframe")
    store = NewsTable(spark, scratch(spark, "news"))
    loads.load(rows, plan, store, "7d")
    return store.read().select("ts", "symbol", "headline", F.md5("body").alias("body_md5"), "source", "url")


# --- news ------------------------------------------------------------------------------------


def news_canonical(spark, sf):
    n = fx.news(spark, sf).select(
        "ts", "symbol", "headline", F.nullif("body", F.col("headline")).alias("body"),
        F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("source")).alias("source"),
    )
    return schemas.canonical_news(n).select("ts", "symbol", "headline", F.length("body").cast("long").alias("n_body"), F.md5("body").alias("body_md5"), "source", "url")


def news_csv(spark, sf):
    path = scratch(spark, "csv")
    n = fx.news(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "symbol", "headline", "body", "source")
    n.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return read_news_csv(spark, path, multi_line=True).select("ts", "symbol", "headline", F.length("body").cast("long").alias("n_body"), F.md5("body").alias("body_md5"), "source", "url")


def news_json(spark, sf):
    return news_from_json(fx.payloads(spark, sf))


def news_slice_(spark, sf):
    return news_slice(fx.news(spark, sf).select("ts", "symbol", "headline", "source"), "signup", JAN(4), JAN(11))


def keyword_catalysts(spark, sf):
    return rounded(fx.catalysts(spark, sf).select("doc_id", "ts", "symbol", "catalyst", "strength", "confidence", "source"))


def keyword_default(spark, sf):
    """The default lexicon over the texts of all documents."""
    return rounded(cat.tag_keywords(fx.news(spark, sf)).select("doc_id", "catalyst", "strength", "confidence"))


def scored_catalysts(spark, sf):
    out = cat.tag_scores(fx.scored_news(spark, sf))
    return rounded(out.select("doc_id", "symbol", "catalyst", "strength", "confidence", F.col("meta")["sentiment"].alias("sentiment")))


def catalyst_report(spark, sf):
    start, end = (F.lit(JAN(d)).cast("timestamp_ntz") for d in (5, 20))
    return rounded(cat.catalyst_report(fx.news(spark, sf), start, end, ["click", "error", "view"], fx.LEXICON))


def catalyst_counts(spark, sf):
    return cat.catalyst_counts(fx.catalysts(spark, sf))


def catalyst_boost(spark, sf):
    return rounded(fusion.catalyst_boost(materialize(fx.signals(spark, sf)), fx.catalysts(spark, sf)).select("symbol", "ts", "catalyst_boost"))


def fused_signals(spark, sf):
    return rounded(fusion.fuse_signals(materialize(fx.signals(spark, sf)), fx.catalysts(spark, sf), min_prob=0.55))


def model_text(spark, sf):
    """What a text model reads of each story."""
    return fx.news(spark, sf).select("doc_id", F.md5(text.model_text()).alias("text_md5"))


def fused_meta(spark, sf):
    """Signals with notes of their own keep them beside the boost's."""
    noted = fx.signals(spark, sf).withColumn("meta", F.create_map(F.lit("kind"), F.lit("trend"), F.lit("catalyst_boost"), F.lit("-1.0")))
    fused = fusion.fuse_signals(materialize(noted), fx.catalysts(spark, sf), min_prob=0.55)
    return rounded(fused.select("symbol", "ts", F.col("meta")["kind"].alias("kind"), F.col("meta")["catalyst_boost"].cast("double").alias("noted_boost")))


# --- trades ----------------------------------------------------------------------------------


def _context(spark, sf):
    bars = fx.hourly_closed(spark, sf)
    walked = trades.trade_bars(bars, "1h")
    return walked, trades.open_context(walked, fx.signals_of(bars), 12)


def _walked(spark, sf, trail=None):
    bars, context = _context(spark, sf)
    return trades.trade_outcomes(size_positions(context), bars, 12, trail)


def _plans(method):
    def run(spark, sf):
        plans = size_positions(_context(spark, sf)[1], 100_000.0, Sizing(method=method))
        return rounded(plans.drop("bar_index", "horizon", "atr", "entry_time"))
    return run


def _outcomes(trail):
    def run(spark, sf):
        out = _walked(spark, sf, trail)
        return rounded(out.select("symbol", "ts", "direction", "entry_time", "entry", "exit_time", "exit", "reason"))
    return run


def trade_costs(spark, sf):
    out = apply_costs(_walked(spark, sf), STANDARD_COSTS)
    return rounded(out.select("symbol", "ts", "direction", "quantity", "pnl", "cost"))


def single_position(spark, sf):
    out = materialize(_walked(spark, sf))
    return rounded(trades.single_position(out, 13).select("symbol", "ts", "direction", "entry_time", "exit_time", "reason"))


def _ledger(spark, sf):
    bars = fx.hourly_closed(spark, sf)
    return materialize(trades.trade_ledger(bars, fx.signals_of(bars), "1h", costs=STANDARD_COSTS))


def trade_ledger(spark, sf):
    return rounded(_ledger(spark, sf))


def equity_curve(spark, sf):
    curve = metrics.equity_curve(_ledger(spark, sf))
    return rounded(curve.select("symbol", "signal_ts", "exit_time", "pnl", "equity", "peak", "return_pct", "drawdown"))


def trade_metrics(spark, sf):
    return rounded(metrics.trade_metrics(metrics.equity_curve(_ledger(spark, sf))))


def metrics_rows(spark, sf):
    return rounded(metrics.metrics_rows(metrics.trade_metrics(metrics.equity_curve(_ledger(spark, sf)))))


def metrics_by_symbol(spark, sf):
    curve = metrics.equity_curve(_ledger(spark, sf), by=["symbol"])
    return rounded(metrics.trade_metrics(curve, by=["symbol"]))


# --- portfolio -------------------------------------------------------------------------------

LIMITS = portfolio.Limits(
    max_concurrent_positions=4, max_total_risk_pct=0.035, max_symbol_exposure_pct=0.012,
    max_daily_loss_pct=0.02, max_correlation=0.06,
)


def _returns(spark, sf):
    return materialize(portfolio.simple_returns(fx.hourly_closed(spark, sf), "1h"))


def return_correlation(spark, sf):
    return rounded(portfolio.return_correlations(_returns(spark, sf)))


def return_correlation_suppliers(spark, sf):
    """Every pair of suppliers that traded on common days."""
    # Only closes are read, and each stored table goes when the next is written: the result is read from the packed returns.
    closes, closes_path = stage(fx.bars_1d(spark, sf, label="close").select("symbol", "ts", "close"))
    returns, returns_path = stage(portfolio.simple_returns(closes, "1d"))
    drop_path(spark, closes_path)
    found = portfolio.return_correlations(returns)
    drop_path(spark, returns_path)
    return rounded(found)


def correlation_lookup(spark, sf):
    known = portfolio.return_correlations(_returns(spark, sf))
    names = fx.ticks(spark, sf).select("symbol").distinct()
    others = F.explode(F.array(*[F.lit(s) for s in (*fx.SYMBOLS, "nosuch")]))
    pairs = names.select(F.col("symbol").alias("symbol_a"), others.alias("symbol_b"))
    return rounded(portfolio.correlation_lookup(pairs, known))


def open_state(spark, sf):
    return rounded(portfolio.open_state(_ledger(spark, sf)).select(
        "symbol", "signal_ts", "open_count", "open_risk", "realised_today", "symbol_open"
        # Whole units of 1e-8 against sums of doubles: values that end in 5 can round either way.
    ), 2)


def _breaches(spark, sf):
    known = portfolio.return_correlations(_returns(spark, sf), least=LIMITS.max_correlation)
    return portfolio.limit_breaches(_ledger(spark, sf), limits=LIMITS, correlations=known)


def limit_breaches(spark, sf):
    return _breaches(spark, sf).select("symbol", "signal_ts", "breach")


def limit_breaches_correlated(spark, sf):
    """The other limits wide open, so that the correlation decides."""
    loose = portfolio.Limits(
        max_concurrent_positions=1000, max_total_risk_pct=10.0, max_symbol_exposure_pct=100.0, max_daily_loss_pct=10.0, max_correlation=0.02,
    )
    known = portfolio.return_correlations(_returns(spark, sf), least=loose.max_correlation)
    return portfolio.limit_breaches(_ledger(spark, sf), limits=loose, correlations=known).select("symbol", "signal_ts", "breach")


def breach_counts(spark, sf):
    return portfolio.breach_counts(_breaches(spark, sf))


def daily_pnl(spark, sf):
    return rounded(portfolio.daily_pnl(_ledger(spark, sf)).select("symbol", "signal_ts", "exit_time", "day", "day_pnl"))


# --- evaluation and models -------------------------------------------------------------------


def confusion(spark, sf):
    return evaluation.confusion_matrix(fx.predictions(spark, sf))


def class_report(spark, sf):
    return rounded(evaluation.classification_report(fx.predictions(spark, sf)))


def fold_summary(spark, sf):
    reports = evaluation.classification_report(fx.predictions(spark, sf), by=["fold"])
    return rounded(evaluation.fold_summary(reports))


def baseline_fit_score(spark, sf):
    """Trees fitted on the earlier samples, scoring the later ones."""
    s = materialize(samples.temporal_split(_samples(spark, sf), 0.2))
    train = s.filter("role = 'train'")
    model = models.fit_trees(train, FEATURE_COLUMNS)
    return _scored(models.score(model, s.filter("role = 'val'")), _learned(models.score(model, train)))


def _learned(scored: DataFrame):
    """Whether the training rows were learned: a guess would be right for a third of each class."""
    return F.lit(evaluation.classification_report(scored).first()["balanced_accuracy"] > 0.6).alias("learned")


def _scored(scored: DataFrame, *more) -> DataFrame:
    """What holds of every scored row, whatever the model."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, b: a + b)
    return scored.select(
        "symbol", "ts", "label", F.size("probs").alias("classes"), F.round(total, 6).alias("total"),
        (F.get("probs", F.col("pred")) == F.array_max("probs")).alias("likeliest"), *more,
    )


def ensemble_score(spark, sf):
    s = materialize(samples.temporal_split(_samples(spark, sf), 0.2))
    train = s.filter("role = 'train'")
    both = models.fit_ensemble(train, FEATURE_COLUMNS, 0.5)
    path = scratch(spark, "model")
    models.save_ensemble(spark, both, path)
    loaded, late = models.load_ensemble(spark, path), s.filter("role = 'val'")
    members = models.member_probs(both, late).select("symbol", "ts", "regression", "trees")
    again = models.member_probs(loaded, late).select("symbol", "ts", F.col("regression").alias("r2"), F.col("trees").alias("t2"))
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < 1e-9), lambda x: x)
    rows = models.score_ensemble(both, late).join(members, ["symbol", "ts"]).join(again, ["symbol", "ts"])
    half = F.zip_with("regression", "trees", lambda a, b: (a + b) / 2)
    same = (near("probs", half).alias("weighted"), (near("regression", "r2") & near("trees", "t2")).alias("reloaded"))
    return _scored(rows, *same, _learned(models.score_ensemble(both, train)))


def average_probs(spark, sf):
    """Member probabilities made from the labels, averaged, and turned into signals."""
    three = lambda *p: F.array(*[F.lit(x) for x in p])
    labels = fx.table(spark, sf, "labels").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("symbol"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "quality"
    )
    first = labels.select("symbol", "ts", three(0.5, 0.3, 0.2).alias("probs"))
    second = labels.select("symbol", "ts", F.when(F.col("quality") == 1, three(0.1, 0.2, 0.7)).otherwise(three(0.0, 0.9, 0.1)).alias("probs"))
    return rounded(models.to_signals(models.average_probs(first, second, 0.25), min_prob=0.6).drop("ts", "probs"))


def walk_forward(spark, sf):
    """Forests on all folds: their sizes, and that every measure is one."""
    reports = models.walk_forward_reports(_samples(spark, sf), FEATURE_COLUMNS)
    measures = [c for c in reports.columns if c not in ("fold", "n_train", "n")]
    held = F.forall(F.array(*[F.col(c).between(0.0, 1.0) for c in measures]), lambda x: x)
    return reports.select("fold", "n_train", F.col("n").cast("bigint").alias("n_val"), held.alias("in_range"))


def walk_forward_fixed(spark, sf):
    """Every column of the folds' reports, by a model that SQL can state: the nearest class mean."""
    return rounded(models.centroid_reports(_samples(spark, sf), FEATURE_COLUMNS).drop("setting"))


def param_search(spark, sf):
    """All trials on all folds; which of them went on to forests follows from the scores that SQL can state."""
    found = models.search_params(fx.hourly(spark, sf), "1h", FRAMES)
    return rounded(found.select(
        "trial", "take_profit_atr", "stop_loss_atr", "n_samples", "n_down", "n_flat", "n_up", "fixed_score", (F.col("rung") > 0).alias("advanced"),
        F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)).alias("scored"),
    ))


# --- streams ---------------------------------------------------------------------------------

LATE = "2100-01-01 00:00:00"


# Values of the far-future row that closes a stream; other columns are NULL.
CLOSING = {"ts": LATE, "symbol": "END", "catalyst": "earnings", "strength": 1.0, "confidence": 1.0}


def _staged(spark, df: DataFrame, name: str) -> DataFrame:
    """The rows as a file stream, closed by one far-future row that lets every window end."""
    path = scratch(spark, name)
    closing = spark.range(1).select(*[F.lit(CLOSING.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    df.write.parquet(path)
    closing.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(spark, stream: DataFrame, name: str) -> DataFrame:
    """The stream's appended output, run until its input is consumed."""
    out, ck = scratch(spark, name), scratch(spark, "ck")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _wall(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).filter(F.col("ts") < F.lit(LATE).cast("timestamp_ntz"))


def stream_bars(spark, sf):
    ticks = _staged(spark, fx.ticks(spark, sf), "ticks")
    return rounded(_wall(_run(spark, jobs.bars_stream(ticks, "1 hour"), "bars")))


def stream_dedup(spark, sf):
    """Each story staged twice comes out once."""
    n = fx.news(spark, sf).select("ts", "symbol", "headline", "source")
    twice = n.unionByName(n)
    source = _staged(spark, twice, "news")
    return _wall(_run(spark, jobs.dedup_stream(source, "40 days"), "dedup")).select("ts", "symbol", "headline")


def stream_catalysts(spark, sf):
    source = _staged(spark, fx.news(spark, sf), "news")
    out = _wall(_run(spark, jobs.catalyst_stream(source, lexicon=fx.LEXICON), "tags"))
    return rounded(out.select("doc_id", "symbol", "catalyst", "strength", "confidence"))


def stream_boost(spark, sf):
    signals = _staged(spark, materialize(fx.signals(spark, sf)), "signals")
    tagged = cat.actionable_catalysts(fx.catalysts(spark, sf)).select("ts", "symbol", "catalyst", "strength", "confidence")
    news = _staged(spark, materialize(tagged), "catalysts")
    return rounded(_wall(_run(spark, jobs.boost_stream(signals, news), "boost")))


def stream_load(spark, sf):
    """A file stream of early and late bars upserted into a table."""
    early, late = _early_and_late(_bar_rows(spark, sf))
    rows = early.withColumn("arrival", F.lit(0)).unionByName(late.withColumn("arrival", F.lit(1)))
    path = scratch(spark, "landed")
    rows.write.parquet(path)
    store = BarTable(spark, scratch(spark, "bars"))
    source = spark.readStream.schema(rows.schema).parquet(path)
    jobs.load_stream(source, store, scratch(spark, "ck")).awaitTermination()
    return rounded(store.read())


def flagship(spark, sf):
    """Hourly bars, holes filled, trend and volatility, with the last closed daily bar beside them."""
    base = materialize(fill_missing_bars(fx.bars_1h(spark, sf), "1h"))
    closed = close_labeled(base, "1h")
    left = add_indicators(closed, "1h", ["sma_20", "ema_12", "atr"]).drop(INDEX, "open", "high", "low")
    day = resample_bars(base, "1d").select("symbol", "ts", "close", "volume")
    return rounded(asof_join(left, {"1d": day}).filter(F.col("atr").isNotNull()))


QUERIES = {
    "flagship": flagship,
    "bars_1h": lambda spark, sf: rounded(fx.bars_1h(spark, sf, "close")),
    "bars_4h": _resampled("4h"),
    "bars_1d": _resampled("1d"),
    "bars_1w": _resampled("1w"),
    "bars_1mo": _resampled("1M"),
    "bars_7h": _resampled("7h"),
    "bars_supplier_1d": lambda spark, sf: rounded(fx.bars_1d(spark, sf, "close"), 8),
    "fill_bars": fill_bars,
    "close_label": close_label,
    "canonical_bars": canonical_bars,
    "validate_bars": validate_bars,
    "returns": _indicators("ret_1", "log_ret_1"),
    "sma": _indicators("sma_20"),
    "ema": _indicators("ema_12", "ema_26"),
    "rsi": _indicators("rsi_14"),
    "macd": _indicators("macd", "macd_signal", "macd_hist"),
    "atr": _indicators("atr"),
    "bollinger": _indicators("bb_mid", "bb_upper", "bb_lower", "bb_width"),
    "stochastic": _indicators("stoch_k", "stoch_d"),
    "adx": _indicators("adx", "plus_di", "minus_di"),
    "vwap": _indicators("vwap_dev"),
    "obv": obv,
    "obv_z": _indicators("obv_z"),
    "bar_shape": _indicators("close_pos", "range_atr"),
    "indicators": _indicators(*INDICATOR_COLUMNS),
    "indicators_supplier": indicators_supplier,
    "feature_names": feature_names,
    **{"pattern_" + c.removeprefix("cdl_"): _indicators(c) for c in PATTERN_COLUMNS},
    "mtf_asof": mtf_asof,
    "window_arrays": window_arrays,
    "window_tensors": window_tensors,
    "weekly_asof": weekly_asof,
    "triple_barrier": triple_barrier,
    "class_balance": class_balance,
    "clean_features": clean_features,
    "flat_features": flat_features,
    "build_samples": build_samples,
    "scaler_stats": scaler_stats,
    "scaled_features": scaled_features,
    "temporal_split": temporal_split,
    "walk_forward_folds": walk_forward_folds,
    "walk_forward_rolling": walk_forward_rolling,
    "upsert_bars": upsert_bars,
    "upsert_report": upsert_report,
    "merge_bars": merge_bars,
    "upsert_news": upsert_news,
    "range_read": range_read,
    "news_range_read": news_range_read,
    "series_coverage": series_coverage,
    "news_coverage": news_coverage,
    "list_symbols": list_symbols,
    "empty_series": empty_series,
    "base_bars": base_bars,
    "chunk_plan": chunk_plan,
    "resume_plan": resume_plan,
    "load_report": load_report,
    "load_bars": load_bars,
    "load_news": load_news,
    "load_news_rows": load_news_rows,
    "news_canonical": news_canonical,
    "news_csv": news_csv,
    "news_json": news_json,
    "news_slice": news_slice_,
    "keyword_catalysts": keyword_catalysts,
    "keyword_default": keyword_default,
    "scored_catalysts": scored_catalysts,
    "catalyst_report": catalyst_report,
    "catalyst_counts": catalyst_counts,
    "catalyst_boost": catalyst_boost,
    "model_text": model_text,
    "fused_meta": fused_meta,
    "fused_signals": fused_signals,
    "trade_plan_fixed": _plans("fixed_fractional"),
    "trade_plan_kelly": _plans("kelly"),
    "trade_plan_vol": _plans("vol_target"),
    "trade_outcome": _outcomes(None),
    "trade_outcome_trailing": _outcomes(0.8),
    "trade_costs": trade_costs,
    "single_position": single_position,
    "trade_ledger": trade_ledger,
    "equity_curve": equity_curve,
    "trade_metrics": trade_metrics,
    "metrics_rows": metrics_rows,
    "metrics_by_symbol": metrics_by_symbol,
    "return_correlation": return_correlation,
    "return_correlation_suppliers": return_correlation_suppliers,
    "correlation_lookup": correlation_lookup,
    "open_state": open_state,
    "limit_breaches": limit_breaches,
    "limit_breaches_correlated": limit_breaches_correlated,
    "breach_counts": breach_counts,
    "daily_pnl": daily_pnl,
    "confusion": confusion,
    "class_report": class_report,
    "fold_summary": fold_summary,
    "baseline_fit_score": baseline_fit_score,
    "ensemble_score": ensemble_score,
    "walk_forward": walk_forward,
    "walk_forward_fixed": walk_forward_fixed,
    "average_probs": average_probs,
    "param_search": param_search,
    "stream_bars": stream_bars,
    "stream_dedup": stream_dedup,
    "stream_catalysts": stream_catalysts,
    "stream_boost": stream_boost,
    "stream_load": stream_load,
}
