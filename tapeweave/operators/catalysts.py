"""Catalyst tags on news: by keywords, or from a text model's scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.arith import col
from tapeweave.functions.text import tagging_text

# Keywords per catalyst, in order of preference on ties.
KEYWORDS = {
    "m_and_a": ["acquire", "acquisition", "merger", "takeover", "buyout", "to buy"],
    "partnership": ["partnership", "collaborat", "strategic alliance", "joint venture"],
    "breakthrough": ["breakthrough", "fda approval", "patent", "unveils", "milestone"],
    "earnings": ["earnings", "beats estimates", "guidance", "revenue"],
    "regulatory": ["sec", "regulator", "antitrust", "investigation", "lawsuit"],
}
# Expected strength per catalyst, and for any other class.
STRENGTH = {"m_and_a": 0.9, "breakthrough": 0.7, "partnership": 0.5, "earnings": 0.4, "regulatory": 0.5}
OTHER_STRENGTH = 0.3
# Text-model labels and the catalysts they stand for.
MODEL_LABELS = {
    "merger or acquisition or takeover": "m_and_a",
    "strategic partnership or collaboration or joint venture": "partnership",
    "technological breakthrough, product launch, or regulatory approval": "breakthrough",
    "quarterly earnings or financial results or guidance": "earnings",
    "regulatory action, lawsuit, or government investigation": "regulatory",
    "routine business news with no major catalyst": "none",
}


def _lookup(key: Column, table: dict, default) -> Column:
    chain = F.lit(default)
    for name, value in reversed(table.items()):
        chain = F.when(key == name, value).otherwise(chain)
    return chain


def tag_keywords(
    news: DataFrame, lexicon: dict[str, list[str]] = KEYWORDS, strength: dict[str, float] = STRENGTH
) -> DataFrame:
    """News with ``catalyst, strength, confidence``: the class with most keywords found.

    A keyword counts once if it occurs anywhere in the text, inside words too; the first class of
    the lexicon wins ties. The scan of the text runs where the row is, without a shuffle.
    """
    names = list(lexicon)
    count = lambda text, words: sum((F.contains(text, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    hits = lambda text: F.struct(*[count(text, lexicon[n]).alias(f"_hits_{i}") for i, n in enumerate(names)])
    # Generated rows are a barrier: the text is lowered and searched once, whatever is filtered later.
    searched = news.select("*", F.inline(F.transform(F.array(tagging_text()), hits)))
    columns = [F.col(f"_hits_{i}") for i in range(len(names))]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    name = F.lit("none")
    for column, label in reversed(list(zip(columns, names))):
        name = F.when((column == F.col("_best")) & (column > 0), label).otherwise(name)
    found = F.col("_best")
    return (
        searched.withColumn("_best", best)
        .withColumn("catalyst", name)
        .withColumns({
            "strength": F.when(found > 0, _lookup(F.col("catalyst"), strength, OTHER_STRENGTH)).otherwise(0.0),
            "confidence": F.when(found > 0, F.least(F.lit(1.0), 0.4 + 0.2 * found)).otherwise(0.0),
        })
        .drop("_best", *[f"_hits_{i}" for i in range(len(names))])
    )


def tag_scores(
    scored: DataFrame,
    labels: dict[str, str] = MODEL_LABELS,
    strength: dict[str, float] = STRENGTH,
    min_confidence: float = 0.5,
) -> DataFrame:
    """Catalysts from a text model's ranked ``labels`` and ``scores`` and its sentiment."""
    confidence = F.get("scores", F.lit(0))
    named = _lookup(F.get("labels", F.lit(0)), labels, "none")
    kept = (named != "none") & (confidence >= min_confidence)
    mood = F.lower(F.coalesce("sentiment_label", F.lit("")))
    conviction = F.coalesce("sentiment_score", F.lit(0.0))
    factor = F.when(mood == "neutral", 0.5).otherwise(0.5 + 0.5 * conviction)
    raw = F.least(F.lit(1.0), _lookup(named, strength, OTHER_STRENGTH) * factor)
    meta = F.create_map(
        F.lit("sentiment"), mood,
        F.lit("sentiment_score"), F.round(conviction, 4).cast("string"),
        F.lit("classifier"), F.lit("scored-catalyst"),
    )
    return scored.withColumns({
        "catalyst": F.when(kept, named).otherwise("none"),
        "strength": F.when(kept, F.round(raw, 4)).otherwise(0.0),
        "confidence": F.when(kept, F.round(confidence, 4)).otherwise(0.0),
        "meta": F.when(kept, meta),
    })


def actionable_catalysts(catalysts: DataFrame) -> DataFrame:
    return catalysts.filter((F.col("catalyst") != "none") & (F.col("confidence") > 0))


def catalyst_counts(catalysts: DataFrame, by: list[str] = ["symbol", "catalyst"]) -> DataFrame:
    """Tagged and actionable rows per group."""
    acts = (F.col("catalyst") != "none") & (F.col("confidence") > 0)
    return catalysts.groupBy(*by).agg(F.count(F.lit(1)).alias("tagged"), F.count_if(acts).alias("actionable"))


def catalyst_report(
    news: DataFrame, start, end, symbols: list[str] | None = None, lexicon: dict[str, list[str]] = KEYWORDS
) -> DataFrame:
    """Actionable catalysts of a look-back window ``[start, end)``, for some or all symbols."""
    window = news.filter((F.col("ts") >= col(start)) & (F.col("ts") < col(end)))
    if symbols is not None:
        window = window.filter(F.col("symbol").isin(symbols))
    tagged = actionable_catalysts(tag_keywords(window, lexicon))
    return tagged.select("ts", "symbol", "catalyst", "strength", "confidence", "source", "headline")
