"""Model signal and news combined; narratives, model replies, prompts, glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.text import fmt_pct, fmt_raw, fmt_signed, json_object_text
from tickerweave.operators.sector import lookup

STRONG_NEWS = 0.30
HISTORY_MESSAGES = 20


def confidence_label(p: Column) -> Column:
    d = F.abs(p - 0.5)
    return F.when(d > 0.15, "high").when(d > 0.05, "moderate").otherwise("low")


def predicted_side(df: DataFrame, p: str = "p_bullish") -> DataFrame:
    """Direction, confidence and the probability of the predicted side."""
    up = F.col(p) >= 0.5
    return df.withColumns(
        {
            "prediction": up.cast("int"),
            "direction": F.when(up, "BULLISH (UP)").otherwise("BEARISH (DOWN)"),
            "side_probability": F.round(F.when(up, F.col(p)).otherwise(1 - F.col(p)), 4),
            "confidence_label": confidence_label(F.col(p)),
        }
    )


def rule_fusion(signals: DataFrame, briefs: DataFrame) -> DataFrame:
    """signals(ticker, prediction, p_bullish, confidence_label) with briefs: strong agreeing news confirms,
    strong opposing news neutralises, anything else (or no news) leaves the model's signal."""
    n = briefs.select("ticker", "aggregate_sentiment", F.col("sentiment_score").alias("news_score"), "retrieval_success")
    df = signals.join(n, "ticker", "left")
    has = F.coalesce("retrieval_success", F.lit(False))
    ml_dir = F.when(F.col("prediction") == 1, "BULLISH").otherwise("BEARISH")
    ml_prob = F.round("p_bullish", 4)
    conf = F.upper("confidence_label")
    strong = has & (F.abs("news_score") >= STRONG_NEWS)
    agree = (F.col("aggregate_sentiment") == "positive") == (F.col("prediction") == 1)
    out = df.select(
        "ticker",
        ml_dir.alias("ml_direction"),
        ml_prob.alias("ml_probability"),
        F.when(strong & ~agree, "NEUTRAL").otherwise(ml_dir).alias("final_direction"),
        F.when(strong & agree, "MODERATE").when(strong, "LOW").otherwise(conf).alias("final_confidence"),
        F.when(strong & ~agree, F.lit(0.5)).otherwise(ml_prob).alias("fusion_probability"),
        F.coalesce("aggregate_sentiment", F.lit("neutral")).alias("news_sentiment"),
        F.col("news_score"),
        has.alias("__has"),
    )
    # Output texts of the contract.
    text = F.when(
        F.col("__has"),
        F.concat(
            F.lit("Rule-based fusion (LLM unavailable). ML signal: "), "ml_direction", F.lit(" (p="), fmt_raw("ml_probability"),
            F.lit("). News sentiment: "), "news_sentiment", F.lit(" (score="), fmt_signed("news_score", 3), F.lit("). Final: "),
            "final_direction", F.lit("."),
        ),
    ).otherwise("ML-only signal — news fusion unavailable.")
    return out.withColumn("narrative", text).drop("__has", "news_score")


def prediction_narrative(df: DataFrame, drivers: DataFrame) -> DataFrame:
    """drivers(ticker, feature, attribution): up to three drivers per side inside one sentence per ticker."""
    side = F.when(F.col("attribution") > 0, "up").otherwise("down")
    w = Window.partitionBy("ticker", "side").orderBy(F.abs("attribution").desc(), "feature")
    d = drivers.withColumn("side", side).withColumn("k", F.row_number().over(w)).filter("k <= 3")
    label = F.concat("feature", F.lit(" ("), fmt_signed("attribution"), F.lit(")"))
    lists = d.groupBy("ticker").agg(
        *[
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("k", label.alias("t"))))),
                                     lambda x: x["t"]), ", ").alias(s)
            for s in ("up", "down")
        ]
    )
    df = df.join(lists, "ticker", "left")
    head = F.concat(
        F.lit("["), "ticker", F.lit("] Prediction: "), "direction", F.lit(" (Probability: "), fmt_pct("side_probability"),
        F.lit(", Confidence: "), "confidence_label", F.lit(")"),
    )
    part = lambda c, title: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"• {title}: "), c, F.lit(".")))
    text = F.concat_ws("  ", head, part(F.col("up"), "Bullish"), part(F.col("down"), "Bearish headwinds"))
    return df.select("ticker", text.alias("narrative"))


REPLY_SCHEMA = "final_direction string, final_confidence string, fusion_probability double, synthesis_narrative string, news_sentiment string"


def parse_replies(df: DataFrame, text: str, defaults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantined): the JSON object inside each free-text reply, absent fields from the defaults."""
    obj = json_object_text(text)
    parsed = F.from_json(obj, REPLY_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    df = df.withColumn("__j", parsed)
    ok = F.col("__j").isNotNull() & F.col("__j._corrupt").isNull()
    good = df.filter(ok).withColumns({k: F.coalesce(F.col(f"__j.{k}"), d) for k, d in defaults.items()}).drop("__j")
    return good, df.filter(~F.coalesce(ok, F.lit(False))).drop("__j")


def last_messages(messages: DataFrame, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """Last messages per conversation (limit pushed before the shuffle), with the number of turns."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = messages.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit).drop("__r")
    n = kept.groupBy("conv_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("turn_count"))
    return kept.join(n, "conv_id")


def prompts(messages: DataFrame, questions: DataFrame, system: str) -> DataFrame:
    """questions(conv_id, query, context) to the full prompt text: system and context, history, question."""
    h = last_messages(messages).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    df = questions.join(h, "conv_id", "left")
    # Output texts of the contract.
    ctx = F.when(
        F.coalesce("context", F.lit("")) != "",
        F.concat(F.lit(f"system: {system}\n\nContext from financial knowledge base:\n"), "context"),
    ).otherwise(F.lit(f"system: {system}"))
    lines = F.transform("h", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    text = F.concat_ws("\n", ctx, F.array_join(lines, "\n"), F.concat(F.lit("user: "), "query"))
    return df.select("conv_id", text.alias("prompt"))


# Descriptions of the features, in lookup order: a name is matched exactly, then by the first prefix.
GLOSSARY = {
    **{f"rsi_{n}": f"Relative strength index over {n} days: above 70 overbought, below 30 oversold." for n in (14, 7, 21)},
    "rsi_overbought": "1 when the 14-day relative strength index is above 70.",
    "rsi_oversold": "1 when the 14-day relative strength index is below 30.",
    "macd_histogram": "Gap between the MACD line and its signal line; positive means a strengthening uptrend.",
    "macd_bullish": "1 when the MACD line is above its signal line.",
    "macd": "Difference of the 12-day and 26-day exponential averages of the close.",
    **{f"momentum_{n}d": f"Relative price change over {n} trading days." for n in (5, 10, 21, 63)},
    "momentum_persistence": "Short-term momentum over long-term momentum; above 1 the move accelerates.",
    **{f"realized_vol_{n}d": f"Annualised deviation of daily returns over {n} days." for n in (5, 10, 21, 63)},
    "gk_vol_20": "Range-based volatility from open, high, low and close over 20 days.",
    "atr_pct": "Average true range as a share of the price.",
    "atr_14": "Average true range over 14 days.",
    "hurst_30": "Hurst exponent: above 0.5 trending, below 0.5 reverting.",
    "volume_ratio": "Volume over its 20-day average.",
    "volume_imbalance_20": "Volume weighted by the direction of the candle over 20 days.",
    "obv_momentum": "Change of the on-balance volume over 5 days.",
    "obv_sma20": "20-day average of the on-balance volume.",
    "obv": "Running total of volume signed by the price direction.",
    "vwap_deviation": "Distance of the close from the volume-weighted average price.",
    "bb_pct": "Position of the close between the lower (0) and upper (1) Bollinger band.",
    "bb_width": "Distance of the Bollinger bands relative to their middle.",
    "bb_squeeze": "1 when the bands are narrow compared with the last 20 days.",
    **{f"close_vs_sma_{n}": f"Distance of the close from its {n}-day average." for n in (5, 10, 20, 50)},
    "sma_5_20_cross": "1 when the 5-day average is above the 20-day average.",
    "sma_20_50_cross": "1 when the 20-day average is above the 50-day average.",
    "ema_12_26_cross": "1 when the 12-day exponential average is above the 26-day one.",
    **{f"returns_{n}d": f"Simple return over {n} trading days." for n in (1, 3, 5, 10)},
    "log_returns": "Logarithm of the daily price ratio.",
    "overnight_gap": "Open relative to the previous close.",
    **{f"pct_from_high_{n}": f"Distance below the {n}-day high." for n in (5, 20)},
    **{f"pct_from_low_{n}": f"Distance above the {n}-day low." for n in (5, 20)},
    **{f"rolling_range_{n}": f"{n}-day price range relative to the price." for n in (5, 20)},
    "hl_spread_pct": "Daily high minus low relative to the close.",
    "amihud_illiq_20": "Price move per unit of traded value over 20 days.",
    **{f"rolling_skew_{n}": f"Skewness of daily returns over {n} days." for n in (20, 60)},
    **{f"rolling_kurt_{n}": f"Tail weight of daily returns over {n} days." for n in (20, 60)},
    "vol_regime_pct": "Rank of the current volatility within the last 252 days.",
    "high_vol_regime": "1 when volatility is in its top quarter.",
    "low_vol_regime": "1 when volatility is in its bottom quarter.",
    "trend_regime": "1 in an uptrend, -1 in a downtrend, 0 otherwise.",
    "in_uptrend": "1 when the 50-day average is clearly above the 200-day average.",
    "in_downtrend": "1 when the 50-day average is clearly below the 200-day average.",
    "candle_body": "Open-to-close distance relative to the daily range.",
    "upper_shadow": "Part of the range above the body.",
    "lower_shadow": "Part of the range below the body.",
    "candle_dir": "1 when the close is above the open.",
}


def describe_feature(name: Column) -> Column:
    keys = F.array(*[F.lit(k) for k in GLOSSARY])
    prefix = F.get(F.filter(keys, lambda k: F.startswith(name, k)), 0)
    generic = F.concat(
        F.lit("Quantitative indicator derived from price and volume data ("), F.trim(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(").")
    )
    return F.coalesce(lookup(GLOSSARY, name), lookup(GLOSSARY, prefix), generic)
