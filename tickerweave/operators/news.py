"""News: hygiene, de-duplication, credibility, recency, sentiment, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.core import div
from tickerweave.functions.text import SPACE, article_date, collapse, fingerprint, host, keyword_hits, token_hits, words
from tickerweave.operators.sector import lookup

# Source credibility in two tiers, and blocked domains.
TIER1 = {
    "reuters.com": 1.00,
    "bloomberg.com": 1.00,
    "wsj.com": 0.98,
    "ft.com": 0.97,
    "sec.gov": 1.00,
    "federalreserve.gov": 1.00,
    "ecb.europa.eu": 0.95,
    "bls.gov": 0.95,
    "bea.gov": 0.95,
    "cnbc.com": 0.90,
    "marketwatch.com": 0.88,
    "finance.yahoo.com": 0.85,
    "barrons.com": 0.92,
    "morningstar.com": 0.90,
    "seekingalpha.com": 0.75,
    "fool.com": 0.70,
    "investopedia.com": 0.72,
    "thestreet.com": 0.78,
    "zacks.com": 0.80,
    "coindesk.com": 0.90,
    "cointelegraph.com": 0.88,
    "theblock.co": 0.88,
    "decrypt.co": 0.82,
    "cryptoslate.com": 0.75,
}
TIER2 = {
    "apnews.com": 0.82,
    "nytimes.com": 0.80,
    "washingtonpost.com": 0.78,
    "theguardian.com": 0.75,
    "economist.com": 0.85,
    "businessinsider.com": 0.68,
    "fortune.com": 0.72,
    "forbes.com": 0.70,
    "techcrunch.com": 0.65,
    "cryptobriefing.com": 0.70,
    "bitcoinist.com": 0.65,
    "newsbtc.com": 0.62,
}
DEFAULT_CREDIBILITY = 0.55
BLOCKED = [
    "wikipedia.org",
    "en.wikipedia.org",
    "wikidata.org",
    "quora.com",
    "reddit.com",
    "pinterest.com",
    "tumblr.com",
    "medium.com",
    "substack.com",
    "stockanalysis.com",
    "macrotrends.net",
    "tradingview.com",
    "finviz.com",
    "barchart.com",
]
# Phrase lists of the article sentiment.
BULLISH = [
    "beats", "beat", "surge", "surged", "upgrade", "upgraded", "raised", "raise", "strong", "record profit", "growth",
    "positive outlook", "exceeds", "bullish", "rally", "rallied", "outperform", "record high", "buyback", "dividend",
    "raised guidance", "above expectations", "strong demand", "expansion", "breakout", "adoption", "all-time high",
    "ath", "halving", "accumulation", "institutional buying", "etf approval",
]
BEARISH = [
    "miss", "missed", "downgrade", "downgraded", "lawsuit", "investigation", "fraud", "decline", "cut", "weak", "loss",
    "losses", "bankruptcy", "warning", "sell-off", "selloff", "below expectations", "layoffs", "recall", "probe",
    "fine", "penalty", "default", "restructuring", "missed earnings", "lowered guidance", "weak demand", "contraction",
    "hack", "exploit", "rug pull", "ban", "crackdown", "delisting", "liquidation", "exchange collapse",
    "regulatory action",
]
SEVERE = [
    "bankruptcy", "fraud", "lawsuit", "investigation", "earnings", "federal reserve", "fed rate", "gdp", "inflation",
    "recession", "merger", "acquisition", "ipo", "guidance", "restatement", "sec", "cftc", "etf", "halving",
    "hard fork", "hack", "exploit",
]
# Word lists of the headline sentiment.
BULLISH_WORDS = [
    "surge", "rally", "beat", "strong", "growth", "bullish", "up", "gain", "profit", "outperform", "record", "high",
    "positive", "rises", "jumped", "soared", "lifted", "upgraded", "raises",
]
BEARISH_WORDS = [
    "drop", "fall", "miss", "weak", "loss", "bearish", "down", "decline", "risk", "concern", "low", "negative",
    "crash", "fell", "tumbled", "slumped", "cut", "downgraded", "warning",
]
# Lookback days per horizon.
MAX_AGE_DAYS = {"1d": 3, "7d": 7, "1m": 30, "6m": 90}
DEFAULT_AGE_DAYS = 7
MIN_WORDS = 10
SNIPPET_CHARS = 400
TOP_K = 8


def credibility(domain: Column) -> Column:
    return F.coalesce(lookup({**TIER2, **TIER1}, F.lower(domain)), F.lit(DEFAULT_CREDIBILITY))


def time_limit(horizon: Column) -> Column:
    """Search window of a horizon: past day, week or month."""
    age = F.coalesce(lookup(MAX_AGE_DAYS, horizon), F.lit(DEFAULT_AGE_DAYS))
    return F.when(age <= 3, "d").when(age <= 7, "w").otherwise("m")


def clean_news(raw: DataFrame) -> DataFrame:
    """raw(ticker, query_idx, result_idx, title, url, body, metadata): usable results with domain and credibility.

    Title and URL must be present, the domain not blocked and the snippet (the
    first 400 characters of the body) at least ten words long.
    """
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    df = raw.withColumns({"title": trimmed("title"), "url": trimmed("url")})
    df = df.withColumn("snippet", F.substring(F.coalesce("body", F.lit("")), 1, SNIPPET_CHARS)).drop("body")
    df = df.withColumn("domain", F.coalesce(host("url"), F.lit("")))
    keep = (
        (F.col("title") != "") & (F.col("url") != "") & ~F.lower("domain").isin(BLOCKED)
        & (F.size(words("snippet")) >= MIN_WORDS)
    )
    return df.filter(keep).withColumn("credibility", credibility(F.col("domain")))


def first_by_title(news: DataFrame) -> DataFrame:
    """One article per ticker and title fingerprint: the first in query order. Copies merge before the shuffle."""
    df = news.withColumn("fingerprint", fingerprint("title"))
    cols = [c for c in df.columns if c not in ("ticker", "fingerprint")]
    best = df.groupBy("ticker", "fingerprint").agg(
        F.min_by(F.struct(*cols), F.struct("query_idx", "result_idx")).alias("r")
    )
    return best.select("ticker", "fingerprint", *[F.col(f"r.{c}").alias(c) for c in cols])


def most_credible(news: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k most credible articles per ticker, ties in arrival order."""
    w = Window.partitionBy("ticker").orderBy(F.col("credibility").desc(), "query_idx", "result_idx")
    return news.withColumn("source_rank", F.row_number().over(w)).filter(F.col("source_rank") <= k)


def recency_audit(news: DataFrame, now, horizon: str | None = None, max_age_days: int | None = None, policy: str = "reject") -> DataFrame:
    """Adds published_at, date_source, age_days, kept, penalty and reason to every article.

    policy for undated articles: "reject", "accept", or "accept_with_penalty"
    (half weight).
    """
    limit = max_age_days if max_age_days is not None else MAX_AGE_DAYS.get(horizon, DEFAULT_AGE_DAYS)
    moment = F.lit(now).cast("timestamp_ntz")
    ts, source = article_date("metadata", "snippet", "title", moment)
    df = news.withColumns({"published_at": ts, "date_source": source})
    p = F.col("published_at")
    seconds = F.unix_seconds(moment.cast("timestamp")) - F.unix_seconds(p.cast("timestamp"))
    age = seconds / 86400
    fresh = p >= moment - F.make_dt_interval(F.lit(limit))
    undated_ok = policy != "reject"
    # Output texts of the contract, here and below.
    reason = F.when(
        p.isNull(), F.lit("" if undated_ok else "Publish date could not be determined and unknown_date_policy=reject.")
    ).when(
        ~fresh,
        F.format_string(f"Age %.1fd exceeds max_age={limit}d (published %s).", age, F.date_format(p, "yyyy-MM-dd")),
    ).otherwise("")
    return df.withColumns(
        {
            "age_days": F.round(age, 1),
            "kept": F.when(p.isNull(), F.lit(undated_ok)).otherwise(fresh),
            "penalty": F.when(p.isNull() & F.lit(policy == "accept_with_penalty"), 0.5).otherwise(1.0),
            "reason": reason,
        }
    )


def rescue_newest(audited: DataFrame, min_kept: int) -> DataFrame:
    """Lift the newest dropped articles until each ticker keeps `min_kept`; undated ones come last.

    Only the `min_kept` newest dropped rows per ticker are ranked at all.
    """
    kept = audited.groupBy("ticker").agg(F.sum(F.col("kept").cast("int")).alias("__k"))
    w = Window.partitionBy("ticker", "kept").orderBy(F.col("published_at").desc_nulls_last(), "query_idx", "result_idx")
    df = audited.withColumn("__r", F.row_number().over(w)).join(kept, "ticker")
    lift = ~F.col("kept") & (F.col("__r") <= F.lit(min_kept) - F.col("__k"))
    return df.withColumn("reason", F.when(lift, f"Rescued to satisfy min_kept={min_kept}.").otherwise(F.col("reason"))).withColumn(
        "kept", F.col("kept") | lift
    ).drop("__r", "__k")


def score_articles(news: DataFrame) -> DataFrame:
    """Phrase sentiment, severity and the composite weight of each article."""
    df = news.withColumn("__t", F.lower(F.concat("title", F.lit(" "), "snippet")))
    df = df.withColumns(
        {"__b": keyword_hits("__t", BULLISH), "__s": keyword_hits("__t", BEARISH), "__v": keyword_hits("__t", SEVERE)}
    )
    bull, bear = F.col("__b"), F.col("__s")
    total = (bull + bear).cast("double")
    score = F.when(bull > bear, div(bull, total)).when(bear > bull, -div(bear, total)).otherwise(0.0)
    df = df.withColumns(
        {
            "sentiment": F.when(bull > bear, "positive").when(bear > bull, "negative").otherwise("neutral"),
            "sentiment_score": F.round(score, 3) + 0.0,
            "severity_score": F.round(F.least(F.lit(1.0), F.col("__v") / 3.0), 3),
        }
    )
    weight = F.col("credibility") * 0.40 + F.col("severity_score") * 0.30 + F.abs("sentiment_score") * 0.30
    penalty = F.col("penalty") if "penalty" in news.columns else F.lit(1.0)
    return df.withColumn("final_weight", F.round(F.round(weight, 9), 3) * penalty).drop("__t", "__b", "__s", "__v")


def headline_sentiment(text: Column) -> tuple[Column, Column]:
    """(label, score) from whole words: bullish minus bearish over their number."""
    bull, bear = token_hits(text, BULLISH_WORDS), token_hits(text, BEARISH_WORDS)
    score = (bull - bear) / F.greatest(bull + bear, F.lit(1))
    label = F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")
    return label, F.round(score, 3) + 0.0


def _extract(title: Column, snippet: Column) -> Column:
    """Title and the snippet cut at a word before 180 characters; short snippets give the title alone."""
    body = collapse(snippet)
    cut = F.regexp_replace(F.regexp_replace(F.substring(body, 1, 180), r" [^ ]*$", ""), r"[.,;]+$", "")
    return F.when(F.length(body) >= 40, F.concat(title, F.lit(": "), cut, F.lit("."))).otherwise(
        F.concat(F.regexp_replace(F.trim(title), r"\.+$", ""), F.lit("."))
    )


def build_briefs(raw: DataFrame, tickers: DataFrame, now, horizon: str = "1d", policy: str = "reject", k: int = TOP_K) -> DataFrame:
    """One brief per ticker: hygiene, first per title, most credible k, recency, scoring, summary.

    After the top-k step at most k articles per ticker remain, so everything
    behind it is small.
    """
    top = most_credible(first_by_title(clean_news(raw)), k)
    audited = score_articles(recency_audit(top, now, horizon, policy=policy))
    limit = MAX_AGE_DAYS.get(horizon, DEFAULT_AGE_DAYS)
    kept = F.col("kept")
    item = F.struct(
        (-F.col("final_weight")).alias("order"), "source_rank", "title", "snippet", "url", "domain", "sentiment",
        "sentiment_score", "severity_score", "credibility", "final_weight",
    )
    s = audited.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("articles_retrieved"),
        F.count_if(kept).alias("articles_kept"),
        F.count_if(kept & (F.col("credibility") >= 0.90)).alias("tier1"),
        F.sum(F.when(kept, F.col("final_weight"))).alias("w"),
        F.sum(F.when(kept, F.col("sentiment_score") * F.col("final_weight"))).alias("sw"),
        F.sort_array(F.collect_list(F.when(kept, item))).alias("top_news"),
    )
    df = tickers.select("ticker").distinct().join(s, "ticker", "left")
    n = F.coalesce("articles_kept", F.lit(0))
    got = F.coalesce("articles_retrieved", F.lit(0))
    note = F.format_string(f"max age {limit}d; %d article(s) discarded as stale or undated", got - n)
    score = F.round(F.coalesce(div("sw", "w"), F.lit(0.0)), 3) + 0.0
    df = df.withColumns({"recency_note": note, "sentiment_score": F.when(n > 0, score).otherwise(0.0)})
    sc = F.col("sentiment_score")
    mood = F.when(sc > 0.10, "positive").when(sc < -0.10, "negative").otherwise("neutral")
    extracts = F.array_join(F.transform(F.slice("top_news", 1, 3), lambda x: _extract(x["title"], x["snippet"])), " ")
    # Output texts of the contract.
    situation = F.when(
        n > 0,
        F.concat(
            F.lit("Market sentiment for "), "ticker", F.lit(" is "), mood, F.lit(" based on "), n.cast("string"),
            F.lit(" source-weighted, recency-filtered articles ("), "recency_note", F.lit("). "), extracts,
        ),
    ).otherwise(
        F.concat(F.lit("No reliable financial news retrieved for this ticker within the recency window. "), "recency_note")
    )
    return df.select(
        "ticker",
        situation.alias("situation_summary"),
        mood.alias("aggregate_sentiment"),
        "sentiment_score",
        F.coalesce("top_news", F.array().cast(df.schema["top_news"].dataType)).alias("top_news"),
        F.when(n > 0, F.concat(F.coalesce("tier1", F.lit(0)).cast("string"), F.lit("/"), n.cast("string"),
                               F.lit(" articles from Tier-1 institutional sources."))).otherwise("").alias("source_quality_note"),
        got.alias("articles_retrieved"),
        n.alias("articles_kept"),
        "recency_note",
        (n > 0).alias("retrieval_success"),
    )
