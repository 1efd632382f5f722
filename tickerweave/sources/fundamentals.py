"""Company payloads and earnings feeds, normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerweave.functions.core import div, safe_double

# Keys harvested from a company payload.
INFO_KEYS = [
    "trailingPE",
    "forwardPE",
    "priceToBook",
    "enterpriseToEbitda",
    "profitMargins",
    "operatingMargins",
    "revenueGrowth",
    "earningsGrowth",
    "debtToEquity",
    "currentRatio",
    "freeCashflow",
    "marketCap",
    "sharesOutstanding",
    "floatShares",
    "institutionPercentHeld",
    "shortPercentOfFloat",
    "nextEarningsDate",
    "mostRecentQuarter",
    "sector",
    "industry",
]
TEXT_KEYS = {"nextEarningsDate", "mostRecentQuarter", "sector", "industry"}


def harvest(df: DataFrame, payload: str, keys: list[str], text_keys=frozenset()) -> DataFrame:
    """Named keys of a JSON object column: finite doubles or NULL, text keys as they are.

    A payload that is not a JSON object gives NULL for every key.
    """
    m = F.from_json(F.col(payload), "map<string,string>")
    base = df.select("*", m.alias("__m"))
    cols = [
        (F.try_element_at("__m", F.lit(k)) if k in text_keys else safe_double(F.try_element_at("__m", F.lit(k)))).alias(k)
        for k in keys
    ]
    return base.select(*df.columns, *cols)


def read_fundamentals(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    return harvest(payloads, payload, INFO_KEYS, TEXT_KEYS).drop(payload)


def _role(name: str) -> str | None:
    low = name.lower().replace(" ", "_")
    if "actual" in low:
        return "actual_eps"
    if "estimate" in low or "expected" in low:
        return "estimated_eps"
    if "surprise" in low and "%" not in name:
        return "surprise_pct"
    return None


def normalise_earnings(feed: DataFrame, ticker: str = "ticker", announced: str = "announced") -> DataFrame:
    """Earnings feed with any naming of its columns to (ticker, announced, actual, estimated, surprise).

    Empty when the feed lacks the actual or the estimated figure. A missing
    surprise column is computed; rows without both figures are dropped.
    """
    roles = {}
    for c in feed.columns:
        if c not in (ticker, announced) and _role(c):
            roles[_role(c)] = c
    base = [F.col(ticker).alias("ticker"), F.to_date(announced).alias("announced")]
    if "actual_eps" not in roles or "estimated_eps" not in roles:
        return feed.limit(0).select(
            *base, *[F.lit(None).cast("double").alias(c) for c in ("actual_eps", "estimated_eps", "surprise_pct")]
        )
    act, est = safe_double(roles["actual_eps"]), safe_double(roles["estimated_eps"])
    own = safe_double(roles["surprise_pct"]) if "surprise_pct" in roles else div(act - est, F.abs(est))
    return feed.select(
        *base, act.alias("actual_eps"), est.alias("estimated_eps"), own.alias("surprise_pct")
    ).dropna(subset=["actual_eps", "estimated_eps"])
