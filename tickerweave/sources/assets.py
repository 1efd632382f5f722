"""Asset identity: class, display name, search phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exchange and pair suffixes, crypto pair pattern, known quote types.
SUFFIXES = [
    "-USD",
    "-USDT",
    "-EUR",
    "-GBP",
    "-BTC",
    "-PERP",
    "-SWAP",
    ".NS",
    ".BO",
    ".L",
    ".TO",
    ".AX",
]
CRYPTO_PAIR = r"^[A-Z0-9]{2,10}-(?:USD|USDT|USDC|EUR|GBP|BTC|ETH|BNB|SOL)$"
QUOTE_TYPES = ["CRYPTOCURRENCY", "EQUITY", "ETF", "MUTUALFUND", "INDEX", "FUTURE", "CURRENCY", "OPTION"]

# Three search phrases per asset class; {n} = name, {t} = ticker.
SEARCH_PHRASES = {
    "CRYPTOCURRENCY": ['"{n}" cryptocurrency price', '"{n}" crypto regulation adoption', '"{n}" blockchain network market'],
    "ETF": ['"{n}" {t} ETF', '"{n}" fund flows NAV performance', '"{n}" ETF market outlook'],
    "MUTUALFUND": ['"{n}" {t} fund', '"{n}" fund performance holdings', '"{n}" mutual fund outlook'],
    "INDEX": ['"{n}" market index', '"{n}" economic outlook macro', '"{n}" trading futures market'],
    "CURRENCY": ['"{n}" {t} currency forex', '"{n}" exchange rate central bank', '"{n}" currency market outlook'],
    "EQUITY": ['"{n}" {t} stock', '"{n}" earnings analyst', '"{n}" guidance outlook'],
}


def bare_symbol(ticker: Column) -> Column:
    """Upper-case symbol without its suffix; otherwise cut at the first dot."""
    up = F.upper(ticker)
    out = F.regexp_extract(up, r"^([^.]*)", 1)
    for s in reversed(SUFFIXES):
        out = F.when(up.endswith(s), F.substring(up, F.lit(1), F.length(up) - len(s))).otherwise(out)
    return out


def resolve_assets(listing: DataFrame) -> DataFrame:
    """listing(ticker, short_name, long_name, quote_type) to one profile per ticker."""
    t = F.upper(F.trim("ticker"))
    name = F.coalesce(F.nullif("short_name", F.lit("")), "long_name")
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    kind = F.upper(F.trim("quote_type"))
    guess = F.when(t.rlike("(?i)" + CRYPTO_PAIR), "CRYPTOCURRENCY").otherwise("EQUITY")
    cls = F.when(kind.isin(QUOTE_TYPES), kind).otherwise(guess)
    return listing.select(
        t.alias("ticker"),
        F.when(blank, bare_symbol(t)).otherwise(F.trim(name)).alias("display_name"),
        cls.alias("asset_class"),
        F.when(blank, "heuristic").otherwise("listing").alias("source"),
        (cls == "CRYPTOCURRENCY").alias("is_crypto"),
        cls.isin("EQUITY", "ETF", "MUTUALFUND").alias("is_equity"),
        cls.isin("INDEX", "FUTURE", "CURRENCY").alias("is_macro"),
    )


def search_phrases(profiles: DataFrame) -> DataFrame:
    """Three rows per asset: its search phrases in order."""

    def filled(cls):
        return F.array(*[
            F.replace(F.replace(F.lit(p), F.lit("{n}"), F.col("display_name")), F.lit("{t}"), F.col("ticker"))
            for p in SEARCH_PHRASES[cls]
        ])

    c = F.col("asset_class")
    choice = (
        F.when(c == "CRYPTOCURRENCY", filled("CRYPTOCURRENCY"))
        .when(c == "ETF", filled("ETF"))
        .when(c == "MUTUALFUND", filled("MUTUALFUND"))
        .when(c.isin("INDEX", "FUTURE"), filled("INDEX"))
        .when(c == "CURRENCY", filled("CURRENCY"))
        .otherwise(filled("EQUITY"))
    )
    return profiles.select("ticker", F.posexplode(choice).alias("query_idx", "query"))
