"""Derived inputs: the analytics tables expressed over the star schema, with the same text in SQL.

The given tables have no price bars, option chains or news, so each is derived
from them by plain aggregations and projections. Every function here has its
SQL twin below, used only to check the Spark results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.sources.bars import bars_from_trades


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as trades: ticker = priority, price = total price, ties by order key."""
    return bars_from_trades(
        read(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"
    )


BARS = """bars AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date,
    arg_min(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS open,
    max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS close,
    CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY ALL)"""


def bars_brand(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades of 25 brands; unit price, order-free aggregates only."""
    li = read(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = read(spark, sf, "part").select("p_partkey", "p_brand")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.avg(unit).alias("open"),
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            ((F.max(unit) + F.min(unit)) / 2).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


BARS_BRAND = """bars_brand AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
    avg(u) AS open, max(u) AS high, min(u) AS low,
    (max(u) + min(u)) / 2 AS close, sum(l_quantity) AS volume
  FROM (SELECT p_brand, l_shipdate, l_quantity, l_extendedprice / l_quantity AS u
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY ALL)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def r(expr: str, places: int = 6) -> str:
    """SQL twin of functions.core.rnd."""
    return f"(round({expr}, {places}) + 0.0::DOUBLE)"


# --- index series -----------------------------------------------------------------

_FUNDS = ["XLK", "XLV", "XLE", "XLF", "XLY"]


def series(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, date, close): five regional funds and the market from orders, index levels from line items.

    A day with a single line item yields a NULL index level.
    """
    o = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    fund = F.element_at(F.array(*[F.lit(x) for x in _FUNDS]), F.col("n_regionkey") + 1)
    day = F.to_date("o_orderdate").alias("date")
    price = F.round(F.avg("o_totalprice"), 6).alias("close")
    funds = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(fund.alias("symbol"), day)
        .agg(price)
    )
    spy = o.groupBy(F.lit("SPY").alias("symbol"), day).agg(price)
    li = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_discount", "l_tax")
    ship = F.to_date("l_shipdate").alias("date")
    vol = {"A": "^VIX", "N": "^VIX9D", "R": "^VIX3M"}
    vol_symbol = F.expr("CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vol.items()) + " END")
    vix = li.groupBy(vol_symbol.alias("symbol"), ship).agg(
        F.when(F.count(F.lit(1)) > 1, F.round(20 + 200 * (F.avg("l_discount") - 0.05), 4)).alias("close")
    )
    rate_symbol = F.when(F.col("l_linestatus") == "F", "^TNX").otherwise("^IRX")
    rates = li.groupBy(rate_symbol.alias("symbol"), ship).agg(F.round(100 * F.avg("l_tax"), 4).alias("close"))
    return funds.unionByName(spy).unionByName(vix).unionByName(rates)


SERIES = f"""series AS (
  SELECT {_FUNDS}[n_regionkey + 1] AS symbol, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
  UNION ALL SELECT 'SPY', CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice), 6) FROM orders GROUP BY d
  UNION ALL SELECT CASE l_returnflag WHEN 'A' THEN '^VIX' WHEN 'N' THEN '^VIX9D' WHEN 'R' THEN '^VIX3M' END AS s,
    CAST(l_shipdate AS DATE) AS d,
    CASE WHEN count(*) > 1 THEN round(20 + 200 * (avg(l_discount) - 0.05::DOUBLE), 4) END FROM lineitem GROUP BY s, d
  UNION ALL SELECT CASE l_linestatus WHEN 'F' THEN '^TNX' ELSE '^IRX' END AS s, CAST(l_shipdate AS DATE) AS d,
    round(100 * avg(l_tax), 4) FROM lineitem GROUP BY s, d)"""

_SECTOR_OF = {
    "1-URGENT": "Technology",
    "2-HIGH": "Health Care",
    "3-MEDIUM": "Energy",
    "4-NOT SPECIFIED": "Unlisted",
    "5-LOW": "Financial Services",
}
_SECTOR_CASE = "CASE ticker " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTOR_OF.items()) + " END"


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per ticker of `bars` with its sector."""
    t = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("ticker")).distinct()
    return t.select("ticker", F.expr(_SECTOR_CASE).alias("sector"))


ASSETS = f"""assets AS (SELECT ticker, {_SECTOR_CASE} AS sector
  FROM (SELECT DISTINCT o_orderpriority AS ticker FROM orders))"""


# --- options ----------------------------------------------------------------------

_CONTRACT = {
    "ticker": "p_brand",
    "snapshot_date": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "expiry": "CAST(date_trunc('month', l_shipdate) AS DATE) + 7 * l_linenumber",
    "side": "CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END",
    "strike": "p_retailprice",
    "iv": "round(3 * l_discount, 4)",
    "volume": "l_quantity - 1",
    "open_interest": "round(250 * l_tax, 0)",
    "bid": "round(l_extendedprice / 1000, 4)",
    "ask": "round(l_extendedprice / 1000 * (1 + 10 * l_tax), 4)",
}


def option_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as option quotes on their part's brand, grouped into monthly snapshots."""
    li = read(spark, sf, "lineitem")
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    spark_sql = {**_CONTRACT, "expiry": "date_add(CAST(date_trunc('month', l_shipdate) AS DATE), 7 * l_linenumber)"}
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(*[f"{e} AS {k}" for k, e in spark_sql.items()])


CHAIN = (
    "chain AS (SELECT "
    + ", ".join(f"{e} AS {k}" for k, e in _CONTRACT.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey)"
)


def option_spot(spark: SparkSession, sf: str) -> DataFrame:
    return option_chain(spark, sf).groupBy("ticker", "snapshot_date").agg(F.round(F.avg("strike"), 6).alias("spot"))


SPOT = "spot AS (SELECT ticker, snapshot_date, round(avg(strike), 6) AS spot FROM chain GROUP BY ALL)"


# --- fundamentals -----------------------------------------------------------------

_SECTORS = ["Technology", "Health Care", "Financials", "Energy", "Utilities"]
# Figures of one brand, as text; brands with few small parts report none for some keys.
_FIGURES = {
    "trailingPE": "CAST(round(avg(p_size), 4) AS {s})",
    "forwardPE": "CAST(round(avg(p_retailprice) / 50, 4) AS {s})",
    "priceToBook": "CASE WHEN min(p_size) > 1 THEN 'N/A' ELSE CAST(round(max(p_retailprice) / 100, 4) AS {s}) END",
    "enterpriseToEbitda": "CAST(round(stddev_pop(p_size), 4) AS {s})",
    "profitMargins": "CAST(round(avg(p_size) / 200, 4) AS {s})",
    "freeCashflow": "CAST(round(sum(p_retailprice) * 10, 2) AS {s})",
    "marketCap": "CASE WHEN count(*) > 2 THEN CAST(round(sum(p_retailprice) * 1000, 2) AS {s}) ELSE 'Infinity' END",
    "sector": "max(sector)",
}


def company_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON payload of text figures per brand."""
    part = read(spark, sf, "part")
    no = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    part = part.withColumn("sector", F.element_at(F.array(*[F.lit(s) for s in _SECTORS]), no % 5 + 1))
    agg = part.groupBy(F.col("p_brand").alias("ticker")).agg(
        *[F.expr(e.format(s="string")).alias(k) for k, e in _FIGURES.items()]
    )
    return agg.select("ticker", F.to_json(F.struct(*_FIGURES)).alias("payload"))


COMPANIES = (
    "companies_raw AS (SELECT p_brand AS ticker, "
    + ", ".join(f"{e.format(s='VARCHAR')} AS {k}" for k, e in _FIGURES.items())
    + f" FROM (SELECT *, {_SECTORS}[CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 + 1] AS sector FROM part)"
    + " GROUP BY p_brand),\n"
    + "companies AS (SELECT ticker, sector, "
    + ", ".join(
        f"CASE WHEN isfinite(TRY_CAST({k} AS DOUBLE)) THEN TRY_CAST({k} AS DOUBLE) END AS {k}"
        for k in _FIGURES
        if k != "sector"
    )
    + " FROM companies_raw)"
)


def earnings_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly figures per ticker of `bars`, announced on the 15th of the month after the quarter's start."""
    o = read(spark, sf, "orders")
    q = F.date_trunc("quarter", F.col("o_orderdate"))
    a = o.groupBy(F.col("o_orderpriority").alias("ticker"), q.alias("q")).agg(
        F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / 1e5, 4).alias("Reported EPS actual"),
        F.round(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))) / 1e5, 4).alias("EPS Estimate"),
    )
    return a.select("ticker", F.date_add(F.to_date("q"), 45).alias("announced"), "Reported EPS actual", "EPS Estimate")


EARNINGS = """earnings_raw AS (
  SELECT o_orderpriority AS ticker, date_trunc('quarter', o_orderdate) AS q,
    round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 1e5::DOUBLE, 4) AS act,
    round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 1e5::DOUBLE, 4) AS est
  FROM orders GROUP BY ALL),
earnings AS (SELECT ticker, CAST(q AS DATE) + 45 AS announced, act AS actual_eps, est AS estimated_eps,
    (act - est) / nullif(abs(est), 0) AS surprise_pct FROM earnings_raw WHERE act IS NOT NULL AND est IS NOT NULL)"""


# --- portfolios -------------------------------------------------------------------

_HOLDING = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1]"


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as holdings: one portfolio per nation, value = positive balance; one asset is held in shares."""
    c = read(spark, sf, "customer")
    tick = F.element_at(F.array(*[F.lit(t) for t in _SECTOR_OF]), (F.col("c_custkey") % 5 + 1).cast("int"))
    g = c.groupBy(F.col("c_nationkey").alias("portfolio_id"), tick.alias("ticker")).agg(
        F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("v"), F.count(F.lit(1)).cast("double").alias("n")
    )
    by_shares = F.col("ticker") == "5-LOW"
    return g.select(
        "portfolio_id", "ticker",
        F.lit(None).cast("double").alias("weight"),
        F.when(~by_shares, F.col("v")).alias("market_value"),
        F.when(by_shares, F.col("n") / 100).alias("shares"),
    )


POSITIONS = f"""positions AS (
  SELECT c_nationkey AS portfolio_id, {_HOLDING} AS ticker, sum(greatest(c_acctbal, 0)) AS v, CAST(count(*) AS DOUBLE) AS n
  FROM customer GROUP BY ALL)"""


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of a rise per ticker: share of finished orders; the ticker with the smallest share has none."""
    o = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("ticker")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("p_bullish")
    )
    return o.join(o.agg(F.min("p_bullish").alias("least")), F.col("p_bullish") > F.col("least")).drop("least")


PROBS = """probs AS (SELECT o_orderpriority AS ticker, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS p
  FROM orders GROUP BY 1 QUALIFY p > min(p) OVER ())"""


# --- news -------------------------------------------------------------------------

NOW = "2026-06-01 12:00:00"
_DOMAINS = ["reuters.com", "cnbc.com", "seekingalpha.com", "nytimes.com", "reddit.com", "Fool.com", "example.net", "ft.com"]
# Text of the date of an article; k is its age in days.
_DAY = "CAST(date_sub(DATE '2026-06-01', CAST(doc_id % 12 AS INT)) AS {s})"
_DAY_SQL = "CAST(DATE '2026-06-01' - CAST(doc_id % 12 AS INTEGER) AS VARCHAR)"


def _news_columns(day: str, first_line: str, source_no: str, element: str, s: str) -> dict[str, str]:
    """Expressions shared by both engines; the five date formats and their place rotate with the document."""
    us = f"concat(substr({day}, 6, 2), '/', substr({day}, 9, 2), '/', substr({day}, 1, 4))"
    eu = f"concat(substr({day}, 9, 2), '.', substr({day}, 6, 2), '.', substr({day}, 1, 4))"
    long = f"concat('May ', substr({day}, 9, 2), ', 2026')"
    kind = "doc_id % 8"
    title = f"CASE WHEN {kind} = 3 THEN concat({first_line}, ' ', {us}) ELSE {first_line} END"
    body = (
        f"CASE {kind} WHEN 2 THEN concat({long}, ' ', text) WHEN 4 THEN concat({eu}, ' ', text) "
        f"WHEN 5 THEN concat(CAST(doc_id % 12 AS {s}), ' days ago ', text) ELSE text END"
    )
    meta_date = f"CASE {kind} WHEN 0 THEN concat({day}, 'T09:30:00Z') WHEN 1 THEN {day} END"
    meta_pub = f"CASE {kind} WHEN 6 THEN concat({day}, 'T09:41+02:00') END"
    return {
        "doc_id": "doc_id",
        "ticker": "upper(lang)",
        "query_idx": "CAST(doc_id % 3 AS INT)",
        "result_idx": "doc_id",
        "title": title,
        "url": f"concat('https://www.', {element}, '/a/', CAST(doc_id AS {s}), '/')",
        "body": body,
        "meta_date": meta_date,
        "meta_pub": meta_pub,
    }


def raw_news(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as search results: title = first line, domain by source, a date in rotating formats."""
    arr = "array(" + ", ".join(f"'{d}'" for d in _DOMAINS) + ")"
    no = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT)"
    cols = _news_columns(_DAY.format(s="string"), "substring_index(text, '\n', 1)", no, f"element_at({arr}, {no} % 8 + 1)", "string")
    df = read(spark, sf, "documents").selectExpr(*[f"{e} AS {k}" for k, e in cols.items()])
    meta = F.map_filter(
        F.create_map(F.lit("date"), F.col("meta_date"), F.lit("published"), F.col("meta_pub")), lambda k, v: v.isNotNull()
    )
    return df.withColumn("metadata", meta).drop("meta_date", "meta_pub")


_NO_SQL = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)"
NEWS = (
    "raw_news AS (SELECT "
    + ", ".join(
        f"{e} AS {k}"
        for k, e in _news_columns(
            _DAY_SQL, "split_part(text, chr(10), 1)", _NO_SQL, f"{_DOMAINS}[{_NO_SQL} % 8 + 1]", "VARCHAR"
        ).items()
    )
    + " FROM documents)"
)


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as listed symbols with mixed suffixes, names and quote types."""
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return p.selectExpr(*[f"{e} AS {k}" for k, e in _LISTING.items()])


_LISTING = {
    "p_partkey": "p_partkey",
    "ticker": "concat(' x', CAST(p_partkey AS {s}), CASE p_size % 7 WHEN 0 THEN '-usd' WHEN 1 THEN '.NS' WHEN 2 THEN '.B' "
    "WHEN 3 THEN '-eth' WHEN 4 THEN '-PERP' ELSE '' END, ' ')",
    "short_name": "CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN '' END",
    "long_name": "CASE WHEN p_size % 5 < 3 THEN concat(p_name, ' ') WHEN p_size % 5 = 3 THEN '  ' END",
    "quote_type": "CASE p_type WHEN 'ECONOMY' THEN 'etf' WHEN 'STANDARD' THEN 'MutualFund' WHEN 'PROMO' THEN 'INDEX' "
    "WHEN 'SMALL' THEN ' CURRENCY' ELSE 'OTHER' END",
}
LISTING = "listing AS (SELECT " + ", ".join(f"{e.format(s='VARCHAR')} AS {k}" for k, e in _LISTING.items()) + " FROM part)"
_LISTING = {k: e.format(s="string") for k, e in _LISTING.items()}
