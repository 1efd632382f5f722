"""Registered queries for text functions, news, fusion and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerweave.functions import text as tx
from tickerweave.functions.core import rnd
from tickerweave.operators import fusion, news, retrieval, technical
from tickerweave.operators.sector import lookup
from tickerweave.plans import inputs as i
from tickerweave.plans.inputs import r, with_ctes
from tickerweave.sources import assets as asrc

_SP = tx.SPACE


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_SP}+'), lambda w: w <> '')"


def _case(table: dict, key: str, default: str) -> str:
    body = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in table.items())
    return f"CASE {key} {body} ELSE {default} END"


_CRED = _case({**news.TIER2, **news.TIER1}, "lower(domain)", "0.55::DOUBLE")
_BLOCKED = ", ".join(f"'{b}'" for b in news.BLOCKED)
_CLEAN = f"""c0 AS (SELECT doc_id, ticker, query_idx, result_idx, {_trim('title')} AS title, {_trim('url')} AS url,
  left(body, 400) AS snippet, meta_date, meta_pub FROM raw_news),
c1 AS (SELECT *, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS domain FROM c0),
clean AS (SELECT *, {_CRED} AS credibility FROM c1 WHERE title <> '' AND url <> '' AND lower(domain) NOT IN ({_BLOCKED})
  AND len({_words('snippet')}) >= 10)"""
_FP = "left(md5(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')), 12)"
_DEDUP = f"""fp AS (SELECT *, {_FP} AS fingerprint FROM clean),
uniq AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY ticker, fingerprint ORDER BY query_idx, result_idx) = 1),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY credibility DESC, query_idx, result_idx) AS INTEGER) AS source_rank
  FROM uniq QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY credibility DESC, query_idx, result_idx) <= 8)"""


def _text_date(c: str) -> tuple[str, str]:
    iso = f"TRY_CAST(regexp_extract({c}, '{tx.ISO_DATE}', 1, 'i') AS TIMESTAMP)"
    long_ = f"regexp_extract({c}, '{tx.LONG_DATE}', 1, 'i')"
    lts = (
        f"try_strptime(regexp_replace(replace({long_}, ',', ''), '^([A-Za-z]{{3}})[A-Za-z]*\\.?\\s+(\\d+)\\s+(\\d+)$', '\\1 \\2 \\3'), '%b %d %Y')"
    )
    us = f"try_strptime(regexp_extract({c}, '{tx.US_DATE}', 1, 'i'), '%m/%d/%Y')"
    eu = f"try_strptime(regexp_extract({c}, '{tx.EU_DATE}', 1, 'i'), '%d.%m.%Y')"
    unit = f"lower(regexp_extract({c}, '{tx.RELATIVE}', 2, 'i'))"
    rel = (
        f"(TIMESTAMP '{i.NOW}' - to_hours(TRY_CAST(regexp_extract({c}, '{tx.RELATIVE}', 1, 'i') AS INTEGER) * "
        f"CASE {unit} WHEN 'hour' THEN 1 WHEN 'day' THEN 24 WHEN 'week' THEN 168 WHEN 'month' THEN 720 END))"
    )
    ts = f"coalesce({iso}, {lts}, {us}, {eu}, {rel})"
    kind = (
        f"CASE WHEN {iso} IS NOT NULL THEN 'snippet_numeric' WHEN {lts} IS NOT NULL THEN 'snippet_long_date' "
        f"WHEN coalesce({us}, {eu}) IS NOT NULL THEN 'snippet_numeric' WHEN {rel} IS NOT NULL THEN 'relative_text' END"
    )
    return ts, kind


_SN, _TI = _text_date("snippet"), _text_date("title")
_META = """coalesce(TRY_CAST(replace(replace(meta_date, 'Z', ''), 'T', ' ') AS TIMESTAMP),
  TRY_CAST(replace(left(meta_pub, 16), 'T', ' ') AS TIMESTAMP) - INTERVAL 2 HOUR)"""


def _dated(src: str) -> str:
    return f"""dated0 AS (SELECT *, {_META} AS m, {_SN[0]} AS s, {_SN[1]} AS sk, {_TI[0]} AS t, {_TI[1]} AS tk FROM {src}),
dated AS (SELECT *, coalesce(m, s, t) AS published_at, CASE WHEN m IS NOT NULL THEN 'metadata' WHEN s IS NOT NULL THEN 'snippet/' || sk
  WHEN t IS NOT NULL THEN 'title/' || tk ELSE 'unknown' END AS date_source FROM dated0)"""


def _audit(limit: int, policy: str) -> str:
    ok = "false" if policy == "reject" else "true"
    pen = "0.5::DOUBLE" if policy == "accept_with_penalty" else "1.0::DOUBLE"
    miss = "Publish date could not be determined and unknown_date_policy=reject." if policy == "reject" else ""
    age = f"(epoch(TIMESTAMP '{i.NOW}') - epoch(published_at)) / 86400"
    fresh = f"published_at >= TIMESTAMP '{i.NOW}' - INTERVAL {limit} DAY"
    return f"""audited AS (SELECT *, round({age}, 1) AS age_days, CASE WHEN published_at IS NULL THEN {ok} ELSE {fresh} END AS kept,
  CASE WHEN published_at IS NULL THEN {pen} ELSE 1.0::DOUBLE END AS penalty,
  CASE WHEN published_at IS NULL THEN '{miss}' WHEN NOT {fresh} THEN printf('Age %.1fd exceeds max_age={limit}d (published %s).',
    {age}, strftime(published_at, '%Y-%m-%d')) ELSE '' END AS reason FROM dated)"""


def _hits(words: list[str], c: str = "tx") -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in words) + ")"


def _scored(src: str) -> str:
    return f"""h AS (SELECT *, {_hits(news.BULLISH)} AS b, {_hits(news.BEARISH)} AS d, {_hits(news.SEVERE)} AS v
  FROM (SELECT *, lower(title || ' ' || snippet) AS tx FROM {src})),
h1 AS (SELECT * EXCLUDE (tx), CASE WHEN b > d THEN 'positive' WHEN d > b THEN 'negative' ELSE 'neutral' END AS sentiment,
  round(CASE WHEN b > d THEN b / (b + d) WHEN d > b THEN -d / (b + d) ELSE 0.0::DOUBLE END, 3) + 0.0::DOUBLE AS sentiment_score,
  round(least(1.0::DOUBLE, v / 3.0::DOUBLE), 3) AS severity_score FROM h),
scored AS (SELECT *, round(round(credibility * 0.4::DOUBLE + severity_score * 0.3::DOUBLE + abs(sentiment_score) * 0.3::DOUBLE, 9), 3) * penalty AS final_weight FROM h1)"""


def _raw(spark, sf):
    return i.raw_news(spark, sf)


def _clean(spark, sf):
    return news.clean_news(_raw(spark, sf))


_KEYS = ["doc_id", "ticker"]


def _hygiene(spark, sf):
    return _clean(spark, sf).select(*_KEYS, "title", F.md5("snippet").alias("snippet_md5"), "url", "domain", rnd("credibility").alias("credibility"))


def _dates(spark, sf):
    df = _clean(spark, sf)
    ts, src = tx.article_date("metadata", "snippet", "title", F.lit(i.NOW).cast("timestamp_ntz"))
    return df.select(*_KEYS, ts.alias("published_at"), src.alias("date_source"), tx.format_iso(ts).alias("iso"))


def _audit_q(spark, sf):
    a = news.recency_audit(_clean(spark, sf), i.NOW, "7d", policy="accept_with_penalty")
    return a.select(*_KEYS, "published_at", "date_source", "age_days", F.col("kept").cast("int").alias("kept"), "penalty", "reason")


def _rescue(spark, sf):
    a = news.recency_audit(_clean(spark, sf), i.NOW, max_age_days=0)
    a = news.rescue_newest(a, 40)
    return a.select(*_KEYS, F.col("kept").cast("int").alias("kept"), "reason")


_RESCUE_SQL = with_ctes(
    i.NEWS, _CLEAN, _dated("clean"), _audit(0, "reject"),
    "k AS (SELECT *, sum(CAST(kept AS INTEGER)) OVER (PARTITION BY ticker) AS nk, row_number() OVER (PARTITION BY ticker, kept "
    "ORDER BY published_at DESC NULLS LAST, query_idx, result_idx) AS rn FROM audited)",
    select="""SELECT doc_id, ticker, CAST(kept OR rn <= 40 - nk AS INTEGER) AS kept,
      CASE WHEN NOT kept AND rn <= 40 - nk THEN 'Rescued to satisfy min_kept=40.' ELSE reason END AS reason FROM k""",
)


def _scores(spark, sf):
    a = news.score_articles(_clean(spark, sf))
    return a.select(*_KEYS, "sentiment", "sentiment_score", "severity_score", rnd("final_weight").alias("final_weight"))


def _ranked(spark, sf):
    """Articles in the order of their composite weight."""
    a = news.score_articles(news.most_credible(news.first_by_title(_clean(spark, sf))))
    w = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("final_weight").desc(), "source_rank"))
    return a.select(*_KEYS, "source_rank", rnd("final_weight").alias("final_weight"), w.alias("weight_rank"))


def _headline(spark, sf):
    d = i.read(spark, sf, "documents")
    label, score = news.headline_sentiment(F.col("text"))
    return d.select("doc_id", label.alias("sentiment"), score.alias("score"))


def _tokens(words):
    lst = ", ".join(f"'{w}'" for w in words)
    return f"len(list_intersect(list_distinct(tk), [{lst}]))"


_HEADLINE_SQL = f"""WITH t AS (SELECT doc_id, {_words('lower(text)')} AS tk FROM documents),
c AS (SELECT doc_id, CAST({_tokens(news.BULLISH_WORDS)} AS DOUBLE) AS b, CAST({_tokens(news.BEARISH_WORDS)} AS DOUBLE) AS d FROM t),
s AS (SELECT doc_id, (b - d) / greatest(b + d, 1) AS s FROM c)
SELECT doc_id, CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment,
  round(s, 3) + 0.0::DOUBLE AS score FROM s"""


def _briefs(spark, sf):
    raw = _raw(spark, sf)
    tick = raw.select("ticker").distinct().unionByName(i.read(spark, sf, "region").select(F.col("r_name").alias("ticker")))
    return news.build_briefs(raw, tick, i.NOW, "7d")


_BRIEF = ["ticker", "situation_summary", "aggregate_sentiment", "sentiment_score", "source_quality_note", "articles_retrieved",
          "articles_kept", "recency_note"]


def _brief_rows(spark, sf):
    return _briefs(spark, sf).select(*_BRIEF, F.col("retrieval_success").cast("int").alias("retrieval_success"))


_EXTRACT = f"""CASE WHEN length(body) >= 40 THEN title || ': ' || regexp_replace(regexp_replace(left(body, 180), ' [^ ]*$', ''), '[.,;]+$', '') || '.'
  ELSE regexp_replace(trim(title), '\\.+$', '') || '.' END"""
_BRIEF_CTES = (
    i.NEWS, _CLEAN, _DEDUP, _dated("top"), _audit(7, "reject"), _scored("audited"),
    f"""ord AS (SELECT *, trim(regexp_replace(snippet, '{_SP}+', ' ', 'g')) AS body, row_number() OVER (PARTITION BY ticker, kept ORDER BY final_weight DESC, source_rank) AS fr FROM scored)""",
    f"""agg AS (SELECT ticker, count(*) AS got, count(*) FILTER (WHERE kept) AS n, count(*) FILTER (WHERE kept AND credibility >= 0.9) AS t1,
      sum(CASE WHEN kept THEN sentiment_score * final_weight END) / nullif(sum(CASE WHEN kept THEN final_weight END), 0) AS sc,
      string_agg(CASE WHEN kept AND fr <= 3 THEN {_EXTRACT} END, ' ' ORDER BY fr) AS ex FROM ord GROUP BY ticker)""",
    "ticks AS (SELECT DISTINCT ticker FROM raw_news UNION SELECT r_name FROM region)",
    """b0 AS (SELECT ticks.ticker, coalesce(got, 0) AS got, coalesce(n, 0) AS n, coalesce(t1, 0) AS t1, ex,
      CASE WHEN coalesce(n, 0) > 0 THEN round(coalesce(sc, 0), 3) + 0.0::DOUBLE ELSE 0.0::DOUBLE END AS sc FROM ticks LEFT JOIN agg USING (ticker))""",
    """briefs AS (SELECT *, CASE WHEN sc > 0.10 THEN 'positive' WHEN sc < -0.10 THEN 'negative' ELSE 'neutral' END AS mood,
      printf('max age 7d; %d article(s) discarded as stale or undated', got - n) AS note FROM b0)""",
)
_BRIEF_SQL = with_ctes(
    *_BRIEF_CTES,
    select="""SELECT ticker, CASE WHEN n > 0 THEN 'Market sentiment for ' || ticker || ' is ' || mood || ' based on ' || n ||
      ' source-weighted, recency-filtered articles (' || note || '). ' || ex
      ELSE 'No reliable financial news retrieved for this ticker within the recency window. ' || note END AS situation_summary,
      mood AS aggregate_sentiment, sc AS sentiment_score, CASE WHEN n > 0 THEN t1 || '/' || n || ' articles from Tier-1 institutional sources.' ELSE '' END
      AS source_quality_note, got AS articles_retrieved, n AS articles_kept, note AS recency_note, CAST(n > 0 AS INTEGER) AS retrieval_success FROM briefs""",
)


def _signals(spark, sf):
    """Model probabilities per news ticker from the labels: share of good documents; region names have no news."""
    d = i.read(spark, sf, "documents").join(i.read(spark, sf, "labels"), "doc_id")
    s = d.groupBy(F.upper("lang").alias("ticker")).agg(F.round(F.avg("quality"), 4).alias("p_bullish"))
    n = i.read(spark, sf, "nation").groupBy("n_regionkey").agg((F.count(F.lit(1)) / 8.0).alias("p_bullish"))
    reg = i.read(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return fusion.predicted_side(s.unionByName(reg.select(F.col("r_name").alias("ticker"), "p_bullish")))


_SIGNALS = """sig0 AS (SELECT upper(lang) AS ticker, round(avg(quality), 4) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1
  UNION ALL SELECT r_name, count(*) / 8.0::DOUBLE FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name),
sig AS (SELECT *, CASE WHEN abs(p - 0.5) > 0.15 THEN 'high' WHEN abs(p - 0.5) > 0.05 THEN 'moderate' ELSE 'low' END AS conf,
  CASE WHEN p >= 0.5 THEN 'BULLISH' ELSE 'BEARISH' END AS dir FROM sig0)"""


def _fusion(spark, sf):
    return fusion.rule_fusion(_signals(spark, sf), _briefs(spark, sf))


_FUSION_SQL = with_ctes(
    *_BRIEF_CTES, _SIGNALS,
    """f AS (SELECT sig.*, mood, sc, n > 0 AS has, abs(sc) >= 0.30 AND n > 0 AS strong, (mood = 'positive') = (dir = 'BULLISH') AS agree
      FROM sig LEFT JOIN briefs USING (ticker))""",
    """g AS (SELECT *, CASE WHEN strong AND NOT agree THEN 'NEUTRAL' ELSE dir END AS fd FROM f)""",
    select="""SELECT ticker, dir AS ml_direction, round(p, 4) AS ml_probability, fd AS final_direction,
      CASE WHEN strong AND agree THEN 'MODERATE' WHEN strong THEN 'LOW' ELSE upper(conf) END AS final_confidence,
      CASE WHEN strong AND NOT agree THEN 0.5::DOUBLE ELSE round(p, 4) END AS fusion_probability, coalesce(mood, 'neutral') AS news_sentiment,
      CASE WHEN has THEN printf('Rule-based fusion (LLM unavailable). ML signal: %s (p=%.4f). News sentiment: %s (score=%+.3f). Final: %s.', dir, round(p, 4), mood, sc, fd)
      ELSE 'ML-only signal — news fusion unavailable.' END AS narrative FROM g""",
)


def _confidence(spark, sf):
    return _signals(spark, sf)


_CONF_SQL = with_ctes(
    _SIGNALS,
    select="""SELECT ticker, p AS p_bullish, CAST(p >= 0.5 AS INTEGER) AS prediction, CASE WHEN p >= 0.5 THEN 'BULLISH (UP)' ELSE 'BEARISH (DOWN)' END AS direction,
      round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS side_probability, conf AS confidence_label FROM sig""",
)


def _narrative(spark, sf):
    """Driver sentences; attributions are scaled deviations of event values by type."""
    e = i.read(spark, sf, "events")
    d = e.groupBy(F.concat(F.lit("U"), (F.col("user_id")).cast("string")).alias("ticker"), F.col("event_type").alias("feature")).agg(
        F.round((F.avg("value") - 50) / 100, 4).alias("attribution")
    )
    s = e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).agg(
        F.round(F.avg((F.col("value") > 30).cast("double")), 3).alias("p_bullish")
    )
    return fusion.prediction_narrative(fusion.predicted_side(s), d)


_NARR_SQL = """WITH d AS (SELECT 'U' || user_id AS ticker, event_type AS feature, round((avg(value) - 50) / 100, 4) AS a FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, a > 0 ORDER BY abs(a) DESC, feature) AS k FROM d),
l AS (SELECT ticker, string_agg(printf('%s (%+.4f)', feature, a), ', ' ORDER BY k) FILTER (WHERE a > 0) AS up,
  string_agg(printf('%s (%+.4f)', feature, a), ', ' ORDER BY k) FILTER (WHERE a <= 0) AS dn FROM k WHERE k <= 3 GROUP BY ticker),
s AS (SELECT 'U' || user_id AS ticker, round(avg(CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0 END), 3) AS p FROM events GROUP BY ALL)
SELECT ticker, concat_ws('  ', printf('[%s] Prediction: %s (Probability: %.1f%%, Confidence: %s)', ticker,
  CASE WHEN p >= 0.5 THEN 'BULLISH (UP)' ELSE 'BEARISH (DOWN)' END, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) * 100,
  CASE WHEN abs(p - 0.5) > 0.15 THEN 'high' WHEN abs(p - 0.5) > 0.05 THEN 'moderate' ELSE 'low' END),
  '• Bullish: ' || up || '.', '• Bearish headwinds: ' || dn || '.') AS narrative FROM s LEFT JOIN l USING (ticker)"""


def _formats(spark, sf):
    o = i.read(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.round(F.col("o_totalprice") / 1e6, 4).alias("p"))
    return o.select(
        "o_orderkey", tx.fmt_pct(F.round("p", 3)).alias("pct"), tx.fmt_raw("p").alias("raw"), tx.fmt_price("o_totalprice").alias("price"),
        tx.fmt_signed(F.col("p") - 0.25).alias("signed"), tx.fmt_duration("o_totalprice").alias("duration"),
    )


_FORMATS_SQL = """SELECT o_orderkey, printf('%.1f%%', round(p, 3) * 100) AS pct, printf('%.4f', p) AS raw, format('${:,.2f}', o_totalprice) AS price,
  printf('%+.4f', p - 0.25) AS signed, printf('%.2fs', o_totalprice) AS duration
  FROM (SELECT *, round(o_totalprice / 1e6::DOUBLE, 4) AS p FROM orders)"""


def _rounding(spark, sf):
    """Fixed decimal places by kind of value: metrics 4, prices 2, sentiment 3; and the scalar functions around them."""
    e = i.read(spark, sf, "events")
    v = F.col("value")
    return e.select(
        "event_id", F.round(v / 97, 4).alias("metric"), F.round(v * 1.37, 2).alias("price_2dp"), rnd(F.sin(v), 3).alias("sentiment_3dp"),
        rnd(F.ln(v + 1)).alias("ln_v"), rnd(F.sqrt(F.abs(v))).alias("sqrt_v"), rnd(F.exp(-v / 50)).alias("exp_v"),
        F.signum(v - 20).alias("sign_v"), F.when(v.isNotNull(), F.greatest(F.lit(10.0), F.least(v, F.lit(60.0)))).alias("clip_v"), rnd(F.pow(v, F.lit(1.5)), 4).alias("pow_v"),
    )


_ROUNDING_SQL = f"""SELECT event_id, round(value / 97, 4) AS metric, round(value * 1.37::DOUBLE, 2) AS price_2dp, {r('sin(value)', 3)} AS sentiment_3dp,
  {r('ln(value + 1)')} AS ln_v, {r('sqrt(abs(value))')} AS sqrt_v, {r('exp(-value / 50)')} AS exp_v, CAST(sign(value - 20) AS DOUBLE) AS sign_v,
  CASE WHEN value IS NOT NULL THEN greatest(10.0::DOUBLE, least(value, 60.0::DOUBLE)) END AS clip_v, {r('pow(value, 1.5)', 4)} AS pow_v FROM events"""


def _iso(spark, sf):
    """Instants written as text in three styles and read back."""
    e = i.read(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("t"))
    txt = F.when(F.col("event_id") % 3 == 0, tx.format_iso("t")).when(
        F.col("event_id") % 3 == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm'-05:30'"))
    return e.select("event_id", txt.alias("text")).select("event_id", "text", tx.parse_iso("text").alias("instant"))


_ISO_SQL = """WITH t AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ')
  ELSE strftime(t, '%Y-%m-%dT%H:%M-05:30') END AS text,
  CASE WHEN event_id % 3 = 2 THEN date_trunc('minute', t) + INTERVAL 330 MINUTE ELSE t END AS instant FROM t"""


def _urls(spark, sf):
    p = i.read(spark, sf, "pages")
    u = F.concat(F.lit(" "), "url", F.lit("// "))
    return p.select("page_id", tx.host("url").alias("host"), tx.normal_url(u).alias("normal_url"), tx.valid_url("url").cast("int").alias("valid"))


_URLS_SQL = """SELECT page_id, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host,
  rtrim(trim(url || '//'), '/') AS normal_url, CAST(regexp_matches(url, '^https?://[^/?#]+') AS INTEGER) AS valid FROM pages"""


def _new_pages(spark, sf):
    p = i.read(spark, sf, "pages").select("page_id", "url")
    ingested = p.filter(F.col("url").contains("/en/")).select(F.concat("url", F.lit("/ ")).alias("url"))
    return retrieval.new_pages(p, ingested)


def _fingerprints(spark, sf):
    n = _raw(spark, sf)
    return n.select("doc_id", tx.fingerprint("title").alias("fingerprint"))


def _dedup(spark, sf):
    return news.first_by_title(_clean(spark, sf)).select("ticker", "fingerprint", "doc_id", "query_idx")


def _topk(spark, sf):
    return news.most_credible(news.first_by_title(_clean(spark, sf))).select(*_KEYS, rnd("credibility").alias("credibility"), "source_rank")


def _listing(spark, sf):
    l = i.listing(spark, sf)
    return asrc.resolve_assets(l).select(
        "ticker", "display_name", "asset_class", "source",
        *[F.col(c).cast("int").alias(c) for c in ("is_crypto", "is_equity", "is_macro")],
    )


def _bare_sql(t):
    parts = " ".join(f"WHEN ends_with({t}, '{s}') THEN left({t}, length({t}) - {len(s)})" for s in asrc.SUFFIXES)
    return f"CASE {parts} ELSE split_part({t}, '.', 1) END"


_PROFILES = f"""l0 AS (SELECT upper(trim(ticker)) AS t, coalesce(nullif(short_name, ''), long_name) AS nm, upper(trim(quote_type)) AS q FROM listing),
profiles AS (SELECT t AS ticker, CASE WHEN coalesce(trim(nm), '') = '' THEN {_bare_sql('t')} ELSE trim(nm) END AS display_name,
  CASE WHEN q IN ({', '.join(f"'{x}'" for x in asrc.QUOTE_TYPES)}) THEN q WHEN regexp_matches(t, '{asrc.CRYPTO_PAIR}') THEN 'CRYPTOCURRENCY' ELSE 'EQUITY' END AS asset_class,
  CASE WHEN coalesce(trim(nm), '') = '' THEN 'heuristic' ELSE 'listing' END AS source FROM l0)"""
_LISTING_SQL = with_ctes(
    i.LISTING, _PROFILES,
    select="""SELECT *, CAST(asset_class = 'CRYPTOCURRENCY' AS INTEGER) AS is_crypto, CAST(asset_class IN ('EQUITY', 'ETF', 'MUTUALFUND') AS INTEGER) AS is_equity,
      CAST(asset_class IN ('INDEX', 'FUTURE', 'CURRENCY') AS INTEGER) AS is_macro FROM profiles""",
)


def _phrases(spark, sf):
    return asrc.search_phrases(asrc.resolve_assets(i.listing(spark, sf)))


def _phrase_sql():
    def lst(cls):
        return "[" + ", ".join("'" + p + "'" for p in asrc.SEARCH_PHRASES[cls]) + "]"

    pick = f"""CASE WHEN asset_class = 'CRYPTOCURRENCY' THEN {lst('CRYPTOCURRENCY')} WHEN asset_class = 'ETF' THEN {lst('ETF')}
      WHEN asset_class = 'MUTUALFUND' THEN {lst('MUTUALFUND')} WHEN asset_class IN ('INDEX', 'FUTURE') THEN {lst('INDEX')}
      WHEN asset_class = 'CURRENCY' THEN {lst('CURRENCY')} ELSE {lst('EQUITY')} END"""
    return with_ctes(
        i.LISTING, _PROFILES,
        f"x AS (SELECT ticker, display_name, UNNEST([0, 1, 2]) AS query_idx, UNNEST({pick}) AS p FROM profiles)",
        select="SELECT ticker, query_idx, replace(replace(p, '{n}', display_name), '{t}', ticker) AS query FROM x",
    )


def _horizons(spark, sf):
    o = i.read(spark, sf, "orders").select(F.col("o_orderkey"), F.element_at(F.array(*[F.lit(x) for x in ("1d", "7d", "1m", "6m", "2y")]),
                                           (F.col("o_orderkey") % 5 + 1).cast("int")).alias("horizon"))
    return o.select("o_orderkey", "horizon", lookup(technical.HORIZONS, "horizon").alias("days"), news.time_limit(F.col("horizon")).alias("time_limit"))


_HORIZONS_SQL = """SELECT o_orderkey, horizon, CASE horizon WHEN '1d' THEN 1 WHEN '7d' THEN 5 WHEN '1m' THEN 21 WHEN '6m' THEN 126 END AS days,
  CASE horizon WHEN '1d' THEN 'd' WHEN '1m' THEN 'm' WHEN '6m' THEN 'm' ELSE 'w' END AS time_limit
  FROM (SELECT o_orderkey, ['1d', '7d', '1m', '6m', '2y'][o_orderkey % 5 + 1] AS horizon FROM orders)"""


def _replies(spark, sf):
    """Free-text replies around the JSON of events: fenced, prefixed, or broken."""
    e = i.read(spark, sf, "events").select("event_id", "value", "event_type", (F.col("event_id") % 4).alias("k"))
    obj = F.to_json(F.struct(F.col("event_type").alias("final_direction"), F.round(F.col("value") / 100, 4).alias("fusion_probability")))
    text = (
        F.when(F.col("k") == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(F.col("k") == 1, F.concat(F.lit("Here is it: "), obj, F.lit(" done")))
        .when(F.col("k") == 2, F.lit("no object here"))
        .otherwise(F.concat(F.lit("{broken: "), obj))
    )
    df = e.select("event_id", text.alias("reply"))
    good, bad = fusion.parse_replies(df, "reply", {"final_direction": F.lit("NEUTRAL"), "final_confidence": F.lit("LOW"), "fusion_probability": F.lit(0.5)})
    cols = ["event_id", "final_direction", "final_confidence", "fusion_probability"]
    return good.select(*cols, F.lit(0).alias("quarantined")).unionByName(
        bad.select("event_id", F.lit(None).cast("string").alias("final_direction"), F.lit(None).cast("string").alias("final_confidence"),
                   F.lit(None).cast("double").alias("fusion_probability"), F.lit(1).alias("quarantined"))
    )


_REPLIES_SQL = """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS final_direction, CASE WHEN event_id % 4 < 2 THEN 'LOW' END AS final_confidence,
  CASE WHEN event_id % 4 < 2 THEN coalesce(round(value / 100, 4), 0.5) END AS fusion_probability, CAST(event_id % 4 >= 2 AS INTEGER) AS quarantined FROM events"""


def _glossary(spark, sf):
    """Descriptions of every feature name, of names derived from them and of unknown ones."""
    p = i.read(spark, sf, "part").select("p_partkey", "p_name")
    names = [*technical.TECHNICAL_FEATURES, "rsi_14_lag", "macd_x", "obv_z"]
    f = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 11 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(f)
    return p.select("p_partkey", name.alias("feature")).select("p_partkey", "feature", fusion.describe_feature(F.col("feature")).alias("description"))


def _glossary_sql():
    names = [*technical.TECHNICAL_FEATURES, "rsi_14_lag", "macd_x", "obv_z"]
    exact = " ".join(f"WHEN feature = '{k}' THEN '{v}'" for k, v in fusion.GLOSSARY.items())
    pre = " ".join(f"WHEN starts_with(feature, '{k}') THEN '{v}'" for k, v in fusion.GLOSSARY.items())
    return f"""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN replace(p_name, ' ', '_') ELSE {names}[p_partkey % {len(names)} + 1] END AS feature FROM part)
    SELECT p_partkey, feature, CASE {exact} {pre} ELSE 'Quantitative indicator derived from price and volume data (' || trim(replace(feature, '_', ' ')) || ').' END AS description FROM f"""


def _chunks(spark, sf):
    c = retrieval.chunk(i.read(spark, sf, "documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk_index", "word_start", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


_CHUNKS_SQL = f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents),
s AS (SELECT doc_id, w, UNNEST(range(0, len(w), 448)) AS word_start FROM w),
c AS (SELECT doc_id, word_start, array_to_string(w[word_start + 1:word_start + 512], ' ') AS content FROM s)
SELECT doc_id, CAST(word_start / 448 AS INTEGER) AS chunk_index, CAST(word_start AS INTEGER) AS word_start, md5(content) AS content_md5,
  CAST(length(content) AS INTEGER) AS n_chars FROM c"""


def _centroids(spark, sf):
    e = i.read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    c = e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    v = c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return v.select(F.col("label").alias("query_id"), F.col("s.x").alias("vector"))


def _search(spark, sf):
    h = retrieval.search(_centroids(spark, sf), i.read(spark, sf, "embeddings"), block_rows=5_000)
    return h.select("query_id", "vec_id", rnd("score", 4).alias("score"), "rank")


_SEARCH = """u AS (SELECT label, UNNEST(range(1, 65)) AS pos, UNNEST(embedding::DOUBLE[]) AS x FROM embeddings),
cu AS (SELECT label, pos, round(avg(x), 6) AS x FROM u GROUP BY ALL),
q AS (SELECT label AS query_id, list(x ORDER BY pos) AS v FROM cu GROUP BY label),
sc AS (SELECT query_id, vec_id, list_inner_product(v, embedding::DOUBLE[]) AS score FROM q, embeddings),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM sc
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 5)"""


def _context(spark, sf):
    h = retrieval.search(_centroids(spark, sf), i.read(spark, sf, "embeddings"), block_rows=5_000)
    d = i.read(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), "source",
        F.when(F.col("doc_id") % 2 == 0, F.substring_index("text", "\n", 1)).alias("title"),
    )
    return retrieval.context_block(h, d)


_CONTEXT_SQL = "WITH " + _SEARCH + """,
d AS (SELECT doc_id AS vec_id, text AS content, source, CASE WHEN doc_id % 2 = 0 THEN split_part(text, chr(10), 1) END AS title FROM documents),
p AS (SELECT query_id, rank, printf('[%d] (source: %s, score: %.4f)', rank, CASE WHEN coalesce(title, '') <> '' THEN title || ' (' || source || ')' ELSE source END,
  round(score, 4)) || chr(10) || content || chr(10) AS p FROM hits JOIN d USING (vec_id))
SELECT query_id, 'Relevant financial context:' || chr(10) || chr(10) || string_agg(p, chr(10) ORDER BY rank) AS context FROM p GROUP BY query_id"""


def _views(spark, sf):
    """Hits as agents show them and chats cite them."""
    h = retrieval.search(_centroids(spark, sf), i.read(spark, sf, "embeddings"), block_rows=5_000)
    d = i.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    agent, chat = retrieval.hit_views(h, d, 300), retrieval.hit_views(h, d, 200).select("query_id", "rank", F.col("content").alias("cited"))
    return agent.join(chat, ["query_id", "rank"])


_VIEWS_SQL = "WITH " + _SEARCH + """
SELECT query_id, rank, vec_id, round(score, 4) + 0.0::DOUBLE AS score, left(text, 300) AS content, left(text, 200) AS cited
FROM hits JOIN documents ON doc_id = vec_id"""


def _memory(spark, sf):
    m = fusion.last_messages(i.read(spark, sf, "conversations"), 4)
    return m.select("conv_id", "turn", "role", "turn_count")


def _prompts(spark, sf):
    c = i.read(spark, sf, "conversations")
    q = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"), F.when(F.count(F.lit(1)) > 4, F.min_by("text", "turn")).alias("context"))
    p = fusion.prompts(c, q, "Answer with care.")
    return p.select("conv_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n"))


_PROMPTS_SQL = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
h AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS h FROM k WHERE rn <= 20 GROUP BY conv_id),
q AS (SELECT conv_id, arg_max(text, turn) AS query, CASE WHEN count(*) > 4 THEN arg_min(text, turn) END AS context FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, 'system: Answer with care.' || CASE WHEN coalesce(context, '') <> '' THEN chr(10) || chr(10) || 'Context from financial knowledge base:' || chr(10) || context ELSE '' END
  || chr(10) || h || chr(10) || 'user: ' || query AS p FROM q JOIN h USING (conv_id))
SELECT conv_id, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS n FROM p"""


def _json_docs(spark, sf):
    """Conversations as JSON lists and event payloads as JSON objects, read as documents."""
    c = i.read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    a = c.select(F.to_json(F.col("s.text")).alias("value"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source"))
    b = i.read(spark, sf, "events").select(F.col("props").alias("value"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source"))
    return retrieval.json_documents(a.unionByName(b), F.lit(True)).select("source", "part", F.md5("text").alias("text_md5"))


_JSON_SQL = """SELECT 'c' || conv_id AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS part, md5(text) AS text_md5 FROM conversations
UNION ALL SELECT 'e' || event_id, 0, md5(props) FROM events"""


def _pages(spark, sf):
    return retrieval.extract_pages(i.read(spark, sf, "pages"))


def _embed(spark, sf):
    c = retrieval.chunk(i.read(spark, sf, "documents").select("doc_id", "text"))
    e = retrieval.embed(c)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return e.select("doc_id", "chunk_index", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


QUERIES = {
    "s11_json_documents": _json_docs,
    "p07_j07_news_hygiene": _hygiene,
    "p08_recency_audit": _audit_q,
    "p09_rescue_floor": _rescue,
    "p10_horizons": _horizons,
    "p11_p16_confidence": _confidence,
    "p14_asset_resolution": _listing,
    "p15_search_phrases": _phrases,
    "j08_new_pages": _new_pages,
    "j12_t05_k07_vector_search": _search,
    "k01_credible_news": _topk,
    "k02_weight_order": _ranked,
    "k10_session_memory": _memory,
    "f01_f02_scalars": _rounding,
    "f03_text_formats": _formats,
    "f04_iso_instants": _iso,
    "f05_article_dates": _dates,
    "f06_urls": _urls,
    "f07_fingerprints": _fingerprints,
    "f09_article_sentiment": _scores,
    "f10_u04_headline_sentiment": _headline,
    "f11_json_replies": _replies,
    "f12_prediction_narrative": _narrative,
    "f12_retrieval_context": _context,
    "k07_hit_views": _views,
    "f13_feature_glossary": _glossary,
    "t01_page_text": _pages,
    "t02_chunks": _chunks,
    "t03_embeddings": _embed,
    "t04_news_dedup": _dedup,
    "t06_a18_a19_news_brief": _brief_rows,
    "t07_rule_fusion": _fusion,
    "t08_prompts": _prompts,
}
ORACLES = {
    "s11_json_documents": _JSON_SQL,
    "p07_j07_news_hygiene": with_ctes(
        i.NEWS, _CLEAN, select=f"SELECT doc_id, ticker, title, md5(snippet) AS snippet_md5, url, domain, {r('credibility')} AS credibility FROM clean"),
    "p08_recency_audit": with_ctes(
        i.NEWS, _CLEAN, _dated("clean"), _audit(7, "accept_with_penalty"),
        select="SELECT doc_id, ticker, published_at, date_source, age_days, CAST(kept AS INTEGER) AS kept, penalty, reason FROM audited"),
    "p09_rescue_floor": _RESCUE_SQL,
    "p10_horizons": _HORIZONS_SQL,
    "p11_p16_confidence": _CONF_SQL,
    "p14_asset_resolution": _LISTING_SQL,
    "p15_search_phrases": _phrase_sql(),
    "j08_new_pages": """SELECT page_id, url FROM pages WHERE rtrim(url, '/') NOT IN (SELECT rtrim(url, '/') FROM pages WHERE contains(url, '/en/'))""",
    "j12_t05_k07_vector_search": "WITH " + _SEARCH + f" SELECT query_id, vec_id, {r('score', 4)} AS score, rank FROM hits",
    "k01_credible_news": with_ctes(i.NEWS, _CLEAN, _DEDUP, select=f"SELECT doc_id, ticker, {r('credibility')} AS credibility, source_rank FROM top"),
    "k02_weight_order": with_ctes(
        i.NEWS, _CLEAN, _DEDUP, "tp AS (SELECT *, 1.0::DOUBLE AS penalty FROM top)", _scored("tp"),
        select=f"""SELECT doc_id, ticker, source_rank, {r('final_weight')} AS final_weight,
        CAST(row_number() OVER (PARTITION BY ticker ORDER BY final_weight DESC, source_rank) AS INTEGER) AS weight_rank FROM scored"""),
    "k10_session_memory": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
        SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) // 2 AS turn_count FROM k WHERE rn <= 4""",
    "f01_f02_scalars": _ROUNDING_SQL,
    "f03_text_formats": _FORMATS_SQL,
    "f04_iso_instants": _ISO_SQL,
    "f05_article_dates": with_ctes(
        i.NEWS, _CLEAN, _dated("clean"),
        select="SELECT doc_id, ticker, published_at, date_source, strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM dated"),
    "f06_urls": _URLS_SQL,
    "f07_fingerprints": with_ctes(i.NEWS, select=f"SELECT doc_id, {_FP} AS fingerprint FROM raw_news"),
    "f09_article_sentiment": with_ctes(
        i.NEWS, _CLEAN, "cp AS (SELECT *, 1.0::DOUBLE AS penalty FROM clean)", _scored("cp"),
        select=f"SELECT doc_id, ticker, sentiment, sentiment_score, severity_score, {r('final_weight')} AS final_weight FROM scored"),
    "f10_u04_headline_sentiment": _HEADLINE_SQL,
    "f11_json_replies": _REPLIES_SQL,
    "f12_prediction_narrative": _NARR_SQL,
    "f12_retrieval_context": _CONTEXT_SQL,
    "k07_hit_views": _VIEWS_SQL,
    "f13_feature_glossary": _glossary_sql(),
    "t02_chunks": _CHUNKS_SQL,
    "t04_news_dedup": with_ctes(i.NEWS, _CLEAN, _DEDUP, select="SELECT ticker, fingerprint, doc_id, query_idx FROM uniq"),
    "t06_a18_a19_news_brief": _BRIEF_SQL,
    "t07_rule_fusion": _FUSION_SQL,
    "t08_prompts": _PROMPTS_SQL,
}
