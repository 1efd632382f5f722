"""Text helpers as column expressions: words, hosts, fingerprints, dates, number formats, JSON in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerweave.functions.core import col

# White space as text handling in most languages sees it, not only ASCII.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(c) -> Column:
    """Non-empty words of a text."""
    return F.filter(F.split(col(c), SPACE + "+"), lambda w: w != "")


def collapse(c) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def host(url) -> Column:
    """Host part of a URL without `www.`, NULL when there is none."""
    h = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(h != "", F.replace(h, F.lit("www."), F.lit("")))


def valid_url(url) -> Column:
    return col(url).rlike(r"^(?i:https?)://[^/?#]+")


def normal_url(url) -> Column:
    """Trimmed, without trailing slashes."""
    return F.regexp_replace(F.regexp_replace(col(url), f"^{SPACE}+|{SPACE}+$", ""), "/+$", "")


def fingerprint(title) -> Column:
    """First 12 hex digits of the MD5 of the lower-case letters and digits of a title."""
    return F.substring(F.md5(F.regexp_replace(F.lower(col(title)), "[^a-z0-9]", "")), 1, 12)


def keyword_hits(text, keywords: list[str]) -> Column:
    """How many of the phrases occur anywhere in the text, also inside words."""
    t = col(text)
    return F.aggregate(
        F.array(*[F.lit(k) for k in keywords]), F.lit(0), lambda acc, k: acc + F.when(t.contains(k), 1).otherwise(0)
    )


def token_hits(text, keywords: list[str]) -> Column:
    """How many of the keywords occur as whole words."""
    return F.size(F.array_intersect(F.array_distinct(words(F.lower(col(text)))), F.array(*[F.lit(k) for k in keywords])))


# --- instants (UTC, without zone) ---------------------------------------------------

_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:T(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?(?:([+-])(\d{2}):?(\d{2}))?$"
NTZ = "timestamp_ntz"


def parse_iso(raw) -> Column:
    """ISO date or date-time with optional offset to UTC; `Z` counts as +00:00; NULL when malformed."""
    s = F.substring(F.replace(F.trim(col(raw)), F.lit("Z"), F.lit("+00:00")), 1, 25)
    g = lambda k: F.regexp_extract(s, _ISO, k)
    n = lambda k, d="0": F.when(g(k) == "", F.lit(d)).otherwise(g(k))
    local = F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), n(4), F.lit(":"), n(5), F.lit(":"), n(6))
    minutes = (n(8).cast("int") * 60 + n(9).cast("int")) * F.when(g(7) == "-", -1).otherwise(1)
    ts = F.when(s.rlike(_ISO), local.try_cast(NTZ))
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def format_iso(ts) -> Column:
    """Instant as `2026-05-14T09:41:22+00:00`."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# Date patterns in order of trust.
ISO_DATE = r"\b(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))"
LONG_DATE = r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d{1,2},?\s+20\d{2})"
US_DATE = r"\b((?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/20\d{2})\b"
EU_DATE = r"\b((?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.20\d{2})\b"
RELATIVE = r"\b(\d+)\s+(hour|day|week|month)s?\s+ago\b"
METADATA_DATE_KEYS = ["date", "published", "pubDate", "publishedAt", "article:published_time"]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def date_in_text(text, now: Column) -> tuple[Column, Column]:
    """(instant, kind) of the first pattern that yields a real date; relative ages count back from `now`."""
    t = col(text)
    hit = lambda p, k=1: F.regexp_extract(t, "(?i)" + p, k)
    iso = hit(ISO_DATE).try_cast(NTZ)
    long = F.split(F.trim(F.replace(hit(LONG_DATE), F.lit(","), F.lit(""))), r"\s+")
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(F.get(long, 0), 1, 3)))
    long_ts = F.when(
        month > 0,
        F.concat(F.get(long, 2), F.lit("-"), month.cast("string"), F.lit("-"), F.get(long, 1)).try_cast(NTZ),
    )
    us, eu = hit(US_DATE), hit(EU_DATE)
    us_ts = F.concat(F.substring(us, 7, 4), F.lit("-"), F.substring(us, 1, 2), F.lit("-"), F.substring(us, 4, 2)).try_cast(NTZ)
    eu_ts = F.concat(F.substring(eu, 7, 4), F.lit("-"), F.substring(eu, 4, 2), F.lit("-"), F.substring(eu, 1, 2)).try_cast(NTZ)
    unit = F.lower(hit(RELATIVE, 2))
    hours = hit(RELATIVE).try_cast("int") * F.when(unit == "hour", 1).when(unit == "day", 24).when(unit == "week", 168).when(
        unit == "month", 720
    )
    rel = now - F.make_dt_interval(F.lit(0), hours)
    ts = F.coalesce(iso, long_ts, us_ts, eu_ts, rel)
    kind = (
        F.when(iso.isNotNull(), "snippet_numeric")
        .when(long_ts.isNotNull(), "snippet_long_date")
        .when(us_ts.isNotNull() | eu_ts.isNotNull(), "snippet_numeric")
        .when(rel.isNotNull(), "relative_text")
    )
    return ts, kind


def article_date(metadata, snippet, title, now: Column) -> tuple[Column, Column]:
    """(instant, source): structured keys first, then the snippet, then the title."""
    m = col(metadata)
    meta = F.coalesce(*[parse_iso(F.try_element_at(m, F.lit(k))) for k in METADATA_DATE_KEYS])
    s_ts, s_kind = date_in_text(snippet, now)
    t_ts, t_kind = date_in_text(title, now)
    source = (
        F.when(meta.isNotNull(), "metadata")
        .when(s_ts.isNotNull(), F.concat(F.lit("snippet/"), s_kind))
        .when(t_ts.isNotNull(), F.concat(F.lit("title/"), t_kind))
        .otherwise("unknown")
    )
    return F.coalesce(meta, s_ts, t_ts), source


# --- number formats -------------------------------------------------------------------


def fmt_pct(p) -> Column:
    return F.format_string("%.1f%%", col(p) * 100)


def fmt_raw(p) -> Column:
    return F.format_string("%.4f", col(p))


def fmt_price(v) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(v), 2))


def fmt_signed(v, places: int = 4) -> Column:
    return F.format_string(f"%+.{places}f", col(v))


def fmt_duration(s) -> Column:
    return F.format_string("%.2fs", col(s))


# --- JSON inside free text ------------------------------------------------------------


def _unfenced(text) -> Column:
    return F.replace(F.regexp_replace(col(text), r"```(?:json|JSON)?\s*", ""), F.lit("```"), F.lit(""))


def json_object_text(text) -> Column:
    """From the first `{` to the last `}` once code fences are gone; NULL when there is no object."""
    s = F.regexp_extract(_unfenced(text), r"(?s)(\{.*\})", 1)
    return F.when(s != "", s)


def json_array_text(text) -> Column:
    s = F.regexp_extract(_unfenced(text), r"(?s)(\[.*\])", 1)
    return F.when(s != "", s)
