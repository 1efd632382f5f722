"""Rolling and grouped statistics with the small-sample corrections pandas applies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerweave.functions.core import col, div, trailing


def rolling_skew(c, n: int) -> Column:
    """Bias-corrected skewness over n rows; Spark's own is the population form."""
    c, w = col(c), trailing(n)
    g1 = F.skewness(c).over(w)
    return F.when(F.count(c).over(w) >= n, g1 * ((n * (n - 1)) ** 0.5 / (n - 2)))


def rolling_kurt(c, n: int) -> Column:
    """Bias-corrected excess kurtosis over n rows."""
    c, w = col(c), trailing(n)
    g2 = F.kurtosis(c).over(w)
    return F.when(
        F.count(c).over(w) >= n,
        ((n + 1) * g2 + 6) * ((n - 1) / ((n - 2) * (n - 3))),
    )


def rolling_rank_pct(c, n: int, need: int) -> Column:
    """Average-tie percentile rank of the last value among the non-null values of n rows."""
    c, w = col(c), trailing(n)
    seen = F.collect_list(c).over(w)
    less = F.size(F.filter(seen, lambda v: v < c))
    same = F.size(F.filter(seen, lambda v: v == c))
    return F.when(
        c.isNotNull() & (F.size(seen) >= need),
        (less + (same + 1) / 2.0) / F.size(seen),
    )


def rolling_cov(a, b, n: int) -> Column:
    a, b, w = col(a), col(b), trailing(n)
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    return F.when(F.count(both).over(w) >= n, F.covar_samp(a, b).over(w))


def rolling_beta(a, market, n: int) -> Column:
    """Cov(a, market) / Var(market); NULL for a flat market."""
    market, w = col(market), trailing(n)
    var = F.when(F.count(market).over(w) >= n, F.var_samp(market).over(w))
    return div(rolling_cov(a, market, n), var)


def rolling_corr(a, b, n: int) -> Column:
    """Pearson correlation built from covariance: the built-in one fails on constant input."""
    a, b, w = col(a), col(b), trailing(n)
    return div(rolling_cov(a, b, n), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w))
