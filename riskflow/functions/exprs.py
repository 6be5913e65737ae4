"""Column-expression building blocks (all JVM-side, codegen-friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow import constants as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount="amount") -> Column:
    """Money as integer cents: sums of these are exact and order-independent.

    An amount that is no money (NaN, infinite, or beyond MAX_MONEY) adds 0, so
    one such row neither ends a job nor drowns an account's history.
    """
    a = col(amount)
    return F.when(F.abs(a) <= C.MAX_MONEY, F.round(a * 100).cast("long")).when(a.isNotNull(), F.lit(0).cast("long"))


# a number as text: sign, digits, exponent, or nan / inf (not the suffixed and
# hexadecimal forms that a cast to double would also read)
NUMBER = r"(?i)^\s*[+-]?(nan|inf(inity)?|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\s*$"
# a time of day that ends in a zone
ZONED = r"[0-9]:[0-9]{2}.*(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"


def number(text) -> Column:
    """Text -> double, NULL where it is no number."""
    c = col(text).cast("string")
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def utc_timestamp(text) -> Column:
    """Text -> zone-less UTC timestamp, NULL where it is none; an offset is applied."""
    c = col(text).cast("string")
    return (F.when(c.rlike(ZONED), c.try_cast("timestamp").cast("timestamp_ntz"))
             .otherwise(c.try_cast("timestamp_ntz")))


def safe_ratio(num, den) -> Column:
    """num / den, 0.0 when the denominator is 0 or NULL (sklearn zero_division=0)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def serving_deviation(amount="amount", avg="account_avg_amount") -> Column:
    """Relative deviation from the account average, 0 unless avg > 0."""
    a, m = col(amount), col(avg)
    return F.when(m > 0, (a - m) / (m + C.DEVIATION_EPSILON)).otherwise(F.lit(0.0))


def training_deviation(amount="amount", avg="account_avg_amount") -> Column:
    """The same formula without the avg > 0 guard (training-time features)."""
    return (col(amount) - col(avg)) / (col(avg) + C.DEVIATION_EPSILON)


def amount_to_max_ratio(amount="amount", mx="account_max_amount") -> Column:
    """E3."""
    return col(amount) / (col(mx) + C.DEVIATION_EPSILON)


def scale_score(raw, min_score, max_score) -> Column:
    """1 - (raw - min) / (max - min); unclamped, NULL when max == min."""
    lo = min_score if isinstance(min_score, Column) else F.lit(float(min_score))
    hi = max_score if isinstance(max_score, Column) else F.lit(float(max_score))
    return F.lit(1.0) - F.try_divide(col(raw) - lo, hi - lo)


def risk_band(score="ml_anomaly_score") -> Column:
    """HIGH >= 0.8, MEDIUM >= 0.5, else LOW (NULL score counts as 0)."""
    s = F.coalesce(col(score), F.lit(0.0))
    return (F.when(s >= C.RISK_HIGH, F.lit("HIGH"))
             .when(s >= C.RISK_MEDIUM, F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))


def severity(score="ml_anomaly_score", amount="amount",
             critical=C.CRITICAL_RISK_THRESHOLD, high=C.HIGH_RISK_THRESHOLD,
             warning=C.WARNING_RISK_THRESHOLD, high_value=C.SEVERITY_HIGH_VALUE) -> Column:
    """Critical / high / warning / info."""
    s, a = col(score), col(amount)
    return (F.when(s >= critical, F.lit("critical"))
             .when((s >= high) | (a >= high_value), F.lit("high"))
             .when(s >= warning, F.lit("warning"))
             .otherwise(F.lit("info")))


def weekday_mon0(ts="timestamp") -> Column:
    """Monday = 0 ... Sunday = 6 (not Spark's dayofweek, which is Sunday = 1)."""
    return F.weekday(col(ts))


def ab_bucket(key="transaction_id") -> Column:
    """A portable 0..99 bucket: first 8 hex digits of md5(key) mod 100."""
    return F.pmod(F.conv(F.substring(F.md5(col(key)), 1, 8), 16, 10).cast("long"), F.lit(100))


def fixed(x, digits: int) -> Column:
    """Python-style fixed-point text (``f"{x:.{digits}f}"``).

    ``format_number`` rounds the exact binary value half-even like Python;
    ``format_string('%.3f')`` would round the decimal text half-up instead
    (0.6375 -> 0.638 vs Python's 0.637). Thousands separators removed.
    """
    return F.regexp_replace(F.format_number(col(x), digits), ",", "")


def money_text(amount="amount") -> Column:
    """Euro text with thousands separator, 2 decimals."""
    return F.concat(F.lit("€"), F.format_number(col(amount), 2))


def money_plain(amount="amount") -> Column:
    """Euro text without separator (alert payloads)."""
    return F.concat(F.lit("€"), fixed(amount, 2))


def percent_text(score) -> Column:
    """Fraction as a percentage with 2 decimals."""
    return F.concat(fixed(col(score) * 100, 2), F.lit("%"))


def minute_text(ts="timestamp") -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm")


def chi_square_p(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square variable with ``df`` degrees of freedom (1 where df is 0).

    1 minus the lower incomplete gamma series y^a e^-y / Gamma(a+1) * sum of y^n / ((a+1)..(a+n)) with a = df/2, y = x/2;
    0 where Chernoff's bound is under e^-40, which also bounds the terms needed."""
    a, y = df / F.lit(2.0), x / F.lit(2.0)
    half = F.pmod(df, F.lit(2)) == 1
    # ln Gamma(a+1): the factors a, a-1, .. down to 1 or 1/2
    steps = F.sequence(F.lit(1).cast("long"), F.ceil(a))
    log_gamma = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log(i - F.when(half, 0.5).otherwise(0.0)))
    log_gamma = log_gamma + F.when(half, 0.5 * F.log(F.lit(math.pi))).otherwise(0.0)
    n = F.ceil(F.greatest(y - a, F.lit(0.0)) + 12 * F.sqrt(y + a) + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s, i):
        term = s["term"] * y / (a + i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1).cast("long"), n), start, add, lambda s: s["sum"])
    far = (y > a) & (y - a - a * F.log(y / a) > 40)
    return (F.when((df <= 0) | (x <= 0), F.lit(1.0)).when(far, F.lit(0.0))
             .otherwise(F.greatest(F.lit(1.0) - F.exp(a * F.log(y) - y - log_gamma) * series, F.lit(0.0))))
