"""Dates, rates, prices and their formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import choose_text, first_number
from .values import col, filled, first_filled, half_even, lenient_float

DEFAULT_RATE = 150.0
_YEN = "¥|￥|jpy|円"


def parse_time(c: Column | str, as_of: Column) -> Column:
    """Timestamp of an ISO text, as_of where it is none."""
    return F.coalesce(F.try_to_timestamp(F.replace(col(c), F.lit("Z"), F.lit("+00:00"))), as_of)


def date_label(c: Column | str, as_of: Column) -> Column:
    return F.date_format(parse_time(c, as_of), "yyyy/MM/dd")


def loose_time(c: Column | str, as_of: Column) -> Column:
    """Days, hours or minutes ago, yyyy-MM-dd, yyyy/MM/dd or Mon d, yyyy; as_of for anything else."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    n = F.regexp_extract(t, r"\d+", 0).try_cast("int")

    def ago(unit: str) -> Column:
        return as_of - F.make_interval(**{unit: n})

    return F.coalesce(
        F.when(F.contains(t, F.lit("日前")), ago("days")).when(t.rlike("小時前|時間前"), ago("hours")).when(F.contains(t, F.lit("分前")), ago("mins")),
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy-M-d"))),
        F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy/M/d"))),
        F.when(t.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), F.try_to_timestamp(t, F.lit("MMM d, yyyy"))),
        as_of,
    )


def span_label(language: Column | str, days: Column | str) -> Column:
    d = col(days)
    months = half_even(d / 30).cast("int").cast("string")
    lang = col(language)

    def put(text: Column, value: Column) -> Column:
        return F.replace(text, F.lit("{n}"), value)

    return (
        F.when(d == 0, choose_text(lang, " (24h內)", " (24h)", " (24시간)", " (24小时内)"))
        .when(d < 30, put(choose_text(lang, " (近{n}天)", " (last {n} days)", " (최근 {n}일)"), d.cast("string")))
        .when(d <= 60, choose_text(lang, " (近1個月)", " (last 1 month)", " (최근 1개월)", " (近1个月)"))
        .otherwise(put(choose_text(lang, " (近{n}個月)", " (last {n} months)", " (최근 {n}개월)", " (近{n}个月)"), months))
    )


def positive_rate(c: Column | str) -> Column:
    r = col(c).try_cast("double")
    return F.when(r > 0, r).otherwise(DEFAULT_RATE)


def resolve_rate(override: Column, live: Column) -> Column:
    """Struct (rate, status): an override, else the live rate, else the default."""
    return F.struct(
        F.when(override.isNotNull(), positive_rate(override)).when(live > 0, live).otherwise(DEFAULT_RATE).alias("rate"),
        F.when(override.isNotNull(), "override").when(live > 0, "live").otherwise("fallback").alias("status"),
    )


def price_text(*cs: Column | str) -> Column:
    return F.coalesce(first_filled(*cs), F.lit(""))


def price_usd(text: Column | str, price: Column | str, currency: Column | str, rate: Column | str) -> Column:
    """A number with a yen or dollar sign in the formatted text wins, then the currency code, else the price is in dollars."""
    r, n, t = positive_rate(rate), first_number(text), F.lower(F.coalesce(col(text), F.lit("")))
    raw = lenient_float(price)
    code = F.lower(F.trim(F.coalesce(col(currency), F.lit(""))))
    return F.when(n.isNotNull() & t.rlike(_YEN), n / r).when(n.isNotNull() & t.rlike(r"\$|usd"), n).when(code.isin("jpy", "yen", "jp¥", "￥", "¥"), raw / r).otherwise(raw)


def price_jpy(text: Column | str, price: Column | str, currency: Column | str, rate: Column | str) -> Column:
    n, t = first_number(text), F.lower(F.coalesce(col(text), F.lit("")))
    return half_even(F.when(n.isNotNull() & t.rlike(_YEN), n).otherwise(price_usd(text, price, currency, rate) * positive_rate(rate))).cast("bigint")


def jpy_from_usd(usd: Column | str, rate: Column | str) -> Column:
    return half_even(lenient_float(usd) * col(rate)).cast("bigint")


def dollars(c: Column | str, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_string(f"%.{digits}f", F.coalesce(col(c).cast("double"), F.lit(0.0))))


def yen(c: Column | str) -> Column:
    n = half_even(col(c).try_cast("double")).cast("bigint")
    return F.concat(F.lit("¥"), F.format_number(F.coalesce(n, F.lit(0)), 0))


def prize_yen(price: Column | str, text: Column | str) -> Column:
    """A whole number of yen: the price, else all digits of the text, else 0."""
    digits = filled(F.regexp_replace(F.coalesce(col(text), F.lit("")), "[^0-9]", ""))
    return F.coalesce(half_even(col(price).try_cast("double")).cast("bigint"), digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def population(m: Column | str) -> Column:
    """Struct of whole population counts and the gem rate from a map of texts; what isn't a number is 0."""
    c = col(m)
    whole = [F.coalesce(F.element_at(c, k).try_cast("double").cast("bigint"), F.lit(0).cast("bigint")).alias(k) for k in ("total_population", "psa10_count", "psa9_count", "psa8_below_count")]
    return F.struct(*whole, lenient_float(F.element_at(c, "gem_mint_rate")).alias("gem_mint_rate"))
