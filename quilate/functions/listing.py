"""Listing keys, URLs, currency conversion, weeks."""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quilate.functions import fixed_values as V


def canonical_url(url: str | None) -> str | None:
    """Lower case, no trailing slash, no tracking parameters, no fragment, query encoded anew."""
    if url is None:
        return None
    parts = urlparse(url.lower().rstrip("/"))
    query = {k: v for k, v in parse_qs(parts.query).items() if k not in V.TRACKING_PARAMETERS}
    return urlunparse(parts._replace(query=urlencode(query, doseq=True), fragment=""))


def normalize_url(url: Column) -> Column:
    """``canonical_url``; URLs without a query, parameters or escapes need no Python and go to it as NULL."""

    @F.pandas_udf(T.StringType())
    def full(s: pd.Series) -> pd.Series:
        return s.map(canonical_url)

    low = F.rtrim(F.lower(url), F.lit("/"))
    plain = F.regexp_replace(low, "#.*$", "")
    is_plain = ~low.rlike(r"[?;%\s]") & low.rlike("^https?://[^/]")
    return F.when(is_plain, plain).otherwise(full(F.when(~is_plain, url)))


def listing_key(source: Column, item_id: Column, url: Column) -> Column:
    """SHA-256 of source and item id, or source and URL where there is no item id."""
    return F.sha2(F.concat_ws(":", source, F.when(F.coalesce(item_id, F.lit("")) != "", item_id).otherwise(normalize_url(url))), 256)


def to_usd(price: Column, currency: Column, rate: Column) -> Column:
    """Dollars: USD as it is, UYU by the rate (NULL without one, or at rate 0); any other currency, NULL too, is an error."""
    return F.when(currency == "USD", price).when(currency == "UYU", F.try_divide(price, rate)).otherwise(F.raise_error(F.concat(F.lit("currency not supported: "), F.coalesce(currency, F.lit("NULL")))).cast("double"))


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date (UTC sessions)."""
    return F.to_date(F.date_trunc("week", ts))


def week_text(ts: Column) -> Column:
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def round_half_up(c: Column, digits: int) -> Column:
    """Rounded by plain arithmetic, so that every engine gives the same digits."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def percent_difference(current: Column, median: Column) -> Column:
    return F.when(median != 0, (current - median) / median * 100).otherwise(0.0)


def price_signal(current: Column, median: Column, threshold: float = 10.0) -> Column:
    """deal at -threshold % or less, expensive at threshold % or more, else fair; a median of 0 is fair."""
    pct = (current - median) / median * 100
    return F.when(median == 0, "fair").when(pct <= -threshold, "deal").when(pct >= threshold, "expensive").otherwise("fair")


def signal_mark(signal: Column) -> Column:
    """Mark of a signal for display; unknown ones get their own."""
    marks = F.create_map(*(F.lit(x) for kv in V.SIGNAL_MARKS.items() for x in kv))
    return F.coalesce(F.try_element_at(marks, signal), F.lit(V.UNKNOWN_MARK))


def signal_label(signal: Column) -> Column:
    return F.when(signal.isin(*V.SIGNAL_MARKS), F.upper(signal)).otherwise("UNKNOWN")


def safe_float(c: Column) -> Column:
    """A double; NaN and what is no number become NULL."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def page_url(site: str, base: Column, page: Column) -> Column:
    """Addresses of result pages in the three dialects."""
    trimmed = F.rtrim(base, F.lit("/"))
    if site in ("thot", "banifox"):
        word = "page" if site == "thot" else "pag"
        return F.when(page == 1, F.concat(trimmed, F.lit("/"))).otherwise(F.concat(trimmed, F.lit(f"/{word}/"), page.cast("string"), F.lit("/")))
    if site == "pccompu":

        @F.pandas_udf(T.StringType())
        def with_page(b: pd.Series, p: pd.Series) -> pd.Series:
            return pd.Series([_query_page(x, y) for x, y in zip(b, p)])

        return with_page(base, page)
    raise ValueError(f"unknown site: {site}")


def page_address(site: str, base: str, page: int) -> str:
    """The same for one address."""
    trimmed = base.rstrip("/")
    if site in ("thot", "banifox"):
        return f"{trimmed}/" if page == 1 else f"{trimmed}/{'page' if site == 'thot' else 'pag'}/{page}/"
    if site == "pccompu":
        return _query_page(base, page)
    raise ValueError(f"unknown site: {site}")


def _query_page(base: str, page: int) -> str:
    parts = urlparse(base)
    query = {k: v[0] for k, v in parse_qs(parts.query).items()} | {"pagina": str(page)}
    return urlunparse(parts._replace(query=urlencode(query)))

