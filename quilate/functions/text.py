"""Title functions as column expressions; only NFKD needs Python, and only for non-ASCII titles."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quilate.functions import fixed_values as V


def java(replacement: str) -> str:
    """A replacement with \\1 groups in Java's form."""
    return re.sub(r"\\(\d)", r"$\1", replacement)


def decomposed(t: str | None) -> str | None:
    if t is None or t.isascii():
        return t
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def without_accents(c: Column) -> Column:
    """NFKD without combining marks; ASCII values stay as they are and go to Python as NULL."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(decomposed)

    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, run(F.when(other, c))).otherwise(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    """Accents, separators, token rewrites, case, noise words and spaces, in this order; NULL stays NULL."""
    t = F.regexp_replace(without_accents(title), V.SEPARATORS, " ")

    def rewritten(t: Column, rewrites, need: str) -> Column:
        def all_of(x: Column) -> Column:
            out = x
            for pattern, replacement in rewrites:
                out = F.regexp_replace(out, "(?i)" + pattern, java(replacement))
            return F.when(x.rlike(need), out).otherwise(x)

        # As a function of an array's element, because the text would be worked out anew for each time it is named.
        return F.get(F.transform(F.array(t), all_of), F.lit(0))

    for lo, hi, need in V.REWRITES_NEED:
        t = rewritten(t, V.TOKEN_REWRITES[lo:hi], need)
    words = F.filter(F.split(collapse(F.lower(t)), " "), lambda w: ~w.isin(*V.NOISE_WORDS) & (w != ""))
    return F.array_join(words, " ")


def normalize_sku(sku: Column) -> Column:
    return collapse(F.lower(sku))


def extract_brand(title: Column) -> Column:
    """The first maker of which any word is part of the title; NULL if none."""
    low = F.lower(title)
    out = None
    for brand, words in V.BRAND_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, brand) if out is None else out.when(hit, brand)
    return out


def extract_variant(title: Column, brand: Column) -> Column:
    """The first product line of the maker in the title, as a heading; NULL if none."""
    low = F.lower(title)
    by_brand = None
    for name, phrases in V.VARIANT_PHRASES:
        found = None
        for p in phrases:
            found = F.when(low.contains(p), p.title()) if found is None else found.when(low.contains(p), p.title())
        by_brand = F.when(brand == name, found) if by_brand is None else by_brand.when(brand == name, found)
    return by_brand
