"""Quantities recorded in different units: unit strings segmented by dynamic programming over tries.

``UnitGrammar`` holds three tries: scale prefixes (``k``, ``x100``, ``centi``), unit roots (``usd``,
``$u``, ``pesos``) and exponents (``/u``, ``c/u``, ``^2``). A unit string is cut into trie entries
with the least cost, unknown characters at a price. Where an entry stands for several roots (a bare
``$``) all readings come out, weighed by the priors of the field's dimension.

``convert_prices`` weighs the readings of the label and of the price as shown against the level of
the product in its week: each candidate unit's likelihood is a normal density of the log ratio with
a flat tail, so a wild value stays in the unit it was labelled with instead of jumping to whatever
unit lies nearest.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilate.operators.identifiers import squeezed


@dataclass(frozen=True)
class Reading:
    root: str
    scale: float
    power: int
    score: float


class Trie:
    def __init__(self, entries: dict[str, list]):
        self.root: dict = {}
        for text, payloads in entries.items():
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = payloads

    def ends(self, text: str, at: int) -> Iterator[tuple[int, list]]:
        """(end, payloads) of each entry that begins at ``at``."""
        node = self.root
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            if "" in node:
                yield i + 1, node[""]


#: Spellings of the currency roots. Fixed values.
ROOTS = {
    "usd": ["usd"], "us$": ["usd"], "u$s": ["usd"], "u$d": ["usd"], "$us": ["usd"], "dolar": ["usd"], "dolares": ["usd"], "dollar": ["usd"], "dollars": ["usd"],
    "uyu": ["uyu"], "$u": ["uyu"], "$uy": ["uyu"], "uy$": ["uyu"], "peso": ["uyu"], "pesos": ["uyu"], "pesosuruguayos": ["uyu"], "m/n": ["uyu"], "m/n$": ["uyu"], "centesimos": ["uyu:0.01"], "centesimo": ["uyu:0.01"],
    "$": ["usd", "uyu"],
}
#: Scales that stand before or after a root. Fixed values.
PREFIXES = {"k": [1000.0], "miles": [1000.0], "mil": [1000.0], "x100": [0.01], "x1000": [0.001], "centi": [0.01], "cents": [0.01], "cent": [0.01], "centavos": [0.01], "milli": [0.001], "kilo": [1000.0], "mega": [1e6]}
#: Exponents and the words for "each", which leave a price as it is. Fixed values.
EXPONENTS = {"c/u": [1], "xunidad": [1], "/u": [1], "^2": [2], "^3": [3], "^-1": [-1], "²": [2], "³": [3]}
#: Words around a price. Fixed values.
FILLERS = ("precio final", "precio en", "precio", "iva inc", "iva", "contado", "en")


#: Whole steps keep sums of logs exact.
LOG_STEPS = 10**9


def _steps(scale: float) -> int:
    return round(math.log10(scale) * LOG_STEPS)


class UnitGrammar:
    """Segmentation of unit strings; ``priors`` weigh the roots of an ambiguous entry (field dimension)."""

    def __init__(self, priors: dict[str, float], roots=ROOTS, prefixes=PREFIXES, exponents=EXPONENTS, fillers=FILLERS):
        self.priors = priors
        self.roots, self.prefixes, self.exponents = Trie(roots), Trie(prefixes), Trie(exponents)
        self.fillers = Trie({f.replace(" ", ""): [None] for f in fillers})

    def readings(self, unit: str | None, keep: int = 4) -> list[Reading]:
        """Readings of a unit string, best first; none for NULL, empty or unreadable strings."""
        if not unit:
            return []
        text = unicodedata.normalize("NFKC", unit).lower()
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        text = re.sub(r"[\s():.,_]+", "", text)
        most = 8.0 + 0.5 * len(text)
        # best[i]: states (root, scale as a whole number of LOG_STEPS to a factor of ten, power) -> least cost of a cut of text[:i]
        best: list[dict] = [{} for _ in range(len(text) + 1)]
        best[0][(None, 0, 1)] = 0.0

        def put(i: int, state: tuple, cost: float) -> None:
            if cost < min(most, best[i].get(state, math.inf)):
                best[i][state] = cost

        def open_states(i: int) -> list:
            """Without those that cannot win: what follows adds the same to all states of a root and leaves them apart, so ``keep`` cheaper ones stay cheaper."""
            states, costs = sorted(best[i].items(), key=lambda x: x[1]), {}
            for (root, *_), cost in states:
                costs.setdefault(root, []).append(cost)
            return [(state, cost) for state, cost in states if cost <= costs[state[0]][min(keep, len(costs[state[0]])) - 1]]

        for i in range(len(text)):
            for (root, scale, power), cost in open_states(i):
                for end, found in self.roots.ends(text, i):
                    for r in found:
                        name, _, own = r.partition(":")
                        if root in (None, name):
                            share = self.priors.get(name, 0.05)
                            put(end, (name, scale + _steps(float(own or 1)), power), cost + 1.0 - (math.log(share) if len(found) > 1 else 0.0))
                for end, found in self.prefixes.ends(text, i):
                    put(end, (root, scale + _steps(found[0]), power), cost + 1.2)
                for end, found in self.exponents.ends(text, i):
                    put(end, (root, scale, power * found[0]), cost + 1.0)
                for end, _ in self.fillers.ends(text, i):
                    put(end, (root, scale, power), cost + 0.8)
                put(i + 1, (root, scale, power), cost + 4.0)
        out = [Reading(r, 10.0 ** max(-300.0, min(300.0, s / LOG_STEPS)), p, -c) for (r, s, p), c in best[-1].items() if r]
        return sorted(out, key=lambda x: -x.score)[:keep]


#: Codes of the units of a price: root, scale. Fixed values.
UNITS = {"usd": ("usd", 1.0), "usd_cents": ("usd", 0.01), "uyu": ("uyu", 1.0), "uyu_cents": ("uyu", 0.01), "uyu_thousands": ("uyu", 1000.0)}


def unit_priors(strings: DataFrame, col: str, grammar: UnitGrammar, other: tuple[float, float]) -> DataFrame:
    """(``unit_string``, ``unit_prior`` map of unit code to log weight) of each distinct string; an empty map if it names no unit.

    A power of a currency (``usd^2``) is no unit of a price.

    ``other`` weighs the units that a string does not name: those near to a named one, and the rest.
    """
    distinct = strings.select(F.col(col).cast("string").alias("unit_string")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps = []
            for text in batch["unit_string"]:
                found = grammar.readings(text)
                top = found[0].score if found else 0.0
                weights = {}
                for code, (root, scale) in UNITS.items():
                    own = [r.score - top for r in found if r.root == root and r.power == 1 and abs(math.log(r.scale / scale)) < 1e-6]
                    if own and max(own) > -2:
                        weights[code] = max(own)
                # A unit of the same root or scale is likelier than one that shares neither.
                near = {UNITS[c] for c in weights}
                roots, scales = {r for r, _ in near}, {k for _, k in near}
                if weights:
                    weights |= {c: other[0] if r in roots or k in scales else other[1] for c, (r, k) in UNITS.items() if c not in weights}
                maps.append(weights)
            yield pd.DataFrame({"unit_string": batch["unit_string"], "unit_prior": maps})

    return distinct.mapInPandas(run, "unit_string string, unit_prior map<string,double>")


def weekly_rate(df: DataFrame, week_col: str, rate_col: str, low: float = 5.0, high: float = 500.0) -> DataFrame:
    """(``rate_week`` date, ``rate``): per week the value most records agree on, in pesos per dollar.

    Records in dollars per peso or pesos per 100 dollars are brought to that unit before they vote.
    """
    r = F.col(rate_col)
    straight = F.when((r >= low) & (r <= high), r).when((r > 0) & (r >= 1 / high) & (r <= 1 / low), 1 / r).when((r >= 100 * low) & (r <= 100 * high), r / 100)
    votes = df.select(F.to_date(week_col).alias("rate_week"), F.round(straight, 4).alias("rate")).where("rate IS NOT NULL AND NOT isnan(rate)").groupBy("rate_week", "rate").agg(F.count("*").alias("n"))
    return votes.groupBy("rate_week").agg(F.max_by("rate", F.struct("n", -F.col("rate"))).alias("rate"))


def rate_units(df: DataFrame, id_col: str, week_col: str, rate_col: str) -> DataFrame:
    """(``row_id``, ``recorded``, ``rate``, ``unit_code``) of each record: the week's rate in pesos per dollar.

    ``unit_code`` is the unit the record is in: ``uyu_per_usd``, ``usd_per_uyu``, ``uyu_per_100_usd``; NULL for a NULL record or one in no such unit.
    """
    rates = weekly_rate(df, week_col, rate_col)
    rows = df.select(F.col(id_col).alias("row_id"), F.to_date(week_col).alias("week"), F.col(rate_col).alias("recorded"))
    near = lambda x: F.abs(F.log(x)) < 0.5
    x, r = F.col("recorded"), F.col("rate")
    ok = x.isNotNull() & (x > 0) & ~F.isnan(x)
    code = F.when(ok & near(x / r), "uyu_per_usd").when(ok & near(x * r), "usd_per_uyu").when(ok & near(x / (100 * r)), "uyu_per_100_usd")
    return rows.join(rates, F.col("week") == F.col("rate_week"), "left").select("row_id", "recorded", F.when(ok, r).alias("rate"), code.alias("unit_code"))


def price_levels(prices: DataFrame) -> DataFrame:
    """(``level_key``, ``level_week``, ``level``, ``level_rows``): median of price_usd per product and week, steadied
    over a year, and the most readings that the product has in a week.

    The weekly median is a mergeable sketch (1 % of rank); the steadying window has one row a week.
    It is long, because a seller may record a wrong unit for weeks, and no narrower than price
    changes allow: units lie a factor of 2.5 or more apart.
    """
    v = F.col("price_usd")
    weekly = prices.where((v > 0) & ~F.isnan(v)).groupBy("level_key", "level_week").agg(F.percentile_approx("price_usd", 0.5, 100).alias("m"), F.count("*").alias("n"))
    w = Window.partitionBy("level_key").orderBy("level_week").rowsBetween(-STEADY_WEEKS, STEADY_WEEKS)
    return weekly.select("level_key", "level_week", F.percentile("m", F.lit(0.5)).over(w).alias("level"), F.max("n").over(Window.partitionBy("level_key")).alias("level_rows"))


SIGMA, TAIL, STEADY_WEEKS = 0.25, 0.005, 26
#: Price texts up to this number are broadcast (some 100 bytes each); more are joined by id.
TEXTS_TO_BROADCAST = 200_000
#: Log weights of units that the label, or the price as shown, does not name: near to it, and far.
LABEL_OTHER, SHOWN_OTHER = (-3.0, -7.0), (-6.0, -8.0)


def price_summary(prices: DataFrame) -> DataFrame:
    """(``canonical_product_id``, ``currency``, ``level_week``, ``readings``): all values of these columns, from one pass."""
    return prices.groupBy("canonical_product_id", "currency", _week().alias("level_week")).agg(F.count("*").alias("readings"))


def _week() -> Column:
    return F.to_date(F.date_trunc("week", "timestamp"))


def nearest_rates(weeks: DataFrame, rates: DataFrame) -> DataFrame:
    """(``rate_week``, ``rate``): each week with its rate, else that of the nearest week that has one, the earlier of two."""
    order = Window.orderBy("rate_week")  # one row a week
    known = F.when(F.col("rate").isNotNull(), F.struct("rate_week", "rate"))
    rows = weeks.join(rates, "rate_week", "full_outer").select("rate_week", "rate", F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first(known, True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    earlier = F.col("b").isNull() | (F.datediff("rate_week", "a.rate_week") <= F.datediff("b.rate_week", "rate_week"))
    return rows.select("rate_week", F.when(F.col("a").isNotNull() & earlier, F.col("a.rate")).otherwise(F.col("b.rate")).alias("rate"))


def convert_prices(prices: DataFrame, texts: DataFrame, rates: DataFrame, key: Column | None = None, summary: DataFrame | None = None, texts_to_broadcast: int = TEXTS_TO_BROADCAST) -> DataFrame:
    """Prices with their unit and their value in dollars.

    Adds ``unit_code``, ``usd_value`` (price in dollars at the week's rate), ``level``, ``level_rows`` and
    ``label_unit`` (the unit that the label names, NULL if it is not exactly USD or UYU) to id,
    timestamp, canonical_product_id, source, seller, price, currency, price_usd. A NULL or NaN price
    has no unit. Without any level the label's unit counts. ``key`` names the product (default: the
    squeezed identifier). A week without a rate takes the nearest week's rate. ``summary``: the
    ``price_summary`` of the prices, where it is at hand, spares two passes over them. Up to
    ``texts_to_broadcast`` texts are broadcast, more are joined by id; the result is the same.
    """
    base = prices.withColumn("level_key", key if key is not None else squeezed(F.col("canonical_product_id"))).withColumn("level_week", _week())
    summary = base if summary is None else summary
    levels = price_levels(base)
    grammar = UnitGrammar({"usd": 0.5, "uyu": 0.5})
    labels = unit_priors(summary, "currency", grammar, LABEL_OTHER).select(F.col("unit_string").alias("_label"), F.col("unit_prior").alias("_label_prior"))
    shown = texts.select("snapshot_id", F.col("price_text").alias("_shown")).where("_shown IS NOT NULL").dropDuplicates(["snapshot_id"])
    # The number differs in every text: the unit string is the text without it.
    shown = shown.withColumn("_unit", F.trim(F.regexp_replace("_shown", r"(?<![x\d])\d[\d.,]*", " ")))
    units = unit_priors(shown, "_unit", grammar, SHOWN_OTHER).select(F.col("unit_string").alias("_unit_string"), F.col("unit_prior").alias("_shown_prior"))
    shown = shown.select("snapshot_id", "_unit")
    # Few prices have a text; a short list of them spares all prices a shuffle by id.
    if texts.limit(texts_to_broadcast + 1).count() <= texts_to_broadcast:
        shown = F.broadcast(shown)
    weeks = summary.select(F.col("level_week").alias("rate_week")).where("level_week IS NOT NULL").distinct()
    filled = nearest_rates(weeks, rates)
    rows = (
        base.join(levels, ["level_key", "level_week"], "left")
        .join(filled, F.col("level_week") == F.col("rate_week"), "left")
        .join(labels, F.col("currency").eqNullSafe(F.col("_label")), "left")
        .join(shown, F.col("id") == F.col("snapshot_id"), "left")
        .join(units, F.col("_unit") == F.col("_unit_string"), "left")
    )
    scale = {c: (F.lit(s) if root == "usd" else s / F.col("rate")) for c, (root, s) in UNITS.items()}
    # A label that says nothing leaves all plain units open.
    prior = F.when(F.coalesce(F.size("_label_prior"), F.lit(0)) > 0, F.col("_label_prior")).otherwise(F.create_map(F.lit("usd"), F.lit(0.0), F.lit("uyu"), F.lit(0.0), F.lit("usd_cents"), F.lit(LABEL_OTHER[0]), F.lit("uyu_cents"), F.lit(LABEL_OTHER[0]), F.lit("uyu_thousands"), F.lit(LABEL_OTHER[0])))
    shown_says = F.coalesce(F.size("_shown_prior"), F.lit(0)) > 0
    rows = rows.withColumn("_prior", prior)

    def score(code: str) -> Column:
        ratio = F.log(F.col("price") * scale[code] / F.col("level"))
        fit = F.coalesce(F.log(F.exp(-ratio * ratio / (2 * SIGMA**2)) * (1 / (SIGMA * math.sqrt(2 * math.pi))) + TAIL), F.lit(0.0))
        named = F.coalesce(F.try_element_at("_prior", F.lit(code)), F.lit(LABEL_OTHER[1]))
        seen = F.when(shown_says, F.coalesce(F.try_element_at("_shown_prior", F.lit(code)), F.lit(SHOWN_OTHER[1]))).otherwise(0.0)
        return fit + named + seen

    usable = F.col("price").isNotNull() & ~F.isnan("price") & (F.col("price") > 0)
    best = F.greatest(*(F.struct(score(c).alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("unit_code"), (F.col("price") * scale[c]).alias("usd_value")) for i, c in enumerate(UNITS)))
    none = F.struct(F.lit(None).cast("double").alias("s"), F.lit(0).alias("o"), F.lit(None).cast("string").alias("unit_code"), F.lit(None).cast("double").alias("usd_value"))
    # A generator: what follows reads the result and never repeats its expression.
    rows = rows.select("*", F.inline(F.array(F.when(usable, best).otherwise(none))))
    label_unit = F.when(F.col("currency") == "USD", "usd").when(F.col("currency") == "UYU", "uyu")
    return rows.withColumn("label_unit", label_unit).drop("s", "o", "_prior", "_label", "_label_prior", "_shown_prior", "_unit", "_unit_string", "snapshot_id", "rate_week", "level_week", "level_key")


#: No goods of this kind cost less or more, in dollars.
LEAST_USD, MOST_USD = 1.0, 30_000.0


def impossible(price_usd: Column, usd_value: Column) -> Column:
    """A price_usd that is no positive number, or a value absurd in every unit."""
    absurd = usd_value.isNull() | F.isnan(usd_value) | (usd_value < LEAST_USD) | (usd_value > MOST_USD)
    return price_usd.isNull() | F.isnan(price_usd) | (price_usd <= 0) | absurd


def unit_findings(converted: DataFrame) -> DataFrame:
    """(``row_id``, ``unit_code``, ``usd_value``) of prices under a wrong label, in another unit, or with a wrong price_usd."""
    off = F.abs(F.col("price_usd") - F.col("usd_value")) > 0.01 * F.col("usd_value")
    wrong = F.col("label_unit").isNull() | (F.col("label_unit") != F.col("unit_code")) | off
    return converted.where(~impossible(F.col("price_usd"), F.col("usd_value")) & wrong).select(F.col("id").alias("row_id"), "unit_code", "usd_value")
