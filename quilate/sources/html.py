"""Listing cards from captured pages: a parser per site, pagination and repeated addresses."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attrs: dict, parent=None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                yield from p.walk()

    def find(self, tag: str = "", cls: str = "", attr: tuple[str, str | None] | None = None) -> list[Node]:
        return [n for n in self.walk() if n.matches(tag, cls, attr)]

    def matches(self, tag: str = "", cls: str = "", attr: tuple[str, str | None] | None = None) -> bool:
        if tag and self.tag != tag or cls and cls not in (self.attrs.get("class") or "").split():
            return False
        return not attr or (attr[0] in self.attrs and (attr[1] is None or self.attrs[attr[0]] == attr[1]))

    def inside(self, tag: str = "", cls: str = "") -> bool:
        n = self.parent
        while n is not None:
            if n.matches(tag, cls):
                return True
            n = n.parent
        return False

    def strings(self) -> list[str]:
        out = []
        for p in self.parts:
            out += p.strings() if isinstance(p, Node) else [p]
        return out

    def own_text(self) -> str:
        return " ".join(t for t in (p.strip() for p in self.parts if isinstance(p, str)) if t)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _first(nodes: list[Node]) -> Node | None:
    return nodes[0] if nodes else None


def cards(site: str, root: Node) -> list[Node]:
    if site == "thot":
        return root.find("li", "product")
    if site == "banifox":
        return [n for n in root.walk() if n.matches(cls="card-producto") or n.matches(cls="cont-producto")]
    if site == "pccompu":
        box = _first(root.find(attr=("id", "resultado_productos")))
        return box.find("div", "prod_cont") if box else []
    raise ValueError(f"unknown site: {site}")


def card_fields(site: str, card: Node) -> tuple | None:
    """(title, href, price text, currency text) of a card; None if a part is missing."""
    strip = lambda n: "".join(s.strip() for s in n.strings())
    if site == "thot":
        price, link = _first(card.find(cls="price")), _first(card.find("a", "product-loop-title"))
        if price is None or link is None:
            return None
        return strip(link), link.attrs.get("href"), " ".join(price.strings()).strip(), None
    if site == "banifox":
        link, price = _first(card.find("a", attr=("title", None))), _first(card.find("div", "precio"))
        if link is None or price is None or not link.attrs["title"] or not link.attrs.get("href"):
            return None
        return link.attrs["title"], link.attrs["href"], price.own_text(), None
    link = _first([n for n in card.find("a") if n.inside("h2") and n.inside("div", "accont")])
    name, money, price = _first(card.find("span", attr=("itemprop", "name"))), _first(card.find("span", "pmoneda")), _first(card.find("span", "pprecio"))
    if None in (link, name, money, price):
        return None
    return strip(name), link.attrs.get("href"), strip(price), strip(money)


def raw_cards(pages: DataFrame, site: str, base: str) -> DataFrame:
    """(page columns, title, url, price_text, currency_text) of each readable card of captured pages.

    Needs ``url`` and ``html``; other columns of the page pass along. NULL pages have no cards.
    """
    keep = [c for c in pages.columns if c != "html"]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for card in cards(site, tree(r.html)):
                    found = card_fields(site, card)
                    if found:
                        rows.append([*(getattr(r, c) for c in keep), found[0], urljoin(base, str(found[1])), found[2], found[3]])
            yield pd.DataFrame(rows, columns=[*(f"page_{c}" for c in keep), "title", "url", "price_text", "currency_text"])

    schema = ", ".join([*(f"page_{c} {kinds[c]}" for c in keep), "title string", "url string", "price_text string", "currency_text string"])
    return pages.mapInPandas(run, schema)


def listings_from_cards(rows: DataFrame, site: str) -> DataFrame:
    """Price and currency as the site writes them; cards without a readable price or title drop."""
    t = F.col("price_text")
    if site == "thot":
        dollars = t.contains("US$")
        text = F.when(dollars, F.replace(F.trim(F.replace(t, F.lit("US$"), F.lit(""))), F.lit(","), F.lit(""))).otherwise(
            F.replace(F.replace(F.trim(F.replace(t, F.lit("$"), F.lit(""))), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        )
        currency = F.when(dollars, "USD").otherwise("UYU")
    elif site == "banifox":
        found = F.regexp_extract(t, r"(?i)USD\s?([\d\.,]+)", 1)
        text, currency = F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), F.lit("USD")
    else:
        text, currency = t, F.when(F.col("currency_text") == "USD", "USD").otherwise("UYU")
    out = rows.withColumn("price", F.trim(text).try_cast("double")).withColumn("currency", currency).withColumn("source", F.lit(site)).withColumn("seller", F.lit(site)).withColumn("condition", F.lit("new"))
    return out.where("price > 0 AND trim(title) <> ''").drop("price_text", "currency_text")


def readable_pages(pages: DataFrame) -> DataFrame:
    """Pages (base_url, page_no, status, urls array) up to where fetching stops.

    It stops at a 404, at a page without items, and at a page whose items all stood on earlier pages.
    """
    items = pages.where("status <> 404").select("base_url", "page_no", F.explode("urls").alias("url"))
    first = items.groupBy("base_url", "url").agg(F.min("page_no").alias("page_no"))
    new = first.groupBy("base_url", "page_no").agg(F.count("*").alias("new_items"))
    w = Window.partitionBy("base_url").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = pages.join(new, ["base_url", "page_no"], "left").withColumn("new_items", F.coalesce("new_items", F.lit(0)))
    return joined.withColumn("_go", F.min(F.when((F.col("status") == 404) | (F.col("new_items") == 0), 0).otherwise(1)).over(w)).where("_go = 1").drop("_go")


def first_of_each_url(rows: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy("url").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
