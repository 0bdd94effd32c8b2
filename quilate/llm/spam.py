"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features.

Each page is read in two views. The trees see features of its words: the shares that stand in
stretches without function words, in stretches that repeat themselves, in links, tags and lists,
and the like. Weak labels come from another view, which the trees never see: how well the raw text
compresses, how often sentences end, how dense addresses and tag marks are; only clear cases get a
label (spam, sound, or none). Trees are grown on bootstrap samples of a bounded number of labelled
pages (chosen by hash of the id, so a rerun fits the same trees); all pages are scored. Page scores
are then smoothed with the spam rate of their host, shrunk by its page count.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilate.llm.leaks import TAG, repair
from quilate.session import ensure_checkpoint_dir

#: Articles, prepositions, conjunctions, pronouns, particles and auxiliary verbs of Spanish, English and Portuguese. Fixed values.
FUNCTION_WORDS = frozenset(
    """
    el la los las un una unos unas lo al del a ante bajo con contra de desde durante en entre hacia hasta mediante para por según sin sobre tras
    y e ni o u pero sino aunque porque pues que si como cuando donde mientras yo tú él ella ello nosotros ellos ellas usted ustedes me te se nos le les
    mi mis tu tus su sus este esta esto estos estas ese esa eso esos esas aquel aquella quien quienes cual cuales qué quién cómo algo alguien nada nadie
    no sí ya muy más menos también tampoco así tan todavía aún nunca siempre
    es son era eran fue fueron ser está están estaba estaban estar ha han había haber he hay tiene tienen tengo tenía hace
    the an of in on at by for with from to into about after before between over under until up down out off through and or but nor so if because
    although while when where than as that which who whom whose what i you she it we they him her us them my your his its our their this these those
    not is are was were be been being am has have had do does did can could will would should may might must there here then too very more less
    os um uma uns umas ao aos à às da dos das na nas num numa pelo pela pelos pelas em com sem até após ou mas nem pois quando onde enquanto embora
    eu ele nós eles elas você vocês lhe lhes meu minha seu sua seus suas isto esse essa isso aquele aquela quem qual não sim já muito mais também tão ainda
    são foi foram estão estava há tem têm tinha ter é
    """.split()
)
FEATURES = ("bare_share", "echo_share", "link_share", "tag_share", "list_share")
#: The other view, for the labels: compressed share of the text; ends of sentences, addresses and tag marks a word; digits a letter; letters, and letters a line.
LABEL_VIEW = ("compressed", "ends", "addresses", "marks", "digits", "letters", "line_letters")
#: Words of the windows in which function words, and repetitions, are counted.
WINDOW, ECHO_WINDOW = 16, 40
#: Words that one address counts as.
ADDRESS_WORDS = 3

_ANCHOR = re.compile(r"<a\b[^<>]*>(.*?)</a>", re.S | re.I)
_URL = re.compile(r"https?://[^\s<>\"']+|www\.[^\s<>\"']+", re.I)
_TAGS = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|h\d)\b[^<>]*>", re.I)
_ANYTAG = re.compile(TAG, re.I)
_WORD = re.compile(r"\w+")
_PRICE = re.compile(r"(?:u\$s|us\$|usd|uyu|\$u|r\$|\$|€)\s?\d|\d\s?(?:pesos|d[oó]lares|dollars|usd|uyu)\b", re.I)
_SPEC = re.compile(r"^\W{0,6}(?:[^\W_]+ ?){1,4}:\s*\S")
LINK, TAGGED, LISTED, PLAIN = 1, 2, 3, 0


def _lines(text: str) -> list[tuple[str, int]]:
    """(line, kind) of a text: plain, listed (prices, specifications), link or tags."""
    text = repair(text).lower()
    if "<" in text:
        text = _ANCHOR.sub(lambda m: f"\n\x01{m[1]}\n", text)
        text = _ANYTAG.sub(" ", _TAGS.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    addresses = _URL.search(text) is not None
    out = []
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        if line.startswith("\x01"):
            out.append((line[1:], LINK))
            continue
        urls = _URL.findall(line) if addresses else ()
        if urls:
            rest = _URL.sub(" ", line)
            n = len(_WORD.findall(rest))
            # A line that is a link with its label; within prose only the address itself counts.
            if n <= 6 * len(urls):
                out.append((rest + " u" * ADDRESS_WORDS * len(urls), LINK))
                continue
            out += [(rest, PLAIN), *((" u" * ADDRESS_WORDS, LINK) for _ in urls)]
            continue
        tags = line.count("#")
        if tags >= 2 and tags >= 0.6 * len(line.split()):
            out.append((line, TAGGED))
        elif line.count(" ") < 40 and len(line.split()) <= 16 and (_PRICE.search(line) or _SPEC.match(line)) and line.count("/") < 3 and line.count(",") < 5:
            out.append((line, LISTED))
        else:
            out.append((line, PLAIN))
    return out


def _typical(counts: np.ndarray, n: int, w: int) -> np.ndarray:
    """For each of n words the middle value of the windows that end at, surround and begin with it."""
    at = np.arange(n)
    last = n - w
    a, b, c = (counts[np.minimum(np.maximum(at - d, 0), last)] for d in (w - 1, w // 2, 0))
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def _shares(ids: np.ndarray, function: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each word's windows: the function-word share, the distinct share, and the latter's width."""
    n = len(ids)
    w = min(WINDOW, n)
    cum = np.concatenate(([0], np.cumsum(function)))
    near = _typical((cum[w:] - cum[:-w]) / w, n, w)
    order = np.argsort(ids, kind="stable")
    previous = np.full(n, -1)
    again = ids[order[1:]] == ids[order[:-1]]
    previous[order[1:][again]] = order[:-1][again]
    w = min(ECHO_WINDOW, n)
    # A word is the first of its kind in the windows that begin after its last occurrence.
    at = np.arange(n)
    change = np.bincount(np.maximum(previous + 1, at - w + 1).clip(0, n), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    distinct = np.cumsum(change)[: n - w + 1] / w
    return near, _typical(distinct, n, w), w


def features(text: str | None) -> list[float]:
    """What the trees see; zeros for a NULL or empty text."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    lines = _lines(text)
    found = [_WORD.findall(line) for line, _ in lines]
    words = [w for f in found for w in f]
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kind = np.repeat([k for _, k in lines], [len(f) for f in found])
    bare, echo = np.zeros(n, bool), np.zeros(n, bool)
    plain = np.flatnonzero(kind == PLAIN)
    if len(plain) >= 10:
        own = words if len(plain) == n else [words[i] for i in plain]
        number = {w: i for i, w in enumerate(dict.fromkeys(own))}
        ids = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
        function = np.fromiter(map(FUNCTION_WORDS.__contains__, number), dtype=bool, count=len(number))[ids]
        near, distinct, width = _shares(ids, function)
        bare[plain] = near < 0.11
        # Prose that repeats a sentence keeps its function words; keyword lists do so only in place names.
        echo[plain] = (distinct < (0.5 if width >= 32 else 0.45)) | ((distinct < 0.62) & (near < 0.25))
    each = np.bincount(kind, minlength=4) / n
    return [float(x) for x in (np.count_nonzero(bare) / n, np.count_nonzero(echo) / n, each[LINK], each[TAGGED], each[LISTED])]


#: Bytes compressed together, so that a text's length plays no part, and what zlib adds to each piece.
PIECE_BYTES, PIECE_OVERHEAD = 1200, 11
_END = re.compile(r"[.!?…](?:\s|<|$)")


def label_view(text: str | None) -> list[float]:
    """What the labels come from; NULL and empty texts compress to all of themselves."""
    if not text or not text.strip():
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    raw = text.encode("utf-8", "replace")
    pieces = max(1, round(len(raw) / PIECE_BYTES))
    step = -(-len(raw) // pieces)
    cut = [raw[i : i + step] for i in range(0, len(raw), step)]
    compressed = sum((len(zlib.compress(c, 6)) - PIECE_OVERHEAD) / len(c) for c in cut) / len(cut)
    words = len(text.split())
    return [compressed, len(_END.findall(text)) / words, (text.count("http") + text.count("www.")) / words, text.count("#") / words, sum(map(text.count, "0123456789")) / len(text), float(len(text)), len(text) / (text.count("\n") + 1)]


#: Weak labels. A page is spam if it compresses below the one share with few sentences, or below the third with hardly
#: any in its letters (and few digits, which lists of goods have), or has none in long lines, or is dense in addresses or tag marks; it is sound above the other share with sentences and without those.
SPAM_COMPRESSED, SOUND_COMPRESSED, LIST_COMPRESSED, LIST_DIGITS = 0.38, 0.45, 0.5, 0.03
SPAM_ENDS, FEW_ENDS, NO_ENDS, SOUND_ENDS, LEAST_LETTERS, LONG_LINES = 0.012, 0.03, 0.004, 0.015, 300, 150
SPAM_MARKS, SOUND_MARKS, SPAM_ADDRESSES, SOUND_ADDRESSES = 0.3, 0.1, 0.12, 0.05


def weak_label(view: Column) -> Column:
    """1 spam, 0 sound, NULL unclear (or both)."""
    compressed, ends, addresses, marks, digits, letters, line_letters = (view[i] for i in range(len(LABEL_VIEW)))
    spam = ((compressed <= SPAM_COMPRESSED) & (ends <= FEW_ENDS)) | ((ends <= SPAM_ENDS) & (letters >= LEAST_LETTERS) & (compressed < LIST_COMPRESSED) & (digits < LIST_DIGITS))
    spam = spam | ((ends <= NO_ENDS) & (letters >= LEAST_LETTERS) & (line_letters >= LONG_LINES)) | (marks >= SPAM_MARKS) | (addresses >= SPAM_ADDRESSES)
    sound = (compressed >= SOUND_COMPRESSED) & (ends >= SOUND_ENDS) & (marks < SOUND_MARKS) & (addresses < SOUND_ADDRESSES)
    return F.when(spam & ~sound, 1).when(sound & ~spam, 0)


class Tree:
    """A binary decision tree by Gini impurity; a cut lies midway between the values on its two sides."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 8, leaf: int = 10):
        self.nodes: list[tuple] = []
        self._grow(x, y, rng, depth, leaf)

    def _grow(self, x, y, rng, depth, leaf) -> int:
        me, n = len(self.nodes), len(y)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth == 0 or n < 2 * leaf or y.min() == y.max():
            return me
        best = (1e-9, None, None)
        parent = y.mean() * (1 - y.mean())
        for f in rng.permutation(x.shape[1])[: max(1, int(x.shape[1] * 0.5))]:
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= leaf) & (at <= n - leaf)]
            if not len(at):
                continue
            a, b = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (n - at)
            gain = parent - (at * a * (1 - a) + (n - at) * b * (1 - b)) / n
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, (v[at[k]] + v[at[k] - 1]) / 2)
        if best[1] is None:
            return me
        low = x[:, best[1]] <= best[2]
        left = self._grow(x[low], y[low], rng, depth - 1, leaf)
        right = self._grow(x[~low], y[~low], rng, depth - 1, leaf)
        self.nodes[me] = (int(best[1]), float(best[2]), left, right, float(y.mean()))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        f, cut, left, right, value = (np.array(c) for c in zip(*self.nodes))
        while True:
            inner = f[at] >= 0
            if not inner.any():
                return value[at]
            go = np.flatnonzero(inner)
            low = x[go, f[at[go]]] <= cut[at[go]]
            at[go] = np.where(low, left[at[go]], right[at[go]])


def bagged_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, seed: int = 7) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree(x[i], y[i], rng) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def page_features(df: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    """(doc_id, host, f array, view array) of each row."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-z]+://)?([^/:?#]+)", 1)).alias("host"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "host": batch["host"], "f": [features(t) for t in batch["text"]], "view": [label_view(t) for t in batch["text"]]})

    return source.mapInPandas(run, f"doc_id {dict(source.dtypes)['doc_id']}, host string, f array<double>, view array<double>")


#: Labelled pages that the trees are grown on, of each kind.
TRAIN_SPAM, TRAIN_SOUND = 2000, 4000
#: With fewer labelled pages of either kind no trees are grown.
LEAST_LABELLED = 20
#: One page in so many, by hash of the id, is never trained on.
HELD_OUT = 5


def _labelled(df: DataFrame, id_col: str, text_col: str, url_col: str, train_spam: int, train_sound: int) -> tuple[DataFrame, list]:
    """The pages with ``label`` and ``held`` (cut from their lineage), and the training rows, none of them held out."""
    ensure_checkpoint_dir(df.sparkSession)
    h = F.xxhash64("doc_id")
    pages = page_features(df, id_col, text_col, url_col).withColumns({"label": weak_label(F.col("view")), "held": F.pmod(h, F.lit(HELD_OUT)) == 0}).drop("view").checkpoint()
    # Bounded training rows of each kind: those with the smallest hashes of the id.
    kinds = ((0, train_sound), (1, train_spam))
    return pages, [r for k, bound in kinds for r in pages.where((F.col("label") == k) & ~F.col("held")).orderBy(h).limit(bound).select("f", "label").collect()]


def _scored(pages: DataFrame, rows: list, trees: int, host_weight: float, host_prior: float) -> DataFrame:
    """``pages`` with ``page_score`` (of the trees) and ``score`` (smoothed with the host's rate)."""
    y = np.array([r["label"] for r in rows], dtype=float)
    forest = bagged_trees(np.array([r["f"] for r in rows]), y, trees) if min((y == 0).sum(), (y == 1).sum()) >= LEAST_LABELLED else None
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def page_score(f: pd.Series) -> pd.Series:
        x = np.array(list(f), dtype=float)
        if not len(x):
            return pd.Series([], dtype=float)
        if shared.value is None:
            return pd.Series(np.minimum(1.0, x[:, :4].sum(axis=1)))
        return pd.Series(np.where(x.any(axis=1), np.mean([t.predict(x) for t in shared.value], axis=0), 0.0))

    scored = pages.withColumn("page_score", page_score("f"))
    hosts = scored.groupBy("host").agg(F.sum("page_score").alias("s"), F.count("*").alias("n")).withColumnRenamed("host", "of")
    total = hosts.agg((F.sum("s") / F.sum("n")).alias("rate")).withColumn("one", F.lit(1))
    rates = hosts.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("of", ((F.col("s") + host_prior * F.col("rate")) / (F.col("n") + host_prior)).alias("host_rate"), "rate")
    bounded = lambda p: F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), p))
    logit = lambda p: F.log(bounded(p)) - F.log(1 - bounded(p))
    smooth = logit(F.col("page_score")) + host_weight * (logit(F.col("host_rate")) - logit(F.col("rate")))
    return scored.join(rates, scored["host"] == rates["of"]).withColumn("score", 1 / (1 + F.exp(-smooth)))


def spam_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url", train_spam: int = TRAIN_SPAM, train_sound: int = TRAIN_SOUND, trees: int = 40, host_weight: float = 0.3, host_prior: float = 50.0, threshold: float = 0.35) -> DataFrame:
    """``doc_id``, ``host``, ``page_score``, ``score``, ``is_spam`` of each row.

    NULL texts and those without words have a page score of 0. A NULL url gives the host ''. With fewer
    than ``LEAST_LABELLED`` labelled pages of either kind (a tiny or empty table) the share of bare,
    repeated, linked and tagged words is the score. Repeated rows each come out; only the named columns are read. Hosts are smoothed
    through one row per host. The threshold is below a half because only clear pages are labelled:
    a page that is half spam is seldom among them.
    """
    pages, rows = _labelled(df, id_col, text_col, url_col, train_spam, train_sound)
    scored = _scored(pages, rows, trees, host_weight, host_prior)
    return scored.select("doc_id", "host", "page_score", "score", (F.col("score") > threshold).alias("is_spam"))


def stage_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url", train_spam: int = TRAIN_SPAM, train_sound: int = TRAIN_SOUND, trees: int = 40, host_weight: float = 0.3, host_prior: float = 50.0, threshold: float = 0.35) -> DataFrame:
    """What each stage finds among the labelled pages that are held out from training.

    (``stage``, ``held_out``, ``spam``, ``found``, ``both``): held-out pages, those labelled spam,
    those over the threshold after the stage (trees, hosts), and those that are both. Labels are weak:
    a page over the threshold that is labelled sound may be mislabelled.
    """
    pages, rows = _labelled(df, id_col, text_col, url_col, train_spam, train_sound)
    scored = _scored(pages, rows, trees, host_weight, host_prior).where("held AND label IS NOT NULL")
    stages = F.explode(F.array(*(F.struct(F.lit(name).alias("stage"), (F.col(c) > threshold).alias("hit")) for name, c in (("trees", "page_score"), ("hosts", "score")))))
    spam = F.col("label") == 1
    return scored.select("label", stages.alias("x")).select("label", "x.*").groupBy("stage").agg(F.count("*").alias("held_out"), F.count_if(spam).alias("spam"), F.count_if("hit").alias("found"), F.count_if(spam & F.col("hit")).alias("both"))
