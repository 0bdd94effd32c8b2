"""Evaluation passages in training documents: an FM-index per training shard.

The words of a shard's documents (case, accents, markup, punctuation and line breaks removed) form
one sequence; words that no passage has share one symbol. Its suffix array gives the
Burrows-Wheeler transform, held in a wavelet tree. Every phrase of ``phrase`` words of every passage is
searched backwards through wavelet ranks, all phrases at once; occurrences are located by walking
the last-first mapping to sampled suffix positions. Occurrences of one document and passage on
neighbouring diagonals merge into stretches; a stretch is then verified word by word and extended
over changed words. A document holds a passage if a stretch spans ``share`` of its words.

A shard is a bounded run of a partition's documents, so memory does not grow with the input, and
shards need nothing from each other: no shuffle except to group each document's own findings.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilate.session import bounded_rows

PHRASE = 4
SHARE = 0.4
#: Words of one shard's index (about 60 bytes each while it is built).
SHARD_WORDS = 1_000_000
#: Evaluation items (some 1 kB each) that one pass over the documents searches; a longer list takes several.
ITEMS_A_PART = 20_000
#: Every so many positions a suffix position is kept.
SAMPLE = 8

#: A tag of any length; what stands after a lone "<" of a text, as in "a < b", is none unless it ends soon.
TAG = r"<(?:[^<>]{0,400}|[a-z/!?][^<>]*)>"
_MARKUP = re.compile(TAG + r"|https?://\S+", re.I)
_BROKEN = re.compile(r"[ÃÂâ][\x80-\xbf‐-™€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]")
_WORDS = re.compile(r"[a-z0-9]+")
_BREAK = re.compile(r"(?<=[a-záéíóúñü])-\n(?=[a-záéíóúñü])")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252 or Latin-1, piece by piece; other text stays."""
    if not _BROKEN.search(text):
        return text

    def back(m: re.Match) -> str:
        for codec in ("cp1252", "latin-1"):
            try:
                return m[0].encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m[0]

    return re.sub(r"[^\x00-\x7f]{2,}", back, text)


@functools.cache
def _marks() -> re.Pattern:
    """The combining marks of the basic plane, as ranges."""
    points = [c for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))]
    first = [c for c in points if not unicodedata.combining(chr(c - 1))]
    ends = [next(e for e in range(c, 0x10001) if e == 0x10000 or not unicodedata.combining(chr(e))) - 1 for c in first]
    return re.compile("[" + "".join(f"{re.escape(chr(c))}-{re.escape(chr(e))}" for c, e in zip(first, ends)) + "]+")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def without_marks(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    text = unicodedata.normalize("NFKD", text)
    if _BEYOND.search(text):
        return "".join(c for c in text if not unicodedata.combining(c))
    return _marks().sub("", text)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if "-\n" in text:
        text = _BREAK.sub("", text)
    if not text.isascii():
        text = repair(text)
    if "<" in text or "://" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = without_marks(text)
    return _WORDS.findall(text.lower())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes not yet told apart are sorted again.

    The first sort takes as many symbols at once as fit 62 bits.
    """
    n = len(s)
    base = int(s.max()) + 2
    h = max(1, min(n, int(62 / np.log2(base))))
    padded = np.zeros(n + h, dtype=np.int64)
    padded[:n] = s + 1
    key = np.zeros(n, dtype=np.int64)
    for k in range(h):
        key = key * base + padded[k : k + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    at = np.arange(n)
    while True:
        # Within what was mixed before, groups of one are done.
        alone = new[at] & np.append(new, True)[at + 1]
        at = at[~alone]
        if not len(at):
            return sa
        pos = sa[at]
        follow = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + follow
        order = np.argsort(key)
        sa[at] = pos[order]
        key = key[order]
        cut = np.empty(len(at), dtype=bool)
        cut[0] = True
        cut[1:] = key[1:] != key[:-1]
        new[at] = cut
        first = np.flatnonzero(cut)
        rank[sa[at]] = at[np.repeat(first, np.diff(np.append(first, len(at))))]
        h *= 2


class WaveletTree:
    """Wavelet matrix over integers: rank of a symbol in a prefix, and access."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        v = values
        for b in range(bits - 1, -1, -1):
            bit = (v >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first ``at`` values (vectors)."""
        start, end = np.zeros_like(at), at
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, z = self.ones[level], self.zeros[level]
            one = ((symbol >> b) & 1).astype(bool)
            s1, e1 = ones[start], ones[end]
            start = np.where(one, z + s1, start - s1)
            end = np.where(one, z + e1, end - e1)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value at, its rank before ``at``)."""
        value, start, pos = np.zeros_like(at), np.zeros_like(at), at
        for level in range(self.bits):
            ones, z = self.ones[level], self.zeros[level]
            one = ones[pos + 1] > ones[pos]
            s1, p1 = ones[start], ones[pos]
            start = np.where(one, z + s1, start - s1)
            pos = np.where(one, z + p1, pos - p1)
            value = value * 2 + one
        return value, pos - start


class FMIndex:
    """FM-index of an integer sequence (symbols of 1 and more; 0 ends it)."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        s = np.append(s.astype(np.int64), 0)
        sa = suffix_array(s)
        self.n = len(s)
        bwt = s[sa - 1]
        self.tree = WaveletTree(bwt, max(1, int(symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols + 1)))).astype(np.int64)
        kept = sa % sample == 0
        self.mark = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
        self.sampled = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases (one per row), by backward search."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out = np.empty(len(rows), dtype=np.int64)
        at, walked, todo = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(todo):
            here = at[todo]
            kept = self.mark[here + 1] > self.mark[here]
            done = todo[kept]
            out[done] = self.sampled[self.mark[at[done]]] + walked[done]
            todo = todo[~kept]
            c, r = self.tree.access(at[todo])
            at[todo] = self.before[c] + r
            walked[todo] += 1
        return out


class Passages:
    """The evaluation passages as phrases over their own vocabulary (1: any other word)."""

    def __init__(self, items: list[tuple[int, str]], phrase: int = PHRASE, share: float = SHARE):
        self.phrase, self.share = phrase, share
        self.ids = [i for i, _ in items]
        texts = [words_of(p) for _, p in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}), 2)}
        self.words = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for t in texts]
        self.symbols = len(self.vocabulary) + 1
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([*self.words, np.zeros(0, dtype=np.int64)])
        rows = [(t[k : k + phrase], i, k) for i, t in enumerate(self.words) for k in range(len(t) - phrase + 1)]
        grams = np.array([r[0] for r in rows], dtype=np.int64).reshape(-1, phrase)
        self.grams, back = np.unique(grams, axis=0, return_inverse=True) if len(grams) else (grams, np.zeros(0, int))
        order = np.argsort(back.ravel(), kind="stable")
        self.use_start = np.concatenate(([0], np.cumsum(np.bincount(back.ravel(), minlength=len(self.grams))))).astype(np.int64)
        self.use_item = np.array([r[1] for r in rows], dtype=np.int64)[order]
        self.use_at = np.array([r[2] for r in rows], dtype=np.int64)[order]

    def encode(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 1) for w in words_of(text)], dtype=np.int64)


#: A stretch grows over agreeing (+1) and changed words (-2) until its score falls this far below its best.
GIVE_UP = 6


def _grown(agrees, start: np.ndarray, step: int) -> np.ndarray:
    """How far each of many stretches grows from ``start`` on; ``agrees(which, at)`` gives 1, 0, or -1 beyond an end."""
    score, best, reach = (np.zeros(len(start), dtype=np.int64) for _ in range(3))
    alive, k = np.arange(len(start)), 0
    while len(alive):
        flag = agrees(alive, start[alive] + step * k)
        alive, flag = alive[flag >= 0], flag[flag >= 0]
        k += 1
        score[alive] += np.where(flag == 1, 1, -2)
        better = alive[(flag == 1) & (score[alive] >= best[alive])]
        best[better], reach[better] = score[better], k
        alive = alive[score[alive] >= best[alive] - GIVE_UP]
    return reach


def grow_stretches(s: np.ndarray, doc_start: np.ndarray, doc_length: np.ndarray, words: np.ndarray, item_start: np.ndarray, item_length: np.ndarray, diagonal: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [first, last) of item words along their diagonals, all at once, grown over changed words: (first, last, agreeing words)."""
    low, high = np.maximum(0, -diagonal), np.minimum(item_length, doc_length - diagonal)

    def agrees(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = (at >= low[which]) & (at < high[which])
        out = np.full(len(which), -1)
        w, k = which[inside], at[inside]
        out[inside] = words[item_start[w] + k] == s[doc_start[w] + diagonal[w] + k]
        return out

    last = last + _grown(agrees, last, 1)
    first = first - _grown(agrees, first - 1, -1)
    length = last - first
    which = np.repeat(np.arange(len(first)), length)
    at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
    same = np.bincount(which, weights=agrees(which, at), minlength=len(first)).astype(np.int64)
    return first, last, same


def find_in_shard(docs: list[np.ndarray], passages: Passages) -> list[tuple[int, int, int, int, float]]:
    """(document, item, first word, last word, share) of each held passage in a shard."""
    if not len(passages.grams) or not docs:
        return []
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    s = np.ones(starts[-1], dtype=np.int64)
    for d, at in zip(docs, starts):
        s[at : at + len(d)] = d
    index = FMIndex(s, passages.symbols)
    low, high = index.search(passages.grams)
    count = high - low
    hit = np.flatnonzero(count)
    if not len(hit):
        return []
    gram = np.repeat(hit, count[hit])
    rows = np.repeat(low[hit], count[hit]) + np.arange(len(gram)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
    pos = index.locate(rows)
    del index
    doc = np.searchsorted(starts, pos, side="right") - 1
    uses = passages.use_start[gram + 1] - passages.use_start[gram]
    doc, pos, gram = np.repeat(doc, uses), np.repeat(pos - starts[doc], uses), np.repeat(gram, uses)
    k = np.repeat(passages.use_start[np.repeat(hit, count[hit])], uses) + np.arange(len(gram)) - np.repeat(np.cumsum(uses) - uses, uses)
    item, at = passages.use_item[k], passages.use_at[k]
    # Runs on one diagonal, a gap of a few changed words allowed.
    diagonal = pos - at
    order = np.lexsort((at, diagonal, item, doc))
    doc, item, diagonal, at = doc[order], item[order], diagonal[order], at[order]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] - at[:-1] > 12)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at)) - 1
    # Only documents whose segments of a passage could together reach the share go on to the words.
    d, i = doc[begin], item[begin]
    first, last, diag = at[begin], at[end] + passages.phrase, diagonal[begin]
    need_of = passages.share * passages.lengths
    keep = _enough(d, i, last - first + 12, need_of[i])
    d, i, first, last, diag = d[keep], i[keep], first[keep], last[keep], diag[keep]
    first, last, same = grow_stretches(s, starts[d], lengths[d], passages.flat, passages.starts[i], passages.lengths[i], diag, first, last)
    # A run needs three agreeing words in four, so all stretches of a pair together need as many.
    keep = _enough(d, i, same, AGREE * need_of[i])
    d, i, first, last, diag, same = d[keep], i[keep], first[keep], last[keep], diag[keep], same[keep]
    out: list[tuple[int, int, int, int, float]] = []
    head = np.flatnonzero(_fresh_pairs(d, i))
    for a, b in zip(head, np.append(head[1:], len(d))):
        need, size = need_of[i[a]], int(passages.lengths[i[a]])
        grown = sorted(set(zip(first[a:b].tolist(), last[a:b].tolist(), same[a:b].tolist(), diag[a:b].tolist())))
        # A word left out or put in moves the diagonal: neighbouring stretches join.
        best, run = (0.0, 0, 0), None
        for f, t, agreeing, g in grown:
            if run and abs(g - run[3]) <= 6 and f >= run[0] and f - run[1] <= 12 and t > run[1]:
                run = (run[0], t, run[2] + agreeing - max(0, run[1] - f), g)
            else:
                run = (f, t, agreeing, g)
            if run[1] - run[0] > best[0] * size and run[2] >= AGREE * (run[1] - run[0]):
                best = ((run[1] - run[0]) / size, run[0], run[1])
        if best[0] * size >= need - 1e-9:
            out.append((int(d[a]), int(i[a]), best[1], best[2], best[0]))
    return out


#: Share of the words of a run that have to agree.
AGREE = 0.75


def _fresh_pairs(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return fresh


def _enough(doc: np.ndarray, item: np.ndarray, size: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which rows, sorted by document and item, belong to a pair whose sizes add up to what it needs."""
    if not len(doc):
        return np.zeros(0, dtype=bool)
    fresh = _fresh_pairs(doc, item)
    head = np.flatnonzero(fresh)
    return (np.add.reduceat(size, head) >= need[head] - 1e-9)[np.cumsum(fresh) - 1]


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", passage: str = "passage", phrase: int = PHRASE, share: float = SHARE, shard_words: int = SHARD_WORDS, items_a_part: int = ITEMS_A_PART) -> DataFrame:
    """``doc_id``, ``item_id``, ``first_word``, ``last_word`` (of the passage) and ``share`` of each held passage.

    NULL and empty texts hold nothing; an empty item list finds nothing; passages under ``phrase``
    words cannot be found. Repeated rows each come out. Only the named columns are read. Texts are
    indexed whole; one text longer than a shard makes a shard of its own. Any number of items is
    searched, ``items_a_part`` a pass.
    """
    known = items.where(F.col(passage).isNotNull()).select(item_id, passage)
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, item_id {dict(items.dtypes)[item_id]}, first_word int, last_word int, share double"
    n = known.count()
    # A longer list goes part by part, each item in one of them; half full, so that chance overfills none.
    parts = 1 if n <= items_a_part else -(-2 * n // items_a_part)
    out = None
    for k in range(parts):
        own = known if parts == 1 else known.where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == k)
        listed = [(r[0], r[1]) for r in bounded_rows(own, max(n, 1) if parts == 1 else items_a_part, "a part of the evaluation items")]
        found = source.mapInPandas(_searcher(df.sparkSession.sparkContext.broadcast((listed, phrase, share)), shard_words), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared, shard_words: int):
    """The search of one part of the items in the shards of a partition's documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = Passages(*shared.value)
        ids, docs, size = [], [], 0

        def flush() -> pd.DataFrame:
            found = find_in_shard(docs, passages)
            return pd.DataFrame([(ids[d], passages.ids[i], f, t, s) for d, i, f, t, s in found], columns=["doc_id", "item_id", "first_word", "last_word", "share"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = passages.encode(text)
                ids.append(doc_id)
                docs.append(words)
                size += len(words) + 1
                if size >= shard_words:
                    yield flush()
                    ids, docs, size = [], [], 0
        if docs:
            yield flush()

    return run
