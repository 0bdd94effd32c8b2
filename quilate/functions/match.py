"""Titles matched to catalogue entries: by containment, by model pattern, by similarity.

The catalogue is a dimension on the driver (bounded, checked). Containment and patterns are column
expressions; similarity is an Arrow UDF over the distinct titles that the first two leave open.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quilate.functions import fixed_values as V
from quilate.functions.text import java, normalize_sku, normalize_title
from quilate.session import bounded_rows, spread

CATALOG_BOUND = 20_000
#: Letters of texts that are compared at once, places below which nodes go together, and pairs of node and place a step. They change no result.
LETTERS_AT_ONCE, PLACES_APART, PAIRS_AT_ONCE = 240_000, 400, 200_000
#: A ratio that is tried before a lower threshold; a text that an entry resembles so much needs no wider search. It changes no result.
NEAR = 0.9


def plain_sku(sku: str) -> str:
    return " ".join(sku.strip().lower().split())


def catalog_entries(catalog: DataFrame) -> list[str]:
    """Skus in file order; NULL and repeated ones are left out."""
    rows = bounded_rows(catalog.where("sku IS NOT NULL").select("pos", "sku"), CATALOG_BOUND, "the catalogue")
    return list(dict.fromkeys(r["sku"] for r in sorted(rows, key=lambda r: (r["pos"] is None, r["pos"], r["sku"]))))


def _searcher(skus: list[str]) -> Callable[[str | None], str | None]:
    """The longest entry that a normalised title contains (file order on ties).

    A literal array of hundreds of entries makes code too large to compile. Here entries are grouped
    by their first word and length, and looked up where the title holds that word.
    """
    ordered = sorted(skus, key=len, reverse=True)
    groups: dict[str, dict[int, dict[str, int]]] = {}
    for i, s in enumerate(ordered):
        text = plain_sku(s)
        groups.setdefault(text.split(" ")[0], {}).setdefault(len(text), {}).setdefault(text, i)

    def one(t):
        if t is None:
            return None
        best = len(ordered)
        for first, lengths in groups.items():
            if first not in t:
                continue
            if not first:
                best = min(best, *(i for entries in lengths.values() for i in entries.values()))
                continue
            at = t.find(first)
            while at >= 0:
                for n, entries in lengths.items():
                    i = entries.get(t[at : at + n], best)
                    if i < best:
                        best = i
                at = t.find(first, at + 1)
        return ordered[best] if best < len(ordered) else None

    return one


def _containment(skus: list[str]):
    """``_searcher`` as an Arrow UDF."""

    @F.pandas_udf(T.StringType())
    def search(titles: pd.Series) -> pd.Series:
        return titles.map(_searcher(skus))

    return search


def exact_titles(df: DataFrame, title_col: str, catalog: DataFrame) -> DataFrame:
    """(``_title``, ``_exact``) of each distinct title, NULL left out; the titles are spread over the session's tasks."""
    titles = spread(df.select(F.col(title_col).alias("_title")).where("_title IS NOT NULL").distinct())
    return titles.withColumn("_exact", _containment(catalog_entries(catalog))(normalize_title(F.col("_title"))))


def with_exact_match(df: DataFrame, title_col: str, catalog: DataFrame, out: str = "exact_sku") -> DataFrame:
    """``df`` with the longest entry contained in the normalised title (file order on ties); NULL if none.

    Distinct titles are searched once.
    """
    found = exact_titles(df, title_col, catalog)
    return df.join(found, F.col(title_col) == F.col("_title"), "left").withColumn(out, F.col("_exact")).drop("_title", "_exact")


def pattern_match(title: Column, skus: list[str]) -> Column:
    """The first model pattern whose rewritten find is an entry; NULL if none. Reads the raw title."""
    ordered = sorted(skus, key=len, reverse=True)
    known = {}
    for s in ordered:
        known.setdefault(plain_sku(s), s)
    if not known:
        return F.lit(None).cast("string")
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))

    def rewritten(found: Column, rewrites) -> Column:
        for p, r in rewrites:
            found = F.regexp_replace(found, p, java(r))
        return F.try_element_at(table, normalize_sku(found))

    # One array of the finds in order; the rewrites stand once, as a function of its elements.
    finds = [F.trim(F.upper(F.regexp_extract(title, "(?i)" + p, 0))) for p in V.MODEL_PATTERNS]
    models = F.transform(F.array(*finds[:-3]), lambda f: F.when(f != "", rewritten(f, V.MODEL_REWRITES)))
    disks = F.transform(F.array(*finds[-3:]), lambda f: F.when(f != "", rewritten(f, V.MODEL_REWRITES[:1])))
    return F.when(title.rlike(V.MODELS_NEED), F.get(F.filter(F.concat(models, disks), lambda s: s.isNotNull()), F.lit(0)))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the bits of one integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = v & masks.get(c, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best similarity of the shorter string with a stretch of the longer, of its length or cut at an end.

    Two empty strings are alike (1.0); an empty and another one are not (0.0).
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    m, n = len(a), len(b)
    letters = set(a)

    def best_of(s: str, t: str) -> float:
        best = 0.0
        for i in range(n - m + 1):
            if t[i + m - 1] in letters:
                best = max(best, indel_ratio(s, t[i : i + m]))
        for k in range(1, m):
            if t[k - 1] in letters:
                best = max(best, indel_ratio(s, t[:k]))
            if t[n - k] in letters:
                best = max(best, indel_ratio(s, t[n - k :]))
        return best

    best = best_of(a, b)
    if m == n and best < 1.0:
        letters = set(b)
        best = max(best, best_of(b, a))
    return best


class _Tree:
    """Entries as a tree of their letters, gone down from all places of many texts at once.

    For each place of the texts the bit-parallel recurrence of ``lcs_length`` goes down the tree: the
    bits are the letters from that place on, a step is one letter of all entries that begin alike. A
    branch ends at a place as soon as more letters are missing than the first part of an entry may
    lack, or after it the whole one.
    """

    def __init__(self, plain: list[str], inside: list[int], code: dict[str, int], behind: bool):
        self.plain, self.code, self.behind = plain, code, behind
        top, self.letters = max(map(ord, code), default=0), max(code.values(), default=-1) + 1
        #: Of each letter up to the last one of the entries its number; what lies beyond has that of no letter.
        self.number = np.full(top + 2, self.letters, dtype=np.uint16)
        for c, i in code.items():
            self.number[ord(c)] = i
        self._grow(inside)

    def _grow(self, inside: list[int]) -> None:
        """The tree as arrays; nodes are numbered level by level, so the children of a node follow each other."""
        level, letters, rows, parents, first, children, starts = [inside], [-1], [], [-1], [], [], [0]
        for depth in range(64):
            following = []
            for some in level:
                own, split = -1, {}
                for i in some:
                    p = self.plain[i]
                    if len(p) > depth:
                        split.setdefault(self.code[p[depth]], []).append(i)
                    elif own < 0:
                        own = i
                parents += [len(rows)] * len(split)
                rows.append(own)
                first.append(len(letters))
                children.append(len(split))
                following += split.values()
                letters += split
            starts.append(len(rows))
            if not following:
                break
            level = following
        self.letter, self.row, self.first, self.children = (np.array(x, dtype=np.int64) for x in (letters, rows, first, children))
        self.depth = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        #: Of each node the length of the longest entry below it, and as bits the lengths of all of them.
        self.longest, parents = np.where(self.row >= 0, self.depth, 0), np.array(parents, dtype=np.int64)
        below = np.where(self.row >= 0, np.uint64(1) << self.depth.astype(np.uint64), np.uint64(0))
        for i, j in reversed(list(zip(starts[1:], starts[2:]))):
            np.maximum.at(self.longest, parents[i:j], self.longest[i:j])
            np.bitwise_or.at(below, parents[i:j], below[i:j])
        #: The pairs of these lengths and the depth, and which of them each node has.
        self.kinds, self.kind = np.unique(np.stack([below, self.depth.astype(np.uint64)]), axis=1, return_inverse=True)
        self.edge, self.least = int(self.longest[0]), min((len(self.plain[i]) for i in inside), default=0)
        self.word = np.uint32 if self.edge <= 32 else np.uint64

    def table(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' sizes; of each letter and place a word of bits, which of the letters ahead it is; of each place the letters ahead and its letter."""
        size, edge = np.array([len(t) for t in texts], dtype=np.int64), self.edge
        total = int(size.sum())
        ahead = np.minimum(np.repeat(np.cumsum(size), size) - np.arange(total), edge)
        joined = "".join(t[::-1] for t in texts) if self.behind else "".join(texts)
        letters = self.number[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(self.number) - 1)]
        inside = ((np.uint64(1) << ahead.astype(np.uint64)) - np.uint64(1)).astype(self.word)
        where = np.zeros((self.letters, total), dtype=self.word)
        # The four or eight bytes from each byte on, shifted by 0 to 7 bits.
        wide = np.dtype("<u4") if edge <= 25 else np.dtype("<u8")
        for i, x in enumerate(where):
            if edge <= 57:
                packed = np.concatenate([np.packbits(letters == i, bitorder="little"), np.zeros(8, dtype=np.uint8)])
                bits = np.ndarray(len(packed) - 8, wide, packed, strides=(1,)).copy()
                x[:] = (bits[:, None] >> np.arange(8, dtype=wide)).ravel()[:total].astype(self.word)
            else:
                x[:] = letters == i
                step = 1
                while step < edge:
                    x[:-step] |= x[step:] << self.word(step)
                    step *= 2
            x &= inside
        return size, where, ahead, letters

    def search(self, table: tuple, open_: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, entry, ratio) of all that reach the threshold with few letters missing in the first part, among entries shorter than the text; only open texts are searched."""
        size, where, ahead, letters = table
        edge, end = self.edge, np.cumsum(size)
        text = np.repeat(np.arange(len(size)), size)
        left = np.where(open_[text], np.repeat(end, size) - np.arange(len(text)), 0)
        # Of w letters that have m - D = w - E of an entry's m, D (2 - threshold) + E threshold is 2 m (1 - threshold) at most, and w is m or, in a cut window, less.
        lengths = np.arange(edge + 1)
        need = np.ceil(lengths * threshold / (2 - threshold) - 1e-9).astype(np.int64)
        beyond, beyond_cut, cost = np.floor(lengths * (1 - threshold) + 1e-9).astype(np.int64), lengths - need, 2 * lengths * (1 - threshold)
        # Of d letters half are missing in the first part at most, or fewer than half in the last part.
        first_part, own, other = lengths * (beyond // 2 + 1) // (beyond + 1), beyond // 2, (beyond - 1) // 2
        if self.behind:
            first_part, own, other = lengths - first_part, other, own
        found: list = []
        # Windows that lack few letters of the first part, by their first letters: of a best window it is one of the entry's.
        places = np.flatnonzero(left >= need[self.least])
        places = places[np.argsort(letters[places], kind="stable")]
        ends = np.searchsorted(letters[places], np.arange(self.letters + 1))
        groups = [(c, places[i:j]) for c, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
        self._descend(groups, where, text, ahead, size, self._most(own, beyond, first_part), self._most(own, beyond_cut, first_part), None, beyond, need, threshold, found)
        # Windows cut at the beginning of the text that lack more letters of the last part; the others are found by the other tree.
        spent = (2 - threshold) * (other + 1)
        misses = self._most(np.minimum(beyond_cut, np.floor((cost - spent) / (2 - threshold) + 1e-9)), beyond_cut, first_part)
        groups = [(-1, (end - size)[(size > 0) & open_])]
        self._descend(groups, where, text, ahead, size, misses, misses, self._most(cost - spent + 1e-6, cost + 1e-6, first_part), beyond, need, threshold, found)
        return found

    def _most(self, at_first: np.ndarray, after: np.ndarray, first_part: np.ndarray) -> np.ndarray:
        """Of each node the most that an entry below it may have, by its length, up to the end of its first part and after it; nothing if it may not at first."""
        below, depth = self.kinds
        out = np.full(len(depth), -1, dtype=np.result_type(at_first, after))
        for m in range(1, self.edge + 1):
            some = np.flatnonzero((below >> np.uint64(m)) & np.uint64(1))
            out[some] = np.maximum(out[some], np.where((depth[some] <= first_part[m]) | (at_first[m] < 0), at_first[m], after[m]))
        return out[self.kind]

    def _descend(self, groups, where, text, ahead, size, inside, most, cost, beyond, need, threshold, found) -> None:
        """Down the tree with all places of a letter, node by node; where few are left, level by level with all their nodes together.

        Of each node ``most`` letters may be missing, ``inside`` where an entry's length is ahead; ``cost`` is given for windows cut at their beginning.
        """
        word = self.word
        bits, one = word(0).itemsize * 8, word(1)
        waiting: dict[int, list] = {}
        # Of each node: the letters of a place that count, and how many of them may be free.
        seen = np.minimum(self.depth + beyond[self.longest], bits)
        mask = (~np.zeros_like(seen, dtype=word)) >> (bits - seen).astype(word)
        free, last = (seen - self.depth).astype(np.int16), int(most.max())
        spare, spare_inside = free + most.astype(np.int16), free + inside.astype(np.int16)
        if cost is not None:
            # The cost of some stretch so far counts: of 12 letters the sum, and the highest one of those that begin them.
            step = np.where((np.arange(4096)[:, None] >> np.arange(12)) & 1, -threshold, 2 - threshold).cumsum(axis=1).astype(np.float32)
            total, highest = step[:, -1].copy(), np.maximum(step.max(axis=1), 0)
            least = ((2 - threshold) * self.depth - cost - 1e-3).astype(np.float32)

        def kept(node, depth: int, at: np.ndarray, v: np.ndarray) -> np.ndarray:
            """Which places can still reach the threshold."""
            if cost is not None:
                reach = np.float32(0)
                for i in reversed(range(0, self.edge, 12)):
                    twelve = (v >> word(i)) & word(4095)
                    reach = np.maximum(highest[twelve], total[twelve] + reach)
                return np.flatnonzero(reach >= least[node])
            if np.ndim(node) or spare[node] != spare_inside[node]:
                ok = np.bitwise_count(v & mask[node]) <= np.where(ahead[at] >= self.longest[node], spare_inside[node], spare[node])
            else:
                ok = np.bitwise_count(v & mask[node]) <= int(spare[node])
            # Below the most letters that may be missing, all that are left have passed.
            if np.ndim(node) and depth <= last + 1:
                ok &= ((v & one) == 0) | (most[node] >= depth)
            return np.flatnonzero(ok)

        def ends(row: np.ndarray, at: np.ndarray, v: np.ndarray, m: int) -> None:
            if cost is not None:
                ratio = np.zeros(len(at))
                for w in range(int(need[m]), m):
                    ratio = np.maximum(ratio, 2 * (w - np.bitwise_count(v & word((1 << w) - 1)).astype(np.int64)) / (m + w))
            else:
                ratio = 2 * (m - np.bitwise_count(v & word((1 << m) - 1)).astype(np.int64)) / (m + np.minimum(m, ahead[at]))
            hit = np.flatnonzero((ratio >= threshold) & (size[text[at]] > m))
            if len(hit):
                found.append((text[at[hit]], row[hit], ratio[hit]))

        def down(node: int, depth: int, at: np.ndarray, v: np.ndarray, begins: int) -> None:
            """``begins``: the letter of these places, until an entry's letter is that one; -1 from then on."""
            if len(v) < PLACES_APART:
                waiting.setdefault(depth, []).append((np.full(len(v), node), at, v))
                return
            for child in following(node):
                open_ = -1 if letter[child] == begins else begins
                # The first letter has to be matched by now or by a next step: most places end here, before the step is computed.
                if open_ >= 0 and (allowed[child] < depth + 1 or not any(letter[x] == open_ or allowed[x] > depth + 1 for x in following(child))):
                    continue
                now, u = at, v & where[self.letter[child]][at]
                w = (v + u) | (v ^ u)
                if depth + 1 > inside[child]:
                    keep = kept(child, depth + 1, at, w)
                    if not len(keep):
                        continue
                    w, now = w[keep], at[keep]
                if self.row[child] >= 0:
                    ends(np.full(len(w), self.row[child]), now, w, depth + 1)
                if self.children[child]:
                    down(child, depth + 1, now, w, open_)

        letter, allowed, first, children = (x.tolist() for x in (self.letter, most, self.first, self.children))
        following = lambda node: range(first[node], first[node] + children[node])
        for begins, at in groups:
            down(0, 0, at, np.full(len(at), ~word(0)), begins)
        for depth in range(self.edge):
            if not waiting.get(depth):
                continue
            node, at, v = (np.concatenate(x) for x in zip(*waiting.pop(depth)))
            for i in range(0, len(node), PAIRS_AT_ONCE):
                some, here, bit = node[i : i + PAIRS_AT_ONCE], at[i : i + PAIRS_AT_ONCE], v[i : i + PAIRS_AT_ONCE]
                many = self.children[some]
                of = np.repeat(np.arange(len(some)), many)
                child = self.first[some][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                here, bit = here[of], bit[of]
                u = bit & where[self.letter[child], here]
                bit = (bit + u) | (bit ^ u)
                keep = kept(child, depth + 1, here, bit)
                child, here, bit = child[keep], here[keep], bit[keep]
                whole = np.flatnonzero(self.row[child] >= 0)
                if len(whole):
                    ends(self.row[child[whole]], here[whole], bit[whole], depth + 1)
                if len(child):
                    waiting.setdefault(depth + 1, []).append((child, here, bit))


class FuzzyIndex:
    """Catalogue entries compared with all windows of many texts at once.

    A window that reaches the threshold lacks few letters of the entry's first part or few of its last
    part. The first kind is found down a tree of the entries, the second down one of the entries
    backwards, over the texts backwards; so no entry that could reach the threshold is left out.
    """

    def __init__(self, skus: list[str]):
        self.skus = skus
        self.plain = [plain_sku(s) for s in skus]
        self.length = np.array([len(p) for p in self.plain], dtype=np.int64)
        #: Entries that fit a word of bits are in the trees, the others are compared one by one.
        self.in_tree = (self.length > 0) & (self.length < 64)
        inside = np.flatnonzero(self.in_tree).tolist()
        code = {c: i for i, c in enumerate(sorted({c for i in inside for c in self.plain[i]}))}
        # Entries differ most in their numbers: what resembles none with any digits in their places needs no search by them.
        alike = {k: i for i, k in enumerate(sorted({"0" if c.isdecimal() else c for c in code}))}
        rough = {c: alike["0" if c.isdecimal() else c] for c in code}
        behind = [p[::-1] for p in self.plain]
        self.letters, self.first, self.rough, self.last = max(1, len(code)), _Tree(self.plain, inside, code, False), _Tree(behind, inside, rough, True), _Tree(behind, inside, code, True)
        self.edge, self.all_in_tree = self.first.edge, bool(self.in_tree.all())

    def best(self, text: str, threshold: float) -> tuple[str | None, float]:
        """The entry of the highest ratio (the first on ties), if that reaches the threshold."""
        return self.best_of_all([text], threshold)[0]

    def best_of_all(self, texts: list[str], threshold: float) -> list[tuple[str | None, float]]:
        """``best`` of each text. The threshold is above 0."""
        found = (x for batch in self._batches(texts) for x in zip(*self._best(batch, threshold)))
        return [(self.skus[r], float(s)) if r < len(self.skus) and s >= threshold else (None, 0.0) for s, r in found]

    def any_of_all(self, texts: list[str], threshold: float) -> list[bool]:
        """Whether any entry's ratio with the text reaches the threshold, of each text; a text is done with the first one."""
        return [bool(s >= threshold) for batch in self._batches(texts) for s in self._best(batch, threshold, any_=True)[0]]

    def _batches(self, texts: list[str]) -> Iterator[list[str]]:
        most, batch, size = max(1000, min(LETTERS_AT_ONCE, 40 * LETTERS_AT_ONCE // self.letters)), [], 0
        for t in texts:
            if batch and size + len(t) > most:
                yield batch
                batch, size = [], 0
            batch.append(t)
            size += len(t)
        if batch:
            yield batch

    def _best(self, texts: list[str], threshold: float, any_: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The highest ratio and its entry of each text; with ``any_``, one that reaches the threshold."""
        score, row = np.zeros(len(texts)), np.full(len(texts), len(self.skus))

        def take(text: np.ndarray, entry: np.ndarray, reached: np.ndarray) -> None:
            order = np.lexsort((entry, -reached, text))
            text, entry, reached = text[order], entry[order], reached[order]
            lead = np.flatnonzero(np.diff(text, prepend=-1))
            text, entry, reached = text[lead], entry[lead], reached[lead]
            better = (reached > score[text]) | ((reached == score[text]) & (entry < row[text]))
            score[text[better]], row[text[better]] = reached[better], entry[better]

        for i, t in enumerate(texts):
            for at, reached in self._others(t, threshold):
                take(np.array([i]), np.array([at]), np.array([reached]))
        left = np.array([self.edge > 0 and t != "" for t in texts], dtype=bool)
        tables: dict[_Tree, tuple] = {}

        def search(tree: _Tree, open_: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            if not open_.any():
                return None
            if tree is self.last or tree not in tables:  # the open texts of the other trees only get fewer
                some = np.flatnonzero(open_)
                tables[tree] = some, tree.table([texts[i] for i in some])
            some, table = tables[tree]
            found = tree.search(table, open_[some], least)
            if not found:
                return None
            text, entry, ratio = (np.concatenate(x) for x in zip(*found))
            return some[text], entry, ratio

        for least in [NEAR, threshold] if threshold < NEAR and not any_ else [threshold]:
            found = search(self.first, left, least)
            if found:
                take(*found)
            if any_:
                left &= score < threshold
            likely, found = np.zeros(len(texts), dtype=bool), search(self.rough, left, least)
            if found:
                likely[found[0]] = True
                found = search(self.last, likely, least)
                if found:
                    take(*found)
            left &= score < least
        return score, row

    def _others(self, text: str, threshold: float) -> Iterator[tuple[int, float]]:
        """(entry, ratio) of those outside the tree and those not shorter than the text, as far as they can reach the threshold."""
        if len(text) > self.edge and self.all_in_tree:
            return
        if not text:
            rows = np.flatnonzero(self.length == 0)
        else:
            rows = np.flatnonzero(((self.length >= len(text)) | ~self.in_tree) & (self.length > 0))
        if text and len(rows):
            # A window of w letters that has L of m in order keeps m - 1 - 2 (m - L) - (w - L) of their pairs at least.
            m, pairs = np.minimum(self.length[rows], len(text)), self._shared(rows, text)
            most = np.minimum((pairs + 1 + m) / 2, m - 1)
            rows = rows[((pairs + 1 + 2 * m) / 3 >= threshold * m - 1e-9) | (2 * most / (m + most) >= threshold - 1e-9)]
        for i in rows:
            ratio = partial_ratio(self.plain[i], text)
            if ratio >= threshold:
                yield i, ratio

    def _shared(self, rows: np.ndarray, text: str) -> np.ndarray:
        """Neighbouring pairs that each of these entries shares with the text."""
        have = Counter(zip(text, text[1:]))
        return np.array([sum(min(n, have[p]) for p, n in self._pairs[i].items() if p in have) for i in rows], dtype=np.int64)

    @functools.cached_property
    def _pairs(self) -> list[Counter]:
        return [Counter(zip(p, p[1:])) for p in self.plain]


@functools.lru_cache(maxsize=2)
def _prepared(skus: tuple[str, ...]) -> tuple[Callable[[str | None], str | None], FuzzyIndex]:
    """What looks for entries in titles by containment and by similarity; a worker keeps it from task to task."""
    return _searcher(list(skus)), FuzzyIndex(list(skus))


def fuzzy_match(titles: DataFrame, title_col: str, catalog: DataFrame, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """(title, ``fuzzy_sku``, ``fuzzy_score``) of each distinct title that some entry resembles."""
    skus = catalog_entries(catalog)
    distinct = spread(titles.select(F.col(title_col)).distinct()).withColumn("_n", normalize_title(F.col(title_col)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, index = _prepared(tuple(skus))
        for batch in batches:
            batch = batch[batch["_n"].notna()]
            found = index.best_of_all(batch["_n"].tolist(), threshold)
            out = pd.DataFrame({title_col: batch[title_col], "fuzzy_sku": [f[0] for f in found], "fuzzy_score": [f[1] for f in found]})
            yield out[out["fuzzy_sku"].notna()]

    return distinct.mapInPandas(run, f"`{title_col}` string, fuzzy_sku string, fuzzy_score double")


def resolve_titles(df: DataFrame, catalog: DataFrame, title_col: str = "title") -> DataFrame:
    """``df`` with ``resolved_sku``, ``confidence`` and ``matched_by`` (exact, regex, fuzzy or NULL).

    Distinct titles are resolved once; similarity runs only on those that containment and patterns leave open.
    """
    skus = catalog_entries(catalog)
    # One pass through Python for containment and similarity; as an operator, it is not run again for what is asked of its result.
    titles = spread(df.select(F.col(title_col).alias("_title")).where("_title IS NOT NULL").distinct())
    read = titles.select("_title", normalize_title(F.col("_title")).alias("_n"), pattern_match(F.col("_title"), skus).alias("_pattern"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, index = _prepared(tuple(skus))
        for batch in batches:
            exact = batch["_n"].map(search).to_numpy(dtype=object)
            pattern, held = batch["_pattern"].to_numpy(dtype=object), np.array([e is not None for e in exact], dtype=bool)
            sku = np.where(held, exact, pattern)
            score, way = np.where(held, V.EXACT_CONFIDENCE, V.PATTERN_CONFIDENCE), np.where(held, "exact", "regex").astype(object)
            left = np.flatnonzero(pd.isna(sku))
            for i, (entry, ratio) in zip(left, index.best_of_all(batch["_n"].iloc[left].tolist(), V.FUZZY_THRESHOLD)):
                sku[i], score[i], way[i] = entry, ratio, "fuzzy"
            out = pd.DataFrame({"_title": batch["_title"], "resolved_sku": sku, "confidence": score, "matched_by": way})
            yield out[out["resolved_sku"].notna()]

    found = read.mapInPandas(run, "_title string, resolved_sku string, confidence double, matched_by string")
    out = df.join(found, F.col(title_col) == F.col("_title"), "left").drop("_title")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def matched_shares(df: DataFrame, by: str, catalog: DataFrame, title_col: str = "title") -> DataFrame:
    """(``by``, ``match_rate``): the share of the rows of each group that ``resolve_titles`` gives an entry.

    Which entry that is is not asked, so a title is done with the first one that it resembles, and only counts go on.
    """
    skus, kind = catalog_entries(catalog), df.schema[by].dataType.simpleString()
    titles = spread(df.groupBy(F.col(by), F.col(title_col).alias("_title")).agg(F.count("*").alias("_rows")))
    read = titles.select(by, "_rows", normalize_title(F.col("_title")).alias("_n"), pattern_match(F.col("_title"), skus).isNotNull().alias("_matched"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, index = _prepared(tuple(skus))
        waiting: list[pd.DataFrame] = []

        def counted(some: pd.DataFrame) -> pd.DataFrame:
            return some.assign(_matched=some["_rows"] * some["_matched"])[[by, "_rows", "_matched"]].groupby(by, dropna=False, as_index=False).sum()

        def searched() -> pd.DataFrame:
            some = pd.concat(waiting)
            waiting.clear()
            return counted(some.assign(_matched=index.any_of_all(some["_n"].tolist(), V.FUZZY_THRESHOLD)))

        for batch in batches:
            batch = batch.assign(_matched=batch["_matched"].astype(bool) | [search(t) is not None for t in batch["_n"]])
            open_ = ~batch["_matched"] & batch["_n"].notna()
            yield counted(batch[~open_])
            # Similarity waits for more titles than a small batch leaves open.
            waiting.append(batch[open_])
            if sum(x["_n"].str.len().sum() for x in waiting) >= LETTERS_AT_ONCE:
                yield searched()
        if waiting:
            yield searched()

    found = read.mapInPandas(run, f"`{by}` {kind}, _rows bigint, _matched bigint")
    return found.groupBy(by).agg((F.sum("_matched") / F.sum("_rows")).alias("match_rate"))
