"""Mapping freely entered values to a reference list with BK-trees.

One metric throughout: the unrestricted Damerau-Levenshtein distance in which an edit of a letter
costs 1 and one that touches a digit 2. The triangle inequality holds, so it prunes subtrees and a
search returns *every* word within the threshold. Digits thus agree exactly wherever one edit is
allowed: one digit makes another product.

The whole entries, their tokens joined, form one BK-tree; every run of neighbouring tokens of a
value whose digits are those of some entry is searched in it, with a threshold by length, and the
longest runs count. So entries and values of any shape are mapped. A second BK-tree holds the names
of entries whose shape ``titles`` reads (name, number, suffix, capacity, speed). It maps values that
give these parts in another order or in other units; a mention it reads that no entry fits is a
product outside the list, and rules out whole entries.

Up to ``shard_entries`` entries one pair of trees is broadcast to all tasks. A longer list is cut
into shards of that size; the values pass each shard in turn. A shard gives all its nearest entries
and how it found them; ties and the fallback to whole entries are decided after the merge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilate.functions import titles as T
from quilate.session import spread

UNMATCHED = "UNMATCHED"
#: How entries were found; of all shards the first of these counts. A mention that no entry fits rules out whole strings.
EXACT, MENTION, NO_ENTRY, WHOLE = range(4)
#: Entries of one shard: some 100 MB of Python objects in a task, whatever the number of values.
SHARD_ENTRIES = 200_000
#: Values remembered per task, so that repeated words do not search the tree again.
CACHE_WORDS = 200_000


#: What an edit costs that touches a digit; of two letters it costs 1.
DIGIT_COST = 2


def _costs(s: str) -> list[int]:
    return [DIGIT_COST if c.isdigit() else 1 for c in s]


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance, digits at ``DIGIT_COST`` (a true metric); above ``limit`` any larger number.

    To put in or leave out a character costs its own cost, to replace or swap two the higher one.
    """
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if limit is not None and abs(la - lb) > limit:
        return limit + 1
    wa, wb = _costs(a), _costs(b)
    pa, pb = [0, *accumulate(wa)], [0, *accumulate(wb)]
    top = pa[la] + pb[lb] + DIGIT_COST
    rows = [[top] * (lb + 2), [top, *pb]]
    last: dict[str, int] = {}
    for i in range(1, la + 1):
        ca, wi = a[i - 1], wa[i - 1]
        row = [top, pa[i]] + [0] * lb
        above = rows[i]
        rows.append(row)
        seen = 0
        for j in range(1, lb + 1):
            cb, wj = b[j - 1], wb[j - 1]
            k, m = last.get(cb, 0), seen
            if ca == cb:
                cost, seen = 0, j
            else:
                cost = wi if wi > wj else wj
            best = above[j] + cost
            x = row[j] + wj
            if x < best:
                best = x
            x = above[j + 1] + wi
            if x < best:
                best = x
            if k and m:
                x = rows[k][m] + (pa[i - 1] - pa[k]) + (wi if wi > wj else wj) + (pb[j - 1] - pb[m])
                if x < best:
                    best = x
            row[j + 1] = best
        last[ca] = i
    return rows[la + 1][lb + 1]


class BKTree:
    """Burkhard-Keller tree over distinct words."""

    def __init__(self, words: list[str] = ()):
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = edit_distance(word, node[0])
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (word, {})
                return
            node = child

    def within(self, word: str, limit: int) -> list[tuple[int, str]]:
        """All words at a distance of ``limit`` or less, nearest first."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            w, children = stack.pop()
            d = edit_distance(word, w)
            if d <= limit:
                out.append((d, w))
            for e in range(d - limit, d + limit + 1):
                if e in children:
                    stack.append(children[e])
        return sorted(out)


def squeeze(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", T.plain(text))


class ReferenceMatcher:
    """The reference list (or one shard of it) with its trees; picklable through its entries.

    ``known``: the rests by (name, category) of the whole list, where the entries are a shard of it.
    """

    def __init__(self, entries: list[tuple[int, str]], max_distance: int = 1, known: dict[tuple, frozenset] | None = None):
        self.entries, self.max_distance, self.known = entries, max_distance, known
        self._build()

    def __getstate__(self):
        return {"entries": self.entries, "max_distance": self.max_distance, "known": self.known}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._build()

    def _build(self) -> None:
        self.by_key: dict[tuple, list] = {}
        self.by_name: dict[str, set] = {}
        rests: dict[tuple, set] = {}
        self.exact: dict[str, tuple[int, str]] = {}
        self.squeezed: dict[str, list[tuple[int, str, str]]] = {}
        self.cache: dict[str, list] = {}
        for pos, entry in self.entries:
            self.exact.setdefault(entry, (pos, entry))
            read, key = T.read_entry(entry), squeeze(entry)
            # What follows a name that was read has to agree exactly.
            self.squeezed.setdefault(key, []).append((pos, entry, key[len(read[1]) :] if read and key.startswith(read[1]) else ""))
            if not read:
                continue
            category, name, rest = read
            self.by_key.setdefault((name, category, rest), []).append((pos, entry))
            self.by_name.setdefault(name, set()).add(category)
            rests.setdefault((name, category), set()).add(rest)
        self.rests = {k: frozenset(v) for k, v in rests.items()} | (self.known or {})
        self.names = BKTree(list(self.by_name))
        self.whole = BKTree(list(self.squeezed))
        self.digits = {digits_of(key) for key in self.squeezed}
        self.longest = max(map(len, self.squeezed), default=0)

    def near(self, word: str) -> list[tuple[int, str]]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            # An edit of a short word is another word: it counts only as it is.
            found = self.cache[word] = self.names.within(word, self.max_distance) if len(word) > 3 else [(0, word)] if word in self.by_name else []
        return found

    def mentions(self, text: str) -> Iterator[tuple[int, str, str, tuple, tuple[int, int]]]:
        """(distance, category, name, rest, token span) of each readable mention of a reference name."""
        tokens = T.tokenize(text)
        for i, (word, _) in enumerate(tokens):
            if not word.isalpha():
                continue
            for distance, name in self.near(word):
                for category in self.by_name[name]:
                    read = T.read_rest(category, text, tokens, i, self.rests[name, category])
                    if read:
                        yield distance, category, name, read[0], read[1]

    def match(self, value: str | None) -> tuple[str | None, int | None]:
        """(entry, distance), or (None, None) if no entry is meant or two are equally near."""
        nearest = self.candidates(value)[2]
        return (nearest[0][2], nearest[0][0]) if len(nearest) == 1 else (None, None)

    def candidates(self, value: str | None) -> tuple[int, int, list[tuple[int, int, str]]]:
        """How entries were found, the length they agree over (whole entries only), and all (distance, position, entry) at the least distance."""
        if value is None or not value.strip():
            return WHOLE, 0, []
        if value in self.exact:
            return EXACT, 0, [(0, *self.exact[value])]
        text = T.plain(value)
        found = set()
        read_any = False
        for distance, category, name, rest, _ in self.mentions(text):
            read_any = True
            for pos, entry in self.by_key.get((name, category, rest), ()):
                found.add((distance, pos, entry))
        if read_any:
            return (MENTION if found else NO_ENTRY), 0, least(found)
        most, found = self.runs(text)
        return WHOLE, most, least(found)

    def runs(self, text: str) -> tuple[int, set[tuple[int, int, str]]]:
        """Entries that a run of neighbouring tokens means as a whole: the most letters and digits of an entry, and those entries."""
        tokens = [m[0] for m in _RUN.finditer(text)]
        found: list[tuple[int, int, int, str]] = []
        for i in range(len(tokens)):
            run = ""
            for j in range(i, len(tokens)):
                run += tokens[j]
                if len(run) > self.longest + self.max_distance:
                    break
                if digits_of(run) not in self.digits or (j + 1 < len(tokens) and _goes_on(tokens[j], tokens[j + 1])) or (i and tokens[i][0].isdigit() and tokens[i - 1].isdigit()):
                    continue
                for distance, key in self.within(run):
                    if distance <= edits_allowed(key, self.max_distance):
                        found += [(len(key), distance, pos, entry) for pos, entry, tail in self.squeezed[key] if run.endswith(tail)]
        most = max((f[0] for f in found), default=0)
        return most, {f[1:] for f in found if f[0] == most}

    def within(self, run: str) -> list[tuple[int, str]]:
        found = self.cache.get("=" + run)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.cache["=" + run] = self.whole.within(run, self.max_distance)
        return found


_RUN = re.compile(r"[a-z]+|\d+")


def digits_of(text: str) -> str:
    return re.sub(r"\D", "", text)


def least(found: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(f for f in found if f[0] == min(found)[0])


def edits_allowed(key: str, most: int) -> int:
    """By length: none in fewer than four letters, one in fewer than twelve, else ``most``."""
    letters = sum(c.isalpha() for c in key)
    return 0 if letters < 4 else min(most, 1) if letters < 12 else most


def _goes_on(token: str, after: str) -> bool:
    """Whether ``after`` makes the number another model: a variant, or more digits."""
    return token.isdigit() and (after in T.VARIANT_WORDS or after in T.VARIANT_LETTERS) or token.isdigit() and after.isdigit()


def known_rests(entries: list[tuple[int, str]], shards: list[list[tuple[int, str]]]) -> list[dict[tuple, frozenset]]:
    """For each shard the rests, in the whole list, of the names that it has."""
    read = {entry: T.read_entry(entry) for _, entry in entries}
    rests: dict[tuple, set] = {}
    for category, name, rest in filter(None, read.values()):
        rests.setdefault((name, category), set()).add(rest)
    frozen = {k: frozenset(v) for k, v in rests.items()}
    return [{k: frozen[k] for k in {(r[1], r[0]) for r in (read[entry] for _, entry in shard) if r}} for shard in shards]


def map_to_reference(df: DataFrame, value_col: str, reference: DataFrame, entry_col: str, key_cols: list[str] = (), max_distance: int = 1, shard_entries: int = SHARD_ENTRIES, shards_bound: int = 64) -> DataFrame:
    """Each row's value with the reference entry it means.

    Output: ``key_cols``, then ``value``, ``entry`` (NULL if unmatched), ``distance``. Only these
    columns pass, so names of other columns cannot clash (a key column of one of these names is
    rejected). NULL, empty and blank values come out unmatched; repeated rows each come out; two
    entries at one distance are a tie and leave the value unmatched; an empty reference list leaves
    all unmatched; an empty table gives an empty result. Texts are read whole, whatever their length.
    """
    if set(key_cols) & {"value", "entry", "distance"}:
        raise ValueError("key_cols must not be named value, entry or distance")
    listed = [
        (i, r[0]) for i, r in enumerate(sorted(reference.select(entry_col).where(F.col(entry_col).isNotNull()).distinct().limit(shard_entries * shards_bound + 1).collect()))
    ]
    if len(listed) > shard_entries * shards_bound:
        raise ValueError("the reference list exceeds the shards allowed; raise shards_bound")
    shards = [listed[k : k + shard_entries] for k in range(0, len(listed), shard_entries)] or [[]]
    source = df.select(*key_cols, F.col(value_col).cast("string").alias("value"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes), "entry string", "distance int"])

    if len(shards) == 1:
        shared = df.sparkSession.sparkContext.broadcast((shards[0], max_distance))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = ReferenceMatcher(*shared.value)
            for batch in batches:
                hits = [matcher.match(v) for v in batch["value"]]
                yield batch.assign(entry=pd.array([h[0] for h in hits], dtype=object), distance=pd.array([h[1] for h in hits], dtype="Int32"))

        return source.mapInPandas(search, schema)
    # Candidates of the shards, merged per distinct value; each value's own rows join them again.
    values = spread(source.select("value").distinct())

    def run(entries: list[tuple[int, str]], known: dict[tuple, frozenset]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((entries, max_distance, known))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = ReferenceMatcher(*shared.value)
            for batch in batches:
                rows = []
                for v in batch["value"]:
                    kind, length, nearest = matcher.candidates(v)
                    rows += [(v, kind, -length, d, e) for d, _, e in nearest] or ([(v, kind, 0, None, None)] if kind == NO_ENTRY else [])
                out = pd.DataFrame(rows, columns=["value", "kind", "shorter", "distance", "entry"], dtype=object)
                yield out.astype({"kind": "int32", "shorter": "int32", "distance": "Int32"})

        return values.mapInPandas(search, "value string, kind int, shorter int, distance int, entry string")

    parts = [run(s, k) for s, k in zip(shards, known_rests(listed, shards))]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("value").agg(F.min(F.struct("kind", "shorter", "distance")).alias("best"), F.collect_set(F.struct("kind", "shorter", "distance", "entry")).alias("all"))
    nearest = F.expr("transform(filter(all, x -> x.kind = best.kind AND x.shorter = best.shorter AND x.distance = best.distance), x -> x.entry)")
    merged = merged.select("value", F.when(F.size(nearest) == 1, nearest[0]).alias("entry"), F.col("best.distance").alias("distance")).where("entry IS NOT NULL")
    return source.join(merged, "value", "left").select(*source.columns, "entry", "distance")
