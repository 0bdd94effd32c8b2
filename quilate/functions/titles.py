"""Reading product mentions out of free text: names, model numbers, capacities, speeds.

A *mention* is ``(category, name, rest)``.  ``name`` is the word that carries spelling mistakes
(a chip family, a memory or disk line); ``rest`` holds everything in which one different character
is a different product (number, suffix, capacity, speed) and therefore has to agree exactly.
The same reader is used for reference entries and for typed values, so both sides get one form.
"""

from __future__ import annotations

import re
import unicodedata

#: Variant words and letters that may follow a model number. Fixed values; a word outside the
#: reference list still has to be read, because it makes the value another product.
VARIANT_WORDS = ("ti", "xt", "plus", "max", "ultra", "lite", "super", "pro", "mini", "xtx", "se", "gt", "xl")
VARIANT_LETTERS = ("x", "f", "g", "k", "ks", "kf", "t", "h", "u", "e", "s", "gt", "ge", "xe")

_TOKEN = re.compile(r"\d+(?:[.,]\d+)?|[a-z]+|[^\sa-z\d]")
_GEN = re.compile(r"(?<!g)ddr[\s_-]*(\d)")
_CAP = re.compile(r"(?<![\d.,])(\d+(?:[.,]\d+)?)[\s_-]*(gigabytes?|gigas?|gb|g|terabytes?|teras?|tb|t|mb)(?![a-z])(?!\s*/\s*s)")
_SPEED = re.compile(r"(?<!\d)(\d{4,5})[\s_-]*(?:mhz|mt\s*/\s*s|mt(?![a-z]))")
_PC = re.compile(r"pc[345][\s_-]*(\d{5})(?!\d)")
_CODE = re.compile(r"(?<![a-z])([a-z]{2})[\s_-]*(\d{2})(?!\d)")
_BARE = re.compile(r"(?:ddr[\s_-]*\d|(?:gb|g|gigas|mb))[\s_|-]+(\d{4})(?!\d)(?![\s_-]*(?:gb|g|mb)(?![a-z]))")


def plain(text: str) -> str:
    """Lower case without accents or compatibility forms."""
    if text.isascii():
        return text.lower()
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(c for c in decomposed if not unicodedata.combining(c)).lower()


def capacity_gb(number: str, unit: str) -> float | None:
    """Capacity in gigabytes; binary multiples (1024, 2048 ...) are read as the round size."""
    try:
        value = float(number.replace(",", "."))
    except ValueError:
        return None
    if unit[0] == "t":
        value *= 1000
    elif unit[0] == "m":
        value /= 1024
    if value >= 1000 and value % 1024 == 0:
        value = value / 1024 * 1000
    return round(value, 3)


def capacities(text: str) -> list[tuple[int, float]]:
    """(position, gigabytes) of every capacity in the text."""
    found = []
    for m in _CAP.finditer(text):
        gb = capacity_gb(m[1], m[2])
        if gb is not None:
            found.append((m.start(), gb))
    return found


def memory_speed(text: str, after_name: str = "", known: frozenset = frozenset()) -> int | None:
    """Transfer rate in MT/s: as MHz, MT/s or a PC module rating, else bare after size, kind or name.

    Of two bare numbers the one among ``known`` rates counts, else the one after size or kind.
    """
    if m := _SPEED.search(text):
        return int(m[1])
    if m := _PC.search(text):
        return int(round(int(m[1]) / 8))
    bare = [int(m[1]) for m in _BARE.finditer(text)] + ([int(after_name)] if after_name else [])
    return next((b for b in bare if b in known), bare[0] if bare else None)


def _number_parts(tokens: list[tuple[str, int]], i: int, cpu: bool) -> tuple[list[str], int]:
    """Model number and suffix from token i on, and the index after them."""
    out = [tokens[i][0]]
    j = i + 1
    known = VARIANT_LETTERS if cpu else VARIANT_WORDS
    k = j
    if k < len(tokens) and tokens[k][0] in "-_/" and len(tokens[k][0]) == 1:
        k += 1
    if k < len(tokens) and tokens[k][0] in known:
        after = tokens[k + 1][0] if k + 1 < len(tokens) else ""
        if not (tokens[k][0] == "s" and after == "/"):
            return [*out, tokens[k][0]], k + 1
    return out, j


def tokenize(text: str) -> list[tuple[str, int]]:
    return [(m[0], m.start()) for m in _TOKEN.finditer(text)]


def is_number4(token: str) -> bool:
    return len(token) == 4 and token.isdigit()


def _skip(tokens: list[tuple[str, int]], i: int, step: int) -> int:
    """Next index past one separator."""
    i += step
    if 0 <= i < len(tokens) and tokens[i][0] in ("-", "_", "/", "."):
        i += step
    return i


def read_rest(category: str, text: str, tokens: list[tuple[str, int]], at: int, known: frozenset = frozenset()) -> tuple[tuple, tuple[int, int]] | None:
    """The exact part of the mention whose name is token ``at``; with the token span it covers.

    ``known`` are the exact parts that the reference has for that name; they decide only between two
    numbers that may both be meant (before and after a name, bare transfer rates).
    """
    n = len(tokens)
    if category == "GPU":
        j = _skip(tokens, at, 1)
        unit = tokens[j + 1][0] if j + 1 < n else ""
        after = j if j < n and is_number4(tokens[j][0]) and unit not in ("mb", "gb", "mhz", "mt") else None
        # before: number [suffix] name
        b = _skip(tokens, at, -1)
        before = None
        if b >= 0 and is_number4(tokens[b][0]):
            before = (b, None)
        elif b >= 0 and tokens[b][0] in VARIANT_WORDS:
            c = _skip(tokens, b, -1)
            if c >= 0 and is_number4(tokens[c][0]):
                before = (c, tokens[b][0])
        if after is not None and before is not None:
            numbers = {r[0] for r in known}
            if tokens[after][0] not in numbers and tokens[before[0]][0] in numbers:
                after = None
        if after is not None:
            parts, end = _number_parts(tokens, after, False)
            return tuple(parts), (at, end)
        if before is not None:
            number = tokens[before[0]][0]
            return ((number, before[1]) if before[1] else (number,)), (before[0], at + 1)
        return None
    if category == "CPU":
        j = _skip(tokens, at, 1)
        if j < n and len(tokens[j][0]) == 1 and tokens[j][0].isdigit():
            k = _skip(tokens, j, 1)
            if k < n and is_number4(tokens[k][0]):
                parts, end = _number_parts(tokens, k, True)
                return (tokens[j][0], *parts), (at, end)
        return None
    if category == "RAM":
        gen = _GEN.search(text)
        caps = [gb for _, gb in capacities(text)]
        j = at + 1
        while j < n and tokens[j][0] in ("-", "|", "_"):
            j += 1
        named = tokens[j][0] if j < n and is_number4(tokens[j][0]) and not (j + 1 < n and tokens[j + 1][0] == "mb") else ""
        speed = memory_speed(text, named, frozenset(r[2] for r in known if r[:2] == (gen[1], caps[0])) if gen and caps else frozenset())
        if not gen or not caps or speed is None:
            return None
        return (gen[1], caps[0], speed), (at, at + 1)
    if category == "SSD":
        code = None
        best = None
        for m in _CODE.finditer(text):
            if m[1] in ("cl", "pc", "no", "de", "lx", "gb", "tb", "mb"):
                continue
            distance = abs(m.start() - tokens[at][1])
            if best is None or distance < best:
                best, code = distance, m[1] + m[2]
        caps = [gb for _, gb in capacities(text)]
        if not code or not caps:
            return None
        return (code, caps[0]), (at, at + 1)
    return None


def read_entry(entry: str) -> tuple[str, str, tuple] | None:
    """(category, name, rest) of a reference entry; the category comes from its shape, not a column."""
    text = plain(entry)
    tokens = tokenize(text)
    words = [i for i, (t, _) in enumerate(tokens) if t.isalpha() and len(t) >= 3]
    if not words:
        return None
    at = words[0]
    if _GEN.search(text):
        category = "RAM"
    elif capacities(text) and _CODE.search(text):
        category = "SSD"
    elif at + 1 < len(tokens) and len(tokens[at + 1][0]) == 1 and tokens[at + 1][0].isdigit():
        category = "CPU"
    else:
        category = "GPU"
    found = read_rest(category, text, tokens, at)
    return (category, tokens[at][0], found[0]) if found else None
