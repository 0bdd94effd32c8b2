import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quilate.llm import leaks as L


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=150, deadline=None)
def test_suffix_array(s):
    a = np.array([*s, 0])
    assert L.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.integers(1, 5), min_size=3, max_size=3))
@settings(max_examples=150, deadline=None)
def test_search_and_locate(s, p):
    index = L.FMIndex(np.array(s), 5, sample=4)
    low, high = index.search(np.array([p]))
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [i for i in range(len(s) - 2) if s[i : i + 3] == p]


VOCABULARY = [f"w{i}" for i in range(400)]


def passages():
    rng = random.Random(1)
    return [(k, " ".join(rng.choices(VOCABULARY, k=120))) for k in (7, 8, 9)]


def test_found_spans(spark):
    items = passages()
    rng = random.Random(2)
    p = {k: t.split() for k, t in items}
    noise = lambda n: " ".join(rng.choices([f"z{i}" for i in range(50)] + VOCABULARY[:5], k=n))
    changed = [w if i % 10 else "otro" for i, w in enumerate(p[7])]
    docs = [
        (1, noise(50) + " " + " ".join(p[7]) + " " + noise(10)), (2, noise(30) + " <p>" + "</b>, ".join(w.upper() for w in p[8][20:80]) + "</p>"), (3, " ".join(changed)), (4, noise(200)), (5, " ".join(p[9][:25])),
        (6, " ".join(p[9][:30]) + noise(40) + " ".join(p[9][60:90])), (7, None), (8, ""), (9, " ".join(p[7]) + " " + " ".join(p[9])), (10, noise(5000)), (3, " ".join(changed)), (11, "\n".join(p[8][:55]) + " extra " + " ".join(p[8][56:])),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, share string")
    ref = spark.createDataFrame(items, "item_id long, passage string")
    want = sorted([(1, 7), (2, 8), (3, 7), (3, 7), (9, 7), (9, 9), (11, 8)])
    for shard in (1_000_000, 100):
        assert sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(df, ref, shard_words=shard).collect()) == want
    assert L.find_leaks(df, ref.limit(0)).count() == 0 and L.find_leaks(df.limit(0), ref).count() == 0


def test_words():
    assert L.words_of("Láctea&nbsp;<b>AÑO</b> https://x.example/q resumi&oacute; cafÃ© fin-\nal") == ["lactea", "ano", "resumio", "cafe", "final"]
    assert L.words_of(None) == [] and L.words_of("<>") == []


def test_tags_of_any_length_and_text_that_is_no_tag():
    tag = '<SPAN style="' + "color: red; " * 200 + '">'
    assert L.words_of(f"uno {tag}dos</span> tres") == ["uno", "dos", "tres"]
    prose = "si a < b " + "entonces " * 100 + "c > d"
    assert L.words_of(prose) == prose.replace("<", " ").replace(">", " ").split()
    assert len(L.words_of("<a " * 100_000)) == 100_000


def brute_growth(doc, item, diagonal, first, last):
    """One stretch, word by word."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)

    def grow(places):
        score = best = reach = 0
        for k, at in enumerate(places, 1):
            score += 1 if item[at] == doc[at + diagonal] else -2
            if item[at] == doc[at + diagonal] and score >= best:
                best, reach = score, k
            if score < best - L.GIVE_UP:
                break
        return reach

    last += grow(range(last, high))
    first -= grow(range(first - 1, low - 1, -1))
    return first, last, sum(item[at] == doc[at + diagonal] for at in range(first, last))


def test_stretches_grow_as_one_by_one():
    rng = random.Random(4)
    docs = [[rng.randint(1, 3) for _ in range(rng.randint(5, 40))] for _ in range(30)]
    items = [[rng.randint(1, 3) for _ in range(rng.randint(5, 30))] for _ in range(10)]
    starts, item_starts = np.cumsum([0] + [len(d) + 1 for d in docs]), np.cumsum([0] + [len(w) for w in items])
    s = np.concatenate([[*d, 1] for d in docs])
    cases = []
    while len(cases) < 300:
        d, i = rng.randrange(30), rng.randrange(10)
        diagonal = rng.randint(-len(items[i]) + 1, len(docs[d]) - 1)
        low, high = max(0, -diagonal), min(len(items[i]), len(docs[d]) - diagonal)
        first = rng.randint(low, high)
        cases.append((d, i, diagonal, first, rng.randint(first, high)))
    d, i, diagonal, first, last = (np.array(c) for c in zip(*cases))
    got = L.grow_stretches(s, starts[d], np.array([len(docs[k]) for k in d]), np.concatenate(items), item_starts[i], np.array([len(items[k]) for k in i]), diagonal, first, last)
    assert list(zip(*(g.tolist() for g in got))) == [brute_growth(docs[a], items[b], g, f, t) for a, b, g, f, t in cases]


def test_marks_of_all_planes():
    import unicodedata

    text = "".join(chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000)
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert L.without_marks(text) == plain(text) and L.without_marks(text[:60_000]) == plain(text[:60_000])


def test_items_of_several_passes(spark):
    items = [(k, " ".join(random.Random(k).choices(VOCABULARY, k=60))) for k in range(40)]
    df = spark.createDataFrame([(k, f"antes {t} luego") for k, t in items] + [(99, items[3][1] + " " + items[8][1])], "doc_id long, text string")
    ref = spark.createDataFrame(items, "item_id long, passage string")
    want = sorted([(k, k) for k in range(40)] + [(99, 3), (99, 8)])
    for bound in (20_000, 16):
        assert sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(df, ref, items_a_part=bound).collect()) == want
