import random

import numpy as np

from quilate.llm import spam as S

PROSE = "El paquete llegó en una caja golpeada pero todo funciona y no me arrepiento de la compra. La memoria que venía en el combo no era la anunciada, así que preferí esperar a que cambie el precio. "


def corpus():
    rng = random.Random(4)
    words = "procesador barato comprar oferta precio tienda gamer placa video nuevo descuento envio memoria disco".split()
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choices(PROSE.split(), k=5)) + " " + PROSE * rng.randint(1, 4), f"https://a{i % 3}.example/x"))
        kind = i % 3
        text = {0: " ".join(rng.choices(words, k=80)), 1: "\n".join(f'<a href="https://q.example/{k}">{rng.choice(words)} {rng.choice(words)}</a>' for k in range(25)), 2: " ".join(f"#{rng.choice(words)}_{rng.choice(words)}" for _ in range(40))}[kind]
        rows.append((1000 + i, text, f"https://b{i % 3}.example/x"))
    specs = "Modelo X con buen precio para la oficina.\n" + "\n".join(f"* Dato{k}: {k} W" for k in range(8)) + "\n" + "\n".join(f"- Placa {k} — U$S {k}00" for k in range(8))
    rows += [(2000, specs, None), (2001, None, None), (2002, "", "https://a0.example"), (2003, PROSE * 3 + "\nhttps://a.example/1\nhttps://a.example/2", "x"), (2004, PROSE * 2000, "x"), (5, PROSE, "https://a0.example/x")]
    return rows


def test_pages(spark):
    df = spark.createDataFrame([(*r, "h") for r in corpus()], "doc_id long, text string, url string, host string")
    got = S.spam_pages(df).collect()
    assert len(got) == len(corpus())
    wrong = [r["doc_id"] for r in got if r["is_spam"] != (1000 <= r["doc_id"] < 2000)]
    assert wrong == []
    assert S.spam_pages(df.limit(0)).count() == 0
    assert {r["is_spam"] for r in S.spam_pages(df.where("doc_id < 3")).collect()} == {False}


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    trees = S.bagged_trees(x[:500], y[:500])
    p = np.mean([t.predict(x[500:]) for t in trees], axis=0)
    assert ((p > 0.5) == y[500:]).mean() > 0.93


def varied(n):
    """Prose that hardly repeats itself."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    small = "el la los de que no con para por se su un una en y pero como más sin sobre".split()
    sentence = lambda: " ".join(rng.choice(small) if k % 2 else word() for k in range(rng.randint(8, 15))).capitalize() + ". "
    return [(5000 + i, "".join(sentence() for _ in range(rng.randint(4, 9))), "https://c.example/x") for i in range(n)]


def test_the_two_views_share_nothing_and_the_trees_decide(spark, monkeypatch):
    assert not set(S.FEATURES) & set(S.LABEL_VIEW)
    df = spark.createDataFrame([*corpus(), *varied(80)], "doc_id long, text string, url string")
    report = {r["stage"]: r for r in S.stage_report(df, train_spam=30, train_sound=40).collect()}
    assert set(report) == {"trees", "hosts"} and report["trees"]["spam"] >= 5 and report["trees"]["held_out"] >= report["trees"]["spam"] + 8
    assert all(r["both"] >= 0.95 * r["spam"] and r["found"] <= r["both"] + 2 for r in report.values())
    assert S.stage_report(df.limit(0)).count() == 0


def test_label_view():
    prose, keys = S.label_view(PROSE * 3), S.label_view("placa barata oferta; " * 60)
    assert keys[0] < 0.1 < prose[0] and keys[1] == 0 < prose[1] and S.label_view(None) == S.label_view("  ") == [1.0, 0, 0, 0, 0, 0, 0]
    assert S.label_view("#a #b")[3] == 1 and S.label_view("https://a.example/x")[2] == 1


def test_long_tags_are_no_page_text():
    tag = '<img src="data:' + "abc, def; " * 200 + '">'
    assert [(line.split(), kind) for line, kind in S._lines(f"uno {tag} dos")] == [(["uno", "dos"], S.PLAIN)]
