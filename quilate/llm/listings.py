"""Grouping listings of the same item: a set-similarity join on normalised title tokens.

A title is reduced to a *hard* part (model, kind of goods, variant, capacity, speed: two different
hard parts are two items) and a set of *soft* tokens (maker, edition, edition number ...). Equal
(hard, soft) sets collapse to one class before anything is joined. Between classes of different
size runs a prefix-filtered join for weighted containment: tokens are scoped by the hard part and
ordered by rarity; a class probes with the prefix that a containment of ``containment`` leaves, the
containing side is indexed by all its tokens, the length filter admits heavier sets only, and the
positional filter needs enough weight from the shared token on. Survivors are verified exactly, and a
star clustering puts each smaller set under the one largest set (centre) that contains it. A set
that several centres contain identifies no single item and stays a group of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilate.llm import titles as T
from quilate.llm.reference_map import ReferenceMatcher, edit_distance
from quilate.session import bounded_rows, ensure_checkpoint_dir

#: Words of the trade that say nothing about which item it is. Fixed values.
TRADE_WORDS = frozenset(
    """
    a al con de del el en la las los para por y the of for with
    unidad ultima placa video grafica tarjeta graphics card vga gpu processor micro microprocesador
    procesador cpu ram memoria memory modulo disco solido estado solid state drive ssd p pc original box
    retail oferta entrega hoy stock imperdible gratis envio new nuevo hot sale alto rendimiento best price
    rgb hasta cuotas meses garantia iva inc gamer edicion edition mod ref s gb g ghz mhz mb tb t tera teras
    gigas mt w v cl threads socket lx nucleos hdmi dp oc triple fan pcie gen gddr nvme m lectura udimm dimm
    ddr x usb c externa termica modular riser
    """.split()
)
#: Accessories; the kind takes the place of the model. Fixed values.
ACCESSORY_KINDS = ("cooler", "pasta", "adaptador", "caja", "gabinete", "ventilador", "soporte", "fuente", "cable")
#: Details of the goods that titles give or leave out at will. Fixed patterns.
_DETAIL = re.compile(
    r"(?<![a-z\d])(?:\d+(?:[.,]\d+)?[\s-]*(?:ghz|mhz|mt\s*/\s*s|w|v|threads|nucleos|meses|cuotas|mm|h)(?![a-z])|cl[\s-]*\d+|pcie(?:[\s-]*gen)?[\s-]*\d(?:\.\d)?(?!\d)"
    r"|gddr\d|socket\s*[a-z]{2}\d|m\.?2(?:\s*2280)?(?!\d)|lectura\s*\d+\s*mb/s|s/\s*cooler|pc[345][\s-]*\d{5}|pcie)"
)
_CAPACITY = re.compile(r"(?<![a-z\d.,])\d+(?:[.,]\d+)?[\s-]*(?:gigabytes?|gigas?|gb|g|terabytes?|teras?|tb|t|mb)(?![a-z])")
_WORDS = re.compile(r"[a-z]+|\d+")
_KINDS = {k: re.compile(rf"(?<![a-z]){k}(?![a-z])") for k in ACCESSORY_KINDS}
_VARIANT = re.compile(r"(\d{4})[\s_-]*(" + "|".join(sorted({*T.VARIANT_WORDS, *T.VARIANT_LETTERS}, key=len, reverse=True)) + r")(?![a-z])")


def normalise(text: str | None, matcher: ReferenceMatcher) -> tuple[str, list[str]]:
    """(hard, sorted soft tokens) of a title; ('', []) if there is nothing to go by."""
    if not text:
        return "", []
    line = T.plain(text)
    found = min(matcher.mentions(line), default=None, key=lambda m: (m[0], m[2]))
    rest = line
    if found:
        _, category, name, exact, span = found
        hard = " ".join([name, *(f"{x:g}" if isinstance(x, float) else str(x) for x in exact)])
        tokens = T.tokenize(line)
        first, last = tokens[span[0]], tokens[span[1] - 1]
        rest = f"{line[: first[1]]} {line[last[1] + len(last[0]) :]}"
        if category == "SSD":
            rest = re.sub(rf"(?<![a-z]){exact[0][:2]}[\s-]*{exact[0][2:]}(?!\d)", " ", rest)
        rest = re.sub(r"(?<!g)ddr[\s-]*\d", " ", _CAPACITY.sub(" ", _DETAIL.sub(" ", rest)))
        if category == "RAM" and f"{exact[2]}" in _DETAIL.sub(" ", line):
            rest = re.sub(rf"(?<!\d){exact[2]}(?!\d)", " ", rest, count=1)
    else:
        hard_parts = []
        no_cooler = re.sub(r"s\s*/\s*cooler", " ", line)
        kinds = [k for k, word in _KINDS.items() if word.search(no_cooler)]
        rate = None
        if gen := re.search(r"(?<!g)ddr[\s_-]*(\d)", line):
            caps = T.capacities(line)
            hard_parts += [f"ddr{gen[1]}", *(f"{gb:g}gb" for _, gb in caps[:1])]
            rate = T.memory_speed(line)  # soft: where it stands alone, it looks like any other number
        elif kinds:
            hard_parts += kinds[:1]
            rest = _KINDS[kinds[0]].sub(" ", no_cooler)
        elif re.search(r"(?<![a-z])(?:ssd|disco|solid|unidad ssd)(?![a-z])", line) or re.search(r"\d\s*(?:tb|tera)", line):
            caps = T.capacities(line)
            hard_parts += ["ssd", *(f"{gb:g}gb" for _, gb in caps[:1])]
        rest = _DETAIL.sub(" ", rest) + (f" {rate}" if rate else "")
        rest = re.sub(r"(?<!g)ddr[\s_-]*\d", " ", _CAPACITY.sub(" ", rest))
        # A line code such as "mx 92", a tier and number such as "7-7600f", or a variant after a number.
        for m in re.finditer(r"(?<![a-z])([a-z]{2})[\s_-]*(\d{2})(?!\d)", rest):
            hard_parts.append(m[1] + m[2])
        rest = re.sub(r"(?<![a-z])[a-z]{2}[\s_-]*\d{2}(?!\d)", " ", rest)
        hard_parts += [m[1] + m[2] for m in _VARIANT.finditer(rest)]
        rest = _VARIANT.sub(" ", rest)
        hard = " ".join(hard_parts)
    soft = {w for w in _WORDS.findall(rest) if w not in TRADE_WORDS and (len(w) > 1)}
    return hard, sorted(soft)


def title_tokens(df: DataFrame, id_col: str, title_col: str, seller_col: str, reference: DataFrame, entry_col: str, entries_bound: int = 200_000) -> DataFrame:
    """(id, seller, hard, soft) of each row; NULL or empty titles give an empty token set."""
    entries = [(i, r[0]) for i, r in enumerate(sorted(bounded_rows(reference.select(entry_col).where(F.col(entry_col).isNotNull()).distinct(), entries_bound, "the reference list")))]
    shared = df.sparkSession.sparkContext.broadcast(entries)
    source = df.select(F.col(id_col).alias("id"), F.col(seller_col).cast("string").alias("seller"), F.col(title_col).cast("string").alias("title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = ReferenceMatcher(shared.value)
        for batch in batches:
            read = [normalise(t, matcher) for t in batch["title"]]
            yield pd.DataFrame({"id": batch["id"], "seller": batch["seller"], "hard": [r[0] for r in read], "soft": [r[1] for r in read]})

    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, seller string, hard string, soft array<string>")


def spelling_corrections(words: DataFrame, ratio: int = 4, short_ratio: int = 50) -> DataFrame:
    """(word, better): words within one edit of a word that is at least ``ratio`` times as frequent.

    Two words within one edit share a form with one letter left out (or the word itself); that
    equi-join proposes, the metric decides, and of several the most frequent counts. Words of
    digits and words under three letters stay; under five letters ``short_ratio`` holds.
    """
    counts = words.where(F.col("word").rlike("^[a-z]{3,40}$")).groupBy("word").agg(F.count("*").alias("n"))
    forms = F.expr("array_union(array(word), transform(sequence(1, length(word)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1))))")
    formed = counts.select("word", "n", F.explode(forms).alias("form"))
    a, b = formed.alias("a"), formed.alias("b")
    least = F.when(F.length("a.word") < 5, short_ratio).otherwise(ratio)
    pairs = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.n") * least <= F.col("b.n"))).select(F.col("a.word").alias("word"), F.col("b.word").alias("better"), F.col("b.n").alias("n")).distinct()

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(p, q, 1) for p, q in zip(x, y)], dtype="int32")

    return pairs.where(distance("word", "better") <= 1).groupBy("word").agg(F.max_by("better", F.struct("n", "better")).alias("better"))


def correct(tokens: DataFrame) -> DataFrame:
    """The tokens with misspelt soft words replaced; sets whose words are all known do not move."""
    fixes = spelling_corrections(tokens.select(F.explode("soft").alias("word")))
    words = tokens.select("hard", "soft").distinct().select("hard", "soft", F.explode("soft").alias("word"))
    changed = words.join(fixes, "word").groupBy("hard", "soft").agg(F.map_from_entries(F.collect_list(F.struct("word", "better"))).alias("fix"))
    joined = tokens.join(changed, ["hard", "soft"], "left")
    fixed = F.when(F.col("fix").isNull(), F.col("soft")).otherwise(F.array_sort(F.array_distinct(F.transform("soft", lambda w: F.coalesce(F.try_element_at("fix", w), w)))))
    return joined.select("id", "seller", "hard", fixed.alias("soft"))


def containment_links(classes: DataFrame, containment: float = 1.0) -> DataFrame:
    """(``class_key``, ``in_key``): sets of which ``containment`` of the weight lies in another set of the same hard part.

    The other set weighs more (of equal weights the later key), so no pair comes out twice. Weights
    grow with rarity among the sets of the hard part; with ``containment`` 1 these are the proper
    supersets. NULL and empty sets link to nothing. Keys of many sets are split by the adaptive
    skew join: both joins on tokens are inner ones.
    """
    if not 0 < containment <= 1:
        raise ValueError("containment lies above 0 and at most at 1")
    tokens = classes.where(F.size("soft") > 0).select("class_key", "hard", F.explode("soft").alias("token"))
    seen = tokens.groupBy("hard", "token").agg(F.count("*").alias("df"))
    total = classes.groupBy("hard").agg(F.count("*").alias("classes"))
    weight = F.log(1 + F.col("classes") / F.col("df")) + 0.1
    # The sets of a hot hard part (or of none) never meet on that key alone: weights are made per token first.
    weights = seen.join(total, "hard").select("hard", "token", F.struct(F.col("df"), "token", weight.alias("w")).alias("t"))
    weighed = tokens.join(weights, ["hard", "token"]).select("class_key", "hard", "t")
    ordered = weighed.groupBy("class_key", "hard").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Both sides of the join read the ordered sets: the cut keeps the plan, and the driver's memory, small.
    sum_of = lambda ts: F.aggregate(ts, F.lit(0.0), lambda a, t: a + t["w"])
    ordered = ordered.withColumn("mass", sum_of("ts")).checkpoint()
    placed = ordered.select("class_key", "hard", "ts", "mass", F.posexplode("ts").alias("at", "x")).select("class_key", "hard", "ts", "mass", F.col("x.token").alias("token"), sum_of(F.slice("ts", 1, F.col("at"))).alias("before"))
    need = F.col("mass") * containment - 1e-9
    # Prefix filter: the first shared token of a pair has no more weight before it than the pair may lack.
    probe = placed.where(F.col("before") <= F.col("mass") - need)
    index = placed.select("hard", "token", F.col("class_key").alias("in_key"), F.col("ts").alias("in_ts"), F.col("mass").alias("in_mass"), F.col("before").alias("in_before"))
    # Length filter by weight, and positional filter: what follows the first shared token on either side bounds the shared weight.
    heavier = F.struct("in_mass", "in_key") > F.struct("mass", "class_key")
    room = F.least(F.col("mass") - F.col("before"), F.col("in_mass") - F.col("in_before")) >= need
    pairs = probe.join(index, ["hard", "token"]).where(heavier & room)
    shared = sum_of(F.filter("ts", lambda t: F.exists("in_ts", lambda u: u["token"] == t["token"])))
    return pairs.where(shared >= need).select("class_key", "in_key").distinct()


def containment_stars(classes: DataFrame, containment: float = 1.0) -> DataFrame:
    """(class_key, centre) of classes (class_key, hard, soft): the star clustering of the module text.

    Centres are the sets that lie in no other. A set that lies in exactly one centre joins it; one
    that lies in several, or (below containment 1) only in sets that are no centres, stays alone.
    """
    links = containment_links(classes, containment).checkpoint()
    # Only centres (sets that no other set contains) gather; exactly one may.
    inner = links.select(F.col("class_key").alias("in_key")).distinct()
    stars = links.join(inner, "in_key", "left_anti").groupBy("class_key").agg(F.min("in_key").alias("centre"), F.count("*").alias("centres"))
    return classes.select("class_key").join(stars.where("centres = 1"), "class_key", "left").select("class_key", F.coalesce("centre", "class_key").alias("centre"))


def group_listings(df: DataFrame, reference: DataFrame, id_col: str = "id", title_col: str = "title", seller_col: str = "seller", entry_col: str = "sku", containment: float = 1.0) -> DataFrame:
    """One row per listing: ``id``, ``seller``, ``group_id`` (NULL if the title names nothing).

    Only the three columns named are read, so other columns cannot clash. Repeated rows keep their
    group; an empty table gives an empty result; titles are read whole.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tokens = correct(title_tokens(df, id_col, title_col, seller_col, reference, entry_col).checkpoint())
    keyed = tokens.withColumn("class_key", F.when((F.size("soft") > 0) | (F.col("hard") != ""), F.concat_ws("|", F.col("hard"), "soft"))).checkpoint()
    classes = keyed.where(F.col("class_key").isNotNull()).select("class_key", "hard", "soft").dropDuplicates(["class_key"]).checkpoint()
    stars = containment_stars(classes, containment)
    return keyed.join(stars, "class_key", "left").select("id", "seller", F.col("centre").alias("group_id")).checkpoint()


def same_item_pairs(groups: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of one group and different sellers, as the result's definition wants.

    A group's rows are cut into blocks of 256; pairs of blocks, not the group, go to the tasks.
    """
    block = 256
    n = Window.partitionBy("group_id", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    rows = groups.where("group_id IS NOT NULL AND seller IS NOT NULL").select("group_id", "id", "seller")
    blocked = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("part", F.concat_ws(".", "salt", F.floor((F.row_number().over(n) - 1) / block)))
    small = blocked.groupBy("group_id").agg(F.count("*").alias("size"), F.collect_set("part").alias("parts")).where("size > 1")
    joined = blocked.join(small, "group_id")
    one = joined.select("group_id", "id", "seller", F.when(F.col("size") <= block, F.lit("")).otherwise(F.col("part")).alias("a"), F.when(F.col("size") <= block, F.array(F.lit(""))).otherwise(F.col("parts")).alias("parts"))
    # A pair of blocks meets once, the lower block on the left.
    left = one.select("group_id", "id", "seller", "a", F.explode(F.filter("parts", lambda p: p >= F.col("a"))).alias("b"))
    right = one.select("group_id", F.col("id").alias("id_2"), F.col("seller").alias("seller_2"), F.explode(F.filter("parts", lambda p: p <= F.col("a"))).alias("a"), F.col("a").alias("b"))
    pairs = left.join(right, ["group_id", "a", "b"]).where(((F.col("a") < F.col("b")) | (F.col("id") < F.col("id_2"))) & (F.col("id") != F.col("id_2")) & (F.col("seller") != F.col("seller_2")))
    return pairs.select(F.least("id", "id_2").alias("id_a"), F.greatest("id", "id_2").alias("id_b"))
