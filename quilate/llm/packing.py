"""Packing texts into containers of fixed token capacity: harmonic classes with refined bins.

Lengths are partitioned at the reciprocals of the capacity (C, C/2, C/3 ...). A bin of class k
takes exactly k documents. Classes up to 32 are refined: k documents of at most b tokens leave room
for C - k b, so such a bin also takes fixed counts of documents of smaller classes whose upper
bounds fit into that room. Every bin pattern thus is a count of documents by class, settled by the
classes' bounds: each shard of documents (by hash of the id) fills its bins alone, from ranks within its classes.
The few documents that remain of each class in a shard go by first fit decreasing.

Only (id, tokens) pairs reach the packing; a shard has a bounded number of them by its hash range.
Rounding never overfills: bounds are integers, and each pattern's worst case is at most C.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Classes at the reciprocals up to this one; shorter texts all belong to the last.
CLASSES = 128
#: Classes whose bins take partners, and how many partner classes (or refills of one) a bin may have.
REFINED, PARTNERS = 32, 4
#: Documents a shard holds on average.
SHARD_DOCUMENTS = 20_000
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-splitting pattern of the byte-level vocabulary. Fixed value.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_tokenizer(path: str):
    """A tiktoken encoding from a file of ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, n_tokens) of each row; NULL and empty texts have no tokens. Whole texts are read.

    The vocabulary file is read by the driver's path and sent to the executors.
    """
    df.sparkSession.sparkContext.addFile(tokenizer_path)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(SparkFiles.get(os.path.basename(tokenizer_path)))
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": np.array(counts, dtype="int64")})

    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, n_tokens bigint")


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin numbers by first fit decreasing; for the remainders of the classes only."""
    bins: list[int] = []
    out = np.empty(len(sizes), dtype="int64")
    for i in np.argsort(-sizes, kind="stable"):
        for b, room in enumerate(bins):
            if room >= sizes[i]:
                bins[b] -= int(sizes[i])
                out[i] = b
                break
        else:
            out[i] = len(bins)
            bins.append(capacity - int(sizes[i]))
    return out


def pack_shard(sizes: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> np.ndarray:
    """Bin number of each size (all between 1 and capacity)."""
    n = len(sizes)
    bins = np.full(n, -1, dtype="int64")
    if not n:
        return bins
    cls = np.minimum(capacity // sizes, classes)
    # Positions by class, largest first, so that consecutive ranks are alike.
    order = np.argsort(-sizes, kind="stable")
    queue = {k: list(order[cls[order] == k]) for k in np.unique(cls)}
    made = 0
    for k in range(1, REFINED + 1):
        if k not in queue:
            continue
        rest, mine = [], queue[k]
        for at in range(0, len(mine) // k * k, k):
            group = mine[at : at + k]
            # The pattern: k documents of this class up to the group's largest, then fixed counts of partner classes.
            room, partners = capacity - k * int(sizes[group[0]]), []
            while room > 0 and len(partners) < PARTNERS:
                c = next((c for c in range(max(-(-capacity // room), k + 1), classes) if queue.get(c)), None)
                if c is None:
                    break
                count = min(room // (capacity // c), len(queue[c]))
                if not count:
                    break
                partners += [queue[c].pop() for _ in range(count)]
                room -= count * (capacity // c)
            if partners or k == 1:
                bins[group + partners] = made
                made += 1
            else:
                rest += group
        queue[k] = rest + mine[len(mine) // k * k :]
    left = []
    for k, mine in queue.items():
        full = len(mine) // k * k
        if full:
            idx = np.array(mine[:full])
            bins[idx] = made + np.arange(full) // k
            made += full // k
        left += mine[full:]
    if left:
        left = np.array(left)
        bins[left] = made + first_fit(sizes[left], capacity)
    return bins


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer_path: str = DEFAULT_TOKENIZER, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``n_tokens``, ``container``.

    A text of at most ``capacity`` tokens is one piece, whole in one container. A longer one is cut
    into full containers and a remainder that is packed like a text. Texts without tokens (NULL or
    empty) need no container: they come out with NULL. Repeated ids are packed as separate rows.
    Only the two columns named are read, so other columns cannot clash.
    """
    shards = max(1, -(-df.count() // shard_documents))
    sized = count_tokens(df, id_col, text_col, tokenizer_path)
    shard = F.pmod(F.xxhash64("id", "n_tokens"), F.lit(shards)).cast("int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        where = int(group["shard"].iloc[0])
        group = group.sort_values(["n_tokens", "id"], kind="stable")
        total = group["n_tokens"].to_numpy()
        whole, rest = total // capacity, total % capacity
        pieces = pd.DataFrame({"doc_id": group["id"].to_numpy(), "piece": whole, "n_tokens": rest})
        packed = pieces[pieces["n_tokens"] > 0].copy()
        numbers = pack_shard(packed["n_tokens"].to_numpy(), capacity)
        packed["container"] = [f"{where}-{b}" for b in numbers]
        empty = pieces[(total == 0)].assign(container=None)
        times = np.repeat(np.arange(len(group)), whole)
        nth = np.arange(len(times)) - np.repeat(np.cumsum(whole) - whole, whole)
        full = pd.DataFrame({"doc_id": group["id"].to_numpy()[times], "piece": nth, "n_tokens": np.full(len(times), capacity), "container": [f"{where}-f{i}" for i in range(len(times))]})
        return pd.concat([packed, full, empty], ignore_index=True)[["doc_id", "piece", "n_tokens", "container"]]

    kind = dict(sized.dtypes)["id"]
    return sized.withColumn("shard", shard).groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece int, n_tokens int, container string")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, unused room and fill of a packing, in one row."""
    per = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum(capacity - F.col("used")).alias("unused"), F.max("used").alias("fullest")).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))
