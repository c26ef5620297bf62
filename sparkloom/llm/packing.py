"""Filling fixed-capacity containers with items by minimum bin slack.

Texts are measured in tokens of a public tokenizer. A text longer than the capacity is split into pieces that
fill a container each and a rest; no other text is split. Which item of a given length goes where is of no
consequence, so the packing works on the histogram of lengths, which has no more entries than the capacity
however many texts there are. Per container a bitset subset-sum dynamic programme over the lengths still there
finds the fullest feasible combination next to the longest one left; that combination is taken off as often as
the histogram allows and becomes a pattern for so many containers. Then every item is numbered within its
length and looks up its container.

Scale: texts are tokenized once, in Arrow batches; the lengths are written to the shared folder and numbered
within (length, random lot) so that no length is gathered into one task. The driver sees the histogram only
(at most capacity rows); the table of patterns has at most capacity * log2(items) entries.

Defined results: null texts count as empty; items without tokens take no room and lie in container 0; repeated
rows and ids are items of their own; equal lengths are interchangeable; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import cut

CAPACITY = 2048
#: Items that one task numbers at a time within a length, on average.
LOT_ITEMS = 200_000
#: Default vocabulary file of the installed public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of the default tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """key, tokens (the whole text's) for every row."""
    path, pattern = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return documents.select(F.col(key), count(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def pieces(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Items: key, piece, token_start, tokens. Only what exceeds the capacity is in several pieces."""
    last = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("tokens") / capacity) - 1)
    return counts.select(key, F.col("tokens").alias("_all"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        key,
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("token_start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("_all") - F.col("piece") * capacity).alias("tokens"),
    )


def fullest(sizes: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that holds the longest item: how many of each length.

    ``sizes`` has lengths in falling order with their numbers. Bit s of the set says that the sum s is reached.
    """
    longest = next(iter(sizes))
    room, reached, steps = capacity - longest, 1, []
    mask = (1 << (room + 1)) - 1
    for size, n in sizes.items():
        left = min(n - (size == longest), room // size)
        chunk = 1
        while left > 0 and not reached >> room & 1:
            take = min(chunk, left)
            steps.append((size, take, reached))
            reached |= (reached << (size * take)) & mask
            left -= take
            chunk *= 2
        if reached >> room & 1:
            break
    target, chosen = reached.bit_length() - 1, {longest: 1}
    for size, take, before in reversed(steps):
        if not before >> target & 1:
            target -= size * take
            chosen[size] = chosen.get(size, 0) + take
    return chosen


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack on a histogram: (number of containers, items of each length in one)."""
    left = {s: histogram[s] for s in sorted(histogram, reverse=True) if s > 0 and histogram[s] > 0}
    if left and next(iter(left)) > capacity:
        raise ValueError("an item exceeds the capacity")
    out = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[s] // k for s, k in chosen.items())
        out.append((times, chosen))
        for s, k in chosen.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
    return out


def _intervals(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Per length and run of numbers: length, first number, items per container, first container; sorted."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for times, chosen in plan:
        for size, k in chosen.items():
            rows.append((size, used.get(size, 0), k, container))
            used[size] = used.get(size, 0) + times * k
        container += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return tuple(table.T)


def numbered(items: DataFrame, key: str, lots: int) -> DataFrame:
    """Items with ``number``, from 0 without gaps within each length; no length is gathered into one task."""
    lotted = items.withColumn("_lot", F.col("lot") % lots)
    counts = lotted.groupBy("tokens", "_lot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tokens").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "_lot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("tokens", "_lot").orderBy(key, "piece", "lot")
    ranked = lotted.withColumn("_rn", F.row_number().over(within))
    return ranked.join(offsets, ["tokens", "_lot"]).withColumn("number", F.col("_offset") + F.col("_rn") - 1).drop("_lot", "_rn", "_offset")


def pack(items: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, lot_items: int = LOT_ITEMS) -> DataFrame:
    """key, piece, token_start, tokens, container for every item of ``pieces``."""
    held = cut(items.withColumn("lot", F.floor(F.rand(7) * (1 << 30))))
    histogram = {r.tokens: r.n for r in held.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    size, first, per, container = _intervals(patterns(histogram, capacity))
    lots = max(1, -(-max(histogram.values(), default=1) // lot_items))
    # one sorted key for (length, number): numbers are below 2^48
    keys = size * (1 << 48) + first

    @F.pandas_udf("long")
    def place(tokens: pd.Series, number: pd.Series) -> pd.Series:
        t, n = tokens.to_numpy(np.int64), number.to_numpy(np.int64)
        out = np.zeros(len(t), dtype=np.int64)
        real = t > 0
        at = np.searchsorted(keys, t[real] * (1 << 48) + n[real], side="right") - 1
        out[real] = container[at] + (n[real] - first[at]) // per[at]
        return pd.Series(out)

    return numbered(held, key, lots).select(key, "piece", "token_start", "tokens", place("tokens", "number").alias("container"))


def slack(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, items, tokens and the share of unused room."""
    total = packed.agg(F.countDistinct("container").alias("containers"), F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * capacity
    return total.withColumn("unused_share", F.round(F.try_divide(room - F.col("tokens"), room), 6))


def verified(packed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Per key whether its pieces cover its text without gap or overlap (whole), all but the last of them full (split_only_if_longer),
    and whether no container that holds one is overfull (fits)."""
    held = cut(packed)
    # container 0 holds the items without tokens besides; each other container holds capacity items at most
    loads = held.groupBy("container").agg(F.sum("tokens").alias("_load"))
    last = F.max("piece").over(Window.partitionBy(key))
    start = F.col("token_start") == F.col("piece") * capacity
    full = (F.col("piece") == last) | (F.col("tokens") == capacity)
    judged = held.withColumns({"_start": start, "_full": full}).join(loads, "container")
    return judged.groupBy(key).agg(
        (F.every("_start") & (F.countDistinct("piece") == F.max("piece") + 1)).alias("whole"), F.every("_full").alias("split_only_if_longer"), (F.max("_load") <= capacity).alias("fits")
    )
