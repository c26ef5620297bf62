"""Evaluation texts leaking into training text, found by winnowing.

Both sides become sequences of words; every run of ``k`` words is hashed, and of each window of ``w`` such
hashes the least is kept (the rightmost of equals). Two texts that share ``k + w - 1`` consecutive words share a
whole window and so its kept hash: with k = 5 and w = 6 no shared span of ten words can be missed. Fingerprints
of corpus and test items are joined. Each fingerprint carries the windows it was kept for, with a hash of all their words, so
a hit counts only if a window is the same, and it is extended from window to window to the full span. The words of
the first window of each longest span are compared at last, so no two hashes that happen to be equal can make a case.

Words are runs of letters and digits in lower case. Markup tags, entities, invisible characters, quote marks,
punctuation and line breaks don't count.

Scale: fingerprints are made in Arrow batches with numpy; about 2/(w+1) of the hashes are kept. A fingerprint that many
texts share gives a hit only where ten words agree, so what is written to the shared folder, when the query is built, is
as large as the result. Only the documents in it are read again, each is split once, and with it go ten words per item, no
item's text. The side of the test items is broadcast only as far as Spark finds it small; otherwise both sides are shuffled by hash.

Defined results: null and empty texts, and texts or items shorter than the span, give nothing; repeated
documents are each reported under their id, rows with the same id and item once with the longest span; repeated
items each count; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut

K, W = 5, 6
#: Texts whose words are held at a time.
TEXTS_AT_ONCE = 2_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?(?:quote|b|i|u|s|url|img|code|color|size|font|list|spoiler)(?:=[^\]\n]*)?\]", re.IGNORECASE)
# Code points of invisible characters, first and last.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0xFEFF, 0xFEFF))
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE) + "]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text, markup and invisible characters aside."""
    if not text:
        return []
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text.lower())


def fingerprints(texts: list[str | None], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, hash, number of windows) of all kept hashes, and (first word, hash of all words) of all windows in their order, for a batch of texts at once."""
    lists = [words(t) for t in texts]
    size = np.array([len(x) for x in lists], dtype=np.int64)
    enough = np.flatnonzero(size >= k + w - 1)
    none = np.empty(0, dtype=np.int64)
    if not len(enough):
        return none, none, none, none, none
    flat = np.array([x for i in enough for x in lists[i]], dtype=object)
    hashed = pd.util.hash_array(flat)
    owner = np.repeat(enough, size[enough])
    starts = np.repeat(np.r_[0, np.cumsum(size[enough])[:-1]], size[enough])
    place = np.arange(len(flat)) - starts
    grams = _hashes(hashed, k)
    windows = len(grams) - w + 1
    least, at = grams[:windows].copy(), np.arange(windows)
    for i in range(1, w):
        newer = grams[i : windows + i]
        better = newer <= least
        least[better] = newer[better]
        at[better] = np.flatnonzero(better) + i
    inside = np.flatnonzero(owner[:windows] == owner[k + w - 2 : windows + k + w - 2])
    kept = at[inside]  # never falls from window to window
    first = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
    whole = _hashes(hashed, k + w - 1)[inside]
    return owner[kept[first]], grams[kept[first]].view(np.int64), np.diff(np.r_[first, len(kept)]), place[inside], whole.view(np.int64)


def _hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words."""
    grams = np.zeros(len(hashed) - n + 1, dtype=np.uint64)
    for i in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(hashed) - n + 1 + i]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return grams ^ (grams >> np.uint64(32))


def _copy(text: str):
    """Tells apart different texts under one key."""
    return F.xxhash64(text)


def fingerprint_table(rows: DataFrame, key: str, text: str, k: int = K, w: int = W) -> DataFrame:
    """_key, _copy, hash, windows (of at, words) for every kept hash of every text."""
    kind = rows.schema[key].dataType.simpleString()
    fields = [("at", pa.int32()), ("words", pa.int64())]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                owner, hashes, counts, at, whole = fingerprints(part.column(2).to_pylist(), k, w)
                structs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(whole, pa.int64())], fields=[pa.field(*f) for f in fields])
                windows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), structs)
                index = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(hashes, pa.int64()), windows], ["_key", "_copy", "hash", "windows"])

    chosen = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), _copy(text).alias("_copy"), F.col(text).alias("_text"))
    return chosen.mapInArrow(make, f"_key {kind}, _copy long, hash long, windows array<struct<at:int,words:long>>")


def longest_run(pairs: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(length, first of both) of the longest run of pairs that grow together."""
    known, best = set(pairs), (0, 0, 0)
    for i, j in sorted(known):
        if (i - 1, j - 1) in known:
            continue
        n = 1
        while (i + n, j + n) in known:
            n += 1
        if n > best[0]:
            best = (n, i, j)
    return best


def candidates(documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Pairs with a window in common: _doc, _doc_copy, _item, _item_copy, span, doc_at, item_at (the first words of the longest span)."""
    corpus = fingerprint_table(documents, doc_key, text, k, w).select(F.col("_key").alias("_doc"), F.col("_copy").alias("_doc_copy"), "hash", F.col("windows").alias("_windows"))
    tests = cut(fingerprint_table(items, item_key, text, k, w).select(F.col("_key").alias("_item"), F.col("_copy").alias("_item_copy"), "hash", "windows"))
    met = corpus.join(tests, "hash").where(F.arrays_overlap(F.transform("_windows", lambda x: x["words"]), F.transform("windows", lambda x: x["words"])))
    same = F.flatten(F.transform("_windows", lambda d: F.transform(F.filter("windows", lambda i: i["words"] == d["words"]), lambda i: F.struct(d["at"].alias("d"), i["at"].alias("i")))))
    pairs = met.groupBy("_doc", "_doc_copy", "_item", "_item_copy").agg(F.flatten(F.collect_set(same)).alias("pairs"))

    @F.pandas_udf("struct<span:int,doc_at:int,item_at:int>")
    def longest(column: pd.Series) -> pd.DataFrame:
        runs = [longest_run([(x["d"], x["i"]) for x in pairs]) for pairs in column]
        return pd.DataFrame([(n + k + w - 2, i, j) for n, i, j in runs], columns=["span", "doc_at", "item_at"], dtype="int32")

    return pairs.select("_doc", "_doc_copy", "_item", "_item_copy", longest("pairs").alias("x")).select("_doc", "_doc_copy", "_item", "_item_copy", "x.*")


def shared_passages(
    documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", k: int = K, w: int = W
) -> DataFrame:
    """Documents that share at least ``k + w - 1`` consecutive words with an item: doc_key, item_key, span (in words)."""
    n = k + w - 1

    @F.pandas_udf("array<string>")
    def cut_out(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, at in zip(texts, places, strict=True):
            own = words(t)
            out.append([" ".join(own[i : i + n]) for i in at])
        return pd.Series(out)

    def first_words(rows: DataFrame, key: str, side: str, found: DataFrame) -> DataFrame:
        """Of every text in ``found`` the words at the places asked for; each text is split once."""
        asked = found.groupBy(f"_{side}", f"_{side}_copy").agg(F.sort_array(F.collect_set(f"{side}_at")).alias("_at"))
        texts = rows.select(F.col(key).alias(f"_{side}"), _copy(text).alias(f"_{side}_copy"), F.col(text).alias("_text"))
        met = texts.join(asked, [f"_{side}", f"_{side}_copy"]).select(f"_{side}", f"_{side}_copy", "_at", cut_out("_text", "_at").alias("_words"))
        opened = met.select(f"_{side}", f"_{side}_copy", F.explode(F.arrays_zip("_at", "_words")).alias("_x"))
        return opened.select(f"_{side}", f"_{side}_copy", F.col("_x._at").alias(f"{side}_at"), F.col("_x._words").alias(f"_{side}_words")).distinct()

    found = cut(candidates(documents, items, doc_key, item_key, text, k, w))
    checked = found
    for rows, key, side in ((documents, doc_key, "doc"), (items, item_key, "item")):
        checked = checked.join(first_words(rows, key, side, found), [f"_{side}", f"_{side}_copy", f"{side}_at"])
    same = checked.where(F.col("_doc_words") == F.col("_item_words"))
    return same.groupBy(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key)).agg(F.max("span").alias("span"))


def leaked_items(passages: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id") -> DataFrame:
    """Per leaked item the number of documents and the longest span."""
    return passages.groupBy(item_key).agg(F.countDistinct(doc_key).alias("documents"), F.max("span").alias("longest_span"))
