import itertools
import random
from collections import Counter

from pyspark.sql import functions as F
from sparkloom.llm import packing


def best_fill(sizes, capacity):
    """The fullest container that holds the longest item, by trying all subsets."""
    longest, *rest = sorted(sizes, reverse=True)
    return max(longest + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if longest + sum(c) <= capacity)


def test_fullest_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(10, 60)
        sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        chosen = packing.fullest({s: sizes[s] for s in sorted(sizes, reverse=True)}, capacity)
        assert all(k <= sizes[s] for s, k in chosen.items()) and max(sizes) in chosen
        assert sum(s * k for s, k in chosen.items()) == best_fill(list(sizes.elements()), capacity)


def test_patterns_use_every_item_once():
    rng = random.Random(2)
    histogram = Counter(min(2048, int(rng.expovariate(1 / 150)) + 1) for _ in range(50_000))
    plan = packing.patterns(dict(histogram))
    used = Counter()
    for times, chosen in plan:
        assert sum(s * k for s, k in chosen.items()) <= 2048
        for s, k in chosen.items():
            used[s] += times * k
    assert used == histogram
    containers, least = sum(t for t, _ in plan), -(-sum(s * n for s, n in histogram.items()) // 2048)
    assert containers <= 1.002 * least + 1


def test_pack_whole_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["stove", "axle", "ledger", "é", "\n"]) for _ in range(rng.randint(0, 700))) for _ in range(400)] + [None, "", "word " * 5_000, "x" * 30_000]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int, lot int")
    counts = packing.token_counts(docs)
    packed = packing.pack(packing.pieces(counts), lot_items=50).cache()
    tokens = {r.doc_id: r.tokens for r in counts.collect()}
    assert len(tokens) == len(texts) and tokens[400] == 0
    encoding = packing._encoding(*packing.default_vocabulary())
    assert all(tokens[i] == len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts))
    rows = packed.collect()
    for i in tokens:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.token_start for r in own] == [2048 * k for k in range(len(own))] and sum(r.tokens for r in own) == tokens[i]
        assert len(own) == max(1, -(-tokens[i] // 2048)) and all(r.tokens == 2048 for r in own[:-1])
    fill = Counter()
    for r in rows:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 2048 and set(fill) == set(range(len(fill)))
    assert packing.slack(packed).collect()[0].items == len(rows)


def test_numbers_have_no_gaps(spark):
    items = spark.range(1_000).select((F.col("id") % 3).alias("tokens"), F.lit(7).alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") * 7919 % 1000).alias("lot"))
    got = packing.numbered(items, "doc_id", 16).groupBy("tokens").agg(F.sort_array(F.collect_list("number")).alias("n")).collect()
    assert all(list(r.n) == list(range(len(r.n))) for r in got) and sum(len(r.n) for r in got) == 1_000


def test_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(packing.pieces(packing.token_counts(empty))).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "a b c")], "doc_id bigint, text string")
    assert packing.pack(packing.pieces(packing.token_counts(same))).count() == 6


def test_verified(spark):
    schema = "doc_id bigint, piece int, token_start bigint, tokens bigint, container bigint"
    good = [(1, 0, 0, 2048, 1), (1, 1, 2048, 10, 2), (2, 0, 0, 2038, 2), (3, 0, 0, 0, 0)]
    bad = [(4, 0, 0, 2048, 3), (4, 2, 4096, 1, 4), (5, 0, 0, 2000, 5), (6, 0, 0, 49, 5), (7, 0, 0, 9, 6), (7, 1, 2048, 9, 6)]
    got = {r.doc_id: (r.whole, r.split_only_if_longer, r.fits) for r in packing.verified(spark.createDataFrame(good + bad, schema)).collect()}
    ok = (True, True, True)
    assert got == {1: ok, 2: ok, 3: ok, 4: (False, True, True), 5: (True, True, False), 6: (True, True, False), 7: (True, False, True)}
