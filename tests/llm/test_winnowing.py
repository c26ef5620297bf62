import random

import pytest
from sparkloom.llm import winnowing

DOC, ITEM = "doc_id bigint, text string", "item_id bigint, text string"


def shares(a, b, n=10):
    a, b = winnowing.words(a), winnowing.words(b)
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))


def found(spark, docs, items):
    got = winnowing.shared_passages(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    return {(r.doc_id, r.item_id): r.span for r in got.collect()}


def test_words():
    text = "> <b>It&#39;s</b>&nbsp;a [i]te​st[/i], na­ïve\n>> café x_y [quote=me]&amp; <br/>10%"
    assert winnowing.words(text) == ["it", "s", "a", "test", "naïve", "café", "x", "y", "10"]
    assert winnowing.words(None) == winnowing.words("") == []


def test_random_texts_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 30)))) for i in range(20)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            a = rng.randint(0, len(own) - 1)
            words[rng.randint(0, len(words)) :] = own[a : a + rng.randint(6, 14)]
        docs.append((d, " ".join(words)))
    assert set(found(spark, docs, items)) == {(d, i) for d, t in docs for i, u in items if shares(t, u)}


@pytest.mark.parametrize("n", [9, 10, 11, 25])
def test_no_span_is_missed(spark, n):
    passage = [f"p{i}" for i in range(n)]
    docs = [(k, " ".join([f"a{k}{i}" for i in range(k)] + passage + [f"b{k}{i}" for i in range(9)])) for k in range(25)]
    got = found(spark, docs, [(1, " ".join(["x"] * 7 + passage + ["y"] * 7))])
    assert got == ({(k, 1): n for k in range(25)} if n >= 10 else {})


def test_disguised_passage(spark):
    item = "When Corkel sketched the bell its ferryman measured 708 paces of amber wall"
    doc = "[quote=x]> so: WHEN&nbsp;<b>Corkel</b>, sketched\n> the be­ll -- its ferry​man [i]measured[/i] 708 paces<br/>of amber wall![/quote]"
    assert found(spark, [(1, doc)], [(5, item)]) == {(1, 5): 13}


def test_defined_results(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = [(1, text), (1, text), (2, None), (3, ""), (4, "w1 w2"), (None, text), (5, "z " * 200_000 + text)]
    assert found(spark, docs, [(1, text), (1, text), (2, None), (3, "short one"), (None, text)]) == {(1, 1): 12, (5, 1): 12}
    assert found(spark, [], [(1, text)]) == {} and found(spark, docs, []) == {}
    clash = spark.createDataFrame([(1, text, 2, "h", 3)], DOC + ", item_id int, hash string, pos int")
    items = spark.createDataFrame([(1, text, 9)], ITEM + ", doc_id int")
    assert winnowing.shared_passages(clash, items).count() == 1
    assert winnowing.leaked_items(winnowing.shared_passages(clash, items)).collect()[0].documents == 1


def test_frequent_words_make_no_candidates(spark):
    """A run of five words that all texts share is a hit of fingerprints, but no candidate without ten words in common."""
    docs = spark.createDataFrame([(d, f"a{d} b{d} c{d} d{d} e{d} how are you all today f{d} g{d} h{d} i{d} j{d}") for d in range(40)], DOC)
    items = spark.createDataFrame([(i, f"m{i} n{i} o{i} p{i} q{i} how are you all today r{i} s{i} t{i} u{i} v{i}") for i in range(40)] + [(99, "x b7 c7 d7 e7 how are you all today f7")], ITEM)
    got = winnowing.candidates(docs, items, "doc_id", "item_id").collect()
    assert [(r["_doc"], r["_item"], r.span, r.doc_at, r.item_at) for r in got] == [(7, 99, 10, 1, 1)]


def test_longest_run():
    assert winnowing.longest_run([(1, 1), (5, 2), (2, 2), (6, 3), (7, 4), (9, 9)]) == (3, 5, 2)


def test_texts_under_one_key_are_told_apart(spark):
    passage = [f"p{i}" for i in range(20)]
    docs = [(1, " ".join(passage[:12])), (1, " ".join(["z"] * 8 + passage[8:]))]
    assert found(spark, docs, [(1, " ".join(passage))]) == {(1, 1): 12}
