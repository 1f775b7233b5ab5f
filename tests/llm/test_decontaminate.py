import random
import re
from itertools import combinations

from strandline.llm import decontaminate as D

from .helpers import ODD, documents


def tokens(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items):
    out = set()
    for i, t, *_ in docs:
        d = tokens(t)
        for k, text in items:
            w = tokens(text)
            if len(w) < 6:
                continue
            best = max((sum(0 <= o + p < len(d) and d[o + p] == x for p, x in enumerate(w)) for o in range(-len(w), len(d))), default=0)
            if best * 5 >= len(w) * 4:
                out.add((i, k, len(w), best))
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def overlaps(spark, docs, items, **how):
    found = D.overlaps(documents(spark, docs, clash=("words", "seed", "pos", "off", "matched", "item_id")), benchmark(spark, items), **how)
    return {(r.doc_id, r.item_id, r.n_words, r.matched) for r in found.collect()}


def test_masks_miss_no_overlap():
    for lengths, family in ((range(6, 15), D.SHORT_MASKS), (range(15, 25), D.MASKS)):
        masks = [[k for k, b in enumerate(m) if b == "1"] for m in family]
        for n in lengths:
            for wrong in combinations(range(n), n - -(-8 * n // 10)):
                bad = set(wrong)
                assert any(not any(s + k in bad for k in m) for m in masks for s in range(n - len(family[0]) + 1)), (n, wrong)


def test_overlaps_are_those_of_brute_force(spark):
    pick = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(pick.choices(vocabulary, k=pick.choice([4, 6, 15, 20, 37, 59])))) for k in range(30)]
    docs = []
    for k in range(150):
        body = pick.choices(vocabulary, k=pick.choice([0, 5, 60]))
        w = items[pick.randrange(30)][1].split()
        for at in pick.sample(range(len(w)), int(len(w) * pick.choice([0, 0.1, 0.2, 0.3]))):
            w[at] = "changed"
        cut = pick.choice([0, 0, 2])
        docs.append((k, " ".join([*body[:20], *(w[cut:]), *body[20:]]).upper() + ".", "en", "a", 1))
    want = brute(docs, items)
    assert len(want) > 50
    for limit in (D.BROADCAST_SEEDS, 0):
        D.BROADCAST_SEEDS, before = limit, D.BROADCAST_SEEDS
        try:
            assert overlaps(spark, docs, items) == want
        finally:
            D.BROADCAST_SEEDS = before


def test_repeated_words_and_repeated_rows(spark):
    items = [(1, "the " * 20), (2, "one two three four five six"), (2, "six five four three two one zero"), (3, None), (4, "")]
    docs = [(1, "The. " * 500, "en", "a", 1), (2, "say one two three four five six now", "en", "a", 1), (2, "say one two three four five six now", "en", "a", 1), (3, "six five four three two one zero", "en", "a", 1)]
    assert overlaps(spark, docs, items) == {(1, 1, 20, 20), (2, 2, 6, 6), (3, 2, 7, 7)}


def test_clean_keeps_odd_rows_and_drops_by_text_without_an_id(spark):
    item = "no id at all but words enough for shingles"
    d = documents(spark, clash=("k_id", "k_text", "item_id"))
    left = D.clean(d, benchmark(spark, [(1, item)]))
    assert left.columns == d.columns
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(r[0]) for r in ODD if r[1] != item)
    assert D.clean(documents(spark, []), benchmark(spark, [(1, item)])).collect() == []
    assert D.clean(d, benchmark(spark, [])).count() == len(ODD)


def test_a_seed_in_all_documents_and_large_benchmarks_change_nothing(spark):
    pick = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    common = " ".join(vocabulary[:12])
    items = [(k, common + " " + " ".join(pick.choices(vocabulary, k=12))) for k in range(10)]
    docs = [(k, " ".join([common, *pick.choices(vocabulary, k=30), items[k % 10][1] if k % 3 else "", common]), "en", "a", 1) for k in range(120)]
    want, shape = brute(docs, items), (D.BROADCAST_SEEDS, D.BROADCAST_BYTES)
    try:
        for D.BROADCAST_SEEDS, D.BROADCAST_BYTES in (shape, (0, 0)):
            assert overlaps(spark, docs, items) == want and len(want) >= 80
            d = documents(spark, docs)
            assert {r.doc_id for r in D.clean(d, benchmark(spark, items)).collect()} == {r[0] for r in docs} - {x[0] for x in want}
    finally:
        D.BROADCAST_SEEDS, D.BROADCAST_BYTES = shape
