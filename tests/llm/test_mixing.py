import random

import pytest

from strandline.llm import mixing

from .helpers import ODD, documents


def waterfill(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    """Reshare the excess of sources above their limit until there is none, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    held, total = {}, budget * sum(sizes.values())
    while True:
        left, share = total - sum(held.values()), sum(w[s] for s in names if s not in held)
        goal = held | {s: left * w[s] / share for s in names if s not in held}
        over = {s: epochs * sizes[s] for s in names if s not in held and goal[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return goal
        held |= over


def test_targets_and_taken_words(spark):
    pick = random.Random(1)
    sources = ["a", "b", "B", "é", "zz", None, "c"]
    docs = [(k, " ".join(["w"] * pick.choice([0, 1, 5, 40, 300])), "en", sources[0] if k % 3 == 0 else pick.choice(sources), 1) for k in range(500)]
    found = mixing.schedule(documents(spark, docs, clash=("size", "key", "range", "target", "w", "k"))).collect()
    assert len(found) == len(docs)
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    goal = waterfill(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.5
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=4)
    again = mixing.schedule(documents(spark, docs).repartition(7)).collect()
    assert sorted((r.row.doc_id, r.taken) for r in again) == sorted((r.row.doc_id, r.taken) for r in found)


def test_queue_is_served_in_order_of_finish(spark):
    docs = [(k, "w " * 10, "en", "ab"[k % 2], 1) for k in range(100)]
    found = mixing.schedule(documents(spark, docs)).collect()
    for s in "ab":
        own = sorted((r.finish, r.taken) for r in found if r.source == s)
        assert [t for _, t in own] == sorted((t for _, t in own), reverse=True)


def test_mix_has_whole_documents_near_the_targets(spark):
    docs = [(k, f"w{k} " * (1 + k % 30), "en", "abc"[k % 3], 1) for k in range(300)]
    d = documents(spark, docs, clash=("size", "times", "finish", "row", "at"))
    out = mixing.mix(d)
    assert out.columns == d.columns
    texts, got = {t for _, t, *_ in docs}, {}
    for r in out.collect():
        assert r.text in texts
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    sizes = {s: sum(len(t.split()) for _, t, _, x, _ in docs if x == s) for s in "abc"}
    goal = waterfill(sizes)
    assert all(abs(got[s] - goal[s]) <= 16 for s in sizes)


def test_odd_rows_and_empty_table(spark):
    found = mixing.schedule(documents(spark)).collect()
    assert len(found) == len(ODD)
    assert all(r.taken == 0 for r in found if r.size == 0)
    assert {r.source for r in found} == {"a", "b", "c", None}
    assert mixing.schedule(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).collect() == []
    assert all(r.target == 0 for r in mixing.schedule(documents(spark, [(1, "", "en", "a", 0)])).collect())


def plain_cut(rows, budget, packet, epochs=2):
    """All packets of all rows in one list, sorted and cut: words taken by row."""
    items, took = [], [0] * len(rows)
    for nr, r in enumerate(rows):
        for e in range(epochs if r.target > 0 else 0):
            for at in range(0, r.size, packet):
                w = min(packet, r.size - at)
                items.append(((r.start + e * r.source_size + at + w) / r.target, r.rank, w, nr))
    for _, _, w, nr in sorted(items):
        took[nr] += (w := min(w, budget))
        budget -= w
    return took


def test_the_cut_is_that_of_all_packets_sorted(spark):
    pick = random.Random(4)
    rows, start = [], {}
    for _ in range(400):
        rank, size = pick.choice([1, 1, 1, 2, 3, 4]), pick.choice([0, 1, 15, 16, 17, 90, 700])
        rows.append([rank, size, start.get(rank, 0)])
        start[rank] = start.get(rank, 0) + size
    goal = {1: start[1] * 1.1, 2: start[2] * 2.0, 3: start[3] * 2.0, 4: 0.0}
    d = spark.createDataFrame([(*r, start[r[0]], goal[r[0]]) for r in rows], "rank int, size long, start long, source_size long, target double").repartition(3)
    shape, n = (mixing.RANGES, mixing.SORTED), int(sum(goal.values()))
    try:
        for budget in (0, 1, 5, n // 3, n - 1, n, 10 * n):
            for packet in (1, 16, 1000):
                # few ranges and little to sort, so the range of the cut is cut several times
                mixing.RANGES, mixing.SORTED = ((4, 3), shape)[packet == 16]
                at = mixing.cut(d, budget, packet=packet)
                got = d.withColumn("taken", mixing.taken(at, packet=packet)).collect()
                assert [r.taken for r in got] == plain_cut(got, budget, packet), (budget, packet)
    finally:
        mixing.RANGES, mixing.SORTED = shape


def test_sources_come_within_a_packet_of_their_targets(spark, sf):
    found = mixing.schedule(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    got, goal = {}, {}
    for r in found:
        got[r.source] = got.get(r.source, 0) + r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(got[s] - goal[s]) <= mixing.PACKET for s in goal) and len(goal) > 5
    assert sum(got.values()) == int(1.5 * sum(r.size for r in found))
