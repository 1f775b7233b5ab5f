import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import sharding

from .helpers import ODD, documents


def test_sizes_slots_and_digests_of_odd_rows(spark):
    found = sharding.shard(documents(spark, clash=("size", "shard", "slot", "at", "range", "n", "first"))).collect()
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(documents(spark, [])).collect() == []


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000)
    for n in (8, 9, 12):
        r = ids.select(sharding.descend(F.col("id"), sharding.topology(n)).alias("a"), sharding.descend(F.col("id"), sharding.topology(n + 1)).alias("b")).collect()
        assert all(x.a == x.b or x.b == n for x in r)
        counts = Counter(x.b for x in r)
        assert set(counts) == set(range(n + 1))
        assert all(abs(c - 20_000 / (n + 1)) < 6 * (20_000 / (n + 1)) ** 0.5 for c in counts.values())


def test_weights_steer_and_movement_stays_in_the_changed_subtree(spark):
    ids = spark.range(20_000)
    even, heavy = sharding.topology(8), sharding.topology(8, [1, 1, 1, 1, 1, 1, 1, 3])
    r = ids.select(sharding.descend(F.col("id"), even).alias("a"), sharding.descend(F.col("id"), heavy).alias("b")).collect()
    region = lambda s: s // 4
    assert Counter(x.b for x in r)[7] == pytest.approx(6000, rel=0.1)
    assert all(x.a == x.b or region(x.b) == 1 for x in r)  # nothing moves within the region that kept its weight
    gone = sharding.topology(8, [1, 1, 1, 0, 1, 1, 1, 1])
    assert 3 not in {x.s for x in ids.select(sharding.descend(F.col("id"), gone).alias("s")).collect()}


def test_placing_depends_on_the_id_alone(spark):
    a = documents(spark, [(k, f"text {k}", "en", "a", 1) for k in range(200)])
    b = documents(spark, [(k, f"other {k}", "de", "b", 1) for k in range(50, 400)])
    x, y = ({r.doc_id: r.shard for r in sharding.shard(d).collect()} for d in (a, b))
    assert all(x[k] == y[k] for k in range(50, 200))


def plain_descent(doc_id, shards, base, weights=None):
    """The way down by the rule: at each level the child of the least exponential draw over its weight wins."""
    w = weights or [1.0] * shards
    draw = lambda name, weight: -math.log((int(hashlib.md5(f"{'null' if doc_id is None else doc_id}|{name}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / weight
    regions = {f"region{r}": {f"rack{k}": [f"shard{s}" for s in range(2 * k, min(2 * k + 2, base, shards))] for k in (2 * r, 2 * r + 1) if 2 * k < min(base, shards)} for r in range(-(-min(base, shards) // 4))}
    regions |= {f"region-of-shard{s}": {f"rack-of-shard{s}": [f"shard{s}"]} for s in range(base, shards)}
    weight = lambda names: sum(w[int(x[5:])] for x in names)
    least = lambda children: min(children, key=lambda c: draw(c[0], c[1]))[0]
    region = least([(r, weight([x for rack in racks.values() for x in rack])) for r, racks in regions.items()])
    rack = least([(k, weight(v)) for k, v in regions[region].items()])
    return int(least([(x, weight([x])) for x in regions[region][rack]])[5:])


def test_the_law_holds_for_every_number_of_shards(spark):
    docs = documents(spark, [(k, f"t{k}", "en", "a", 1) for k in range(400)] + [(None, "x", "en", "a", 1)])
    for n in range(1, 13):
        found = sharding.shard(docs, n).collect()
        base = min(n, sharding.BASE_SHARDS)
        assert all(r.shard == plain_descent(r.doc_id, n, base) and r.grown_shard == plain_descent(r.doc_id, n + 1, base) for r in found)
        assert all(r.grown_shard in (r.shard, n) for r in found) and any(r.grown_shard == n for r in found)
    grown = {r.doc_id: r.grown_shard for r in sharding.shard(docs, 7).collect()}
    then = sharding.shard(docs, 8, base=7).collect()
    assert all(r.shard == grown[r.doc_id] and r.grown_shard in (r.shard, 8) for r in then)


def test_the_querys_rows_go_down_as_by_the_rule(spark, sf):
    from strandline.llm import queries

    for r in queries.op6_shards(spark, sf).collect():
        assert r.shard == plain_descent(r.doc_id, 8, 8) and r.grown_shard == plain_descent(r.doc_id, 9, 8)
