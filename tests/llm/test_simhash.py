import random
from itertools import combinations

import pytest
from xxhash import xxh64_intdigest

from strandline.llm import passages, simhash

from .helpers import ODD, ascii_words, documents


def brute_fingerprint(text):
    w = ascii_words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    home = {n: n for n in nodes}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_of_odd_rows(spark):
    found = simhash.near_duplicates(documents(spark, clash=("fp", "rep", "component_id", "node"))).collect()
    assert len(found) == len(ODD)
    want = sorted(((i, brute_fingerprint(t)) for i, t, *_ in ODD), key=repr)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1) for r in found), key=repr) == want
    by = {r.doc_id: r.component_id for r in found}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3
    assert {r.component_id for r in found if r.doc_id is None and r.fp == 0} == {3}


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("crowd", [2, 64])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, bits, crowd):
    pick = random.Random(bits)
    base = [pick.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for k in pick.sample(range(64), pick.choice([1, 1, 2, 3, 5])):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    d = spark.createDataFrame([(simhash._long(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    links = [(r.u, r.v) for r in simhash.links(d, bits, crowd).collect()]
    near = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= bits]
    nodes = range(len(fps))
    want = brute_components(nodes, near)
    assert brute_components(nodes, links) == want
    from strandline.llm.components import components

    roots = {r.node: r.root for r in components(spark.createDataFrame(links or [(0, 0)], "u long, v long")).collect()}
    assert {n: roots.get(n, n) for n in nodes} == want


def test_manhattan_never_exceeds_hamming():
    pick = random.Random(3)

    def unary(x):
        return ((x & x >> 1) & 0x5555555555555555) << 1 | (x | x >> 1) & 0x5555555555555555

    for _ in range(2000):
        a = pick.getrandbits(64)
        b = a ^ sum(1 << k for k in pick.sample(range(64), pick.randrange(6)))
        assert (unary(a) ^ unary(b)).bit_count() <= (a ^ b).bit_count()


def test_keep_one_keeps_rows_whole(spark):
    d = documents(spark, clash=("fp", "component_id"))
    left = simhash.keep_one(d)
    assert left.columns == d.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9]
    assert ids.count(None) == 2


def test_near_copies_with_several_edits_go(spark):
    pick = random.Random(11)
    vocabulary = [f"w{k}" for k in range(900)]
    docs, kin, passage = [], {}, " ".join(pick.choices(vocabulary, k=60))
    for k in range(40):
        w = pick.choices(vocabulary, k=pick.choice([12, 30, 90, 250, 700]))
        if k % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        docs.append((k, " ".join(w)))
        for j in (1, 2):
            x = list(w)
            for at in pick.sample(range(len(x)), len(x) // 60):
                x[at] = "changed"
            kin[100 * j + k] = k
            docs.append((100 * j + k, " ".join([*x, "end"])))
    d = documents(spark, [(i, t, "en", "a", 1) for i, t in docs])
    texts = dict(docs)
    near = {i for i, k in kin.items() if passages.similarity(texts[i], texts[k]) >= 0.8}
    assert len(near) > 60
    left = {r.doc_id for r in simhash.keep_one(d).collect()}
    assert set(range(40)) <= left and len(near & left) <= 0.02 * len(near)
    assert not any(passages.similarity(texts[i], texts[k]) < 0.6 and i not in left for i, k in kin.items())
    found = [(r.u, r.v) for r in passages.near_copies(d, d.select("doc_id").limit(0)).collect()]
    assert found and all(passages.similarity(texts[u], texts[v]) >= 0.8 for u, v in found)


def edited(pick, n, words, at=1):
    """Copies of ``words`` with ``at`` different words edited each."""
    return [" ".join(f"x{c}" if k in where else w for k, w in enumerate(words)) for c in range(n) for where in [set(pick.sample(range(len(words)), at))]]


def brute_copies(texts, links=()):
    near = [(a, b) for a, b in combinations(texts, 2) if passages.similarity(texts[a], texts[b]) >= 0.8]
    return brute_components(texts, [*near, *links])


def test_near_copies_span_what_brute_force_links(spark):
    pick = random.Random(5)
    words = lambda n: [f"v{k}" for k in pick.sample(range(10**6), n)]
    texts = []
    for size in (60, 60, 200):
        base = words(size)
        texts += [" ".join(base), *edited(pick, 100, base, size // 60)]
    chain = words(300)
    for k in range(60):
        chain[pick.randrange(300)] = f"r{k}"
        texts.append(" ".join(chain))
    passage = words(90)
    texts += [" ".join([*passage, *words(pick.choice([4, 8, 12, 20, 60]))]) for _ in range(150)]
    texts += ["a b", "a b", "a b c", "", None]
    pick.shuffle(texts)
    texts = dict(enumerate(texts))
    d = documents(spark, [(i, t, "en", "a", 1) for i, t in texts.items()])
    found = [(r.u, r.v) for r in passages.near_copies(d, d.select("doc_id").limit(0)).collect()]
    blank = [i for i, t in texts.items() if not t]
    want = brute_copies({i: t for i, t in texts.items() if t})
    assert brute_components(texts, found) == want | {i: i for i in blank}
    assert all(passages.similarity(texts[u], texts[v]) >= 0.8 for u, v in found)


def test_original_amid_its_copies_leaves_one(spark):
    pick = random.Random(1)
    base = [f"v{k}" for k in range(60)]
    copies = edited(pick, 100, base)
    texts = dict(enumerate([*copies[:50], " ".join(base), *copies[50:]]))
    left = {r.doc_id for r in simhash.keep_one(documents(spark, [(i, t, "en", "a", 1) for i, t in texts.items()])).collect()}
    assert left == {i for i, r in brute_copies(texts).items() if i == r}
    assert len(left) == 1


def test_links_lead_through_rows_their_fingerprint_removes(spark):
    pick = random.Random(4)
    words, texts = [f"v{k}" for k in range(300)], []
    for k in range(100):
        words[pick.randrange(300)] = f"r{k}"
        texts.append(" ".join(words))
    pick.shuffle(texts)
    texts = dict(enumerate(texts))
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(texts, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert links
    left = {r.doc_id for r in simhash.keep_one(documents(spark, [(i, t, "en", "a", 1) for i, t in texts.items()])).collect()}
    assert left == {i for i, r in brute_copies(texts, links).items() if i == r} and len(left) == 1


def test_long_chain_is_one_component(spark):
    from strandline.llm.components import components

    edges = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(5, 5), (None, 3), (7, 6)], "u long, v long")
    found = components(edges).collect()
    assert {r.root for r in found} == {0} and sorted(r.node for r in found) == list(range(1, 301))


def test_one_id_with_different_texts_loses_neither(spark):
    words = lambda seed: " ".join(random.Random(seed).choices([f"w{k}" for k in range(5000)], k=80))
    docs = [(1, words(1)), (1, words(2)), (2, words(1) + " end"), (3, words(3)), (3, words(3)), (4, words(2)), (5, words(5)), (5, words(6)), (5, words(6))]
    d = documents(spark, [(i, t, "en", "a", 1) for i, t in docs], clash=("_node", "_row", "fp", "node", "_shared"))
    left = simhash.keep_one(d)
    assert left.columns == d.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    # one text of each group, every text that stands alone, and no row twice
    assert len(kept) == len(set(kept)) == 5
    base = {t.removesuffix(" end") for _, t in kept}
    assert base == {words(k) for k in (1, 2, 3, 5, 6)} and (3, words(3)) in kept


def test_hot_fingerprints_meet_their_component_where_they_are(spark):
    docs = [(k, "same words in every one of these" if k % 3 else f"row {k} of its own with other words", "en", "a", 1) for k in range(200)] + ODD
    want = sorted(map(repr, simhash.near_duplicates(documents(spark, docs)).collect()))
    for hot in (1, 50):
        assert sorted(map(repr, simhash.near_duplicates(documents(spark, docs), hot=hot).collect())) == want
