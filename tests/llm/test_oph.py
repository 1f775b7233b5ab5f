import hashlib
import random

from pyspark.sql import functions as F

from strandline.llm import oph

from .helpers import ODD, documents


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    """(doc_id, n_chars, edited) by the rule, ids ascending, null ids first."""
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + after[:half], after, t))
    return out


def test_edited_texts_and_likeness(spark):
    pick = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = [(3 * k, " ".join(pick.choices(vocabulary, k=pick.choice([3, 8, 30, 90, 300, 900]))), "en", "a", 1) for k in range(150)]
    docs += [(3 * k + 1, docs[k][1] + " and a few more words at the end", "en", "a", 1) for k in range(100)]
    found = {r.doc_id: r for r in oph.fingerprint_next(documents(spark, docs, clash=("range", "guest", "after", "tie")), rows_a_range=17).collect()}
    errors = []
    for i, n, edited, after, text in brute(docs):
        r = found[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r.near_edited - jaccard(text, edited)), abs(r.near_next - jaccard(text, after))]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 2 * oph.BINS
    assert sum(errors) / len(errors) < 0.025 and max(errors) < 0.2


def test_odd_rows(spark):
    docs = [r for r in ODD if r[0] is not None] + [(None, "no id", "en", "a", 5)]
    found = oph.fingerprint_next(documents(spark, docs)).collect()
    # rows of one id are equal here, so their order doesn't matter
    want = sorted((repr(i), n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, *_ in brute(docs))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == want
    by = {r.doc_id: r for r in found}
    assert by[1].fingerprint == by[2].fingerprint != "" and by[1].near_next == 1.0
    assert by[3].fingerprint == by[5].fingerprint == "" and by[3].near_next == 1.0 and by[5].near_next == 0.0
    assert oph.fingerprint_next(documents(spark, [])).collect() == []


def test_lone_row_follows_itself(spark):
    r = oph.fingerprint_next(documents(spark, [(4, "abcdef", "en", "a", 6)])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0


def test_bins_hold_the_least_hash_and_empty_ones_copy(spark):
    hashes = [5, -7, 2**62, -(2**63), 2**63 - 1, 2**62 + 9]
    d = spark.createDataFrame([(hashes,)], "h array<long>")
    minima = d.select(oph.bin_minima(F.col("h"), 8)).first()[0]
    want = [None] * 8
    for h in sorted(hashes):
        k = (h >> 61) + 4
        want[k] = h if want[k] is None else want[k]
    assert minima == want
    full = d.select(oph.densify(oph.bin_minima(F.col("h"), 8), 8)).first()[0]
    for k, x in enumerate(full):
        probed = next(want[oph._probe(k, t, 8)] for t in range(99) if want[oph._probe(k, t, 8)] is not None)
        assert x == (want[k] if want[k] is not None else probed)
    assert d.select(oph.densify(oph.bin_minima(F.col("h"), 8), 8, probes=0)).first()[0] != [None] * 8


def brute_ranges(found):
    by = {}
    for r in sorted(found, key=lambda r: (r.has, r.id, r.tie)):
        by.setdefault(r.range, []).append(r)
    assert list(by) == sorted(by)  # ranges follow the order
    return by


def test_ranges_hold_as_many_rows_however_ids_lie(spark):
    pick = random.Random(6)
    clustered = [2**60, -(2**62), *range(4000), *(10**12 + pick.randrange(10**4) * 10**3 for _ in range(4000))]
    one_id = [(7, f"text {k}", "en", "a", 1) for k in range(4000)]
    no_id = [(None, f"none {k}", "en", "a", 1) for k in range(3000)]
    for docs in ([(i, "t", "en", "a", 1) for i in set(clustered)], one_id + [(k, "x", "en", "a", 1) for k in range(4000)], no_id + one_id):
        by = brute_ranges(oph.in_ranges(documents(spark, docs), rows_a_range=100).collect())
        mean = len(docs) / len(by)
        assert len(by) > 0.8 * len(docs) / 100 and max(map(len, by.values())) < 2 * mean


def test_one_id_with_different_texts_goes_by_their_hashes(spark):
    docs = [(1, f"text number {k} of one id", "en", "a", 1) for k in range(60)] + [(None, f"none {k}", "en", "a", 1) for k in range(30)] + [(2, "z", "en", "a", 1)]
    d = documents(spark, docs, clash=("has", "id", "tie", "first", "guest", "before", "range"))
    tie = {r.text: r.tie for r in oph._order(d).collect()}
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = sorted((repr(i), n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, *_ in brute(order))
    for size in (3, 7, 1000):
        assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in oph.fingerprint_next(d, rows_a_range=size).collect()) == want
