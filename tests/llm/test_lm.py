import collections
import math
import zlib

import pytest

from strandline.llm import lm

from .helpers import DOCS, ODD, ascii_words, documents


def brute(docs, order, prior):
    """Scores by plain counting: {row number: (n_tokens, n_known, N, base, score)}."""
    tokens = [[b" "] + ascii_words(t) + [b""] for _, t, *_ in docs]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in docs]
    grams = collections.Counter()
    for ws, t in zip(tokens, train):
        if t:
            for k in range(1, order + 1):
                grams.update(tuple(ws[i - k + 1 : i + 1]) for i in range(k - 1, len(ws)))
    words = {g: n for g, n in grams.items() if len(g) == 1 and g != (b" ",)}
    n, v = sum(words.values()), len(words)

    def prob(ws, i, k):
        if k == 1:
            return (grams[(ws[i],)] + 1) / (n + v + 1)
        context = tuple(ws[i - k + 1 : i])
        lower = prob(ws, i, k - 1)
        return (grams[(*context, ws[i])] + prior * lower) / (grams[context] + prior) if len(context) == k - 1 and grams[context] else lower

    out = []
    for ws in tokens:
        base = sum(math.log10((grams[(w,)] + 1) / (n + v + 1)) for w in ws[1:])
        score = sum(math.log10(prob(ws, i, min(order, i + 1))) for i in range(1, len(ws)))
        out.append((len(ws) - 1, sum(grams[(w,)] > 0 for w in ws[1:]), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_plain_counting(spark, order):
    short = [r if r[0] != 7 else (7, r[1][:900], *r[2:]) for r in ODD] + [(k, f"the quick w{k % 5} fox {k}", "en", "a", 1) for k in range(20, 60)]
    found = lm.score(documents(spark, short, clash=("held_out", "block", "score")), order=order, prior=2.5).collect()
    want = sorted(zip([d[0] for d in short], brute(short, order, 2.5)), key=repr)
    got = sorted(((r.doc_id, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in found), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted(g[1][:3] for g in got) == sorted(w[1][:3] for w in want)
    for k in (3, 4):
        assert sorted(g[1][k] for g in got) == pytest.approx(sorted(w[1][k] for w in want), abs=1e-8)
    assert {r.held_out for r in found if r.doc_id is None} == {False}


def test_blocks_do_not_change_scores(spark, monkeypatch):
    d = documents(spark)
    one = sorted(round(r.score, 8) for r in lm.score(d).collect())
    for name, n in (("LEAST_TOKENS", 7), ("MOST_TOKENS", 7), ("PART_BLOCKS", 1)):
        monkeypatch.setattr(lm, name, n)
    assert sorted(round(r.score, 8) for r in lm.score(d.repartition(3)).collect()) == one


def test_empty_table_and_no_training_rows(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).collect() == []
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    found = lm.score(spark.createDataFrame([(i, "a b", "en", "a", 3) for i in out], DOCS)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0.0 for r in found)


def test_model_beats_unigrams_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    better = lm.score(d).filter("held_out").selectExpr("avg(int(score > base_score))", "sum(score) > sum(base_score)").first()
    assert better[0] > 0.8 and better[1]


def test_requests_grow_as_the_corpus_does():
    rows = lambda t: t // lm.block_tokens(t) * max(4, t // (lm.PART_BLOCKS * lm.block_tokens(t)))
    for t in (2 * 10**7, 10**8, 2 * 10**8):
        assert 4.5 < rows(5 * t) / rows(t) < 5.5
    assert lm.block_tokens(0) == lm.LEAST_TOKENS and lm.block_tokens(10**15) == lm.MOST_TOKENS
