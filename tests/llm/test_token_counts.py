from collections import Counter

import pytest

from strandline.llm import queries
from strandline.llm import token_counts as T

from .helpers import ODD, documents


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}


def brute(rows):
    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.read_ranks(), special_tokens={})
    docs, tokens = Counter(), Counter()
    for _, t, lang, source, _ in rows:
        for name, n in (("words-1", len((t or "").encode().split())), ("bpe", len(coder.encode_ordinary(t or "")))):
            docs[source, lang, name] += 1
            tokens[source, lang, name] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def test_insert_delete_revise_and_replay(spark):
    ranks = T.read_ranks()
    counted = T.count_tokens(documents(spark, clash=("tokens", "words", "pairs", "tokenizer", "revised")), ranks, "bpe")
    rollup = T.fresh(spark)
    assert totals(rollup) == {}
    assert rollup.commit("one", T.insert(counted)) and totals(rollup) == brute(ODD)
    assert not rollup.commit("one", T.insert(counted)) and totals(rollup) == brute(ODD)
    assert rollup.commit("two", T.delete(counted.filter("doc_id = 7")))
    assert totals(rollup) == brute([r for r in ODD if r[0] != 7])
    changed = [(6, "zwei Wörter mehr sind vier", "de", "c", 26)]
    new = T.count_tokens(documents(spark, changed), ranks, "bpe")
    assert rollup.commit("three", T.revise(counted.filter("doc_id = 6"), new))
    assert not rollup.commit("three", T.revise(counted.filter("doc_id = 6"), new))
    left = [r for r in ODD if r[0] not in (6, 7)] + changed
    assert totals(rollup) == brute(left)
    assert rollup.commit("four", T.delete(counted).limit(0)) and totals(rollup) == brute(left)
    assert totals(T.Rollup(spark, rollup.path)) == brute(left)


def test_batch_without_its_mark_is_written_again(spark):
    rollup = T.fresh(spark)
    one = spark.createDataFrame([("a", "en", "t", 1, 5)], T.DELTA)
    rollup.commit("x", one)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{rollup.path}/batch=x/_SUCCESS")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)
    assert rollup.commit("x", one) and totals(rollup) == {("a", "en", "t"): (1, 5)}


def test_groups_that_come_to_nothing_go(spark):
    rollup = T.fresh(spark)
    one = spark.createDataFrame([("a", None, "t", 1, 5), (None, None, None, 1, None)], T.DELTA)
    rollup.commit("in", one)
    assert totals(rollup) == {("a", None, "t"): (1, 5), (None, None, None): (1, 0)}
    rollup.commit("out", one.selectExpr("source", "lang", "tokenizer", "-sign as sign", "tokens"))
    assert totals(rollup) == {}


def lines_once(text):
    return "\n".join(dict.fromkeys(text.split("\n")))


def query(spark, folder, rows, labels):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in queries.op2_token_counts(spark, str(folder)).collect()}


def test_query_with_repeated_ids_and_odd_rows(spark, tmp_path):
    repeated = [(1, "a a a", "en", "s", 5), (1, "b\nb\nb", "en", "s", 5), (2, "c", "en", "s", 1)]
    rows = [*ODD, *repeated, (10, "x\nx", "en", "a", 3), (10, "x\nx", "en", "a", 3), (11, "bad\nbad", "de", None, 7), (12, "\n\n", "en", "a", 2)]
    labels = [(1, 0, 0), (1, 1, 0), (2, 1, 0), (10, 0, 0), (11, 0, 1), (12, 0, 0), (7, None, 1), (8, 1, None), (None, 0, 0), (99, 0, 0)]
    toxic = {i for i, _, x in labels if x == 1}
    low = {i for i, q, x in labels if i is not None and q == 0} - toxic
    left = [(i, lines_once(t) if i in low and t else t, *rest) for i, t, *rest in rows if i not in toxic]
    want = {(s, lang, "byte_bpe_50k-1" if n == "bpe" else n): x for (s, lang, n), x in brute(left).items()}
    assert query(spark, tmp_path, rows, labels) == want
    assert want["s", "en", "words-1"] == (3, 5)


def test_query_over_empty_tables(spark, tmp_path):
    assert query(spark, tmp_path, [], []) == {}


def test_a_batch_without_its_mark_does_not_count(spark):
    rollup = T.fresh(spark)
    rollup.commit("whole", spark.createDataFrame([("a", "en", "t", 1, 5)], T.DELTA))
    spark.createDataFrame([("a", "en", "t", 100, 7)], T.CHANGE).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{rollup.path}/batch=torn")
    assert totals(rollup) == {("a", "en", "t"): (1, 5)} and not rollup.committed("torn")
    for name in ("", "*", "a/b", "x{1,2}", "..", "a b", None):
        with pytest.raises((ValueError, TypeError)):
            rollup.commit(name, spark.createDataFrame([], T.DELTA))
